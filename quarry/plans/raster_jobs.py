"""Raster jobs.

Fixture: every embedding of 64 floats is one 8×8 channel; three
consecutive vectors form one BGR image (images missing a channel are
dropped). The SQL oracles express each operator independently with
offset joins over the pixel table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import round_half_up
from quarry.operators import raster as RA
from quarry.plans.catalog import register
from quarry.session import scratch_path
from quarry.sources import files as FS
from quarry.sources.tables import Tables

SIDE = 8  # 64-float embeddings as 8×8 channels


def raster(t):
    """raster_from_array: posexplode the packed vector, position → (y, x)."""
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "e"))
    px = e.select(
        F.floor(F.col("vec_id") / 3).cast("bigint").alias("img"),
        F.pmod(F.col("vec_id"), F.lit(3)).cast("int").alias("ch"),
        F.floor(F.col("p") / SIDE).cast("int").alias("y"),
        F.pmod(F.col("p"), F.lit(SIDE)).cast("int").alias("x"),
        F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("e").cast("double") + 0.6) * 212.5)))
        .cast("int").alias("v"))
    return px


def colour(t):
    """The images that have all three channels: what mixes channels needs them."""
    complete = (t.embeddings.groupBy(F.floor(F.col("vec_id") / 3).cast("bigint").alias("img"))
                .agg(F.count_distinct(F.pmod(F.col("vec_id"), F.lit(3))).alias("n_ch"))
                .filter(F.col("n_ch") == 3).select("img"))
    return raster(t).join(complete, "img", "left_semi")


def gray(t):
    return RA.gray(colour(t))


def D(x: float) -> str:
    """Exact double literal for the oracle (DuckDB reads bare decimals as DECIMAL)."""
    return f"'{float(x)!r}'::DOUBLE"


RASTER_CTE = f"""
raster AS (
  SELECT (vec_id // 3)::BIGINT AS img, (vec_id % 3)::INTEGER AS ch, ((p - 1) // {SIDE})::INTEGER AS y,
         ((p - 1) % {SIDE})::INTEGER AS x,
         least(255, greatest(0, floor((e::DOUBLE + {D(0.6)}) * {D(212.5)})))::INTEGER AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(generate_series(1, len(embedding))) AS p FROM embeddings)),
colour AS (SELECT * FROM raster WHERE img IN (SELECT img FROM raster GROUP BY 1 HAVING count(DISTINCT ch) = 3)),
gray AS (
  SELECT img, 0 AS ch, y, x,
         floor({D(RA.GRAY_WEIGHTS[2])} * max(v) FILTER (WHERE ch = 2) + {D(RA.GRAY_WEIGHTS[1])} * max(v) FILTER (WHERE ch = 1)
               + {D(RA.GRAY_WEIGHTS[0])} * max(v) FILTER (WHERE ch = 0))::INTEGER AS v
  FROM colour GROUP BY img, y, x),
dims AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM raster GROUP BY img)"""


def W(body: str) -> str:
    return f"WITH {RASTER_CTE}\n{body}"


def map_sql(c: str, n: str, border: str) -> str:
    if border == "replicate":
        return f"least(greatest({c}, 0), {n} - 1)"
    if border == "reflect101":
        m = f"((({c}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)))"
        return f"(CASE WHEN {n} = 1 THEN 0 WHEN {m} >= {n} THEN 2 * ({n} - 1) - {m} ELSE {m} END)"
    if border == "reflect":
        m = f"((({c}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
        return f"(CASE WHEN {m} >= {n} THEN 2 * {n} - 1 - {m} ELSE {m} END)"
    raise ValueError(border)


def offsets_sql(taps_y, taps_x) -> str:
    """VALUES (dy, dx, w) for a separable kernel given as centred taps."""
    ry, rx = (len(taps_y) - 1) // 2, (len(taps_x) - 1) // 2
    rows = [f"({i - ry}, {j - rx}, {D(wy * wx)})" for i, wy in enumerate(taps_y) for j, wx in enumerate(taps_x)]
    return f"(VALUES {', '.join(rows)}) AS k(dy, dx, kw)"


def window_sql(src: str, radius: int, border: str | None, agg: str) -> str:
    """(img, ch, y, x, agg over the (2r+1)² neighbours); border None = only
    in-range neighbours (truncated window)."""
    offs = ", ".join(f"({dy}, {dx})" for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))
    if border is None:
        return (f"SELECT t.img, t.ch, t.y, t.x, {agg} AS v FROM {src} t CROSS JOIN (VALUES {offs}) AS k(dy, dx) "
                f"JOIN {src} s ON s.img = t.img AND s.ch = t.ch AND s.y = t.y + k.dy AND s.x = t.x + k.dx "
                "GROUP BY t.img, t.ch, t.y, t.x")
    return (f"SELECT t.img, t.ch, t.y, t.x, {agg} AS v FROM {src} t JOIN dims dm USING (img) CROSS JOIN (VALUES {offs}) AS k(dy, dx) "
            f"JOIN {src} s ON s.img = t.img AND s.ch = t.ch AND s.y = {map_sql('t.y + k.dy', 'dm.h', border)} "
            f"AND s.x = {map_sql('t.x + k.dx', 'dm.w', border)} GROUP BY t.img, t.ch, t.y, t.x")


def conv_sql(src: str, taps, border: str, dims: str = "dims") -> str:
    """Weighted sum with a separable kernel expressed as one 2-D offset
    join (exact for the dyadic kernels used here)."""
    return (f"SELECT t.img, t.ch, t.y, t.x, sum(k.kw * s.v) AS v FROM {src} t JOIN {dims} dm USING (img) CROSS JOIN "
            f"{offsets_sql(taps, taps)} JOIN {src} s ON s.img = t.img AND s.ch = t.ch "
            f"AND s.y = {map_sql('t.y + k.dy', 'dm.h', border)} AND s.x = {map_sql('t.x + k.dx', 'dm.w', border)} "
            "GROUP BY t.img, t.ch, t.y, t.x")


def u8_sql(e: str) -> str:
    return f"least(greatest(floor(({e}) + 0.5), 0), 255)::INTEGER"


# ------------------------------------------------------------------ point ops

@register("raster_from_array", sql=W("SELECT * FROM raster"))
def raster_from_array(spark, d):
    return raster(Tables(spark, d))


@register("raster_gray", sql=W("SELECT img, y, x, v FROM gray"))
def raster_gray(spark, d):
    return gray(Tables(spark, d)).select("img", "y", "x", "v")


@register("raster_channel_reorder", sql=W("SELECT img, 2 - ch AS ch, y, x, v FROM colour"))
def raster_channel_reorder(spark, d):
    return RA.channel_reorder(colour(Tables(spark, d)))


_HSV_SQL = W(f"""
, px AS (SELECT img, y, x, max(v) FILTER (WHERE ch = 0)::DOUBLE AS b, max(v) FILTER (WHERE ch = 1)::DOUBLE AS g,
               max(v) FILTER (WHERE ch = 2)::DOUBLE AS r FROM colour GROUP BY img, y, x),
m AS (SELECT *, greatest(b, g, r) AS mx, greatest(b, g, r) - least(b, g, r) AS d FROM px),
h0 AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN mx = r THEN {D(60)} * (g - b) / d
                      WHEN mx = g THEN {D(120)} + {D(60)} * (b - r) / d ELSE {D(240)} + {D(60)} * (r - g) / d END AS h FROM m)
SELECT img, y, x, floor(CASE WHEN h < 0 THEN h + {D(360)} ELSE h END / {D(2)} + 0.5)::INTEGER AS h,
       floor(CASE WHEN mx = 0 THEN 0.0::DOUBLE ELSE d * {D(255)} / mx END + 0.5)::INTEGER AS s, mx::INTEGER AS v FROM h0""")
_HSV_SQL = _HSV_SQL.replace("dims AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM raster GROUP BY img)\n,",
                            "dims AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM raster GROUP BY img),")


@register("raster_hsv", sql=_HSV_SQL)
def raster_hsv(spark, d):
    return RA.hsv(colour(Tables(spark, d)))


@register("raster_split_merge", sql=W("SELECT * FROM colour"))
def raster_split_merge(spark, d):
    """split → (b, g, r) per pixel → merge back: must give the input."""
    return RA.merge_channels(RA.split_channels(colour(Tables(spark, d))))


@register("raster_minmax_norm", sql=W("""
SELECT img, ch, y, x, floor(CASE WHEN hi > lo THEN (v - lo)::DOUBLE / (hi - lo) ELSE 0.0 END * 1e6 + 0.5) / 1e6 AS v
FROM raster JOIN (SELECT img, ch, min(v) AS lo, max(v) AS hi FROM raster GROUP BY 1, 2) USING (img, ch)"""))
def raster_minmax_norm(spark, d):
    n = RA.minmax_norm(raster(Tables(spark, d)))
    return n.withColumn("v", round_half_up("v", 6))


@register("raster_log", sql=W(f"""
SELECT img, ch, y, x, CASE WHEN mx = 0 THEN 0 WHEN v = mx THEN 255
       ELSE floor({D(255)} * ln(1.0::DOUBLE + v) / ln(1.0::DOUBLE + mx)) END::INTEGER AS v
FROM raster JOIN (SELECT img, max(v) AS mx FROM raster GROUP BY 1) USING (img)"""))
def raster_log(spark, d):
    return RA.log_transform(raster(Tables(spark, d)))


GAMMAS = (0.1, 0.5, 1.2, 2.2)
_GAMMA_SQL = W(f"""
SELECT img, ch, y, x, g AS gamma, floor({D(255)} * pow(v / {D(255)}, g))::INTEGER AS v
FROM raster CROSS JOIN (VALUES {', '.join(f'({D(g)})' for g in GAMMAS)}) AS gm(g)""")


@register("raster_gamma", sql=_GAMMA_SQL)
def raster_gamma(spark, d):
    return RA.gamma_variants(raster(Tables(spark, d)), GAMMAS)


@register("sink_partitioned_variants", sql=_GAMMA_SQL)
def sink_partitioned_variants(spark, d):
    """One output folder per gamma (partitionBy), read back."""
    g = RA.gamma_variants(raster(Tables(spark, d)), GAMMAS)
    path = FS.write_partitioned(g, scratch_path(spark, "gamma"), ["gamma"])
    back = spark.read.parquet(path)
    return back.select(*RA.KEYS, F.col("gamma").cast("double").alias("gamma"), "v")


@register("raster_piecewise", sql=W(f"""
SELECT img, ch, y, x, floor(CASE WHEN v <= 70 THEN {D(0 / 70)} * v
                                 WHEN v <= 140 THEN {D(255 / 70)} * (v - 70) + 0
                                 ELSE {D(0 / 115)} * (v - 140) + 255 END)::INTEGER AS v FROM raster"""))
def raster_piecewise(spark, d):
    return RA.piecewise(raster(Tables(spark, d)), 70, 0, 140, 255)


_CDF_SQL = """
h AS (SELECT img, v, count(*) AS n FROM gray GROUP BY 1, 2),
c AS (SELECT img, v, n, (sum(n) OVER (PARTITION BY img ORDER BY v))::BIGINT AS cum, (sum(n) OVER (PARTITION BY img))::BIGINT AS tot FROM h)"""


@register("running_cdf", sql=W(f", {_CDF_SQL} SELECT img, v, n, cum, cum / tot AS share FROM c"))
def running_cdf(spark, d):
    return RA.running_cdf(gray(Tables(spark, d)))


@register("raster_hist_equalize", sql=W(f""", {_CDF_SQL},
lut AS (SELECT img, v, CASE WHEN tot > cmin THEN floor((cum - cmin)::DOUBLE / (tot - cmin) * {D(255)} + 0.5) ELSE v END::INTEGER AS nv
        FROM (SELECT *, min(cum) OVER (PARTITION BY img) AS cmin FROM c))
SELECT g.img, g.ch, g.y, g.x, nv AS v FROM gray g JOIN lut USING (img, v)"""))
def raster_hist_equalize(spark, d):
    return RA.hist_equalize(gray(Tables(spark, d)))


@register("raster_threshold", sql=W("""
SELECT img, ch, y, x, CASE WHEN v > 120 THEN 255 ELSE 0 END AS binary, CASE WHEN v > 120 THEN 0 ELSE 255 END AS binary_inv,
       CASE WHEN v > 120 THEN 120 ELSE v END AS trunc, CASE WHEN v > 120 THEN v ELSE 0 END AS tozero,
       CASE WHEN v > 120 THEN 0 ELSE v END AS tozero_inv FROM gray"""))
def raster_threshold(spark, d):
    return RA.thresholds(gray(Tables(spark, d)), 120, 255)


_OTSU_SQL = """
h AS (SELECT img, v, count(*) AS n FROM gray GROUP BY 1, 2),
s AS (SELECT img, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY img) AS nn,
             sum(n * v) OVER (PARTITION BY img) AS ss FROM h WINDOW w AS (PARTITION BY img ORDER BY v)),
sc AS (SELECT img, v, ((nn * s0 - n0 * ss)::DOUBLE) * ((nn * s0 - n0 * ss)::DOUBLE) / ((n0 * (nn - n0))::DOUBLE) AS score
       FROM s WHERE n0 < nn),
best AS (SELECT img, arg_min(v, (-score, v)) AS t FROM sc GROUP BY img),
th AS (SELECT i.img, coalesce(best.t, 0)::INTEGER AS t FROM (SELECT DISTINCT img FROM gray) i LEFT JOIN best USING (img))"""


@register("raster_otsu", sql=W(f""", {_OTSU_SQL}
SELECT g.img, g.ch, g.y, g.x, t, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM gray g JOIN th USING (img)"""))
def raster_otsu(spark, d):
    return RA.otsu_binary(gray(Tables(spark, d)))


# ------------------------------------------------------------ neighbourhoods

@register("raster_adaptive_mean", sql=W(f""", m AS ({window_sql('gray', 2, 'replicate', 'sum(s.v)')})
SELECT g.img, g.ch, g.y, g.x, CASE WHEN g.v > m.v / {D(25)} - {D(5)} THEN 255 ELSE 0 END AS v
FROM gray g JOIN m USING (img, ch, y, x)"""))
def raster_adaptive_mean(spark, d):
    return RA.adaptive_threshold(gray(Tables(spark, d)), 5, 5.0, "mean")


@register("raster_adaptive_gauss", sql=W(f""", m AS ({conv_sql('gray', RA.gaussian_taps(5), 'replicate')})
SELECT g.img, g.ch, g.y, g.x, CASE WHEN g.v > m.v - {D(5)} THEN 255 ELSE 0 END AS v
FROM gray g JOIN m USING (img, ch, y, x)"""))
def raster_adaptive_gauss(spark, d):
    return RA.adaptive_threshold(gray(Tables(spark, d)), 5, 5.0, "gauss")


@register("raster_gaussian_blur", sql=W(f""", b AS ({conv_sql('raster', RA.gaussian_taps(5), 'reflect101')})
SELECT img, ch, y, x, {u8_sql('v')} AS v FROM b"""))
def raster_gaussian_blur(spark, d):
    return RA.gaussian_blur(raster(Tables(spark, d)), 5, 0.0, "reflect101")


@register("raster_median_blur", sql=W(f"""
SELECT img, ch, y, x, v FROM ({window_sql('raster', 1, 'replicate', 'list_sort(list(s.v))[5]')})"""))
def raster_median_blur(spark, d):
    return RA.median_blur(raster(Tables(spark, d)), 3, "replicate")


@register("raster_dilate", sql=W(window_sql("gray", 2, None, "max(s.v)")))
def raster_dilate(spark, d):
    return RA.morph(gray(Tables(spark, d)), "dilate", 1, 2)


@register("raster_erode", sql=W(window_sql("gray", 2, None, "min(s.v)")))
def raster_erode(spark, d):
    return RA.morph(gray(Tables(spark, d)), "erode", 1, 2)


@register("raster_open", sql=W(f", e AS ({window_sql('gray', 1, None, 'min(s.v)')}) {window_sql('e', 1, None, 'max(s.v)')}"))
def raster_open(spark, d):
    return RA.morph(RA.morph(gray(Tables(spark, d)), "erode", 1), "dilate", 1)


@register("raster_close", sql=W(f", e AS ({window_sql('gray', 1, None, 'max(s.v)')}) {window_sql('e', 1, None, 'min(s.v)')}"))
def raster_close(spark, d):
    return RA.morph(RA.morph(gray(Tables(spark, d)), "dilate", 1), "erode", 1)


@register("moving_extrema", sql=W(f"""
SELECT a.img, a.ch, a.y, a.x, a.v AS vmin, b.v AS vmax FROM ({window_sql('gray', 1, None, 'min(s.v)')}) a
JOIN ({window_sql('gray', 1, None, 'max(s.v)')}) b USING (img, ch, y, x)"""))
def moving_extrema(spark, d):
    return RA.moving_extrema(gray(Tables(spark, d)), 1)


@register("neighbour_offset_join", sql=W(f"""
SELECT img, ch, y, x, v::BIGINT AS v FROM ({window_sql('raster', 1, 'reflect101', 'sum(s.v)')})"""))
def neighbour_offset_join(spark, d):
    return RA.neighbour_sum(raster(Tables(spark, d)), 1, "reflect101")


# ------------------------------------------------------------------ geometry

@register("raster_resize_area", sql=W(f"""
SELECT img, ch, (y // 3)::INTEGER AS y, (x // 3)::INTEGER AS x, {u8_sql('sum(v)::DOUBLE / count(v)')} AS v
FROM raster JOIN dims USING (img) WHERE y // 3 < h // 3 AND x // 3 < w // 3 GROUP BY img, ch, y // 3, x // 3"""))
def raster_resize_area(spark, d):
    return RA.resize_area(raster(Tables(spark, d)), 3)


OUT = 12


def _bilinear_sql(targets: str, clamp: bool) -> str:
    qy = "least(greatest(y0 + dy, 0), h - 1)" if clamp else "y0 + dy"
    qx = "least(greatest(x0 + dx, 0), w - 1)" if clamp else "x0 + dx"
    return f"""
, t0 AS ({targets}),
t1 AS (SELECT *, floor(sx)::INTEGER AS x0, floor(sy)::INTEGER AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM t0),
t2 AS (SELECT t1.*, nb.dy, nb.dx, {qy} AS qy, {qx} AS qx FROM t1 CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS nb(dy, dx)),
t3 AS (SELECT t2.img, t2.ch, t2.y, t2.x, fx, fy, dy * 2 + dx AS code, coalesce(s.v, 0) AS sv
       FROM t2 LEFT JOIN raster s ON s.img = t2.img AND s.ch = t2.ch AND s.y = t2.qy AND s.x = t2.qx),
p AS (SELECT img, ch, y, x, fx, fy, max(sv) FILTER (WHERE code = 0) AS p0, max(sv) FILTER (WHERE code = 1) AS p1,
             max(sv) FILTER (WHERE code = 2) AS p2, max(sv) FILTER (WHERE code = 3) AS p3 FROM t3 GROUP BY ALL)
SELECT img, ch, y, x, {u8_sql('(1.0::DOUBLE - fy) * ((1.0::DOUBLE - fx) * p0 + fx * p1) + fy * ((1.0::DOUBLE - fx) * p2 + fx * p3)')} AS v FROM p"""


_GRID_SQL = "(SELECT DISTINCT img, ch FROM raster) c JOIN dims USING (img)"


@register("raster_resize_interp", sql=W(_bilinear_sql(f"""
SELECT img, ch, yy::INTEGER AS y, xx::INTEGER AS x, h, w,
       least(greatest((yy + 0.5::DOUBLE) * (h / {D(OUT)}) - 0.5::DOUBLE, 0.0::DOUBLE), h - 1.0::DOUBLE) AS sy,
       least(greatest((xx + 0.5::DOUBLE) * (w / {D(OUT)}) - 0.5::DOUBLE, 0.0::DOUBLE), w - 1.0::DOUBLE) AS sx
FROM {_GRID_SQL} CROSS JOIN range({OUT}) ry(yy) CROSS JOIN range({OUT}) rx(xx)""", clamp=True)))
def raster_resize_interp(spark, d):
    return RA.resize_linear(raster(Tables(spark, d)), OUT, OUT)


ROT = RA.rotation_matrix(SIDE / 2, SIDE / 2, 30.0, 1.0)


def _inverse(m):
    (a, b, c), (d_, e, f) = m
    det = a * e - b * d_
    ia, ib, id_, ie = e / det, -b / det, -d_ / det, a / det
    return ia, ib, -(ia * c + ib * f), id_, ie, -(id_ * c + ie * f)


_IA, _IB, _IC, _ID, _IE, _IF = _inverse(ROT)


@register("raster_affine", sql=W(_bilinear_sql(f"""
SELECT img, ch, yy::INTEGER AS y, xx::INTEGER AS x, h, w,
       {D(_IA)} * xx + {D(_IB)} * yy + {D(_IC)} AS sx, {D(_ID)} * xx + {D(_IE)} * yy + {D(_IF)} AS sy
FROM {_GRID_SQL}, LATERAL (SELECT unnest(range(h)) AS yy), LATERAL (SELECT unnest(range(w)) AS xx)""", clamp=False)))
def raster_affine(spark, d):
    """Rotation by 30° about the image centre, scale 1, bilinear, 0 outside."""
    return RA.affine(raster(Tables(spark, d)), ROT)


@register("raster_translate", sql=W(f"""
SELECT c.img, c.ch, yy::INTEGER AS y, xx::INTEGER AS x, coalesce(r.v, 0) AS v
FROM {_GRID_SQL}, LATERAL (SELECT unnest(range(h)) AS yy), LATERAL (SELECT unnest(range(w)) AS xx)
LEFT JOIN raster r ON r.img = c.img AND r.ch = c.ch AND r.y = yy - 1 AND r.x = xx - 2"""))
def raster_translate(spark, d):
    """Integer translation (dx=2, dy=1): a pure shift of coordinates."""
    return RA.translate(raster(Tables(spark, d)), 2, 1)


def _affine_sql(m) -> str:
    ia, ib, ic, id_, ie, if_ = _inverse(m)
    return W(_bilinear_sql(f"""
SELECT img, ch, yy::INTEGER AS y, xx::INTEGER AS x, h, w,
       {D(ia)} * xx + {D(ib)} * yy + {D(ic)} AS sx, {D(id_)} * xx + {D(ie)} * yy + {D(if_)} AS sy
FROM {_GRID_SQL}, LATERAL (SELECT unnest(range(h)) AS yy), LATERAL (SELECT unnest(range(w)) AS xx)""", clamp=False))


SHEAR = [[1.0, -0.15, 0.0], [0.0, 1.0, 0.0]]
QUARTER = [[1.0, 0.0, SIDE / 4], [0.0, 1.0, SIDE / 4]]


@register("raster_shear", sql=_affine_sql(SHEAR))
def raster_shear(spark, d):
    """Horizontal shear by -0.15, bilinear, 0 outside."""
    return RA.affine(raster(Tables(spark, d)), SHEAR)


@register("raster_quarter_shift", sql=_affine_sql(QUARTER))
def raster_quarter_shift(spark, d):
    """Shift by a quarter of the image in both directions."""
    return RA.affine(raster(Tables(spark, d)), QUARTER)


# The shifts towards the four edges (dx, dy), scaled to the fixture's 8 x 8 tiles.
EDGE_SHIFTS = {"left": (-2, 0), "right": (2, 0), "top": (0, 2), "bottom": (0, -2)}


@register("raster_edge_shifts", sql=W(" UNION ALL ".join(f"""
SELECT '{name}' AS edge, c.img, c.ch, yy::INTEGER AS y, xx::INTEGER AS x, coalesce(r.v, 0) AS v
FROM {_GRID_SQL}, LATERAL (SELECT unnest(range(h)) AS yy), LATERAL (SELECT unnest(range(w)) AS xx)
LEFT JOIN raster r ON r.img = c.img AND r.ch = c.ch AND r.y = yy - ({dy}) AND r.x = xx - ({dx})"""
    for name, (dx, dy) in EDGE_SHIFTS.items())))
def raster_edge_shifts(spark, d):
    """The image moved towards each of the four edges."""
    return RA.translations(raster(Tables(spark, d)), EDGE_SHIFTS).select("edge", *RA.KEYS, "v")


ZOOM = 3
_TAPS_SQL = "(VALUES " + ", ".join(
    f"({p}, {off}, {', '.join(D(w) for w in ws)})" for p, (off, ws) in enumerate(RA.cubic_taps(ZOOM))
) + ") AS tp(p, off, w0, w1, w2, w3)"


def _cubic_pass(src: str, out: str, axis: str, size: str) -> str:
    other = "y" if axis == "x" else "x"
    at = ", ".join(f"least(greatest(i // {ZOOM} + off + {k - 1}, 0), n - 1)::INTEGER AS a{k}" for k in range(4))
    joins = " ".join(f"JOIN {src} s{k} ON s{k}.img = t.img AND s{k}.ch = t.ch AND s{k}.{other} = t.{other} AND s{k}.{axis} = t.a{k}"
                     for k in range(4))
    return f"""{out}_i AS (SELECT img, ch, {other}, n, unnest(range(n * {ZOOM})) AS i FROM (
  SELECT DISTINCT img, ch, {other}, {size} AS n FROM {src} JOIN dims USING (img))),
{out}_t AS (SELECT img, ch, {other}, i::INTEGER AS {axis}, w0, w1, w2, w3, {at} FROM {out}_i JOIN {_TAPS_SQL} ON tp.p = i % {ZOOM}),
{out} AS (SELECT t.img, t.ch, t.{other}, t.{axis}, w0 * s0.v + w1 * s1.v + w2 * s2.v + w3 * s3.v AS v FROM {out}_t t {joins})"""


@register("raster_resize_cubic", sql=W(f""", src AS (SELECT img, ch, y, x, v::DOUBLE AS v FROM raster),
{_cubic_pass('src', 'px', 'x', 'w')}, {_cubic_pass('px', 'py', 'y', 'h')}
SELECT img, ch, y, x, {u8_sql('v')} AS v FROM py"""))
def raster_resize_cubic(spark, d):
    """Enlargement by three with cubic interpolation."""
    return RA.resize_cubic(raster(Tables(spark, d)), ZOOM)


PAD = 2
BORDERS = ("constant", "constant_red", "reflect", "reflect101", "replicate")


def _pad_sql(mode: str) -> str:
    n = f"{SIDE + 2 * PAD}"
    grid = f"(SELECT DISTINCT img, ch FROM raster) c JOIN dims USING (img) CROSS JOIN range({n}) ry(yy) CROSS JOIN range({n}) rx(xx)"
    if mode.startswith("constant"):
        const = "CASE WHEN c.ch = 2 THEN 255 ELSE 0 END" if mode == "constant_red" else "0"
        return (f"SELECT '{mode}' AS mode, c.img, c.ch, yy::INTEGER AS y, xx::INTEGER AS x, coalesce(r.v, {const}) AS v FROM {grid} "
                f"LEFT JOIN raster r ON r.img = c.img AND r.ch = c.ch AND r.y = yy - {PAD} AND r.x = xx - {PAD}")
    return (f"SELECT '{mode}' AS mode, c.img, c.ch, yy::INTEGER AS y, xx::INTEGER AS x, r.v FROM {grid} "
            f"JOIN raster r ON r.img = c.img AND r.ch = c.ch AND r.y = {map_sql(f'yy - {PAD}', 'h', mode)} "
            f"AND r.x = {map_sql(f'xx - {PAD}', 'w', mode)}")


@register("raster_border", sql=W(" UNION ALL ".join(_pad_sql(m) for m in BORDERS)))
def raster_border(spark, d):
    """2-pixel frames: constant black, constant red (B, G, R = 0, 0, 255),
    reflect, reflect101, replicate."""
    r = raster(Tables(spark, d))
    out = None
    for mode in BORDERS:
        if mode == "constant_red":
            p = RA.pad(r, PAD, "constant", {2: 255})
        else:
            p = RA.pad(r, PAD, mode)
        p = p.withColumn("mode", F.lit(mode))
        out = p if out is None else out.unionByName(p)
    return out.select("mode", *RA.KEYS, "v")


_PYR = [t / 16.0 for t in RA.PYRAMID_TAPS]


def _pyr_down_sql(src: str) -> str:
    return (f"SELECT img, ch, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, {u8_sql('v')} AS v FROM "
            f"({conv_sql(src, _PYR, 'reflect101', dims='d_' + src)}) WHERE y % 2 = 0 AND x % 2 = 0")


def _pyr_level_sql(src: str, out: str) -> str:
    return (f"d_{src} AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM {src} GROUP BY img),\n"
            f"{out} AS ({_pyr_down_sql(src)})")


@register("raster_pyramid_down", sql=W(f", {_pyr_level_sql('raster', 'l1')} SELECT * FROM l1"))
def raster_pyramid_down(spark, d):
    return RA.pyr_down(raster(Tables(spark, d)))


@register("raster_pyramid_levels", sql=W(f""", {_pyr_level_sql('raster', 'l1')}, {_pyr_level_sql('l1', 'l2')},
{_pyr_level_sql('l2', 'l3')}
SELECT *, 0 AS level FROM raster UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3"""))
def raster_pyramid_levels(spark, d):
    return RA.pyramid_levels(raster(Tables(spark, d)), 3)


def _up_taps_sql() -> str:
    # output j = 2i + parity: even taps (i-1, i, i+1) = (1, 6, 1)/8, odd taps (i, i+1) = (4, 4)/8
    rows = ["(0, -1, 0.125)", "(0, 0, 0.75)", "(0, 1, 0.125)", "(1, 0, 0.5)", "(1, 1, 0.5)"]
    return f"(VALUES {', '.join(rows)}) AS {{a}}(par, off, wt)"


@register("raster_pyramid_up", sql=W(f"""
, grid AS (SELECT c.img, c.ch, yy AS y, xx AS x, h, w FROM (SELECT DISTINCT img, ch FROM raster) c JOIN dims USING (img),
           LATERAL (SELECT unnest(range(2 * h)) AS yy), LATERAL (SELECT unnest(range(2 * w)) AS xx))
SELECT g.img, g.ch, g.y::INTEGER AS y, g.x::INTEGER AS x, {u8_sql('sum(ky.wt::DOUBLE * kx.wt::DOUBLE * s.v)')} AS v
FROM grid g CROSS JOIN {_up_taps_sql().format(a='ky')} CROSS JOIN {_up_taps_sql().format(a='kx')}
JOIN raster s ON s.img = g.img AND s.ch = g.ch
 AND s.y = {map_sql('g.y // 2 + ky.off', 'g.h', 'reflect101')} AND s.x = {map_sql('g.x // 2 + kx.off', 'g.w', 'reflect101')}
WHERE ky.par = g.y % 2 AND kx.par = g.x % 2
GROUP BY g.img, g.ch, g.y, g.x"""))
def raster_pyramid_up(spark, d):
    return RA.pyr_up(raster(Tables(spark, d)))


@register("raster_hstack", sql=W("""
SELECT img, ch, y, x, v FROM raster UNION ALL
SELECT r.img, 2 - r.ch, r.y, (r.x + w)::INTEGER, r.v FROM raster r JOIN dims USING (img)"""))
def raster_hstack(spark, d):
    r = raster(Tables(spark, d))
    return RA.hstack(r, RA.channel_reorder(r))


_SOBEL_X = [(-1, -1, -1.0), (0, -1, -2.0), (1, -1, -1.0), (-1, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0)]
_SOBEL_Y = [(-1, -1, -1.0), (-1, 0, -2.0), (-1, 1, -1.0), (1, -1, 1.0), (1, 0, 2.0), (1, 1, 1.0)]


def _sobel_sql(taps, name):
    vals = ", ".join(f"({dy}, {dx}, {D(w)})" for dy, dx, w in taps)
    return (f"SELECT t.img, t.ch, t.y, t.x, sum(k.kw * s.v) AS {name} FROM gray t JOIN dims dm USING (img) "
            f"CROSS JOIN (VALUES {vals}) AS k(dy, dx, kw) JOIN gray s ON s.img = t.img AND s.ch = t.ch "
            f"AND s.y = {map_sql('t.y + k.dy', 'dm.h', 'replicate')} AND s.x = {map_sql('t.x + k.dx', 'dm.w', 'replicate')} "
            "GROUP BY t.img, t.ch, t.y, t.x")


def _nb(dy, dx):
    return (f"coalesce((SELECT m2.m FROM mag m2 WHERE m2.img = mg.img AND m2.ch = mg.ch AND m2.y = mg.y + ({dy}) "
            f"AND m2.x = mg.x + ({dx})), 0.0)")


# The operator defaults to the source's (100, 700). The fixture images are
# low-contrast 8×8 tiles whose largest L1 gradient is about 420, so the job
# uses a high threshold of 250 (99th percentile ≈ 264) to give hysteresis
# real strong seeds and weak chains to follow.
EDGE_LOW, EDGE_HIGH = 100.0, 250.0


@register("raster_edges", sql=W(f""",
gx AS ({_sobel_sql(_SOBEL_X, 'gx')}), gy AS ({_sobel_sql(_SOBEL_Y, 'gy')}),
mag AS (SELECT img, ch, y, x, gx, gy, abs(gx) + abs(gy) AS m FROM gx JOIN gy USING (img, ch, y, x)),
nms AS (SELECT mg.*, CASE
    WHEN abs(gy) <= abs(gx) * {D(RA.TAN_22_5)} THEN m > {_nb(0, -1)} AND m >= {_nb(0, 1)}
    WHEN abs(gy) > abs(gx) * {D(RA.TAN_67_5)} THEN m > {_nb(-1, 0)} AND m >= {_nb(1, 0)}
    WHEN gx * gy > 0 THEN m > {_nb(-1, -1)} AND m > {_nb(1, 1)}
    ELSE m > {_nb(-1, 1)} AND m > {_nb(1, -1)} END AS keep FROM mag mg),
cand AS (SELECT img, ch, y, x, m > {D(EDGE_HIGH)} AS strong FROM nms WHERE keep AND m > {D(EDGE_LOW)}),
reach(img, ch, y, x) AS (
  SELECT img, ch, y, x FROM cand WHERE strong
  UNION
  SELECT c.img, c.ch, c.y, c.x FROM reach r JOIN cand c ON c.img = r.img AND c.ch = r.ch
    AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1)
SELECT g.img, g.ch, g.y, g.x, CASE WHEN r.img IS NULL THEN 0 ELSE 255 END AS v
FROM gray g LEFT JOIN (SELECT DISTINCT * FROM reach) r USING (img, ch, y, x)""").replace("WITH ", "WITH RECURSIVE ", 1))
def raster_edges(spark, d):
    """Gradient edges (Sobel, L1 magnitude, non-maximum suppression,
    hysteresis 100/250, see above) on the gray rasters."""
    return RA.canny(gray(Tables(spark, d)), EDGE_LOW, EDGE_HIGH)
