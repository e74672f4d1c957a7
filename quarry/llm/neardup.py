"""Operator 7, near-duplicates by a chosen-path set similarity join.

Documents are sets of hashed 4-word shingles (quarry.llm.shingles); those with
at least 80 % of their union in common are linked, and components of the
links are the result. Equal sets are first made one class.

``TREES`` independent trees: the root's children are the classes with the same
minwise token of that tree. A node of more than ``NODE`` classes is branched
again, along ``BRANCHES`` signature positions that a hash of its path selects;
nodes still large at ``DEPTH`` are compared block against block. Small nodes
are compared exhaustively on signatures, at a threshold (``LOOSE`` of
``SIGNATURE`` positions) that a linked pair misses with a chance below 1e-7.
A linked pair shares a given tree's first node with a chance of 0.8 or more,
so all trees miss it with at most 0.2 ** 8 = 3e-6 (1e-5 when branched).

What the nodes find joins classes into candidate clusters; each class's full
set then goes once to its cluster, where links are decided on the full sets.
Neither step emits pairs: a node or cluster gives one edge per member, to the
smallest id of its connected part. In a cluster too large for one task, a
growing part starts at the smallest id: every round a few of its members, the
pivots, are compared with all that is not yet reached, and what is linked with
one of them joins the part. A round sends each unreached set once and each
pivot once a block, so a group of near copies, however large, costs a few
times what it holds. What no round reached is compared with the part and with
itself, block against block, so that no link is lost.

Defined results: texts without words have an empty set, are linked with
nothing and are their own component. A null id is left out (it names no
document). Texts of any length are taken whole, as the set of all their
shingles. Repeated rows of one id share their component. An empty table
gives an empty result. Other columns are ignored, or kept by
``filter_documents`` whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, stored
from quarry.llm.shingles import mix, shingle_sets

TREES = 8
SIGNATURE = 128
LOOSE = 77  # of 128: 0.6
NODE = 2048
BRANCHES = 2
DEPTH = 4
BLOCK_SHINGLES = 1_000_000
BLOCK_MEMBERS = 128
RECTANGLE = 512
SMALL_IDS = 1_000_000
PERCENT = 80
PIVOTS = 8
ROUNDS = 8

_U = np.uint64
_seeds = np.random.default_rng(20_240_607)
_TREE_A = _seeds.integers(0, 1 << 63, TREES, dtype=_U) * _U(2) + _U(1)
_TREE_B = _seeds.integers(0, 1 << 63, TREES, dtype=_U)
_SIG_A = (_seeds.integers(0, 1 << 31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SIG_B = _seeds.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)[:, None]


def tokens_and_signature(s: np.ndarray) -> tuple[list[int], bytes]:
    """The minwise token of each tree, and SIGNATURE 16-bit minwise values."""
    tokens = np.full(TREES, np.iinfo(_U).max, _U)
    low = np.full(SIGNATURE, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 4096):
        part = s[at: at + 4096]
        tokens = np.minimum(tokens, (np.multiply.outer(_TREE_A, part) + _TREE_B[:, None]).min(axis=1))
        small = (part >> _U(32)).astype(np.uint32)[None, :]
        low = np.minimum(low, (_SIG_A * small + _SIG_B).min(axis=1))
    return tokens.view(np.int64).tolist(), ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def set_key(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart, whatever the order of their members."""
    both = [mix(s).sum(dtype=_U), mix(s ^ _U(0xC2B2AE3D27D4EB4F)).sum(dtype=_U)]
    return np.array([*both], dtype="<u8").tobytes()


def profiles(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key, tokens and signature of every document (key null for empty sets)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                sets = shingle_sets(p.column(1).to_pylist())
                pairs = [tokens_and_signature(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [p.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([x[0] for x in pairs], pa.list_(pa.int64())),
                     pa.array([x[1] for x in pairs], pa.binary())],
                    names=["doc_id", "n_shingles", "key", "tokens", "signature"])

    return df.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, key binary, tokens array<bigint>, signature binary")


def parts_of(like, n: int) -> list[np.ndarray]:
    """Connected parts (two members or more) of 0..n-1; ``like(x, others)`` says
    which of the others x is linked with. A member that was reached is never
    compared again, so parts of alike members cost little."""
    left, out = np.arange(n), []
    while len(left) > 1:
        queue, part, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            hit = like(queue.pop(), left)
            found, left = left[hit], left[~hit]
            queue.extend(found)
            part.extend(found)
        if len(part) > 1:
            out.append(np.array(part))
    return out


def grouped_edges(df: DataFrame, columns: list[str], make_like) -> DataFrame:
    """Edges (a, b) from each group of ``df`` (columns: grp, cid and what
    ``make_like`` takes): one to every member of a connected part from its
    smallest id. Groups stream in sorted order through a task."""
    import pyarrow as pa

    ordered = df.select("grp", "cid", *columns).repartition("grp").sortWithinPartitions("grp", "cid")

    def run(batches):
        grp, held = None, []

        def close():
            if len(held) < 2:
                return None
            cid = np.array([h[0] for h in held])
            like = make_like([h[1:] for h in held])
            a, b = [], []
            for part in parts_of(like, len(held)):
                ids = np.sort(cid[part])
                ids = ids[np.concatenate([[True], ids[1:] != ids[:-1]])]
                a += [ids[0]] * (len(ids) - 1)
                b += ids[1:].tolist()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            done = []
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != grp:
                    done.append(close())
                    grp, held = g, []
                held.append(row)
            yield from (e for e in done if e is not None and e.num_rows)
        last = close()
        if last is not None:
            yield last

    return ordered.mapInArrow(run, "a long, b long")


def signature_like(rows: list):
    sig = np.frombuffer(b"".join(r[0] for r in rows), "<u2").reshape(-1, SIGNATURE)

    def like(x, others):
        return np.count_nonzero(sig[others] == sig[x], axis=1) >= LOOSE
    return like


def exact_like(rows: list):
    """Links on full sets, by counting over the lists of members of each shingle."""
    sets = [np.frombuffer(r[0], "<u8") for r in rows]
    size = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    lists = member[order]
    ends = np.cumsum(np.bincount(code))
    begins = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[0], np.cumsum(size)])

    def like(x, others):
        mine = code[first[x]: first[x + 1]]
        lens = ends[mine] - begins[mine]
        take = np.repeat(begins[mine] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        both = np.bincount(lists[take], minlength=len(sets))[others]
        return 100 * both >= PERCENT * (size[x] + size[others] - both)
    return like


def blocks(df: DataFrame, n_blocks: Column) -> DataFrame:
    """``df`` (grp, cid, ...) with groups of several blocks cut up: a row goes to
    every pair of blocks that holds its own. Any two rows meet in one of them."""
    k = F.greatest(F.lit(1), n_blocks).cast("int")
    mine = F.pmod(F.xxhash64("cid"), k)
    d = df.withColumn("__k", k).withColumn("__m", mine.cast("int"))
    d = d.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    pair = F.xxhash64("grp", F.least("__m", "__o"), F.greatest("__m", "__o"))
    return d.withColumn("grp", F.when(F.col("__k") == 1, F.col("grp")).otherwise(pair)).drop("__k", "__m", "__o")


def pivot_links(pivots: DataFrame, rest: DataFrame) -> DataFrame:
    """(grp, a, b): each row of ``rest`` (b) that is linked with a pivot (a) of
    its group, once. Both have grp, cid, k and full; a group's rows are dealt
    over k keys, to each of which its pivots go."""
    import pyarrow as pa

    mine = F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")
    first = pivots.select("grp", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("salt"),
                          F.lit(0).alias("kind"), "cid", "full")
    both = first.unionByName(rest.select("grp", mine.alias("salt"), F.lit(1).alias("kind"), "cid", "full"))
    ordered = both.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "kind", "cid")

    def run(batches):
        at, known = None, []
        for batch in batches:
            out = []
            for grp, salt, kind, cid, full in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, salt) != at:
                    at, known = (grp, salt), []
                s = np.frombuffer(full, "<u8")
                if kind == 0:
                    known.append((cid, s))
                    continue
                for a, p in known:
                    small, large = (s, p) if len(s) < len(p) else (p, s)
                    if 100 * len(small) < PERCENT * len(large):
                        continue  # too different in size
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    n = int(np.count_nonzero(large[place] == small))
                    if 100 * n >= PERCENT * (len(s) + len(p) - n):
                        out.append((grp, a, cid))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["grp", "a", "b"])

    return ordered.mapInArrow(run, "grp long, a long, b long")


def large_cluster_links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is linked in the clusters of ``sets``
    (grp, cid, k, full; stored), by rounds of pivots and blocks for the rest."""
    reached = stored(sets.groupBy("grp").agg(F.min("cid").alias("cid")), "reached")
    rest = sets.join(reached.select("cid"), "cid", "left_anti")
    edges = []
    for r in range(ROUNDS):
        order = F.xxhash64("cid", F.lit(r))
        chosen = (reached.groupBy("grp", F.pmod(order, F.lit(PIVOTS)).alias("slot"))
                  .agg(F.min_by("cid", order).alias("cid")).select("cid"))
        pivots = stored(sets.join(chosen, "cid", "left_semi"), "pivots")
        found = stored(pivot_links(pivots, rest), "pivot-links")
        edges.append(found.select("a", "b"))
        if found.isEmpty():
            break
        reached = stored(reached.unionByName(found.select("grp", F.col("b").alias("cid"))), "reached")
        rest = stored(rest.join(found.select(F.col("b").alias("cid")), "cid", "left_anti"), "unreached")
        if rest.isEmpty():
            return _all(edges)
    # Rectangles of blocks: the unreached against the reached, and against each other.
    def sized(rows: DataFrame, name: str) -> DataFrame:
        size = F.sum(F.octet_length("full") / 8)
        return rows.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / RECTANGLE), F.ceil(size / BLOCK_SHINGLES))
                                       .cast("int").alias(name))

    inside = sets.join(reached.select("cid"), "cid", "left_semi")
    shape = sized(rest, "over").join(sized(inside, "down"), "grp")
    inside, across = inside.join(shape, "grp"), rest.join(shape, "grp")
    left = inside.select(F.pmod(F.xxhash64("cid"), F.col("down")).cast("int").alias("i"), "grp", "cid", "full",
                         F.explode(F.sequence(F.lit(0), F.col("over") - 1)).alias("j"))
    right = across.select(F.pmod(F.xxhash64("cid"), F.col("over")).cast("int").alias("j"), "grp", "cid", "full",
                          F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"))
    pairs = left.unionByName(right).select(F.xxhash64("grp", "i", "j").alias("grp"), "cid", "full")
    own = blocks(across.select("grp", "cid", "over", "full"), F.col("over")).select(
        F.xxhash64("grp", F.lit("own")).alias("grp"), "cid", "full")
    edges.append(grouped_edges(pairs.unionByName(own), ["full"], exact_like))
    return _all(edges)


def nodes(classes: DataFrame) -> DataFrame:
    """(grp, cid) of every node to be compared, from the trees."""
    def sized(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return stored(rows.join(counts, "grp"), "nodes")

    level = sized(classes.select("cid", F.posexplode("tokens").alias("tree", "token")).select(
        F.xxhash64("tree", "token").alias("grp"), "cid"))
    found = [level.filter(F.col("n") <= NODE).select("grp", "cid")]
    for depth in range(2, DEPTH + 1):
        large = level.filter(F.col("n") > NODE)
        if large.isEmpty():
            return _all(found)
        # A position is selected by the path and the branch; the child is its value there.
        at = F.pmod(F.xxhash64("grp", "branch"), F.lit(SIGNATURE)).cast("int")
        children = large.join(classes.select("cid", "signature"), "cid").select(
            "cid", "grp", "signature", F.explode(F.array(*map(F.lit, range(BRANCHES)))).alias("branch")).select(
            F.xxhash64("grp", "branch", F.substring("signature", at * 2 + 1, F.lit(2)), F.lit(depth)).alias("grp"), "cid")
        level = sized(children)
        found.append(level.filter(F.col("n") <= NODE).select("grp", "cid"))
    found.append(blocks(level.filter(F.col("n") > NODE), F.ceil(F.col("n") / NODE)).select("grp", "cid"))
    return _all(found)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(cid, root) of every id in an edge; root is the smallest id reachable.

    Alternating stars: each id's larger neighbours, then its smaller ones, are
    hung below the smallest neighbour, until nothing moves. Every round is
    written to shared storage; ids with many neighbours are only ever joined
    with one row and pre-aggregated, never gathered."""
    e = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
               "edges")
    seen = None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return e.select(F.col("b").alias("cid"), F.col("a").alias("root")).union(
                e.select(F.col("a").alias("cid"), F.col("a").alias("root")).distinct())
        seen = mark
        # large star: u's neighbours above u move to u's smallest neighbour
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: u and its neighbours below u move to the smallest of them
        up = large.filter("a <> b")
        low = up.groupBy("b").agg(F.min("a").alias("m"))
        small = up.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        e = stored(small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "stars")


def full_sets(texts: DataFrame) -> DataFrame:
    """(cid, full) of a table (cid, text): the sorted shingle hashes as bytes."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                full = [s.astype("<u8").tobytes() for s in shingle_sets(p.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(full, pa.binary())], names=["cid", "full"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, full binary")


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``df`` (doc_id, text)."""
    docs = df.select("doc_id", "text").filter("doc_id IS NOT NULL")
    prof = stored(profiles(docs), "profiles")
    classes = stored(prof.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("cid"), F.first("tokens").alias("tokens"), F.first("signature").alias("signature"),
        F.first("n_shingles").alias("size")), "classes")
    found = nodes(classes).join(classes.select("cid", "signature"), "cid")
    clusters = stored(components(grouped_edges(found, ["signature"], signature_like)), "clusters")
    n = clusters.count()
    # The texts of clustered classes only; the id list is broadcast while it is small.
    ids = clusters.select(F.col("cid").alias("doc_id"))
    texts = docs.join(F.broadcast(ids) if n <= SMALL_IDS else ids, "doc_id", "left_semi").withColumnRenamed("doc_id", "cid")
    member = clusters.join(classes.select("cid", "size"), "cid")
    # Blocks of a cluster are small in members and in shingles, so that a large
    # group of copies is many tasks.
    per = F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)).alias("k")
    member = stored(member.join(member.groupBy("root").agg(per), "root").select(F.col("root").alias("grp"), "cid", "k"),
                    "members")
    sets = member.join(full_sets(texts), "cid")
    links = grouped_edges(sets.filter(F.col("k") <= 1), ["full"], exact_like)
    large = member.filter(F.col("k") > 1)
    if not large.isEmpty():
        links = links.unionByName(large_cluster_links(
            stored(large.join(full_sets(texts), "cid").select("grp", "cid", "k", "full"), "large-clusters")))
    roots = stored(components(links), "components")
    classed = classes.select("key", "cid").join(roots, "cid", "left").select(
        "key", F.coalesce("root", "cid").alias("root"))
    return prof.select("doc_id", "n_shingles", "key").join(classed, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id"))


def filter_documents(df: DataFrame) -> DataFrame:
    """The rows of ``df`` but those of documents that aren't the first of their
    component. Rows without an id stay."""
    gone = stored(near_duplicates(df).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "duplicates")
    small = gone.count() <= SMALL_IDS
    return df.join(F.broadcast(gone) if small else gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op7_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2),
      lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) LEFT JOIN n USING (doc_id)"""
