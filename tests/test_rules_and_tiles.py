"""Rule joins of any size and edge linking by tiles, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import joins as J
from quarry.operators import raster as RA

RULES = "p int, l string, k string"


def classify(texts, rules, default):
    order = sorted((p, lab, k) for p, lab, k in rules if lab is not None and k is not None)
    return [next((lab for _, lab, k in order if t is not None and k in t), default) for t in texts]


@pytest.mark.parametrize("window", [1024, 7])
def test_rules_equal_the_first_match(spark, monkeypatch, window):
    monkeypatch.setattr(J, "WINDOW", window)
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcé漢 ") for _ in range(n))
    rules = [(r.randrange(40), f"l{r.randrange(9)}", word(r.randint(1, 5))) for _ in range(60)] + [(1, None, "a"), (0, "x", None)]
    texts = [None, "", "a", "漢" * 40] + [word(r.randint(1, 60)) for _ in range(120)]
    for some in (rules, rules + [(20, "always", "")], []):
        df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, t string, intent string")
        got = J.keyword_classify(df, F.col("t"), spark.createDataFrame(some, RULES), "none").collect()
        assert [x.intent for x in sorted(got, key=lambda x: x.i)] == classify(texts, some, "none")


def test_a_hundred_thousand_rules_stay_in_spark(spark):
    rules = spark.range(100_000).select(F.col("id").cast("int").alias("p"), F.concat(F.lit("l"), F.col("id")).alias("l"),
                                        F.substring(F.md5(F.col("id").cast("string")), 1, 9).alias("k"))
    some = {x.p: x.k for x in rules.filter("p IN (7, 90000, 55)").collect()}
    df = spark.createDataFrame([(1, f"zz{some[90000]}zz{some[55]}"), (2, some[7]), (3, "nothing")], "i int, t string")
    got = {x.i: x.intent for x in J.keyword_classify(df, F.col("t"), rules, "none").collect()}
    assert got == {1: "l55", 2: "l7", 3: "none"}


def test_substrings_of_a_small_table_are_never_broadcast(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "texts")
    spark.range(200).select("id", F.concat(F.lit("say hello "), F.col("id")).alias("t")).write.parquet(path)
    rules = spark.createDataFrame([(1, "greeting", "hello"), (2, "number", "1")], RULES)
    seen = []
    for chars, way in ((J.BROADCAST_CHARS, "BroadcastHashJoin [_kw"), (0, "SortMergeJoin [_kw")):
        monkeypatch.setattr(J, "BROADCAST_CHARS", chars)
        got = J.keyword_classify(spark.read.parquet(path), F.col("t"), rules, "none")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert way in plan and "BuildLeft" not in plan
        seen.append(sorted(map(tuple, got.collect())))
    assert seen[0] == seen[1] and {r[2] for r in seen[0]} == {"greeting"}


def spiral(n):
    """A one-pixel line that winds inwards, two pixels apart."""
    y, x, dy, dx, seen = 0, 0, 0, 1, {(0, 0)}
    side = 90
    path = [(0, 0)]
    while len(path) < n:
        for turn in range(2):
            ny, nx = y + dy, x + dx
            ahead = (ny + dy, nx + dx)
            if 0 <= ny < side and 0 <= nx < side and ahead not in seen:
                break
            dy, dx = dx, -dy
        else:
            break
        y, x = ny, nx
        seen.add((y, x))
        path.append((y, x))
    return path


@pytest.mark.parametrize("tile", [64, 8])
def test_a_spiral_takes_few_rounds(spark, tile):
    path = spiral(2000)
    assert len(path) == 2000
    rows = [(1, 0, y, x, k == 0) for k, (y, x) in enumerate(path)] + [(1, 0, 300, 300, False), (2, 0, 0, 0, False)]
    c = spark.createDataFrame(rows, "img bigint, ch int, y int, x int, strong boolean")
    parts, rounds = RA.linked_parts(c, tile)
    got = {}
    for r in parts.collect():
        got.setdefault(tuple(r.part), set()).add((r.img, r.y, r.x))
    assert rounds < 20
    assert sorted(map(len, got.values())) == [1, 1, 2000]


@pytest.mark.parametrize("tile", [64, 3, 1])
def test_parts_equal_a_flood_fill(spark, tile):
    r = random.Random(5)
    on = {(i, y, x) for i in range(3) for y in range(20) for x in range(20) if r.random() < 0.33}
    rows = [(i, 0, y, x, r.random() < 0.1) for i, y, x in sorted(on)]
    parts, _ = RA.linked_parts(spark.createDataFrame(rows, "img bigint, ch int, y int, x int, strong boolean"), tile)
    got = {}
    for q in parts.collect():
        got.setdefault(tuple(q.part), set()).add((q.img, q.y, q.x))
    left, want = set(on), []
    while left:
        queue = [left.pop()]
        part = set(queue)
        while queue:
            i, y, x = queue.pop()
            near = {(i, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            part |= near
            queue += near
        want.append(part)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_components_of_chains(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (900, 901), (5, 5)], "a long, b long")
    got, rounds = G.components(edges)
    assert {r.node: r.component for r in got.collect()} == {i: 0 for i in range(300)} | {900: 900, 901: 900}
    assert rounds < 20


def test_reachability_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0,)], "node bigint")
    got = {r.node: r.hop for r in G.reachability(edges, seeds).collect()}
    assert got == {k: k for k in range(41)}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_reachability_deals_edges_to_more_tasks_as_they_grow(spark, monkeypatch):
    """What a task holds is bounded: the edges' buckets grow with the edges, beyond the shuffle partitions."""
    import glob

    from quarry.operators import graph as G
    paths, scratch = [], G.scratch_path
    monkeypatch.setattr(G, "scratch_path", lambda *a: paths.append(scratch(*a)) or paths[-1])
    monkeypatch.setattr(G, "EDGES", 20, raising=False)
    edges = spark.range(400).selectExpr("id % 60 AS src", "(id * 7 + 1) % 60 AS dst")
    got = {r.node: r.hop for r in G.reachability(edges, spark.range(1).selectExpr("id AS node")).collect()}
    assert got[0] == 0 and len(got) > 1
    assert len(glob.glob(paths[0].removeprefix("file:") + "/*.parquet")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
