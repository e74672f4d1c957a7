"""Operator 11, a Merkle manifest of a table: subroots per group, one root, a proof per row.

The tree is binary: two consecutive nodes become the sha256 of their hex
digests joined, the last node of an odd level is hashed alone. Nodes stand in
aligned blocks of ``2**BITS``; a block keeps each of its levels as one string
of 64-character digests. The next level is the digests of its 128-character
substrings, and the sibling of a node is the 64 characters that flank it, so
no level is ever a row per node and pair. The roots of a group's blocks are
the leaves of the next round, until a group has one node; the groups' roots,
in the order of the groups, go the same way to the root of the table. Going
back down, each block hands its members their siblings inside it, followed by
the siblings of the block itself.

A row's place in its group comes from a range partition by group, order, leaf
and row number: a group that holds most rows, or an id that many rows share,
is spread over all ranges. Rows are hashed where they are read; what is
exchanged is ids and digests, never texts. Every round is written below the
checkpoint folder and read back.

Defined results: null fields count as ``-``; a null group is a group of its
own, before all others and unlike the empty string; null ids come first in
their group and are never tampered with. Rows of one group and id are ordered
by their leaves; rows equal in all fields are leaves of their own, side by
side, each with its own proof. Texts are hashed whole, empty ones as ``0:``.
An empty table gives no rows. Columns that aren't fields are ignored,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import read, stored

BITS = 6  # levels in a full block of 64 nodes: a level is a string of 4096 characters at most
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7


def leaf(fields: list[Column]) -> Column:
    """Hex sha256 of the fields, each with its length in bytes before it."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A group as a string that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``key``) with ``idx``, the place within the key in the
    given order, and ``n``, the number of rows of the key.

    Rows equal in the order are spread by their row number. The counts are
    taken per range and key, so their table has a row per range plus one per
    key, and joining it back deals rows by range and key, not by key."""
    by = ["key", *order, "__row"]
    laid = stored(
        rows.withColumn("__row", F.monotonically_increasing_id())
        .repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftrightunsigned("__row", 33).cast("int"))
        .withColumn("__at", F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).drop("__row"), "merkle-ranges")
    runs = laid.groupBy("__part", "key").agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))
    whole = Window.partitionBy("key")
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__part", "key", F.sum("__size").over(whole).alias("n"),
                       (F.coalesce(F.sum("__size").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return (laid.join(runs, ["__part", "key"]).withColumn("idx", F.col("__at") + F.col("__shift"))
            .drop("__part", "__at", "__shift"))


def _parents(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (2 * DIGEST)).cast("int"))
    return F.array_join(F.transform(
        pairs, lambda i: F.sha2(F.substring(level, i * (2 * DIGEST) + 1, F.lit(2 * DIGEST)), 256)), "")


def _levels(first: Column, n: Column) -> Column:
    """All levels of a block whose group has ``n`` nodes: a full block's height
    where the group goes on above it, else up to its one root."""
    height = F.when(n > (1 << BITS), F.lit(BITS)).when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))
    steps = F.slice(F.array(*[F.lit(k) for k in range(BITS)]), F.lit(1), height)
    return F.aggregate(steps, F.array(first), lambda a, _: F.concat(a, F.array(_parents(F.element_at(a, -1)))))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of blocks, from the leaves up. ``nodes`` has ``key``, ``idx``,
    ``n``, ``node`` and columns that only the leaves carry; a round's rows are
    (key, n, block, members, levels), and the last has one block per key."""
    rounds = []
    while True:
        rest = [c for c in nodes.columns if c not in ("key", "n", "idx", "node")]
        grouped = (nodes.groupBy("key", "n", F.shiftright("idx", BITS).alias("block"))
                   .agg(F.sort_array(F.collect_list(F.struct("idx", "node", *rest))).alias("members")))
        first = F.array_join(F.transform("members", lambda m: m["node"]), "")
        blocks = stored(grouped.withColumn("levels", _levels(first, F.col("n"))), "merkle-blocks")
        rounds.append(blocks)
        most = blocks.agg(F.max("n")).first()[0]
        if most is None or most <= 1 << BITS:
            return rounds
        nodes = blocks.select("key", F.col("block").alias("idx"),
                              F.shiftright(F.col("n") + ((1 << BITS) - 1), BITS).alias("n"),
                              F.element_at("levels", -1).alias("node"))


def _member(m: Column) -> Column:
    """A block's member with its siblings inside the block, and their sides."""
    inner = F.slice("levels", F.lit(1), F.size("levels") - 1)
    at = m["idx"].bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def beside(level: Column, j: Column) -> Column:
        other = F.call_function("shiftright", at, j).bitwiseXOR(F.lit(1))
        return F.substring(level, other * DIGEST + 1, F.lit(DIGEST))

    def side(level: Column, j: Column) -> Column:
        odd = F.call_function("shiftright", at, j).bitwiseAND(F.lit(1)) == 1
        return F.when(odd, "l").when(beside(level, j) == "", "-").otherwise("r")

    return F.struct(m.alias("m"), F.array_join(F.transform(inner, beside), "").alias("s"),
                    F.array_join(F.transform(inner, side), "").alias("d"))


def descend(rounds: list[DataFrame], crown: DataFrame) -> DataFrame:
    """The leaves with ``siblings`` (digests joined, from the leaf up) and
    ``sides`` (a letter per level: the sibling is left, right, or there is
    none, ``-``). ``crown`` has ``key``, the same two columns for the key's
    root, and columns that every leaf of the key is given."""
    above = crown.withColumn("block", F.lit(0).cast("long"))
    extra = [c for c in crown.columns if c not in ("key", "siblings", "sides")]
    for blocks in reversed(rounds):
        joined = blocks.join(above, ["key", "block"])
        out = joined.select("key", "siblings", "sides", *extra,
                            F.explode(F.transform("members", _member)).alias("x"))
        own = [c for c in blocks.schema["members"].dataType.elementType.names if c != "idx"]
        carried = [F.col(f"x.m.{c}").alias(c) for c in own] if blocks is rounds[0] else []
        above = out.select("key", F.col("x.m.idx").alias("block"),
                           F.concat("x.s", "siblings").alias("siblings"), F.concat("x.d", "sides").alias("sides"),
                           *extra, *carried)
    return above.withColumnRenamed("block", "idx")


def fold(node: Column, siblings: Column, sides: Column) -> Column:
    """The root that a leaf's digest leads to, by its own path."""
    steps = F.filter(F.split(sides, ""), lambda s: s != "")

    def step(a: Column, side: Column) -> Column:
        s = F.substring(siblings, a["at"], F.when(side == "-", 0).otherwise(DIGEST))
        both = F.when(side == "l", F.concat(s, a["node"])).otherwise(F.concat(a["node"], s))
        return F.struct(F.sha2(both, 256).alias("node"), (a["at"] + F.length(s)).alias("at"))

    start = F.struct(node.alias("node"), F.lit(1).alias("at"))
    return F.aggregate(steps, start, step, lambda a: a["node"])


def manifest(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (``key`` from ``group_key``, ``node``, more columns) with
    ``subroot``, ``root``, ``siblings`` and ``sides``; leaves ascend in ``order``."""
    rounds = climb(placed(rows, [*order, "node"]))
    subroots = rounds[-1].select("key", F.element_at("levels", -1).alias("subroot"))
    tops = subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("subroot").alias("node"))
    upper = climb(placed(tops, ["group"]))
    root = upper[-1].select("key", F.element_at("levels", -1).alias("root"))  # one row at most
    crown = descend(upper, root.withColumn("siblings", F.lit("")).withColumn("sides", F.lit("")))
    crown = crown.select(F.col("group").alias("key"), F.col("node").alias("subroot"), "root", "siblings", "sides")
    return descend(rounds, crown).drop("key", "idx")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof digest and the check of a tampered copy for every document."""
    d = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    changed = [F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    rows = d.select("doc_id", group_key(F.col("lang")).alias("key"), leaf([F.col(f) for f in FIELDS]).alias("node"),
                    F.when(tampered, leaf(changed)).alias("changed"))
    m = manifest(stored(rows, "merkle-leaves"), ["doc_id"])
    folded = fold(F.coalesce("changed", "node"), F.col("siblings"), F.col("sides"))
    return m.select("doc_id", F.col("node").alias("leaf"), "subroot", "root",
                    F.sha2("siblings", 256).alias("proof_sha256"), folded.alias("folded_root"),
                    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    def hashed(fields: str) -> str:
        parts = [f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields.split()]
        return f"sha256({' || '.join(parts)})"

    # One row per group and level; a level is the list of its digests.
    step = """list_transform(range(0, (len(h) + 1) // 2),
      lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"""
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(n, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(0, 256)) AS n)),
d AS (SELECT *, row_number() OVER () AS rid, doc_id::VARCHAR AS s FROM documents),
crc AS (
  SELECT rid, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS crc FROM d, bits WHERE s IS NOT NULL),
l AS (
  SELECT d.rid, doc_id, coalesce('=' || lang, '-') AS k, {hashed('doc_id source lang n_chars text')} AS leaf,
    CASE WHEN crc % {TAMPER_EVERY} = 0 THEN {hashed('doc_id source lang (n_chars+1) text')} END AS changed
  FROM d LEFT JOIN crc ON crc.rid = d.rid),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place FROM l),
tree AS (
  SELECT k, 0 AS lvl, list(leaf ORDER BY place) AS h FROM p GROUP BY k
  UNION ALL SELECT k, lvl + 1, {step} FROM tree WHERE len(h) > 1),
sub AS (SELECT k, max(lvl) AS height, max(h[1]) FILTER (len(h) = 1) AS subroot,
          row_number() OVER (ORDER BY k) - 1 AS place FROM tree GROUP BY k),
top AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS h FROM sub
  UNION ALL SELECT lvl + 1, {step} FROM top WHERE len(h) > 1),
path AS (
  SELECT p.rid, t.lvl, (p.place >> t.lvl) % 2 AS odd, coalesce(t.h[xor(p.place >> t.lvl, 1) + 1], '') AS sib
  FROM p JOIN tree t ON t.k = p.k AND len(t.h) > 1
  UNION ALL
  SELECT p.rid, s.height + t.lvl, (s.place >> t.lvl) % 2, coalesce(t.h[xor(s.place >> t.lvl, 1) + 1], '')
  FROM p JOIN sub s ON s.k = p.k JOIN top t ON len(t.h) > 1),
proof AS (SELECT rid, list({{'odd': odd, 'sib': sib}} ORDER BY lvl) AS q FROM path GROUP BY rid),
folded AS (
  SELECT p.rid, 0 AS i, coalesce(changed, leaf) AS h, coalesce(q, []) AS q FROM p LEFT JOIN proof ON proof.rid = p.rid
  UNION ALL
  SELECT rid, i + 1, sha256(CASE WHEN q[i + 1].odd = 1 THEN q[i + 1].sib || h ELSE h || q[i + 1].sib END), q
  FROM folded WHERE i < len(q)),
r AS (SELECT h[1] AS root FROM top WHERE len(h) = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root,
  sha256(coalesce(array_to_string(list_transform(f.q, lambda x: x.sib), ''), '')) AS proof_sha256,
  f.h AS folded_root, f.h = r.root AS verified
FROM p JOIN sub s ON s.k = p.k JOIN folded f ON f.rid = p.rid AND f.i = len(f.q), r"""


SQL = _sql()
