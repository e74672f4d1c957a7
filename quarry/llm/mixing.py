"""Operator 1, mixing sources to target weights by hierarchical budgeting.

A budget of tokens is handed down a tree (domain, language, source). At each
node it is shared among the children by weight; a child that cannot take its
share (fewer tokens than that in all allowed epochs) takes what it has, and
the shortage goes to its siblings in proportion to their weights. Only what a
whole node cannot take returns to the level above. At a leaf the budget is
whole epochs plus the prefix of one more epoch, in which documents are ordered
by a hash of seed, epoch and id; the prefix holds the documents whose running
sum of tokens stays within what is left.

All arithmetic is on integers. Leaves are summed up before any exchange, the
prefix sum of a leaf runs over 4096 hash bins first and over the rows of the
one bin with the cut afterwards, so a leaf with a third of all rows is never
in one task; the choice itself is a filter on the documents, whose texts are
never shuffled.

Defined results: null or blank texts have no tokens and cost nothing; a null
language or source is the leaf named ``und``. Weights that the table
doesn't name are ``default``. Rows with equal id (repeated rows) share their
place in the order, so all or none of them are in a prefix; rows without an id
do so too. A text counts whole, however long; it is in a prefix or not. A budget of at
least epochs * tokens takes everything; an empty table gives an empty result.
Other columns are kept whatever their names; ``epoch`` replaces a column of
that name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read, stored, words

LEVELS = ("domain", "lang", "source")
SMALL_LEAVES = 50_000
BIN_DIGITS = 3  # hex digits of the order hash: 4096 bins a leaf


@dataclass(frozen=True)
class Mix:
    """Weights by level (key: the node's own name), the share of the corpus
    to take, the epochs a document may be seen in, and the seed."""

    weights: dict = field(default_factory=lambda: {
        "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
        "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}})
    default: int = 1
    share_percent: int = 60
    epochs: int = 2
    seed: str = "mix-1"

    def weight(self, level: str) -> Column:
        out = F.lit(self.default)
        for name, w in self.weights.get(level, {}).items():
            out = F.when(F.col(level) == name, w).otherwise(out)
        return out.cast("long")


def tree_columns(df: DataFrame) -> DataFrame:
    """id, tree columns and token count of documents. A source's domain is
    domain0 to domain3, by the first hex digit of the md5 of its name."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("und"))
    digit = F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int")
    return df.select(
        F.col("doc_id"), F.concat(F.lit("domain"), (digit % 4).cast("string")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), source.alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("tokens"))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (one row a child: parent columns, name, weight, room, and the
    parent's budget) with ``given``, the child's part.

    Children are taken in order of room per weight. One is full when its room
    is at most its share of what the earlier ones left; past the last full one
    the rest is shared by weight, and what integer division leaves goes to
    the children in turn. A window spans the children of one node only."""
    by = [*parent, F.lit(0)]
    order = Window.partitionBy(*by).orderBy(F.try_divide("room", "weight").asc_nulls_last(), name)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)

    def big(c: str) -> Column:  # products of token counts and weights stay exact at any size
        return F.col(c).cast("decimal(19,0)")

    d = nodes.withColumns({
        "b_left": F.col("budget") - F.coalesce(F.sum("room").over(past), F.lit(0)),
        "w_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(past), F.lit(0))})
    d = d.withColumn("full", F.when(big("room") * big("w_left") <= big("weight") * big("b_left"), 1).otherwise(0))
    # Fullness is monotone in the order; the running minimum guards the equal ratios.
    d = d.withColumn("full", F.min("full").over(order))
    d = d.withColumns({
        "b_rest": F.col("budget") - F.sum(F.col("room") * F.col("full")).over(whole),
        "w_rest": F.sum(F.col("weight") * (1 - F.col("full"))).over(whole)})
    share = F.when(F.col("w_rest") > 0, F.expr(
        "CAST((CAST(b_rest AS decimal(20,0)) * weight) DIV w_rest AS long)")).otherwise(F.lit(0).cast("long"))
    d = d.withColumn("base", F.when(F.col("full") == 1, F.col("room")).otherwise(share))
    crumbs = F.col("budget") - F.sum("base").over(whole)
    open_rank = F.sum(1 - F.col("full")).over(order)
    extra = F.when((F.col("full") == 0) & (open_rank <= crumbs), 1).otherwise(0)
    return d.withColumn("given", F.least(F.col("room"), F.col("base") + extra).cast("long")).drop(
        "b_left", "w_left", "full", "b_rest", "w_rest", "base")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``given``, ``whole`` epochs and
    ``rest`` of a further one. Rooms are summed up the tree, budgets go down it."""
    rooms = leaves.withColumn("room", F.col("tokens") * mix.epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0  # one number
    top = rooms.groupBy("domain").agg(F.sum("room").alias("room")).withColumn(
        "budget", F.lit(min(total * mix.share_percent // 100, total * mix.epochs)).cast("long"))
    down = share_out(top.withColumn("weight", mix.weight("domain")), [], "domain")
    for k in (1, 2):
        up, name = list(LEVELS[:k]), LEVELS[k]
        nodes = rooms.groupBy(*up, name).agg(F.sum("room").alias("room"))
        parent = down.select(*up, F.col("given").alias("budget"))
        down = share_out(nodes.join(parent, up).withColumn("weight", mix.weight(name)), up, name)
    return down.select(*LEVELS, "given").join(leaves, list(LEVELS)).select(
        *LEVELS, "tokens", "given",
        F.expr("CASE WHEN tokens > 0 THEN CAST(given DIV tokens AS int) ELSE 1 END").alias("whole"),
        F.expr("CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END").cast("long").alias("rest"))


def place(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch.cast("string"), doc_id.cast("string")))


def with_leaf(d: DataFrame, plan: DataFrame, n_leaves: int) -> DataFrame:
    """Join on the leaf; the plan is broadcast only if it is small, else AQE splits hot leaves."""
    return d.join(F.broadcast(plan) if n_leaves <= SMALL_LEAVES else plan, list(LEVELS))


def plan_mix(docs: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """Per leaf: whole epochs and the last place (hash, id) inside the prefix of
    the next epoch; and the number of leaves. ``docs`` is from tree_columns."""
    leaves = stored(docs.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    plan = stored(budgets(leaves, mix), "mix-budgets")
    n = plan.count()
    order = with_leaf(docs, plan.filter("rest > 0").select(*LEVELS, "whole", "rest"), n).select(
        *LEVELS, "rest", "tokens", "doc_id", place(mix, F.col("whole"), F.col("doc_id")).alias("place"))
    order = order.withColumn("bin", F.substring("place", 1, BIN_DIGITS))
    sums = order.groupBy(*LEVELS, "bin").agg(F.sum("tokens").alias("in_bin"), F.first("rest").alias("rest"))
    upto = F.sum("in_bin").over(Window.partitionBy(*LEVELS).orderBy("bin"))
    # The cut is in the first bin that passes the rest (there is one: rest < tokens of an epoch).
    cut_bin = sums.withColumn("upto", upto).filter("upto > rest").groupBy(*LEVELS).agg(
        F.min_by(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("before")), "bin").alias("c")).select(
        *LEVELS, F.col("c.bin").alias("bin"), F.col("c.before").alias("before"))
    near = with_leaf(order, cut_bin.withColumnRenamed("bin", "cut_bin"), n).filter("bin = cut_bin")
    run = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("place", "doc_id"))
    inside = near.withColumn("upto", F.col("before") + run).filter("upto <= rest")
    last = inside.groupBy(*LEVELS).agg(F.max(F.struct("place", "doc_id")).alias("last"))
    cuts = cut_bin.join(last, list(LEVELS), "left").select(
        *LEVELS, F.coalesce(F.col("last.place"), F.col("bin")).alias("cut_place"),
        F.col("last.doc_id").alias("cut_id"))
    return stored(plan.join(cuts, list(LEVELS), "left"), "mix-plan"), n


def chosen(d: DataFrame, plan: DataFrame, n: int, mix: Mix, lang: Column, source: Column,
           keep: list[str]) -> DataFrame:
    """The rows of ``d`` that the plan takes, once per epoch: a join on the leaf and a filter."""
    cuts = plan.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"),
                       F.struct("whole", "rest", "cut_place", "cut_id").alias("__p"))
    d = d.join(F.broadcast(cuts) if n <= SMALL_LEAVES else cuts,
               (lang == F.col("__lang")) & (source == F.col("__source")))
    p = F.col("__p")
    here = place(mix, p["whole"], F.col("doc_id"))
    part = (p["rest"] > 0) & ((here < p["cut_place"]) | ((here == p["cut_place"]) & ((F.col("doc_id") <= p["cut_id"]) | F.col("doc_id").eqNullSafe(p["cut_id"]))))
    d = d.withColumn("__times", p["whole"] + F.when(part, 1).otherwise(0)).filter("__times > 0")
    return d.select(*[F.col(f"`{c}`") for c in keep],
                    F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch"))


def select_mix(df: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The chosen rows of ``df`` (doc_id, lang, source, text and any others),
    once per epoch they are seen in, with ``epoch`` (from 0)."""
    mix = mix or Mix()
    plan, n = plan_mix(stored(tree_columns(df), "mix-docs"), mix)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("und")) for c in ("lang", "source")]
    return chosen(df, plan, n, mix, *named, keep=[c for c in df.columns if c != "epoch"])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, once per epoch, with their leaf and tokens."""
    mix = Mix()
    docs = stored(tree_columns(read(spark, sf_dir, "documents")), "mix-docs")
    plan, n = plan_mix(docs, mix)
    return chosen(docs, plan, n, mix, F.col("lang"), F.col("source"), keep=docs.columns)


def _sql(mix: Mix) -> str:
    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{k}' THEN {w}" for k, w in mix.weights.get(level, {}).items())
        return f"(CASE{cases} ELSE {mix.default} END)" if cases else f"{mix.default}"

    def level(k: int) -> str:
        up, name = list(LEVELS[:k]), LEVELS[k]
        by, cols = (f"PARTITION BY {', '.join(up)}" if up else ""), ", ".join(LEVELS[: k + 1])
        budget = f"(SELECT {', '.join(up)}, given AS budget FROM down{k - 1})" if up else "top"
        join = f"JOIN {budget} USING ({', '.join(up)})" if up else f", {budget}"
        return f"""
n{k} AS (SELECT {cols}, room, budget, {weight(name)} AS weight FROM (
    SELECT {cols}, sum(tokens) * {mix.epochs} AS room FROM leaves GROUP BY ALL) {join}),
f{k} AS (SELECT *, min(CASE WHEN room * w_left <= weight * b_left THEN 1 ELSE 0 END) OVER (
        {by} ORDER BY room::DOUBLE / weight, {name}) AS is_full FROM (SELECT *,
    budget - coalesce(sum(room) OVER ({by} ORDER BY room::DOUBLE / weight, {name}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_left,
    sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by} ORDER BY room::DOUBLE / weight, {name}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM n{k})),
s{k} AS (SELECT *, CASE WHEN is_full = 1 THEN room WHEN w_rest > 0 THEN (b_rest * weight) // w_rest ELSE 0 END AS base
    FROM (SELECT *, budget - sum(room * is_full) OVER ({by}) AS b_rest,
        sum(weight * (1 - is_full)) OVER ({by}) AS w_rest FROM f{k})),
down{k} AS (SELECT {cols}, least(room, base + CASE WHEN is_full = 0 AND sum(1 - is_full) OVER (
        {by} ORDER BY room::DOUBLE / weight, {name}) <= budget - sum(base) OVER ({by}) THEN 1 ELSE 0 END) AS given
    FROM s{k})"""

    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'und') AS source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::HUGEINT AS tokens
  FROM documents),
docs AS (SELECT doc_id, 'domain' || ((instr('0123456789abcdef', substring(md5(source), 1, 1)) - 1) % 4) AS domain,
    lang, source, tokens FROM t),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM docs GROUP BY ALL),
top AS (SELECT least((sum(tokens) * {mix.share_percent}) // 100, sum(tokens) * {mix.epochs}) AS budget FROM leaves),
{",".join(level(k) for k in range(3))},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 1 END AS whole,
    CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest
  FROM down2 JOIN leaves USING (domain, lang, source)),
o AS (SELECT docs.*, whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('{mix.seed}:' || whole || ':' || doc_id), doc_id) AS upto
  FROM docs JOIN plan USING (domain, lang, source)),
c AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, unnest(range(times::BIGINT))::INTEGER AS epoch
FROM c WHERE times > 0"""


SQL = _sql(Mix())
