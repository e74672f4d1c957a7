"""CSV records of files that are read in many pieces.

A quoted cell may hold line ends, so where a record begins depends on all
quotes before it in the file. Files are read as lines, a split at a time; two
passes settle the rest. The first reduces a split to the parity of its quotes
and the last line that begins a record in it, for either state it may start in.
One row a split, running over the splits of a file, gives the state in which
each begins and the record it is in the middle of. The second pass gives every
line the place of its record's first line. Records of one line, nearly all in
most files, go on as they are; only the lines of longer ones are exchanged, by
record.

Files follow RFC 4180: cells with quotes, separators or line ends are quoted,
and a quote inside is doubled. A cell without quotes around it must hold none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _blocks_of(batches, names: tuple[str, ...]):
    """Slices of (file, block, ...) batches, each of one split, with whether the split goes on from the slice before."""
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        file, block = (b.column(b.schema.get_field_index(c)) for c in names)
        new = np.ones(n, bool)
        same = np.array(file[1:].to_numpy(zero_copy_only=False) == file[:-1].to_numpy(zero_copy_only=False), bool)
        new[1:] = ~(same & (np.diff(block.to_numpy()) == 0))
        cuts = [*np.flatnonzero(new).tolist(), n]
        for a, z in zip(cuts, cuts[1:]):
            key = (file[a].as_py(), block[a].as_py())
            yield key, key == last, b.slice(a, z - a)
            last = key


def _summary(batches):
    """A row per split: lines, parity, and the last line that begins a record if the split starts outside or inside a cell."""
    import pyarrow as pa

    def row():
        return pa.RecordBatch.from_pydict(
            {"file": [key[0]], "block": [key[1]], "lines": [lines], "parity": [parity], "last0": [last[0]], "last1": [last[1]]},
            schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("parity", pa.int32()),
                              ("last0", pa.int64()), ("last1", pa.int64())]))

    key, lines, parity, last = None, 0, 0, [-1, -1]
    for k, goes_on, part in _blocks_of(batches, ("file", "block")):
        if not goes_on:
            if key is not None:
                yield row()
            key, lines, parity, last = k, 0, 0, [-1, -1]
        odd = part.column(part.schema.get_field_index("odd")).to_numpy(zero_copy_only=False).astype(np.int64)
        before = (parity + np.concatenate([[0], np.cumsum(odd)])) % 2
        for h in (0, 1):
            begins = np.flatnonzero(before[:-1] == h)
            if len(begins):
                last[h] = lines + int(begins[-1])
        lines += len(odd)
        parity = int(before[-1])
    if key is not None:
        yield row()


def _placed(batches):
    """Every line with the place (split, line) of its record's first line and its own, and whether it is a whole record."""
    import pyarrow as pa

    line, state, at = 0, 0, (0, 0)
    for (_, block), goes_on, part in _blocks_of(batches, ("file", "block")):
        col = {n: part.column(part.schema.get_field_index(n)) for n in part.schema.names}
        if not goes_on:
            line, state = 0, col["state"][0].as_py()
            at = (col["in_block"][0].as_py() or 0, col["in_line"][0].as_py() or 0)
        odd = col["odd"].to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(odd)
        before = (state + np.concatenate([[0], np.cumsum(odd)])) % 2
        begins = before[:-1] == 0
        place = np.where(begins, line + np.arange(n), -1)
        first = np.maximum.accumulate(place)
        in_block = np.where(first >= 0, block, at[0])
        in_line = np.where(first >= 0, first, at[1])
        whole = begins & (before[1:] == 0)
        at, state = (int(in_block[-1]), int(in_line[-1])), int(before[-1])
        yield pa.RecordBatch.from_arrays(
            [col["file"], pa.array(in_block), pa.array(in_line), pa.array(np.full(n, block)), pa.array(line + np.arange(n)),
             pa.array(whole), col["value"]],
            names=["file", "in_block", "in_line", "block", "line", "whole", "value"])
        line += n


def csv_records(spark: SparkSession, path: str, header: bool = True, **options) -> DataFrame:
    """(file, value): a row per record of all files at ``path``, without their
    header records and without blank lines. ``options`` go to the reader
    (recursive lookup, name patterns)."""
    lines = spark.read.options(lineSep="\n", **options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    lines = lines.withColumn("odd", odd)
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = lines.select("file", "block", "odd").mapInArrow(
        _summary, "file string, block bigint, lines bigint, parity int, last0 bigint, last1 bigint")
    splits = splits.withColumn("state", F.coalesce(F.sum("parity").over(of_file), F.lit(0)) % 2)
    last = F.when(F.col("state") == 0, F.col("last0")).otherwise(F.col("last1"))
    splits = splits.withColumn("begun", F.when(last >= 0, F.struct(F.col("block").alias("b"), last.alias("l"))))
    splits = splits.withColumn("open", F.last("begun", ignorenulls=True).over(of_file)).select(
        "file", "block", F.col("state").cast("int").alias("state"), F.col("open.b").alias("in_block"), F.col("open.l").alias("in_line"))
    # (one row per split of the files: some 128 MB each)
    placed = lines.join(F.broadcast(splits), ["file", "block"]).select(
        "file", "block", "value", "odd", "state", "in_block", "in_line").mapInArrow(
        _placed, "file string, in_block bigint, in_line bigint, block bigint, line bigint, whole boolean, value string")
    if header:
        placed = placed.filter((F.col("in_block") != 0) | (F.col("in_line") != 0))
    one = placed.filter("whole").select("file", "value")
    many = placed.filter("NOT whole").groupBy("file", "in_block", "in_line").agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    many = many.select("file", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    records = one.unionByName(many).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    return records.filter(F.col("value") != "")
