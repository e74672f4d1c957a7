"""File sources and sinks: CSV with explicit schemas, recursive folder
scans, JSON, vector and partitioned Parquet sinks, reuse of stored
results. Paths are cluster paths (e.g. under ``spark.checkpoint.dir``)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.session import ensure_checkpoint_dir, scratch_path
from quarry.sources.records import csv_records


# A null cell. Quoted empty cells are empty texts; a text that is this mark, or
# backslashes and this mark, is written with one backslash more.
NULL_MARK = "\\N"
_CSV = {"quote": '"', "escape": '"', "nullValue": NULL_MARK, "emptyValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CORRUPT = "_corrupt_record"


def _strings(df: DataFrame, names, change: Callable[[Column], Column]) -> DataFrame:
    """``df`` with its string columns among ``names`` changed."""
    kinds = dict(df.dtypes)
    return df.select(*[change(F.col(f"`{c}`")).alias(c) if c in names and kinds[c] == "string" else F.col(f"`{c}`")
                       for c in df.columns])


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Header line, no index column; overwrite (idempotent on task retry).
    Blanks, quotes, line ends, empty texts and nulls come back as they were."""
    marked = _strings(df, set(df.columns) - set(partition_by or []), lambda c: F.regexp_replace(c, r"^(\\+N)$", r"\\$1"))
    w = marked.write.mode("overwrite").options(header=True, **_CSV).option("quoteAll", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def _schema(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _parsed(spark: SparkSession, path: str, schema: StructType, mode: str, **options) -> DataFrame:
    """The records at ``path`` as columns of ``schema``, in as many tasks as the files have splits."""
    records = csv_records(spark, path, **options)
    how = {"mode": mode, "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true", **{k: str(v) for k, v in _CSV.items()}}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    d = records.select("file", F.from_csv("value", ddl, how).alias("r")).select(F.col("file").alias("_path"), "r.*")
    return _strings(d, {f.name for f in schema.fields} - {CORRUPT}, lambda c: F.regexp_replace(c, r"^\\(\\+N)$", "$1"))


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str,
                     **options) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the declared schema, rejects). Every record is parsed in
    full whatever columns are used later, so both have the same rows for
    every query; a reject keeps its line in ``_corrupt_record``."""
    full = StructType([*_schema(schema).fields, StructField(CORRUPT, StringType())])
    ensure_checkpoint_dir(spark)
    df = _parsed(spark, path, full, "PERMISSIVE", **options).checkpoint()  # both outputs come from one and the same parse
    ok = df.filter(F.col(CORRUPT).isNull()).select(*[f"`{f.name}`" for f in _schema(schema).fields], "_path")
    return ok, df.filter(F.col(CORRUPT).isNotNull()).select("_path", CORRUPT)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV read: declared schema, header skipped (no inference pass). A
    row that doesn't fit fails the query instead of turning into nulls."""
    return _parsed(spark, path, _schema(schema), "FAILFAST").drop("_path")


def read_csv_positional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header present but ignored: the declared names are applied by position."""
    return read_csv(spark, path, schema)


def read_csv_tree(spark: SparkSession, root: str, schema: StructType | str,
                  glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Every matching file below ``root`` (recursively), stacked: (rows that fit
    the schema, rejects). Unreadable files are skipped; the source path is
    kept as ``_path``."""
    return read_csv_checked(spark, root, schema, recursiveFileLookup=True, pathGlobFilter=glob, ignoreCorruptFiles=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def default_sample_valid(df: DataFrame, col: str) -> bool:
    """A stored text result is valid when a sample value has spaces or is
    short (a long value without any space means a broken earlier run)."""
    row = df.select(col).filter(F.col(col).isNotNull()).limit(1).collect()
    if not row:
        return True
    v = row[0][0]
    return not (" " not in v and len(v) > 20)


def materialize_or_reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                         check: Callable[[DataFrame], bool]) -> DataFrame:
    """Read the stored result at ``path`` unless it is missing or fails the
    sample check; then rebuild it, write it (overwrite) and read it back.
    Reading back also cuts the lineage of later jobs."""
    if path_exists(spark, path):
        stored = spark.read.parquet(path)
        if check(stored):
            return stored
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_RESULTS: dict[tuple, str] = {}


def once_per_input(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result ``name`` of the table at ``source``, built and stored once per
    application and state of the table (bytes, files, time of its last change)
    and read back by whoever asks again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size, status = fs.getContentSummary(p), fs.getFileStatus(p)
    key = (spark.sparkContext.applicationId, name, source, size.getLength(), size.getFileCount(),
           status.getModificationTime())
    path = _RESULTS.get(key)
    if path is None or not path_exists(spark, path):
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _RESULTS[key] = path
    return spark.read.parquet(path)


def write_vectors(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> str:
    """One output folder per parameter value (``by=value/``)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path
