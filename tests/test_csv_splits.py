"""CSV files of many splits, with line ends inside quoted cells."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources import files as FS
from quarry.sources.records import csv_records

DDL = "k bigint, t string, u string"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def cell(r):
    return r.choice(["plain", 'a "quoted" word', "line\nends\n\n", ",", "", " blanks ", "é漢", "x" * 60, '"', '\n"\n', "a\r\nb",
                     "long\n" * 500 if r.random() < 0.05 else "short", '""', "\\N", "\\\\N", "\\"])


@pytest.mark.parametrize("seed", range(4))
def test_records_of_files_in_many_splits(spark, small_splits, tmp_path, seed):
    r = random.Random(seed)
    want = []
    for f in range(2):
        rows = [[str(f * 1000 + i), cell(r), cell(r)] for i in range(150)]
        want += rows
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            w = csv.writer(out, lineterminator="\r\n" if f else "\n")
            w.writerow(["k", "t\nwith a line end", "u"])
            w.writerows(rows)
    got = csv_records(spark, str(tmp_path))
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() >= 8
    back = [next(csv.reader([x.value.replace("\n", "\x00")])) for x in got.collect()]
    back = [[c.replace("\x00", "\n") for c in row] for row in back]
    assert sorted(back) == sorted(want)


def test_round_trip_in_many_splits(spark, small_splits, tmp_path):
    r = random.Random(9)
    rows = [(i, r.choice([None, cell(r)]), cell(r)) for i in range(300)]
    df = spark.createDataFrame(rows, DDL)
    path = FS.write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = FS.read_csv(spark, path, DDL)
    assert back.rdd.getNumPartitions() >= 8
    assert sorted((x.k, x.t, x.u) for x in back.collect()) == sorted(rows, key=lambda x: x[0])


def test_rejects_keep_their_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t,u\n1,a,b\nx,"two\nlines",c\n\n2,,"q"\n3,only two\n')
    ok, bad = FS.read_csv_checked(spark, str(tmp_path), DDL)
    assert sorted((x.k, x.t, x.u) for x in ok.collect()) == [(1, "a", "b"), (2, None, "q")]  # an empty cell without quotes is null
    assert sorted(x[1] for x in bad.collect()) == ["3,only two", 'x,"two\nlines",c']
    with pytest.raises(Exception):
        FS.read_csv(spark, str(tmp_path), DDL).collect()


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("k,t,u\n")
    (tmp_path / "c.csv").write_text("k,t,u")
    assert FS.read_csv(spark, str(tmp_path), DDL).count() == 0


def test_a_null_mark_as_text_comes_back(spark, tmp_path):
    rows = [(1, "\\N", None), (2, "\\\\N", "\\"), (3, "", "N")]
    path = FS.write_csv(spark.createDataFrame(rows, DDL), str(tmp_path / "out"))
    assert sorted(map(tuple, FS.read_csv(spark, path, DDL).collect())) == rows
    assert FS.read_csv(spark, path, DDL).filter(F.col("t").isNull()).count() == 0
