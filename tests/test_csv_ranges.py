"""CSV files with line breaks in cells: many tasks, the same rows as Spark's whole-file reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from tabloom.sources import csv_ranges as R
from tabloom.sources import io as S


def whole(spark, path, header=True, sep=",", encoding="utf-8"):
    df = (spark.read.option("sep", sep).option("encoding", encoding).option("header", header).option("quote", '"').option("escape", '"')
          .option("multiLine", True).option("nullValue", "").option("emptyValue", None).csv(path))
    return S.blanks_to_null(df if header else df.toDF(*[str(i) for i in range(len(df.columns))]))


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def use(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")
    yield use
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bag(df):
    return sorted(map(repr, df.collect()))


def test_line_states_equal_a_plain_reader():
    rng = random.Random(3)
    for _ in range(4000):
        cells = ["".join(rng.choice('ab",\n') for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 4))]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(cells)
        lines = out.getvalue()[:-1].encode().split(b"\n")
        inside = False
        for k, line in enumerate(lines):
            inside = R.ends_inside(line, inside, b'"', b",")
            assert inside == (k < len(lines) - 1), lines
    assert not R.ends_inside(b'5" pipe,2" bolt', False, b'"', b",")          # a quote inside a plain cell
    assert R.ends_inside(b'x,"a""', False, b'"', b",") and not R.ends_inside(b'x,"a"" b"c', False, b'"', b",")


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cuts_anywhere(spark, tmp_path, small_ranges, size, end):
    rng = random.Random(size)
    rows = []
    for i in range(50):
        cell = "".join(rng.choice(['a', 'é', '"', ',', ' ', end, "漢", '""']) for _ in range(rng.choice([0, 3, 30, 200])))
        rows.append([str(i), cell, rng.choice(["", " ", "x", '5 "q"', end])])
    for f in range(2):
        with open(tmp_path / f"part{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, lineterminator=end)
            w.writerow(["id", "text", "other"])
            w.writerows(rows[f::2])
    small_ranges(size)
    got = S.read_csv(spark, str(tmp_path))
    assert got.columns == ["id", "text", "other"]
    want = [[c if c.strip(" ") else None for c in r] for r in rows]
    assert sorted(map(list, got.collect()), key=repr) == sorted(want, key=repr)       # cells keep their own line breaks
    if end == "\n":                       # Spark's reader writes CR LF in cells as LF
        assert bag(got) == bag(whole(spark, str(tmp_path)))
        assert bag(S.read_csv(spark, str(tmp_path), header=False)) == bag(whole(spark, str(tmp_path), False))
    if size < 1000:
        assert R.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 5


def test_a_cell_over_many_ranges(spark, tmp_path, small_ranges):
    big = "\n".join(f"line {i}" for i in range(500))
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{big}"\n2,"short"\n\n3,\n4,"{big}"')
    small_ranges(64)
    got = {r.k: r.v for r in S.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"1": big, "2": "short", "3": None, "4": big}


def test_other_encodings_and_delimiters(spark, tmp_path, small_ranges):
    small_ranges(50)
    text = 'k;v\n1;"売上\n表;""甲"""\n2;ソ能\n' * 1
    (tmp_path / "j.csv").write_bytes(text.encode("shift_jis"))
    got = {r.k: r.v for r in S.read_csv(spark, str(tmp_path / "j.csv"), delimiter=";", encoding="shift_jis").collect()}
    assert got == {"1": '売上\n表;"甲"', "2": "ソ能"}
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfk,v\n1,\"a\nb\"\n")
    assert [(r.k, r.v) for r in S.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", "a\nb")]
    (tmp_path / "e.csv").write_text("k,v\n")
    assert S.read_csv(spark, str(tmp_path / "e.csv")).count() == 0


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    """The documents' texts, 931 of 1000 with line breaks, in one file that is repeated to about 20 MB."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.crossJoin(spark.range(8).select(F.col("id").alias("copy")))
    S.export_csv({"documents": docs.coalesce(1)}, str(tmp_path))
    small_ranges(1 << 20)
    got = S.read_csv(spark, f"{tmp_path}/documents")
    assert R.lines_of(spark, f"{tmp_path}/documents").rdd.getNumPartitions() >= 15
    want = docs.select(F.col("doc_id").cast("string"), F.when(F.trim("text") != "", F.col("text")).alias("text"), "lang", F.col("copy").cast("string"))
    total = F.sum(F.xxhash64("doc_id", "text", "lang", "copy").cast("decimal(38,0)"))
    assert got.select(total, F.count("*")).first() == want.select(total, F.count("*")).first()
