"""CSV files with line breaks in cells, read by many tasks.

Spark's text source cuts a file at line breaks, which may lie inside a quoted
cell.  A first scan finds for every cut range how a line state at its start
(between records, or inside a quoted cell) leads to the state at its end.  The
ranges' states follow from these in file order.  A second scan then joins each
range's lines to whole records; the record that a cut runs through is put
together from its pieces.  Spark's own ``from_csv`` parses the records.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOM = b"\xef\xbb\xbf"


def ends_inside(line: bytes, inside: bool, quote: bytes, delimiter: bytes) -> bool:
    """Whether a line that starts inside a quoted cell, or at a record's start, ends inside one.

    A quote opens a cell only at the cell's start; a doubled one belongs to the
    text; text after a closing quote runs to the next delimiter.
    """
    if quote not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:
            if line.startswith(quote, at):
                at += 1
            else:
                at = line.find(delimiter, at)
                if at < 0:
                    return False
                at += len(delimiter)
                continue
        inside = False
        while True:
            at = line.find(quote, at)
            if at < 0:
                return True
            if not line.startswith(quote, at + 1):
                break
            at += 2
        at = line.find(delimiter, at + 1)
        if at < 0 or at >= n:
            return False
        at += len(delimiter)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, line)``: the bytes of each line, and which range of which file it lies in."""
    df = spark.read.option("lineSep", "\n").text(path)
    return df.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.col("value").cast("binary").alias("line"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int] | None, bytes]]:
    """The lines in order, each with its range; (None, b"") at the end."""
    for b in batches:
        for f, s, line in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), b.column("line").to_pylist()):
            yield (f, s), line
    yield None, b""


def range_states(lines: DataFrame, quote: bytes, delimiter: bytes) -> DataFrame:
    """One row a range: ``file, start``, the states ``after_out`` and ``after_in`` at its end, and ``closes``.

    ``closes``: whether a record that runs into the range ends in it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, [False, True, False]
        for at, line in _ranges(batches):
            if at != now:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "after_out": [state[0]],
                                                      "after_in": [state[1]], "closes": [state[2]]})
                now, state = at, [False, True, False]
            if at is not None:
                out = ends_inside(line, state[0], quote, delimiter)
                # once both starts have met a record's end they go on alike
                state[1] = out if state[0] == state[1] else ends_inside(line, state[1], quote, delimiter)
                state[0] = out
                state[2] = state[2] or not state[1]

    return lines.mapInArrow(run, "file long, start long, after_out boolean, after_in boolean, closes boolean")


def starts_inside(states: list) -> dict[tuple[int, int], int]:
    """Ranges that start inside a cell, with the start of the range in which that cell's record began."""
    out: dict[tuple[int, int], int] = {}
    file, inside, origin = None, False, 0
    for r in sorted(states, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, inside = r.file, False
        if inside:
            out[r.file, r.start] = origin
        if not inside or r.closes:
            origin = r.start
        inside = r.after_in if inside else r.after_out
    return out


def records(lines: DataFrame, inside: dict[tuple[int, int], int], quote: bytes, delimiter: bytes) -> DataFrame:
    """``(file, origin, start, piece, first)``: whole records, and pieces of those that a cut runs through.

    ``origin`` is null for a whole record, else the start of the range in which
    the record began.  ``first`` marks a file's first record.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, held, state, origin, size = None, [], False, None, 0

        def batch():
            out = pa.RecordBatch.from_pydict({
                "file": pa.array([r[0] for r in rows], pa.int64()), "origin": pa.array([r[1] for r in rows], pa.int64()),
                "start": pa.array([r[2] for r in rows], pa.int64()), "piece": pa.array([r[3] for r in rows], pa.binary()),
                "first": pa.array([r[4] for r in rows], pa.bool_())})
            rows.clear()
            return out

        first = False
        for at, line in _ranges(batches):
            if at != now:
                if held:          # the record goes on in the next range; the line break between the pieces is put back
                    rows.append((now[0], now[1] if origin is None else origin, now[1], b"\n".join(held) + b"\n", first))
                if at is None:
                    break
                now, held = at, []
                origin = inside.get(at)
                state, first = origin is not None, at[1] == 0
                if first and line.startswith(_BOM):
                    line = line[3:]
            held.append(line)
            state = ends_inside(line, state, quote, delimiter)
            if state:
                continue
            text = b"\n".join(held)
            held = []
            if origin is not None:
                rows.append((now[0], origin, now[1], text, False))
            elif text not in (b"", b"\r"):
                rows.append((now[0], None, now[1], text, first))
                first = False
            origin = None
            size += len(text)
            if len(rows) >= 5000 or size > 4 << 20:
                size = 0
                yield batch()
        if rows:
            yield batch()

    return lines.mapInArrow(run, "file long, origin long, start long, piece binary, first boolean")


def read_records(spark: SparkSession, path: str, delimiter: str, quote: str = '"', encoding: str = "utf-8") -> DataFrame:
    """``(record, first)``: the text of every record of the CSV files at ``path``, and whether it is a file's first."""
    q, d = quote.encode(encoding), delimiter.encode(encoding)
    lines = lines_of(spark, path)
    inside = starts_inside(range_states(lines, q, d).collect())       # one row a range
    pieces = records(lines, inside, q, d)
    cut = (pieces.where(F.col("origin").isNotNull()).groupBy("file", "origin")
           .agg(F.array_sort(F.collect_list(F.struct("start", "piece", "first"))).alias("p"))
           .select(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"])).alias("piece"), F.exists("p", lambda x: x["first"]).alias("first")))
    whole = pieces.where(F.col("origin").isNull()).select("piece", "first")
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a record's own line end may have a carriage return
            text = [x.removesuffix(b"\r").decode(encoding, "replace") for x in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_pydict({"record": pa.array(text, pa.string()), "first": b.column("first")})

    return whole.unionByName(cut).mapInArrow(decoded, "record string, first boolean")


def column_names(spark: SparkSession, path: str, rows: DataFrame, header: bool, delimiter: str, encoding: str) -> list[str]:
    """The first file's header, or a name for each column of its first record."""
    if encoding.lower() in ("utf-8", "utf8", "us-ascii", "iso-8859-1"):
        return (spark.read.option("sep", delimiter).option("encoding", encoding).option("header", header).option("quote", '"')
                .option("escape", '"').option("multiLine", True).csv(path).columns)
    top = rows.where("first").select("record").limit(1).collect()       # Spark's reader does not know the encoding
    cells = next(csv.reader(io.StringIO(top[0].record, newline=""), delimiter=delimiter)) if top else []
    return [c or f"_c{i}" for i, c in enumerate(cells)] if header else [f"_c{i}" for i in range(len(cells))]


def read_split(spark: SparkSession, path: str, header: bool, delimiter: str, encoding: str) -> DataFrame:
    """The CSV files as text columns, parsed by Spark from whole records."""
    rows = read_records(spark, path, delimiter, encoding=encoding)
    columns = column_names(spark, path, rows, header, delimiter, encoding)
    if header:
        rows = rows.where(~F.col("first"))
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "", "mode": "PERMISSIVE"}
    if not columns:
        return spark.createDataFrame([], "")
    cells = rows.select(F.from_csv("record", schema, options).alias("r"))
    return cells.select(*[F.col("r").getField(f"c{i}").alias(c) for i, c in enumerate(columns)])
