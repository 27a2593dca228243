"""Packing of tokenized documents along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.bpe import Encoder
from tabloom.llm.common import materialize, parallel, release
from tabloom.llm.hilbert import hilbert_index
from tabloom.llm.suffix_dedup import groups

DIMS, BITS = 3, 16      # projected dimensions, bits of each on the curve's grid
END = 1                 # id after each document
RUN_IDS = 1 << 20       # ids whose vectors are summed at once
WORDS = 200_000         # words that a worker remembers


def _directions(ids: np.ndarray) -> np.ndarray:
    """Random signs of each id's hash in every projected dimension (ids x DIMS)."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.stack([((h >> np.uint64(d)) & np.uint64(1)).astype(np.int8) * 2 - 1 for d in range(DIMS)], 1)


def curve_keys(docs: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document's id array.

    The hashed count vector is projected on DIMS random sign directions and
    scaled by the root of its length; a fixed squashing function (not one
    fitted to the data) puts each coordinate on the grid.
    """
    if not docs:
        return np.zeros(0, np.int64)
    n = np.array([len(d) for d in docs], np.int64)
    signs = _directions(np.arange(1 << 16))
    coords = np.empty((len(docs), DIMS))
    for _, own in groups(np.cumsum(n) // RUN_IDS):
        flat, size = np.concatenate([docs[i] for i in own]), n[own]
        ends = np.cumsum(size)
        for d in range(DIMS):
            run = np.cumsum(signs[flat, d], dtype=np.int64)
            before = np.where(ends > size, run[np.maximum(ends - size - 1, 0)], 0)
            coords[own, d] = (np.where(size > 0, run[np.maximum(ends - 1, 0)], 0) - before) / np.sqrt(np.maximum(size, 1))
    grid = ((np.tanh(coords / 8) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
    return hilbert_index(grid, BITS)


def tokenized(docs: DataFrame, path: str, ranks: str | None, text: str) -> DataFrame:
    """Per row: its columns (without the text), ``ids`` (two bytes each, with the end id), ``n`` and ``key``."""
    kept = [c for c in docs.columns if c != text]
    df = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("t"))
    row_type = df.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, WORDS, ranks)
        end = np.array([END], "<u2").tobytes()
        for b in batches:
            blobs = [x + end for x in encoder.of([t or "" for t in b.column("t").to_pylist()])]
            ids = [np.frombuffer(x, "<u2") for x in blobs]
            yield pa.RecordBatch.from_pydict({
                "row": b.column("row"), "ids": pa.array(blobs, pa.binary()),
                "n": pa.array([len(x) for x in ids], pa.int64()), "key": pa.array(curve_keys(ids), pa.int64())})
            release()
    return df.mapInArrow(run, f"row {row_type}, ids binary, n long, key long")


def stream_starts(tokens: DataFrame) -> DataFrame:
    """``uid`` -> position of the document's first id in one stream along the curve.

    Only (key, uid, n) are range-sorted; each partition sums its own rows, and
    one row per partition is summed over partitions.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            n = b.column("n").to_numpy()
            after = at + np.cumsum(n)
            yield pa.RecordBatch.from_pydict({"part": b.column("part"), "uid": b.column("uid"),
                                              "n": b.column("n"), "at": pa.array(after - n, pa.int64())})
            at = int(after[-1]) if len(after) else at

    sorted_rows = (tokens.select("key", "uid", "n").repartitionByRange(parallel(tokens), "key", "uid")
                   .sortWithinPartitions("key", "uid").select(F.spark_partition_id().alias("part"), "uid", "n"))
    local = materialize(sorted_rows.mapInArrow(sums, "part int, uid long, n long, at long"), "curve")
    # one row per partition: as many rows as there are shuffle partitions
    total = local.groupBy("part").agg(F.sum("n").alias("n"))
    before = total.select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return local.join(F.broadcast(before), "part").select("uid", (F.col("before") + F.col("at")).alias("at"))


def pack(docs: DataFrame, path: str, size: int = 2048, text: str = "text", ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of ``size`` ids; one row per piece of a document.

    Documents follow one another along the Hilbert curve of their projected
    hashed vectors (ties by row), so a sequence holds similar documents; the
    stream is cut every ``size`` ids, and only the very last sequence can be
    shorter.  Columns: the documents' other columns, ``start``, ``length``,
    ``ids`` (binary, little-endian unsigned 32-bit; if ``with_ids``), ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``.

    ``path`` is the vocabulary's file for the tokenizers library; ``ranks``, if
    given, the same vocabulary as ranks, which encodes new words faster.

    Null texts pack as empty ones (the end id alone); repeated rows are packed
    each; an empty table gives no rows; documents' columns with the names of
    the new ones are dropped.
    """
    new = tuple(c for c in ("start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset") if with_ids or c != "ids")
    docs = docs.select(*[c for c in docs.columns if c not in new])
    # rows get an id that is fixed by being written; the ids are written once and not computed again
    tokens = materialize(tokenized(docs, path, ranks, text).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    row_type = tokens.schema["row"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("pick", *new)}
            ids, ats = b.column("ids").to_pylist(), b.column("at").to_pylist()
            for i, (blob, at) in enumerate(zip(ids, ats)):
                wide = np.frombuffer(blob, "<u2").astype("<u4").tobytes()
                n, start = len(wide) // 4, 0
                while start < n:
                    offset = (at + start) % size
                    length = min(n - start, size - offset)
                    own = wide[4 * start:4 * (start + length)]
                    values = {"pick": i, "start": start, "length": length, "ids": own, "ids_crc32": zlib.crc32(own), "doc_tokens": n,
                              "sequence_id": (at + start) // size, "offset": offset}
                    for c in out:
                        out[c].append(values[c])
                    start += length
            pick = pa.array(out.pop("pick"), pa.int64())
            yield pa.RecordBatch.from_pydict({"row": b.column("row").take(pick)} | {
                c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()})

    joined = tokens.select("row", "ids", "uid").join(stream_starts(tokens), "uid").select("row", "ids", "at")
    fields = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in new)
    out = joined.mapInArrow(pieces, f"row {row_type}, {fields}")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != text], *new)


def digest(pieces: DataFrame) -> DataFrame:
    """Contract columns of the registered query."""
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
