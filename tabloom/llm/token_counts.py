"""Token counts by a map-side two-tier lookup: broadcast table, then worker caches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.bpe import Pieces, pieces_of

SAMPLE_DOCS = 2_000       # documents whose pieces choose the broadcast table (it affects speed only)
TABLE_ENTRIES = 32_768    # entries of the broadcast table
PIECE_BYTES = 32          # longest piece it holds: at most TABLE_ENTRIES * (PIECE_BYTES + 2) bytes
CACHE_ENTRIES = 500_000   # words that a worker remembers besides


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", sample_docs: int = SAMPLE_DOCS,
                     entries: int = TABLE_ENTRIES) -> bytes:
    """Compact table of frequent pieces: ``length byte, piece, zero byte`` records.

    Chosen from the first ``sample_docs`` documents of one partition, so its size has a proven bound
    (``entries * (PIECE_BYTES + 2)`` bytes); a piece that it lacks is found by
    the second tier.
    """
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        seen = 0
        for b in batches:
            for t in b.column("t").to_pylist()[:sample_docs - seen]:
                n.update(p for p in pieces_of(t) if "\0" not in p and len(p.encode()) <= PIECE_BYTES)
            seen += b.num_rows
            if seen >= sample_docs:
                break
        pieces = Pieces(path, len, sum)
        rows = [(p, v) for p, c in n.most_common(entries) if c > 1 and (v := pieces.encode(p)) < 256]
        if rows:
            blob = b"".join(bytes([v]) + p.encode() + b"\0" for p, v in rows)
            yield pa.RecordBatch.from_pydict({"blob": pa.array([blob], pa.binary())})

    # limit(1).collect() runs one partition, and further ones only while none has had a piece
    found = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(top, "blob binary").limit(1).collect()
    return bytes(found[0].blob) if found else b""


def unpack(blob: bytes) -> dict[str, int]:
    return {r[1:].decode(): r[0] for r in _records(blob)}


def _records(blob: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(blob):
        end = blob.index(b"\0", at + 1)
        yield blob[at:end]
        at = end + 1


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``) beside the columns other than the text.

    One narrow pass: words and pieces of the broadcast table are summed at
    once, others are encoded by the worker and remembered.  Nothing is shuffled.  Null
    texts count as empty (0 bytes, 0 tokens); repeated rows are counted each;
    columns named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    table = frequent_lengths(docs, path, text)
    df = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("t"))
    row_type = df.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, len, sum, unpack(table), CACHE_ENTRIES)
        for b in batches:
            sizes, counts = [], []
            for t in b.column("t").to_pylist():
                t = t or ""
                sizes.append(len(t.encode()))
                counts.append(pieces.of(t))
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "n_bytes": pa.array(sizes, pa.int64()),
                                              "n_tokens": pa.array(counts, pa.int64())})

    out = df.mapInArrow(run, f"row {row_type}, n_bytes long, n_tokens long")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
