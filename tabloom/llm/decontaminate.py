"""Benchmark decontamination by Wu-Manber search of the test items' word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import utf8
from tabloom.llm.wu_manber import WuManber

# word bytes: ASCII letters (lower-cased) and digits, and every byte of a non-ASCII character
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))

SPANS = "array<struct<first:long,last:long>>"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def windows_of(text: bytes, n: int) -> list[bytes]:
    """Windows of ``n`` consecutive words; a shorter text, if it has words, is one window."""
    w = words_of(text)
    if not w:
        return []
    return [b" " + b" ".join(w[i:i + n]) + b" " for i in range(max(1, len(w) - n + 1))]


def window_blocks(items: DataFrame, n: int, block_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    """The items' distinct windows in blocks of at most about ``block_bytes`` bytes.

    Items stream to the driver partition by partition, so neither the driver
    nor a search stage ever holds more than one block of them at a time.
    """
    block: dict[bytes, list[str]] = {}
    size = 0
    for r in items.select(F.col("item_id").cast("string").alias("id"), "text").where("text is not null").toLocalIterator():
        for w in windows_of(r.text.encode(), n):
            own = block.setdefault(w, [])
            if r.id not in own:
                own.append(r.id)
                size += len(w) + len(r.id or "") + 16
        if size >= block_bytes:
            yield block
            block, size = {}, 0
    if block:
        yield block


def normalized(batch: pa.RecordBatch) -> tuple[list[bytes], pa.Array]:
    """Each text's words, one space around each, and their number."""
    norm, n = [], []
    for t in utf8(batch, "text"):
        w = words_of(t)
        norm.append(b" " + b" ".join(w) + b" ")
        n.append(len(w))
    return norm, pa.array(n, pa.int64())


def _search_block(block: dict[bytes, list[str]]):
    """A mapInArrow function that adds the block's hits to every row."""
    patterns = list(block)
    owners = [block[p] for p in patterns]
    lengths = [p.count(b" ") - 1 for p in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = WuManber(patterns)
        for batch in batches:
            norm, n = normalized(batch)
            starts = np.cumsum([0] + [len(x) + 1 for x in norm])
            buf = b"\n".join(norm)
            at, which = engine.search(buf)
            doc = np.searchsorted(starts, at, side="right") - 1
            spans = batch.column("hits").to_pylist()
            items = batch.column("items").to_pylist()
            order = np.argsort(doc, kind="stable")
            cuts = np.flatnonzero(np.diff(doc[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                d = int(doc[part[0]])
                gaps = np.cumsum(np.frombuffer(norm[d], np.uint8) == 32)
                first = gaps[at[part] - starts[d]] - 1
                spans[d] = merged([(s["first"], s["last"]) for s in spans[d]]
                                  + [(int(f), int(f) + lengths[w]) for f, w in zip(first, which[part])])
                items[d] = sorted({*items[d], *(o for w in set(which[part].tolist()) for o in owners[w] if o is not None)})
            out = {"row": batch.column("row"), "text": batch.column("text"), "n_words": n,
                   "hits": pa.array(spans, batch.schema.field("hits").type),
                   "items": pa.array(items, batch.schema.field("items").type)}
            yield pa.RecordBatch.from_pydict(out)
    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their number of words, where there is nothing to search for."""
    for b in batches:
        at = b.schema.get_field_index("n_words")
        yield b.set_column(at, b.schema.field(at), normalized(b)[1])


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Union of half-open word ranges, in order."""
    out: list[list[int]] = []
    for f, e in sorted(spans):
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([f, e])
    return [{"first": f, "last": e} for f, e in out]


def benchmark_hits(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text",
                   block_bytes: int = 8 << 20) -> DataFrame:
    """Every document's words that lie in a test item's window, and the items found.

    Adds ``n_words`` (long), ``hits`` (half-open word ranges, merged) and
    ``items`` (ids as strings, sorted) to the columns of ``docs``; columns of
    those names are replaced.  A window is ``n`` consecutive words of an item;
    an item with fewer words, but not none, is one window.

    The windows reach the executors in blocks of ``block_bytes``; each block is
    one pass of narrow tasks, so a test collection of any size works without a
    shuffle and without one large broadcast.  Null or empty texts have no words
    and no hits, null item ids count as hits but are not listed, repeated rows
    are searched like any others, and empty tables give no hits.
    """
    kept = [c for c in docs.columns if c not in (text, "n_words", "hits", "items")]
    df = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"), F.lit(None).cast("long").alias("n_words"),
                     F.array().cast(SPANS).alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = df.schema
    passes = [_search_block(block) for block in window_blocks(items.select("item_id", F.col("text")), n, block_bytes)]
    for search in passes or [_count]:       # a search counts the words as well: a pass of its own would need a worker of its own
        df = df.mapInArrow(search, schema)
    return df.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("text").alias(text), "n_words", "hits", "items")


def hit_words(hits="hits"):
    """Number of words covered by the merged ranges."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])


def digest(hits: DataFrame) -> DataFrame:
    """Contract columns of the registered query."""
    return hits.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"))


def sha_of(ids: list[str]) -> str:
    """The same digest in plain Python, for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
