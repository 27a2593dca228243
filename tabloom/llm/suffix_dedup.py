"""Removal of byte passages that occur earlier, by a distributed sparse suffix array.

Suffixes start at *anchors*: in every string of ``width`` bytes, the position
whose ``GRAM`` leading bytes have the smallest hash.  The choice depends on
the string's bytes alone, so all occurrences of a string have their anchor at
the same place, and it is enough to sort the suffixes at anchors (about one
position in 43) with the bytes around them instead of the suffixes at every
position.

1. Map: anchors of each batch; strings that the batch holds twice are settled
   there, so a passage that a third of all documents share leaves each batch
   once.  The rest are range-partitioned by their leading bytes with sampled
   splitters.  A splitter is a whole leading string, so suffixes that can
   match never lie on both sides of a boundary; a leading string that fills
   more than a bucket is split window by window on the hash of the window.
2. Bucket: multikey quicksort by 8-byte characters, once over the bytes after
   the anchors and once over the bytes before them; common prefixes of
   neighbours say which windows are equal, and all but the first are removed.
3. Removed ranges meet their documents by document bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabloom.llm.common import parallel, release

GRAM = 16                    # leading bytes that place a suffix
CHUNK = 1 << 19              # bytes that the anchor search handles at once
PART_BYTES = 3 << 20         # text bytes of a batch's part, within which equal strings are settled at once
BUCKET_SUFFIXES = 100_000    # suffixes that a bucket is planned for
LEVEL = 4                    # zstd level of what holds text
SAMPLE_BYTES = 8 << 20       # text bytes of the sample that gives the splitters
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)   # odd, so it has an inverse modulo 2**64
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 .. n-1 of ``base`` modulo 2**64."""
    p = _powers.get(which)
    if p is None or len(p) < n:
        p = np.ones(1, _U)
        while len(p) < n:
            p = np.concatenate([p, p * (p[-1:] * base)])
        _powers[which] = p = p[:max(n, CHUNK + 2)].copy()
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Rolling:
    """Hash of any substring of a buffer."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_TABLE[raw] * _power("base", _BASE, n + 1)[:n])])
        self.back = _power("back", _INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(_U))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n])


def anchors(raw: np.ndarray, ends: np.ndarray, width: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, last window start) for all windows of ``width`` bytes inside a document.

    ``raw`` holds documents one after another; ``ends`` are their ends.
    """
    span = width - GRAM + 1
    n = len(raw) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = (rolling.grams(GRAM) & _U(0xFFFFFFFF00000000)) | np.arange(len(raw) - GRAM + 1, dtype=_U)
    size = 1
    while 2 * size <= span:      # minimum over a window of `span` positions, by doubling
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < span:
        h = np.minimum(h[:n], h[span - size:span - size + n])
    at = (h[:n] & _U(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int32)
    ok = ends - starts >= width
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, (ends - width + 1)[ok], -1)
    at = np.where(np.cumsum(inside[:n]) > 0, at, -1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    keep = at[first] >= 0
    return at[first][keep], first[keep], last[keep]


def contexts(raw: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes ``width - GRAM`` before to ``width`` after each anchor, and which of them its windows cover."""
    left = width - GRAM
    padded = np.concatenate([np.zeros(left, np.uint8), raw, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, left + width)[at]
    return rows, covered(at - first, last + width - at, width)


def covered(before: np.ndarray, after: np.ndarray, width: int) -> np.ndarray:
    col = np.arange(2 * width - GRAM) - (width - GRAM)
    return (col >= -before[:, None]) & (col < after[:, None])


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (n x m 8-byte characters) and the equal bytes of neighbours.

    Level by level: rows that agree so far form a group, a group is divided by
    its next character, and groups of one are done.  The second result has, for
    each place but the first, the number of leading bytes shared with the place
    before (0 for the first).
    """
    n, m = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    lcp = np.zeros(n, np.int64)
    open_ = np.arange(n)                     # places still in a group of several
    tied = np.zeros(n, bool)                 # agrees with the place before so far
    for d in range(m):
        if d:
            group = np.cumsum(~tied[open_])
            own = order[open_]
            own = own[np.lexsort((words[own, d], group))]
            order[open_] = own
        col = words[order[open_], d]
        again = np.zeros(len(open_), bool)
        if len(open_) > 1:
            joined = (tied[open_[1:]] | (d == 0)) & (open_[1:] == open_[:-1] + 1)
            diff = col[1:] ^ col[:-1]
            same = joined & (diff == 0)
            part = joined & (diff != 0)
            lcp[open_[1:][same]] += 8
            lcp[open_[1:][part]] += leading_zero_bytes(diff[part])
            again[1:] = same
        tied[open_] = again
        keep = again.copy()
        keep[:-1] |= again[1:]
        open_ = open_[keep]
        if not len(open_):
            break
    return order, lcp


def leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += x < _U(1 << (8 * (8 - k)))
    return out


def later_windows(rows: np.ndarray, before: np.ndarray, after: np.ndarray, rank: np.ndarray, width: int):
    """Windows equal to one of a smaller rank: row numbers and distances of the window's start before the anchor.

    ``rows`` has the bytes around the anchors (zero where not covered), row i
    has the windows that start ``width - after[i]`` to ``before[i]`` bytes
    before its anchor, and ``rank`` orders the rows (equal: the same place).
    """
    left = width - GRAM
    none = np.zeros(0, np.int64)
    right = _characters(rows[:, left:])
    order, lcp = multikey_sort(right)
    longest = np.empty(len(rows), np.int64)
    longest[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    alive = np.flatnonzero(longest >= np.maximum(GRAM, width - before))
    if len(alive) < 2:
        return none, none
    alive = alive[np.argsort(rank[alive], kind="stable")]
    rows, before, after, rank, right = rows[alive], before[alive], after[alive], rank[alive], right[alive]
    order, lcp = multikey_sort(right)
    r_max = np.empty(len(rows), np.int64)
    r_max[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    l_order, l_lcp = multikey_sort(_characters(rows[:, :left][:, ::-1]))
    l_max = np.empty(len(rows), np.int64)
    l_max[l_order] = np.maximum(l_lcp, np.concatenate([l_lcp[1:], [0]]))
    low = np.maximum(width - after, width - r_max)
    high = np.minimum(before, l_max)
    out_row, out_off = [], []
    r_class, l_class = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for o in range(max(0, int(low.min(initial=width))), int(high.max(initial=-1)) + 1):
        active = np.flatnonzero((low <= o) & (o <= high))
        if len(active) < 2:
            continue
        r_class[order] = np.cumsum(lcp < width - o)
        l_class[l_order] = np.cumsum(l_lcp < o) if o else 0
        key = r_class[active] * (len(rows) + 1) + l_class[active]
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = active[by[rank[active[by]] > rank[active[head]]]]
        out_row.append(alive[late])
        out_off.append(np.full(len(late), o))
    return (np.concatenate(out_row), np.concatenate(out_off)) if out_row else (none, none)


def _characters(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 8-byte characters."""
    n, m = rows.shape
    wide = np.zeros((n, -(-m // 8) * 8), np.uint8)
    wide[:, :m] = rows
    return wide.view(">u8").astype(_U)


def pack(level: int = 1, /, **columns: np.ndarray) -> bytes:
    """Arrays as one zstd-compressed blob."""
    batch = pa.RecordBatch.from_pydict({"v": pa.array([v.tobytes() for v in columns.values()], pa.large_binary())})
    return to_ipc(batch, level)


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    col = from_ipc(blob).column("v")
    return [np.frombuffer(col[i].as_py(), t) for i, t in enumerate(types)]


def to_ipc(batch: pa.RecordBatch, level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def slices(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each."""
    n = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), batch.num_rows]
    for s, e in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(s, e - s)


def doc_hash(texts: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=4).digest(), "little") for t in texts], np.uint32)


def doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U) * _BASE) % _U(n)).astype(np.int64)


def groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
        yield int(key[part[0]]), part


class Plan:
    """Splitters, and the leading strings that are split further (hash -> first bucket, number of buckets)."""

    def __init__(self, sample: np.ndarray, suffixes: int, least: int):
        self.n = max(least, -(-suffixes // BUCKET_SUFFIXES))
        keys = np.sort(sample.view(f"S{GRAM}").ravel())
        self.splitters = np.unique(keys[(np.arange(1, self.n) * len(keys)) // self.n]) if len(keys) else keys
        value, count = np.unique(keys, return_counts=True)
        each = suffixes / max(len(keys), 1)
        often = (count >= 8) & (count * each > BUCKET_SUFFIXES)
        self.heavy = value[often]
        self.parts = -(-(count[often] * each).astype(np.int64) // BUCKET_SUFFIXES) + 1
        self.base = self.n + np.concatenate([[0], np.cumsum(self.parts)])
        self.buckets = int(self.base[-1])


def sample_anchors(docs: DataFrame, text: str, total: int, width: int) -> np.ndarray:
    """Leading strings of the anchors of about SAMPLE_BYTES of documents, chosen at random."""
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, ends, _ in chunks([x or b"" for x in b.column("t").cast(pa.binary()).to_pylist()]):
                at, _, _ = anchors(raw, ends, width, Rolling(raw))
                if len(at):
                    rows = np.lib.stride_tricks.sliding_window_view(raw, GRAM)[at]
                    yield pa.RecordBatch.from_pydict({"k": pa.array([rows.tobytes()], pa.binary())})

    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    some = docs.select(F.col(text).alias("t"))
    some = some if share == 1.0 else some.sample(share, seed=7)
    got = [r.k for r in some.mapInArrow(lead, "k binary").toLocalIterator()]
    return np.frombuffer(b"".join(got), np.uint8).reshape(-1, GRAM)


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Documents joined to buffers of about CHUNK bytes: bytes, ends, number of the first document."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        yield (np.frombuffer(b"".join(texts[start:stop]), np.uint8),
               np.cumsum([len(t) for t in texts[start:stop]]).astype(np.int64), start)
        start = stop


def runs_of(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about ``size`` bytes together."""
    n = np.cumsum([len(t) for t in texts]) // size
    cuts = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(texts)]
    return zip(cuts[:-1], cuts[1:])


def batch_suffixes(texts: list[bytes], ids: np.ndarray, hashes: np.ndarray, plan: Plan, width: int):
    """Per chunk: the suffixes of a batch of documents that it can't settle itself, and the ranges that it can."""
    out, seen = [], []
    for raw, ends, start in chunks(texts):
        rolling = Rolling(raw)
        at, first, last = anchors(raw, ends, width, rolling)
        if not len(at):
            continue
        lead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)[at]).view(f"S{GRAM}").ravel()
        bucket = np.searchsorted(plan.splitters, lead, side="right")
        if len(plan.heavy):     # one row for each window of a heavy leading string
            which = np.searchsorted(plan.heavy, lead)
            hot = plan.heavy[np.minimum(which, len(plan.heavy) - 1)] == lead
            size = np.where(hot, last - first + 1, 1)
            pick = np.repeat(np.arange(len(at)), size)
            shift = np.arange(len(pick)) - np.repeat(np.cumsum(size) - size, size)
            at, hot, which, bucket = at[pick], hot[pick], which[pick], bucket[pick]
            first = first[pick] + shift
            last = np.where(hot, first, last[pick])
            part = (rolling.of(first, first + width) >> _U(20)) % np.where(hot, plan.parts[np.minimum(which, len(plan.heavy) - 1)], 1).astype(_U)
            bucket = np.where(hot, plan.base[np.minimum(which, len(plan.heavy) - 1)] + part.astype(np.int64), bucket)
        doc = np.searchsorted(ends, at, side="right")
        begin = np.concatenate([[0], ends[:-1]])[doc]
        same = rolling.of(first, last + width) ^ mix((at - first).astype(_U) + _U(1))
        out.append((at, first, last, bucket, doc + start, begin, same, raw))
    if not out:
        return
    cols = [np.concatenate([o[c] for o in out]) for c in range(7)]
    at, first, last, bucket, doc, begin, same = cols
    chunk = np.repeat(np.arange(len(out)), [len(o[0]) for o in out])
    # equal strings of the batch: only the first one goes on
    rank = np.lexsort((at - begin, hashes[doc], ids[doc]))
    by = rank[np.argsort(same[rank], kind="stable")]
    head = np.concatenate([[True], same[by][1:] != same[by][:-1]])
    lead_of = by[np.flatnonzero(head)][np.cumsum(head) - 1]
    late = ~head & ((ids[doc[by]] != ids[doc[lead_of]]) | (hashes[doc[by]] != hashes[doc[lead_of]])
                    | (at[by] - begin[by] != at[lead_of] - begin[lead_of]))
    drop = by[late]
    go = np.sort(by[head])
    seen = (doc[drop], first[drop] - begin[drop], last[drop] + width - begin[drop])
    rows, mask = [], []
    for c, o in enumerate(out):
        own = go[chunk[go] == c]
        r, m = contexts(o[7], at[own], first[own], last[own], width)
        rows.append(r)
        mask.append(m)
    yield (np.concatenate(rows), np.concatenate(mask), bucket[go], doc[go], (at - begin)[go],
           (at - first)[go], (last + width - at)[go], seen)


def removed_ranges(ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, base: int):
    """Rows (bucket, blob) of removed byte ranges by document bucket."""
    for b, own in groups(doc_bucket(ids, n)):
        yield base + b, pack(i=ids[own].astype("<i8"), h=hashes[own].astype("<u4"), s=start[own].astype("<i8"), e=end[own].astype("<i8"))


def union_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]


def remove_repeats(docs: DataFrame, width: int = 100, text: str = "text") -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts earlier.

    Earlier means a smaller ``doc_id``, or the same document and an earlier
    start; strings are judged on the input and may overlap, and no string spans
    two documents.  Columns: those of ``docs`` (the text as it was), ``kept``
    (binary: the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``
    (maximal removed runs); columns with those names are replaced.

    Null and empty texts, and texts under ``width`` bytes, keep everything.  A
    null doc_id counts as smaller than any other.  Rows with one doc_id and
    different texts are different documents in an order of their own (by a 32-bit
    hash of the text); of rows that are repeated with id and text, one counts as
    the first and the others as later copies.
    """
    kept = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    docs = docs.select(*kept)

    def result(b: pa.RecordBatch, rest: list[bytes], sizes: list[int], spans: list[int]) -> pa.Table:
        n_removed = [n - len(r) for n, r in zip(sizes, rest)]
        return pa.table({**{c: b.column(c) for c in kept}, "kept": pa.array(rest, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())})

    new = {"kept": T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in new.items()]])
    return removal(docs, width, text, result, schema)


def removal(docs: DataFrame, width: int, text: str, result, schema: T.StructType) -> DataFrame:
    """What ``result`` makes of each batch of rows, the bytes kept of its texts, their sizes before and their removed runs.

    It is called where the ranges meet the documents, so no further Python
    worker has to stand beside that one.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = parallel(docs)
    plan = Plan(sample_anchors(docs, text, total, width), total * 2 // (width - GRAM + 2), 4 * parts)
    n_docs = max(4 * parts, total // (8 << 20))
    row = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])

    def ids_of(batch) -> np.ndarray:
        return batch.column("doc_id").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)

    def texts_of(batch) -> list[bytes]:
        return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]

    def rows_of(pairs) -> pa.RecordBatch:
        pairs = list(pairs)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                           pa.array([p[1] for p in pairs], pa.binary())], schema=row)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, text, PART_BYTES)):
            release()
            texts, ids = texts_of(b), ids_of(b)
            hashes = doc_hash(texts)
            for rows, mask, bucket, doc, pos, before, after, seen in batch_suffixes(texts, ids, hashes, plan, width):
                yield rows_of(removed_ranges(ids[seen[0]], hashes[seen[0]], seen[1], seen[2], n_docs, plan.buckets))
                yield rows_of((k, pack(LEVEL, i=ids[doc[g]].astype("<i8"), h=hashes[doc[g]].astype("<u4"), p=pos[g].astype("<i8"),
                                       b=before[g].astype(np.uint8), a=after[g].astype(np.uint8), t=rows[g][mask[g]]))
                              for k, g in groups(bucket))

    def sort_bucket(key, t):
        release()
        if key[0].as_py() >= plan.buckets:
            return t
        cols = [unpack(x.as_py(), "<i8", "<u4", "<i8", "u1", "u1", "u1") for x in t.column("blob")]
        ids, hashes, pos, before, after, raw = (np.concatenate([c[k] for c in cols]) for k in range(6))
        before, after = before.astype(np.int64), after.astype(np.int64)
        rows = np.zeros((len(ids), 2 * width - GRAM), np.uint8)
        rows[covered(before, after, width)] = raw
        order = np.lexsort((pos, hashes, ids))
        new = np.concatenate([[True], (np.diff(ids[order]) != 0) | (hashes[order][1:] != hashes[order][:-1]) | (np.diff(pos[order]) != 0)])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(new)
        which, off = later_windows(rows, before, after, rank, width)
        start = pos[which] - off
        by = np.lexsort((start, which))
        which, start = which[by], start[by]
        cut = np.concatenate([[True], (np.diff(which) != 0) | (np.diff(start) != 1)]) if len(which) else np.zeros(0, bool)
        head = np.flatnonzero(cut)
        tail = np.concatenate([head[1:] - 1, [len(which) - 1]]) if len(head) else head
        out = rows_of(removed_ranges(ids[which[head]], hashes[which[head]], start[head], start[tail] + width, n_docs, plan.buckets))
        return pa.Table.from_batches([out])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows_of((plan.buckets + k, to_ipc(b.take(pa.array(g)), LEVEL)) for k, g in groups(doc_bucket(ids_of(b), n_docs)))

    def finish(key, t):
        gone: dict[tuple[int, int], list] = {}
        for x in t.filter(pc.equal(t.column("kind"), 1)).column("blob"):
            for i, h, s, e in zip(*(c.tolist() for c in unpack(x.as_py(), "<i8", "<u4", "<i8", "<i8"))):
                gone.setdefault((i, h), []).append((s, e))
        out = []
        repeated: set[tuple[int, int]] = set()
        for x in t.filter(pc.equal(t.column("kind"), 0)).column("blob"):
            b = from_ipc(x.as_py()).combine_chunks()
            texts = texts_of(b)
            kept_bytes, spans = [], []
            for k, raw in zip(zip(ids_of(b).tolist(), doc_hash(texts).tolist()), texts):
                ranges = np.array(gone.get(k, []), np.int64).reshape(-1, 2)
                if k in repeated and len(raw) >= width:
                    ranges = np.array([[0, len(raw)]], np.int64)
                repeated.add(k)
                s, e = union_of(ranges[:, 0], ranges[:, 1])
                at, rest = 0, []
                for a, z in zip(s.tolist(), e.tolist()):
                    rest.append(raw[at:a])
                    at = z
                rest.append(raw[at:])
                kept_bytes.append(b"".join(rest))
                spans.append(len(s))
            out.append(result(b, kept_bytes, [len(t) for t in texts], spans))
        return pa.concat_tables(out) if out else empty

    empty = to_arrow_schema(schema).empty_table()
    pair = "bucket long, blob binary"
    ranges = (docs.select("doc_id", text).mapInArrow(suffixes, pair)
              .groupBy("bucket").applyInArrow(sort_bucket, pair).withColumn("kind", F.lit(1)))
    whole = docs.mapInArrow(documents, pair).withColumn("kind", F.lit(0))
    return ranges.unionByName(whole).groupBy("bucket").applyInArrow(finish, schema)


def without_repeats(docs: DataFrame, width: int = 100, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with what :func:`remove_repeats` keeps as their text, all rows and columns else as they were.

    Bytes of a character that a removed run cuts off go with it; null texts
    stay null; a column ``n_chars`` follows the new text.
    """
    cols = docs.columns

    def result(b: pa.RecordBatch, rest: list[bytes], sizes: list[int], spans: list[int]) -> pa.Table:
        new = [r.decode("utf-8", "ignore") if there else None for r, there in zip(rest, b.column(text).is_valid().to_pylist())]
        return pa.table({c: pa.array(new, pa.string()) if c == text else b.column(c) for c in cols})

    out = removal(docs, width, text, result, docs.schema)
    if n_chars not in cols:
        return out
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))


def digest(result: DataFrame) -> DataFrame:
    """Contract columns of the registered query."""
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
