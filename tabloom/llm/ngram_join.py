"""Jaccard self-join on word shingles with token-combination prefixes.

1. Documents are written once in *units* of a few MB; a unit's distinct
   shingles are counted across units by hash range, and every shingle gets a
   class by the number of sets that hold it.
2. A set's prefix is its first ``n - ceil(t n) + 1`` shingles, rarest class
   first: two sets that reach the threshold share one of them.  Shingles that
   one set holds are not indexed; those of the rare classes are indexed singly.
3. If a prefix reaches into the frequent class, it is extended to the whole
   set, which is cut into hash classes: two sets at the threshold differ in at
   most a third as many shingles as they have, fewer than the set's non-empty
   classes, so one class holds the same combination of shingles in both.  The
   combinations are indexed instead of the frequent shingles.
4. Candidates are verified exactly.  First every set of an index key meets the
   key's smallest set only; keys whose sets then still lie in several
   components meet across components, in blocks, screened by parity bitmaps
   whose differing bits bound the number of differing shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from tabloom.llm.common import apart, discard, materialize, parallel, release
from tabloom.llm.components import components
from tabloom.llm.suffix_dedup import doc_bucket, from_ipc, groups, mix, pack, runs_of, slices, to_ipc, unpack
from tabloom.session import cut_lineage

UNIT_BYTES = 2 << 20       # text bytes of a unit
ID_BITS = 40               # bits of a shingle's hash that are counted (collisions only change its class)
CLASS_FROM = (2, 4, 16, 64)   # smallest number of sets of classes 1, 2, ...; the last class is the frequent one
FREQUENT = len(CLASS_FROM)
BLOCK = 2048               # sets of one index key that meet in one block
MEET = 1 << 18             # pairs of a block that are compared at once
LONG_WORD = 64             # bytes; longer words are hashed one by one
_U = np.uint64
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of the documents' distinct shingles, sorted by document and hash."""
    parts = [(doc + s, h) for s, e in runs_of(texts) for doc, h in [_shingle_sets(texts[s:e], k)]]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, start and end of each word in them, and each text's number of words."""
    raw = np.frombuffer(b"\n".join([b"", *texts, bytes(8)]).lower(), np.uint8)
    space = _SPACE[raw[:len(raw) - 8]]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
    return raw, start, end, np.diff(np.searchsorted(start, bounds))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, by functions without known families of collisions.

    Words of up to LONG_WORD bytes advance together, eight bytes a step;
    ``raw`` goes on for eight bytes behind the last one.
    """
    size = end - start
    h = size.astype(_U)
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    at = np.flatnonzero(size <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        at = at[size[at] > done]
        if not len(at):
            break
        left = np.minimum(size[at] - done, 8).astype(_U)
        chunk = eight[start[at] + done].view("<u8").ravel() & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
        h[at] = scramble(h[at] * _U(0x9E3779B97F4A7C15) + chunk)
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxh3_64_intdigest(raw[start[i]:end[i]])
    return h


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one function of 64 bits in which each bit depends on all."""
    for _ in range(2):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a sequence of words that goes on with ``word``."""
    return mix(h * _U(0x9E3779B97F4A7C15) + word)


def _shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    raw, start, end, n = words_of(texts)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    word = word_hashes(raw, start, end)
    first = np.cumsum(n) - n
    size = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), size)
    i = np.repeat(first, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    every = np.full(max(len(word) - k + 1, 0), k, _U)       # the k words from each word on, across texts as well
    for j in range(k):
        every = chain(every, word[j:j + len(every)])
    h = np.empty(len(doc), _U)
    full = n[doc] >= k
    h[full] = every[i[full]]
    short = np.flatnonzero(~full)   # a text of fewer words is one shingle of them all
    long = n[doc[short]]
    own = long.astype(_U)
    for j in range(k - 1):
        at = np.flatnonzero(long > j)
        own[at] = chain(own[at], word[i[short[at]] + j])
    h[short] = own
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[new], h[new]


def set_ids(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each document's set."""
    n = np.bincount(doc, minlength=docs).astype(np.int64)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h * _U(0xD6E8FEB86659FD93)))])
    ends = np.cumsum(n)
    return n, mix(sums[ends] - sums[ends - n] + n.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def bitmap(h: np.ndarray) -> bytes:
    """Parity bitmap of a set: a power of two of at least two bits for each shingle."""
    bits = max(64, 1 << int(2 * len(h) - 1).bit_length())
    odd = np.bincount((h >> _U(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(raw: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap cut down to ``size`` bytes."""
    return np.bitwise_xor.reduce(raw.reshape(-1, size), axis=0)


def class_keys(h: np.ndarray, percent: int) -> tuple[np.ndarray, bool]:
    """Combination keys of a set in its two size classes, and whether they are enough.

    Sizes fall into classes by powers of ``100 / percent``; sets that can link
    are in the same class or in neighbouring ones, so a set joins in its own
    class and the one below.  Shingles are dealt to hash classes; a key is the
    combination that a class holds.  They are enough if more classes are
    occupied than shingles can differ.
    """
    n = len(h)
    ratio = max(100 / percent, 1.01)
    c = int(np.floor(np.log(n) / np.log(ratio) + 1e-9))
    out, enough = [], True
    for j in (c, c - 1):
        g = max(1, int(np.ceil(0.6 * ratio ** j)))
        cls = (mix(h + _U(j + 1)) % _U(g)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(cls[order]) != 0]))
        value = np.add.reduceat(mix(h[order] ^ _U(0x5851F42D4C957F2D)), cut)
        out.append(mix(value + (cls[order][cut].astype(_U) + _U((j + 1) << 40)) * _U(0x9E3779B97F4A7C15)))
        enough &= len(cut) > (100 - percent) * n // percent
    return np.concatenate(out), enough


def to_units(docs: DataFrame, k: int, text: str) -> DataFrame:
    """``(unit, blob)``: rows with their set's size ``n`` and fingerprint ``node``, in units of a few MB.

    A checkpoint, for it has all texts: Spark can delete it once no frame reads it any more.
    """
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text, UNIT_BYTES):
                texts = [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
                n, node = set_ids(*shingle_sets(texts, k), len(texts))
                part = pa.RecordBatch.from_arrays([*[part.column(c) for c in cols], pa.array(n), pa.array(node)],
                                                  [*cols, "n__", "node__"])
                yield pa.RecordBatch.from_pydict({"blob": pa.array([to_ipc(part)], pa.binary())})
            release()
    return cut_lineage(docs.mapInArrow(run, "blob binary").withColumn("unit", F.monotonically_increasing_id()))


def steps(ids: np.ndarray) -> np.ndarray:
    """First value and differences of sorted ids."""
    return np.concatenate([ids[:1], ids[1:] - ids[:-1]])


def planes(v: np.ndarray) -> np.ndarray:
    """Bytes of little-endian integers, plane by plane (sorted differences compress well so)."""
    return v.view(np.uint8).reshape(len(v), -1).T.copy()


def unplanes(raw: np.ndarray, dtype: str) -> np.ndarray:
    return raw.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def shingle_classes(units: DataFrame, k: int, text: str, ranges: int) -> DataFrame:
    """``(unit, part, blob)``: classes of the unit's distinct shingles of hash range ``part``, in hash order."""
    shift = _U(64 - (ranges - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, unit in zip(b.column("blob").to_pylist(), b.column("unit").to_pylist()):
                h = unit_shingles(blob, k, text)[2]
                value, held = np.unique(h, return_counts=True)
                part = (value >> shift).astype(np.int64)
                ids = (value >> _U(64 - ID_BITS)).astype("<u8")
                cuts = np.searchsorted(part, np.arange(ranges + 1))
                rows = [(p, pack(d=planes(steps(ids[s:e])), c=np.minimum(held[s:e], 255).astype(np.uint8)))
                        for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([r[0] for r in rows], pa.int64()), "unit": pa.array([unit] * len(rows), pa.int64()),
                    "blob": pa.array([r[1] for r in rows], pa.binary())})
                release()

    def classify(key, t):
        release()
        got = [unpack(x.as_py(), "u1", "u1") for x in t.column("blob")]
        ids = [np.cumsum(unplanes(g[0], "<u8")) for g in got]
        flat = np.concatenate(ids)
        order = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], np.diff(flat[order]) != 0])
        group = np.cumsum(new) - 1
        total = np.bincount(group, np.concatenate([g[1] for g in got])[order].astype(np.float64))
        cls = np.empty(len(flat), np.uint8)
        cls[order] = np.searchsorted(np.array(CLASS_FROM), total, side="right")[group]
        ends = np.cumsum([len(i) for i in ids])
        return pa.table({"unit": t.column("unit"), "part": t.column("part"),
                         "blob": pa.array([pack(c=cls[e - len(i):e]) for i, e in zip(ids, ends)], pa.binary())})

    return (units.mapInArrow(count, "part long, unit long, blob binary").groupBy("part")
            .applyInArrow(classify, "unit long, part long, blob binary"))


def unit_shingles(blob: bytes, k: int, text: str):
    """A unit's fingerprints and its sets' shingles; a set held by several documents of the unit counts once."""
    t = from_ipc(blob)
    node = t.column("node__").to_numpy()
    _, once = np.unique(node, return_index=True)
    texts = [x or b"" for x in t.column(text).cast(pa.binary()).take(pa.array(once)).to_pylist()]
    doc, h = shingle_sets(texts, k)
    return node[once], doc, h


def index_rows(units: DataFrame, chosen: DataFrame, classes: DataFrame, k: int, text: str, percent: int) -> DataFrame:
    """Index entries ``(node, n, key)`` and, with key null, each indexed set ``(node, n, bits, shingles)``.

    ``chosen``: (unit, node) of the one unit that speaks for each set.
    """
    def run(key, unit, side):
        release()
        node, doc, h = unit_shingles(unit.column("blob")[0].as_py(), k, text)
        side = side.sort_by("part")
        own = pc_not_null(side, "node").column("node").to_numpy()
        got = [unpack(x.as_py(), "u1")[0] for x in pc_not_null(side, "blob").column("blob")]
        rows: dict[str, list] = {c: [] for c in ("node", "n", "key", "bits", "shingles")}
        if not len(h):
            return index_table(rows)
        value, at = np.unique(h, return_inverse=True)
        cls = np.concatenate(got)[at].astype(np.int64)
        n = np.bincount(doc, minlength=len(node))
        order = np.lexsort((h, cls, doc))
        doc_s, cls_s, h_s = doc[order], cls[order], h[order]
        start = np.cumsum(n) - n
        place = np.arange(len(h)) - start[doc_s]
        prefix = n - -(-percent * n // 100) + 1
        inside = (place < prefix[doc_s]) & (cls_s > 0) & np.isin(node, own)[doc_s]
        for d, part in groups(doc_s[inside]):
            at = np.flatnonzero(inside)[part]
            whole = h[start[d]:start[d] + n[d]]
            rare = at[cls_s[at] < FREQUENT]
            keys = [h_s[rare]]
            if len(rare) < len(at):
                combined, enough = class_keys(whole, percent)
                keys.append(combined)
                if not enough:
                    keys.append(h_s[at[cls_s[at] >= FREQUENT]])
            keys = np.concatenate(keys).view(np.int64).tolist()
            m = len(keys) + 1
            rows["node"] += [int(node[d])] * m
            rows["n"] += [int(n[d])] * m
            rows["key"] += [*keys, None]
            rows["bits"] += [None] * (m - 1) + [bitmap(whole)]
            rows["shingles"] += [None] * (m - 1) + [whole.astype("<u8").tobytes()]
        return index_table(rows)

    side = classes.select("unit", "part", "blob", F.lit(None).cast("long").alias("node")).unionByName(
        chosen.select("unit", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("blob"), "node"))
    return (units.groupBy("unit").cogroup(side.groupBy("unit"))
            .applyInArrow(run, "node long, n long, key long, bits binary, shingles binary"))


def pc_not_null(t: pa.Table, c: str) -> pa.Table:
    return t.filter(t.column(c).is_valid())


def index_table(rows: dict[str, list]) -> pa.Table:
    return pa.table({c: pa.array(v, pa.binary() if c in ("bits", "shingles") else pa.int64()) for c, v in rows.items()})


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the threshold: bitmaps screen, shingles decide."""
    def screen(b: pa.RecordBatch) -> list[bool]:
        return [can_link(x, y, n, m, percent) for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")))]

    def decide(b: pa.RecordBatch) -> list[bool]:
        out = []
        for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return out

    def keep(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(test(b), pa.bool_()))
        return run

    for k, (test, value) in enumerate(((screen, "bits"), (decide, "shingles"))):
        a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col(value).alias("xa"))
        b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col(value).alias("xb"))
        pairs = (apart(pairs, "a", "b") if k else pairs).join(a, "a").join(b, "b").mapInArrow(keep(test), "a long, b long")
    return pairs


def can_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether sizes and bitmaps allow the threshold: shared s >= percent/(100+percent) (n+m)."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(fold(np.frombuffer(x, np.uint8), size) ^ fold(np.frombuffer(y, np.uint8), size)).sum())
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def residual_pairs(keys: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, written: list[str]) -> DataFrame:
    """Screened pairs that share an index key and lie in different components.

    A pair recurs under every key that it shares; the lists of pairs are merged
    as arrays, so that each pair becomes one row.  ``written`` gets the path of
    the table that the pairs are read from.
    """
    placed = keys.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    placed = materialize(placed, "placed", written)
    several = (placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c"))
               .where("lo < hi").select("key", F.ceil(F.col("c") / BLOCK).cast("long").alias("nb")))
    block = F.pmod(F.xxhash64("node"), F.col("nb"))
    rows = (placed.join(several, "key").withColumn("own", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .join(sets.select("node", "n", "bits"), "node"))
    merged = 2 * parallel(keys)
    deal = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(8 * parallel(keys)))

    def meet(key, t):
        run = np.unique(np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")], 1), axis=0, return_inverse=True)[1].ravel()
        node, label, n, own = (t.column(c).to_numpy() for c in ("node", "label", "n", "own"))
        lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
        bits = t.column("bits").to_pylist()
        name, first, local = np.unique(node, return_index=True, return_inverse=True)
        size, n_of = np.array([len(bits[i]) for i in first]), n[first]
        codes: list[np.ndarray] = []
        waiting, most = 0, 2 * MEET
        for _, g in groups(run):
            a = g[own[g] == lo[g[0]]]
            b = g[own[g] == hi[g[0]]]
            for rows_a in np.array_split(a, -(-len(a) * len(b) // MEET)) if len(b) and len(a) else []:
                ok = ((label[rows_a][:, None] != label[b]) & (100 * np.minimum(n[rows_a][:, None], n[b])
                                                              >= percent * np.maximum(n[rows_a][:, None], n[b])))
                i, j = np.nonzero(ok)
                x, y = local[rows_a[i]], local[b[j]]
                codes.append(np.minimum(x, y) * len(name) + np.maximum(x, y))
                waiting += len(i)
            if waiting > most:       # pairs recur under many keys
                codes, waiting = [np.unique(np.concatenate(codes))], 0
                most = min(max(len(codes[0]), 2 * MEET), 8 * MEET)
        pair = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        x, y = pair // len(name), pair % len(name)
        least = np.minimum(size[x], size[y])
        keep = np.zeros(len(pair), bool)
        for m in np.unique(least):
            some = np.flatnonzero(least == m)
            used = np.unique(np.concatenate([x[some], y[some]]))
            folded = np.stack([fold(np.frombuffer(bits[first[i]], np.uint8), int(m)) for i in used]).view("<u8")
            for part in np.array_split(some, -(-len(some) * int(m) // (1 << 23))):
                differ = np.bitwise_count(folded[np.searchsorted(used, x[part])] ^ folded[np.searchsorted(used, y[part])]).sum(1).astype(np.int64)
                both = n_of[x[part]] + n_of[y[part]]
                keep[part] = (100 + percent) * (both - differ) >= 2 * percent * both
        a, b = name[x[keep]], name[y[keep]]
        out = [(k, pack(a=a[g].astype("<i8"), b=b[g].astype("<i8"))) for k, g in groups(doc_bucket(a, merged))]
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int64()), "blob": pa.array([r[1] for r in out], pa.binary())})

    def once(key, t):
        got = [unpack(x.as_py(), "<i8", "<i8") for x in t.column("blob")]
        pair = np.unique(np.stack([np.concatenate([g[k] for g in got]) for k in (0, 1)], 1), axis=0)
        return pa.table({"a": pa.array(pair[:, 0]), "b": pa.array(pair[:, 1])})

    rows = rows.select(deal.alias("deal"), "key", "lo", "hi", "own", "node", "label", "n", "bits")
    return apart(rows.groupBy("deal").applyInArrow(meet, "bucket long, blob binary")
                 .groupBy("bucket").applyInArrow(once, "a long, b long"), "a", "b")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """``n_shingles`` and ``component_id`` beside the documents' other columns (the text left out).

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A
    document's set holds its distinct ``k``-word shingles; with fewer words,
    the whole sequence; null or empty texts have the empty set, which links
    with nothing.  Two documents link when ``100 * shared >= percent * union``;
    ``component_id`` is the smallest doc_id that links reach, the document
    itself included (null only where no document of the component has an id).

    Sets are known by a 64-bit fingerprint and 64-bit shingle hashes; documents
    of equal sets are one set from there on, whatever their number.  Repeated
    rows and ids are documents of their own.  Columns named like the new ones
    are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "n_shingles", "component_id")]
    _, grouped = grouped_members(docs.select(*kept, text), kept, k, percent, text)
    least = grouped.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(least, "node", "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id.

    Components are those of :func:`jaccard_components`.  Documents without a
    shingle all stay; of rows that repeat the smallest id one stays, and a
    document without an id stays only where its component has none with one.
    """
    units, grouped = grouped_members(docs, [], k, percent, text)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "unit", "at"))
    chosen = (grouped.where("n > 0").groupBy("node").agg(first.alias("f")).select("f.unit", "f.at")
              .unionByName(grouped.where("n = 0").select("unit", "at")))

    def pick(key, unit, places):
        t = from_ipc(unit.column("blob")[0].as_py()) if unit.num_rows else None
        return t.select(columns).take(places.column("at").sort()) if t is not None else empty

    columns, empty = docs.columns, to_arrow_schema(docs.schema).empty_table()
    return units.groupBy("unit").cogroup(chosen.groupBy("unit")).applyInArrow(pick, docs.schema)


def grouped_members(docs: DataFrame, kept: list[str], k: int, percent: int, text: str) -> tuple[DataFrame, DataFrame]:
    """The units, and every document with the label of its component as ``node``.

    Index and links are deleted as soon as the labels stand.
    """
    units = to_units(docs, k, text)
    passing: list[str] = []
    members = materialize(members_of(units, kept, docs), "members")
    chosen = members.where("n > 0").groupBy("node").agg(F.min("unit").alias("unit"))
    total = members.agg(F.sum("n")).first()[0] or 0
    ranges = max(64, 1 << int(total // 500_000).bit_length())
    classes = shingle_classes(units, k, text, ranges)
    index = materialize(index_rows(units, chosen, classes, k, text, percent), "index", passing)
    sets = index.where("key is null").select("node", "n", "bits", "shingles")
    keys = index.where("key is not null").select("key", "node")
    star = (keys.join(keys.groupBy("key").agg(F.min("node").alias("a")), "key").where("a != node")
            .select("a", F.col("node").alias("b")).distinct())
    edges = materialize(linked(star, sets, percent), "links", passing)
    labels = components(edges)
    more = materialize(linked(residual_pairs(keys, sets, labels, percent, passing), sets, percent), "links", passing)
    if more.limit(1).count():
        labels = components(edges.union(more))
    discard(docs.sparkSession, passing)
    grouped = members.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node")).drop("label")
    return units, grouped


def members_of(units: DataFrame, kept: list[str], docs: DataFrame) -> DataFrame:
    """``(row, doc_id, n, node, unit, at)`` of every document; ``row`` has the kept columns."""
    names = kept or ["doc_id"]
    row_type = docs.select(F.struct(*names).alias("row")).schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, unit in zip(b.column("blob").to_pylist(), b.column("unit").to_pylist()):
                t = from_ipc(blob).combine_chunks().to_batches()[0]
                row = pa.StructArray.from_arrays([t.column(c) for c in names], names)
                yield pa.RecordBatch.from_arrays(
                    [row, t.column("n__"), t.column("node__"), pa.array([unit] * t.num_rows, pa.int64()), pa.array(range(t.num_rows), pa.int64())],
                    ["row", "n", "node", "unit", "at"])
    out = units.mapInArrow(run, f"row {row_type}, n long, node long, unit long, at long")
    return out.withColumn("doc_id", F.col("row.doc_id"))
