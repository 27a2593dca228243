"""Periodic runs of words, by Baier grouping.

The first phase of Baier's suffix sorter groups suffixes by ever longer
contexts.  When a group's turn comes, from the highest to the lowest, its
context is the longest Lyndon word at which its suffixes start, so the phase
yields the Lyndon array without a suffix array.  Under an order of the words
and under its reverse, some Lyndon root of every run is among the two arrays'
words; each root is extended to both sides by longest common extensions.

A run that repeats three times holds no word that its text has less than three
times, so such words part a text into stretches and only long stretches go
through the grouping.  Documents do not depend on one another: one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import release

ROWS = 500           # documents of a batch that are handled together
PART_WORDS = 100_000   # words of stretches that are grouped together (a longer stretch alone)
PASSES = 8           # rounds of parting; more would only find more words that no run holds


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place.

    ``ranks``: the words' places in the order, from 0 without gaps.  Groups
    wait in a doubly linked list.  The highest takes its suffixes out of the
    text's list of open places; what each then meets on its left is the nearest
    place with a lower suffix.  Places met c times move to a new group directly
    above their own, the more often met the higher, and their context grows by
    c of this group's contexts.
    """
    n = len(ranks)
    k = max(ranks, default=-1) + 1
    members: list = [[] for _ in range(k)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    context = [1] * k
    below, above = list(range(-1, k - 1)), [*range(1, k), -1][:k]
    group = list(ranks)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    g = k - 1
    while g >= 0:
        size = context[g]
        met: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:          # moved on to a higher group
                continue
            out[i] = size
            p, q = left[i], right[i]
            if q < n:
                left[q] = p
            if p >= 0:
                right[p] = q
                met[p] = met.get(p, 0) + 1
        members[g] = ()
        for times in sorted(set(met.values()), reverse=True):
            fresh: dict[int, int] = {}
            for p, c in met.items():
                if c != times:
                    continue
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(context)
                    context.append(context[old] + c * size)
                    members.append([])
                    higher = above[old]
                    above.append(higher)
                    below.append(old)
                    above[old] = new
                    if higher >= 0:
                        below[higher] = new
                members[new].append(p)
                group[p] = new
        g = below[g]
    return out


class Extensions:
    """Longest common extensions over blocks of 1, 2, 4, ... words that are numbered by their content."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names = [ids.astype(np.int32)]
        size = 1
        while 2 * size <= longest:
            last = self.names[-1].astype(np.int64)
            pair = last[:-size] * (int(last.max()) + 1) + last[size:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from places a and b > a on."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            for _ in range(2 if k == len(self.names) - 1 else 1):      # the largest block may fit twice
                can = np.flatnonzero(b + out < len(name))
                out[can[name[a[can] + out[can]] == name[b[can] + out[can]]]] += 1 << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words up to places a and b > a."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, size = self.names[k], 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                can = np.flatnonzero(a - out - size + 1 >= 0)
                at = out[can] + size - 1
                out[can[name[a[can] - at] == name[b[can] - at]]] += size
        return out


def runs_of(ids: np.ndarray, longest: int, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs in ``ids`` of at least ``least`` words and ``times`` periods.

    ``longest`` bounds the length of a common extension.  Sorted by start, then period.
    """
    rank = np.unique(ids, return_inverse=True)[1]
    top = int(rank.max())
    at, period = [], []
    for order in (rank, top - rank):
        length = np.array(lyndon_array(order.tolist()))
        i = np.flatnonzero(length * times <= longest)
        at.append(i)
        period.append(length[i])
    i, p = np.concatenate(at), np.concatenate(period)
    fits = i + p < len(rank)
    i, p = i[fits], p[fits]
    ext = Extensions(rank, longest)
    ahead = ext.forward(i, i + p)
    # a run has a root among the places of its first period: that one alone is extended to the left
    near = ahead + 2 * p - 1 >= np.maximum(least, times * p)
    i, p, ahead = i[near], p[near], ahead[near]
    behind = ext.backward(i - 1, i + p - 1)
    found = np.stack([i - behind, behind + p + ahead, p], 1)
    return np.unique(found[found[:, 1] >= np.maximum(least, times * p)], axis=0)


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least ``least`` words outside which no run reaches."""
    done, open_ = [], [(0, len(ids))]
    for _ in range(PASSES):
        parted = []
        for a, b in open_:
            local = np.unique(ids[a:b], return_inverse=True)[1]
            often = np.bincount(local)[local] >= times
            if often.all():
                done.append((a, b))
                continue
            edge = np.diff(np.concatenate([[0], often.view(np.int8), [0]]))
            ends = np.flatnonzero(edge == -1)
            starts = np.flatnonzero(edge == 1)
            keep = ends - starts >= least
            parted += [(a + int(s), a + int(e)) for s, e in zip(starts[keep], ends[keep])]
        open_ = parted
        if not open_:
            break
    return done + open_


def numbered(words: list[bytes]) -> np.ndarray:
    own: dict[bytes, int] = {}
    return np.array([own.setdefault(w, len(own)) for w in words], np.int64)


def find_runs(texts: list[bytes], least: int, times: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs of each text, and the texts with single spaces between words and without the repetitions."""
    none = np.zeros((0, 3), np.int64)
    runs, collapsed = [none] * len(texts), []
    waiting: list[tuple[int, int, np.ndarray]] = []      # text, first word, ids

    def flush():
        if not waiting:
            return
        parts, starts, at = [], [], 0
        for _, _, ids in waiting:
            starts.append(at)
            parts += [ids, [-1 - len(starts)]]           # a word of its own after each stretch
            at += len(ids) + 1
        found = runs_of(np.concatenate(parts), max(len(x[2]) for x in waiting), least, times)
        own = np.searchsorted(starts, found[:, 0], "right") - 1
        for k in np.unique(own):
            t, first, _ = waiting[k]
            mine = found[own == k]
            mine[:, 0] += first - starts[k]
            runs[t] = np.concatenate([runs[t], mine])
        waiting.clear()

    for t, text in enumerate(texts):
        words = text.split()
        collapsed.append(b" ".join(words))
        if len(words) < least:
            continue
        ids = numbered(words)
        for a, b in stretches(ids, least, times):
            if waiting and sum(len(x[2]) for x in waiting) + b - a > PART_WORDS:
                flush()
            waiting.append((t, a, ids[a:b].copy()))
    flush()
    for t, found in enumerate(runs):
        if len(found):
            found = runs[t] = found[np.lexsort((found[:, 2], found[:, 0]))]
            words = collapsed[t].split()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 0] + found[:, 1], -1)
            gone = np.cumsum(edge)[:-1] > 0
            collapsed[t] = b" ".join([w for w, x in zip(words, gone.tolist()) if not x])
    return runs, collapsed


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``runs`` and ``collapsed`` beside the columns other than the text.

    ``runs``: (start, length, period) of every maximal stretch of words that
    repeats with a smallest period, of at least ``least`` words and ``times``
    periods, by start, then period; words lie between ASCII white space and
    count from 0.  ``collapsed``: the words that no run holds after its first
    period, one space between them.  Null, empty and blank texts have no runs
    and the empty collapsed text; repeated rows are handled each; columns named
    like the new ones are replaced.

    One narrow pass.  Memory: the batch's texts, and for a stretch of n words
    that all occur often about 4 log2(n) + 200 bytes a word.
    """
    if times < 2:
        raise ValueError("a run holds at least two periods")
    kept = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    df = docs.select(F.struct(*kept).alias("row") if kept else F.lit(True).alias("row"), F.col(text).alias("t"))
    row_type = df.schema["row"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                texts = [x or b"" for x in b.column("t").cast(pa.binary()).to_pylist()]
                runs, collapsed = find_runs(texts, least, times)
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(run_type))
                yield pa.RecordBatch.from_pydict({
                    "row": b.column("row"), "runs": pa.ListArray.from_arrays(pa.array(offsets), items),
                    "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})
            release()

    out = df.mapInArrow(run, f"row {row_type}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "runs", "collapsed")


def with_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A tenth of the documents, drawn by crc32 of the id, with their end replaced by a repetition.

    With h the crc32 of the decimal id, h % 10 = 0, g = floor(h / 10) and n > 0
    words: from word a = g % n on, word i becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)).  Other texts, and rows without an id,
    stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("__w")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    df = docs.withColumn("__w", F.when((F.pmod(h, F.lit(10)) == 0) & F.col(text).isNotNull(), words))
    df = df.withColumn("__a", F.when(n > 0, a)).withColumn("__p", F.when(n > 0, p))
    looped = F.transform("__w", lambda w, i: F.get("__w", F.when(i < F.col("__a"), i).otherwise(
        F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p"))).cast("int")))
    new = F.when(n > 0, F.array_join(looped, " ")).otherwise(F.col(text))
    return df.withColumn(text, new).select(*docs.columns)


def digest(runs: DataFrame) -> DataFrame:
    """Number of runs, the run with the greatest exponent, and digests of all runs and of the collapsed text."""
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                       lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    all_lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(all_lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
