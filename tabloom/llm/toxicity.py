"""Toxicity by non-negative positive-unlabelled (PU) learning.

Confirmed toxic documents are the positives; a sample of all documents, toxic
ones among them, is the unlabelled set.  A linear classifier over hashed words
and word beginnings minimises the class-prior-corrected risk

    prior * R+(positives)  +  max(0, R-(unlabelled) - prior * R-(positives))

whose second part estimates the risk on the unseen negatives; where it falls
below zero, which only overfitting can do, the step is reversed.  Several
members train on shards of the samples, in parallel tasks, and their
probabilities are averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import materialize, release, utf8
from tabloom.llm.suffix_dedup import LEVEL, to_ipc
from tabloom.operators.selection import select_ranks
from tabloom.session import cut_lineage

BITS = 20                # hashed features: 2**BITS
HEADS = (4, 5, 6)        # lengths of word beginnings, in bytes
POSITIVES = 6_000        # toxic documents that are fitted at most, all members together
UNLABELLED = 18_000      # unlabelled documents that are fitted at most
MEMBERS = 3              # classifiers
CLEAN_REJECTED = 0.001   # share of the training fold's clean documents that a filter may reject
STEPS = 160
RATE = 0.1
SHRINK = 0.003           # proximal step of each weight towards zero
LEAST_POSITIVES = 4      # positives that must have a feature
CACHE = 150_000          # words whose features a worker keeps
ROWS = 2_500             # documents of a batch that are scored and sent back together

# bytes of words: ASCII letters (lower-cased), digits, and all of non-ASCII characters
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def hashed(token: bytes) -> int:
    return zlib.crc32(token) & ((1 << BITS) - 1)


def word_features(word: bytes) -> tuple[int, ...]:
    """Features of a word: itself, and its beginnings if it is longer."""
    return (hashed(b"=" + word), *(hashed(word[:k]) for k in HEADS if len(word) >= k))


class Features(dict):
    """Cache from a word to its features."""

    def __missing__(self, word: bytes):
        f = word_features(word)
        if len(self) < CACHE:
            self[word] = f
        return f

    def of(self, text: bytes) -> set[int]:
        """Distinct features of a text."""
        return set().union(*map(self.__getitem__, set(text.translate(_FOLD).split())))


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and bias of one classifier."""
    features = Features()
    rows = [np.fromiter(features.of(t), np.int32) for part in (positive, unlabelled) for t in part]
    features.clear()
    release()
    held = np.bincount(np.concatenate(rows[:len(positive)] or [np.zeros(0, np.int32)]), minlength=1 << BITS)
    used = np.flatnonzero(held >= min(LEAST_POSITIVES, max(1, len(positive) // 4)))
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    rows = [(c := place[r])[c >= 0] for r in rows]
    col = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_p = np.arange(len(rows)) < len(positive)
    place = None
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))        # logistic loss: gradient s - 1 for label 1, s for label 0
        loss_neg = np.logaddexp(0, z)
        negatives = loss_neg[~is_p].sum() / n_u - prior * loss_neg[is_p].sum() / n_p
        g = np.where(is_p, -prior * s / n_p, s / n_u)       # of the negatives' risk
        g = -g if negatives < 0 else g + np.where(is_p, prior * (s - 1) / n_p, 0)
        gw, gb = np.bincount(col, g[row], len(used)), g.sum()
        m, mb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb
        v, vb = 0.99 * v + 0.01 * gw ** 2, 0.99 * vb + 0.01 * gb ** 2
        c1, c2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w = w - RATE * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK, 0)
    return used[w != 0], w[w != 0], b


def train(docs: DataFrame, labels: DataFrame, text: str = "text", seed: int = 17) -> tuple[list, float]:
    """Members ``(features, weights, bias)`` and the class prior.

    ``labels``: ``doc_id`` and ``toxic`` of the rows that may be learnt from;
    of several rows for one document, a toxic one counts.  The prior is the
    share of toxic documents among them; the classifiers themselves see only
    the toxic ones' labels.  The samples have at most POSITIVES and UNLABELLED
    documents, whatever the size of the tables; only their ids are broadcast.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return [], 0.0
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    some = known.withColumn("u", draw).withColumn("p", (F.col("toxic") == 1).cast("int"))
    picked = (some.where((F.col("p") == 1) & (F.col("u") < 0.95 * POSITIVES / toxic)).select("doc_id", F.lit(1).alias("p"))
              .limit(POSITIVES)
              .unionByName(some.where(F.col("u") >= 1 - 0.95 * UNLABELLED / n).select("doc_id", F.lit(0).alias("p")).limit(UNLABELLED)))
    sample = (docs.select("doc_id", F.col(text).alias("text")).where("text is not null")
              .join(F.broadcast(picked), "doc_id"))
    shard = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(MEMBERS))
    prior = toxic / n

    def member(key, t):
        release()
        # a document counts once in each sample, however often its row is repeated
        _, once = np.unique(np.stack([t.column("doc_id").to_numpy(), t.column("p").to_numpy()], 1), axis=0, return_index=True)
        t = t.take(pa.array(once))
        p = t.column("p").to_numpy()
        texts = [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]
        f, w, b = fit([x for x, y in zip(texts, p) if y], [x for x, y in zip(texts, p) if not y], prior)
        texts.clear()
        release()
        return pa.table({"f": pa.array([f.tolist()], pa.list_(pa.int64())), "w": pa.array([w.tolist()], pa.list_(pa.float64())),
                         "b": pa.array([b], pa.float64())})

    rows = (sample.select(shard.alias("shard"), "doc_id", "p", "text").groupBy("shard")
            .applyInArrow(member, "f array<long>, w array<double>, b double").collect())
    return [(np.array(r.f, np.int64), np.array(r.w), r.b) for r in rows], prior


def with_score(docs: DataFrame, members: list, prior: float = 0.0, text: str = "text", column: str = "score",
               keep_text: bool = True) -> DataFrame:
    """The columns of ``docs`` and ``column``, the members' mean probability.

    A narrow pass over whole texts, each of which goes through Python once
    (and not back without ``keep_text``).  ``column`` replaces one of its name.
    """
    df, run, row_type, columns = scoring(docs, members, prior, text, column, keep_text)
    return df.mapInArrow(run, f"row {row_type}, {'text string, ' if keep_text else ''}score double").select(*columns)


def kept_scores(docs: DataFrame, members: list, prior: float = 0.0, text: str = "text", column: str = "score") -> tuple[DataFrame, DataFrame]:
    """:func:`with_score`, and only ``doc_id`` and ``column`` of it, both read from one pass that is kept.

    The pass is kept as packed batches in a checkpoint, which Spark can delete
    once neither frame is read any more.
    """
    df, run, row_type, columns = scoring(docs, members, prior, text, column)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_pydict({"blob": pa.array([to_ipc(b, LEVEL)], pa.binary())})

    def opened(*fields: int):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for blob in b.column("blob"):
                    yield from pa.ipc.open_stream(blob.as_buffer(), options=pa.ipc.IpcReadOptions(included_fields=list(fields)))
                release()
        return read

    blobs = cut_lineage(df.mapInArrow(pack, "blob binary"))
    return (blobs.mapInArrow(opened(0, 1, 2), f"row {row_type}, text string, score double").select(*columns),
            blobs.mapInArrow(opened(0, 2), f"row {row_type}, score double").select("row.doc_id", F.col("score").alias(column)))


def scoring(docs: DataFrame, members: list, prior: float, text: str, column: str, keep_text: bool = True):
    """What a scoring pass reads, its function of batches, the type of their ``row``, and the columns that they give."""
    kept = [c for c in docs.columns if c != column and (keep_text or c != text)]
    others = [c for c in kept if c != text]
    df = docs.select(F.struct(*others).alias("row") if others else F.lit(True).alias("row"), F.col(text).alias("text"))
    row_type = df.schema["row"].dataType.simpleString()
    weights = np.zeros((1 << BITS, max(len(members), 1)), np.float32)
    for k, (f, w, _) in enumerate(members):
        weights[f, k] = w
    used = np.flatnonzero(weights.any(axis=1))
    weights, bias = weights[used], np.array([b for *_, b in members])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = dict(zip(used.tolist(), range(len(used))))
        features = Relevant(place)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                out = []
                for t in utf8(b, "text"):
                    if not len(bias):
                        out.append(prior)
                        continue
                    own = features.of(t)
                    z = bias + (weights[list(own)].sum(axis=0) if own else 0.0)
                    out.append(float((1 / (1 + np.exp(-np.clip(z, -50, 50)))).mean()))
                back = {"text": b.column("text")} if keep_text else {}
                yield pa.RecordBatch.from_pydict({"row": b.column("row"), **back, "score": pa.array(out, pa.float64())})
            release()

    columns = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept]
    return df, run, row_type, [*columns, F.col("score").alias(column)]


def score(docs: DataFrame, members: list, prior: float = 0.0, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` (0 to 1, the members' mean probability) and ``predicted`` (1 if score >= 0.5).

    Null texts score as empty ones, by the bias alone; without a member every
    score is the prior.  Repeated rows score alike; columns with the new names
    are replaced.
    """
    out = with_score(docs.drop("predicted"), members, prior, text, keep_text=keep_text)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


class Relevant(Features):
    """Features that have a weight, by their place in the table."""

    def __init__(self, place: dict[int, int]):
        super().__init__()
        self.place = place

    def __missing__(self, word: bytes):
        f = tuple(self.place[x] for x in word_features(word) if x in self.place)
        if len(self) < CACHE:
            self[word] = f
        return f


def held_out(doc_id="doc_id"):
    """Documents that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def reject_threshold(scored: DataFrame, labels: DataFrame, column: str = "score") -> float:
    """The least score from which a filter rejects at most CLEAN_REJECTED of the clean documents.

    Too few documents to tell such a share never lower it below 0.5.

    ``labels`` as in :func:`train`; all their clean documents in ``scored``
    count, and only ids and scores are shuffled.  Of several rows of a document
    the highest score counts; null ids and labels do not, and without a clean
    document the threshold is 0.5.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    once = scored.groupBy("doc_id").agg(F.max(column).alias("score")).join(known.where("toxic = 0"), "doc_id").select("score")
    # the first that has to stay
    total, found = select_ranks(materialize(once, "clean_scores"), ["score"], lambda _, n: [n - 1 - int(CLEAN_REJECTED * n)] if n else [])
    if not total["score"]:
        return 0.5
    least = float(np.nextafter(next(iter(found["score"].values())), 2))
    return least if int(CLEAN_REJECTED * total["score"]) else max(0.5, least)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Scores by members trained on the labels outside the held-out fold, without the texts; ``held_out`` is false for a null id."""
    members, prior = train(docs, labels.where(~held_out()), text)
    out = score(docs, members, prior, text, keep_text=False)
    return out.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
