"""Exact top-k inner products by norm buckets with local pruning.

Candidates are sorted into buckets of similar length.  A query's threshold is
the k-th best score it is known to reach; against a bucket it becomes a cosine
threshold, ``threshold / (query length * longest vector in the bucket)``:

* above 1 the bucket holds nothing for the query;
* at or above ``COORDINATE_FROM`` candidates must lie within bounds on the
  query's largest coordinates (coordinate pruning);
* below, only candidates that are long enough are left (length pruning).

What remains is verified by its exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import materialize, parallel
from tabloom.llm.suffix_dedup import pack, unpack

BUCKET = 4096             # vectors of a bucket at most (partition permitting)
BLOCK = 1024              # queries of a block
COORDINATE_FROM = 0.9     # cosine threshold from which coordinate pruning pays
FOCUS = 4                 # coordinates that it looks at


def integer_vectors(vectors: DataFrame, vec: str, scale: int) -> DataFrame:
    """``(vec_id, v, norm)`` of the valid rows: components ``floor(scale * x)`` as longs."""
    x = F.transform(F.col(vec), lambda e: e.cast("double"))
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * scale).cast("long"))
    rows = vectors.where(F.col(vec).isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return (rows.select("vec_id", v.alias("v"))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))))


def blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows of each partition as blobs of at most ``size`` vectors: ``(block, blob, longest)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - n)
                kept.append(part)
                n += part.num_rows
                b = b.slice(part.num_rows)
                if n == size:
                    yield blob(kept)
                    kept, n = [], 0
        if n:
            yield blob(kept)

    def blob(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        v = t.column("v").chunk(0)
        width = np.diff(v.offsets.to_numpy())
        m = np.zeros((t.num_rows, int(width.max(initial=0))), np.int64)
        m[np.arange(m.shape[1]) < width[:, None]] = v.flatten().to_numpy()
        data = pack(i=t.column("vec_id").to_numpy(), u=t.column("uid").to_numpy(), v=m)
        return pa.RecordBatch.from_pydict({f"{prefix}_blob": pa.array([data], pa.binary()),
                                           f"{prefix}_longest": pa.array([float(t.column("norm").to_numpy().max())])})

    out = rows.select("vec_id", "uid", "v", "norm").mapInArrow(run, f"{prefix}_blob binary, {prefix}_longest double")
    return materialize(out.withColumn(f"{prefix}", F.monotonically_increasing_id()), prefix)


def read_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, uid, v = unpack(blob, "<i8", "<i8", "<i8")
    return ids, uid, v.reshape(len(ids), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices (missing components count as 0)."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def candidates(q: np.ndarray, p: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Which pairs the bucket's pruning leaves, query by query (queries x vectors)."""
    d = max(q.shape[1], p.shape[1])
    q = np.pad(q, ((0, 0), (0, d - q.shape[1]))).astype(np.float64)
    p = np.pad(p, ((0, 0), (0, d - p.shape[1]))).astype(np.float64)
    lq, lp = np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1)
    # a threshold of 0 or less prunes nothing; the small slack keeps rounding on the safe side
    cos = np.divide(threshold, lq * lp.max(initial=0), out=np.full(len(q), -1.0), where=(threshold > 0) & (lq * lp.max(initial=0) > 0))
    cos[(threshold > 0) & (lq * lp.max(initial=0) == 0)] = 2.0
    cos -= 1e-9
    out = np.ones((len(q), len(p)), bool)
    out[cos > 1] = False
    by_length = (cos <= 1) & (cos < COORDINATE_FROM) & (threshold > 0)
    out[by_length] = lp[None, :] * lq[by_length, None] >= threshold[by_length, None] * (1 - 1e-9)
    unit = np.divide(p, lp[:, None], out=np.zeros_like(p), where=lp[:, None] > 0)
    for i in np.flatnonzero((cos <= 1) & (cos >= COORDINATE_FROM)):
        x = q[i] / lq[i]
        wide = np.arccos(np.clip(cos[i], -1, 1))             # largest angle to the query
        for f in np.argsort(-np.abs(x))[:FOCUS]:
            angle = np.arccos(np.clip(x[f], -1, 1))
            out[i] &= ((unit[:, f] >= np.cos(min(np.pi, angle + wide)) - 1e-9)
                       & (unit[:, f] <= np.cos(max(0.0, angle - wide)) + 1e-9))
    return out


def best(q_blob: bytes, p_blob: bytes, threshold: np.ndarray, k: int):
    """The bucket's best ``k`` for each query among the scores that reach the threshold."""
    qi, qu, q = read_blob(q_blob)
    pi, pu, p = read_blob(p_blob)
    keep = candidates(q, p, threshold)
    left = keep.any(axis=1)
    found = []
    if left.any():
        score = products(q[left], p)
        order = np.argsort(pi, kind="stable")                # ties go to the smaller id
        for row, i in enumerate(np.flatnonzero(left)):
            s = score[row]
            ok = keep[i] & (s >= threshold[i]) & (pu != qu[i])
            n = int(ok.sum())
            if n > 4 * k:
                ok &= s >= np.partition(s[ok], n - k)[n - k]
            at = order[ok[order]]
            at = at[np.argsort(-s[at], kind="stable")[:k]]
            found.append((np.full(len(at), qi[i]), np.full(len(at), qu[i]), pi[at], s[at]))
    return [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4)]


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vec: str = "embedding") -> DataFrame:
    """For each query its ``k`` candidates of the highest integer product: ``query_id, rank, vec_id, score``.

    Components are ``floor(scale * x)``; queries are the vectors whose
    ``vec_id`` ``every`` divides, candidates all vectors but the query's own
    row.  Ties go to the smaller ``vec_id``.  Vectors that are null or hold a
    null or a component that is not finite, and rows without a ``vec_id``, take
    no part; vectors of different dimensions compare as if padded with zeros;
    an empty vector has products of 0.  Rows that repeat a ``vec_id`` are
    vectors of their own, each answered with its own ranks.
    """
    rows = materialize(integer_vectors(vectors, vec, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    count = rows.count()
    n = max(1, -(-count // BUCKET))
    buckets = blocks(rows.repartitionByRange(n, F.desc("norm"), "vec_id", "uid").sortWithinPartitions(F.desc("norm"), "vec_id"), BUCKET, "bucket")
    asked = rows.where(F.col("vec_id") % every == 0)
    query_blocks = blocks(asked.repartitionByRange(max(1, -(-count // (every * BLOCK))), "vec_id", "uid"), BLOCK, "query")
    # the buckets of the longest vectors give each query a score that its k-th best can't be below
    first = buckets.orderBy(F.desc("bucket_longest"), "bucket").limit(1)

    def lower_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, p in zip(b.column("query_blob").to_pylist(), b.column("bucket_blob").to_pylist()):
                qi, qu, qv = read_blob(q)
                _, pu, pv = read_blob(p)
                s = np.where(pu[None, :] == qu[:, None], np.iinfo(np.int64).min, products(qv, pv))
                if s.shape[1] > k:
                    low = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                else:
                    low = np.full(len(qi), np.iinfo(np.int64).min)
                out.append(pack(t=low))
            yield pa.RecordBatch.from_pydict({"query": b.column("query"), "low": pa.array(out, pa.binary())})

    # one bucket (at most BUCKET vectors) goes to every block of queries
    lows = materialize(query_blocks.crossJoin(F.broadcast(first.select("bucket_blob"))).mapInArrow(lower_bounds, "query long, low binary"), "lows")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, p, low in zip(*(b.column(c).to_pylist() for c in ("query_blob", "bucket_blob", "low"))):
                threshold = unpack(low, "<i8")[0].astype(np.float64)
                qi, qu, pi, s = best(q, p, threshold, k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(qi), "uid": pa.array(qu), "vec_id": pa.array(pi), "score": pa.array(s)})

    # every block of the stated queries meets every bucket: pairs of block numbers, dealt over all tasks
    pairs = query_blocks.select("query").crossJoin(buckets.select("bucket")).repartition(max(parallel(rows), 2), "query", "bucket")
    met = pairs.join(query_blocks, "query").join(lows, "query").join(buckets, "bucket")
    found = met.mapInArrow(verify, "query_id long, uid long, vec_id long, score long")
    by = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
