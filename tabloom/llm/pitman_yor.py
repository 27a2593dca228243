"""Hierarchical Pitman-Yor bigram model, sampled in parallel and scored where the counts are.

Each previous word (context) has a restaurant; contexts are dealt by hash to
buckets, the restaurants of a bucket share a parent restaurant, and all
parents share the root, which seats every training token over a uniform base.

* Words go once to hash ranges, which count them over all training documents
  and send each bucket the counts of the words that it will meet.
* Tokens go to their context's bucket as (context, word, document, count),
  aggregated per batch of documents.  A bucket has everything that its
  restaurants need: it draws their seating by Gibbs sweeps - the customers of
  one word in one context are seated anew, one after another, given the tables
  of the rest and the parent's predictions, then the parent's own customers
  (the tables below it) given the root's - and averages the predictive
  probabilities after the burn-in.
* Each bucket adds up its tokens' scores by document; sums meet per batch.

A context with a large share of all tokens has its restaurant in one bucket
like any other, but its tokens are dealt by their words as well: its parts first
add up the counts of its words for the bucket, which draws the seating, and then
score their tokens with the probabilities that the bucket sends back.  So
neither the shares nor the session's partitions change a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import materialize, release
from tabloom.llm.suffix_dedup import Rolling, from_ipc, groups, mix, pack, runs_of, slices, to_ipc, unpack

UNIT_BYTES = 4 << 20           # text bytes of a unit of documents
BUCKET_TOKENS = 2_000_000      # tokens that a bucket is planned for
LEAST_BUCKETS = 32             # buckets of a small corpus (they are part of the model: contexts of a bucket share a parent)
SAMPLE_DOCS = 4_000            # documents whose contexts say which are split (it affects the layout only)
SWEEPS, BURN_IN = 4, 1         # Gibbs sweeps, and how many of them are not averaged
STRENGTH = (0.5, 5.0, 1.0)     # concentration of contexts, parents and the root
BASE_UNIT, SCORE_UNIT = 1e-10, 1e-7   # to which a bucket's sums for a document are rounded
SINGLE_STEPS = 32              # customers of a word that are seated singly; later ones in growing groups
_U = np.uint64
ID_BITS = 48
START, END = 1, 2              # ids of the start context and of the end token


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word id and context id of every token; each document ends with END."""
    parts = [(doc + s, word, context) for s, e in runs_of(texts) for doc, word, context in [_tokens_of(texts[s:e])]]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), n + 1)
    last = np.cumsum(n + 1) - 1
    word = np.full(len(doc), END, np.int64)
    raw = np.frombuffer(b" ".join(b" ".join(w) for w in words if w), np.uint8)
    if len(raw):
        gaps = np.flatnonzero(raw == 32)
        start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        inner = np.ones(len(doc), bool)
        inner[last] = False
        word[inner] = (Rolling(raw).of(start, end) >> _U(64 - ID_BITS)).astype(np.int64)
    context = np.concatenate([[START], word[:-1]]) if len(word) else word
    context[last[:-1] + 1] = START
    return doc, word, context


class Layout:
    """Buckets of contexts; ``split`` maps a context with a large share to its number of parts.

    Parts lie in groups of their own, ``buckets`` to ``2 * buckets - 1``.
    """

    def __init__(self, buckets: int, split: dict[int, int]):
        self.buckets = buckets
        self.contexts = np.array(sorted(split), np.int64)
        self.parts = np.array([split[c] for c in sorted(split)], np.int64)

    def home(self, context: np.ndarray) -> np.ndarray:
        """Bucket of a context's restaurant."""
        return (mix(context.view(_U) * _U(0x9E3779B97F4A7C15)) % _U(self.buckets)).astype(np.int64)

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Group of a token: its context's bucket, or the group of a split context's part."""
        out = self.home(context)
        if len(self.contexts):
            k = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            part = mix(word.view(_U) * _U(0xD6E8FEB86659FD93)) % self.parts[k].astype(_U)
            h = mix(mix(context.view(_U) * _U(0x9E3779B97F4A7C15)) + part) % _U(self.buckets)
            out = np.where(self.contexts[k] == context, h.astype(np.int64) + self.buckets, out)
        return out


def planes(v: np.ndarray) -> np.ndarray:
    """Bytes of integers, plane by plane (small numbers and sorted differences compress well so)."""
    return v.view(np.uint8).reshape(len(v), -1).T.copy()


def unplanes(raw: np.ndarray, dtype: str) -> np.ndarray:
    return raw.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def squeeze(ids: np.ndarray) -> np.ndarray:
    """Sorted ids as planes of differences."""
    return planes(np.concatenate([ids[:1], ids[1:] - ids[:-1]]).astype("<i8"))


def unsqueeze(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(unplanes(raw, "<i8"))


def fixed(logs: np.ndarray, unit: float) -> np.ndarray:
    """Negative sums of logarithms as planes of whole multiples of ``unit``."""
    return planes(np.rint(-logs / unit).astype("<i8"))


def layout_of(docs: DataFrame, text: str, total: int, buckets: int) -> Layout:
    """Splits contexts that hold more than half a bucket of a bounded sample of documents."""
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, context = tokens_of([x or b"" for x in b.column("t").cast(pa.binary()).to_pylist()])
            c, n = np.unique(context, return_counts=True)
            often = n * 4 * buckets > len(context)
            yield pa.RecordBatch.from_pydict({"c": pa.array(c[often]), "n": pa.array(n[often].astype(np.int64)),
                                              "all": pa.array([len(context)] * int(often.sum()), pa.int64())})

    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    some = docs.select(F.col(text).alias("t"))
    some = some if share == 1.0 else some.sample(share, seed=5)
    got = (some.mapInArrow(top, "c long, n long, all long").groupBy("c").agg((F.sum("n") / F.sum("all")).alias("share"))
           .where(F.col("share") > 0.5 / buckets).orderBy(F.desc("share")).limit(2 * buckets).collect())
    return Layout(buckets, {r.c: int(np.ceil(2 * buckets * r.share)) for r in got})


def types_of(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each (context, word), in their order, and the type of every entry."""
    order = np.lexsort((word, context))
    head = np.concatenate([[True], (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(head) - 1
    return order[head], of


def word_counts(docs: DataFrame, text: str, layout: Layout, ranges: int, trained) -> DataFrame:
    """Counts of all words over the training documents.

    Rows: ``(bucket, blob)`` with the words that a bucket meets (``v`` 0) or
    with the counts of a part of split contexts (``v`` is the part's group);
    bucket -1 with sums in ``n`` (tokens), ``v`` (distinct words), ``n1`` and
    ``n2`` (words counted once and twice); bucket -2 with the count ``n`` of
    split context ``v``.
    """
    shift = _U(ID_BITS - (ranges - 1).bit_length())
    split = layout.contexts

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "t", UNIT_BYTES):
                train = part.column("train").to_numpy(zero_copy_only=False)
                doc, word, context = tokens_of([x or b"" for x in part.column("t").cast(pa.binary()).to_pylist()])
                bucket = layout.home(context)
                value, at = np.unique(word, return_inverse=True)
                count = np.bincount(at, train[doc], minlength=len(value)).astype("<u4")
                order = np.lexsort((bucket, at))
                pair = np.stack([at[order], bucket[order]])
                new = np.concatenate([[True], (np.diff(pair) != 0).any(axis=0)])
                pair = pair[:, new]
                where = np.bincount(pair[0], minlength=len(value)).astype("<u4")
                first = np.concatenate([[0], np.cumsum(where)]).astype(np.int64)
                key = (value.view(_U) >> shift).astype(np.int64)
                cuts = np.searchsorted(key, np.arange(ranges + 1))
                rows = [(r, pack(w=squeeze(value[s:e]), c=planes(count[s:e]), k=planes(where[s:e]),
                                 b=planes(pair[1][first[s]:first[e]].astype("<u4"))))
                        for r, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
                if len(split):
                    group = layout.of(context, word)
                    own = np.flatnonzero(group >= layout.buckets)
                    for g, at_group in groups(group[own]):
                        i = own[at_group]
                        rows.append((ranges + g, pack_types(context[i], word[i], train[doc[i]].astype(np.int64))))
                yield pa.RecordBatch.from_pydict({"range": pa.array([r[0] for r in rows], pa.int64()),
                                                  "blob": pa.array([r[1] for r in rows], pa.binary())})
            release()

    def count_types(group, t):
        parts = [read_types(x.as_py()) for x in t.column("blob")]
        context, word, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
        home = layout.home(context)
        rows = [(h, pack_types(context[own], word[own], times[own]), 0, group, 0, 0)
                for h in np.unique(home) for own in [home == h]]
        return table_of(rows)

    def table_of(rows):
        return pa.table({c: pa.array([r[i] for r in rows], pa.binary() if c == "blob" else pa.int64())
                         for i, c in enumerate(("bucket", "blob", "n", "v", "n1", "n2"))})

    def count(key, t):
        release()
        if key[0].as_py() >= ranges:
            return count_types(key[0].as_py() - ranges, t)
        got = [unpack(x.as_py(), "u1", "u1", "u1", "u1") for x in t.column("blob")]
        words = [unsqueeze(g[0]) for g in got]
        value, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate([unplanes(g[1], "<u4") for g in got]), minlength=len(value)).astype(np.int64)
        used = np.repeat(at, np.concatenate([unplanes(g[2], "<u4") for g in got]))
        bucket = np.concatenate([unplanes(g[3], "<u4") for g in got]).astype(np.int64)
        order = np.lexsort((used, bucket))
        used, bucket = used[order], bucket[order]
        new = np.concatenate([[True], (np.diff(used) != 0) | (np.diff(bucket) != 0)])
        used, bucket = used[new], bucket[new]
        rows = [(-1, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()))]
        hot = np.flatnonzero(np.isin(value, split) | (value == END))
        rows += [(-2, None, int(total[i]), int(value[i]), 0, 0) for i in hot]
        rows += [(k, pack(w=squeeze(value[used[g]]), c=planes(total[used[g]].astype("<u8"))), 0, 0, 0, 0) for k, g in groups(bucket)]
        return table_of(rows)

    df = docs.select(F.col(text).alias("t"), trained.alias("train"))
    return (df.mapInArrow(vocabulary, "range long, blob binary").groupBy("range")
            .applyInArrow(count, "bucket long, blob binary, n long, v long, n1 long, n2 long"))


def discount(once: float, twice: float) -> float:
    """Discount from the numbers of types seen once and twice."""
    return float(np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.95))


def seat(customers: np.ndarray, weight: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables that each group of customers takes when seated one after another.

    ``weight`` is the mass of a new table that serves the group's word; a
    customer joins the group's tables with mass (customers - d * tables).
    """
    order = np.argsort(-customers, kind="stable")
    c, q, t = customers[order], weight[order], np.ones(len(order))
    t[c == 0] = 0
    i = 1
    while True:
        m = np.searchsorted(-c, -i, side="left")      # groups with more than i customers
        if not m:
            break
        step = 1 if i < SINGLE_STEPS else i // 8
        p = q[:m] / (q[:m] + i - d * t[:m])
        if step == 1:
            t[:m] += rng.random(m) < p
        else:
            t[:m] += rng.binomial(np.minimum(step, (c[:m] - i)).astype(np.int64), np.minimum(p, 1))
        i += step
    out = np.empty(len(order))
    out[order] = t
    return out


class Restaurants:
    """The restaurants of a bucket: its (context, word) types, their counts, and the model's totals.

    A bucket has whole restaurants; ``split`` is the exact count of a type's
    context where that was dealt in parts, and -1 elsewhere.
    """

    def __init__(self, context, word, count, overall, split, totals):
        self.c = count.astype(np.float64)
        self.ctx = np.unique(context, return_inverse=True)[1]
        self.in_context = np.bincount(self.ctx, self.c)[self.ctx] if len(self.c) else self.c
        if ((split >= 0) & (split != self.in_context)).any():
            raise RuntimeError("the parts of a split context don't add up to its count")
        self.w = np.unique(word, return_inverse=True)[1]
        n, v, n1, n2 = totals
        d0, s0 = discount(n1, n2), STRENGTH[2]
        per_word = np.zeros(self.w.max(initial=-1) + 1)
        per_word[self.w] = overall
        seen = per_word > 0
        self.root = (np.where(seen, per_word - d0, 0) + (s0 + d0 * v) / (v + 1)) / (n + s0)

    def predict(self, rng, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> np.ndarray:
        """Predictive probability of each type's word in its context, averaged over sampled seatings."""
        d1 = discount((self.c == 1).sum(), (self.c == 2).sum())
        s1, s2, _ = STRENGTH
        tables = np.minimum(self.c, 1.0)
        parent = self.root
        total = np.zeros(len(self.c))
        for k in range(sweeps):
            in_ctx = np.bincount(self.ctx, tables)[self.ctx] if len(self.c) else tables
            tables = seat(self.c, (s1 + d1 * in_ctx) * parent[self.w], d1, rng)
            sent = np.bincount(self.w, tables, minlength=len(self.root))
            d2 = discount((sent == 1).sum(), (sent == 2).sum())
            up = seat(sent, (s2 + d2 * (sent > 0).sum()) * self.root, d2, rng)
            parent = (sent - d2 * up + (s2 + d2 * up.sum()) * self.root) / (s2 + sent.sum())
            if k >= burn_in:
                in_ctx = np.bincount(self.ctx, tables)[self.ctx] if len(self.c) else tables
                total += (self.c - d1 * tables + (s1 + d1 * in_ctx) * parent[self.w]) / (s1 + self.in_context)
        return total / (sweeps - burn_in)


def score_documents(docs: DataFrame, trained, text: str = "text") -> DataFrame:
    """Scores every document by the model learnt from those where ``trained`` (a boolean column) holds.

    Words are runs of anything but ASCII white space, A-Z lower-cased; each
    text ends with one end token.  Adds to the documents' other columns (the
    text left out): ``n_tokens``, ``n_known`` (tokens whose word training has),
    ``train_tokens``, ``base_score`` (add-one unigram log10 probability) and
    ``score`` (the model's).  Columns with those names are replaced.

    Null texts count as empty ones (the end alone), repeated rows are documents
    of their own, and a null ``trained`` counts as false.  Without training
    documents every probability is the uniform base.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c != text and c not in new]
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        # rows are read more than once, and those of a shuffle may come in another order each time
        docs, trained = materialize(docs.withColumn("train_tokens", trained), "documents"), F.col("train_tokens")
    trained = F.coalesce(trained, F.lit(False))
    size, rows = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    estimate = int((size or 0) / 6 + rows)
    buckets = max(LEAST_BUCKETS, -(-estimate // BUCKET_TOKENS))
    layout = layout_of(docs, text, rows, buckets)
    counts = materialize(word_counts(docs, text, layout, max(16, 1 << int(estimate // 2_000_000).bit_length()), trained), "words")
    n, v, n1, n2 = (x or 0 for x in counts.where("bucket = -1").agg(*[F.sum(c) for c in ("n", "v", "n1", "n2")]).first())
    split = {r.v: r.n for r in counts.where("bucket = -2").select("v", "n").collect()}
    split |= {START: split.get(END, 0)} if START in layout.contexts else {}
    split_ids = np.array(sorted(split), np.int64)
    split_count = np.array([split[c] for c in sorted(split)], np.float64)

    def units(batches: Iterator[pa.RecordBatch], parts: bool = False) -> Iterator[pa.RecordBatch]:
        """Units' tokens by bucket, and their rows; or, with ``parts``, their tokens by group of split contexts."""
        serial = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in slices(b, "t", UNIT_BYTES):
                train = part.column("train").to_numpy(zero_copy_only=False)
                part = part.take(pa.array(np.argsort(~train, kind="stable")))     # training documents first
                doc, word, context = tokens_of([x or b"" for x in part.column("t").cast(pa.binary()).to_pylist()])
                bucket = layout.of(context, word)
                n_tokens = np.bincount(doc, minlength=part.num_rows)
                order = np.flatnonzero((bucket >= layout.buckets) == parts)
                order = order[np.lexsort((doc[order], word[order], context[order], bucket[order]))]
                doc, word, context, bucket = doc[order], word[order], context[order], bucket[order]
                change = np.stack([bucket[1:] != bucket[:-1], context[1:] != context[:-1], word[1:] != word[:-1], doc[1:] != doc[:-1]])
                at = np.flatnonzero(np.concatenate([[True], change.any(axis=0)])) if len(doc) else np.zeros(0, np.int64)
                times = np.diff(np.append(at, len(doc)))
                doc, word, context, bucket = doc[at], word[at], context[at], bucket[at]
                out = [] if parts else [
                    (2 * layout.buckets + serial % layout.buckets,
                     to_ipc(pa.RecordBatch.from_arrays([part.column("row"), pa.array(n_tokens.astype(np.int64))], ["row", "n"])))]
                cuts = np.searchsorted(bucket, np.arange(2 * layout.buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[k], cuts[k + 1])
                    out.append((int(k), unit_blob(context[own], word[own], doc[own], times[own], int(train.sum()))))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([o[0] for o in out], pa.int64()),
                                                  "unit": pa.array([serial] * len(out), pa.int64()),
                                                  "blob": pa.array([o[1] for o in out], pa.binary())})
                serial += 1
            release()

    def sample(key, t):
        release()
        bucket = key[0].as_py()
        if bucket >= 2 * layout.buckets:
            return t.select(["unit", "blob"]).append_column("kind", pa.array([1] * t.num_rows, pa.int64()))
        ids = t.column("unit").to_numpy()
        blobs = [x.as_py() for x in t.column("blob")]
        known = [unpack(b, "u1", "u1") for b, i in zip(blobs, ids) if i == -1]
        vocabulary = np.concatenate([unsqueeze(k[0]) for k in known])
        vocabulary_count = np.concatenate([unplanes(k[1], "<u8") for k in known]).astype(np.int64)
        order = np.argsort(vocabulary)
        vocabulary, vocabulary_count = vocabulary[order], vocabulary_count[order]
        unit_ids = [int(i) for i in ids if i >= 0]
        parts = [read_unit_blob(b) for b, i in zip(blobs, ids) if i >= 0]
        groups_of = [-2 - int(i) for i in ids if i < -1]
        shares = [read_types(b) for b, i in zip(blobs, ids) if i < -1]
        if not parts and not shares:
            return pa.table({"unit": pa.array([], pa.int64()), "blob": pa.array([], pa.binary()), "kind": pa.array([], pa.int64())})
        context, word, trained_count = (np.concatenate([p[k] for p in parts + shares]) for k in range(3))
        parts, sizes = [p[3:] for p in parts], [len(p[0]) for p in shares]
        first, type_of = types_of(context, word)
        count = np.bincount(type_of, trained_count)
        context, word = context[first], word[first]
        overall = vocabulary_count[np.searchsorted(vocabulary, word)]
        given = np.full(len(context), -1.0)
        if len(split_ids):
            k = np.minimum(np.searchsorted(split_ids, context), len(split_ids) - 1)
            given = np.where(split_ids[k] == context, split_count[k], -1.0)
        model = Restaurants(context, word, count, overall, given, (n, v, n1, n2))
        score = np.log10(model.predict(np.random.default_rng(bucket)))
        base = np.log10((overall + 1) / (n + v + 1))
        out = unit_sums(unit_ids, parts, type_of, (overall > 0, base, score))
        start = len(type_of) - sum(sizes)
        kinds = [0] * len(out)
        for group, size in zip(groups_of, sizes):
            own = type_of[start:start + size]
            start += size
            out.append((group, pack(t=np.frombuffer(pack_types(context[own], word[own], (overall[own] > 0).astype(np.int64)), "u1"),
                                    b=base[own], s=score[own])))
            kinds.append(2)
        return pa.table({"unit": pa.array([o[0] for o in out], pa.int64()), "blob": pa.array([o[1] for o in out], pa.binary()),
                         "kind": pa.array(kinds, pa.int64())})

    def score_parts(key, t):
        """Sums of the tokens of split contexts, by the probabilities from their buckets."""
        release()
        ids = t.column("unit").to_numpy()
        blobs = [x.as_py() for x in t.column("blob")]
        given = [unpack(b, "u1", "<f8", "<f8") for b, i in zip(blobs, ids) if i < 0]
        tables = [read_types(g[0].tobytes()) for g in given]
        unit_ids = [int(i) for i in ids if i >= 0]
        parts = [read_unit_blob(b) for b, i in zip(blobs, ids) if i >= 0]
        context, word = (np.concatenate([p[k] for p in tables + parts]) for k in range(2))
        known, base, score = (np.concatenate(x) for x in ([p[2] for p in tables], [g[1] for g in given], [g[2] for g in given]))
        first, type_of = types_of(context, word)
        if (first >= len(known)).any():
            raise RuntimeError("a word of a split context has no probability")
        out = unit_sums(unit_ids, [p[3:] for p in parts], type_of[len(known):], (known[first], base[first], score[first]))
        return pa.table({"unit": pa.array([o[0] for o in out], pa.int64()), "blob": pa.array([o[1] for o in out], pa.binary()),
                         "kind": pa.array([0] * len(out), pa.int64())})

    def add_up(key, t):
        kind = t.column("kind").to_numpy()
        blobs = [x.as_py() for x in t.column("blob")]
        rows = from_ipc(next(b for b, k in zip(blobs, kind) if k == 1)).combine_chunks()
        sums = np.zeros((3, rows.num_rows))
        for b, k in zip(blobs, kind):
            if k == 0:
                d, known, base, score = unpack(b, "u1", "u1", "u1", "u1")
                d = unsqueeze(d)
                sums[0, d] += unplanes(known, "<u4")
                sums[1, d] -= unplanes(base, "<i8") * BASE_UNIT
                sums[2, d] -= unplanes(score, "<i8") * SCORE_UNIT
        return pa.table({"row": rows.column("row"), "n_tokens": rows.column("n"), "n_known": pa.array(sums[0].astype(np.int64)),
                         "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    df = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("t"), trained.alias("train"))
    row_type = df.schema["row"].dataType.simpleString()
    tokens = df.mapInArrow(units, "bucket long, unit long, blob binary")
    # unit -1: words and their counts; below that: the counts of a group of parts
    known = counts.where("bucket >= 0").select("bucket", (-F.col("v") - F.when(F.col("v") > 0, 2).otherwise(1)).alias("unit"), "blob")
    sums = tokens.unionByName(known).groupBy("bucket").applyInArrow(sample, "unit long, blob binary, kind long")
    if len(layout.contexts):
        sums = materialize(sums, "sums")
        shares = df.mapInArrow(lambda batches: units(batches, True), "bucket long, unit long, blob binary")
        given = sums.where("kind = 2").select(F.col("unit").alias("bucket"), F.lit(-1).cast("long").alias("unit"), "blob")
        sums = sums.where("kind < 2").unionByName(
            shares.unionByName(given).groupBy("bucket").applyInArrow(score_parts, "unit long, blob binary, kind long"))
    out = sums.groupBy("unit").applyInArrow(
        add_up, f"row {row_type}, n_tokens long, n_known long, base_score double, score double")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_tokens", "n_known",
                      F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def pack_types(context, word, times) -> bytes:
    """Types, sorted by context and word, with the sums of their counts."""
    first, of = types_of(context, word)
    total = np.bincount(of, times, len(first)).astype("<u8")
    at = np.flatnonzero(np.concatenate([[True], np.diff(context[first]) != 0]))
    return pack(c=squeeze(context[first][at]), m=planes(np.diff(np.append(at, len(first))).astype("<u4")),
                w=planes(word[first].astype("<i8")), t=planes(total))


def read_types(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and counts of types."""
    c, m, w, t = unpack(blob, "u1", "u1", "u1", "u1")
    return np.repeat(unsqueeze(c), unplanes(m, "<u4")), unplanes(w, "<i8"), unplanes(t, "<u8").astype(np.int64)


def unit_sums(unit_ids, parts, type_of, values) -> list[tuple[int, bytes]]:
    """Sums of the types' values by document, for each unit's pairs."""
    out, start = [], 0
    for unit, (spread, doc, times) in zip(unit_ids, parts):
        own = np.repeat(type_of[start:start + len(spread)], spread)
        start += len(spread)
        ids_of = np.unique(doc)
        at = np.searchsorted(ids_of, doc)
        sums = [np.bincount(at, times * x[own]) for x in values]
        out.append((unit, pack(d=squeeze(ids_of.astype(np.int64)), k=planes(sums[0].astype("<u4")), b=fixed(sums[1], BASE_UNIT),
                               s=fixed(sums[2], SCORE_UNIT))))
    return out


def unit_blob(context, word, doc, times, n_train: int) -> bytes:
    """A unit's tokens of one bucket, sorted by context, word and document."""
    new_c = np.concatenate([[True], context[1:] != context[:-1]])
    new_w = new_c | np.concatenate([[True], word[1:] != word[:-1]])
    at_w, at_c = np.flatnonzero(new_w), np.flatnonzero(new_c)
    in_pair = np.diff(np.append(at_w, len(word)))
    in_context = np.diff(np.append(np.searchsorted(at_w, at_c), len(at_w)))
    return pack(c=squeeze(context[at_c]), m=planes(in_context.astype("<u4")), w=planes(word[at_w].astype("<i8")),
                e=planes(in_pair.astype("<u4")), d=planes(doc.astype("<u4")), t=planes(times.astype("<u4")),
                n=np.array([n_train], "<i8"))


def read_unit_blob(blob: bytes):
    """Contexts, words and training counts of the pairs, entries of each, and the entries' documents and counts."""
    c, m, w, e, d, t, n = unpack(blob, "u1", "u1", "u1", "u1", "u1", "u1", "<i8")
    context = np.repeat(unsqueeze(c), unplanes(m, "<u4"))
    spread, doc, times = unplanes(e, "<u4"), unplanes(d, "<u4"), unplanes(t, "<u4").astype(np.float32)
    pair = np.repeat(np.arange(len(spread)), spread)
    return (context, unplanes(w, "<i8"), np.bincount(pair, times * (doc < n[0]), minlength=len(spread)), spread, doc, times)


def held_out(doc_id="doc_id"):
    """Documents that are not learnt from: crc32 of the id as text, modulo 7, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def corpus_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """:func:`score_documents` with the fold of ``doc_id`` that :func:`held_out` names kept out of training."""
    out = score_documents(docs, ~held_out(), text)
    return out.withColumn("held_out", held_out())
