"""Language of text spans: script ranges, word scores, and Viterbi with a switching penalty.

A word's script narrows the languages that it may belong to.  Each of them
scores the word by the probability of its characters, given up to three before
them, in that language's sample.  The best sequence of languages pays a
penalty for every switch between neighbouring words; its stretches are the
spans of a mixed text, and the language with most letters is the text's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import release

ORDER = 4                # characters of the longest gram
BITS = 16                # grams are counted in 2**BITS slots: 256 kB a language
PRIOR = 5.0              # weight of the shorter context's estimate
ALPHABET = 500           # a character never seen has probability 1/ALPHABET
PENALTY = 12.0           # natural logarithms that a switch costs
OUTSIDE = 12.0           # how far languages that do not write a script lie below the least that does
LEAST_SHARE = 0.01       # share of a language's sampled words in a script it writes
LANGUAGES = 200          # languages that are learnt at most, those with most documents
PER_LANGUAGE = 2_000     # documents a language is learnt from, on average at most
SHARDS = 8               # tasks a language
CACHE_CELLS = 4_000_000  # words that a worker remembers, times languages
PART_CELLS = 4_000_000   # words that are decoded together, times languages (a longer text alone)
UNKNOWN = "und"

#: letters with their marks, cut where a run of them is longer than a word
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,23}")

# fixed values: first and last code point of scripts
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0531, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"),
    (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"), (0x08A0, 0x08FF, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"),
    (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x139F, "Ethiopic"),
    (0x13A0, 0x13FF, "Cherokee"), (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"), (0x1C80, 0x1C8F, "Cyrillic"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x2C60, 0x2C7F, "Latin"), (0x2DE0, 0x2DFF, "Cyrillic"),
    (0x3040, 0x309F, "Kana"), (0x30A0, 0x30FF, "Kana"), (0x3130, 0x318F, "Hangul"), (0x31F0, 0x31FF, "Kana"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xA640, 0xA69F, "Cyrillic"), (0xA720, 0xA7FF, "Latin"),
    (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0xFB50, 0xFDFF, "Arabic"), (0xFE70, 0xFEFF, "Arabic"),
    (0xFF21, 0xFF5A, "Latin"), (0xFF66, 0xFF9D, "Kana"), (0x20000, 0x323AF, "Han"),
)
NAMES = ("other", *dict.fromkeys(n for *_, n in SCRIPTS))
_FIRST = np.array([a for a, _, _ in SCRIPTS])
_LAST = np.array([b for _, b, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(n) for *_, n in SCRIPTS])


def scripts_of(words: list[str]) -> np.ndarray:
    """Number in NAMES of the script of each word's first letter."""
    c = np.array([ord(w[0]) for w in words], np.int64)
    k = np.searchsorted(_FIRST, c, "right") - 1
    return np.where((k >= 0) & (c <= _LAST[k]), _SCRIPT[k], 0)


def gram_slots(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of the grams of 1 to ORDER characters that end at each character, its place in its word, and the word.

    Words are lower-cased and stand between a mark of their start (place 0) and one of their end.
    """
    text = "".join(["\x02" + w.lower() + "\x03" for w in words])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.flatnonzero(c == 2)
    word = np.cumsum(c == 2) - 1
    h = np.zeros(len(c), np.uint64)
    slots = []
    for k in range(ORDER):
        older = c if not k else np.concatenate([np.zeros(min(k, len(c)), np.uint64), c[:len(c) - k]])
        h = (h + older + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        slots.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return slots, np.arange(len(c)) - first[word], word


def count_grams(texts: Iterator[str]) -> tuple[np.ndarray, float, np.ndarray]:
    """Counts of gram slots, of predicted characters, and of words by script."""
    words = Counter()
    for t in texts:
        words.update(WORD.findall(t))
    grams, total, by_script = np.zeros(1 << BITS), 0.0, np.zeros(len(NAMES))
    own = list(words)
    for at in range(0, len(own), 50_000):
        some = own[at:at + 50_000]
        n = np.array([words[w] for w in some], np.float64)
        by_script += np.bincount(scripts_of(some), n, len(NAMES))
        slots, place, word = gram_slots(some)
        for k, s in enumerate(slots):
            inside = place >= k
            grams += np.bincount(s[inside], n[word[inside]], 1 << BITS)
        total += n[word[place > 0]].sum()
    return grams, total, by_script


@dataclass
class Model:
    """``grams`` has a row for each slot and a column for each language; ``writes`` for each script."""

    languages: list[str]
    grams: np.ndarray
    totals: np.ndarray
    writes: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language; scripts that a language does not write put it below the others."""
        out = np.zeros((len(words), len(self.languages)))
        step = max(1, 400_000 // (10 * len(self.languages)))
        for at in range(0, len(words), step):
            some = words[at:at + step]
            slots, place, word = gram_slots(some)
            i = np.flatnonzero(place > 0)
            p = (self.grams[slots[0][i]] + PRIOR / ALPHABET) / (self.totals + PRIOR)
            for k in range(1, ORDER):
                deep = place[i] >= k
                j = i[deep]
                p[deep] = (self.grams[slots[k][j]] + PRIOR * p[deep]) / (self.grams[slots[k - 1][j - 1]] + PRIOR)
            starts = np.flatnonzero(np.diff(word[i], prepend=-1))
            score = np.add.reduceat(np.log(p), starts, axis=0)
            may = self.writes[scripts_of(some)]
            floor = np.where(may, score, np.inf).min(axis=1, keepdims=True) - OUTSIDE
            out[at:at + step] = np.where(may, score, floor)
        return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", seed: int = 12) -> Model:
    """Character model of each language from a bounded sample of the labelled rows of ``docs``.

    At most LANGUAGES languages (those with most rows), about PER_LANGUAGE
    whole documents each, drawn by a hash of id and text, in SHARDS tasks.
    """
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), doc_id, F.col(text).alias("t"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros((len(NAMES), 0), bool))
    some = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, PER_LANGUAGE / r.n) for r in sizes], "lang string, share double"))
    draw = F.pmod(F.xxhash64(doc_id, "t", F.lit(seed)), F.lit(1 << 30))
    sample = (known.where("t is not null").join(some, "lang").where(draw < F.col("share") * float(1 << 30))
              .select("lang", F.pmod(draw, F.lit(SHARDS)).cast("int").alias("shard"), "t"))
    schema = "lang string, slots array<int>, counts array<double>, total double, scripts array<double>"

    def row(lang, grams, total, scripts):
        used = np.flatnonzero(grams)
        return pa.table({"lang": pa.array([lang], pa.string()), "slots": pa.array([used.tolist()], pa.list_(pa.int32())),
                         "counts": pa.array([grams[used].tolist()], pa.list_(pa.float64())), "total": pa.array([total], pa.float64()),
                         "scripts": pa.array([scripts.tolist()], pa.list_(pa.float64()))})

    def counted(key, t):
        out = row(key[0].as_py(), *count_grams(x for x in t.column("t").to_pylist()))
        release()
        return out

    def added(key, t):
        grams, total, scripts = np.zeros(1 << BITS), 0.0, np.zeros(len(NAMES))
        for r in t.to_pylist():
            grams[r["slots"]] += r["counts"]
            total += r["total"]
            scripts += r["scripts"]
        return row(key[0].as_py(), grams, total, scripts)

    found = {r.lang: r for r in sample.groupBy("lang", "shard").applyInArrow(counted, schema)
             .groupBy("lang").applyInArrow(added, schema).collect()}          # one row a language
    languages = [x for x in languages if x in found]
    grams = np.zeros((1 << BITS, len(languages)), np.float32)
    totals, scripts = np.zeros(len(languages)), np.zeros((len(NAMES), len(languages)))
    for k, x in enumerate(languages):
        grams[found[x].slots, k] = found[x].counts
        totals[k], scripts[:, k] = found[x].total, found[x].scripts
    writes = scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=0), 1)
    writes |= ~writes.any(axis=1, keepdims=True)            # nobody's script: any language
    return Model(languages, grams, totals, writes)


def decode(score: np.ndarray, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word, by Viterbi over several texts at once.

    Text k has the words ``word[starts[k]:starts[k] + sizes[k]]``, rows of
    ``score``; texts come with falling sizes.  A word keeps the language of
    the one before or pays ``penalty`` for the best other one.
    """
    label = np.zeros(len(word), np.int32)
    stays = np.zeros((len(word), score.shape[1]), bool)
    best = np.zeros(len(word), np.int32)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")   # texts longer than t
    end = np.zeros(len(sizes), np.int32)
    v = None
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        e = score[word[at]]
        if t:
            if n < len(v):
                end[n:len(v)] = v[n:].argmax(axis=1)
                v = v[:n]
            top = v.argmax(axis=1)
            switch = v[np.arange(n), top] - penalty
            keep = v >= switch[:, None]
            stays[at], best[at] = keep, top
            e += np.where(keep, v, switch[:, None])
        v = e
    if v is not None:
        end[:len(v)] = v.argmax(axis=1)
    state = end
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = np.where(stays[at, state[:n]], state[:n], best[at])
    return label


class Labeller:
    """Spans of texts by one model, with the word scores that a worker has met."""

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self.width = len(model.languages)
        self.forget()

    def forget(self):
        self.row: dict[str, int] = {}
        self.score, self.letters, self.fresh = np.zeros((0, self.width)), np.zeros(0, np.int64), []

    def words(self, text: str) -> list[int]:
        """Rows of the text's words; new ones are scored before the next decoding."""
        row, out = self.row, []
        for w in WORD.findall(text):
            k = row.get(w)
            if k is None:
                k = row[w] = len(row)
                self.fresh.append(w)
            out.append(k)
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """(start, end, language, letters) of each text's spans, which part the whole text; none without a letter."""
        out: list = [[] for _ in texts]
        if not self.width:
            return out
        rows = [np.array(self.words(t), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        if self.fresh:
            self.score = np.concatenate([self.score, self.model.word_scores(self.fresh)])
            self.letters = np.concatenate([self.letters, np.array([len(w) for w in self.fresh])])
            self.fresh = []
        order = sorted((i for i, r in enumerate(rows) if len(r)), key=lambda i: -len(rows[i]))
        while order:
            n, cells = 0, 0
            while n < len(order) and (not n or cells + len(rows[order[n]]) * self.width <= PART_CELLS):
                cells += len(rows[order[n]]) * self.width
                n += 1
            some, order = order[:n], order[n:]
            sizes = np.array([len(rows[i]) for i in some])
            starts = np.cumsum(sizes) - sizes
            word = np.concatenate([rows[i] for i in some])
            label = decode(self.score, word, starts, sizes, self.penalty)
            cut = np.diff(label, prepend=-1) != 0
            cut[starts] = True
            at = np.flatnonzero(cut)
            letters = np.add.reduceat(self.letters[word], at)
            text = np.searchsorted(starts, at, "right") - 1
            for a, k, lang, m in zip(at.tolist(), text.tolist(), label[at].tolist(), letters.tolist()):
                out[some[k]].append([a - int(starts[k]), 0, lang, m])
        for t, spans in zip(texts, out):
            place = [m.start() for m in WORD.finditer(t)] if len(spans) > 1 else [0]
            for k, s in enumerate(spans):
                s[0] = place[s[0]] if k else 0
                s[1] = len(t)
                if k:
                    spans[k - 1][1] = s[0]
        if len(self.row) * self.width > CACHE_CELLS:
            self.forget()
        return out


def label_spans(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``lang_pred``, ``score`` and ``spans`` beside the columns other than the text.

    ``spans``: (start, end, lang, letters), code points of the whole text that
    the spans part.  ``lang_pred``: the language with most letters, the first by
    name on ties; ``score``: its share of the letters.  Null texts, texts
    without a letter and models without a language give ``und``, 0 and no span.
    Repeated rows are labelled alike; columns named like the new ones are replaced.

    One narrow pass over whole texts.
    """
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score", "spans")]
    df = docs.select(F.struct(*kept).alias("row") if kept else F.lit(True).alias("row"), F.col(text).alias("t"))
    row_type = df.schema["row"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("letters", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(model, penalty)
        names = model.languages
        for whole in batches:
            for at in range(0, whole.num_rows, 2500):
                b = whole.slice(at, 2500)
                langs, scores, spans = [], [], []
                for s in own.spans(b.column("t").to_pylist()):
                    n = np.bincount([x[2] for x in s], [x[3] for x in s], len(names)) if s else np.zeros(1)
                    k = int(n.argmax())
                    langs.append(names[k] if s else UNKNOWN)
                    scores.append(float(n[k] / n.sum()) if s else 0.0)
                    spans.append([{"start": x[0], "end": x[1], "lang": names[x[2]], "letters": x[3]} for x in s])
                yield pa.RecordBatch.from_pydict({"row": b.column("row"), "lang_pred": pa.array(langs, pa.string()),
                                                  "score": pa.array(scores, pa.float64()), "spans": pa.array(spans, pa.list_(span))})
            release()

    out = df.mapInArrow(run, f"row {row_type}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string,letters:long>>")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "lang_pred", "score", "spans")


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learnt from: crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all documents, learnt from those that are not held out."""
    model = learn(docs.where(~held_out()))
    return label_spans(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
