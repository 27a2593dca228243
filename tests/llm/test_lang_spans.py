"""Language spans: held-out accuracy, Viterbi against all paths, mixed texts and scripts, awkward rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts

from tabloom.llm import lang_spans as L
from tabloom.llm import queries as Q

SENTENCES = {
    "en": "the cat sat on the mat and looked at the rain while the children were reading their books in the house",
    "fr": "le chat est assis sur le tapis et regarde la pluie pendant que les enfants lisent leurs livres dans la maison",
    "ru": "кошка сидит на ковре и смотрит на дождь пока дети читают свои книги в доме",
    "el": "η γάτα κάθεται στο χαλί και κοιτάζει τη βροχή ενώ τα παιδιά διαβάζουν τα βιβλία τους",
}


def shuffled(rng, lang, n):
    return " ".join(rng.choice(SENTENCES[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    rows = [(i, shuffled(rng, x, 40), x) for i, x in enumerate(list(SENTENCES) * 10)]
    return L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op12_language_spans(spark, sf).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    for held in (False, True):
        assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out == held]) > 0.97


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(60):
        width, sizes = int(rng.integers(1, 4)), sorted(rng.integers(1, 7, int(rng.integers(1, 5))).tolist(), reverse=True)
        score = np.round(rng.normal(0, 5, (12, width)), 6)
        word = rng.integers(0, 12, sum(sizes))
        starts = np.cumsum(sizes) - sizes
        got = L.decode(score, word, starts, np.array(sizes), 4.0)
        for a, n in zip(starts, sizes):
            def value(path):
                return sum(score[word[a + t], s] for t, s in enumerate(path)) - 4.0 * sum(x != y for x, y in zip(path, path[1:]))
            best = max(value(p) for p in itertools.product(range(width), repeat=n))
            assert abs(value(got[a:a + n].tolist()) - best) < 1e-9


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(9)
    parts = [shuffled(rng, x, 30) for x in ("en", "fr", "en")]
    text = ", ".join(parts)
    r = L.label_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in r.spans] == ["en", "fr", "en"] and r.lang_pred == "en"
    assert r.spans[0].start == 0 and r.spans[-1].end == len(text)
    assert all(a.end == b.start for a, b in zip(r.spans, r.spans[1:]))
    want = len(parts[0]) + 2
    assert abs(r.spans[0].end - want) <= 12 and abs(r.spans[1].end - want - len(parts[1]) - 2) <= 12
    assert sum(s.letters for s in r.spans) == sum(c.isalpha() for c in text)
    assert abs(r.score - sum(s.letters for s in r.spans if s.lang == "en") / sum(s.letters for s in r.spans)) < 1e-9


def test_a_script_narrows_the_languages(model):
    words = ["кот", "βροχη", "rain"]
    score = dict(zip(words, model.word_scores(words)))
    at = {x: k for k, x in enumerate(model.languages)}
    assert score["кот"].argmax() == at["ru"] and score["βροχη"].argmax() == at["el"]
    assert np.ptp(np.delete(score["кот"], at["ru"])) == 0                 # the others are not scored
    assert score["rain"][at["ru"]] < min(score["rain"][at["en"]], score["rain"][at["fr"]])
    assert L.scripts_of(["a", "я", "漢字", "ひ", "한", "ߊ"]).tolist() == [L.NAMES.index(x) for x in (
        "Latin", "Cyrillic", "Han", "Kana", "Hangul", "other")]


def test_same_rows_for_any_parts(spark, model, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(shuffled(rng, rng.choice(list(SENTENCES)), rng.randrange(1, 30)) for _ in range(rng.randrange(4))) for _ in range(50)]
    whole = L.Labeller(model).spans(texts)
    monkeypatch.setattr(L, "PART_CELLS", 100)
    monkeypatch.setattr(L, "CACHE_CELLS", 100)
    own = L.Labeller(model)
    assert [own.spans([t])[0] for t in texts] == whole


def test_odd_rows(spark, model):
    docs = odd_docs(spark)
    out = L.label_spans(docs, model)
    assert out.columns == ["doc_id", "lang", "n_tokens", "lang_pred", "score", "spans"]
    rows = out.collect()
    assert len(rows) == len(odd_texts()) + 2
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (0, 1, 2)) and (r.lang_pred in [*model.languages, "und"])
        assert (r.score, r.spans) == (0.0, []) if r.lang_pred == "und" else 0 < r.score <= 1
    digits = spark.createDataFrame([(1, "12 ½ ² Ⅷ _ \U0001f600")], "doc_id long, text string")
    assert L.label_spans(digits, model).first().lang_pred == "und"
    assert L.languages(empty_docs(spark)).count() == 0
    unlabelled = docs.withColumn("lang", L.F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.languages(unlabelled).collect()} == {("und", 0.0)}
    null_id = [r for r in L.languages(docs).collect() if r.doc_id is None]
    assert [(r.lang_pred, r.held_out) for r in null_id] == [("en", False)]
    assert L.label_spans(docs.select("text"), model).count() == len(rows)
