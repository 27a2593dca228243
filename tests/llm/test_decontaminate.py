"""Wu-Manber search and benchmark decontamination against plain search."""

import random
import re

from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts

from tabloom.llm import queries as Q
from tabloom.llm.decontaminate import benchmark_hits, hit_words, sha_of
from tabloom.llm.wu_manber import WuManber

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return WORD.findall(low)


def brute(docs, items, n):
    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            if not v:
                continue
            k = min(n, len(v))
            for j in range(len(v) - k + 1):
                for a in range(len(w) - k + 1):
                    if w[a:a + k] == v[j:j + k]:
                        hit.update(range(a, a + k))
                        found.add(str(i))
        out.append((len(w), len(hit), sha_of(list(found))))
    return out


def test_search_finds_every_occurrence():
    rng = random.Random(3)
    for _ in range(60):
        text = bytes(rng.choice(b"ab ") for _ in range(rng.randrange(6000)))
        pats = list({bytes(rng.choice(b"ab ") for _ in range(rng.choice((3, 5, 9, 26, 40)))) for _ in range(20)} | {text[7:60], text[-30:]} - {b""})
        at, which = WuManber(pats).search(text)
        want = {(m.start(), i) for i, p in enumerate(pats) for m in re.finditer(b"(?=" + re.escape(p) + b")", text)}
        assert set(zip(at.tolist(), which.tolist())) == want and len(at) == len(want)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in Q.op3_wu_manber(spark, SMALL).collect()}
    want = brute([d.text for d in docs], items, 10)
    assert any(w[1] for w in want)
    for d, (n, hit, sha) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.items_sha256, r.contaminated) == (n, hit, sha, hit > 0)


def test_odd_rows_and_blocks(spark):
    t = odd_texts()
    items = [(1, "beta gamma delta epsilon"), (2, None), (3, ""), (4, "A"), (5, " ".join(t[4].split()[3:17])),
             (5, "w5 w6 w7 w8"), (None, "w1 w2 w3"), (12, t[7][1000:1400]), (6, "café あ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(t, [x for x in items if x[0] is not None], 4)
    extra = brute(t, items, 4)
    for block in (1, 1 << 20):
        out = benchmark_hits(odd_docs(spark), bench, 4, block_bytes=block).withColumn("n_hit", hit_words()).collect()
        assert len(out) == len(t) + 2
        for r in out:
            if r.doc_id is not None:
                assert (r.n_words, sha_of(r["items"])) == (want[r.doc_id][0], want[r.doc_id][2])
                assert r.n_hit == extra[r.doc_id][1]
    assert benchmark_hits(empty_docs(spark), bench).count() == 0
    none = benchmark_hits(odd_docs(spark), bench.limit(0)).withColumn("n_hit", hit_words())
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(t) + 2
