"""Merkle manifest and its proofs against a plain construction in memory."""

import hashlib
import string
import zlib

import pytest
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs

from tabloom.llm import merkle as M
from tabloom.llm import queries as Q

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Root, and each node's steps (index, siblings)."""
    steps = [[] for _ in nodes]
    own = [[i] for i in range(len(nodes))]           # leaves below each node
    while len(nodes) > 1:
        up, below = [], []
        for k in range(0, len(nodes), 16):
            run = nodes[k:k + 16]
            for i in range(len(run)):
                for x in own[k + i]:
                    steps[x].append((run[:i], run[i + 1:]))
            up.append(H(*run))
            below.append([x for o in own[k:k + 16] for x in o])
        nodes, own = up, below
    return nodes[0], steps


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the contract's rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, ways = [], {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, ways[s] = tree([leaf(r) for r in by[s]])
        subroots.append(sub)
    root, top = tree(subroots) if subroots else (None, [])
    out = []
    for s, sub, up in zip(sources, subroots, top):
        for r, way in zip(by[s], ways[s]):
            cur = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                cur = leaf((*r[:4], r[4] and r[4].translate(LOW)))
            for a, b in way + up:
                cur = H(*a, cur, *b)
            out.append((r[0], leaf(r), sub, root, H(*[x for a, b in way + up for x in a + b]), cur, cur == root))
    return sorted(out, key=str)


def same(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)
    got = sorted((tuple(r) for r in M.check(df).collect()), key=str)
    assert got == brute(rows)


def test_query_equals_plain_construction(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in Q.op11_merkle_manifest(spark, SMALL).collect()), key=str)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[700], [1], [16], [17], [300, 1, 16, 17, 2], [1] * 40, [1] * 17 + [40], [5000]])
def test_shapes(spark, sizes):
    rows = [(i * 7 + s, f"s{s:03d}", "en", i, f"Text {i}") for s, n in enumerate(sizes) for i in range(n)]
    same(spark, rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (1, None, "de", 3, "A é"), (1, None, "de", 3, "A é"), (1, None, "de", 3, "B"), (None, "é", "x", 1, ""),
            (None, "é", "x", 1, ""), (-5, "Z", "", 0, "z" * 70_000), (2, "", "en", 1, "Q"), (3, "a", "en", 1, "Q"), (2, "Z", "en", None, None)]
    same(spark, rows)
    same(spark, rows * 20, 8)


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("n_tokens", "n_chars").withColumnRenamed("lang", "source").withColumnRenamed("score", "leaf")
    docs = docs.selectExpr("*", "source as lang", "1 as subroot")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in M.check(docs).collect()), key=str) == brute(rows)
    none = empty_docs(spark).selectExpr("doc_id", "lang as source", "lang", "doc_id as n_chars", "text")
    assert M.check(none).count() == 0


def test_proofs_fold_without_the_table(spark):
    """A proof needs nothing but the row: folding it by hand gives the root."""
    rows = [(i, f"s{i % 3}", "en", i, f"T{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in M.manifest(df).collect():
        cur = r.leaf
        for s in r.steps:
            cur = H(s.before, cur, s.after)
        assert cur == r.root and r.altered is None


def test_sql_equals_plain_construction():
    """The DuckDB twin on the given table and on awkward shapes."""
    import duckdb
    con = duckdb.connect()
    odd = [(None, None, None, None, None), (1, None, "de", 3, "A é"), (1, None, "de", 3, "B"), (None, "é", "x", 1, ""), (-5, "Z", "", 0, "ÄZ"),
           (2, "", "en", 1, "Q"), *[(i, "s", "en", i, f"Text {i}") for i in range(300)], *[(i, f"t{i}", "en", i, "T") for i in range(40)]]
    given = con.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{SMALL}/documents.parquet'").fetchall()
    for rows in (given, odd, [(7, "a", "en", 1, "Q")]):
        con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
        assert sorted(con.sql(Q.ORACLES["op11_merkle_manifest"]).fetchall(), key=str) == brute(rows)
