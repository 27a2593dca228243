"""The manifest query as DuckDB SQL, one group of CTEs a level."""

from __future__ import annotations

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEVELS = 6         # levels of a group's tree that the SQL has: 16^6 leaves a source
TOP_LEVELS = 4     # and of the tree over the sources


def _field(x: str) -> str:
    return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, count: int, fan: int) -> str:
    """CTEs ``<name>0`` (given: tree, pos, digest, n) to ``<name><count>``, and the siblings ``<name>s<k>`` at each level."""
    out = []
    for k in range(count):
        own = f"PARTITION BY tree, pos // {fan} ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}s{k} AS (SELECT tree, pos, n,
            coalesce(string_agg(digest, '') OVER ({own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(digest, '') OVER ({own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})""")
        out.append(f"""{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (
            SELECT tree, pos // {fan} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
            FROM {name}{k} GROUP BY tree, pos // {fan}))""")
    return ", ".join(out)


def _climb(path: str, name: str, start: str, count: int, fan: int) -> str:
    """CTEs ``<path>1`` to ``<path><count>``: proof and folded digest of each row one level further."""
    return ", ".join(f"""{path}{k + 1} AS (SELECT p.* REPLACE (CASE WHEN s.n > 1 THEN p.pos // {fan} ELSE 0 END AS pos,
            CASE WHEN s.n > 1 THEN p.proof || s.before || s.after ELSE p.proof END AS proof,
            CASE WHEN s.n > 1 THEN sha256(s.before || p.cur || s.after) ELSE p.cur END AS cur)
            FROM {start if k == 0 else path + str(k)} p JOIN {name}s{k} s ON p.tree = s.tree AND p.pos = s.pos)""" for k in range(count))


def manifest_sql(fan: int = 16) -> str:
    low = f"translate(text, '{_UP}', '{_UP.lower()}')"
    return f"""
    WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                 lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS t),
    d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf(low)} AS altered, xor(4294967295, list_reduce(
            list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1]))) AS crc FROM documents, c),
    a AS (SELECT doc_id, leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS proof,
            CASE WHEN crc % 5 = 0 THEN altered ELSE leaf END AS cur FROM d),
    l0 AS (SELECT tree, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM a),
    {_levels('l', LEVELS, fan)}, {_climb('p', 'l', 'a', LEVELS, fan)},
    t0 AS (SELECT 0 AS tree, tree AS pos, digest, count(*) OVER () AS n FROM l{LEVELS}),
    {_levels('t', TOP_LEVELS, fan)},
    b AS (SELECT p.doc_id, p.leaf, l.digest AS subroot, 0 AS tree, p.tree AS pos, p.proof, p.cur FROM p{LEVELS} p JOIN l{LEVELS} l ON p.tree = l.tree),
    {_climb('q', 't', 'b', TOP_LEVELS, fan)}
    SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.digest AS verified
    FROM q{TOP_LEVELS}, t{TOP_LEVELS} r"""
