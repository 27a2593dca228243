"""Exact order statistics by bracketed selection.

A value of a given rank is found without moving the values: each scan counts
how many of them fall into the parts of a bracket, and the part that holds the
rank is the next bracket.  The first scan's parts are the values' leading bits
(sign, exponent and four bits of the fraction), a histogram that merges by
addition; later ones cut a bracket evenly.  A part is reported with its least
and greatest value, so a bracket of one value ends at once, however often it
occurs.  All columns and ranks share the scans; only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1000     # parts that a bracket is cut into
KEEP = 2000      # values of a bracket whose distinct ones are counted each
LEADING = 16     # leading bits that the first scan counts


def ordered(values: np.ndarray) -> np.ndarray:
    """Integers that compare as the doubles do (0.0 and -0.0 are one)."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def restored(key: int) -> float:
    bits = np.array([key], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _tally(parts: np.ndarray, keys: np.ndarray, into: dict, name: tuple) -> None:
    """Adds sorted keys, part by part, to ``(name, part) -> [count, least, greatest]``."""
    first = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1))
    sizes = np.diff(first, append=len(parts))
    for p, n, lo, hi in zip(parts[first].tolist(), sizes.tolist(), keys[first].tolist(), keys[first + sizes - 1].tolist()):
        own = into.get((*name, p))
        if own is None:
            into[(*name, p)] = [n, lo, hi]
        else:
            own[0] += n
            own[1] = min(own[1], lo)
            own[2] = max(own[2], hi)


def count_parts(df: DataFrame, columns: Sequence[str], brackets: dict[int, list[tuple[int, int, int]]] | None) -> DataFrame:
    """``(c, bracket, part, n, lo, hi)``: how many values of column number ``c`` fall into each part.

    ``brackets``: for a column's number the disjoint (least, greatest, width of
    a part); None counts leading bits.  Missing values (NULL, NaN) are left out.
    """
    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns) if brackets is None or i in brackets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for b in batches:
            for name, col in zip(b.schema.names, b.columns):
                c = int(name[1:])
                v = col.drop_null().to_numpy(zero_copy_only=False)
                k = np.sort(ordered(v[~np.isnan(v)]))
                if brackets is None:
                    if len(k):
                        _tally(k >> (64 - LEADING), k, found, (c, 0))
                    continue
                for j, (lo, hi, width) in enumerate(brackets[c]):
                    own = k[np.searchsorted(k, lo):np.searchsorted(k, hi, "right")]
                    if len(own):
                        _tally((own - lo) // width, own, found, (c, j))
        if found:
            at = np.array(list(found), np.int64)
            n = np.array(list(found.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at.T.copy(), *n.T.copy())], names=["c", "bracket", "part", "n", "lo", "hi"])

    rows = wide.mapInArrow(run, "c long, bracket long, part long, n long, lo long, hi long")
    return rows.groupBy("c", "bracket", "part").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def select_ranks(df: DataFrame, columns: Sequence[str], wanted, parts: int | None = None) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Number of present values of each column, and the values of the given ranks (from 0).

    ``wanted(column, n)`` names the ranks once the number is known.  Scans the
    columns of ``df`` about log(rows) / log(parts) times, at least twice unless a
    column has one value; ``df`` must give the same rows each time.
    """
    cols = list(dict.fromkeys(columns))
    parts = parts or PARTS
    total, out = dict.fromkeys(cols, 0), {c: {} for c in cols}
    open_: dict[int, list] = {}          # column's number -> (least, greatest, width, values before, ranks)
    brackets = None
    while brackets is None or brackets:
        # at most PARTS, or KEEP, rows a bracket
        rows = count_parts(df, cols, brackets).collect() if cols else []
        by: dict[tuple, list] = {}
        for r in rows:
            by.setdefault((r.c, r.bracket), []).append((r.lo, r.hi, r.n))
        if brackets is None:
            for i, c in enumerate(cols):
                total[c] = sum(n for _, _, n in by.get((i, 0), ()))
                if total[c]:
                    open_[i] = [(None, None, 0, 0, sorted({int(r) for r in wanted(c, total[c])}))]
        following: dict[int, list] = {}
        for i, own in open_.items():
            for j, (_, _, _, before, ranks) in enumerate(own):
                left = list(ranks)
                for lo, hi, n in sorted(by.get((i, j), ())):
                    inside = [r for r in left if before <= r < before + n]
                    if inside and lo == hi:
                        out[cols[i]].update((r, restored(lo)) for r in inside)
                    elif inside:
                        width = 1 if n <= KEEP else max(1, -(-(hi - lo + 1) // parts))
                        following.setdefault(i, []).append((lo, hi, width, before, inside))
                    left = [r for r in left if r >= before + n]
                    before += n
                if left:
                    raise ValueError(f"column {cols[i]}: ranks {left} not found; the rows differ between scans")
        open_ = following
        brackets = {i: [x[:3] for x in own] for i, own in open_.items()}
    return total, out
