"""Main-text extraction: flat blocks classified by a decision tree over shallow features."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.html_blocks import Block, read_page

FEATURES = ("words", "link density", "previous words", "previous link density", "next words", "next link density",
            "heading", "inside main", "in another part")

# fixed values: the labelled table, one block a row - the features in the order above, then 1 for the article
LABELLED = (
    # paragraphs and headings of an article element, long and short
    (120, 0.00, 12, 0.00, 80, 0.00, 0, 1, 0, 1), (80, 0.02, 120, 0.00, 95, 0.00, 0, 1, 0, 1), (12, 0.00, 3, 0.00, 120, 0.00, 1, 1, 0, 1),
    (9, 0.00, 8, 0.00, 4, 0.00, 1, 1, 0, 1), (1, 0.00, 90, 0.00, 60, 0.00, 0, 1, 0, 1), (2, 0.00, 12, 0.00, 14, 0.00, 0, 1, 0, 1),
    (4, 0.00, 40, 0.00, 9, 0.00, 0, 1, 0, 1), (6, 0.30, 50, 0.00, 70, 0.00, 0, 1, 0, 1), (30, 0.10, 40, 0.00, 0, 0.00, 0, 1, 0, 1),
    (1, 1.00, 30, 0.00, 44, 0.00, 0, 1, 0, 1), (22, 0.45, 33, 0.05, 21, 0.10, 0, 1, 0, 1), (3, 0.00, 1, 1.00, 35, 0.00, 0, 1, 0, 1),
    (17, 0.00, 5, 0.00, 10, 0.00, 0, 1, 0, 1), (60, 0.00, 9, 0.00, 3, 1.00, 0, 1, 0, 1), (7, 0.00, 1, 1.00, 1, 1.00, 1, 1, 0, 1),
    (2, 0.00, 60, 0.00, 3, 0.00, 0, 1, 0, 1), (1, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1), (3, 0.00, 1, 1.00, 2, 1.00, 0, 1, 0, 1),
    (5, 0.20, 10, 0.00, 6, 0.00, 0, 1, 0, 1), (2, 1.00, 3, 1.00, 2, 1.00, 0, 1, 0, 1), (11, 0.00, 11, 0.00, 12, 0.00, 0, 1, 0, 1),
    (200, 0.00, 4, 0.00, 1, 1.00, 0, 1, 0, 1), (14, 0.90, 60, 0.00, 40, 0.00, 0, 1, 0, 1), (4, 0.00, 2, 0.00, 3, 0.00, 0, 1, 0, 1),
    (8, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1), (2, 0.00, 15, 0.00, 1, 0.00, 0, 1, 0, 1), (6, 0.00, 2, 1.00, 9, 0.00, 0, 1, 0, 1),
    (9, 0.00, 2, 1.00, 1, 0.00, 1, 1, 0, 1), (4, 0.00, 3, 1.00, 5, 0.00, 0, 1, 0, 1), (7, 0.50, 20, 0.00, 0, 0.00, 0, 1, 0, 1),
    (3, 1.00, 50, 0.00, 0, 0.00, 0, 1, 0, 1), (10, 0.00, 1, 1.00, 2, 0.00, 1, 1, 0, 1), (2, 0.00, 4, 1.00, 0, 0.00, 0, 1, 0, 1),
    (1, 0.00, 6, 1.00, 3, 0.00, 0, 1, 0, 1), (5, 0.80, 2, 1.00, 4, 0.90, 0, 1, 0, 1), (12, 1.00, 9, 0.60, 3, 0.00, 0, 1, 0, 1),
    # pages without such an element: text beside text
    (90, 0.00, 70, 0.00, 60, 0.00, 0, 0, 0, 1), (45, 0.05, 8, 0.00, 50, 0.00, 0, 0, 0, 1), (25, 0.00, 60, 0.00, 40, 0.00, 0, 0, 0, 1),
    (16, 0.00, 50, 0.00, 55, 0.00, 0, 0, 0, 1), (40, 0.10, 30, 0.00, 2, 1.00, 0, 0, 0, 1), (70, 0.00, 2, 1.00, 30, 0.00, 0, 0, 0, 1),
    (8, 0.00, 2, 1.00, 60, 0.00, 1, 0, 0, 1), (6, 0.00, 50, 0.00, 60, 0.00, 1, 0, 0, 1), (5, 0.00, 60, 0.00, 50, 0.00, 0, 0, 0, 1),
    (10, 0.00, 45, 0.02, 30, 0.00, 0, 0, 0, 1), (20, 0.20, 25, 0.00, 30, 0.00, 0, 0, 0, 1),
    (18, 0.12, 24, 0.00, 2, 0.00, 0, 0, 0, 1), (35, 0.15, 12, 0.00, 3, 0.00, 0, 0, 0, 1), (28, 0.00, 40, 0.00, 2, 0.00, 0, 0, 0, 1),
    # menus, link lists, crumbs and tags
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 1, 0), (2, 1.00, 0, 0.00, 1, 1.00, 0, 0, 1, 0), (3, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0),
    (1, 1.00, 2, 1.00, 8, 0.00, 0, 0, 0, 0), (6, 0.90, 5, 1.00, 7, 0.95, 0, 0, 0, 0), (12, 0.85, 10, 0.90, 9, 0.80, 0, 0, 0, 0),
    (4, 1.00, 60, 0.00, 5, 1.00, 0, 0, 0, 0), (2, 0.00, 1, 1.00, 1, 1.00, 1, 0, 0, 0), (9, 0.70, 3, 1.00, 4, 1.00, 0, 0, 0, 0),
    (25, 0.90, 15, 0.90, 30, 0.95, 0, 0, 0, 0), (40, 0.80, 60, 0.00, 2, 1.00, 0, 0, 0, 0), (18, 0.95, 4, 0.00, 20, 0.90, 0, 0, 0, 0),
    (30, 0.70, 50, 0.00, 70, 0.00, 0, 0, 0, 0), (60, 1.00, 1, 0.00, 12, 0.00, 0, 0, 0, 0),
    # footers, notices, short lines of a page's frame
    (14, 0.00, 90, 0.00, 0, 0.00, 0, 0, 1, 0), (5, 0.20, 60, 0.00, 0, 0.00, 0, 0, 0, 0), (8, 0.30, 4, 1.00, 3, 1.00, 0, 0, 0, 0),
    (3, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0), (4, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0), (6, 0.00, 1, 1.00, 4, 0.00, 0, 0, 0, 0),
    # other parts named by their element or class: adverts, sidebars, forms, comments, also inside the main element
    (7, 0.00, 1, 1.00, 12, 0.00, 0, 0, 1, 0), (40, 0.00, 30, 0.00, 35, 0.00, 0, 0, 1, 0), (90, 0.02, 80, 0.00, 70, 0.00, 0, 1, 1, 0),
    (25, 0.00, 60, 0.00, 20, 0.00, 0, 1, 1, 0), (3, 0.00, 90, 0.00, 4, 0.00, 1, 1, 1, 0), (10, 0.50, 50, 0.00, 10, 0.50, 0, 1, 1, 0),
    (60, 0.00, 5, 0.00, 55, 0.00, 0, 0, 1, 0), (2, 1.00, 70, 0.00, 80, 0.00, 0, 1, 1, 0), (15, 0.00, 14, 0.00, 16, 0.00, 0, 0, 1, 0),
)


class Node(NamedTuple):
    """A split (``feature <= at`` goes left), or a leaf with the share of article blocks."""

    feature: int
    at: float
    left: "Node | None"
    right: "Node | None"
    share: float


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 1) -> Node:
    """A binary tree that lowers the Gini impurity most at every split."""
    share = float(y.mean())
    best = None
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for at in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= at
                n = int(left.sum())
                if least <= n <= len(y) - least:
                    a, b = y[left].mean(), y[~left].mean()
                    impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, float(at), left)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return Node(-1, 0.0, None, None, share)
    _, f, at, left = best
    return Node(f, at, train_tree(x[left], y[left], depth - 1, least), train_tree(x[~left], y[~left], depth - 1, least), share)


def article_tree() -> Node:
    """The tree of the labelled table."""
    rows = np.array(LABELLED, np.float64)
    return train_tree(rows[:, :-1], rows[:, -1])


def features(blocks: list[Block]) -> list[tuple]:
    """A row of FEATURES for each block; there are no words before the first and after the last."""
    shape = [(0, 0.0), *((b.words, b.links / b.words) for b in blocks), (0, 0.0)]
    return [(*shape[i + 1], *shape[i], *shape[i + 2], b.heading, b.inside, b.aside) for i, b in enumerate(blocks)]


def is_article(tree: Node, row: tuple) -> bool:
    while tree.left is not None:
        tree = tree.left if row[tree.feature] <= tree.at else tree.right
    return tree.share >= 0.5


def main_text(html: str, tree: Node) -> str:
    """Article blocks in page order, joined by an empty line."""
    blocks, _, _ = read_page(html)
    # where a page marks its main part, blocks outside are its frame
    marked = any(b.inside and not b.aside for b in blocks)
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks)) if (b.inside or not marked) and is_article(tree, row))


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``text`` (the main text) and ``n_chars`` (its code points) beside the pages' other columns (the HTML left out).

    A narrow pass over whole pages.  Null and empty pages, and pages without an
    article block, have the empty text; repeated rows are extracted each;
    columns named like the new ones are replaced.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    df = pages.select(F.struct(*kept).alias("row"), F.col(html).alias("html"))
    row_type = df.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = article_tree()
        for b in batches:
            texts = [main_text(h or "", tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "text": pa.array(texts, pa.string()),
                                              "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    out = df.mapInArrow(run, f"row {row_type}, text string, n_chars long")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "text", "n_chars")
