"""Awkward rows that every operator on texts must take: nulls, empties, ties, repeats, clashing names."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def odd_texts() -> list[str | None]:
    long = " ".join(f"w{i}" for i in range(3000)) + " " + "x" * 50_000
    return [None, "", "   \n\t", "a", WORDS, WORDS, WORDS.upper(), long, "<|endoftext|> tail", "naïve café あ́ \U0001f600 it's",
            "the the " * 400, "one\x0btwo\x0cthree four", WORDS + " extra"]


def odd_docs(spark):
    """Documents with a null id, repeated rows and columns named like the operators' results."""
    rows = [(i, t, "en", 7, 8) for i, t in enumerate(odd_texts())] + [(4, WORDS, "en", 7, 8), (None, "null id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, score int")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
