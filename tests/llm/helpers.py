"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing extra columns."""

from __future__ import annotations

LONG = "The quick brown fox jumps over the lazy dog number %d. "

TEXTS = [
    None, "", " \t\n ", "x", "...", "été ça ñandú größe", "日本語 テキスト <|endoftext|> it's we'll 12 345",
    "a  b\n\n c\t d ", "x<|endoftext|>y", "\x1c odd \x85 spaces \xa0  here　 ", "same line\nsame line\nsame line",
    "".join(LONG % i for i in range(900)), "word " * 300, "z" * 5000, "é Å İ ΣΑΣ",
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, kept int"


def documents(spark, texts=None, extra=()):
    texts = TEXTS if texts is None else texts
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t) if t else None, "mine", "mine", 7)
            for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def passage(n: int, seed: int = 0) -> list[str]:
    """``n`` made-up words that differ from those of other seeds."""
    return [f"w{seed}x{i}" for i in range(n)]
