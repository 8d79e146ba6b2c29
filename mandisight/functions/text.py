"""Text cleaning for speech (J1-J3) as ordered ``regexp_replace`` chains.

White space and digits are the Unicode ones: ``\\p{Nd}`` for digits, and the
characters that count as white space spelled out in ``ODD_SPACE`` (Java's
``\\s`` is ASCII unless a flag is set). ``(?d)`` makes ``.`` and ``^`` treat only a line
feed as a line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters of the reference's text patterns, but for the line feed and the space.
ODD_SPACE = r"[\x09\x0B-\x0D\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# What they have become when the steps below run.
WS = r"[ \n]"

# Markdown removal steps, in order (pattern, replacement).
MARKDOWN_STEPS = [
    (r"```[\s\S]*?```", ""),                      # fenced code blocks
    (r"(?d)`.*?`", ""),                           # inline code
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),            # [label](link) -> label
    (rf"(?dm)^{WS}*#+{WS}*", ""),                 # headings
    (r"\*\*|__|\*|_", ""),                        # bold / italic marks
    (rf"(?dm)^{WS}*[-*+]{WS}+", ""),              # bullet markers
    (rf"(?dm)^{WS}*\p{{Nd}}+\.{WS}+", ""),        # numbered markers
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text_for_speech(text, language_code) -> Column:
    """J1 + J2: markdown to plain text; Latin letters dropped for Telugu."""
    # All white space but line feeds ends as a plain space: made one at once, it keeps the patterns ASCII.
    t = F.regexp_replace(_c(text), ODD_SPACE, " ")
    for pattern, repl in MARKDOWN_STEPS:
        t = F.regexp_replace(t, pattern, repl)
    t = F.when(_c(language_code) == "te", F.regexp_replace(t, "[A-Za-z]+", "")).otherwise(t)
    t = F.trim(F.regexp_replace(t, f"{WS}+", " "))  # one plain space is all that is left at the ends
    return F.when(_c(text).isNull() | (_c(text) == ""), F.lit("")).otherwise(t)


def language_code(name) -> Column:
    """BCP-47 tag or language name -> te / hi / ta / en (default en).

    Tag tests run first (te, hi, ta, en), then name tests, as written.
    """
    low = F.lower(F.coalesce(_c(name), F.lit("")))
    out = F.lit("en")
    for code, word in reversed([("te", "telugu"), ("hi", "hindi"), ("ta", "tamil"), ("en", "english")]):
        out = F.when(low.contains(word), F.lit(code)).otherwise(out)
    for code in reversed(["te", "hi", "ta", "en"]):
        out = F.when(low.contains(f"{code}-") | (low == code), F.lit(code)).otherwise(out)
    return out
