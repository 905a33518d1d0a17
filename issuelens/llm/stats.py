"""Rule statistics of whole texts, shared by the quality rules and the quality classifier.

Counts are exact over the whole text; words are runs of anything but ASCII blanks. Null text counts as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import give_back
from .common import small_batches, text_bytes

COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_bars", "n_distinct", "longest")
_BLANKS = bytes([9, 10, 11, 12, 13, 32])
_TAIL = bytes(range(0x80, 0xC0))
_SYMBOLS, _UPPER, _DIGITS, _MARKS, _BARS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|"


def repeated_words(words: list) -> int:
    """Words that lie in a window of three that the list holds twice or more."""
    triples = list(zip(words, words[1:], words[2:]))
    if len(set(triples)) == len(triples):
        return 0
    seen, again = set(), set()
    for t in triples:
        (again if t in seen else seen).add(t)
    covered = bytearray(len(words))
    for i, t in enumerate(triples):
        if t in again:
            covered[i : i + 3] = b"\x01\x01\x01"
    return sum(covered)


def counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    has = lambda of: size - len(text.translate(None, of))
    return (
        len(text.translate(None, _TAIL)), len(words), len(text.translate(None, _TAIL + _BLANKS)), has(_SYMBOLS), len(lines), len(lines) - len(set(lines)),
        repeated_words(words), has(_UPPER), has(_DIGITS), has(_MARKS), has(_BARS), len(set(words)), max(map(len, words), default=0),
    )


def _counts(texts: pd.Series) -> pd.DataFrame:
    rows = [counts(t) for t in texts]
    give_back()
    return pd.DataFrame(rows, columns=list(COUNTS))


def with_counts(docs: DataFrame, column: str = "text", out: str = "stats") -> DataFrame:
    """docs and a struct column of COUNTS."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))(text_bytes(column)))


def features(of: str = "stats") -> dict[str, Column]:
    """Ratios of the counts, by name: what trees and forests split on."""
    c = lambda name: F.col(f"{of}.{name}").cast("double")
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return {
        "words": F.log1p(c("n_words")),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "line_words": F.log1p(per("n_words", "n_lines")),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "marks": per("n_marks", "n_words"),
        "bars": per("n_bars", "n_words"),
        "distinct": per("n_distinct", "n_words"),
        "longest": F.log1p(c("longest")),
    }
