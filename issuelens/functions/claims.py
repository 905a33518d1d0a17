"""What a sentence claims of a term: where words stand, what a negation reaches, and what is ruled out.

A sentence is an array of lower-case words. A negation reaches the terms behind it, as far as SCOPE words; "not" counts
only behind a form of be or have, so that "not less than" or "whether or not" deny nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wording import words_of

SCOPE = 40
AUXILIARIES = ("is", "are", "was", "were", "has", "have", "had", "been", "be", "does", "do", "did")


def word_list(text: Column) -> Column:
    """The words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(words_of(text), F.lit("")), " "), lambda w: w != "")


def _is(word: Column, wanted: str) -> Column:
    return F.coalesce(word.startswith(wanted[:-1]) if wanted.endswith("*") else word == wanted, F.lit(False))


def places(words: Column, *phrases: str) -> Column:
    """Where any of some phrases begins; a word that ends in * stands for all that begin so."""

    def begins(phrase: str) -> Callable[[Column, Column], Column]:
        wanted = phrase.split()

        def at(word: Column, i: Column) -> Column:
            met = _is(word, wanted[0])
            for k, w in enumerate(wanted[1:], 1):
                met = met & _is(F.get(words, i + k), w)
            return F.when(met, i)

        return at

    return F.array_compact(F.flatten(F.array(*[F.transform(words, begins(p)) for p in phrases])))


def has(places_: Column) -> Column:
    return F.size(places_) > 0


def behind(first: Column, then: Column, most: int, least: int = 1) -> Column:
    """Places of then that stand least to most words behind one of first."""
    return F.filter(then, lambda t: F.exists(first, lambda f: (t - f).between(least, most)))


def ahead(first: Column, then: Column, most: int, least: int = 1) -> Column:
    """Places of first that have one of then least to most words behind them."""
    return F.filter(first, lambda f: F.exists(then, lambda t: (t - f).between(least, most)))


def without(places_: Column, others: Column, most: int) -> Column:
    """places that have none of others in the most words before."""
    return F.filter(places_, lambda t: ~F.exists(others, lambda o: (t - o).between(1, most)))


def negations(words: Column) -> Column:
    """Where a negation stands: none, neither, never, or not behind a form of be or have."""
    return F.concat(places(words, "none", "neither", "never"), behind(places(words, *AUXILIARIES), places(words, "not"), 1))


def denied(words: Column, term: Column, scope: int = SCOPE) -> Column:
    """Is one of a term's places within the reach of a negation?"""
    return has(behind(negations(words), term, scope))
