"""Secret scan: three fixed patterns, then character Markov models compared by log-likelihood ratio.

The models are first-order chains over the characters that keys are made of. The random ones learn from labelled samples of
random strings, one chain a kind of key (the samples of RANDOM and what the patterns capture in the corpus); the ordinary
one learns from everything else in the corpus. A token is a secret if the mean likelihood of the random chains is so many
times that of the ordinary one that the posterior odds reach FALSE_ALARM: the prior odds are the corpus's own, captures over
tokens. Where a token as a whole isn't one, its pieces between separators are tested. Each task sums its pairs, so what is
gathered is one table of PAIRS counts a label, from all texts.

Defined cases: null text is empty and has no span; spans are code points, end exclusive; overlapping spans of different
kinds all stand; what a pattern leaves of a token is tested by itself; tokens without a letter are never tested; rows that
repeat are scanned once each; an empty table gives an empty result; a column secrets of the input is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "model")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
PIECE = re.compile(r"[A-Za-z0-9]{12,}")
LETTER = re.compile(r"[A-Za-z]")
SIDE = len(ALPHABET) + 1
PAIRS = SIDE * SIDE
CLASS = np.zeros(256, np.uint16)
CLASS[[ord(c) for c in ALPHABET]] = np.arange(1, SIDE)
#: Alphabets of keys in common use; random strings over each are the labelled samples of random strings.
RANDOM = {"base16": ALPHABET[26:32] + ALPHABET[52:62], "base32": ALPHABET[:26] + "234567", "upper": ALPHABET[:26] + ALPHABET[52:62], "lower": ALPHABET[26:62], "base62": ALPHABET[:62], "base64": ALPHABET[:64], "url64": ALPHABET[:62] + "_-"}
SAMPLES, SAMPLE_LENGTH = 4000, 32
#: A false alarm counts as much as so many misses.
FALSE_ALARM = 1000.0
#: Weight of the law of single characters in the rows of a model, in samples.
SMOOTH = 40.0
FOUND = "n_assign long, n_access long, n_hex long, n_model long, spans array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the three patterns find, by start."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pairs(raw: bytes) -> np.ndarray:
    c = CLASS[np.frombuffer(raw, np.uint8)].astype(np.int64)
    return np.bincount(c[:-1] * SIDE + c[1:], minlength=PAIRS) if len(c) > 1 else np.zeros(PAIRS, np.int64)


def random_samples(seed: int = 20240611) -> dict[str, list[str]]:
    """Random strings by kind of key: the same in every run."""
    rng = np.random.default_rng(seed)
    return {kind: ["".join(x) for x in rng.choice(list(alphabet), (SAMPLES, SAMPLE_LENGTH))] for kind, alphabet in RANDOM.items()}


def sample_counts(docs: DataFrame) -> DataFrame:
    """pair, label (1: captured by a pattern), n: pairs of neighbouring characters in all texts of docs; pair -1 counts tokens and captures."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, tokens = np.zeros((2, PAIRS), np.int64), [0, 0]
        for batch in batches:
            for text in batch["text"]:
                spans = base_spans(text)
                secret = b"\n".join(text[a:b].encode("utf-8", "replace") for a, _, b in spans)
                known = _pairs(secret) if secret else 0
                total[1] += known
                total[0] += _pairs(text.encode("utf-8", "replace")) - known
                tokens[0] += sum(1 for _ in TOKEN.finditer(text))
                tokens[1] += len(spans)
        label, pair = np.nonzero(total)
        yield pd.DataFrame({"pair": np.append(pair, [-1, -1]), "label": np.append(label, [0, 1]), "n": np.append(total[label, pair], tokens)})

    small_batches(docs.sparkSession)
    return docs.select(text_or_empty().alias("text")).mapInPandas(count, "pair long, label long, n long").groupBy("pair", "label").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Models:
    """Logarithms of the laws of pairs: of each random chain (kinds, SIDE, SIDE), and of the ordinary one; and the ratio that a secret needs."""

    random: np.ndarray
    ordinary: np.ndarray
    margin: float

    def ratio(self, token: str) -> float:
        """Natural logarithm of the mean likelihood of the random chains over that of the ordinary one."""
        c = CLASS[np.frombuffer(token.encode(), np.uint8)]
        a, b = c[:-1], c[1:]
        return float(np.logaddexp.reduce(self.random[:, a, b].sum(1)) - np.log(len(self.random)) - self.ordinary[a, b].sum())

    def secret(self, token: str) -> bool:
        return LETTER.search(token) is not None and self.ratio(token) >= self.margin


def _law(n: np.ndarray) -> np.ndarray:
    """log P(next | character) from counts of pairs, backed off to single characters."""
    n = n.reshape(SIDE, SIDE)[:, 1:].astype(np.float64)
    single = (n.sum(0) + 0.5) / (n.sum() + 0.5 * (SIDE - 1))
    law = np.zeros((SIDE, SIDE))
    law[:, 1:] = np.log((n + SMOOTH * single) / (n.sum(1, keepdims=True) + SMOOTH))
    return law


def fit(counts: DataFrame, samples: dict[str, list[str]] | None = None) -> Models:
    """counts, as of sample_counts, has PAIRS rows a label at most; samples: random strings by kind."""
    n, tokens = np.zeros((2, PAIRS)), [0, 0]
    for r in counts.collect():
        if r["pair"] < 0:
            tokens[r["label"]] = r["n"]
        else:
            n[r["label"], r["pair"]] = max(0, r["n"])
    chains = [sum(_pairs(x.encode()) for x in strings) for strings in (random_samples() if samples is None else samples).values()]
    if n[1].any():
        chains.append(n[1])
    odds = (tokens[1] + 0.5) / (tokens[0] + 0.5)
    return Models(np.stack([_law(c) for c in chains]), _law(n[0]), float(np.log(FALSE_ALARM) - np.log(min(odds, 1.0))))


def model_spans(text: str, models: Models, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens, without what is taken, that the models tell for secrets; else such pieces of them."""
    found = []
    for m in TOKEN.finditer(text):
        parts, at = [], m.start()
        for a, b in sorted(x for x in taken if x[0] < m.end() and m.start() < x[1]):
            parts.append((at, a))
            at = max(at, b)
        for a, b in [*parts, (at, m.end())]:
            if b - a < 12:
                continue
            if models.secret(text[a:b]):
                found.append((a, b))
            else:
                found += [p.span() for p in PIECE.finditer(text, a, b) if p.span() != (a, b) and models.secret(p.group())]
    return found


def scanner(models: Models):
    """A column function: text to n_assign, n_access, n_hex, n_model and spans."""

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = base_spans(text)
            n = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
            more = model_spans(text, models, [(a, b) for a, _, b in spans])
            spans += [(a, 3, b) for a, b in more]
            rows.append((*n, len(more), [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)]))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_model", "spans"])

    return scan


def _redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text with its spans replaced by [SECRET]; touching or overlapping spans give one mark."""
    out = []
    for text, found in zip(texts, spans):
        parts, at = [], 0
        for s in found:
            if s["start"] >= at:
                parts += [text[at : s["start"]], "[SECRET]"]
            at = max(at, s["end"])
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out)


def _digest(spans: pd.Series) -> pd.DataFrame:
    rows = []
    for found in spans:
        said = [f"{s['kind']}:{s['start']}:{s['end']}" for s in found]
        rows.append((hashlib.sha256(",".join(x for x in said if not x.startswith("model:")).encode()).hexdigest(), ",".join(said)))
    return pd.DataFrame(rows, columns=["base_sha256", "spans"])


def digest(spans: Column) -> Column:
    """base_sha256 and spans as the strings kind:start:end, comma-joined."""
    return F.pandas_udf(_digest, "base_sha256 string, spans string")(spans)


def scan_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """docs and a struct column secrets (counts by kind, and spans). models: trained ones; learned from docs if None."""
    models = fit(sample_counts(docs)) if models is None else models
    return docs.withColumn("secrets", scanner(models)(text_or_empty()))


def without_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """docs with every secret in text replaced by [SECRET]; null texts stay null."""
    models = fit(sample_counts(docs)) if models is None else models
    clean = F.pandas_udf(_redact, "string")(text_or_empty(), scanner(models)(text_or_empty())["spans"])
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))
