"""Numbers: similarity, authority, rewards, health scores, answer metrics. Built-in functions unless said otherwise."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions.lazy import arrow_udf

# Weights of roles, source kinds and signals.
ROLE_WEIGHTS = {"executive": 1.0, "director": 0.9, "manager": 0.8, "lead": 0.75, "engineer": 0.6, "analyst": 0.6, "bot": 0.3, "unknown": 0.5}
SOURCE_WEIGHTS = {"confluence": 0.9, "notion": 0.85, "google_docs": 0.8, "sharepoint": 0.8, "github": 0.7, "slack": 0.4, "email": 0.5, "unknown": 0.5}
HALF_LIFE_DAYS = 180.0
SIGNALS = {
    "accepted": ("positive", 0.3),
    "rejected": ("negative", 0.6),
    "corrected": ("negative", 0.9),
    "escalated": ("negative", 0.5),
    "shared": ("positive", 0.8),
    "follow_up": ("neutral", 0.1),
    "emoji_positive": ("positive", 0.4),
    "emoji_negative": ("negative", 0.5),
    "reply_positive": ("positive", 0.5),
    "reply_negative": ("negative", 0.6),
}
SEVERITIES = ("info", "warning", "critical")
# Words of denial.
NEGATIONS = "not no never none neither nor nothing nowhere nobody don't doesn't didn't won't wouldn't shouldn't couldn't isn't aren't wasn't weren't cannot".split()


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _lookup(table: dict, key: Column, default) -> Column:
    found = F.lit(default)
    for k, v in table.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero norm, for empty arrays and for unequal lengths."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def recency(modified: Column, as_of: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """Halves every ``half_life_days``; no date: 0.5; the future: 1."""
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(modified)) / 86400.0
    return F.when(modified.isNull(), 0.5).when(days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), days / half_life_days))


def authority(role: Column, source_type: Column, modified: Column, as_of: Column) -> Column:
    """0.4 role, 0.3 kind of source, 0.3 recency; unknown names weigh as 'unknown'."""
    r = _lookup(ROLE_WEIGHTS, F.lower(role), ROLE_WEIGHTS["unknown"])
    s = _lookup(SOURCE_WEIGHTS, F.lower(source_type), SOURCE_WEIGHTS["unknown"])
    return clamp01(0.4 * r + 0.3 * s + 0.3 * recency(modified, as_of))


def authority_multiplier(a: Column, b: Column) -> Column:
    return 2 * clamp01(0.5 + F.greatest(a, b) + 0.5 * F.least(a, b))


def adjust_severity(severity: Column, multiplier: Column) -> Column:
    """Severity's rank times the multiplier, rounded, within the scale."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    at = F.greatest(F.lit(1), F.least(F.lit(3), round_half_up(rank * multiplier)))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), at.cast("int"))


def reward(signal_type: Column, reputation: Column) -> Column:
    """``struct<kind, value>`` of a signal: its weight times the user's reputation."""
    return F.struct(
        _lookup({k: v[0] for k, v in SIGNALS.items()}, signal_type, "neutral").alias("kind"),
        clamp01(_lookup({k: v[1] for k, v in SIGNALS.items()}, signal_type, 0.0) * reputation).alias("value"),
    )


def words_of(c: Column) -> Column:
    """Lower-case words of more than two characters, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda w: F.length(w) > 2)


def keyword_accuracy(expected: Column, answer: Column) -> Column:
    """Share of the expected words, repeats counted, that the answer has; no words: 1."""
    e, a = words_of(expected), words_of(answer)
    return F.when(F.size(e) == 0, 1.0).otherwise(F.size(F.filter(e, lambda w: F.array_contains(a, w))) / F.size(e))


def keyword_reward(expected: Column, completion: Column) -> Column:
    """Share of the distinct expected words that a completion has; no words: 0."""
    e, a = F.array_distinct(words_of(expected)), words_of(completion)
    return F.when(F.size(e) == 0, 0.0).otherwise(F.size(F.array_intersect(e, a)) / F.size(e))


def negation_conflict(expected: Column, answer: Column) -> Column:
    """Whether an answer shares a word of over three characters with what is expected and has a negation."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_']+"), lambda w: w != "")
    subject, said = F.filter(words(expected), lambda w: (F.length(w) > 3) & ~w.isin(NEGATIONS)), words(answer)
    return F.arrays_overlap(subject, said) & F.exists(said, lambda w: w.isin(NEGATIONS))


def key_fact_score(facts: Column, answer: Column) -> Column:
    """Share of the key facts that the answer contains, whatever their case; no facts: 0."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(F.size(facts) == 0, 0.0).otherwise(F.size(F.filter(facts, lambda f: low.contains(F.lower(f)))) / F.size(facts))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, row by row of a table held in one array."""
    if not a or not b:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    x, y = [ids[w] for w in a], np.array([ids[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == w, row[:-1] + 1, 0)))
    return int(row[-1])


@arrow_udf("double")
def lcs_f1(expected: pd.Series, answer: pd.Series) -> pd.Series:
    """F1 over the longest common subsequence of words (Arrow batches, a table row per word)."""
    out = []
    for e, a in zip(expected, answer, strict=True):
        x, y = (re.findall(r"[a-z0-9]+", (t or "").lower()) for t in (e, a))
        n = _lcs(x, y)
        out.append(0.0 if not n else 2 * (n / len(y)) * (n / len(x)) / (n / len(y) + n / len(x)))
    return pd.Series(out, dtype="float64")


def median_int(values: Column) -> Column:
    """Median of an array of whole numbers; of two middle ones their mean, rounded half up."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.try_element_at(s, F.floor((n + 1) / 2).cast("int")), F.try_element_at(s, F.floor(n / 2 + 1).cast("int"))
    return F.when(n % 2 == 1, low).otherwise(round_half_up((low + high) / 2))
