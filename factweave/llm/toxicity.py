"""Toxic passages as maximum-scoring segments of token log-odds (operator 7)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import documents, plain_words, shingle_hashes, unused
from factweave.plans.staging import stage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Labelled rows that the model is fitted on, at most; they bound the tokens that come to the driver.
SAMPLE_ROWS = 200_000


@dataclass
class ToxicModel:
    """Scores of tokens and of all others, the extreme-value parameters, and the calibration of a document's score."""

    scores: dict[str, float]
    other: float
    lam: float
    k: float
    slope: float = 1.0
    offset: float = 0.0


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def segments(found: list[float], gaps: list[int], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa, 1999) of a sequence of token scores, in linear time.

    Given by the positions ``gaps`` of the tokens with scores ``found``; all other tokens score ``other`` (below 0).
    Returns first and last token and score.
    """
    out: list[list[float]] = []  # start, end, sum before, sum up to the end
    total, last = 0.0, -1
    for s, at in zip(found, gaps, strict=True):
        total += other * (at - last - 1)
        last = at
        before, total = total, total + s
        if s <= 0:
            continue
        seg = [at, at, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in out]


def passages(text: str | None, model: ToxicModel, alpha: float = 0.05) -> tuple[list[tuple[int, int, float]], float, int]:
    """Significant segments of a text, the evidence ``-ln p`` of all of it, and its number of tokens.

    A segment's score ``S`` has E-value ``K n exp(-lambda S)`` (Karlin and Altschul, 1990); it is significant if that is
    at most ``alpha``. The evidence adds ``lambda S - ln(K n)``, where positive, over segments, so it is length-corrected.
    """
    words = tokens(text)
    n, get = len(words), model.scores.get
    at = [i for i, w in enumerate(words) if w in model.scores]
    found = segments([get(words[i]) for i in at], at, model.other)
    base = math.log(max(model.k * n, 1e-9)) if n else 0.0
    bits = [(a, b, model.lam * s - base) for a, b, s in found]
    return [x for x in bits if x[2] >= -math.log(alpha)], sum(max(x[2], 0.0) for x in bits), n


def _karlin(scores: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """``lambda`` with ``E exp(lambda s) = 1`` and an upper bound of ``K`` for a distribution of negative mean."""
    if (scores * weights).sum() >= 0 or scores.max() <= 0:
        return 1.0, 1.0
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        if (weights * np.exp(np.minimum(mid * scores, 700))).sum() > 1:
            high = mid
        else:
            low = mid
    return low, float(min(1.0, max((weights[scores > 0]).sum(), 1e-9)))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", alpha: float = 0.05, effect: float = 1.0, strength: float = 0.01, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Token log-odds with an informative Dirichlet prior (Monroe et al., 2008), and the calibration of their segments.

    Learns from the labelled rows for which ``held_out``, a column over ``doc_id``, is false; if there are more than
    ``sample_rows``, from a sample by hash of about that size; near copies among them count once. Counts of texts that
    hold a token are made by Spark; its prior counts are ``strength`` times those it would have if it were neutral. A
    token keeps its log-odds if they are ``effect`` or more, either way, and too rare by chance at level ``alpha`` over
    all tokens; these come to the driver. All other tokens score a little below
    zero, so that chance segments stay short. Repeats of a doc_id in ``labels`` count by their largest label.
    Without labels of both kinds no token scores, and every score is 0.5 or less.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    share = min(1.0, sample_rows / max(1, marked.count()))
    # a uniform hash of the id, so that the sample is the same in each pass; its size bounds what is broadcast
    sample = marked.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # copies and near copies mostly share the least of their shingles' hashes; one of them speaks for all
    # (the words are a column of their own, or each shingle would make them again)
    worded = found.select("doc_id", "y", F.xxhash64("text").alias("own"), plain_words(F.col("text")).alias("words"))
    sketch = F.coalesce(F.array_min(shingle_hashes(F.col("words"), 5)), "own")
    single = stage(worded.select("doc_id", "y", sketch.alias("sketch")).groupBy("sketch").agg(F.min(F.struct("doc_id", "y")).alias("one")).select("one.*").distinct(), "toxic-sample")
    train = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(single), "doc_id").select("text", "y")
    rows = train.select("y", F.array_distinct(F.filter(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).alias("words"))
    counts = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    totals = rows.agg(F.sum(F.col("y") * F.size("words")).alias("pos"), F.sum((1 - F.col("y")) * F.size("words")).alias("neg")).first()
    n1, n0 = float(totals["pos"] or 0), float(totals["neg"] or 0)
    if not n1 or not n0:
        return ToxicModel({}, -0.1, 1.0, 1.0, 1.0, -1.0)
    n, base = F.col("pos") + F.col("neg"), n1 / (n1 + n0)
    prior = strength * n
    a, b = F.col("pos") + prior, F.col("neg") + prior * (n0 / n1)
    delta = F.log(a / b) + math.log(n0 / n1)
    share = F.col("pos") / n
    # Chernoff's bound on the chance of such a share among n texts, times the number of tokens
    surprise = n * (F.when(share > 0, share * F.log(share / base)).otherwise(0.0) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    bar = math.log(max(1, counts.count()) / alpha)
    kept = counts.select("w", delta.alias("delta"), surprise.alias("surprise"), n.alias("n")).where((F.col("surprise") >= bar) & (F.abs("delta") >= effect)).orderBy(F.col("surprise").desc(), "w").collect()
    scores = {r["w"]: float(r["delta"]) for r in kept}
    mass = np.array([r["n"] for r in kept], float) / (n1 + n0)
    values = np.array([r["delta"] for r in kept], float)
    drift = -max(0.05, 2.0 * float((mass * np.maximum(values, 0)).sum()))
    lam, k = _karlin(np.r_[values, drift], np.r_[mass, max(1 - mass.sum(), 0.0)])
    model = ToxicModel(scores, drift, lam, k)
    evidence = _evidence(model)
    seen = train.select("y", evidence("text").alias("x")).groupBy("y", F.round("x", 2).alias("x")).count().orderBy("x").collect()
    x = np.array([math.log1p(r["x"]) for r in seen])
    y, w = np.array([r["y"] for r in seen], float), np.array([r["count"] for r in seen], float)
    model.slope, model.offset = _logistic(x, y, w)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one value, by Newton's method with a little shrinkage; the slope is positive."""
    beta = np.array([0.0, 1.0])
    design = np.c_[np.ones_like(x), x]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 0.05 * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[1]), 1e-3), float(beta[0])


def _evidence(model: ToxicModel):
    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([passages(t, model)[1] for t in texts], dtype="float64")

    return evidence


NAMES = ("toxic_score", "toxic_passages", "n_toxic_passages")


def score_toxicity(docs: DataFrame, model: ToxicModel, alpha: float = 0.05, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1), ``toxic_passages`` (token spans with their evidence) and their number.

    Whole texts are scored, in one pass and without a shuffle. Null and empty texts have no passages and get the
    score of a text without evidence. Rows are scored each for itself; columns of these names, which ``names`` changes, are
    replaced; all others stay, whatever they are called.
    """

    @F.pandas_udf("struct<evidence:double,passages:array<struct<first:int,last:int,evidence:double>>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        got = [passages(t, model, alpha) for t in texts]
        return pd.DataFrame({"evidence": [float(x[1]) for x in got], "passages": [[{"first": a, "last": b, "evidence": float(s)} for a, b, s in x[0]] for x in got]})

    (seen,) = unused(docs, "scan")
    rows = docs.withColumn(seen, scan("text"))
    score_, found, count = names
    score = 1 / (1 + F.exp(-(model.slope * F.log1p(f"{seen}.evidence") + model.offset)))
    return rows.withColumns({score_: score, found: F.col(f"{seen}.passages"), count: F.size(f"{seen}.passages").cast("long")}).drop(seen)


def held_out_rows() -> Column:
    """Rows kept from learning: a fifth, by the id's checksum."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of four fifths."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out_rows())
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out_rows().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "n_toxic_passages")
