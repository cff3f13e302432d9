"""Exact nearest vectors by inverted lists: rings around coarse centroids that the triangle inequality rules out are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.plans.staging import stage

#: Vectors that the centroids are made from, at most, and centroids and rings, at most.
SAMPLE, CENTROIDS, RINGS = 16_384, 1_024, 16_384
#: Numbers of the vectors that one task has on a side, at most, but for a ring.
CELL = 4_194_304
#: Of an angle, for rounding.
SLACK = 1e-6


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def centroids(vectors: DataFrame, n: int, steps: int = 6) -> np.ndarray:
    """Directions around which the vectors gather: k-means by cosine on a hash sample of at most ``SAMPLE`` of them."""
    wanted = max(1, min(CENTROIDS, int(np.sqrt(n))))
    share = min(1.0, SAMPLE / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("did"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))).orderBy("did").limit(SAMPLE).select("embedding").collect()
    x = _unit([r["embedding"] for r in rows])
    c = x[np.linspace(0, len(x) - 1, min(wanted, len(x))).astype(int)]
    for _ in range(steps):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def knn_lists(nodes: DataFrame, k: int, min_similarity: float | None = None, block: int = 4096) -> tuple[DataFrame, float]:
    """Exact nearest neighbours by cosine, self included: ``id, other, similarity, rank``; and the share of ring pairs that were skipped.

    Equal vectors are searched once and expanded to their ids, the first ``k`` of each. A vector belongs to the list of its nearest centroid,
    and in it to a ring of about ``block`` vectors by its angle from there. Each ring first meets itself, which bounds the angle of
    a vector's ``k``-th neighbour; angles obey the triangle inequality, so of the other rings only those are read that can
    hold a nearer one. Rings are dealt to cells of many on both sides, so a ring is sent once for each cell, not for each ring it meets, and a cell
    gives the best of a vector, not those of each ring. All directions alike (no clusters, many dimensions) rule out little: then most rings meet, as in ``knn``.
    Ties go by id, a vector itself first. Nodes without a vector are left out; a vector of zeros has cosine 0 with all, and is far from none.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    spark = nodes.sparkSession
    given = nodes.select("id", "embedding").where("embedding is not null and size(embedding) > 0")
    spread = given.groupBy("embedding", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k).alias("ids"))
    same = stage(spread.groupBy("embedding").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k).alias("ids")).withColumn("did", F.element_at("ids", 1)), "knn-vectors")
    n = same.count()
    if not n:
        return spark.createDataFrame([], f"id {kind}, other {kind}, similarity double, rank int"), 0.0
    middle = centroids(same, n)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a = _angles(_unit(b["embedding"]), middle)
                near = a.argmin(axis=1)
                yield pd.DataFrame({"did": b["did"].astype(object), "embedding": b["embedding"], "list": near, "angle": a[np.arange(len(a)), near]})

    placed = stage(same.select("did", "embedding").mapInPandas(assign, f"did {kind}, embedding {same.schema['embedding'].dataType.simpleString()}, list long, angle double"), "knn-placed")
    each = max(block, n // RINGS + 1)
    place = F.row_number().over(Window.partitionBy("list").orderBy("angle", "did"))
    rings = placed.withColumn("ring", F.concat_ws("-", "list", F.floor((place - 1) / each)))
    rings = stage(rings.groupBy("ring").agg(F.first("list").alias("list"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.collect_list(F.struct("did", "embedding")).alias("rows")), "knn-rings")
    marks = rings.select("ring", "list", "low", "high").orderBy("ring").collect()
    names, lists = [m["ring"] for m in marks], np.array([m["list"] for m in marks])
    low, high = np.array([m["low"] for m in marks]), np.array([m["high"] for m in marks])

    def tops(ids: list, others: list, s: np.ndarray) -> pd.DataFrame:
        """The ``k`` best of each row; all that tie with the last stay, for the order by id."""
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else np.full((len(s), 1), -2.0)
        a, b = np.nonzero(s >= kth - 1e-12)
        return pd.DataFrame({"did": pd.Series(np.array(ids, object)[a], dtype=object), "other": pd.Series(np.array(others, object)[b], dtype=object), "similarity": s[a, b]})

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each ring with itself, and where each of its vectors must look besides."""
        for batch in batches:
            for ring, cells in zip(batch["ring"], batch["rows"], strict=True):
                x = _unit([c["embedding"] for c in cells])
                s = x @ x.T
                found = tops([c["did"] for c in cells], [c["did"] for c in cells], s)
                yield found.astype(object).assign(ring=None, into=None)
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(s), -1.0)
                reach = np.arccos(np.clip(kth, -1.0, 1.0)) + SLACK
                reach[np.linalg.norm(x, axis=1) == 0] = 10.0
                to = _angles(x, middle)
                needed = np.zeros(len(names), bool)
                for i in range(0, len(x), 256):
                    a = to[i : i + 256][:, lists]
                    needed |= (np.maximum(a - high, low - a) <= reach[i : i + 256, None]).any(axis=0)
                into = [names[j] for j in np.flatnonzero(needed) if names[j] != ring]
                yield pd.DataFrame({"did": None, "other": None, "similarity": None, "ring": ring, "into": into}, dtype=object)

    first = stage(rings.select("ring", "rows").mapInPandas(own, f"did {kind}, other {kind}, similarity double, ring string, into string"), "knn-first")
    todo = first.where("ring is not null").select("ring", "into")
    skipped = 1.0 - (todo.count() + len(names)) / len(names) ** 2

    dim = len(same.select("embedding").first()["embedding"])
    chunks = max(1, -(-n // max(each, CELL // dim)))
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks))
    left = todo.groupBy("ring", chunk("into").alias("q")).agg(F.collect_list("into").alias("into")).withColumn("p", chunk("ring")).join(rings.select("ring", F.col("rows").alias("mine")), "ring")
    right = todo.select(chunk("ring").alias("p"), "into").distinct().withColumn("q", chunk("into")).join(rings.select(F.col("ring").alias("into"), F.col("rows").alias("theirs")), "into")

    def best_of(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows ``a``, those that are as good as the ``k``-th of their row."""
        at = np.lexsort((-s, a))
        a, b, s = a[at], b[at], s[at]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.array([], int)
        size = np.diff(np.r_[start, len(a)])
        bound = np.repeat(np.where(size >= k, s[np.minimum(start + k - 1, max(len(s) - 1, 0))], -2.0), size)
        kept = s >= bound - 1e-12
        return a[kept], b[kept], s[kept]

    def meet(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """The rings of one chunk with those of another that they need."""
        of = {name: ([c["did"] for c in cells], _unit([c["embedding"] for c in cells])) for name, cells in zip(others["into"], others["theirs"], strict=True)}
        out = []
        for into, cells in zip(mine["into"], mine["mine"], strict=True):
            ids, x = np.array([c["did"] for c in cells], object), _unit([c["embedding"] for c in cells])
            own_s = x @ x.T
            reach = np.partition(own_s, own_s.shape[1] - k, axis=1)[:, own_s.shape[1] - k] if own_s.shape[1] >= k else np.full(len(x), -2.0)
            found, names_of, held = [np.array([], int), np.array([], int), np.array([])], [], 0
            for name in into:
                other, y = of[name]
                s = x @ y.T
                a, b = np.nonzero(s >= reach[:, None] - 1e-12)
                found = [np.r_[p, q] for p, q in zip(found, (a, b + held, s[a, b]), strict=True)]
                names_of += other
                held += len(other)
                if len(found[0]) > 8 * k * len(x):
                    found = list(best_of(*found))
            a, b, s = best_of(*found)
            out.append(pd.DataFrame({"did": pd.Series(ids[a], dtype=object), "other": pd.Series(np.array(names_of, object)[b] if len(b) else [], dtype=object), "similarity": s}))
        return pd.concat(out) if out else pd.DataFrame({"did": [], "other": [], "similarity": []})

    pairs = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, f"did {kind}, other {kind}, similarity double")
    met = first.where("ring is null").select("did", "other", "similarity").unionByName(pairs)
    # the best vectors of each vector, then the ids that have these; a vector's own ids all have the same best
    best = met.withColumn("place", F.rank().over(Window.partitionBy("did").orderBy(F.desc(F.round("similarity", 12))))).where(F.col("place") <= k)
    many = best.join(same.select(F.col("did").alias("other"), "ids"), "other").select("did", F.round("similarity", 12).alias("similarity"), F.explode("ids").alias("other"))
    near = many.withColumn("place", F.row_number().over(Window.partitionBy("did").orderBy(F.desc("similarity"), "other"))).where(F.col("place") <= k + 1)
    ids = given.join(same.select("embedding", "did"), "embedding").select("id", "did")
    hits = ids.join(near.groupBy("did").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))).alias("near")), "did")
    # an id that isn't among the first of its own vector's ids takes the place of the last of them
    own_s = F.try_element_at(F.filter(F.col("near"), lambda x: x["other"] == F.col("did")), F.lit(1))["s"]
    rest = F.filter("near", lambda x: x["other"] != F.col("id"))
    ranked = F.slice(F.concat(F.filter(rest, lambda x: x["s"] < F.col("s0")), F.array(F.struct(F.col("s0").alias("s"), F.col("id").alias("other"))), F.filter(rest, lambda x: x["s"] >= F.col("s0"))), 1, k)
    out = hits.withColumn("s0", F.coalesce(own_s, F.lit(0.0))).select("id", F.posexplode(ranked).alias("rank", "x"))
    out = out.select("id", F.col("x.other").alias("other"), (-F.col("x.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))
    return (out if min_similarity is None else out.where(F.col("similarity") >= min_similarity)), skipped
