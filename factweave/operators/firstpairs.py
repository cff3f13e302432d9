"""The first pairs in order, out of all that share a token: read from sorted postings that stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.plans.staging import release, stage

#: Items whose pairs are looked for first, and how the number grows.
FIRST, GROWTH, MOST = 16, 4, 4096


def first_pairs(rows: DataFrame, limit: int, allowed: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, lot: int = FIRST) -> DataFrame:
    """``ord_a, ord_b``: the first ``limit`` pairs, ``ord_a < ord_b``, in this order, of ``rows (ord, tokens)`` that share a token and are ``allowed``.

    The first items meet so many of the next items of each of their tokens as could be wanted: what a token has beyond is
    not read (the tokens that are broadcast are those of one lot of at most ``MOST`` items), so a token that every row has costs no more than its first rows. An item's pairs are sure up to where the
    first of its tokens was cut; if these are too few, the token is followed further. ``allowed`` takes and gives pairs ``ord_a, ord_b``.
    Items without tokens have no pairs; ``ord`` is a number of its own for each row.
    """
    tokens = stage(rows.select(F.col("ord").cast("long").alias("ord"), F.explode(F.array_distinct("tokens")).alias("token")), "pairs-tokens")
    items = stage(tokens.select("ord").distinct(), "pairs-items")
    found: list[tuple[int, int]] = []
    after, depth = None, 2 * limit
    while len(found) < limit:
        ahead = items if after is None else items.where(F.col("ord") > after)
        ids = [r["ord"] for r in ahead.orderBy("ord").limit(lot).collect()]
        if not ids:
            break
        mine = stage(tokens.where(F.col("ord").between(ids[0], ids[-1])).select(F.col("ord").alias("ord_a"), "token"), "pairs-mine")
        place = F.row_number().over(Window.partitionBy("token").orderBy("ord"))
        met = tokens.where(F.col("ord") > ids[0]).join(F.broadcast(mine.select("token").distinct()), "token", "left_semi")
        met = stage(met.withColumn("place", place).where(F.col("place") <= depth + 1), "pairs-met")
        cut = met.where(F.col("place") == depth + 1).select("token", F.col("ord").alias("cut"))
        bound = mine.join(cut, "token").groupBy("ord_a").agg(F.min("cut").alias("cut"))
        pairs = mine.join(met.where(F.col("place") <= depth), "token").where("ord > ord_a").select("ord_a", F.col("ord").alias("ord_b")).distinct()
        sure = allowed(pairs).join(bound, "ord_a", "left").where("cut is null or ord_b < cut")
        got = [(r["ord_a"], r["ord_b"]) for r in sure.orderBy("ord_a", "ord_b").limit(limit - len(found)).collect()]
        unsure = bound.agg(F.min("ord_a").alias("a")).first()["a"]
        release(mine, met)
        if unsure is None:
            found += got
            after, lot = ids[-1], min(lot * GROWTH, MOST)
            continue
        upto = [p for p in got if p[0] <= unsure]
        if len(found) + len(upto) >= limit:
            found += upto
            break
        # the first item that was cut comes again, alone at first, with its tokens followed further
        found += [p for p in upto if p[0] < unsure]
        after, depth, lot = unsure - 1, depth * 8, FIRST
    release(tokens, items)
    return rows.sparkSession.createDataFrame(found[:limit], "ord_a long, ord_b long")
