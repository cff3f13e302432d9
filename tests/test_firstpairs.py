"""The first pairs in order against all pairs."""

import random

from factweave.operators import detect, firstpairs
from factweave.plans import staging


def plain(rows, limit, fits=lambda a, b: True):
    order = sorted(rows)
    return [(a, b) for k, (a, x) in enumerate(order) for b, y in order[k + 1 :] if set(x) & set(y) and fits(a, b)][:limit]


def test_first_pairs(spark):
    r = random.Random(4)
    rows = [(3 * k, r.sample("abcdefghij", r.randint(0, 2)) + (["common"] if k > 40 else [])) for k in range(90)]
    df = spark.createDataFrame(rows, "ord long, tokens array<string>")
    for limit in (5, 60):
        assert [tuple(x) for x in firstpairs.first_pairs(df, limit, lot=4).collect()] == plain(rows, limit)
    few = lambda pairs: pairs.where("(ord_a + ord_b) % 30 = 0")  # noqa: E731  most are refused, so tokens are followed further
    assert [tuple(x) for x in firstpairs.first_pairs(df, 12, few).collect()] == plain(rows, 12, lambda a, b: (a + b) % 30 == 0)
    assert firstpairs.first_pairs(df.limit(0), 5).count() == 0
    rare = spark.createDataFrame(rows[:3], df.schema)
    assert [tuple(x) for x in firstpairs.first_pairs(rare, 50).collect()] == plain(rows[:3], 50)


def test_one_token_everywhere(spark, monkeypatch):
    """A hundred pairs of ten thousand rows that all share a token: only the first postings are read."""
    made = {}
    keep = staging.stage
    monkeypatch.setattr(firstpairs, "stage", lambda df, name: made.setdefault(name, keep(df, name)))
    monkeypatch.setattr(firstpairs, "release", lambda *tables: None)
    rows = spark.range(10_000).selectExpr("id as ord", "array('everywhere', concat('own', id)) as tokens")
    got = firstpairs.first_pairs(rows, 100).collect()
    assert [tuple(x) for x in got] == [(0, k) for k in range(1, 101)]
    assert made["pairs-met"].count() < 300


def test_claims_of_two_files(spark):
    claims = spark.createDataFrame([(1, "The limits are raised", "a"), (2, "a limit is raising", "a"), (3, "raised limiting", "b"), (4, "stuff", None), (5, "Stuff!", None), (6, "stuffs", "b"), (7, None, "c")], "ord long, text string, source_file string")
    for limit in (100, None):
        assert sorted(map(tuple, detect.claim_pairs(claims, limit).collect())) == [(1, 3), (2, 3), (4, 6), (5, 6)]
