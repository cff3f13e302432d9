"""Pairs met in cells against brute force; groups larger than a cell, groups related to others or to themselves."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from factweave.operators import cells, detect, pairs
from factweave.registry import QUERIES
from tests.test_library import nodes

driver.queries()


def test_meet_makes_each_pair_once(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice("aaaabbc")) for k in range(400)]
    related = [("a", "a", 1), ("b", "a", 2), ("c", "c", 3), ("b", "c", 4), ("d", "a", 5)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = cells.meet(df, spark.createDataFrame(related, "g1 string, g2 string, kind int"), met=20).select("x.id", F.col("y.id").alias("other"), "kind").collect()
    kinds = {frozenset((a, b)): k for a, b, k in related}
    want = {(frozenset((i, j)), kinds[frozenset((g, h))]) for (i, g), (j, h) in itertools.combinations(rows, 2) if frozenset((g, h)) in kinds}
    assert len(got) == len(want) and {(frozenset((r.id, r.other)), r.kind) for r in got} == want


def test_twins(spark):
    """Classes 0-4 are all related to each other, 5 and 6 to these alone; 7 to itself; the kind tells 4 from the others."""
    links = [(i, j, 1) for i, j in itertools.combinations_with_replacement(range(4), 2)] + [(4, j, 2) for j in range(5)] + [(i, j, 1) for i in (5, 6) for j in range(5)] + [(7, 7, 1)]
    groups, related = cells.twins(spark.createDataFrame(links, "cls long, other long, kind int"))
    of = {r.cls: r.g for r in groups.collect()}
    assert len({of[i] for i in range(4)}) == 1 and of[5] == of[6] and len(set(of.values())) == 4
    kinds = {frozenset((r.g1, r.g2)): r.kind for r in related.collect()}
    assert {(i, j): kinds.get(frozenset((of[i], of[j]))) for i in range(8) for j in range(i + 1) if frozenset((of[i], of[j])) in kinds} == {(max(i, j), min(i, j)): k for i, j, k in links}


def test_sets_of_many_members_are_compared_once(spark, monkeypatch):
    """two sets of 300 members each share two tokens of three; only the sets are joined by token, and their members in cells."""
    monkeypatch.setattr(cells, "MET", 64)
    rows = [(k, ["a", "b", "cd"[k % 2]]) for k in range(600)]
    seen = []
    shared = pairs.shared_sets
    monkeypatch.setattr(pairs, "shared_sets", lambda sets, *args: seen.append(sets.count()) or shared(sets, *args))
    got = pairs.overlap_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), 2).groupBy("shared").count().collect()
    assert seen == [2] and {r.shared: r["count"] for r in got} == {3: 2 * 300 * 299 // 2, 2: 300 * 300}


@pytest.mark.parametrize("name", ["same_entities", "fact_conflicts", "owner_conflicts", "correction_conflicts", "policy_conflicts", "number_conflicts"])
def test_pairs_are_not_shuffled(spark, name):
    """what makes the pairs is the join of cells, above which nothing is grouped, sorted or joined."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(plan) if "Join " in x)
    assert "__cell" in plan[first] and not any(w in x for x in plan[:first] for w in ("Aggregate", "Sort", "Window", "Repartition"))


def test_first_of_many_numbers(spark):
    """nodes with several numbers, whose first clash stands, beside nodes with one; a status code of the first node is none."""
    df = nodes(spark, [
        {"id": "b", "title": "API limits", "raw": "The API supports 20 users there. The API supports 700 requests for clients."},
        {"id": "a", "title": "API limits", "raw": "The API allows 20 users now. Another API allows 800 requests for clients. A third API serves 40 users daily."},
        {"id": "c", "title": "API limits", "raw": "The API serves 900 requests."},
        {"id": "d", "title": "API limits", "raw": "The status code API serves 500 requests."},
        {"id": "e", "title": "API limits", "raw": "The older API serves 910 requests."},
    ])
    got = {(r.a, r.b): (r.unit, r.value_a, r.value_b) for r in pairs.number_contradictions(df).collect()}
    assert got[("b", "a")] == ("user", 20.0, 40.0) and got[("a", "c")] == ("request", 800.0, 900.0) and got[("c", "d")] == ("request", 900.0, 500.0)
    assert ("d", "e") not in got and set(got) == {("b", "a"), ("b", "c"), ("b", "d"), ("b", "e"), ("a", "c"), ("a", "d"), ("a", "e"), ("c", "d"), ("c", "e")}


def test_completed_by_the_first_of_a_class(spark):
    """F8: many nodes of the same words; the own node is skipped, and only two of a class are looked at."""
    rows = [{"id": f"n{k}", "title": f"gateway migration billing {'shipped' if k % 2 else 'planned'}", "summary": f"x{k}"} for k in range(60)]
    bombs = spark.createDataFrame([("one", ["n1"], True, "warning"), ("two", ["n2"], True, "warning"), ("three", ["n3"], False, "warning")], "label string, node_ids array<string>, expired boolean, severity string")
    df = nodes(spark, rows).withColumn("title", F.concat("title", F.lit(" "), "id"))
    done = detect.completed_deadlines(bombs, df)
    assert {r.label: (r.completed_by, r.severity) for r in done.collect()} == {"one": ("gateway migration billing shipped n3", "info"), "two": ("gateway migration billing shipped n1", "info"), "three": (None, "warning")}
    assert not re.search(r"Aggregate \[label#\d+, id#", done._jdf.queryExecution().optimizedPlan().toString())  # shared words are not counted for each two nodes


def test_same_topic_totals(spark, monkeypatch):
    """the totals are those of the pairs, with several ranges of ids, and none is made but within a range."""
    rnd = random.Random(2)
    monkeypatch.setattr(pairs, "MET", 16)
    rows = [{"id": f"n{rnd.randint(0, 10**6)}-{k}", "title": rnd.choice(["large ring", "blue gear", "new rod"]), "raw": " ".join(rnd.sample("alpha beta gamma delta epsilon zeta eta theta".split(), rnd.randint(2, 6))), "source": rnd.choice(["a", "b", ""])} for k in range(120)]
    df = nodes(spark, rows)
    made = pairs.same_topic_pairs(df).join(df.select(F.col("id").alias("a"), "source_id"), "a").groupBy("source_id").count()
    assert {r.source_id: r.n for r in pairs.same_topic_totals(df).collect()} == {r.source_id: r["count"] for r in made.collect()}


def test_links_do_not_meet_at_entities(spark):
    """all nodes share an entity, and only near ones become pairs; without one, a link needs the nearest of the first."""
    vectors = [[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.7, 0.7, 0.0], [0.0, 0.0, 1.0], [0.0, 0.05, 1.0], [0.0, 0.08, 1.0]]
    rows = [{"id": f"n{k}", "title": f"t{k}", "entities": ["all"] if k < 3 else [f"e{k}"]} for k in range(6)]
    df = nodes(spark, rows).join(spark.createDataFrame([(f"n{k}", v) for k, v in enumerate(vectors)], "id string, embedding array<float>"), "id")
    links = pairs.propose_links(df, 2, block=2)
    assert {(r.a, r.b) for r in links.collect()} == {("n0", "n1"), ("n0", "n2"), ("n1", "n2"), ("n3", "n4"), ("n4", "n5")}
