"""Greedy choices in rounds against the walk, row by row."""

import random
import re

import pytest
from pyspark.sql import functions as F

import factweave.queries_more  # noqa: F401  registers its queries
from factweave.functions import text
from factweave.operators import detect, evaluate, greedy
from factweave.registry import QUERIES

SF = "/root/testdata/sf0.001"


def walk(order, near, least):
    gone, out = set(), set()
    for u in order:
        if u not in gone:
            took = {v for v in near[u] if v not in gone}
            if len(took) >= least:
                gone |= took | {u}
                out |= {(u, x) for x in took | {u}}
    return out


def graph(seed):
    """One giant component: a ring, chords, and a group in which all are near each other."""
    r = random.Random(seed)
    ids = [f"n{k}" for k in range(70)]
    r.shuffle(ids)
    edges = {(ids[k], ids[k - 1]) for k in range(70)} | {tuple(r.sample(ids, 2)) for _ in range(30)} | {(a, b) for a in ids[:12] for b in ids[:12] if a != b}
    near = {i: set() for i in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    order = sorted(ids)
    r.shuffle(order)
    return order, near


@pytest.mark.parametrize("least,local_links", [(0, 0), (2, 0), (2, 10**6)])
def test_take_in_order(spark, least, local_links):
    for seed in range(1):
        order, near = graph(seed)
        links = spark.createDataFrame([(a, b) for a in near for b in near[a]], "u string, v string")
        pick = lambda left, right: links.join(left.withColumnRenamed("id", "u"), "u", "left_semi").join(right.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")  # noqa: E731,B023
        items = spark.createDataFrame([(x, k) for k, x in enumerate(order)], "id string, at long")
        got = greedy.take_in_order(items, pick, least, local_links).collect()
        assert {(r.leader, r.id) for r in got} == walk(order, near, least) and len(got) == len(set(got))
    assert greedy.take_in_order(items.limit(0), pick, least, local_links).count() == 0


def plain_match(left, right, links):
    used, out = set(), {}
    for d, c in sorted((at, c) for c, at in left):
        for t, o in sorted((at, o) for o, at in right):
            if t not in used and (c, o) in links:
                used.add(t)
                out[c, o] = out.get((c, o), 0) + 1
                break
    return out


def test_match_in_order(spark):
    r = random.Random(5)
    for _ in range(1):
        left = [(f"c{r.randint(0, 4)}", k) for k in range(40)]
        right = [(f"t{r.randint(0, 5)}", k) for k in range(30)]
        links = {(f"c{r.randint(0, 4)}", f"t{r.randint(0, 5)}") for _ in range(10)}
        got = greedy.match_in_order(spark.createDataFrame(left, "cls string, at long"), spark.createDataFrame(right, "other string, at long"), spark.createDataFrame(list(links), "cls string, other string"))
        assert {(x.cls, x.other): x.n for x in got.groupBy("cls", "other").agg(F.sum("n").alias("n")).collect()} == plain_match(left, right, links)


@pytest.mark.parametrize("local_links", [0, 12])
def test_match_leaves_used_links(spark, monkeypatch, local_links):
    """a round reads the links that the one before left open; the last are walked, where they are few enough."""
    r = random.Random(8)
    left = [(f"c{r.randint(0, 9)}", k) for k in range(60)]
    right = [(f"t{r.randint(0, 9)}", k) for k in range(50)]
    links = {(f"c{r.randint(0, 9)}", f"t{r.randint(0, 9)}") for _ in range(30)}
    seen, walked, walk, keep = [], [], greedy._match, greedy.stage
    monkeypatch.setattr(greedy, "_match", lambda *a: walked.append(len(a[2])) or walk(*a))
    monkeypatch.setattr(greedy, "stage", lambda df, name: (lambda out: (seen.append(out.count()) if name == "match-open" else None, out)[1])(keep(df, name)))
    got = greedy.match_in_order(spark.createDataFrame(left, "cls string, at long"), spark.createDataFrame(right, "other string, at long"), spark.createDataFrame(list(links), "cls string, other string"), local_links)
    assert {(x.cls, x.other): x.n for x in got.groupBy("cls", "other").agg(F.sum("n").alias("n")).collect()} == plain_match(left, right, links)
    assert seen == sorted(seen, reverse=True) and all(n <= local_links for n in walked) and (len(walked) == 1 or not local_links)


def words(headline):
    return set(re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", headline.lower())).strip().split(" "))


def plain_consensus(rows, passes):
    clusters = []
    for r in sorted(rows, key=lambda r: (r["pass_index"], r["ord"])):
        for c in clusters:
            a, b = words(c[0]["headline"]), words(r["headline"])
            j = len(a & b) / len(a | b)
            if c[0]["category"] == r["category"] and (j >= 0.5 or (j >= 0.3 and set(c[0]["docs"]) & set(r["docs"]))):
                c.append(r)
                break
        else:
            clusters.append([r])
    out = []
    for c in clusters:
        votes = len({r["pass_index"] for r in c})
        if votes >= -(-passes // 2):
            rank = sorted({"info": 0, "warning": 1, "critical": 2}.get(r["severity"], 0) for r in c)
            best = max(c, key=lambda r: (len(r["headline"]), -r["pass_index"], -r["ord"]))["headline"]
            out.append((c[0]["category"], (c[0]["pass_index"] << 40) + c[0]["ord"], votes, ("info", "warning", "critical")[rank[len(rank) // 2]], best, len({d for r in c for d in r["docs"]})))
    return sorted(out)


def test_agreed_headlines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", F.array_join(F.slice(F.split("text", r"\s+"), 1, 9), " ").alias("h")).collect()
    rows = [{"category": r.lang, "pass_index": r.doc_id % 3, "ord": r.doc_id, "severity": ("info", "warning", "critical")[r.doc_id % 3], "headline": r.h, "docs": [r.source]} for r in docs]
    want = plain_consensus(rows, 3)
    assert want and sorted(map(tuple, QUERIES["agreed_headlines"](spark, SF).collect())) == want


def test_consensus_of_made_findings(spark):
    """Headlines without letters, of one template, and with documents that decide."""
    r = random.Random(2)
    heads = ["", "!?", "Limits of the API differ", "limits of the api differ a lot", "The api's limits", "Holiday rules", "holiday rules, new and old and more", "naïve rules"]
    rows = [{"pass_index": p, "ord": k, "category": r.choice("ab"), "severity": r.choice(["info", "warning", "critical", "odd"]), "headline": r.choice(heads) + r.choice(["", f" {r.randint(0, 5)}"]), "docs": r.sample(["x", "y", "z"], r.randint(0, 2))} for p in range(3) for k in range(40)]
    df = spark.createDataFrame([(x["pass_index"], x["ord"], x["category"], x["severity"], x["headline"], x["docs"]) for x in rows], "pass_index int, ord long, category string, severity string, headline string, affected_documents array<string>")
    got = detect.consensus(df, 3).select("category", "cluster", "votes", "severity", "headline", F.size("documents"))
    assert sorted(map(tuple, got.collect())) == plain_consensus(rows, 3)


def test_fuzzy_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", text.tokenize(F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ")).alias("w")).collect()
    found, truth = ([(r.doc_id, r.lang, set(r.w)) for r in sorted(docs, key=lambda r: r.doc_id) if r.doc_id % 2 == k] for k in (1, 0))
    used = set()
    for _, lang, w in found:
        for t, of, x in truth:
            if t not in used and lang == of and w and x and len(w & x) / min(len(w), len(x)) > 0.4:
                used.add(t)
                break
    assert used
    assert tuple(QUERIES["fuzzy_documents"](spark, SF).first()) == (len(used), len(found) - len(used), len(truth) - len(used))


def test_fuzzy_of_nothing(spark):
    df = spark.createDataFrame([(1, "a", "some words here")], "ord long, type string, text string")
    assert tuple(evaluate.fuzzy_metrics(df, df.limit(0)).select("tp", "fp", "fn").first()) == (0, 1, 0)
