"""Behaviours of the library on small rows, and joins against brute force."""

import datetime as dt
import itertools
import random
import subprocess
import sys
from pathlib import Path

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.functions import scores, text
from factweave.functions.extract import _model_json, _sections, number_facts
from factweave.operators import answers, detect, evaluate, feedback, filters, graph, pairs, report
from factweave.sources import readers, sinks
from factweave.streaming import feeds

NODE = "id string, ord long, title string, summary string, facts array<string>, raw string, source_id string, entities array<struct<name:string,type:string>>, doc_type string, source_type string"


def nodes(spark, rows):
    made = [(r["id"], k, r.get("title", ""), r.get("summary", ""), r.get("facts", []), r.get("raw", ""), r.get("source", r["id"] + ".md"), [(e, "x") for e in r.get("entities", [])], r.get("doc_type", "general"), r.get("source_type", "md")) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, NODE)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.integers(1, 4))
def test_overlap_pairs_equals_all_pairs(spark, seed, least):
    rnd = random.Random(seed)
    sets = {i: {f"w{int(rnd.paretovariate(0.7)) % 25}" for _ in range(rnd.randint(0, 9))} for i in range(25)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>").repartition(rnd.randint(1, 5))
    got = {(r.a, r.b, r.shared) for r in pairs.overlap_pairs(df, least).collect()}
    want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least}
    assert got == want


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(17)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    part = {}
    for u, v in edges:
        if u != v:
            a, b = part.get(u, {u}), part.get(v, {v})
            whole = a | b
            part.update(dict.fromkeys(whole, whole))
    assert got == {n: min(c) for n, c in part.items()}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_number_facts_and_conflicts(spark):
    df = nodes(spark, [
        {"id": "a", "title": "API limits", "raw": "The API is rate limited to 1,000 requests per minute for clients."},
        {"id": "b", "title": "API limits", "raw": "The API supports 500 requests per minute for all clients."},
        {"id": "c", "title": "Parking", "raw": "We have 20 users."},
    ])
    facts = df.select("id", F.explode(number_facts("raw")).alias("f")).select("id", "f.value", "f.unit").collect()
    assert ("a", 1000.0, "request") in [tuple(r) for r in facts]
    assert [(r.a, r.b, r.value_a, r.value_b) for r in pairs.number_contradictions(df).collect()] == [("a", "b", 1000.0, 500.0)]


def test_policies_owners_and_cascade(spark):
    df = nodes(spark, [
        {"id": "a", "title": "Work policy", "raw": "We are remote-first. Billing is owned by the payments team.", "entities": ["Billing"]},
        {"id": "b", "title": "Work policy", "raw": "This is an office-first company. Billing is managed by finance.", "entities": ["billing"]},
        {"id": "c", "title": "Lunch", "raw": "Soup."},
    ])
    assert [(r.a, r.b) for r in pairs.policy_contradictions(df).collect()] == [("a", "b")]
    own = pairs.ownership_conflicts(df).collect()
    assert [(r.entity, r.owner_a, r.owner_b) for r in own] == [("billing", "payments", "finance")]
    none = spark.createDataFrame([], "a string, b string")
    assert [(r.a, r.b, r.kind) for r in pairs.heuristic_contradictions(df, none).collect()] == [("a", "b", "policy")]
    seen = spark.createDataFrame([("b", "a")], "a string, b string")
    assert pairs.heuristic_contradictions(df, seen).count() == 0


def test_deadlines(spark):
    at = F.to_timestamp(F.lit("2026-03-15"))
    df = nodes(spark, [
        {"id": "a", "raw": "Migration due by January 2026. Launch target 2026-03 for all."},
        {"id": "b", "raw": "Q4 2025 goals. Reports due by January 2026."},
        {"id": "c", "raw": "| Q1 2027 | x |\nShipped in Q2 2025."},
        {"id": "d", "raw": "Notes by January 2026", "doc_type": "meeting_notes"},
    ])
    got = {r.label: r for r in detect.time_bombs(df, at).collect()}
    assert got["by January 2026"].node_ids == ["a", "b", "d"] and got["by January 2026"].severity == "warning" and got["by January 2026"].expired
    assert got["2026-03"].severity == "warning" and not got["2026-03"].expired
    assert got["Q4 2025"].months_ago == 2 and "Q1 2027" not in got and "Q2 2025" not in got


def test_staleness(spark):
    df = nodes(spark, [{"id": "a", "raw": "Last updated: January 2025. As of 2024-05-01."}, {"id": "b", "raw": "Updated 2026-03-01"}, {"id": "c", "raw": "modified: 2020-01"}])
    edges = spark.createDataFrame([("b", "c", "supersedes", dt.datetime(2026, 1, 1))], "source_id string, target_id string, type string, created_at timestamp")
    got = detect.dated_references(df, edges, F.to_timestamp(F.lit("2026-03-15"))).collect()
    assert [(r.id, r.label, r.months_ago) for r in got] == [("a", "Last updated: January 2025", 15)]


def test_reputation(spark):
    rows = [("u1", "shared")] * 3 + [("u2", "corrected")] * 2 + [("u3", "rejected"), ("u3", "escalated")]
    got = {r.user_id: r.score for r in feedback.reputation(spark.createDataFrame(rows, "user_id string, signal_type string")).collect()}
    assert abs(got["u1"] - 3 / 13) < 1e-12 and abs(got["u2"] - 4 / 12) < 1e-12 and got["u3"] == 0


def test_metrics_conventions(spark):
    none = spark.createDataFrame([], "a string, b string, positive boolean")
    row = evaluate.pair_metrics(none, none).first()
    assert (row.precision, row.recall, row.f1) == (0, 0, 0)
    ids = spark.createDataFrame([], "id string")
    row = evaluate.id_metrics(ids, ids, ids).first()
    assert (row.precision, row.recall) == (1, 1)
    d = spark.createDataFrame([("b", "a"), ("x", "y")], "a string, b string")
    t = spark.createDataFrame([("a", "b", True), ("c", "d", True)], "a string, b string, positive boolean")
    row = evaluate.pair_metrics(d, t).first()
    assert (row.tp, row.fp, row.fn) == (1, 1, 1)


def test_model_json():
    assert _model_json('{"a": 1}')[1] == "direct"
    assert _model_json('{"a": [1, 2,')[1] == "repaired"
    assert _model_json('Sure!\n```json\n{"a": 1}\n```')[1] == "fenced"
    assert _model_json('The answer is {"a": 1} as asked')[1] == "embedded"
    assert _model_json("no")[0] is None


def test_sections():
    assert [(s["heading"], s["text"]) for s in _sections("intro text\n\n# One\n\n" + "x" * 150 + "\n\n## Two\n\n" + "y" * 120, 2000, 100)] == [("One", "intro text\n\n" + "x" * 150), ("Two", "y" * 120)]
    assert len(_sections("# H\n\n" + "\n\n".join("p" * 900 for _ in range(5)), 2000, 100)) == 3


def test_html(spark):
    page = "<html><title> T </title><script>x</script><h2>Head</h2><p>Some <b>bold</b> &amp; <a href='/x'>link</a></p><ul><li>one</li></ul></html>"
    row = spark.createDataFrame([(page,)], "h string").select(readers.html_title(F.col("h")).alias("t"), readers.html_to_markdown(F.col("h")).alias("m")).first()
    assert row.t == "T" and "## Head" in row.m and "Some **bold** & link" in row.m and "- one" in row.m and "script" not in row.m


def test_pair_issues_and_rules(spark):
    rows = [("1", "A good long question", "yes", "no", 0.5, ["n"]), ("2", "", "x", "x", 2.0, [])]
    df = spark.createDataFrame(rows, "id string, prompt string, chosen string, rejected string, confidence double, source_node_ids array<string>")
    assert {(r.field, r.issue) for r in filters.pair_issues(df).collect()} == {("prompt", "empty"), ("chosen", "identical"), ("confidence", "out of range"), ("source_node_ids", "no sources")}
    assert filters.pair_report(df).first().valid == 1
    det = spark.createDataFrame([("staleness", "Old page", ["n1"]), ("duplicate", "Twice", ["n2"])], "type string, description string, node_ids array<string>")
    rules = filters.parse_rules(spark.createDataFrame([("# c",), ("type:staleness old",)], "line string"))
    assert [r.type for r in filters.apply_ignore_rules(det, rules).collect()] == ["duplicate"]


def test_dpo_lines(spark):
    lines = spark.createDataFrame([(1, '{"prompt":"p","chosen":"c","rejected":"r"}'), (2, "oops"), (3, '{"prompt":"p","chosen":1,"rejected":"r","metadata":{}}')], "line_no long, line string")
    got = {(r.line_no, r.issue) for r in filters.dpo_line_issues(lines).collect()}
    assert got == {(2, "not json"), (3, "chosen is no text"), (3, "metadata")}


def test_consensus(spark):
    rows = [(p, k, "contradiction", s, h, ["a.md"]) for p, k, s, h in [(0, 0, "critical", "limits of the api differ"), (1, 0, "warning", "limits of the api differ a lot"), (2, 0, "info", "holiday rules")]]
    df = spark.createDataFrame(rows, "pass_index int, ord long, category string, severity string, headline string, affected_documents array<string>")
    got = detect.consensus(df, 3).collect()
    assert [(r.votes, r.headline) for r in got] == [(2, "limits of the api differ a lot")]


def test_changes_and_threads(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    ch = spark.createDataFrame([("a", 2, "upsert", 1), ("b", 0, "delete", 2), ("c", 5, "upsert", 1), ("a", 3, "upsert", 3)], "id string, v int, action string, changed_at int")
    assert sorted((r.id, r.v) for r in feeds.apply_changes(base, ch).collect()) == [("a", 3), ("c", 5)]
    m = [("g", "1", None, "u", "start", None, []), ("g", "2", "1", "v", "re", None, [("ok", 3)]), ("g", "3", "1", "u", "re", None, []), ("g", "4", None, "u", "alone", None, []), ("g", "5", None, "u", "in", "channel_join", [])]
    df = spark.createDataFrame(m, "channel string, ts string, thread_ts string, user string, text string, subtype string, reactions array<struct<name:string,count:int>>")
    t = readers.build_threads(df)
    assert [(r.thread, r.n_replies, r.parent.text) for r in t.collect()] == [("1", 2, "start")]
    docs = readers.threads_to_documents(t, spark.createDataFrame([("u", "Uma")], "user string, name string")).collect()
    assert docs[0].title == "#g — Uma: start" and docs[0].participants == ["Uma", "v"] and docs[0].reactions[0].n == 3


def test_sync_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "upsert", 1), ("b", 1, "upsert", 1)], "id string, v int, action string, changed_at int").write.parquet(src)
    stream = spark.readStream.schema("id string, v int, action string, changed_at int").parquet(src)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    feeds.sync_stream(stream, out, cp).awaitTermination()
    spark.createDataFrame([("a", 2, "upsert", 2), ("b", 0, "delete", 2)], "id string, v int, action string, changed_at int").write.mode("append").parquet(src)
    feeds.sync_stream(stream, out, cp).awaitTermination()
    schema = spark.createDataFrame([], "id string, v int").schema
    assert [(r.id, r.v) for r in feeds.read_synced(spark, out, schema).collect()] == [("a", 2)]
    assert len(feeds.read_synced(spark, out, schema, 0).collect()) == 2
    # many keys, then one: only its bucket is written again; then all go, and one comes back
    spark.range(500).selectExpr("concat('k', id) as id", "1 as v", "'upsert' as action", "3 as changed_at").write.mode("append").parquet(src)
    feeds.sync_stream(stream, out, cp).awaitTermination()
    before = feeds.synced_buckets(spark, out)
    spark.createDataFrame([("k7", 9, "upsert", 4)], "id string, v int, action string, changed_at int").write.mode("append").parquet(src)
    feeds.sync_stream(stream, out, cp).awaitTermination()
    after = feeds.synced_buckets(spark, out)
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in after) == 1
    assert {r.id: r.v for r in feeds.read_synced(spark, out, schema).where("id in ('k7', 'k8')").collect()} == {"k7": 9, "k8": 1}
    feeds.read_synced(spark, out, schema).selectExpr("id", "v", "'delete' as action", "5 as changed_at").write.mode("append").parquet(src)
    feeds.sync_stream(stream, out, cp).awaitTermination()
    assert feeds.read_synced(spark, out, schema).count() == 0 and feeds.synced_buckets(spark, out) == {}


def test_pairs_stream(spark, tmp_path):
    """In two batches: a correction counts the signals before its own time, whenever they came, and none after it."""
    schema = "id string, user_id string, signal_type string, created_at timestamp, original_question string, original_answer string, corrected_answer string"
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    told = lambda i, u, k, answer="b": (i, u, "corrected", day(k), "what?", "a", answer)
    one = [told("1", "u", 0), *[(f"s{k}", "u", "shared", day(k), None, None, None) for k in range(1, 60)], told("2", "u", 100), told("3", "u", 101, "a"), told("4", None, 1)]
    two = [told("5", "u", 20), told("6", "v", 5), *[(f"r{k}", "u", "rejected", day(200 + k), None, None, None) for k in range(60)], told("7", "u", 300), told("8", "u", 110)]
    src, got = str(tmp_path / "in"), {}
    for rows in (one, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = feeds.pairs_stream(spark.readStream.schema(schema).parquet(src), "1000 days").writeStream.foreachBatch(lambda b, n: got.update({r.id: (r.confidence, r.created_at) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    # 2: (2 + 59) / 70; 5: (2 + 19) / 30; 8: (8 + 59) / 73; 7 counts the rejections: (10 + 59 - 60) / 134; 3 is no correction
    assert {k: v[0] for k, v in got.items()} == {"1": 0.6, "2": 1.0, "4": 0.6, "5": 0.6, "6": 0.6, "8": 1.0}


def test_health_and_diff(spark):
    f = spark.createDataFrame([("contradiction", "critical"), ("stale_commitment", "warning")], "category string, severity string")
    row = report.health_from_findings(f).first()
    assert (row.consistency, row.freshness, row.ownership, row.coverage, row.overall) == (75, 92, 100, 100, 89)
    a = spark.createDataFrame([("x", ["1", "2"]), ("y", ["3"])], "type string, node_ids array<string>")
    b = spark.createDataFrame([("x", ["2", "1"]), ("z", ["3"])], "type string, node_ids array<string>")
    assert sorted((r.status, r.fingerprint) for r in report.diff_runs(a, b).collect()) == [("added", "z::3"), ("removed", "y::3"), ("unchanged", "x::1,2")]


def test_answers(spark):
    c = spark.createDataFrame([("r1", "a", "b"), ("r2", "c", "d")], "request_id string, a string, b string")
    r = spark.createDataFrame([("r1", '{"type": "contradicts", "reason": "x"'), ("r2", '{"type": "none"}')], "request_id string, response string")
    assert [(x.source_id, x.target_id, x.confidence) for x in answers.apply_edge_answers(c, r).collect()] == [("a", "b", 0.9)]


def test_text_columns(spark):
    df = spark.createDataFrame([("x.y+z@mail.org wrote", "It is owned by the Core team, ok. Second sentence here.")], "m string, t string")
    row = df.select(text.redact_emails(F.col("m")).alias("m"), text.owner_of(F.col("t"), F.lit("it")).alias("o"), text.clean_excerpt(F.col("t"), 40).alias("e")).first()
    assert row.m == "x***@mail.org wrote" and row.o == "core" and row.e == "It is owned by the Core team, ok."
    assert spark.range(1).select(scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c")).first().c > 0.707
    assert sinks.export_dpo(spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")).first().line == '{"prompt":"p","chosen":"c","rejected":"r"}'


def test_order_is_a_rank(spark):
    df = readers.with_order(spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k")).repartition(7), "k")
    assert [r.ord for r in df.orderBy("k").collect()] == list(range(1000))


def test_library_does_without_the_training_text_part():
    root = Path(__file__).resolve().parents[1]
    found = subprocess.run([sys.executable, "-c", "import factweave.queries, factweave.queries_more, sys; print([m for m in sys.modules if 'llm' in m])"], cwd=root, capture_output=True, text=True, check=True)
    assert found.stdout.strip() == "[]"


def test_excerpts_headlines_questions(spark):
    long = "One sentence that is long enough to stand. And another one that goes on and on"
    rows = [("  few \n words ", "few words"), (long, "One sentence that is long enough to stand."), ("word " * 20, ("word " * 12).strip() + "…"), ("x" * 70, "x" * 60 + "…"), ("Short. " + "y" * 60, "Short. " + "y" * 53 + "…"), (None, "")]
    got = spark.createDataFrame(rows, "c string, want string").select(text.clean_excerpt(F.col("c"), 60).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    heads = [("Topic", "any", "Topic"), (None, "Short: and long", "Short"), (None, "no colon", "no colon"), (None, "y" * 90, "y" * 77 + "...")]
    got = spark.createDataFrame(heads, "t string, d string, want string").select(text.headline(F.col("t"), F.col("d")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    asked = [(" it differs ", ["a"], [], "What is the correct information regarding: it differs"), ("", ["a", " ", "b"], ["s"], "What is the current policy on a and b?"), (None, [], ["", " First\nsecond"], "What is the current policy on First?"), (None, None, None, None)]
    got = spark.createDataFrame(asked, "d string, t array<string>, s array<string>, want string").select(feedback.detection_question(F.col("d"), F.col("t"), F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
