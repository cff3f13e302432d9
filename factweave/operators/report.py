"""Scores, counts, diffs and registers over detections and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.scores import round_half_up

# What belongs to a dimension of health, weights of the dimensions, penalties.
BY_CATEGORY = {"consistency": ("contradiction", "duplicate_truth"), "freshness": ("stale_commitment", "commitment_without_followthrough"), "ownership": ("ownership_gap", "decision_without_context"), "coverage": ("tribal_knowledge",)}
BY_TYPE = {"consistency": ("contradiction", "duplicate"), "freshness": ("staleness", "time_bomb"), "ownership": (), "coverage": ("undocumented",)}
WEIGHTS = {"consistency": 0.35, "freshness": 0.25, "ownership": 0.2, "coverage": 0.2}
SEVERITIES = ("critical", "warning", "info")


def n_of(severity: str, *more: Column) -> Column:
    cond = F.col("severity") == severity
    for m in more:
        cond = cond & m
    return F.count_if(cond)


def _health(df: DataFrame, column: str, groups: dict, penalty: dict[str, int]) -> DataFrame:
    def dimension(kinds: tuple) -> Column:
        inside = F.col(column).isin(*kinds) if kinds else F.lit(False)
        lost = sum((p * n_of(s, inside) for s, p in penalty.items()), F.lit(0))
        return F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("long")

    dims = df.agg(*[dimension(k).alias(d) for d, k in groups.items()])
    return dims.select(round_half_up(sum((w * F.col(d) for d, w in WEIGHTS.items()), F.lit(0.0))).cast("long").alias("overall"), *groups)


def health_from_findings(findings: DataFrame) -> DataFrame:
    """One row: overall health and its dimensions; 25, 8 or 3 points off per finding."""
    return _health(findings, "category", BY_CATEGORY, {"critical": 25, "warning": 8, "info": 3})


def health_from_detections(detections: DataFrame) -> DataFrame:
    """The same out of detections: 15 or 5 points off."""
    return _health(detections, "type", BY_TYPE, {"critical": 15, "warning": 5})


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("long")


def score(detections: DataFrame, *by: str) -> DataFrame:
    """Scores by group: linear (15, 5, 1), exponential, and capped (10 a critical one up to 50; warnings 3, then 1, up to 25)."""
    counts = detections.groupBy(*by).agg(*[n_of(s).alias(s) for s in SEVERITIES])
    c, w, i = F.col("critical"), F.col("warning"), F.col("info")
    capped = 100 - F.least(10 * c, F.lit(50)) - F.least(3 * F.least(w, F.lit(5)) + F.greatest(w - 5, F.lit(0)), F.lit(25))
    return counts.select(*by, *SEVERITIES, _clamped(100 - 15 * c - 5 * w - i).alias("linear"), round_half_up(100 * F.exp(-0.08 * c - 0.02 * w - 0.005 * i)).cast("long").alias("exponential"), _clamped(capped).alias("capped"))


def three_dimensions(detections: DataFrame) -> DataFrame:
    """Consistency (15, 8), freshness (12 a stale one, 10 a deadline) and coverage (10 a topic) of a report, at least 0."""
    of = lambda *k: F.col("type").isin(*k)
    return detections.agg(
        _clamped(100 - 15 * n_of("critical", of("contradiction", "duplicate")) - 8 * n_of("warning", of("contradiction", "duplicate"))).alias("consistency"),
        _clamped(100 - 12 * F.count_if(of("staleness")) - 10 * F.count_if(of("time_bomb"))).alias("freshness"),
        _clamped(100 - 10 * F.count_if(of("undocumented"))).alias("coverage"),
    )


def ci_report(runs: DataFrame, min_score: int = 0, fail_on: str | None = None, allow_regression: bool = True) -> DataFrame:
    """Gate of each run of ``detections`` with ``corpus, run_at``: score, previous, delta, failed severity, passed."""
    rows = score(runs, "corpus", "run_at")
    order = Window.partitionBy("corpus").orderBy("run_at")
    rows = rows.withColumn("previous", F.lag("linear").over(order)).withColumn("delta", F.col("linear") - F.col("previous"))
    up_to = SEVERITIES[: SEVERITIES.index(fail_on) + 1] if fail_on else ()
    hit = F.lit(None).cast("string")
    for s in reversed(up_to):
        hit = F.when(F.col(s) > 0, F.lit(s)).otherwise(hit)
    ok = (F.col("linear") >= min_score) & hit.isNull() & (F.lit(allow_regression) | F.coalesce(F.col("delta") >= 0, F.lit(True)))
    return rows.select("corpus", "run_at", F.col("linear").alias("score"), "previous", "delta", hit.alias("failed_on"), ok.alias("passed"))


def detection_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("type", "severity").agg(F.count("*").alias("n"))


def store_status(**tables: DataFrame) -> DataFrame:
    """``name, n`` of each table; of pairs also those not exported."""
    out = None
    for name, df in tables.items():
        rows = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        if name == "pairs":
            rows = rows.unionByName(df.where(~F.col("exported")).agg(F.count("*").alias("n")).select(F.lit("unexported").alias("name"), "n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def resolution_summary(resolutions: DataFrame) -> DataFrame:
    a = F.col("action")
    return resolutions.agg(F.count_if(~a.isin("dismiss", "skip")).alias("resolved"), F.count_if(a == "dismiss").alias("dismissed"), F.count_if(a == "skip").alias("skipped"))


def risk_register(detections: DataFrame, n: int | None = 10) -> DataFrame:
    """Nodes in two detections or more: ``node_id, n, types, risk``, the most first."""
    got = detections.select(F.explode(F.array_distinct("node_ids")).alias("node_id"), "type", "severity").groupBy("node_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("type")).alias("types"), F.bool_or(F.col("severity") == "critical").alias("__c")).where("n >= 2")
    out = got.select("node_id", "n", "types", F.when(F.col("__c"), "high").when(F.col("n") >= 3, "medium").otherwise("low").alias("risk"))
    return out if n is None else out.orderBy(F.desc("n"), "node_id").limit(n)


def contradiction_graph(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node counts and edges with their severity, of the first two nodes of each contradiction."""
    rows = detections.where("type = 'contradiction' and size(node_ids) >= 2").select(F.slice("node_ids", 1, 2).alias("ids"), "severity")
    return rows.select(F.explode("ids").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n")), rows.select(F.element_at("ids", 1).alias("a"), F.element_at("ids", 2).alias("b"), "severity")


def topic_coverage(document_map: DataFrame, findings: DataFrame) -> DataFrame:
    """``topic, n, state``: conflicted if a contradiction's file and the topic contain each other, healthy from two documents."""
    topics = document_map.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    files = findings.where(F.col("category").isin("contradiction", "duplicate_truth")).select(F.explode("affected_documents").alias("f")).select(F.lower(F.regexp_replace(F.element_at(F.split("f", "/"), -1), r"\.\w+$", "")).alias("f")).where("f <> ''").distinct()
    t = F.lower("topic")
    bad = topics.join(F.broadcast(files), t.contains(F.col("f")) | F.col("f").contains(t), "left_semi").select("topic", F.lit(True).alias("bad"))  # findings of a report are few
    return topics.join(bad, "topic", "left").select("topic", "n", F.when(F.col("bad"), "conflicted").when(F.col("n") >= 2, "healthy").otherwise("thin").alias("state"))


def detector_stats(detections: DataFrame, nodes: DataFrame) -> DataFrame:
    return detections.groupBy("detector").agg(F.count("*").alias("detections")).crossJoin(nodes.agg(F.count("*").alias("nodes")))


def findings_by_category(findings: DataFrame) -> DataFrame:
    docs = F.array_size(F.array_distinct(F.flatten(F.collect_list("affected_documents")))).cast("long")
    return findings.groupBy("category").agg(F.count("*").alias("n"), n_of("critical").alias("critical"), docs.alias("documents"))


def projected_score(findings: DataFrame, overall: int) -> DataFrame:
    quick, medium = F.count_if(F.col("effort") == "quick_win"), F.count_if(F.col("effort") == "medium")
    return findings.agg(F.least(F.lit(100), overall + 5 * F.when(quick > 0, quick).otherwise(medium)).cast("long").alias("projected"))


def fingerprint() -> Column:
    return F.concat_ws("::", "type", F.array_join(F.array_sort("node_ids"), ","))


def diff_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """``status, fingerprint`` of the rows of two runs: added, removed, unchanged."""
    a, b = before.select(fingerprint().alias("fingerprint")), after.select(fingerprint().alias("fingerprint"))
    tag = lambda df, s: df.select(F.lit(s).alias("status"), "fingerprint")
    return tag(b.join(a, "fingerprint", "left_anti"), "added").unionByName(tag(a.join(b, "fingerprint", "left_anti"), "removed")).unionByName(tag(b.join(a, "fingerprint", "left_semi"), "unchanged"))
