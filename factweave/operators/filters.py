"""Row filters: nodes, edges, ignore rules, findings, corrections, preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import UUID, is_uuid_list

# Categories of findings.
CATEGORIES = ("contradiction", "duplicate_truth", "stale_commitment", "commitment_without_followthrough", "ownership_gap", "decision_without_context", "tribal_knowledge")
SEVERITIES = ("critical", "warning", "info")


def filter_nodes(nodes: DataFrame, model: str | None = None, min_confidence: float | None = None, since: Column | None = None) -> DataFrame:
    for wanted in (model is not None and F.col("embedding_model") == model, min_confidence is not None and F.col("confidence") >= min_confidence, since is not None and F.col("updated_at") >= since):
        nodes = nodes if wanted is False else nodes.where(wanted)
    return nodes


def nodes_of_source(nodes: DataFrame, source_id: str) -> DataFrame:
    return nodes.where(F.col("source_id") == source_id)


def edges_of_node(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))


def edges_of_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("type") == kind)


def parse_rules(lines: DataFrame) -> DataFrame:
    """Ignore rules, one per line of ``line``: ``type:``, ``text:`` and ``node:`` parts; bare words join the text."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    part = lambda k: F.nullif(F.regexp_extract(line, rf"(?:^|\s){k}:(\S+)", 1), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"(?:^|\s)(?:type|node|text):\S+", " "), r"\s+", " "))
    text = F.nullif(F.lower(F.concat_ws(" ", part("text"), F.nullif(bare, F.lit("")))), F.lit(""))
    return lines.where(line != "").select(part("type").alias("rule_type"), text.alias("rule_text"), part("node").alias("rule_node"))


def apply_ignore_rules(detections: DataFrame, rules: DataFrame) -> DataFrame:
    """Detections that no rule matches on all of its given parts. Rules are a hand-written file, so they are broadcast."""
    fits = (
        (F.col("rule_type").isNull() | (F.col("type") == F.col("rule_type")))
        & (F.col("rule_text").isNull() | F.lower("description").contains(F.col("rule_text")))
        & (F.col("rule_node").isNull() | F.exists("node_ids", lambda n: n.startswith(F.col("rule_node"))))
    )
    return detections.join(F.broadcast(rules), fits, "left_anti")


def split_auto_resolvable(detections: DataFrame) -> DataFrame:
    said = F.coalesce(F.get_json_object("metadata_json", "$.autoResolvable"), F.get_json_object("metadata_json", "$.autoResolve"))
    return detections.withColumn("auto_resolvable", (F.col("severity") == "info") | F.coalesce(said == "true", F.lit(False)))


def clean_findings(raw: DataFrame) -> DataFrame:
    """Findings with a known category and severity, a headline and evidence; defaults for the rest."""
    ok = F.col("category").isin(*CATEGORIES) & F.col("severity").isin(*SEVERITIES) & (F.trim("headline") != "") & F.col("evidence").isNotNull()
    empty = F.array().cast("array<string>")
    return raw.where(ok).withColumns({"effort": F.coalesce("effort", F.lit("medium")), "affected_documents": F.coalesce("affected_documents", empty), "business_impact": F.coalesce("business_impact", F.lit("")), "recommendation": F.coalesce("recommendation", F.lit(""))})


def validation_candidates(detections: DataFrame, nodes: DataFrame, limit: int | None = 20) -> DataFrame:
    """Detections of two sources or other than two nodes; those within the first ``limit`` of all are to be validated."""
    source = nodes.select("id", F.col("source_id").alias("src"))
    at = lambda k: F.try_element_at("node_ids", F.lit(k))
    rows = detections.join(source.withColumnsRenamed({"id": "id_a", "src": "src_a"}), at(1) == F.col("id_a"), "left").join(source.withColumnsRenamed({"id": "id_b", "src": "src_b"}), at(2) == F.col("id_b"), "left")
    rows = rows.where(~((F.size("node_ids") == 2) & F.coalesce(F.col("src_a") == F.col("src_b"), F.lit(False)))).drop("id_a", "id_b", "src_a", "src_b")
    if limit is None:
        return rows.withColumn("validate", F.lit(True))
    first = detections.select("ord").orderBy("ord").limit(limit).agg(F.max("ord").alias("__last"))
    return rows.crossJoin(F.broadcast(first)).withColumn("validate", F.col("ord") <= F.col("__last")).drop("__last")


def validate_corrections(df: DataFrame) -> DataFrame:
    """``valid`` and, if not, the first ``reason``."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = (
        F.when(blank("original_question"), "empty question")
        .when(blank("original_answer"), "empty original answer")
        .when(blank("corrected_answer"), "empty corrected answer")
        .when(F.trim("original_answer") == F.trim("corrected_answer"), "identical answers")
        .when(is_uuid_list(F.col("original_question")), "question is an id")
    )
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def pair_issues(pairs: DataFrame) -> DataFrame:
    """A row per issue of a preference pair: ``id, field, issue, severity``."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    short_id = lambda c: (F.length(c) < 60) & F.coalesce(F.col(c).rlike(f"(?i){UUID}"), F.lit(False))
    rules = [
        *[(t(c) == "", c, "empty", "error") for c in ("prompt", "chosen", "rejected")],
        ((t("chosen") == t("rejected")) & (t("chosen") != ""), "chosen", "identical", "error"),
        (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence", "out of range", "error"),
        (F.coalesce(F.size("source_node_ids"), F.lit(0)) < 1, "source_node_ids", "no sources", "warning"),
        ((t("prompt") != "") & (F.length(t("prompt")) < 10), "prompt", "short", "warning"),
        (F.coalesce(F.col("prompt").rlike(f"(?i){UUID}"), F.lit(False)), "prompt", "holds an id", "error"),
        (short_id("chosen"), "chosen", "is an id", "error"),
        (short_id("rejected"), "rejected", "is an id", "error"),
    ]
    issue = lambda f, i, s: F.struct(F.lit(f).alias("field"), F.lit(i).alias("issue"), F.lit(s).alias("severity"))
    return pairs.select("id", F.explode(F.array_compact(F.array(*[F.when(c, issue(f, i, s)) for c, f, i, s in rules]))).alias("x")).select("id", "x.*")


def pair_report(pairs: DataFrame) -> DataFrame:
    """Pairs, valid pairs (no error), errors and warnings in one row."""
    bad = pair_issues(pairs)
    counts = bad.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct(F.when(F.col("severity") == "error", F.col("id"))).alias("invalid"))
    return pairs.agg(F.count("*").alias("pairs")).crossJoin(counts).select("pairs", (F.col("pairs") - F.col("invalid")).alias("valid"), "errors", "warnings")


def dpo_line_issues(lines: DataFrame) -> DataFrame:
    """A row per issue of a training line ``line_no, line``: not JSON, fields missing, metadata there, an id as prompt."""
    v = F.try_parse_json("line")
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    rules = [(v.isNull(), "not json"), *[(v.isNotNull() & ~F.coalesce(kind(f) == "STRING", F.lit(False)), f"{f} is no text") for f in ("prompt", "chosen", "rejected")]]
    rules += [(F.try_variant_get(v, "$.metadata", "variant").isNotNull(), "metadata"), (F.coalesce(is_uuid_list(F.try_variant_get(v, "$.prompt", "string")), F.lit(False)), "prompt is an id")]
    return lines.select("line_no", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules]))).alias("issue"))


def first_n(df: DataFrame, *order: str, n: int | None) -> DataFrame:
    """The first ``n`` rows of an order, which only tops of partitions are sorted for; all without a number."""
    return df if n is None else df.orderBy(*order).limit(n)


def ranked(df: DataFrame) -> DataFrame:
    """Detections by kind, then severity, then order."""
    rank = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    return df.orderBy(rank("type", ("contradiction", "time_bomb", "staleness", "duplicate", "undocumented")), rank("severity", SEVERITIES), "ord")


def top_per_severity(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("severity").orderBy("ord"))).where(F.col("__k") <= n).drop("__k")


def action_plan(findings: DataFrame) -> DataFrame:
    """Findings above info, by effort, then severity."""
    rank = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    return findings.where("severity <> 'info'").orderBy(rank("effort", ("quick_win", "medium", "major")), rank("severity", SEVERITIES), "ord")
