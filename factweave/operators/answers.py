"""Applying a model's answers, which come as a table, to the candidates they are for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.extract import parse_model_json
from factweave.functions.scores import adjust_severity, clamp01
from factweave.functions.text import headline, snippet


def parsed(responses: DataFrame, schema: str) -> DataFrame:
    """``request_id`` and the columns of ``schema`` out of ``response``; ``mode`` tells how the JSON was found."""
    rows = responses.select("request_id", parse_model_json("response").alias("p"))
    return rows.select("request_id", F.from_json("p.json", schema).alias("x"), F.col("p.mode").alias("mode")).select("request_id", "x.*", "mode")


def _pair() -> list[Column]:
    return [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that ``seen`` has in neither direction."""
    known = seen.select(*_pair()).distinct()
    return rows.join(known, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")


def first_per_pair(rows: DataFrame, *order: str) -> DataFrame:
    last = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")


def apply_split_truth(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidate pairs ``request_id, a, b`` that the answers call one truth told twice."""
    said = parsed(responses, "isDuplicate boolean, severity string, reason string")
    return candidates.join(said, "request_id").where("isDuplicate").select("a", "b", F.coalesce("severity", F.lit("info")).alias("severity"), "reason")


def apply_nli(pairs: DataFrame, responses: DataFrame, seen: DataFrame) -> DataFrame:
    """Claim pairs ``request_id, ord_a, ord_b, a, b`` answered as contradictions, the first per unseen pair of nodes."""
    said = parsed(responses, "verdict string, confidence double, explanation string")
    hits = pairs.join(said, "request_id").where("lower(verdict) = 'contradiction'")
    return first_per_pair(unseen(hits, seen), "ord_a", "ord_b").select("a", "b", "confidence", "explanation")


def apply_claim_comparison(pairs: DataFrame, responses: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Node pairs ``request_id, a, b, ord_a, ord_b`` whose facts the answers find to clash, the first per unseen pair.

    ``a, b, severity, description, suggested_action, topic, claim_a, claim_b, impact, confidence``; a severity other
    than critical is a warning, of medium confidence.
    """
    said = parsed(responses, "isContradiction boolean, topic string, claimA string, claimB string, severity string, explanation string")
    titles = nodes.select("id", "title")
    rows = pairs.join(said, "request_id").where("isContradiction").join(titles.withColumnsRenamed({"id": "a", "title": "ta"}), "a").join(titles.withColumnsRenamed({"id": "b", "title": "tb"}), "b")
    grave = F.coalesce(F.col("severity") == "critical", F.lit(False))
    cells = lambda text, *columns: F.format_string(text, *[F.coalesce(c, F.lit("")) for c in columns])
    rows = rows.withColumns({
        "severity": F.when(grave, "critical").otherwise("warning"),
        "confidence": F.when(grave, "high").otherwise("medium"),
        "description": cells("When discussing %s, %s states: '%s'. However, %s states: '%s'.", F.col("topic"), F.col("ta"), F.col("claimA"), F.col("tb"), F.col("claimB")),
        "suggested_action": cells("Review and align %s and %s on %s.", F.col("ta"), F.col("tb"), F.col("topic")),
    })
    return first_per_pair(unseen(rows, seen), "ord_a", "ord_b").select("a", "b", "severity", "description", "suggested_action", "topic", F.col("claimA").alias("claim_a"), F.col("claimB").alias("claim_b"), F.col("explanation").alias("impact"), "confidence")


def edge_candidates(nodes: DataFrame, k: int = 10, min_similarity: float = 0.15, limit: int | None = 30) -> DataFrame:
    """Pairs of near nodes that a model is asked about, in order of the first node, then nearness: ``request_id, a, b``."""
    from factweave.operators.pairs import knn

    near = knn(nodes, k, min_similarity).where("id <> other").join(nodes.select("id", "ord"), "id")
    first = near.groupBy(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).agg(F.min(F.struct("ord", "rank", F.col("id").alias("a"), F.col("other").alias("b"))).alias("h")).select("h.*")
    out = first.select(F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b")).alias("request_id"), "a", "b", "ord", "rank")
    return (out if limit is None else out.orderBy("ord", "rank").limit(limit)).drop("ord", "rank")


def apply_edge_answers(pairs: DataFrame, responses: DataFrame) -> DataFrame:
    """Edges out of answers: contradicts 0.9, supersedes 0.85, related 0.6; none or anything else: no edge."""
    said = parsed(responses, "type string, reason string")
    rows = pairs.join(said.withColumnRenamed("type", "said"), "request_id", "left")
    weight = F.when(F.col("said") == "contradicts", 0.9).when(F.col("said") == "supersedes", 0.85).when(F.col("said") == "related", 0.6)
    return rows.withColumn("confidence", weight).where("confidence is not null").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("said").alias("type"), "confidence", "reason")


def apply_package_findings(packages: DataFrame, responses: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Findings of packages whose nodes exist and whose pair is unseen; severity follows the authority multiplier."""
    said = parsed(responses, "findings array<struct<nodeA:string,nodeB:string,severity:string,description:string>>")
    rows = packages.join(said, packages["package"] == said["request_id"]).select("package", F.posexplode("findings").alias("ord", "f")).select("package", "ord", F.col("f.nodeA").alias("a"), F.col("f.nodeB").alias("b"), "f.severity", "f.description")
    ids = nodes.select("id", "authority")
    rows = rows.where(F.col("severity").isin("critical", "warning", "info")).join(ids.withColumnsRenamed({"id": "a", "authority": "wa"}), "a").join(ids.withColumnsRenamed({"id": "b", "authority": "wb"}), "b")
    rows = rows.withColumn("severity", adjust_severity(F.col("severity"), 2 * clamp01(0.5 + F.greatest("wa", "wb") + 0.5 * F.least("wa", "wb"))))
    return first_per_pair(unseen(rows, seen), "package", "ord").select("package", "a", "b", "severity", "description")


def apply_validation(detections: DataFrame, responses: DataFrame) -> DataFrame:
    """Detections ``request_id`` that the answers leave as real; without a good answer they stay, of low confidence."""
    said = parsed(responses, "isReal boolean, impact string, confidence string, explanation string").drop("mode")
    rows = detections.join(said, "request_id", "left")
    return rows.withColumn("isReal", F.coalesce("isReal", F.lit(True))).where("isReal").withColumn("confidence", F.coalesce("confidence", F.lit("low"))).drop("isReal")


def time_bomb_candidates(nodes: DataFrame) -> DataFrame:
    """Nodes with a date and the first 1,000 characters that a model is asked about: ``request_id, excerpt``."""
    from factweave.operators.detect import DATE_GATE
    from factweave.operators.pairs import node_text

    return nodes.withColumn("body", node_text()).where(F.col("body").rlike(DATE_GATE)).select(F.col("id").alias("request_id"), F.substring("body", 1, 1000).alias("excerpt"))


def apply_time_bombs(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    said = parsed(responses, "hasTimeBomb boolean, deadline string, expired boolean, description string").drop("mode")
    rows = candidates.join(said, "request_id").where("hasTimeBomb")
    return rows.select(F.col("request_id").alias("id"), "deadline", "expired", F.when(F.col("expired"), "critical").otherwise("warning").alias("severity"), "description")


def pairs_from_choices(detections: DataFrame, nodes: DataFrame, choices: DataFrame) -> DataFrame:
    """Preference pairs out of choices ``detection_id, choice (a or b), confidence, resolved_by``: prompt, chosen, rejected."""
    side = nodes.select("id", snippet(F.coalesce("raw", "summary")).alias("t"))
    rows = detections.join(choices, "detection_id").join(side.withColumnsRenamed({"id": "a", "t": "ta"}), "a").join(side.withColumnsRenamed({"id": "b", "t": "tb"}), "b")
    is_a = F.lower("choice") == "a"
    confidence = F.when(F.col("resolved_by") == "user", 1.0).otherwise(clamp01(F.coalesce("confidence", F.lit(0.7))))
    prompt = F.concat(F.lit("Which is right? "), headline(F.lit(None).cast("string"), F.col("description")))
    return rows.select("detection_id", prompt.alias("prompt"), F.when(is_a, F.col("ta")).otherwise(F.col("tb")).alias("chosen"), F.when(is_a, F.col("tb")).otherwise(F.col("ta")).alias("rejected"), confidence.alias("confidence"))


# Categories of findings and kinds of detections.
TO_KIND = {"contradiction": "contradiction", "duplicate_truth": "duplicate", "stale_commitment": "staleness", "commitment_without_followthrough": "time_bomb", "ownership_gap": "undocumented", "decision_without_context": "undocumented", "tribal_knowledge": "undocumented"}
TO_CATEGORY = {"contradiction": "contradiction", "duplicate": "duplicate_truth", "staleness": "stale_commitment", "time_bomb": "commitment_without_followthrough", "undocumented": "tribal_knowledge"}


def _mapped(table: dict[str, str], c: str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(F.col(c) == k, F.lit(v)).otherwise(out)
    return out


def findings_to_detections(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings with the nodes of their documents, or else of their evidence: ``ord, type, severity, description, node_ids``.

    A path is known in full (its last node) or by its base name (its first).
    """
    full = nodes.groupBy(F.col("source_id").alias("path")).agg(F.max_by("id", "ord").alias("id"))
    base = nodes.groupBy(F.element_at(F.split("source_id", "/"), -1).alias("path")).agg(F.min_by("id", "ord").alias("id"))
    table = full.withColumn("w", F.lit(0)).unionByName(base.withColumn("w", F.lit(1))).groupBy("path").agg(F.min_by("id", "w").alias("node"))
    paths = F.when(F.size("affected_documents") > 0, F.col("affected_documents")).otherwise(F.transform("evidence", lambda e: e["source"]))
    long = findings.select("ord", F.posexplode_outer(paths).alias("pos", "path")).join(table, "path", "left").where("node is not null")
    ids = long.groupBy("ord").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])).alias("node_ids"))
    rows = findings.join(ids, "ord", "left")
    return rows.select("ord", _mapped(TO_KIND, "category").alias("type"), "severity", F.col("headline").alias("description"), F.coalesce("node_ids", F.array().cast("array<string>")).alias("node_ids"))


def detections_to_findings(detections: DataFrame) -> DataFrame:
    """Detections with their context as findings."""
    effort = F.when(F.col("type").isin("staleness", "time_bomb"), "quick_win").when(F.col("type") == "undocumented", "major").otherwise("medium")
    return detections.select("ord", _mapped(TO_CATEGORY, "type").alias("category"), "severity", headline(F.col("topic"), F.col("description")).alias("headline"), F.transform("nodes", lambda n: F.struct(n["source"].alias("source"), n["excerpt"].alias("quote"))).alias("evidence"), effort.alias("effort"), F.array_distinct(F.transform("nodes", lambda n: n["source"])).alias("affected_documents"))


def contradiction_scenarios(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labelled pairs ``a, b, correct`` with the right and the wrong text."""
    side = nodes.select("id", F.coalesce("raw", "summary").alias("t"))
    rows = pairs.join(side.withColumnsRenamed({"id": "a", "t": "ta"}), "a").join(side.withColumnsRenamed({"id": "b", "t": "tb"}), "b")
    ok = F.col("correct") == F.col("a")
    return rows.select("a", "b", F.when(ok, F.col("ta")).otherwise(F.col("tb")).alias("right"), F.when(ok, F.col("tb")).otherwise(F.col("ta")).alias("wrong"))


def document_map(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Topics and owner of each document by path; of several entries the last."""
    last = answers.groupBy("path").agg(F.max_by(F.struct("topics", "owner"), "ord").alias("x"))
    return docs.join(last, "path", "left").select("path", F.coalesce("x.topics", F.array().cast("array<string>")).alias("topics"), F.col("x.owner").alias("owner"))


def corpus_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of documents and about how many tokens they have, four characters each."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.ceil(F.sum(F.length(text)) / 4), F.lit(0)).cast("long").alias("tokens"))


