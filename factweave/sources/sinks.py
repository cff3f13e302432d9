"""Training lines, tickets and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def export_nodes(nodes: DataFrame, min_confidence: float = 0.0, metadata: bool = True) -> DataFrame:
    """JSON lines of nodes; vectors are left out, and ``metadata_json`` if not wanted."""
    drop = {"embedding", "ord"} | (set() if metadata else {"metadata_json"})
    return nodes.where(F.col("confidence") >= min_confidence).select(F.to_json(F.struct(*[c for c in nodes.columns if c not in drop])).alias("line"))


def export_pairs(pairs: DataFrame) -> DataFrame:
    """JSON lines of preference pairs with their metadata."""
    meta = F.struct(F.col("conflict_type").alias("conflictType"), F.col("resolved_by").alias("resolvedBy"), iso("resolved_at").alias("resolvedAt"), "confidence", F.col("source_node_ids").alias("sourceNodeIds"))
    return pairs.select(F.to_json(F.struct("prompt", "chosen", "rejected", meta.alias("metadata"))).alias("line"))


def export_combined(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both kinds of lines in one table, told apart by ``type``."""

    def tagged(lines: DataFrame, kind: str) -> DataFrame:
        return lines.select(F.concat(F.lit(f'{{"type":"{kind}",'), F.substring("line", 2, 1 << 30)).alias("line"))

    return tagged(export_nodes(nodes), "node").unionByName(tagged(export_pairs(pairs), "preference_pair"))


def export_dpo(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.to_json(F.struct("prompt", "chosen", "rejected")).alias("line"))


def export_sft(nodes: DataFrame, prefix: str = "Explain", min_confidence: float = 0.0) -> DataFrame:
    """``instruction`` and ``response`` lines out of titles, summaries and facts; blank summaries are left out."""
    kept = nodes.where((F.col("confidence") >= min_confidence) & (F.trim("summary") != ""))
    response = F.when(F.size("facts") > 0, F.concat_ws(" ", "summary", F.array_join("facts", " "))).otherwise(F.col("summary"))
    return kept.select(F.to_json(F.struct(F.concat_ws(" ", F.lit(prefix), "title").alias("instruction"), response.alias("response"))).alias("line"))


def export_new_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the pairs that were not exported yet, in order of creation, and all pairs marked as exported."""
    return export_dpo(pairs.where(~F.col("exported")).orderBy("created_at", "id")), pairs.withColumn("exported", F.lit(True))


def make_tickets(detections: DataFrame) -> DataFrame:
    """``title, priority, labels, files, body`` of detections ``type, severity, topic, description, suggested_action, sources``."""
    # Titles by type
    lead = {"contradiction": "Resolve contradiction", "duplicate": "Merge duplicate truth", "staleness": "Update stale content", "undocumented": "Document topic", "time_bomb": "Review deadline"}
    title = F.lit("Review finding")
    for kind, text in lead.items():
        title = F.when(F.col("type") == kind, F.lit(text)).otherwise(title)
    priority = F.when(F.col("severity") == "critical", "P1").when(F.col("severity") == "warning", "P2").otherwise("P3")
    files = F.transform("sources", lambda s: F.element_at(F.split(s, "/"), -1))
    return detections.select(
        F.concat_ws(": ", title, F.coalesce("topic", F.substring("description", 1, 80))).alias("title"),
        priority.alias("priority"),
        F.array(F.lit("knowledge"), F.col("type")).alias("labels"),
        files.alias("files"),
        F.concat_ws("\n\n", "description", "suggested_action").alias("body"),
        "ord",
    )


def tickets_markdown(tickets: DataFrame) -> DataFrame:
    """A Markdown section per priority."""
    line = F.concat(F.lit("- **"), "title", F.lit("** ("), F.array_join("files", ", "), F.lit(")"))
    rows = tickets.groupBy("priority").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("rows"))
    return rows.select("priority", F.concat(F.lit("## "), "priority", F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))


def save_snapshot(df: DataFrame, path: str, run_at: str) -> None:
    """Appends a run, by its time, so that history stays and the latest can be read alone."""
    df.withColumn("run_at", F.lit(run_at)).write.mode("append").partitionBy("run_at").parquet(path)


def resolutions_from_choices(detections: DataFrame, choices: DataFrame) -> DataFrame:
    """Choices ``detection_id, action, resolved_by, resolved_at`` other than skip, with their detections."""
    return choices.where("action <> 'skip'").join(detections.select("detection_id", "type", "node_ids", "description"), "detection_id")
