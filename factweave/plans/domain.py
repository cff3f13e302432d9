"""Domain tables derived from the given ones, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("contradiction", "duplicate", "staleness", "undocumented", "time_bomb")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node per part: what it is, how much it allows, who owns it, and how its team works."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    team = F.lower(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    limit = F.concat(F.lit("The "), "p_name", F.lit(" "), F.lower("p_type"), F.lit(" line from "), "p_brand", F.lit(" allows "), F.col("p_size").cast("string"), F.lit(" requests per hour."))
    owner = F.concat(F.lit("The "), "p_name", F.lit(" is owned by the "), team, F.lit(" team."))
    rule = F.when(k % 3 == 0, "This line is remote-first.").when(k % 3 == 1, "This line is office-first.").otherwise("No rule.")
    return p.select(
        F.concat(F.lit("part-"), k.cast("string")).alias("id"),
        k.alias("ord"),
        F.col("p_name").alias("title"),
        F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("facts"),
        F.concat_ws(" ", limit, owner, rule).alias("raw"),
        F.concat(F.lit("src"), (k % 20).cast("string"), F.lit(".md")).alias("source_id"),
        F.when(k % 4 == 0, "slack").otherwise("md").alias("source_type"),
        F.array(*[F.struct(F.col(c).alias("name"), F.lit(t).alias("type")) for c, t in (("p_name", "product"), ("p_brand", "brand"), ("p_type", "kind"))]).alias("entities"),
        F.array(F.struct(F.lit("brand").alias("type"), F.col("p_brand").alias("name")), F.struct(F.lit("part").alias("type"), F.col("p_name").alias("name"))).alias("parent_chain"),
        (k % 7 == 0).alias("authoritative"),
        F.lit("general").alias("doc_type"),
        (F.col("p_size") / 50.0).alias("confidence"),
        F.to_timestamp(F.lit("2020-01-01")).alias("updated_at"),
        F.lit(None).cast("timestamp").alias("source_last_modified"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


NODES_SQL = """nodes as (select 'part-' || p_partkey as id, p_partkey as ord, p_name as title,
  'The ' || p_name || ' ' || lower(p_type) || ' line from ' || p_brand || ' allows ' || p_size || ' requests per hour. The ' || p_name || ' is owned by the ' || lower(replace(p_brand, '#', ' ')) || ' team. '
    || case p_partkey % 3 when 0 then 'This line is remote-first.' when 1 then 'This line is office-first.' else 'No rule.' end as raw,
  'src' || (p_partkey % 20) || '.md' as source_id, p_brand, p_type, p_size, lower(p_name) as e1, lower(p_brand) as e2, lower(p_type) as e3 from part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name in a row: the later supersedes the earlier; every fifth pair contradicts too."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part")
    before = F.lag("p_partkey").over(Window.partitionBy("p_name").orderBy("p_partkey"))
    rows = p.select("p_partkey", before.alias("older")).where("older is not null")
    created = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit("2019-06-01"))) + F.col("p_partkey") * 86400)
    kind = F.explode(F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("supersedes"), F.lit("contradicts"))).otherwise(F.array(F.lit("supersedes"))))
    named = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string"))
    return rows.select(named("p_partkey").alias("source_id"), named("older").alias("target_id"), kind.alias("type"), ((F.col("p_partkey") % 10) / 10.0).alias("confidence"), created.alias("created_at")).withColumn("id", F.concat_ws(">", "source_id", "target_id", "type"))


EDGES_SQL = """pairs_ as (select p_partkey, lag(p_partkey) over (partition by p_name order by p_partkey) as older from part),
edges as (select 'part-' || p_partkey as source_id, 'part-' || older as target_id, unnest(case when p_partkey % 5 = 0 then ['supersedes', 'contradicts'] else ['supersedes'] end) as type,
  (p_partkey % 10) / 10.0::double as confidence, timestamp '2019-06-01' + to_days(p_partkey::int) as created_at, p_partkey as newer_key, older as older_key from pairs_ where older is not null)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection per order: kind and severity by keys, about the customer's and the day's node."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 5 + 1).cast("int"))
    severity = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "warning").otherwise("info")
    ids = F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd")))
    return o.select(k.alias("ord"), kind.alias("type"), severity.alias("severity"), ids.alias("node_ids"), F.concat(F.lit("Order "), k.cast("string"), F.lit(": status "), "o_orderstatus").alias("description"), F.col("o_orderstatus").alias("corpus"), F.year("o_orderdate").alias("run_at"), F.lit(None).cast("string").alias("metadata_json"))


DETECTIONS_SQL = """detections as (select o_orderkey as ord, ['contradiction', 'duplicate', 'staleness', 'undocumented', 'time_bomb'][o_orderkey % 5 + 1] as type,
  case when o_orderpriority like '1%' then 'critical' when o_orderpriority like '2%' then 'warning' else 'info' end as severity,
  ['c' || o_custkey, 'd' || strftime(o_orderdate, '%Y%m%d')] as node_ids, 'Order ' || o_orderkey || ': status ' || o_orderstatus as description, o_orderstatus as corpus, year(o_orderdate)::int as run_at from orders)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as signals about question nodes."""
    e = table(spark, sf_dir, "events")
    kinds = {"purchase": "corrected", "signup": "shared", "error": "rejected", "view": "accepted", "click": "escalated"}
    kind = F.lit("follow_up")
    for a, b in kinds.items():
        kind = F.when(F.col("event_type") == a, F.lit(b)).otherwise(kind)
    node = F.get_json_object("props", "$.k")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.lit("c").alias("conversation_id"), kind.alias("signal_type"), F.concat(F.lit("use "), F.col("value").cast("decimal(18,2)").cast("string")).alias("correction_text"), F.array(node).alias("question_node_ids"), F.col("ts").alias("created_at"))


SIGNALS_SQL = """signals as (select event_id as id, user_id::varchar as user_id, case event_type when 'purchase' then 'corrected' when 'signup' then 'shared' when 'error' then 'rejected' when 'view' then 'accepted' when 'click' then 'escalated' else 'follow_up' end as signal_type,
  'use ' || value::decimal(18,2)::varchar as correction_text, json_extract_string(props, '$.k') as node, ts as created_at from events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat messages: a thread each."""
    c = table(spark, sf_dir, "conversations")
    ts = lambda t: F.format_string("%010d.%06d", F.col("conv_id"), t)
    likes = F.array(F.struct(F.lit("plus").alias("name"), F.col("turn").cast("int").alias("count")))
    return c.select(F.lit("general").alias("channel"), ts(F.col("turn")).alias("ts"), ts(F.lit(0).cast("long")).alias("thread_ts"), F.col("role").alias("user"), "text", F.lit(None).cast("string").alias("subtype"), likes.alias("reactions"))
