"""More registered queries: sources and sinks, the rule tables, model answers, reports and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import extract, scores, text
from factweave.operators import answers, detect, evaluate, feedback, filters, pairs, report
from factweave.plans import domain as d
from factweave.plans.domain import DETECTIONS_SQL, EDGES_SQL, NODES_SQL, table
from factweave.plans.staging import shared_dir
from factweave.registry import query
from factweave.sources import readers, sinks


def _case(key: str, values: list[str], of: int) -> str:
    """SQL for one of ``values`` by ``key`` modulo ``of``."""
    return "case " + key + f" % {of} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _pick(key: str, values: list[str]):
    """One of ``values`` by ``key`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _s(c: str):
    return F.col(c).cast("string")


def _parts(spark, sf):
    return table(spark, sf, "part")


# --- sources -------------------------------------------------------------------------------------------------------------
def _files(spark, sf):
    files = _parts(spark, sf).select(F.concat(F.lit("part-"), _s("p_partkey"), F.lit(".md")).alias("path"), F.col("p_name").alias("content"), F.sha2("p_name", 256).alias("sha256"), F.col("p_partkey").alias("k"))
    log = files.where("k % 3 <> 0").select(F.col("path").alias("file_path"), F.when(F.col("k") % 3 == 1, F.col("sha256")).otherwise("other").alias("file_hash"), F.lit(1).alias("ingested_at"))
    # an older line of the log, which the later one replaces
    log = log.unionByName(files.where("k % 3 = 1").select(F.col("path").alias("file_path"), F.lit("old").alias("file_hash"), F.lit(0).alias("ingested_at")))
    return files.drop("k"), log


@query("select 'part-' || p_partkey || '.md' as path, case p_partkey % 3 when 0 then 'new' when 1 then 'unchanged' else 'changed' end as status from part")
def incremental_plan(spark, sf):
    return readers.plan_incremental(*_files(spark, sf)).select("path", "status")


@query("select 'part-' || p_partkey as id from part where p_partkey % 3 <> 2")
def purged_nodes(spark, sf):
    nodes = d.nodes(spark, sf).withColumn("source_id", F.concat("id", F.lit(".md")))
    return readers.purge_changed(nodes, readers.plan_incremental(*_files(spark, sf))).select("id")


@query("""with p as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) as path from pages)
select page_id from p where not (path like '/en/1%' or (host like '%.com' and path like '/fr%'))""")
def allowed_pages(spark, sf):
    pages = table(spark, sf, "pages")
    hosts = pages.select(F.try_parse_url("url", F.lit("HOST")).alias("host")).distinct()
    body = F.concat(F.lit("User-agent: robot\nDisallow: /\n\nUser-agent: *\nDisallow: /en/1 # drafts\nDisallow:\n"), F.when(F.col("host").endswith(".com"), "disallow: /fr\n").otherwise(""))
    return readers.filter_disallowed(pages, hosts.select("host", body.alias("body"))).select("page_id")


@query("""select 'export/' || replace(c_name, '#', '_') || '.html' as path, replace(c_name, '#', ' ') as title, '# ' || c_name || chr(10) || chr(10) || 'A customer of the ' || lower(c_mktsegment) || ' segment, **number ' || c_custkey || '** of all.' as markdown from customer where c_custkey % 5 <> 0""")
def wiki_export(spark, sf):
    path = F.concat(F.when(F.col("c_custkey") % 5 == 0, "export/images/").otherwise("export/"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(".html"))
    html = F.concat(F.lit('<div id="page-metadata">Created by</div><script>x = 1</script><h1>'), "c_name", F.lit("</h1><p>A customer of the "), F.lower("c_mktsegment"), F.lit(" segment, <b>number "), _s("c_custkey"), F.lit("</b> of all.</p><footer>foot</footer>"))
    return readers.read_wiki_export(table(spark, sf, "customer").select(path.alias("path"), html.alias("content")), most=None)


@query("select c_name || ' ' || md5(c_name) || '.md' as path, c_name as title, 'The notes on ' || c_name || ' are kept here for whoever looks for them.' as markdown from customer")
def notes_export(spark, sf):
    c = table(spark, sf, "customer")
    return readers.read_notes_export(c.select(F.concat("c_name", F.lit(" "), F.md5("c_name"), F.lit(".md")).alias("path"), F.concat(F.lit("  The notes on "), "c_name", F.lit(" are kept here for whoever looks for them.\n")).alias("content")))


@query("select s_suppkey, '```' || chr(10) || 'select ' || s_suppkey || chr(10) || '```' || chr(10) || chr(10) || 'See ' || s_name || ' – now' as markdown from supplier")
def storage_pages(spark, sf):
    c = F.concat(F.lit('<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[select '), _s("s_suppkey"), F.lit(']]></ac:plain-text-body></ac:structured-macro><p>See <ac:link><ri:page ri:content-title="'), "s_name", F.lit('"/></ac:link>&#160;&#8211; now</p>'))
    return table(spark, sf, "supplier").select("s_suppkey", readers.storage_to_markdown(c).alias("markdown"))


@query("select s_suppkey, 'Hi @' || s_name || ', see **the list** & more' as line from supplier")
def chat_lines(spark, sf):
    c = F.concat(F.lit('<p>Hi <at id="0">'), "s_name", F.lit('</at>, see <b>the list</b> &amp; <a href="http://x">more</a></p><attachment id="7"></attachment>'))
    return table(spark, sf, "supplier").select("s_suppkey", readers.chat_html_to_text(c).alias("line"))


@query("select c_custkey as id, c_name as title, 'Our balance is ' || c_custkey || ' as of now.' as content, 'c***@example.com' as author from customer where c_custkey % 4 <> 0")
def mail_documents(spark, sf):
    c = table(spark, sf, "customer")
    body = F.when(F.col("c_custkey") % 4 == 0, "<p>Thanks!</p>").otherwise(F.concat(F.lit("<p>Our balance is "), _s("c_custkey"), F.lit(" as of now.</p>")))
    return readers.messages_to_documents(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("subject"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("author"), body.alias("text")), redact=True)


@query("""with c as (select l_orderkey, string_agg('line ' || l_linenumber || ': part ' || l_partkey, chr(10) || chr(10) order by l_shipdate, l_linenumber, l_partkey) as said from lineitem group by l_orderkey)
select o_orderkey as id, md5('Status: ' || o_orderstatus || chr(10) || 'Project: shop' || chr(10) || 'Labels: ' || o_orderpriority || ', order' || chr(10) || chr(10) || 'An order of customer ' || o_custkey || coalesce(chr(10) || chr(10) || said, '')) as content from orders left join c on l_orderkey = o_orderkey""")
def issue_documents(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    issues = o.select(F.col("o_orderkey").alias("id"), F.lit("Order").alias("title"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("assignee"), F.lit("shop").alias("project"), F.array("o_orderpriority", F.lit("order")).alias("labels"), F.concat(F.lit("An order of customer "), _s("o_custkey")).alias("body"))
    comments = li.select(F.col("l_orderkey").alias("issue_id"), F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("created_at"), F.concat(F.lit("line "), _s("l_linenumber")).alias("author"), F.concat(F.lit("part "), _s("l_partkey")).alias("text"))
    return readers.issues_to_documents(issues, comments).select("id", F.md5("content").alias("content"))


@query("""select s_suppkey as id, case when s_suppkey % 2 = 0 then '| name | nation |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_name || ' | ' || s_nationkey || ' |' else 'The supplier ' || s_name end as content, true as authoritative from supplier""")
def drive_documents(spark, sf):
    s = table(spark, sf, "supplier")
    csv = F.col("s_suppkey") % 2 == 0
    body = F.when(csv, F.concat(F.lit('name,nation\n"'), "s_name", F.lit('",'), _s("s_nationkey"))).otherwise(F.concat(F.lit("The supplier "), "s_name"))
    rows = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), body.alias("text"), F.when(csv, "text/csv").otherwise("text/plain").alias("mime"), F.array().cast("array<string>").alias("parents"))
    return readers.pages_to_documents(rows).select("id", "content", "authoritative")


@query("""select kind, count(*) as n, count(owner) as owned from (select 'customer' as kind, null as owner from customer union all select 'supplier', s_name from supplier) group by kind""")
def united_sources(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("title"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("owner"))
    return readers.union_sources(a, b).groupBy("kind").agg(F.count("*").alias("n"), F.count("owner").alias("owned"))


@query("""select 'doc-' || regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') || '-' || substr(md5(c_custkey::varchar), 1, 6) || '.md' as file_name, '---' || chr(10) || 'title: ' || c_name || chr(10) || 'source: http://c/' || c_custkey || chr(10) || '---' || chr(10) || chr(10) || c_mktsegment as body from customer""")
def staged_documents(spark, sf):
    c = table(spark, sf, "customer")
    return readers.stage_markdown(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("http://c/"), _s("c_custkey")).alias("source_url"), F.col("c_mktsegment").alias("content")))


@query("select case s_suppkey % 4 when 0 then 'pair' when 1 then 'sft' when 2 then 'node' else 'invalid' end as kind, count(*) as n from supplier group by kind")
def exported_lines(spark, sf):
    """Lines written as files to the shared folder, read again and classified."""
    line = _pick("s_suppkey", ['{"prompt":"a","chosen":"b","rejected":"c"}', '{"instruction":"a","response":"b"}', '{"id":1,"title":"t"}', "{broken"])
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf, "supplier").select(line.alias("value")).write.text(path)
    return evaluate.classify_lines(readers.read_export(spark, path)).groupBy("kind").agg(F.count("*").alias("n"))


@query("""with k as (select s_suppkey % 4 as k from supplier) select count(*) filter (where k = 0) as n_pair, count(*) filter (where k = 1) as n_sft, count(*) filter (where k = 2) as n_node, count(*) filter (where k = 3) as n_invalid, 'mixed' as dataset_type from k""")
def export_analysis(spark, sf):
    line = _pick("s_suppkey", ['{"prompt":"a","chosen":"b","rejected":"c"}', '{"instruction":"a","response":"b"}', '{"id":1,"title":"t"}', "{broken"])
    return evaluate.analyze_export(table(spark, sf, "supplier").select(F.lit("f").alias("path"), F.col("s_suppkey").alias("line_no"), line.alias("line")))


@query("""select doc_id::varchar as pair_id, toxic = 1 as has_contradiction, doc_id || '-a' as doc_a, doc_id || '-b' as doc_b from labels""")
def nli_pairs(spark, sf):
    return readers.build_nli_corpus(_nli(spark, sf), 1 << 30)[1]


@query("""select doc_id || '-' || side as id, doc_id::varchar as pair_id, case side when 'a' then 'premise ' || quality else 'hypothesis ' || toxic end as raw from labels, (values ('a'), ('b')) s(side)""")
def nli_nodes(spark, sf):
    return readers.build_nli_corpus(_nli(spark, sf), 1 << 30)[0].select("id", "pair_id", "raw")


def _nli(spark, sf):
    la = table(spark, sf, "labels")
    return la.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "contradiction").otherwise("neutral").alias("label"), F.concat(F.lit("premise "), _s("quality")).alias("premise"), F.concat(F.lit("hypothesis "), _s("toxic")).alias("hypothesis"))


@query("""select sha256(path || chr(1) || ordinal) as id, case when ordinal = 0 then 'About' else file end as title, path as source_id, 'md' as source_type, array_to_string(['teams', lower(p_brand)], '/') as folders, body as raw
from (select 'teams/' || lower(p_brand) || '/part-' || p_partkey || '.md' as path, 'part-' || p_partkey || '.md' as file, p_partkey % 2 as ordinal, p_brand, p_name || ' for sale' as body from part)""")
def chunk_nodes(spark, sf):
    p = _parts(spark, sf)
    files = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("teams/"), F.lower("p_brand"), F.lit("/part-"), _s("p_partkey"), F.lit(".md")).alias("path"))
    chunks = p.select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 2).alias("ordinal"), F.when(F.col("p_partkey") % 2 == 0, "About").alias("heading"), F.concat("p_name", F.lit(" for sale")).alias("text"))
    return readers.build_nodes(chunks, files).select("id", "title", "source_id", "source_type", F.array_join(F.transform("parent_chain", lambda x: x["name"]), "/").alias("folders"), "raw")


@query("""select 'part-' || p_partkey as id, case when p_partkey % 3 = 0 then p_name else '' end as facts, case p_partkey % 6 when 0 then 'policy' else 'general' end as doc_type from part""")
def extracted_nodes(spark, sf):
    said = _parts(spark, sf).where("p_partkey % 3 = 0").select(F.concat(F.lit("part-"), _s("p_partkey")).alias("id"), F.array("p_name").alias("facts"), F.array().cast("array<string>").alias("entities"), F.when(F.col("p_partkey") % 2 == 0, "policy").otherwise("poem").alias("doc_type"))
    return readers.apply_extraction(d.nodes(spark, sf), said).select("id", F.array_join("facts", "|").alias("facts"), "doc_type")


@query("""select 'part-' || p_partkey as node_id, p_name as node_title, 1 as pos, p_name || ' is of type ' || p_type as text from part""")
def atomic_claims(spark, sf):
    said = _parts(spark, sf).select(F.concat(F.lit("part-"), _s("p_partkey")).alias("id"), F.array(F.lit("too short"), F.concat("p_name", F.lit(" is of type "), "p_type")).alias("claims"))
    return readers.apply_claims(d.nodes(spark, sf), said).select("node_id", "node_title", "pos", "text")


# --- sinks ---------------------------------------------------------------------------------------------------------------
def _preferences(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Which of "), _s("o_orderkey"), F.lit("?")).alias("prompt"), F.col("o_orderstatus").alias("chosen"), F.col("o_orderpriority").alias("rejected"), F.lit("contradiction").alias("conflict_type"), F.lit("user").alias("resolved_by"), F.col("o_orderdate").alias("resolved_at"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(0.5).alias("confidence"), F.array(F.concat(F.lit("c"), _s("o_custkey"))).alias("source_node_ids"), (F.col("o_orderkey") % 3 == 0).alias("exported"), F.col("o_orderdate").alias("created_at"))


@query("""select json_object('prompt', 'Which of ' || o_orderkey || '?', 'chosen', o_orderstatus, 'rejected', o_orderpriority, 'metadata', json_object('conflictType', 'contradiction', 'resolvedBy', 'user', 'resolvedAt', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z',
'confidence', case when o_orderkey % 2 = 0 then 1.0::double else 0.5::double end, 'sourceNodeIds', ['c' || o_custkey]))::varchar as line from orders""")
def pair_lines(spark, sf):
    return sinks.export_pairs(_preferences(spark, sf))


@query("select 'node' as type, count(*) as n from part union all select 'preference_pair', count(*) from orders")
def combined_lines(spark, sf):
    lines = sinks.export_combined(d.nodes(spark, sf), _preferences(spark, sf))
    return lines.groupBy(F.get_json_object("line", "$.type").alias("type")).agg(F.count("*").alias("n"))


@query("""select json_object('instruction', 'Explain ' || p_name, 'response', p_type || case when p_partkey % 2 = 0 then ' It is a ' || p_brand else '' end)::varchar as line from part where p_partkey % 5 <> 0 and p_size / 50.0::double >= 0.5""")
def sft_lines(spark, sf):
    p = _parts(spark, sf)
    none = F.array().cast("array<string>")
    nodes = p.select(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_type")).alias("summary"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("It is a "), "p_brand"))).otherwise(none).alias("facts"), (F.col("p_size") / 50.0).alias("confidence"))
    return sinks.export_sft(nodes, min_confidence=0.5)


@query("""select json_object('prompt', 'Which of ' || o_orderkey || '?', 'chosen', o_orderstatus, 'rejected', o_orderpriority)::varchar as line from orders where o_orderkey % 3 <> 0""")
def new_pair_lines(spark, sf):
    return sinks.export_new_pairs(_preferences(spark, sf))[0]


@query("select true as exported, count(*) as n from orders")
def marked_pairs(spark, sf):
    return sinks.export_new_pairs(_preferences(spark, sf))[1].groupBy("exported").agg(F.count("*").alias("n"))


@query(f"""with {DETECTIONS_SQL} select ord, case type when 'contradiction' then 'Resolve contradiction' when 'duplicate' then 'Merge duplicate truth' when 'staleness' then 'Update stale content' when 'undocumented' then 'Document topic' else 'Review deadline' end || ': ' || description as title,
case severity when 'critical' then 'P1' when 'warning' then 'P2' else 'P3' end as priority, 'knowledge|' || type as labels, node_ids[1] || '|' || node_ids[2] as files, description || chr(10) || chr(10) || 'Look into it.' as body from detections""")
def ticket_rows(spark, sf):
    rows = d.detections(spark, sf).withColumns({"topic": F.lit(None).cast("string"), "suggested_action": F.lit("Look into it."), "sources": F.transform("node_ids", lambda x: F.concat(F.lit("a/b/"), x))})
    return sinks.make_tickets(rows).select("ord", "title", "priority", F.array_join("labels", "|").alias("labels"), F.array_join("files", "|").alias("files"), "body")


@query(f"with {DETECTIONS_SQL} select run_at::varchar as run_at, count(*) as n from detections group by run_at")
def snapshots(spark, sf):
    """Runs saved one after the other and read again."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    x = d.detections(spark, sf)
    for year in [r["run_at"] for r in x.select("run_at").distinct().collect()]:  # a run a year, seven in all
        sinks.save_snapshot(x.where(F.col("run_at") == year).drop("run_at", "metadata_json"), path, str(year))
    return spark.read.parquet(path).groupBy(F.col("run_at").cast("string").alias("run_at")).agg(F.count("*").alias("n"))


def _with_ids(spark, sf):
    return d.detections(spark, sf).withColumn("detection_id", F.col("ord"))


@query(f"with {DETECTIONS_SQL} select ord as detection_id, type, case ord % 3 when 0 then 'keep' else 'dismiss' end as action from detections where ord % 3 <> 2")
def saved_resolutions(spark, sf):
    x = _with_ids(spark, sf)
    choices = x.select("detection_id", _pick("ord", ["keep", "dismiss", "skip"]).alias("action"), F.lit("user").alias("resolved_by"), F.lit(None).cast("timestamp").alias("resolved_at"))
    return sinks.resolutions_from_choices(x, choices).select("detection_id", "type", "action")


@query(f"with {DETECTIONS_SQL} select count(*) filter (where ord % 4 = 0) as resolved, count(*) filter (where ord % 4 = 1) as dismissed, count(*) filter (where ord % 4 >= 2) as skipped from detections")
def resolutions(spark, sf):
    return report.resolution_summary(d.detections(spark, sf).select(_pick("ord", ["keep", "dismiss", "skip", "skip"]).alias("action")))


@query("select 'nodes' as name, count(*) as n from part union all select 'pairs', count(*) from orders union all select 'unexported', count(*) from orders where o_orderkey % 3 <> 0")
def status(spark, sf):
    return report.store_status(nodes=d.nodes(spark, sf), pairs=_preferences(spark, sf))


# --- filters -------------------------------------------------------------------------------------------------------------
@query("select 'part-' || p_partkey as id from part where p_size / 50.0::double >= 0.5")
def sure_nodes(spark, sf):
    return filters.filter_nodes(d.nodes(spark, sf), min_confidence=0.5, since=F.to_timestamp(F.lit("2019-12-31"))).select("id")


@query("select 'part-' || p_partkey as id from part where p_partkey % 20 = 3")
def nodes_of_file(spark, sf):
    return filters.nodes_of_source(d.nodes(spark, sf), "src3.md").select("id")


@query(f"with {EDGES_SQL}, k as (select max(target_id) as id from edges) select source_id, target_id, type from edges, k where source_id = k.id or target_id = k.id")
def edges_at_node(spark, sf):
    e = d.edges(spark, sf)
    return filters.edges_of_node(e, e.agg(F.max("target_id")).first()[0]).select("source_id", "target_id", "type")


@query(f"with {EDGES_SQL} select source_id, target_id from edges where type = 'contradicts'")
def edges_by_type(spark, sf):
    return filters.edges_of_type(d.edges(spark, sf), "contradicts").select("source_id", "target_id")


_CATEGORIES = list(filters.CATEGORIES)


def _findings(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    severity = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "warning").otherwise("info")
    evidence = F.array(F.struct(F.concat(F.lit("c"), _s("o_custkey"), F.lit(".md")).alias("source"), F.lit("q").alias("quote")))
    return o.select(
        F.col("o_orderkey").alias("ord"), _pick("o_orderkey", [*_CATEGORIES, "other"]).alias("category"), severity.alias("severity"),
        F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.concat(F.lit("Order "), _s("o_orderkey"))).alias("headline"),
        F.when(F.col("o_orderkey") % 13 != 0, evidence).alias("evidence"), _pick("o_orderkey", ["quick_win", "medium", "major"]).alias("effort"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("docs/c"), _s("o_custkey"), F.lit(".md")))).alias("affected_documents"), F.lit(None).cast("string").alias("business_impact"), F.lit(None).cast("string").alias("recommendation"),
    )


_FINDINGS = f"""findings as (select o_orderkey as ord, {_case('o_orderkey', [repr(c) for c in [*_CATEGORIES, 'other']], 8)} as category, case when o_orderpriority like '1%' then 'critical' when o_orderpriority like '2%' then 'warning' else 'info' end as severity,
['quick_win', 'medium', 'major'][o_orderkey % 3 + 1] as effort, o_custkey from orders where o_orderkey % 8 <> 7 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0)"""


@query(f"with {_FINDINGS} select ord, category, severity, effort, case when ord % 2 = 0 then 1 else 0 end::int as n_documents from findings")
def valid_findings(spark, sf):
    return filters.clean_findings(_findings(spark, sf)).select("ord", "category", "severity", "effort", F.size("affected_documents").alias("n_documents"))


@query(f"""with {_FINDINGS}, c as (select category, count(*) filter (where severity = 'critical') as c, count(*) filter (where severity = 'warning') as w, count(*) filter (where severity = 'info') as i from findings group by category),
p as (select category, 25 * c + 8 * w + 3 * i as lost from c), h as (select greatest(0, 100 - coalesce(sum(lost) filter (where category in ('contradiction', 'duplicate_truth')), 0))::bigint as consistency, greatest(0, 100 - coalesce(sum(lost) filter (where category in ('stale_commitment', 'commitment_without_followthrough')), 0))::bigint as freshness,
greatest(0, 100 - coalesce(sum(lost) filter (where category in ('ownership_gap', 'decision_without_context')), 0))::bigint as ownership, greatest(0, 100 - coalesce(sum(lost) filter (where category = 'tribal_knowledge'), 0))::bigint as coverage from p)
select floor(0.35::double * consistency + 0.25::double * freshness + 0.2::double * ownership + 0.2::double * coverage + 0.5::double)::bigint as overall, * from h""")
def findings_health(spark, sf):
    return report.health_from_findings(filters.clean_findings(_findings(spark, sf)))


@query(f"with {_FINDINGS} select category, count(*) as n, count(*) filter (where severity = 'critical') as critical, count(distinct case when ord % 2 = 0 then o_custkey end) as documents from findings group by category")
def category_counts(spark, sf):
    return report.findings_by_category(filters.clean_findings(_findings(spark, sf)))


@query(f"with {_FINDINGS} select least(100, 40 + 5 * case when count(*) filter (where effort = 'quick_win') > 0 then count(*) filter (where effort = 'quick_win') else count(*) filter (where effort = 'medium') end)::bigint as projected from findings")
def projected(spark, sf):
    return report.projected_score(filters.clean_findings(_findings(spark, sf)), 40)


@query(f"with {_FINDINGS} select ord, effort, severity from findings where severity <> 'info'")
def plan_of_action(spark, sf):
    return filters.action_plan(filters.clean_findings(_findings(spark, sf))).select("ord", "effort", "severity")


@query(f"with {DETECTIONS_SQL}, r as (select ord, type, severity, row_number() over (order by list_position(['contradiction', 'time_bomb', 'staleness', 'duplicate', 'undocumented'], type), list_position(['critical', 'warning', 'info'], severity), ord) as k from detections) select ord, type, severity from r where k <= 40")
def first_ranked(spark, sf):
    """The first forty in the order of a report."""
    return filters.ranked(d.detections(spark, sf)).limit(40).select("ord", "type", "severity")


@query(f"with {DETECTIONS_SQL} select ord from detections order by severity, ord limit 30")
def first_thirty(spark, sf):
    return filters.first_n(d.detections(spark, sf), "severity", "ord", n=30).select("ord")


@query("""select p_partkey as ord, true as validate from part where not (p_partkey % 3 = 0 and p_partkey >= 20)""")
def to_validate(spark, sf):
    """Detections on a part and the one twenty before it, of one file in every third; others are of two files or of one node."""
    p = _parts(spark, sf)
    k = F.col("p_partkey")
    ids = F.when((k % 3 == 0) & (k >= 20), F.array(k, k - 20)).when((k % 3 == 1) & (k >= 1), F.array(k, k - 1)).otherwise(F.array(k))
    rows = p.select(k.alias("ord"), F.transform(ids, lambda x: F.concat(F.lit("part-"), x.cast("string"))).alias("node_ids"))
    return filters.validation_candidates(rows, d.nodes(spark, sf), None).select("ord", "validate")


_REASONS = ["empty question", "empty original answer", "empty corrected answer", "identical answers", "question is an id", None]
_UUID = "123e4567-e89b-12d3-a456-426614174000"


@query("select o_orderkey as id, " + _case("o_orderkey", [f"'{r}'" if r else "null" for r in _REASONS], 6) + " as reason, o_orderkey % 6 = 5 as valid from orders")
def correction_reasons(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 6
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(k == 0, " ").when(k == 4, _UUID).otherwise("What?").alias("original_question"), F.when(k == 1, "").otherwise("old").alias("original_answer"), F.when(k == 2, F.lit(None).cast("string")).when(k == 3, " old ").otherwise("new").alias("corrected_answer"))
    return filters.validate_corrections(rows).select("id", "reason", "valid")


_LINES = [
    ("not json", ["not json"]),
    ('{"prompt":"p","chosen":"c","rejected":"r"}', []),
    ('{"prompt":"p","chosen":1,"rejected":"r"}', ["chosen is no text"]),
    ('{"chosen":"c"}', ["prompt is no text", "rejected is no text"]),
    ('{"prompt":"p","chosen":"c","rejected":"r","metadata":{}}', ["metadata"]),
    (f'{{"prompt":"{_UUID}","chosen":"c","rejected":"r"}}', ["prompt is an id"]),
]


@query("select o_orderkey as line_no, unnest(" + _case("o_orderkey", [str(issues) + "::varchar[]" for _, issues in _LINES], 6) + ") as issue from orders")
def line_issues(spark, sf):
    return filters.dpo_line_issues(table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no"), _pick("o_orderkey", [x for x, _ in _LINES]).alias("line")))


@query("""select count(*) as pairs, count(*) filter (where o_orderkey % 4 <> 0) as valid, count(*) filter (where o_orderkey % 4 = 0) as errors, count(*) as warnings from orders""")
def pairs_report(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.lit("Which one is right?").alias("prompt"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("a").alias("chosen"), F.lit("b").alias("rejected"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("source_node_ids"))
    return filters.pair_report(rows)


# --- rule tables: a row for every entry ------------------------------------------------------------------------------------
def _cases(spark, sf, rows: list[tuple]) -> DataFrame:
    """Orders with the case that their key picks: ``id`` and columns ``c0``, ``c1``, ..."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return o.select("id", *[_pick("id", [r[i] for r in rows]).alias(f"c{i}") for i in range(len(rows[0]))])


def _expected(rows: list[tuple], at: int, name: str) -> str:
    return "select o_orderkey as id, " + _case("o_orderkey", ["null" if r[at] is None else repr(r[at]) for r in rows], len(rows)) + f" as {name} from orders"


_OWNERS = [(f"The gateway is {verb} by {the}core data {unit}. The rest is not.", "gateway", "core data") for verb, the, unit in (("owned", "the ", "team"), ("managed", "", "group"), ("handled", "the ", "squad"), ("responsible", "", "dept"), ("maintained", "the ", "department"), ("operated", "", ""))]
_OWNERS += [("It is owned by someone. The gateway is slow.", "gateway", None), ("The gateway is owned by x.", "gateway", None), ("The gateway, owned by Ada Lovelace, is slow", "gateway", "ada lovelace")]


@query(_expected(_OWNERS, 2, "owner"))
def owner_phrases(spark, sf):
    return _cases(spark, sf, [r[:2] for r in _OWNERS]).select("id", text.owner_of(F.col("c0"), F.col("c1")).alias("owner"))


_DENIALS = [(f"The service runs daily", f"The service does {w} run", True) for w in scores.NEGATIONS]
_DENIALS += [("The service runs", "The service can't run", False), ("The service runs", "It is wrong about the service", False), ("The job runs", "It does not run", False), ("Never once", "It never ran", False)]


@query(_expected(_DENIALS, 2, "denied"))
def denials(spark, sf):
    return _cases(spark, sf, [r[:2] for r in _DENIALS]).select("id", scores.negation_conflict(F.col("c0"), F.col("c1")).alias("denied"))


_TITLES = [(w, "b", "person_knows") for w in pairs.PERSON_WORDS] + [("a", w, "person_knows") for w in pairs.PERSON_WORDS] + [(w, "b", "caused_by") for w in pairs.CAUSE_WORDS] + [(w, "b", "contradicts") for w in pairs.WRONG_WORDS]
_TITLES += [("a", "caused", "related"), ("a", "wrong", "related"), ("the team who", "because", "related"), ("caused by the team lead", "b", "person_knows")]


@query(_expected(_TITLES, 2, "type"))
def link_types(spark, sf):
    return _cases(spark, sf, [r[:2] for r in _TITLES]).select("id", pairs.link_type(F.col("c0"), F.col("c1")).alias("type"))


_GATE = "The public gateway accepts {} for every signed client"
_EDGES = [(f"We are {a} here", f"We are {b} here", "contradicts") for a, b in pairs.OPPOSED] + [(f"We are {b} here", f"We are {a} here", "contradicts") for a, b in pairs.OPPOSED]
_EDGES += [
    ("We are remote-first or office", "We like the office", None),
    (_GATE.format("100 requests per hour"), _GATE.format("200 requests per hour"), "contradicts"),
    (_GATE.format("$100"), _GATE.format("$2,000.50"), "contradicts"),
    (_GATE.format("99%"), _GATE.format("95%"), "contradicts"),
    (_GATE.format("3 per month"), _GATE.format("4 per month"), "contradicts"),
    (_GATE.format("100 requests"), _GATE.format("100 requests"), None),
    (_GATE.format("0 requests"), _GATE.format("200 requests"), None),
    (_GATE.format("$1 or $8"), _GATE.format("$8 or $1"), None),
    ("Within 5 days your manager requires approval", "Within 9 days your manager requires approval", None),
    ("The status is 404 requests of every signed client", "The status is 500 requests of every signed client", None),
    *[(f"{w} {_GATE.format('100 requests')}", f"{w} {_GATE.format('200 requests')}", None) for w in ("sure", "certain", "confident", "probably", "maybe", "likely", "unlikely")],
    ("The rollout plan of Q1 2024", "The rollout plan of Q3 2024", "supersedes"),
]


@query(_expected(_EDGES, 2, "type"))
def edge_types(spark, sf):
    rows = _cases(spark, sf, [r[:2] for r in _EDGES])
    both = rows.select("id", F.col("c0").alias("text_a"), F.col("c1").alias("text_b"), F.lit("Rollout").alias("title_a"), F.lit("Rollout").alias("title_b"), F.lit("a.md").alias("source_a"), F.lit("b.md").alias("source_b"))
    return pairs.classify_pairs(both).select("id", "type")


_NUMBERS = [
    ("Up to 1,200 requests. Then 0 calls", [(1200.0, "Up to 1,200 requests")]),
    ("It costs $5.50 now! Or 7%", [(5.5, "It costs $5.50 now"), (7.0, "Or 7%")]),
    ("Use 3 GBs or 12 per week", [(3.0, "Use 3 GBs or 12 per week"), (12.0, "Use 3 GBs or 12 per week")]),
    ("Call 5 tokens\nand 2 days", [(5.0, "Call 5 tokens"), (2.0, "and 2 days"), (2.0, "and 2 days")]),
    ("none at all", []),
]


@query("select o_orderkey as id, " + _case("o_orderkey", [repr("|".join(f"{v}:{c}" for v, c in x)).replace("\\n", "' || chr(10) || '") for _, x in _NUMBERS], 5) + " as found from orders")
def numbers_in_context(spark, sf):
    rows = _cases(spark, sf, [(r[0],) for r in _NUMBERS])
    return rows.select("id", F.array_join(F.transform(extract.context_numbers("c0"), lambda x: F.concat_ws(":", x["value"].cast("string"), x["context"])), "|").alias("found"))


_DEADLINES = [
    ("Launch in Q3 2024.", "Q3 2024=2024-09-30"),
    ("We were done, completed Q3 2024.", ""),
    ("| table | Q3 2024", ""),
    ("The deadline is 2024-02", "2024-02=2024-02-29"),
    ("Last updated: 2024-02", ""),
    ("No word of it 2024-02", ""),
    ("Ship by end of March 2025 please", "by end of March 2025=2025-03-31"),
    ("Finish by end of year", "by end of year=2020-12-31"),
    ("Finish by month", "by month=2020-01-31"),
]


@query(_expected(_DEADLINES, 1, "found"))
def deadline_dates(spark, sf):
    found = extract.deadlines(F.col("c0"), F.to_timestamp(F.lit("2020-01-01")))
    return _cases(spark, sf, [(r[0],) for r in _DEADLINES]).select("id", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["label"], x["end_date"])), "|").alias("found"))


_DATES = [("From Q2 2021 on", "2021-04-01"), ("In 2022-07 and 2023-13", "2022-07-01"), ("since September 2020, Oct 2021", "2020-09-01|2021-10-01"), ("Q3 2020 then 2021-02 then may 2022", "2020-07-01|2021-02-01|2022-05-01"), ("in 1999", "")]


@query(_expected(_DATES, 1, "dates"))
def dates_about(spark, sf):
    return _cases(spark, sf, [(r[0],) for r in _DATES]).select("id", F.array_join(text.approximate_dates(F.col("c0")).cast("array<string>"), "|").alias("dates"))


_ANSWERS = [('{"a": 1}', "direct", '{"a": 1}'), ('{"a": [1, 2', "repaired", '{"a": [1, 2]}'), ('Here:\n```json\n{"a": 2}\n```\nDone', "fenced", '{"a": 2}'), ('I think {"a": 3} fits', "embedded", '{"a": 3}'), ("nothing", None, None)]


@query("select o_orderkey as id, " + _case("o_orderkey", ["null" if m is None else repr(m) for _, m, _ in _ANSWERS], 5) + " as mode, " + _case("o_orderkey", ["null" if j is None else repr(j) for *_, j in _ANSWERS], 5) + " as json from orders")
def model_json(spark, sf):
    return _cases(spark, sf, [(r[0],) for r in _ANSWERS]).select("id", extract.parse_model_json("c0").alias("p")).select("id", "p.mode", "p.json")


_FLAT = r"regexp_replace(regexp_replace(text, '[\s\x0b\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(rf"""with x as (select doc_id, {_FLAT} as flat from documents), y as (select *, left(flat, 250) as head, regexp_extract(left(flat, 250), '^(.{{31,}}[.!?]) ', 1, 's') as sentence, regexp_extract(left(flat, 250), '^(.{{31,}}) ', 1, 's') as word from x)
select doc_id, md5(case when len(flat) <= 250 then flat when sentence <> '' then sentence when word <> '' then word || '…' else head || '…' end) as excerpt from y""")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean_excerpt(F.col("text"))).alias("excerpt"))


@query("""select doc_id, md5(case when doc_id % 5 = 0 then source when strpos(text, ':') between 2 and 60 then left(text, strpos(text, ':') - 1) when len(text) <= 80 then text else left(text, 77) || '...' end) as headline from documents""")
def headlines(spark, sf):
    """Headlines of the documents, every fifth with a topic."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.headline(F.when(F.col("doc_id") % 5 == 0, F.col("source")), F.col("text"))).alias("headline"))


@query(r"""with x as (select doc_id, source, regexp_replace(split_part(text, chr(10), 1), '^[\s\x0b\x{a0}\x{3000}]+|[\s\x0b\x{a0}\x{3000}]+$', '', 'g') as line, regexp_replace(text, '^[\s\x0b\x{a0}\x{3000}]+|[\s\x0b\x{a0}\x{3000}]+$', '', 'g') as told from documents)
select doc_id, md5(case when doc_id % 3 = 0 and told <> '' then 'What is the correct information regarding: ' || left(told, 120) when doc_id % 3 = 1 then 'What is the current policy on ' || source || ' and ' || lang || '?' else 'What is the current policy on ' || left(line, 80) || '?' end) as question from x join documents using (doc_id, source)""")
def questions(spark, sf):
    """Questions about the documents, by description, by titles and by summary."""
    k, none = F.col("doc_id") % 3, F.array().cast("array<string>")
    asked = feedback.detection_question(F.when(k == 0, F.col("text")), F.when(k == 1, F.array("source", "lang")).otherwise(none), F.array("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(asked).alias("question"))


@query("select p_partkey, round(len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 9) as jaccard, round(len(list_intersect(a, b))::double / least(len(a), len(b)), 9) as overlap from (select p_partkey, list_distinct(string_split(p_name, ' ')) as a, list_distinct(string_split(p_name || ' ' || p_type, ' ')) as b from part)")
def set_overlaps(spark, sf):
    a, b = F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    return _parts(spark, sf).select("p_partkey", F.round(text.jaccard(a, b), 9).alias("jaccard"), F.round(text.overlap_of_smaller(a, b), 9).alias("overlap"))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def next_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    met = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return met.select("a.vec_id", F.round(scores.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@query("""with x as (select p_partkey, p_size / 50.0::double as a, (p_partkey % 10) / 10.0::double as b, ['info', 'warning', 'critical'][p_partkey % 3 + 1] as severity from part), y as (select *, 2 * greatest(0.0::double, least(1.0::double, 0.5::double + greatest(a, b) + 0.5::double * least(a, b))) as m from x)
select p_partkey, round(m, 9) as multiplier, ['info', 'warning', 'critical'][greatest(1, least(3, floor((p_partkey % 3 + 1) * m + 0.5::double)))::int] as adjusted from y""")
def adjusted_severity(spark, sf):
    a, b = F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 10.0
    m = scores.authority_multiplier(a, b)
    return _parts(spark, sf).select("p_partkey", F.round(m, 9).alias("multiplier"), scores.adjust_severity(_pick("p_partkey", list(scores.SEVERITIES)), m).alias("adjusted"))


@query("""with o as (select o_custkey, list(o_orderkey order by o_orderkey) as v, count(*)::int as n from orders group by o_custkey) select o_custkey, case when n % 2 = 1 then v[(n + 1) // 2] else floor((v[n // 2] + v[n // 2 + 1]) / 2.0::double + 0.5::double)::bigint end::bigint as median from o""")
def median_orders(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("v"))
    return rows.select("o_custkey", scores.median_int(F.col("v")).cast("long").alias("median"))


_WORDS = "list_filter(regexp_split_to_array(lower({}), '\\W+'), lambda w: len(w) > 2)"


@query(f"""with x as (select item_id, list_distinct({_WORDS.format('text')}) as e, {_WORDS.format('substr(text, 1, len(text) // 2)')} as g from benchmark) select item_id, round(case when len(e) = 0 then 0 else len(list_intersect(e, g))::double / len(e) end, 9) as reward from x""")
def completion_rewards(spark, sf):
    half = F.expr("substring(text, 1, cast(length(text) div 2 as int))")
    return table(spark, sf, "benchmark").select("item_id", F.round(scores.keyword_reward(F.col("text"), half), 9).alias("reward"))


@query("select p_partkey, round((case when contains(lower(a), lower(p_name)) then 1 else 0 end + case when contains(lower(a), lower(p_brand)) then 1 else 0 end + 0) / 3.0::double, 9) as score from (select *, 'It is a ' || upper(p_name) || case when p_partkey % 2 = 0 then ' of ' || lower(p_brand) else '' end as a from part)")
def fact_scores(spark, sf):
    said = F.concat(F.lit("It is a "), F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" of "), F.lower("p_brand"))).otherwise(""))
    return _parts(spark, sf).select("p_partkey", F.round(scores.key_fact_score(F.array("p_name", "p_brand", F.lit("no such fact")), said), 9).alias("score"))


# --- pairs -----------------------------------------------------------------------------------------------------------------
@query(f"""with {NODES_SQL} select least(a.id, b.id) as x, greatest(a.id, b.id) as y, case when a.ord < b.ord then a.p_size else b.p_size end as size_a, case when a.ord < b.ord then b.p_size else a.p_size end as size_b from nodes a join nodes b on a.id < b.id and a.e1 = b.e1 and a.e2 = b.e2 and a.e3 = b.e3 and a.p_size <> b.p_size""")
def fact_conflicts(spark, sf):
    """Parts of one name, brand and type whose facts give other sizes."""
    sizes = _parts(spark, sf).select(F.concat(F.lit("part-"), _s("p_partkey")).alias("id"), F.array(F.concat(F.lit("The stock holds "), _s("p_size"), F.lit(" pieces"))).alias("facts"))
    found = pairs.fact_contradictions(d.nodes(spark, sf).drop("facts").join(sizes, "id"))
    number = lambda c: F.regexp_extract(F.element_at(c, 1), r"(\d+)", 1).cast("int")
    return found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), number("only_a").alias("size_a"), number("only_b").alias("size_b"))


@query(f"""with {EDGES_SQL}, e as (select newer_key as a, older_key as b, case when confidence >= 0.8 then 'critical' else 'warning' end as s from edges where type = 'contradicts')
select 'part-' || a as a, 'part-' || b as b, case when a % 7 = 0 and b % 7 = 0 then 'critical' when x.p_brand = y.p_brand then 'critical' else s end as severity from e join part x on x.p_partkey = a join part y on y.p_partkey = b""")
def boosted(spark, sf):
    nodes = d.nodes(spark, sf)
    return pairs.boost_severity(pairs.edge_contradictions(nodes, d.edges(spark, sf)), nodes)


@query(f"""with {EDGES_SQL}, s as (select list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s, a.vec_id as x, b.vec_id as y, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc) as k from embeddings a, embeddings b)
select distinct x::varchar || ':' || y::varchar as request_id from (select least(x::varchar, y::varchar) as x, greatest(x::varchar, y::varchar) as y from s where k <= 6 and x <> y and s >= 0.15)""")
def pairs_to_ask(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"), "embedding")
    return answers.edge_candidates(e, 6, 0.15, None).select("request_id")


# --- model answers -----------------------------------------------------------------------------------------------------------
def _asked(spark, sf) -> DataFrame:
    """Pairs of parts in a row that a model was asked about, each twice."""
    e = d.edges(spark, sf).where("type = 'supersedes'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.regexp_extract("source_id", r"\d+", 0).cast("long").alias("k"))
    return e.select("a", "b", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).withColumns({"request_id": F.concat_ws("/", _s("k"), _s("n")), "ord_a": F.col("k"), "ord_b": F.col("n")})


_TOLD = f"{EDGES_SQL}, told as (select source_id as a, target_id as b, newer_key as k from edges where type = 'supersedes')"


def _answered(spark, sf, response) -> DataFrame:
    return _asked(spark, sf).select("request_id", response.alias("response"))


def _none(spark, sf):
    """Pairs seen before: those of every seventh part, the other way round."""
    return _asked(spark, sf).where("k % 7 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))


@query(f"""with {_TOLD} select a, b, case when k % 2 = 0 then 'critical' else 'warning' end as severity, 'When discussing the size, ' || x.p_name || ' states: ''A0''. However, ' || y.p_name || ' states: ''B''.' as description, case when k % 2 = 0 then 'high' else 'medium' end as confidence
from told join part x on 'part-' || x.p_partkey = a join part y on 'part-' || y.p_partkey = b where k % 7 <> 0 and k % 3 <> 0""")
def compared_claims(spark, sf):
    k = F.col("k")
    said = F.concat(F.lit('```json\n{"isContradiction": '), F.when(k % 3 == 0, "false").otherwise("true"), F.lit(', "topic": "the size", "claimA": "A'), _s("n"), F.lit('", "claimB": "B", "severity": "'), F.when(k % 2 == 0, "critical").otherwise("odd"), F.lit('", "explanation": "e"}\n```'))
    return answers.apply_claim_comparison(_asked(spark, sf), _answered(spark, sf, said), d.nodes(spark, sf), _none(spark, sf)).select("a", "b", "severity", "description", "confidence")


@query(f"with {_TOLD} select a, b, 0.9::double as confidence, 'n0' as explanation from told where k % 7 <> 0 and k % 3 = 1")
def nli_verdicts(spark, sf):
    k = F.col("k")
    said = F.concat(F.lit('{"verdict": "'), F.when(k % 3 == 1, "Contradiction").otherwise("neutral"), F.lit('", "confidence": 0.9, "explanation": "n'), _s("n"), F.lit('"}'))
    return answers.apply_nli(_asked(spark, sf), _answered(spark, sf, said), _none(spark, sf))


@query(f"with {_TOLD} select a, b, case when k % 2 = 0 then 'warning' else 'info' end as severity, 'r' as reason from told, (values (0), (1)) n(n) where k % 3 = 1")
def told_twice(spark, sf):
    k = F.col("k")
    said = F.concat(F.lit('{"isDuplicate": '), F.when(k % 3 == 1, "true").otherwise("false"), F.when(k % 2 == 0, ', "severity": "warning"').otherwise(""), F.lit(', "reason": "r"}'))
    return answers.apply_split_truth(_asked(spark, sf), _answered(spark, sf, said))


@query(f"""with {_TOLD} select a as source_id, b as target_id, ['contradicts', 'supersedes', 'related'][k % 5 + 1] as type, [0.9::double, 0.85::double, 0.6::double][k % 5 + 1] as confidence from told, (values (0), (1)) n(n) where k % 5 < 3""")
def answered_edges(spark, sf):
    said = F.concat(F.lit('{"type": "'), _pick("k", ["contradicts", "supersedes", "related", "none", "odd"]), F.lit('", "reason": "x"}'))
    return answers.apply_edge_answers(_asked(spark, sf), _answered(spark, sf, said)).select("source_id", "target_id", "type", "confidence")


@query(f"with {DETECTIONS_SQL} select ord as request_id, case ord % 3 when 0 then 'high' else 'low' end as confidence from detections where ord % 3 <> 1")
def validated(spark, sf):
    x = d.detections(spark, sf).select(F.col("ord").alias("request_id"))
    said = x.select("request_id", _pick("request_id", ['{"isReal": true, "confidence": "high"}', '{"isReal": false}', "no answer"]).alias("response"))
    return answers.apply_validation(x, said).select("request_id", "confidence")


@query("select 'part-' || p_partkey as id, '2024-01' as deadline, p_partkey % 4 = 0 as expired, case when p_partkey % 4 = 0 then 'critical' else 'warning' end as severity from part where p_partkey % 2 = 0")
def told_deadlines(spark, sf):
    nodes = _parts(spark, sf).select(F.concat(F.lit("part-"), _s("p_partkey")).alias("id"), F.col("p_name").alias("title"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("facts"), F.when(F.col("p_partkey") % 2 == 0, "Done by 2024-01").otherwise("No date").alias("raw"), F.col("p_partkey").alias("k"))
    asked = answers.time_bomb_candidates(nodes)
    said = nodes.select(F.col("id").alias("request_id"), F.concat(F.lit('{"hasTimeBomb": true, "deadline": "2024-01", "expired": '), F.when(F.col("k") % 4 == 0, "true").otherwise("false"), F.lit("}")).alias("response"))
    return answers.apply_time_bombs(asked, said).drop("description")


@query(f"""with {_TOLD} select a || '>' || b as detection_id, 'Which is right? ' || 'Parts' as prompt, case when k % 2 = 0 then x.p_type else y.p_type end as chosen, case when k % 2 = 0 then y.p_type else x.p_type end as rejected, case when k % 3 = 0 then 1.0::double when k % 3 = 1 then 0.7::double else 0.9::double end as confidence
from told join part x on 'part-' || x.p_partkey = a join part y on 'part-' || y.p_partkey = b""")
def choice_pairs(spark, sf):
    k = F.col("k")
    x = _asked(spark, sf).where("n = 0").withColumn("detection_id", F.concat_ws(">", "a", "b"))
    nodes = _parts(spark, sf).select(F.concat(F.lit("part-"), _s("p_partkey")).alias("id"), F.col("p_type").alias("raw"), F.lit("s").alias("summary"))
    choices = x.select("detection_id", F.when(k % 2 == 0, "A").otherwise("b").alias("choice"), F.when(k % 3 == 2, 0.9).alias("confidence"), F.when(k % 3 == 0, "user").otherwise("auto").alias("resolved_by"))
    return answers.pairs_from_choices(x.select("detection_id", "a", "b", F.lit("Parts: they differ").alias("description")), nodes, choices)


@query(f"""with {_FINDINGS}, n as (select c_custkey as k from customer) select ord, {_case("ord", ["'contradiction'", "'duplicate'", "'staleness'", "'time_bomb'", "'undocumented'", "'undocumented'", "'undocumented'"], 8)} as type, case when k is null then '' else 'c' || o_custkey end as node_ids from findings left join n on k = o_custkey""")
def finding_detections(spark, sf):
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("c"), _s("c_custkey")).alias("id"), F.concat(F.lit("notes/c"), _s("c_custkey"), F.lit(".md")).alias("source_id"), F.col("c_custkey").alias("ord"))
    rows = filters.clean_findings(_findings(spark, sf)).withColumn("affected_documents", F.transform("affected_documents", lambda f: F.replace(f, F.lit("docs/"), F.lit("notes/"))))
    return answers.findings_to_detections(rows, nodes).select("ord", "type", F.array_join("node_ids", "|").alias("node_ids"))


@query(f"""with {DETECTIONS_SQL} select ord, case type when 'contradiction' then 'contradiction' when 'duplicate' then 'duplicate_truth' when 'staleness' then 'stale_commitment' when 'time_bomb' then 'commitment_without_followthrough' else 'tribal_knowledge' end as category,
'Order ' || ord as headline, case when type in ('staleness', 'time_bomb') then 'quick_win' when type = 'undocumented' then 'major' else 'medium' end as effort, node_ids[1] as documents from detections""")
def detection_findings(spark, sf):
    rows = d.detections(spark, sf).withColumns({"topic": F.lit(None).cast("string"), "nodes": F.transform(F.slice("node_ids", 1, 1), lambda x: F.struct(x.alias("source"), F.lit("q").alias("excerpt")))})
    return answers.detections_to_findings(rows).select("ord", "category", "headline", "effort", F.array_join("affected_documents", "|").alias("documents"))


@query(f"""with {_TOLD} select a, b, x.p_type as right, y.p_type as wrong from told join part x on 'part-' || x.p_partkey = a join part y on 'part-' || y.p_partkey = b""")
def scenarios(spark, sf):
    nodes = _parts(spark, sf).select(F.concat(F.lit("part-"), _s("p_partkey")).alias("id"), F.lit(None).cast("string").alias("raw"), F.col("p_type").alias("summary"))
    return answers.contradiction_scenarios(nodes, _asked(spark, sf).where("n = 0").select("a", "b", F.col("a").alias("correct")))


@query("select c_custkey as path, case when c_custkey % 2 = 0 then 'new' else '' end as topics, case when c_custkey % 2 = 0 then 'ada' end as owner from customer")
def mapped_documents(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"))
    said = c.where("path % 2 = 0").select("path", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.array(F.lit("old")).alias("topics")), F.struct(F.lit(1).alias("ord"), F.array(F.lit("new")).alias("topics")))).alias("x")).select("path", "x.ord", "x.topics", F.lit("ada").alias("owner"))
    return answers.document_map(c, said).select("path", F.array_join("topics", "|").alias("topics"), "owner")


@query(f"""with {DETECTIONS_SQL} select ord as detection_id, 'part-' || (ord % 100) as id, p_name as title, case when ord % 2 = 0 then 'told' else p_type end as excerpt from detections join part on p_partkey = ord % 100""")
def detection_context(spark, sf):
    nodes = _parts(spark, sf).select(F.concat(F.lit("part-"), _s("p_partkey")).alias("id"), F.col("p_name").alias("title"), F.lit("f.md").alias("source_id"), F.col("p_type").alias("raw"), F.lit("").alias("summary"))
    k = F.concat(F.lit("part-"), (F.col("ord") % 100).cast("string"))
    rows = d.detections(spark, sf).select(F.col("ord").alias("detection_id"), F.array(F.lit("gone"), k).alias("node_ids"), F.when(F.col("ord") % 2 == 0, F.create_map(k, F.lit("told"))).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("excerpts"))
    return detect.attach_context(rows, nodes).select("detection_id", F.explode("nodes").alias("n")).select("detection_id", "n.id", "n.title", "n.excerpt")


# --- reports and evaluation ---------------------------------------------------------------------------------------------------
@query(f"""with {DETECTIONS_SQL} select greatest(0, least(100, 100 - 15 * count(*) filter (where severity = 'critical' and type in ('contradiction', 'duplicate')) - 8 * count(*) filter (where severity = 'warning' and type in ('contradiction', 'duplicate'))))::bigint as consistency,
greatest(0, 100 - 12 * count(*) filter (where type = 'staleness') - 10 * count(*) filter (where type = 'time_bomb'))::bigint as freshness, greatest(0, 100 - 10 * count(*) filter (where type = 'undocumented'))::bigint as coverage from detections""")
def dimensions(spark, sf):
    return report.three_dimensions(d.detections(spark, sf))


@query("""with t as (select n_name as topic from nation union all select n_name from nation where n_nationkey % 3 = 0) select topic, count(*) as n, case when topic in ('NATION_1', 'NATION_10', 'NATION_11', 'NATION_12', 'NATION_13', 'NATION_14', 'NATION_15', 'NATION_16', 'NATION_17', 'NATION_18', 'NATION_19') then 'conflicted' when count(*) >= 2 then 'healthy' else 'thin' end as state from t group by topic""")
def topics(spark, sf):
    n = table(spark, sf, "nation")
    maps = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.array("n_name", "n_name")).otherwise(F.array("n_name")).alias("topics"))
    found = n.where("n_nationkey = 1").select(F.lit("contradiction").alias("category"), F.array(F.lit("docs/nation_1.md")).alias("affected_documents"))
    return report.topic_coverage(maps, found)


@query("select o_orderpriority as detector, count(*) as detections, (select count(*) from part) as nodes from orders group by o_orderpriority")
def detector_counts(spark, sf):
    return report.detector_stats(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("detector")), d.nodes(spark, sf))


@query("""with r as (select distinct l_linenumber as run, l_partkey as key from lineitem where l_linenumber <= 3), n as (select run, count(*) as n from r group by run), b as (select x.run as ra, y.run as rb, count(*) as shared from r x join r y on x.key = y.key and x.run < y.run group by all),
j as (select b.shared::double / (p.n + q.n - b.shared) as j from b join n p on p.run = ra join n q on q.run = rb) select round(avg(j), 9) as mean, round(min(j), 9) as least, round(max(j), 9) as most, min(j) >= 0.8 as passed, (select count(distinct key) from r) as distinct_findings from j""")
def consistency(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_linenumber").alias("run"), F.col("l_partkey").alias("key"))
    out = evaluate.run_consistency(rows)
    return out.select(F.round("mean", 9).alias("mean"), F.round("min", 9).alias("least"), F.round("max", 9).alias("most"), "passed", "distinct_findings")


@query("select avg(case when p_partkey % 3 = 0 then 0.0::double else 1.0::double end) as resolution_rate from part")
def resolved_share(spark, sf):
    good, bad = F.concat(F.lit("chosen answer "), "p_type"), F.lit("other words entirely")
    return evaluate.resolution_rate(_parts(spark, sf).select(good.alias("chosen"), bad.alias("rejected"), F.when(F.col("p_partkey") % 3 == 0, bad).otherwise(good).alias("answer")))


@query("select b.n - a.n as n_pairs, b.n - a.n as n_nodes, 0::bigint as n_sft, 2 * (b.n - a.n) as n_total from (select count(*) as n from orders where o_orderstatus = 'F') a, (select count(*) as n from orders where o_orderstatus = 'O') b")
def version_changes(spark, sf):
    v = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("version_id")).agg(F.count("*").alias("n_pairs"), F.count("*").alias("n_nodes"), F.lit(0).cast("long").alias("n_sft"), (2 * F.count("*")).alias("n_total"))
    return evaluate.version_delta(v, "F", "O")


@query("""select 'part-' || p_partkey as id, 'What is known about ' || p_name || '?' as question, p_type || ' It is a ' || p_brand as expected_answer, 'product' as domain, 'easy' as difficulty from part where p_size >= 40""")
def node_benchmark(spark, sf):
    nodes = d.nodes(spark, sf).drop("summary", "facts").join(_parts(spark, sf).select(F.concat(F.lit("part-"), _s("p_partkey")).alias("id"), F.col("p_type").alias("summary"), F.array(F.concat(F.lit("It is a "), "p_brand")).alias("facts")), "id")
    return evaluate.benchmark_from_nodes(nodes)


@query("""select o_orderkey as id, 'Which of ' || o_orderkey || '?' || chr(10) || 'A: ' || o_orderstatus || chr(10) || 'B: ' || o_orderpriority as question, o_orderstatus as expected_answer, 'contradiction' as domain, 'medium' as difficulty from orders""")
def pair_benchmark(spark, sf):
    return evaluate.benchmark_from_pairs(_preferences(spark, sf))


@query("""select c_custkey as id, 'Who?' as question, c_name as expected_answer, case when c_custkey % 2 = 0 then 'crm' else 'general' end as domain, 'medium' as difficulty from customer""")
def question_benchmark(spark, sf):
    return evaluate.benchmark_from_questions(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("Who?").alias("question"), F.col("c_name").alias("correct_answer"), F.when(F.col("c_custkey") % 2 == 0, "crm").alias("domain")))


@query("""with m as (select r.r_regionkey as k, avg(case when o_orderstatus = 'F' then 1.0::double else 0.0::double end) as x from orders, region r where r_regionkey < 3 and o_orderkey % (r_regionkey + 2) = 0 group by 1)
select max(case when k = 2 then x end) >= max(case when k = 1 then x end) and max(case when k = 2 then x end) >= max(case when k = 0 then x end) and max(case when k = 2 then x end) > greatest(max(case when k = 0 then x end), max(case when k = 1 then x end)) as passed from m""")
def approaches(spark, sf):
    r = table(spark, sf, "region").where("r_regionkey < 3")
    met = table(spark, sf, "orders").join(F.broadcast(r), F.col("o_orderkey") % (F.col("r_regionkey") + 2) == 0)  # three rows
    x = met.groupBy(_pick("r_regionkey", ["a", "b", "c"]).alias("approach")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("x"))
    return evaluate.approach_gate(x.select("approach", F.col("x").alias("precision"), F.col("x").alias("recall"), F.col("x").alias("f1")))


@query("""select c_custkey as model_id, metric, least, value from (select c_custkey, 'accuracy' as metric, 0.5::double as least, (c_custkey % 10) / 10.0::double as value from customer union all select c_custkey, 'similarity', 0.1::double, null from customer) where value is null or value < least""")
def policy_misses(spark, sf):
    models = table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id"), F.create_map(F.lit("accuracy"), (F.col("c_custkey") % 10) / 10.0).alias("eval_scores"))
    minimum = table(spark, sf, "region").where("r_regionkey < 2").select(_pick("r_regionkey", ["accuracy", "similarity"]).alias("metric"), F.when(F.col("r_regionkey") == 0, 0.5).otherwise(0.1).alias("least"))
    return evaluate.policy_failures(models, minimum)


@query("""select count(*) filter (where c_custkey % 2 = 0) as tp, 0::bigint as fp, count(*) filter (where c_custkey % 2 = 1) as fn from customer""")
def fuzzy_hits(spark, sf):
    """Half of the customers, found by their name in other words."""
    c = table(spark, sf, "customer")
    told = lambda s: F.concat(F.lit(s), F.replace("c_name", F.lit("#"), F.lit("x")))
    truth = c.select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("type"), told("truth ").alias("text"))
    return evaluate.fuzzy_metrics(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("type"), told("seen ").alias("text")), truth).select("tp", "fp", "fn")


@query("""select 'supplier' || s_suppkey as category, 2::bigint as votes, 'warning' as severity, 'Clash of sizes and owners' as headline from supplier where s_suppkey % 2 = 0""")
def agreed_findings(spark, sf):
    """Findings of two of three passes, with one word more in the second; every other supplier has only one."""
    s = table(spark, sf, "supplier")
    both = F.array(F.struct(F.lit(0).alias("p"), F.lit("Clash of sizes").alias("h")), F.struct(F.lit(1).alias("p"), F.lit("Clash of sizes and owners").alias("h")))
    rows = s.select("s_suppkey", F.explode(F.when(F.col("s_suppkey") % 2 == 0, both).otherwise(F.slice(both, 1, 1))).alias("x"))
    rows = rows.select(F.concat(F.lit("supplier"), _s("s_suppkey")).alias("category"), F.col("x.p").alias("pass_index"), F.col("s_suppkey").alias("ord"), F.lit("warning").alias("severity"), F.col("x.h").alias("headline"), F.array().cast("array<string>").alias("affected_documents"))
    return detect.consensus(rows, 3).select("category", F.col("votes").cast("long").alias("votes"), "severity", "headline")


def _first_words(n: int):
    return F.array_join(F.slice(F.split("text", r"\s+"), 1, n), " ")


@query()
def agreed_headlines(spark, sf):
    """What two of three passes say alike in the first words of the documents, pass by pass in order of their number."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("category"), (F.col("doc_id") % 3).cast("int").alias("pass_index"), F.col("doc_id").alias("ord"), F.element_at(F.array(*[F.lit(x) for x in ("info", "warning", "critical")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("severity"), _first_words(9).alias("headline"), F.array("source").alias("affected_documents"))
    return detect.consensus(docs, 3).select("category", "cluster", F.col("votes").cast("long").alias("votes"), "severity", "headline", F.size("documents").cast("long").alias("n_documents"))


@query()
def fuzzy_documents(spark, sf):
    """Documents with an odd number as detections of those with an even one, by their first words: copies compete for one truth."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("type"), _first_words(6).alias("text"))
    return evaluate.fuzzy_metrics(docs.where("ord % 2 = 1"), docs.where("ord % 2 = 0")).select("tp", "fp", "fn")


@query("""select least(a, b) as lo, greatest(a, b) as hi, min(k) as k from (select 'c' || o_custkey as a, 'd' || (o_orderkey % 10) as b, o_orderkey as k from orders union all select 'd' || (o_orderkey % 10), 'c' || o_custkey, o_orderkey + 1 from orders) group by 1, 2""")
def once_per_pair(spark, sf):
    o = table(spark, sf, "orders")
    one, two = F.concat(F.lit("c"), _s("o_custkey")), F.concat(F.lit("d"), (F.col("o_orderkey") % 10).cast("string"))
    rows = o.select(one.alias("a"), two.alias("b"), F.col("o_orderkey").alias("k")).unionByName(o.select(two.alias("a"), one.alias("b"), (F.col("o_orderkey") + 1).alias("k")))
    return answers.first_per_pair(rows, "k").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "k")
