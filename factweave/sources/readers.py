"""Landed files, pages, chats, issues and tables to documents, and documents to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions.extract import csv_to_markdown, markdown_sections, resolve_links
from factweave.functions.text import doc_type

SKIP = r"/(?:node_modules|dist|\.git)/"
ASSETS = r"(?i)\.(?:png|jpe?g|gif|svg|webp|ico|css|js|pdf|zip|gz|mp4|mp3|woff2?)(?:[?#]|$)"
# Entities that are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
LEAST_TEXT = 50


def _sub(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def read_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``path, content, sha256, ord`` of the files under a folder, outside tool folders, in order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    rows = files.where(~F.col("path").rlike(SKIP)).select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"))
    return with_order(rows, "path")


def with_order(df: DataFrame, *keys: str) -> DataFrame:
    """``ord``: the rank of a row by ``keys``, made by a sort over ranges and counts of their sizes, not by one task."""
    part = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    sizes = part.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__least"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", "__least", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return part.join(F.broadcast(starts), "__p").withColumn("ord", F.col("__start") + F.col("__i") - F.col("__least")).drop("__p", "__i", "__least", "__start")


def plan_incremental(files: DataFrame, ingest_log: DataFrame) -> DataFrame:
    """``files`` with ``status``: new, changed or unchanged against the hashes of the log ``(file_path, file_hash)``."""
    log = ingest_log.groupBy("file_path").agg(F.max_by("file_hash", "ingested_at").alias("known_hash"))
    status = F.when(F.col("known_hash").isNull(), "new").when(F.col("known_hash") == F.col("sha256"), "unchanged").otherwise("changed")
    return files.join(log, files["path"] == log["file_path"], "left").withColumn("status", status).drop("file_path", "known_hash")


def purge_changed(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """Nodes without those of changed files."""
    return nodes.join(plan.where("status = 'changed'").select(F.col("path").alias("source_id")), "source_id", "left_anti")


def html_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), F.trim(found)).otherwise("Untitled")


# Tags that go with what is in them, and what stands for the others, in order.
DROPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside")
TAG_RULES = (
    *((rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n") for n in range(1, 7)),
    (r"(?is)<li[^>]*>(.*?)</li>", "- $1\n"),
    (r"(?i)</?[ou]l[^>]*>", "\n"),
    (r"(?is)<p[^>]*>(.*?)</p>", "\n$1\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<hr\s*/?>", "\n---\n"),
    (r"(?is)<(?:strong|b)[^>]*>(.*?)</(?:strong|b)>", "**$1**"),
    (r"(?is)<(?:em|i)[^>]*>(.*?)</(?:em|i)>", "*$1*"),
    (r"(?is)<pre[^>]*><code[^>]*>(.*?)</code></pre>", "\n```\n$1\n```\n"),
    (r"(?is)<code[^>]*>(.*?)</code>", "`$1`"),
    (r"(?is)<a[^>]*>(.*?)</a>", "$1"),
    (r"<[^>]+>", ""),
)


def html_to_markdown(html: Column) -> Column:
    """Text of a page with Markdown marks; scripts, styles, navigation, header, footer, asides and comments go."""
    dropped = [(rf"(?is)<{t}.*?</{t}>", "") for t in DROPPED_TAGS]
    c = _sub(F.coalesce(html, F.lit("")), *dropped, (r"(?s)<!--.*?-->", ""), *TAG_RULES)
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return trimmed_lines(c)


def trimmed_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def pages_to_markdown(pages: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """``page_id, url, title, markdown`` of pages that are no assets and have more than ``least`` characters of text."""
    rows = pages.where(~F.coalesce(F.col("url").rlike(ASSETS), F.lit(False)))
    return rows.select("page_id", "url", html_title(F.col("html")).alias("title"), html_to_markdown(F.col("html")).alias("markdown")).where(F.length("markdown") > least)


def filter_disallowed(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Pages whose path starts with no ``Disallow`` rule for all agents; ``robots``: ``host, body``."""
    lines = robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    agent = F.when(F.lower(line).startswith("user-agent:"), F.trim(F.substring(line, 12, 200)))
    order = Window.partitionBy("host").orderBy("pos")
    rules = lines.withColumn("agent", F.last(agent, ignorenulls=True).over(order)).where((F.col("agent") == "*") & F.lower(line).startswith("disallow:"))
    rules = rules.select("host", F.trim(F.substring(line, 10, 2000)).alias("prefix")).where("prefix <> ''").distinct()
    rows = pages.withColumn("__host", F.try_parse_url("url", F.lit("HOST"))).withColumn("__path", F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/")))
    return rows.join(rules, (F.col("__host") == F.col("host")) & F.col("__path").startswith(F.col("prefix")), "left_anti").drop("__host", "__path")


def extract_links(pages: DataFrame) -> DataFrame:
    """Distinct ``page_id, target``: links to the page's own host, resolved, without fragments."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"'#]+)"""), F.lit(1))
    rows = pages.select("page_id", "url", F.explode(resolve_links("url", hrefs)).alias("target"))
    same = (F.try_parse_url("target", F.lit("HOST")) == F.try_parse_url("url", F.lit("HOST"))) & (F.try_parse_url("target", F.lit("PROTOCOL")) == F.try_parse_url("url", F.lit("PROTOCOL")))
    return rows.where(same).select("page_id", "target").distinct()


def read_wiki_export(files: DataFrame, most: int | None = None) -> DataFrame:
    """Exported wiki pages ``(path, content)`` to ``path, title, markdown``: image folders and page furniture dropped."""
    rows = files.where(~F.col("path").rlike(r"/(?:images|attachments)/"))
    body = _sub(F.col("content"), (r"(?is)<div[^>]*(?:id|class)=\"(?:page-metadata|breadcrumb[^\"]*|footer)\"[^>]*>.*?</div>", ""), (r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", "$1 | "), (r"(?is)<tr[^>]*>(.*?)</tr>", "\n| $1\n"))
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html?$", ""), "[-_+]", " ")
    title = F.regexp_replace(html_title(F.col("content")), r" - Confluence.*$", "")
    out = rows.select("path", F.when(title.isin("Untitled", ""), name).otherwise(title).alias("title"), html_to_markdown(body).alias("markdown")).where(F.length("markdown") >= LEAST_TEXT)
    return out if most is None else out.orderBy("path").limit(most)


def read_notes_export(files: DataFrame) -> DataFrame:
    """Exported notes, Markdown or HTML: the 32-digit id at the end of a file name is dropped."""
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(?:md|html?)$", ""), r"[ -]?[0-9a-f]{32}$", "")
    text = F.when(F.col("path").rlike(r"\.html?$"), html_to_markdown(F.col("content"))).otherwise(F.regexp_replace("content", r"^\s+|\s+$", ""))
    return files.select("path", F.trim(name).alias("title"), text.alias("markdown")).where(F.length("markdown") >= LEAST_TEXT)


def storage_to_markdown(c: Column) -> Column:
    """Wiki storage XHTML to Markdown: code macros, panels, page links, tables, numeric entities."""
    c = _sub(
        F.coalesce(c, F.lit("")),
        (r"(?is)<ac:structured-macro[^>]*ac:name=\"code\"[^>]*>.*?<!\[CDATA\[(.*?)\]\]>.*?</ac:structured-macro>", "\n```\n$1\n```\n"),
        (r"(?is)</?ac:(?:structured-macro|rich-text-body|layout[^>]*|link)[^>]*>", ""),
        (r"(?is)<ri:page[^>]*ri:content-title=\"([^\"]*)\"[^>]*/?>", "$1"),
        (r"(?is)<ac:parameter[^>]*>.*?</ac:parameter>", ""),
        (r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", "$1 | "),
        (r"(?is)<tr[^>]*>(.*?)</tr>", "| $1\n"),
        (r"&#160;", " "),
        (r"&#8211;", "–"),
        (r"&#8217;", "’"),
    )
    return html_to_markdown(c)


def chat_html_to_text(c: Column) -> Column:
    """Chat HTML to text: mentions as @name, attachments dropped, links as their text."""
    c = _sub(F.coalesce(c, F.lit("")), (r"(?is)<at[^>]*>(.*?)</at>", "@$1"), (r"(?is)<attachment[^>]*>(?:.*?</attachment>)?", ""))
    return html_to_markdown(c)


def build_threads(messages: DataFrame, min_replies: int = 2) -> DataFrame:
    """Chat messages to threads: ``channel, thread, parent, replies, n_replies``.

    ``messages``: ``channel, ts, thread_ts, user, text, subtype`` and ``reactions``. Joins and leaves are dropped. A
    message without a thread, or that is its own, is a parent (the last such row wins, else the first message).
    """
    rows = messages.where(~F.coalesce(F.col("subtype").isin("channel_join", "channel_leave"), F.lit(False)))
    message = F.struct("ts", "user", "text", "reactions")
    is_parent = F.col("thread_ts").isNull() | (F.col("thread_ts") == F.col("ts"))
    grouped = rows.groupBy("channel", F.coalesce("thread_ts", "ts").alias("thread")).agg(
        F.max(F.when(is_parent, message)).alias("own"), F.min(message).alias("first"), F.sort_array(F.collect_list(message)).alias("every")
    )
    parent = F.coalesce("own", "first")
    out = grouped.select("channel", "thread", parent.alias("parent"), "every")
    out = out.select("channel", "thread", "parent", F.filter("every", lambda m: m["ts"] != F.col("parent.ts")).alias("replies"))
    return out.withColumn("n_replies", F.size("replies").cast("long")).where(F.col("n_replies") >= min_replies)


def threads_to_documents(threads: DataFrame, users: DataFrame) -> DataFrame:
    """Threads to documents: ``id, title, content, participants, n_replies, last_ts, reactions``.

    Up to 20 messages are shown; of more, the first five, up to three in the middle with three reactions or more, and
    the last five. ``users``: ``user, name``; a user without a name keeps the id.
    """
    every = threads.select("channel", "thread", "n_replies", F.posexplode(F.concat(F.array("parent"), "replies")).alias("pos", "m"))
    named = every.join(users.select(F.col("user").alias("__u"), "name"), F.col("m.user") == F.col("__u"), "left").withColumn("who", F.coalesce("name", "m.user"))
    line = F.concat(F.lit("**"), F.col("who"), F.lit("**: "), F.coalesce("m.text", F.lit("")))
    liked = F.coalesce(F.exists("m.reactions", lambda r: r["count"] >= 3), F.lit(False))
    row = F.struct("pos", line.alias("line"), "who", F.col("m.text").alias("text"), F.col("m.ts").alias("ts"), liked.alias("liked"))
    got = named.groupBy("channel", "thread", "n_replies").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    n = F.size("rows")
    middle = F.slice(F.filter(F.slice("rows", F.lit(6), F.greatest(n - 10, F.lit(0))), lambda x: x["liked"]), 1, 3)
    lines = lambda a: F.transform(a, lambda x: x["line"])
    short = F.concat(lines(F.slice("rows", 1, 5)), lines(middle), F.array(F.concat(F.lit("*… "), (n - 10 - F.size(middle)).cast("string"), F.lit(" messages omitted …*"))), lines(F.slice("rows", -5, 5)))
    body = F.when(n <= 20, lines(F.col("rows"))).otherwise(short)
    first = F.element_at("rows", 1)
    counts = threads.select("channel", "thread", F.explode(F.concat(F.array("parent"), "replies")).alias("m")).select("channel", "thread", F.explode("m.reactions").alias("r")).groupBy("channel", "thread", F.col("r.name").alias("name")).agg(F.sum("r.count").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("channel", "thread").orderBy(F.desc("n"), "name"))).where("k <= 5")
    best = best.groupBy("channel", "thread").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "name", "n"))), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("reactions"))
    out = got.select(
        "channel",
        "thread",
        F.concat_ws("-", "channel", "thread").alias("id"),
        F.concat(F.lit("#"), "channel", F.lit(" — "), first["who"], F.lit(": "), F.substring(F.element_at(F.split(F.coalesce(first["text"], F.lit("")), "\n"), 1), 1, 80)).alias("title"),
        F.array_join(body, "\n\n").alias("content"),
        F.array_distinct(F.transform("rows", lambda x: x["who"])).alias("participants"),
        "n_replies",
        F.element_at("rows", -1)["ts"].alias("last_ts"),
    )
    return out.join(best, ["channel", "thread"], "left").drop("channel", "thread")


def messages_to_documents(df: DataFrame, least: int = 20, redact: bool = False) -> DataFrame:
    """Messages ``id, subject, author, text`` to documents; shorter ones than ``least`` are dropped."""
    from factweave.functions.text import redact_emails

    author = redact_emails(F.col("author")) if redact else F.col("author")
    return df.withColumn("content", chat_html_to_text(F.col("text"))).where(F.length("content") >= least).select("id", F.col("subject").alias("title"), F.col("content"), author.alias("author"))


def issues_to_documents(issues: DataFrame, comments: DataFrame, least: int = 20) -> DataFrame:
    """Issues ``id, title, status, assignee, labels, project, body`` with their comments in order as documents."""
    said = comments.groupBy("issue_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "author", "text"))).alias("said"))
    rows = issues.join(said, issues["id"] == said["issue_id"], "left")
    head = F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.title()}: "), F.col(c).cast("string"))) for c in ("status", "assignee", "project")], F.when(F.size("labels") > 0, F.concat(F.lit("Labels: "), F.array_join("labels", ", "))))
    tail = F.array_join(F.transform(F.coalesce("said", F.array()), lambda x: F.concat_ws(": ", x["author"], x["text"])), "\n\n")
    content = F.concat_ws("\n\n", F.when(head != "", head), "body", F.when(tail != "", tail))
    return rows.select("id", "title", content.alias("content"), F.array(F.struct(F.lit("project").alias("type"), F.col("project").alias("name"))).alias("parent_chain")).where(F.length("content") >= least)


def pages_to_documents(df: DataFrame, least: int = 20) -> DataFrame:
    """Wiki or drive pages ``id, title, text, mime, parents`` to authoritative documents; CSV becomes a table."""
    content = F.when(F.col("mime") == "text/csv", csv_to_markdown("text")).otherwise(F.col("text"))
    return df.select("id", "title", content.alias("content"), F.col("parents").alias("parent_chain"), F.lit(True).alias("authoritative")).where(F.length("content") >= least)


def union_sources(*dfs: DataFrame) -> DataFrame:
    """All sources in one table; what a source lacks is null."""
    out, *rest = dfs
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def stage_markdown(df: DataFrame, prefix: str = "doc") -> DataFrame:
    """``file_name, body`` of documents: front matter of what is known, then the text."""
    slug = F.substring(F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", "-"), 1, 60)
    name = F.concat_ws("-", F.lit(prefix), slug, F.substring(F.md5(F.col("id").cast("string")), 1, 6))
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("source: "), F.col("source_url")), F.lit("---"))
    return df.select(F.concat(name, F.lit(".md")).alias("file_name"), F.concat_ws("\n\n", front, "content").alias("body"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exported JSONL files with their file and number: ``path, line_no, line``."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("path", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def build_nli_corpus(rows: DataFrame, per_label: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Premise / hypothesis rows ``id, label, premise, hypothesis`` to nodes and labelled pairs, ``per_label`` of each label."""
    pick = rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id"))).where(F.col("k") <= per_label)
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("premise").alias("text")), F.struct(F.lit("b").alias("side"), F.col("hypothesis").alias("text"))))
    nodes = pick.select("id", sides.alias("s")).select(F.concat_ws("-", F.col("id").cast("string"), "s.side").alias("id"), F.col("id").cast("string").alias("pair_id"), F.substring("s.text", 1, 2000).alias("raw"), F.substring("s.text", 1, 200).alias("summary"))
    pairs = pick.select(F.col("id").cast("string").alias("pair_id"), (F.col("label") == "contradiction").alias("has_contradiction"), F.concat(F.col("id").cast("string"), F.lit("-a")).alias("doc_a"), F.concat(F.col("id").cast("string"), F.lit("-b")).alias("doc_b"))
    return nodes, pairs


def chunk_markdown(docs: DataFrame, most: int = 2000, least: int = 100) -> DataFrame:
    """``doc_id, ordinal, heading, text, char_offset`` of Markdown documents; offsets run over the texts."""
    rows = docs.select("doc_id", F.posexplode(markdown_sections(F.col("text"), most, least)).alias("ordinal", "s")).select("doc_id", "ordinal", "s.heading", "s.text")
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("char_offset", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long"))


def chunk_windows(docs: DataFrame, size: int = 1500, overlap: int = 200, chars_per_page: int = 3000) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``: ``doc_id, char_offset, text, page_number``; blank ones go."""
    rows = docs.where(F.length("text") > 0).select("doc_id", F.col("text").alias("__t"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))).alias("char_offset"))
    cut = rows.select("doc_id", F.col("char_offset").cast("long"), F.trim(F.substring("__t", F.col("char_offset") + 1, F.lit(size))).alias("text"))
    return cut.where("text <> ''").withColumn("page_number", (F.floor(F.col("char_offset") / chars_per_page) + 1).cast("long"))


def build_nodes(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks ``doc_id, ordinal, heading, text`` of files ``doc_id, path`` to nodes with deterministic ids."""
    rows = chunks.join(files.select("doc_id", "path"), "doc_id")
    name = F.element_at(F.split("path", "/"), -1)
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    title = F.coalesce("heading", name)
    return rows.select(
        F.sha2(F.concat_ws("\u0001", F.col("path"), F.col("ordinal").cast("string")), 256).alias("id"),
        title.alias("title"),
        F.substring("text", 1, 200).alias("summary"),
        F.col("text").alias("raw"),
        F.regexp_extract(name, r"\.(\w+)$", 1).alias("source_type"),
        F.col("path").alias("source_id"),
        doc_type(title, F.col("text")).alias("doc_type"),
        F.transform(F.filter(folders, lambda f: f != ""), lambda f: F.struct(F.lit("folder").alias("type"), f.alias("name"))).alias("parent_chain"),
        "ordinal",
    )


def apply_extraction(nodes: DataFrame, answers: DataFrame, kinds: tuple[str, ...] = ("meeting_notes", "changelog", "config", "api_reference", "policy", "architecture", "guide", "general")) -> DataFrame:
    """Facts, entities and kind out of a model's answers ``id, facts, entities, doc_type``; unknown kinds are dropped."""
    rows = nodes.drop("facts", "entities").join(answers.select("id", "facts", "entities", F.col("doc_type").alias("__kind")), "id", "left")
    kind = F.when(F.col("__kind").isin(*kinds), F.col("__kind"))
    return rows.withColumns({"facts": F.coalesce("facts", F.array().cast("array<string>")), "doc_type": F.coalesce(kind, "doc_type")}).drop("__kind")


def apply_claims(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """Atomic claims of more than ten characters: ``node_id, node_title, source_file, pos, text``."""
    rows = nodes.join(answers.select("id", "claims"), "id").select(F.col("id").alias("node_id"), F.col("title").alias("node_title"), F.col("source_id").alias("source_file"), F.posexplode("claims").alias("pos", "text"))
    return rows.where(F.length("text") > 10)


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: the one with the highest version, an update before a base row of the same."""
    rows = base.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc(version), F.desc("__new"))
    return rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "__new")
