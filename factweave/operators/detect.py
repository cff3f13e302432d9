"""Detectors over nodes and edges, and what ties their results together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.extract import COMPLETION, deadlines
from factweave.functions.scores import round_half_up
from factweave.functions.text import B0, B1, SPACES, claim_stems, clean_excerpt, dated_mentions, jaccard, tokenize, topic_words
from factweave.operators.firstpairs import first_pairs
from factweave.operators.graph import connected_components
from factweave.operators.greedy import shared_prefixes, take_in_order
from factweave.operators.pairs import boost_severity, edge_contradictions, heuristic_contradictions, near_vectors, node_text, overlap_pairs, prefilter, shared_sets
from factweave.plans.staging import stage

DAY = 86400.0
CHAT = ("slack", "teams", "chat")


def superseded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``supersedes`` edges whose older node was last changed before the edge: ``newer, older, created_at``."""
    ids = nodes.select("id", F.coalesce("source_last_modified", "updated_at").alias("changed"))
    rows = edges.where("type = 'supersedes'").join(ids.select(F.col("id").alias("target_id"), "changed"), "target_id").join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return rows.where(F.col("changed") < F.coalesce("created_at", F.timestamp_seconds(F.lit(0)))).select(F.col("source_id").alias("newer"), F.col("target_id").alias("older"), "created_at")


def stale_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Superseded nodes with all that replace them: ``older, newer (array, in order), n_newer``."""
    rows = superseded(nodes, edges).join(nodes.select(F.col("id").alias("newer"), "ord"), "newer")
    got = rows.groupBy("older").agg(F.sort_array(F.collect_set(F.struct("ord", "newer"))).alias("x"))
    return got.select("older", F.transform("x", lambda y: y["newer"]).alias("newer"), F.size("x").cast("long").alias("n_newer"))


def dated_references(nodes: DataFrame, edges: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """Nodes, not superseded, whose first dated mention older than ``days`` tells their age: ``id, label, months_ago``."""
    gone = edges.where("type = 'supersedes'").select(F.col("target_id").alias("id")).distinct()
    age = lambda d: (F.unix_timestamp(as_of) - F.unix_timestamp(d.cast("timestamp"))) / DAY
    old = F.filter(dated_mentions(node_text()), lambda x: age(x["date"]) > days)
    rows = nodes.join(gone, "id", "left_anti").withColumn("hit", F.try_element_at(old, F.lit(1))).where("hit is not null")
    return rows.select("id", F.col("hit.label").alias("label"), round_half_up(age(F.col("hit.date")) / 30).alias("months_ago"))


DATE_GATE = rf"(?i)(?:{B0}Q[1-4]\s*20\d{{2}}|20\d{{2}}-\d{{2}}|{B0}by\s+(?:end|the|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|month|year))"


def deadline_hits(nodes: DataFrame, as_of: Column) -> DataFrame:
    """A row per deadline of a node: ``id, ord, pos, label, expired, months_ago, severity``."""
    rows = nodes.withColumn("body", node_text()).where(F.col("body").rlike(DATE_GATE))
    rows = rows.select("id", "ord", "doc_type", F.explode(deadlines(F.col("body"), as_of)).alias("d")).select("id", "ord", "doc_type", "d.pos", "d.label", F.to_timestamp(F.concat("d.end_date", F.lit(" 23:59:59"))).alias("end"))
    left = F.unix_timestamp("end") - F.unix_timestamp(as_of)
    noted = F.coalesce(F.col("doc_type").isin("meeting_notes", "changelog"), F.lit(False))
    severity = F.when(left < 0, F.when(noted, "info").otherwise("warning")).when(left <= 30 * DAY, "warning").otherwise("info")
    months = F.when(left < 0, round_half_up(-left / (30 * DAY)))
    return rows.select("id", "ord", "pos", "label", (left < 0).alias("expired"), months.alias("months_ago"), severity.alias("severity"))


def time_bombs(nodes: DataFrame, as_of: Column, limit: int | None = 20) -> DataFrame:
    """Deadlines merged by label, in order of the first: ``label, node_ids, severity, expired, months_ago, n_documents``."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("critical", "warning", "info")]), F.col("severity"))
    hits = deadline_hits(nodes, as_of).withColumn("rank", rank)
    at = F.struct("ord", "pos")
    got = hits.groupBy("label").agg(F.min(at).alias("first"), F.min("rank").alias("rank"), F.min_by("expired", at).alias("expired"), F.min_by("months_ago", at).alias("months_ago"), F.sort_array(F.collect_set(F.struct("ord", "id"))).alias("x"))
    out = got.select("label", F.transform("x", lambda y: y["id"]).alias("node_ids"), F.element_at(F.array(*[F.lit(s) for s in ("critical", "warning", "info")]), F.col("rank").cast("int")).alias("severity"), "expired", "months_ago", F.size("x").cast("long").alias("n_documents"), "first")
    return (out if limit is None else out.orderBy("first").limit(limit)).drop("first")


def completed_deadlines(bombs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expired deadlines that another node may have completed: ``bombs`` with ``completed_by`` (its title), severity info then.

    The other node has a word of completion and shares three topic words; the first in order stands. Equal sets of topic words are one
    class; only the first two nodes of a class are looked at, as one may be the deadline's own.
    """
    short = F.concat_ws(" ", "title", F.array_join("facts", " "), "summary")
    words = nodes.select("id", F.struct("ord", "id", "title").alias("node"), F.array_sort(topic_words(short)).alias("tokens"), short.rlike(f"(?i){COMPLETION}").alias("done"))
    words = stage(words.where(F.size("tokens") >= 3), "topic-words")
    sets = stage(words.select("tokens").distinct().withColumn("cls", F.monotonically_increasing_id()), "topic-sets")
    met = shared_sets(sets, 3, True).select("cls", "other")
    met = met.unionByName(met.select(F.col("other").alias("cls"), F.col("cls").alias("other"))).unionByName(sets.select("cls", F.col("cls").alias("other")))

    def first_two(rows: DataFrame, key: str) -> DataFrame:
        """The first two nodes of each key."""
        one = rows.groupBy(key).agg(F.min("node").alias("one"))
        two = rows.join(one, key).where("node.id <> one.id").groupBy(key).agg(F.min("node").alias("two"))
        return one.join(two, key, "left").select(key, F.explode(F.array_compact(F.array("one", "two"))).alias("node"))

    of = words.join(sets, "tokens")
    theirs = first_two(of.where("done").select(F.col("cls").alias("other"), "node"), "other")
    best = first_two(met.join(theirs, "other").select("cls", "node"), "cls")
    mine = bombs.where("expired").select("label", F.element_at("node_ids", 1).alias("id")).join(of.select("id", "cls"), "id")
    first = mine.join(best, "cls").where("id <> node.id").groupBy("label").agg(F.min("node")["title"].alias("completed_by"))
    rows = bombs.join(first, "label", "left")
    return rows.withColumn("severity", F.when(F.col("completed_by").isNotNull(), "info").otherwise(F.col("severity")))


def chat_clusters(nodes: DataFrame, threshold: float = 0.64, min_size: int = 3) -> DataFrame:
    """Greedy clusters of chat nodes, in order: ``cluster, node_ids, n, title, facts, severity``.

    A free node takes all free ones nearer than ``threshold``, if they are ``min_size`` with it; else it stays free for those after it.
    The first of a cluster is the one that took the others (``greedy.take_in_order``: in rounds, none of which walks a component).
    """
    chat = stage(nodes.where(F.col("source_type").isin(*CHAT)).where("size(embedding) > 0").select("id", "ord", "title", "facts", "embedding"), "chat-nodes")
    got = take_in_order(chat.select("id", F.col("ord").cast("long").alias("at")), near_vectors(chat.select("id", "embedding"), threshold), min_size - 1)
    got = got.select(F.col("leader").alias("cluster"), "id").join(chat.select("id", "ord", "title", "facts"), "id")
    head = F.struct((F.col("id") != F.col("cluster")).alias("other"), "ord", "id", "title", "facts")
    x = got.groupBy("cluster").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("rows"))
    return x.select("cluster", F.slice(F.transform("rows", lambda r: r["id"]), 1, 10).alias("node_ids"), "n", F.element_at("rows", 1)["title"].alias("title"), F.slice(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r["facts"], F.array())))), 1, 10).alias("facts"), F.when(F.col("n") >= 6, "warning").otherwise("info").alias("severity"))


def undocumented_topics(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Clusters that no document covers: two shared title tokens, or one and a Jaccard of 0.28 with its first facts."""
    tokens = lambda title, facts: tokenize(F.concat_ws(" ", title, F.array_join(F.slice(facts, 1, 5), " ")))
    docs = nodes.where(~F.col("source_type").isin(*CHAT)).select("id", tokenize(F.col("title")).alias("tt"), tokens("title", "facts").alias("ta"))
    mine = clusters.select("cluster", tokenize(F.col("title")).alias("ct"), tokens("title", "facts").alias("ca"))
    met = mine.select("cluster", F.explode("ct").alias("w")).join(docs.select("id", F.explode("tt").alias("w")), "w").groupBy("cluster", "id").agg(F.count("*").alias("shared"))
    met = met.join(mine, "cluster").join(docs, "id")
    close = F.size(F.array_intersect("ca", "ta")) / F.greatest(F.size(F.array_union("ca", "ta")), F.lit(1))
    covered = met.where((F.col("shared") >= 2) | (close >= 0.28)).select("cluster").distinct()
    return clusters.join(covered, "cluster", "left_anti")


def _unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def split_truth_candidates(nodes: DataFrame, edges: DataFrame, limit: int | None = 20) -> DataFrame:
    """The first pairs without an edge that share a token of title and facts, one with facts, in order: ``a, b, ord_a, ord_b``.

    They come from postings that stop (``firstpairs.first_pairs``); all of them are made only without a ``limit``.
    """
    rows = stage(nodes.select("id", F.col("ord").cast("long").alias("ord"), F.coalesce(F.size("facts"), F.lit(0)).alias("n"), tokenize(F.concat_ws(" ", "title", F.array_join("facts", " "))).alias("tokens")), "split-truth")
    linked = _unordered(edges, "source_id", "target_id")
    sides = [rows.select(F.col("ord").alias(f"ord_{k}"), F.col("id").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab"]

    def allowed(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sides[0], "ord_a").join(sides[1], "ord_b").where("n_a > 0 or n_b > 0")
        return met.join(linked, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti").select("ord_a", "ord_b")

    if limit is None:
        met = overlap_pairs(rows.select(F.col("ord").alias("id"), "tokens"), 1).select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))
        out = allowed(met)
    else:
        out = first_pairs(rows, limit, allowed)
    return out.join(sides[0], "ord_a").join(sides[1], "ord_b").select("a", "b", "ord_a", "ord_b")


def claim_pairs(claims: DataFrame, limit: int | None = 100) -> DataFrame:
    """The first pairs of claims ``ord, text, source_file`` of two files that share a stem, in order: ``ord_a, ord_b``.

    As for ``split_truth_candidates``, all pairs are made only without a ``limit``. A missing file is a file of its own.
    """
    rows = stage(claims.select(F.col("ord").cast("long").alias("ord"), "source_file", claim_stems(F.col("text")).alias("tokens")), "claims")
    sides = [rows.select(F.col("ord").alias(f"ord_{k}"), F.col("source_file").alias(f"file_{k}")) for k in "ab"]

    def allowed(pairs: DataFrame) -> DataFrame:
        return pairs.join(sides[0], "ord_a").join(sides[1], "ord_b").where(~F.col("file_a").eqNullSafe(F.col("file_b"))).select("ord_a", "ord_b")

    if limit is not None:
        return first_pairs(rows, limit, allowed)
    return allowed(overlap_pairs(rows.select(F.col("ord").alias("id"), "tokens"), 1).select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b")))


def claim_comparison_candidates(nodes: DataFrame, seen: DataFrame, limit: int = 30) -> DataFrame:
    """The first unseen pairs of nodes with facts, out of the first nodes that can give so many."""
    first = nodes.where(F.size("facts") > 0).select("id", "ord").orderBy("ord").limit(limit + 2 + seen.limit(limit).count())
    met = first.alias("x").join(first.alias("y"), F.col("x.ord") < F.col("y.ord")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.ord").alias("ord_a"), F.col("y.ord").alias("ord_b"))
    met = met.join(_unordered(seen, "a", "b"), (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
    return met.orderBy("ord_a", "ord_b").limit(limit)


def entity_clusters(nodes: DataFrame) -> DataFrame:
    """``id, cluster``: nodes that share entities, directly or through others; clusters of two nodes or more."""
    long = nodes.select("id", F.explode(F.transform("entities", lambda e: F.lower(e["name"]))).alias("e")).where(F.trim("e") != "").distinct()
    hub = long.groupBy("e").agg(F.min("id").alias("v"))
    edges = long.join(hub, "e").where("id <> v").select(F.col("id").alias("u"), "v").distinct()
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def context_packages(nodes: DataFrame, edges: DataFrame, size: int = 10) -> DataFrame:
    """Clusters in runs of ``size``: ``package, node_ids, edge_ids, shared_entities, topic, sources``; a last run of one is dropped."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("ord"))
    rows = entity_clusters(nodes).join(nodes.select("id", "ord", "source_id", "entities"), "id").withColumn("run", F.floor((rank - 1) / size)).withColumn("package", F.concat_ws("#", "cluster", F.col("run").cast("string")))
    x = rows.groupBy("package").agg(F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("m"), F.sort_array(F.collect_set("source_id")).alias("sources")).where(F.size("m") >= 2)
    x = x.select("package", F.transform("m", lambda y: y["id"]).alias("node_ids"), "sources")
    names = rows.select("package", "id", F.explode(F.transform("entities", lambda e: F.lower(e["name"]))).alias("e")).distinct().groupBy("package", "e").count().where("count >= 2").groupBy("package").agg(F.sort_array(F.collect_list("e")).alias("shared_entities"))
    of = rows.select("package", "id")
    inner = edges.select(F.col("id").alias("edge"), "source_id", "target_id").join(of.withColumnRenamed("id", "source_id"), "source_id").join(of.withColumnRenamed("id", "target_id"), ["target_id", "package"])
    inner = inner.groupBy("package").agg(F.sort_array(F.collect_set("edge")).alias("edge_ids"))
    empty = F.array().cast("array<string>")
    out = x.join(names, "package", "left").join(inner, "package", "left").withColumns({"shared_entities": F.coalesce("shared_entities", empty), "edge_ids": F.coalesce("edge_ids", empty)})
    return out.withColumn("topic", F.when(F.size("shared_entities") > 0, F.array_join(F.slice("shared_entities", 1, 3), ", ")).otherwise("general"))


def attach_context(detections: DataFrame, nodes: DataFrame) -> DataFrame:
    """Detections ``detection_id, node_ids, excerpts`` with ``nodes``: id, title, source and excerpt, in order; unknown ids go."""
    long = detections.select("detection_id", "excerpts", F.posexplode("node_ids").alias("pos", "id"))
    got = long.join(nodes.select("id", "title", F.col("source_id").alias("source"), clean_excerpt(F.coalesce("raw", "summary")).alias("clean")), "id")
    cell = F.struct("pos", "id", "title", "source", F.coalesce(F.try_element_at("excerpts", F.col("id")), "clean").alias("excerpt"))
    rows = got.groupBy("detection_id").agg(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x.dropFields("pos")).alias("nodes"))
    return detections.drop("nodes").join(rows, "detection_id", "left")


@dataclass
class Detector:
    """A function ``(nodes, edges, as_of) -> detections`` with a name and, if wanted, a candidate filter ``(k, similarity)``.

    With a context provider ``context``, a function ``(nodes, edges) -> packages``, the detector gets its packages as a fourth argument.
    """

    name: str
    fn: Callable[..., DataFrame]
    near: tuple[int, float] | None = None
    context: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def _detections(df: DataFrame, kind: str, node_ids: Column, severity: Column, description: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), severity.alias("severity"), node_ids.alias("node_ids"), description.alias("description"))


def contradiction_detector(nodes: DataFrame, edges: DataFrame, as_of: Column, max_fact: int | None = None, max_total: int | None = None) -> DataFrame:
    """Told and heuristic contradictions, their severity boosted by authority and kinship; caps only for a report."""
    told = edge_contradictions(nodes, edges)
    found = heuristic_contradictions(nodes, told.select("a", "b"), max_fact, max_total)
    both = told.select("a", "b", F.lit("edge").alias("kind"), "severity").unionByName(found.select("a", "b", "kind", "severity"))
    return _detections(boost_severity(both, nodes), "contradiction", F.array("a", "b"), F.col("severity"), F.concat(F.lit("Contradiction by "), "kind"))


def staleness_detector(nodes: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    a = _detections(stale_nodes(nodes, edges), "staleness", F.concat(F.array("older"), F.col("newer")), F.lit("warning"), F.concat(F.lit("Superseded by "), F.col("n_newer").cast("string"), F.lit(" newer versions")))
    b = _detections(dated_references(nodes, edges, as_of), "staleness", F.array("id"), F.lit("info"), F.concat("label", F.lit(", "), F.col("months_ago").cast("string"), F.lit(" months ago")))
    return a.unionByName(b)


def deadline_detector(nodes: DataFrame, edges: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    rows = completed_deadlines(time_bombs(nodes, as_of, limit), nodes)
    return _detections(rows, "time_bomb", F.col("node_ids"), F.col("severity"), F.concat(F.lit("Deadline: "), "label"))


def undocumented_detector(nodes: DataFrame, edges: DataFrame, as_of: Column, threshold: float = 0.64) -> DataFrame:
    rows = undocumented_topics(chat_clusters(nodes, threshold), nodes)
    return _detections(rows, "undocumented", F.col("node_ids"), F.col("severity"), F.concat(F.lit("Only told in chat: "), "title"))


DEFAULT = (Detector("contradictions", contradiction_detector), Detector("staleness", staleness_detector), Detector("undocumented", undocumented_detector), Detector("time_bombs", deadline_detector))
#: The same with the caps of a short report.
REPORT = (
    Detector("contradictions", partial(contradiction_detector, max_fact=10, max_total=50)),
    Detector("staleness", staleness_detector),
    Detector("undocumented", undocumented_detector),
    Detector("time_bombs", partial(deadline_detector, limit=20)),
)


def run_detectors(nodes: DataFrame, edges: DataFrame, as_of: Column, detectors: tuple[Detector, ...] = DEFAULT) -> DataFrame:
    """The detections of all detectors, with the detector's name."""
    out = None
    for d in detectors:
        n, e = prefilter(nodes, edges, *d.near) if d.near else (nodes, edges)
        given = (d.context(n, e),) if d.context else ()
        rows = d.fn(n, e, as_of, *given).withColumn("detector", F.lit(d.name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def headline_words(headline: Column) -> Column:
    """The words of a headline as a set: lower case, letters a-z and digits alone; without any, one empty word."""
    kept = F.regexp_replace(F.lower(F.coalesce(headline, F.lit(""))), rf"[^a-z0-9{SPACES}]", "")
    return F.array_distinct(F.split(F.trim(F.regexp_replace(kept, rf"[{SPACES}]+", " ")), " "))


def consensus(findings: DataFrame, passes: int, min_votes: int | None = None) -> DataFrame:
    """Findings that ``ceil(passes / 2)`` passes agree on: ``category, cluster, votes, severity, headline, documents``.

    In order of passes, a finding joins the first cluster of its category whose first finding is near enough: half of all words
    in common, or three in ten and a document. Only headlines that share a rare word meet (``greedy.take_in_order``: in rounds, none
    of which walks a category). The median severity and the longest headline stand; ``cluster`` tells the first finding's place.
    ``ord`` orders the findings of one category and pass.
    """
    votes = -(-passes // 2) if min_votes is None else min_votes
    at = F.shiftleft(F.col("pass_index").cast("long"), 40) + F.col("ord").cast("long")
    docs = F.coalesce("affected_documents", F.array().cast("array<string>"))
    rows = stage(findings.select(F.struct(F.col("category").alias("category"), at.alias("at")).alias("id"), "category", at.alias("at"), "pass_index", "severity", "headline", docs.alias("docs"), headline_words(F.col("headline")).alias("words")), "consensus")
    rare = stage(shared_prefixes(rows.select("id", F.transform("words", lambda w: F.concat_ws("|", w, "category")).alias("tokens")), 0.3), "consensus-words")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        sides = [rare.join(x, "id", "left_semi").select(F.col("id").alias(n), "token") for x, n in ((left, "u"), (right, "v"))]
        met = sides[0].join(sides[1], "token").where("u <> v").select("u", "v").distinct()
        told = [rows.select(F.col("id").alias(n), F.col("words").alias(f"{n}w"), F.col("docs").alias(f"{n}d")) for n in ("u", "v")]
        j = jaccard(F.col("uw"), F.col("vw"))
        return met.join(told[0], "u").join(told[1], "v").where((j >= 0.5) | ((j >= 0.3) & F.arrays_overlap("ud", "vd"))).select("u", "v")

    x = rows.join(take_in_order(rows.select("id", "at"), near), "id")
    names = F.array(*[F.lit(s) for s in ("info", "warning", "critical")])
    ranks = F.array_sort(F.collect_list(F.greatest(F.array_position(names, F.col("severity")), F.lit(1))))
    best = F.max_by("headline", F.struct(F.length("headline"), -F.col("at")))
    out = x.groupBy("leader").agg(F.count_distinct("pass_index").alias("votes"), ranks.alias("r"), best.alias("headline"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("docs")))).alias("documents"))
    median = F.element_at(names, F.element_at("r", F.floor(F.size("r") / 2 + 1).cast("int")).cast("int"))
    return out.where(F.col("votes") >= votes).select("leader.category", F.col("leader.at").alias("cluster"), "votes", median.alias("severity"), "headline", "documents")
