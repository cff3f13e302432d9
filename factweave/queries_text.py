"""Registered queries over the given texts, with SQL that computes the answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.functions import extract, scores, text
from factweave.functions.text import CLAIM_STOP, TOKEN_STOP
from factweave.operators import answers, detect, feedback, filters, hooks, pairs, vectorlists
from factweave.plans import domain as d
from factweave.plans.domain import EDGES_SQL, NODES_SQL, SIGNALS_SQL, table
from factweave.registry import query


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: The first twelve words of a text, and what is read from them.
_HEAD = r"array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 12), ' ')"
_STEM = "case when w like '%ing' and len(w) > 5 then w[:-4] when w like '%ed' and len(w) > 4 then w[:-3] when w like '%es' and len(w) > 4 then w[:-3] when w like '%s' and len(w) > 3 then w[:-2] else w end"
_STEMS = rf"list_distinct(list_transform(list_filter(regexp_split_to_array(lower({{c}}), '[^a-zA-Z0-9_]+'), lambda w: len(w) > 2 and w not in ({_listed(CLAIM_STOP)})), lambda w: {_STEM}))"
_TOKENS = rf"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({{c}}), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: len(w) >= 2 and w not in ({_listed(TOKEN_STOP)})))"


def _head(n: int = 12, start: int = 1):
    return F.array_join(F.slice(F.split("text", r"\s+"), start, n), " ")


@query(f"""with c as (select doc_id, source, unnest({_STEMS.format(c=_HEAD)}) as stem from documents), p as (select distinct a.doc_id as ord_a, b.doc_id as ord_b from c a join c b using (stem) where a.doc_id < b.doc_id and a.source is distinct from b.source)
select ord_a, ord_b from p order by ord_a, ord_b limit 100""")
def related_claims(spark, sf):
    """The first hundred pairs of documents of two sources whose first words share a stem."""
    return detect.claim_pairs(table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), _head().alias("text"), F.col("source").alias("source_file")))


@query(f"""with c as (select doc_id, doc_id % 3 > 0 as told, unnest({_TOKENS.format(c=_HEAD)}) as token from documents), p as (select distinct a.doc_id as a, b.doc_id as b from c a join c b using (token) where a.doc_id < b.doc_id and (a.told or b.told) and not (b.doc_id = a.doc_id + 1 and a.doc_id % 2 = 0))
select 'doc-' || a as a, 'doc-' || b as b from p order by p.a, p.b limit 20""")
def split_truths(spark, sf):
    """The first twenty pairs of documents that may tell one thing twice; every even one has an edge to the next."""
    docs = table(spark, sf, "documents")
    name = lambda k: F.concat(F.lit("doc-"), (F.col("doc_id") + k).cast("string"))
    told = F.col("doc_id") % 3 > 0
    nodes = docs.select(name(0).alias("id"), F.col("doc_id").alias("ord"), F.when(told, _head(4)).otherwise(_head()).alias("title"), F.when(told, F.array(_head(8, 5))).otherwise(F.array().cast("array<string>")).alias("facts"))
    edges = docs.where("doc_id % 2 = 0").select(name(0).alias("source_id"), name(1).alias("target_id"))
    return detect.split_truth_candidates(nodes, edges).select("a", "b")


@query("""select id, other, round(s, 5) as similarity from (select a.vec_id::varchar as id, b.vec_id::varchar as other, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s,
row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc) as k from embeddings a, embeddings b) where k <= 5 and s >= 0.5""")
def listed_neighbours(spark, sf):
    """The same neighbours as of all cosines, found by inverted lists."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return vectorlists.knn_lists(vectors, 5, 0.5)[0].select("id", "other", F.round("similarity", 5).alias("similarity"))


@query(f"""with {NODES_SQL}, o as (select distinct ord, e, replace(e2, '#', ' ') as owner from (select ord, unnest([e1, e2, e3]) as e, e1, e2 from nodes) where len(e) > 3 and contains(e1, e)),
n as (select e, count(*) as n, count(distinct owner) as o from o group by e) select n.e as entity, n.n as n_nodes, n.o as n_owners, (select count(*) from o a join o b on a.e = b.e and a.ord < b.ord and a.owner <> b.owner where a.e = n.e) as n_links from n""")
def owner_totals(spark, sf):
    """How many pairs of nodes name different owners of an entity, without making them."""
    return pairs.ownership_totals(d.nodes(spark, sf))


@query(f"""with {SIGNALS_SQL}, c as (select * from signals where signal_type = 'corrected') select node, count(*) as n_corrections, count(distinct correction_text) as n_texts, count(distinct user_id) as n_users,
(select count(*) from c a join c b on a.id < b.id and a.user_id <> b.user_id and a.correction_text <> b.correction_text where a.node = c.node and b.node = c.node) as n_links from c group by node""")
def correction_totals(spark, sf):
    """How many pairs of users correct a question node differently, without making them."""
    return feedback.conflict_totals(d.signals(spark, sf))


def _vector_nodes(spark, sf):
    """Nodes with the vector of their number, if there is one."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    return d.nodes(spark, sf).drop("embedding").join(v, "ord", "left")


@query(f"""with {EDGES_SQL}, v as (select 'part-' || vec_id as id from embeddings where vec_id % 3 > 0) select e.id, e.type from (select source_id || '>' || target_id || '>' || type as id, * from edges) e where source_id in (from v) or target_id in (from v)""")
def candidate_edges(spark, sf):
    """Edges that a detector with a candidate filter sees: two thirds of the nodes have a vector."""
    return pairs.prefilter(_vector_nodes(spark, sf).withColumn("embedding", F.when(F.col("ord") % 3 > 0, F.col("embedding"))), d.edges(spark, sf), 10, 0.3)[1].select("id", "type")


@query("""with n as (select p_partkey as k, p_name, p_partkey % 4 = 1 as late, p_partkey % 3 = 0 as done from part), w as (select distinct k, unnest(string_split(p_name || case when done then ' shipped' else '' end, ' ')) as w from n),
m as (select n.k, o.k as other, o.p_name as title from n join w a using (k) join w b on a.w = b.w and len(a.w) >= 5 join n o on o.k = b.k and o.done and o.k <> n.k where n.late group by n.k, o.k, o.p_name having count(distinct a.w) >= 3)
select 'by ' || k as label, min_by(m.title, m.other) as completed_by, case when count(m.other) > 0 then 'info' else 'warning' end as severity from n left join m using (k) where late group by k""")
def completed_later(spark, sf):
    """Deadlines of every fourth part that are over, and the first part, shipped, that shares three words with each."""
    k, name = F.col("p_partkey"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    p = table(spark, sf, "part")
    nodes = p.select(name.alias("id"), k.alias("ord"), F.col("p_name").alias("title"), F.array().cast("array<string>").alias("facts"), F.when(k % 3 == 0, "It shipped.").otherwise("").alias("summary"))
    bombs = p.where(k % 4 == 1).select(F.concat(F.lit("by "), k.cast("string")).alias("label"), F.array(name).alias("node_ids"), F.lit(True).alias("expired"), F.lit("warning").alias("severity"))
    return detect.completed_deadlines(bombs, nodes).select("label", "completed_by", "severity")


@query("""with n as (select p_partkey as k, (p_partkey % 10) / 10.0::double as w, ['critical', 'warning', 'info', 'none'][p_partkey % 4 + 1] as severity from part), q as (select a.k, a.severity, 2 * greatest(0.0::double, least(1.0::double, 0.5 + greatest(a.w, b.w) + 0.5::double * least(a.w, b.w))) as m from n a join n b on b.k = a.k + 1 where a.k % 5 <> 0 and a.severity <> 'none')
select 'part-' || k as a, 'part-' || (k + 1) as b, ['info', 'warning', 'critical'][greatest(1, least(3, floor(list_position(['info', 'warning', 'critical'], severity) * m + 0.5::double)))::int] as severity from q""")
def package_findings(spark, sf):
    """What a model finds in packages of two parts in a row; every fifth pair is known, and some answers name what isn't there."""
    k, name = F.col("p_partkey"), lambda n: F.concat(F.lit("part-"), (F.col("p_partkey") + n).cast("string"))
    p = table(spark, sf, "part")
    packages = p.select(F.concat(F.lit("p"), k.cast("string")).alias("package"))
    severity = F.element_at(F.array(*[F.lit(x) for x in ("critical", "warning", "info", "none")]), (k % 4 + 1).cast("int"))
    one = F.struct(name(0).alias("nodeA"), name(1).alias("nodeB"), severity.alias("severity"), F.lit("They differ").alias("description"))
    lost = F.struct(F.lit("nowhere").alias("nodeA"), name(1).alias("nodeB"), F.lit("critical").alias("severity"), F.lit("Who?").alias("description"))
    responses = p.select(F.concat(F.lit("p"), k.cast("string")).alias("request_id"), F.to_json(F.struct(F.array(lost, one, one).alias("findings"))).alias("response"))
    known = p.where(k % 5 == 0).select(name(1).alias("a"), name(0).alias("b"))
    nodes = p.select(name(0).alias("id"), ((k % 10) / 10.0).alias("authority"))
    return answers.apply_package_findings(packages, responses, nodes, known).select("a", "b", "severity")


@query(f"""with {NODES_SQL}, v as (select vec_id as ord, embedding::double[] as x from embeddings), p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc) as k
from embeddings a join nodes n on n.ord = a.vec_id, embeddings b join nodes m on m.ord = b.vec_id), near as (select distinct least('part-' || a, 'part-' || b) as a, greatest('part-' || a, 'part-' || b) as b from p where k <= 10 and s >= 0.5 and 'part-' || a < 'part-' || b),
e as (select id, ord, unnest([e1, e2, e3]) as e from nodes), shared as (select distinct x.id as a, y.id as b from e x join e y on x.e = y.e and x.id < y.id), pair as (select a, b, max(s) as s from (select a, b, 0 as s from near union all select a, b, 1 from shared) group by a, b),
c as (select pair.*, list_cosine_similarity(va.x, vb.x) as cos from pair join nodes na on na.id = pair.a join nodes nb on nb.id = pair.b join v va on va.ord = na.ord join v vb on vb.ord = nb.ord)
select a, b, 'related' as type, round(cos, 6) as similarity from c where cos >= 0.75 or (s = 1 and cos >= 0.5)""")
def proposed_links(spark, sf):
    """Links between nodes with near vectors, or less near ones and an entity in common."""
    nodes = _vector_nodes(spark, sf).where("embedding is not null")
    return pairs.propose_links(nodes).select("a", "b", "type", F.round("similarity", 6).alias("similarity"))


def _remote_only(texts: list[str]) -> list[list[float] | None]:
    """A vector for texts about remote work, none for others."""
    return [[1.0, float(len(t) % 7)] if "remote-first" in t else None for t in texts]


def _crowded(nodes, edges, as_of, packages):
    """A detection for each package of five nodes or more."""
    many = F.size("node_ids") >= 5
    return packages.where(many).select(F.lit("crowded").alias("type"), F.lit("info").alias("severity"), "node_ids", F.concat(F.lit("Package "), "package").alias("description"))


@query(f"""with {NODES_SQL}, p as (select source_id, list('part-' || ord order by ord) as ids from nodes where ord % 3 = 0 group by source_id having count(*) >= 5)
select 'own' as detector, 'crowded' as type, 'Package ' || source_id as description, md5(array_to_string(ids, '|')) as ids from p""")
def own_detector(spark, sf):
    """A detector of one's own: an embedding function, the candidate filter that goes by its vectors, and a context provider."""
    nodes = hooks.embed_nodes(d.nodes(spark, sf), _remote_only)
    own = detect.Detector("own", _crowded, near=(5, 0.3), context=hooks.grouped_by("source_id"))
    found = detect.run_detectors(nodes, d.edges(spark, sf), F.current_timestamp(), (own,))
    return found.select("detector", "type", "description", F.md5(F.array_join("node_ids", "|")).alias("ids"))


_AUTHORITY = "greatest(0.0::double, least(1.0::double, 0.5::double * case p_partkey % 3 when 0 then 0.9::double when 1 then 0.2::double else 0.4::double end + 0.25::double * 0.6::double + 0.25::double * case when p_partkey % 2 = 0 then 0.5::double else pow(0.5::double, (p_partkey % 50) / 30.0::double) end))"


@query(f"select p_partkey, round({_AUTHORITY}, 9) as authority from part")
def configured_authority(spark, sf):
    """Authority of parts with weights of one's own; every second has no date."""
    weights = hooks.AuthorityConfig(roles={"lead": 0.9, "guest": 0.2, "unknown": 0.4}, sources={"unknown": 0.6}, shares=(0.5, 0.25, 0.25), half_life_days=30.0)
    k, now = F.col("p_partkey"), F.to_timestamp(F.lit("2020-01-01"))
    role = F.when(k % 3 == 0, "Lead").when(k % 3 == 1, "guest")
    at = F.when(k % 2 == 1, F.timestamp_seconds(F.unix_timestamp(now) - (k % 50) * 86400))
    return table(spark, sf, "part").select("p_partkey", F.round(weights.of(role, F.lit("wiki"), at, now), 9).alias("authority"))


_DENY = "not no never none neither nor nothing nowhere nobody don''t doesn''t didn''t won''t wouldn''t shouldn''t couldn''t isn''t aren''t wasn''t weren''t cannot".split()
_SAID = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_'']+'), lambda w: w <> '')"


@query(f"""with t as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as before, text || case when turn % 3 = 0 then ' I do not think so' else '' end as text from conversations),
w as (select conv_id, turn, list_filter({_SAID.format('before')}, lambda w: len(w) > 3 and w not in ({_listed(_DENY)})) as subject, {_SAID.format('text')} as said from t where before is not null)
select conv_id, turn, list_has_any(subject, said) and list_has_any(said, [{_listed(_DENY)}]) as denied from w""")
def denied_turns(spark, sf):
    """Turns that deny what the turn before them speaks of; every third says so."""
    t = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " I do not think so").otherwise(""))
    return t.select("conv_id", "turn", scores.negation_conflict(F.col("before"), said).alias("denied"))


_AS_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query(f"""with x as (select conv_id, turn, text, md5(text) as h from conversations) select conv_id, turn, case when turn % 5 = 0 then 'empty question' when trim(text) = '' then 'empty original answer' when turn % 5 = 1 then 'empty corrected answer' when turn % 5 = 2 then 'identical answers' when turn % 5 = 3 and conv_id % 2 = 0 then 'question is an id' end as reason from x""")
def turn_corrections(spark, sf):
    """Turns as corrected answers: without a question, without a correction, with the same text again, and asked by ids."""
    h, k = F.md5("text"), F.col("turn") % 5
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    asked = F.when(k == 0, " ").when((k == 3) & (F.col("conv_id") % 2 == 0), F.concat(uuid, F.lit(", "), F.upper(uuid))).otherwise(F.concat(F.lit("What of "), uuid))
    answer = F.when(k == 1, "").when(k == 2, F.concat(F.lit("  "), F.trim("text"), F.lit(" "))).otherwise(F.concat("text", F.lit("!")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", asked.alias("original_question"), F.col("text").alias("original_answer"), answer.alias("corrected_answer"))
    return filters.validate_corrections(rows).select("conv_id", "turn", "reason")


@query("""select doc_id, case doc_id % 4 when 0 then 'direct' when 1 then 'fenced' when 2 then 'embedded' else 'repaired' end as mode, n_chars, md5(case when doc_id % 4 = 3 then lang else text end) as said from documents""")
def wrapped_answers(spark, sf):
    """Documents as answers in JSON: as it is, in a fence, in the midst of words, and cut off."""
    k = F.col("doc_id") % 4
    whole = F.to_json(F.struct("n_chars", F.col("text").alias("said")))
    cut = F.concat(F.lit('{"n_chars": '), F.col("n_chars").cast("string"), F.lit(', "said": "'), "lang")
    answer = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), whole, F.lit(" So it is."))).otherwise(cut)
    docs = table(spark, sf, "documents").where(~F.col("text").contains("```")).select("doc_id", extract.parse_model_json(answer).alias("p"))
    got = docs.select("doc_id", "p.mode", F.from_json("p.json", "n_chars long, said string").alias("x"))
    return got.select("doc_id", "mode", "x.n_chars", F.md5("x.said").alias("said"))


@query(r"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: lower(trim(s))), lambda s: len(s) > 20) as s from documents) select doc_id, len(s)::bigint as n, md5(array_to_string(s, '|')) as said from s""")
def sentence_lists(spark, sf):
    """Sentences of more than twenty characters."""
    found = text.long_sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "|")).alias("said"))


@query(f"""with x as (select doc_id, md5(text) as h from documents), y as (select doc_id, {_AS_UUID} as u from x) select doc_id, doc_id % 4 in (0, 2) as ids from y""")
def id_lists(spark, sf):
    """Which texts are UUIDs: one alone, one with a word, several, and one cut short."""
    h, k = F.md5("text"), F.col("doc_id") % 4
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    told = F.when(k == 0, F.concat(F.lit(" "), uuid)).when(k == 1, F.concat(uuid, F.lit(" is it"))).when(k == 2, F.concat_ws(", ", uuid, F.upper(uuid), uuid)).otherwise(F.concat(uuid, F.lit("0")))
    return table(spark, sf, "documents").select("doc_id", text.is_uuid_list(told).alias("ids"))


@query("""with p as (select p_partkey as k, 2017 + p_partkey % 4 as y, p_partkey % 12 + 1 as m from part), d as (select k, case k % 3 when 0 then 'Q' || (k % 4 + 1) || ' ' || y when 1 then y || '-' || lpad(m::varchar, 2, '0') else 'by ' || ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][m] || ' ' || y end as label,
last_day(make_date(y, case k % 3 when 0 then 3 * (k % 4 + 1) else m end, 1)) + interval 86399 second as e, k % 5 = 0 as noted from p),
t as (select *, epoch(e) - epoch(timestamp '2019-06-15') as left_ from d) select 'part-' || k as id, label, left_ < 0 as expired, case when left_ < 0 then floor(-left_ / 2592000.0::double + 0.5)::bigint end as months_ago, case when left_ < 0 then case when noted then 'info' else 'warning' end when left_ <= 2592000 then 'warning' else 'info' end as severity from t""")
def part_deadlines(spark, sf):
    """Deadlines of parts as quarters, months and names of months; every fifth in the notes of a meeting."""
    k = F.col("p_partkey")
    y, m = (F.lit(2017) + k % 4).cast("string"), (k % 12 + 1).cast("int")
    names = F.array(*[F.lit(x.capitalize()) for x in text.MONTHS])
    told = F.when(k % 3 == 0, F.concat(F.lit("Due in Q"), (k % 4 + 1).cast("string"), F.lit(" "), y, F.lit("."))).when(k % 3 == 1, F.concat(F.lit("The deadline is "), y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("."))).otherwise(F.concat(F.lit("To be done by "), F.element_at(names, m), F.lit(" "), y, F.lit(".")))
    nodes = table(spark, sf, "part").select(F.concat(F.lit("part-"), k.cast("string")).alias("id"), k.alias("ord"), F.lit("").alias("title"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("facts"), told.alias("raw"), F.when(k % 5 == 0, "meeting_notes").otherwise("general").alias("doc_type"))
    hits = detect.deadline_hits(nodes, F.to_timestamp(F.lit("2019-06-15")))
    return hits.select("id", "label", "expired", F.col("months_ago").cast("long").alias("months_ago"), "severity")


@query(r"""with w as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda w: len(w) > 2) as e, list_filter(regexp_split_to_array(lower(substr(text, 1, len(text) // 3)), '[^a-zA-Z0-9_]+'), lambda w: len(w) > 2) as a from benchmark) select item_id, round(case when len(e) = 0 then 1 else len(list_filter(e, lambda x: list_contains(a, x)))::double / len(e) end, 9) as accuracy from w""")
def keyword_shares(spark, sf):
    """The share of a benchmark item's words that its first third has."""
    third = F.substring("text", F.lit(1), F.floor(F.length("text") / 3).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", F.round(scores.keyword_accuracy(F.col("text"), third), 9).alias("accuracy"))
