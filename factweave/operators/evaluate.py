"""Precision and recall, consistency of runs, benchmarks and gates of models, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.scores import cosine, keyword_accuracy, lcs_f1, negation_conflict
from factweave.functions.text import overlap_of_smaller, tokenize
from factweave.operators.greedy import match_in_order
from factweave.plans.staging import stage


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def _prf(counts: DataFrame, empty: float) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty), _ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    rows = counts.withColumns({"precision": p, "recall": r})
    return rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def pair_metrics(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of pairs ``a, b``, whichever way round, against ``truth a, b, positive``; empty: 0."""
    key = F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b")).alias("k")
    d, t = detections.select(key).distinct().withColumn("d", F.lit(True)), truth.where("positive").select(key).distinct().withColumn("t", F.lit(True))
    both = d.join(t, "k", "full_outer")
    return _prf(both.agg(F.count_if(F.col("d") & F.col("t")).alias("tp"), F.count_if(F.col("d") & F.col("t").isNull()).alias("fp"), F.count_if(F.col("t") & F.col("d").isNull()).alias("fn")), 0.0)


def id_details(expected: DataFrame, detected: DataFrame, universe: DataFrame) -> DataFrame:
    tag = lambda df, n: df.select("id").distinct().withColumn(n, F.lit(True))
    rows = universe.select("id").distinct().join(tag(expected, "expected"), "id", "left").join(tag(detected, "detected"), "id", "left")
    return rows.select("id", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("detected", F.lit(False)).alias("detected"))


def id_metrics(expected: DataFrame, detected: DataFrame, universe: DataFrame) -> DataFrame:
    """The same for ids within a universe; empty sets: 1."""
    e, d = F.col("expected"), F.col("detected")
    return _prf(id_details(expected, detected, universe).agg(F.count_if(e & d).alias("tp"), F.count_if(~e & d).alias("fp"), F.count_if(e & ~d).alias("fn")), 1.0)


def _classes(rows: DataFrame, cls: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``ord, type, text`` in classes of one type and one set of tokens: ``(cls, at)``, and ``(cls, type, tokens)`` of those with tokens."""
    x = rows.select("type", "ord", F.array_sort(tokenize(F.col("text"))).alias("tokens"))
    x = stage(x.withColumn(cls, F.sha2(F.concat_ws("|", "type", F.array_join("tokens", " ")), 256)), "fuzzy-classes")
    return x.select(cls, F.col("ord").cast("long").alias("at")), x.where(F.size("tokens") > 0).groupBy(cls).agg(F.first("type").alias("type"), F.first("tokens").alias("tokens"))


def overlap_links(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``cls, other``: classes ``(cls, type, tokens)`` and ``(other, type, tokens)`` that share more than ``least`` of the smaller's tokens.

    A smaller set that shares so much has one of the shared tokens among the rarest that are left when ``least`` of its size is
    taken off; so these are joined with all tokens of the larger sets, once with either side as the smaller.
    """
    sides = [x.select(F.col(n), F.concat_ws("|", "type").alias("type"), F.size("tokens").alias("size"), F.explode("tokens").alias("token")) for x, n in ((left, "cls"), (right, "other"))]
    df = sides[0].select("type", "token").unionByName(sides[1].select("type", "token")).groupBy("type", "token").agg(F.count("*").alias("df"))

    def met(small: DataFrame, key: str, large: DataFrame) -> DataFrame:
        k = F.row_number().over(Window.partitionBy(key).orderBy("df", "token"))
        rare = small.join(df, ["type", "token"]).withColumn("k", k).where(F.col("k") <= F.col("size") - F.floor(F.col("size") * least + 1e-9))
        return rare.select(key, "type", "token", F.col("size").alias("s")).join(large.withColumnRenamed("size", "t"), ["type", "token"]).where("s <= t").select("cls", "other")

    pairs = met(sides[0], "cls", sides[1]).unionByName(met(sides[1], "other", sides[0])).distinct()
    pairs = pairs.join(left.select("cls", F.col("tokens").alias("ta")), "cls").join(right.select("other", F.col("tokens").alias("tb")), "other")
    return pairs.where(overlap_of_smaller(F.col("ta"), F.col("tb")) > least).select("cls", "other")


def fuzzy_metrics(detections: DataFrame, truth: DataFrame, least: float = 0.4) -> DataFrame:
    """Each detection ``ord, type, text``, in order, takes the first free positive ``ord, type, text`` of its type that overlaps enough.

    Equal texts form classes, which are linked and matched as such (``greedy.match_in_order``), so no task gets a type's rows.
    """
    (d, dc), (t, tc) = _classes(detections, "cls"), _classes(truth, "other")
    taken = match_in_order(d, t, overlap_links(dc, tc, least))
    tp = taken.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tp"))
    rows = tp.crossJoin(d.agg(F.count("*").alias("nd"))).crossJoin(t.agg(F.count("*").alias("nt")))
    return _prf(rows.select("tp", (F.col("nd") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn")), 0.0)


def run_consistency(keys: DataFrame, least: float = 0.8) -> DataFrame:
    """Jaccard of the findings ``run, key`` of each two runs: mean, min, max, passed, distinct findings. Runs are few."""
    rows = keys.distinct()
    sizes = rows.groupBy("run").agg(F.count("key").alias("n"))
    both = rows.alias("x").join(rows.alias("y"), "key").where("x.run < y.run").groupBy(F.col("x.run").alias("ra"), F.col("y.run").alias("rb")).agg(F.count("*").alias("shared"))
    pairs = sizes.select(F.col("run").alias("ra"), F.col("n").alias("na")).join(sizes.select(F.col("run").alias("rb"), F.col("n").alias("nb")), F.col("ra") < F.col("rb")).join(both, ["ra", "rb"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    j = F.when(F.col("na") + F.col("nb") == 0, 1.0).otherwise(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    out = pairs.agg(F.avg(j).alias("mean"), F.min(j).alias("min"), F.max(j).alias("max"))
    return out.withColumn("passed", F.col("min") >= least).crossJoin(rows.agg(F.count_distinct("key").alias("distinct_findings")))


def benchmark_from_nodes(nodes: DataFrame) -> DataFrame:
    """Items of sure nodes with facts: ``id, question, expected_answer, domain, difficulty``."""
    n = F.size("facts")
    rows = nodes.where((F.col("confidence") >= 0.8) & (n >= 1))
    domain = F.coalesce(F.lower(F.try_element_at("entities", F.lit(1))["type"]), F.lit("general"))
    return rows.select("id", F.concat(F.lit("What is known about "), "title", F.lit("?")).alias("question"), F.concat_ws(" ", "summary", F.array_join("facts", " ")).alias("expected_answer"), domain.alias("domain"), F.when(n <= 2, "easy").when(n <= 5, "medium").otherwise("hard").alias("difficulty"))


def benchmark_from_pairs(pairs: DataFrame) -> DataFrame:
    q = F.concat_ws("\n", "prompt", F.concat(F.lit("A: "), "chosen"), F.concat(F.lit("B: "), "rejected"))
    return pairs.select("id", q.alias("question"), F.col("chosen").alias("expected_answer"), F.lit("contradiction").alias("domain"), F.lit("medium").alias("difficulty"))


def benchmark_from_questions(questions: DataFrame) -> DataFrame:
    return questions.select("id", "question", F.col("correct_answer").alias("expected_answer"), F.coalesce("domain", F.lit("general")).alias("domain"), F.lit("medium").alias("difficulty"))


def score_answers(items: DataFrame, answers: DataFrame, vectors: DataFrame | None = None, method: str = "keyword") -> DataFrame:
    """``model_id, item_id, accuracy, similarity, contradicts``; similarity of given vectors, else the accuracy."""
    rows = items.select(F.col("id").alias("item_id"), "expected_answer").join(answers, "item_id")
    exact = keyword_accuracy(F.col("expected_answer"), F.col("model_answer")) if method == "keyword" else lcs_f1("expected_answer", "model_answer")
    rows = rows.withColumns({"accuracy": exact, "contradicts": negation_conflict(F.col("expected_answer"), F.col("model_answer"))})
    if vectors is not None:
        rows = rows.join(vectors, ["item_id", "model_id"], "left").withColumn("similarity", F.coalesce(cosine(F.col("expected_vector"), F.col("answer_vector")), "accuracy"))
    else:
        rows = rows.withColumn("similarity", F.col("accuracy"))
    return rows.select("model_id", "item_id", "accuracy", "similarity", "contradicts")


def eval_result(scores: DataFrame) -> DataFrame:
    rate = F.avg(F.col("contradicts").cast("double"))
    return scores.groupBy("model_id").agg(F.count("*").alias("items"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("similarity"), F.coalesce(rate, F.lit(0.0)).alias("contradiction_rate")).withColumn("confidence", F.col("accuracy"))


def resolution_rate(df: DataFrame) -> DataFrame:
    """Share of answers nearer to ``chosen`` than to ``rejected``."""
    better = keyword_accuracy(F.col("chosen"), F.col("answer")) > keyword_accuracy(F.col("rejected"), F.col("answer"))
    return df.agg(F.coalesce(F.avg(better.cast("double")), F.lit(0.0)).alias("resolution_rate"))


METRICS = ("accuracy", "similarity", "contradiction_rate", "confidence")


def compare_models(results: DataFrame, base: str, new: str) -> DataFrame:
    """``metric, base, new, delta, verdict``; fewer contradictions are better."""
    long = results.unpivot("model_id", list(METRICS), "metric", "value")
    side = lambda m, n: long.where(F.col("model_id") == m).select("metric", F.col("value").alias(n))
    rows = side(base, "base").join(side(new, "new"), "metric").withColumn("delta", F.col("new") - F.col("base"))
    gain = F.when(F.col("metric") == "contradiction_rate", -F.col("delta")).otherwise(F.col("delta"))
    return rows.withColumn("verdict", F.when(gain > 0, "improved").when(gain < 0, "regressed").otherwise("same"))


def model_gate(results: DataFrame, base: str, new: str) -> DataFrame:
    rows = compare_models(results, base, new)
    names = lambda v: F.sort_array(F.collect_list(F.when(F.col("verdict") == v, F.col("metric"))))
    out = rows.agg(names("regressed").alias("regressions"), names("improved").alias("improvements"))
    return out.withColumn("passed", F.size("regressions") == 0).withColumn("winner", F.when(F.size("improvements") > F.size("regressions"), new).when(F.size("improvements") < F.size("regressions"), base).otherwise("tie"))


def head_to_head(scores: DataFrame, a: str, b: str) -> DataFrame:
    side = lambda m, n: scores.where(F.col("model_id") == m).select("item_id", F.col("accuracy").alias(n))
    rows = side(a, "accuracy_a").join(side(b, "accuracy_b"), "item_id")
    return rows.withColumn("winner", F.when(F.col("accuracy_a") > F.col("accuracy_b"), a).when(F.col("accuracy_a") < F.col("accuracy_b"), b).otherwise("tie"))


def approach_gate(metrics: DataFrame) -> DataFrame:
    """Approaches a, b, c with ``precision, recall, f1``: c passes if as precise as b, recalls as a, and is best in F1."""
    of = lambda a, c: F.max(F.when(F.col("approach") == a, F.col(c)))
    ok = (of("c", "precision") >= of("b", "precision")) & (of("c", "recall") >= of("a", "recall")) & (of("c", "f1") > F.greatest(of("a", "f1"), of("b", "f1")))
    whole = F.count_distinct("approach") == 3
    return metrics.agg((whole & F.coalesce(ok, F.lit(False))).alias("passed"))


def policy_failures(models: DataFrame, minimum: DataFrame) -> DataFrame:
    """Metrics ``metric, least`` that a model ``model_id, eval_scores (map)`` lacks or misses."""
    rows = models.join(F.broadcast(minimum), F.lit(True))  # a policy has a few lines
    value = F.try_element_at("eval_scores", F.col("metric"))
    return rows.select("model_id", "metric", "least", value.alias("value")).where("value is null or value < least")


def split_dataset(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: train or validation, by a hash of the key, so a row never changes sides."""
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000))
    return df.withColumn("split", F.when(at < int(share * 1000), "validation").otherwise("train"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Exported lines ``path, line_no, line`` with their ``kind``: pair, node, sft or invalid, by the fields they have."""
    keys = F.json_object_keys("line")
    has = lambda *k: F.coalesce(F.array_contains(keys, k[0]) if len(k) == 1 else F.size(F.array_intersect(keys, F.array(*[F.lit(x) for x in k]))) == len(k), F.lit(False))
    kind = F.when(has("prompt", "chosen", "rejected"), "pair").when(has("instruction", "response"), "sft").when(has("id", "title"), "node").otherwise("invalid")
    return lines.withColumn("kind", kind)


def analyze_export(lines: DataFrame) -> DataFrame:
    """One row: lines of each kind and the dataset's type."""
    k = F.col("kind")
    row = classify_lines(lines).agg(*[F.count_if(k == x).alias(f"n_{x}") for x in ("pair", "node", "sft", "invalid")])
    return row.withColumn("dataset_type", F.when((F.col("n_pair") > 0) & (F.col("n_sft") + F.col("n_node") == 0), "dpo").when((F.col("n_pair") == 0) & (F.col("n_sft") > 0), "sft").otherwise("mixed"))


def invalid_lines(lines: DataFrame, n: int = 10) -> DataFrame:
    return classify_lines(lines).where("kind = 'invalid'").orderBy("path", "line_no").limit(n).select("path", "line_no")


def version_delta(versions: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of four counts between two dataset versions."""
    counts = ("n_pairs", "n_nodes", "n_sft", "n_total")
    side = lambda v: versions.where(F.col("version_id") == v)
    x, y = side(a).alias("x"), side(b).alias("y")
    return x.join(y, F.lit(True)).select(*[(F.col(f"y.{c}") - F.col(f"x.{c}")).alias(c) for c in counts])


def lineage(versions: DataFrame, version_id: str, most: int = 100) -> DataFrame:
    """``version_id, depth`` from a version up to its root, by a recursive query; a cycle ends at ``most`` steps."""
    spark = versions.sparkSession
    versions.createOrReplaceTempView("__versions")
    return spark.sql(
        f"""with recursive up(version_id, parent_id, depth) as (
          select version_id, parent_id, 0 from __versions where version_id = :v
          union all select v.version_id, v.parent_id, up.depth + 1 from __versions v join up on v.version_id = up.parent_id where up.depth < {most})
        select version_id, min(depth) as depth from up group by version_id""",
        args={"v": version_id},
    )


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__k = 1").drop("__k")
