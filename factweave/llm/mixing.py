"""Mixing sources to target weights by Pareto order sampling (operator 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import BLANK, documents
from factweave.llm.spans import broadcast_if
from factweave.plans.staging import stage

#: Ranks are cut into so many bins, and a bin again into as many.
BINS = 1024


def word_count(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANK)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words that each source should give: ``(skey, source_size, target)`` from ``(skey, size)`` rows.

    Sources in order of ``skey`` weigh ``weights``, repeated, and share ``share`` of all words. A source gives at most
    ``cap`` times its own; what it can't give is shared again by weight. One row per source goes through one window.
    """
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    w = F.element_at(cycle, (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1)
    weighed = by_source.withColumn("w", w).withColumn("full_at", cap * F.col("source_size") / F.col("w"))
    order = Window.orderBy("full_at", "skey")
    left = (
        weighed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("given", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (share * F.col("total") - cap * F.col("given")) / F.col("w_left"))
    )
    # the first source, in the order in which they fill up, that the level leaves room in
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "skey", "level"))).over(every)["level"]
    filled = F.coalesce(F.least(level * F.col("w"), cap * F.col("source_size")), cap * F.col("source_size"))
    return left.select("skey", "source_size", filled.cast("double").alias("target"))


def class_rates(classes: DataFrame, targets: DataFrame, cap: float = 2.0) -> DataFrame:
    """Expected copies of a document by source and length class: ``(skey, cls, rate)``.

    Classes are powers of two of the length; a class's weight grows gently with it. Rates are in proportion to
    the weights, at most ``cap``, and give the source's target in expectation. At most 64 rows a source.
    """
    order = Window.partitionBy("skey").orderBy(F.col("cls").desc())
    weight = (16.0 + F.col("cls")) / 16.0
    x = (
        classes.join(targets, "skey")
        .withColumn("weight", weight)
        .withColumn("units", (16 + F.col("cls")) * F.col("words"))
        .withColumn("given", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("units_left", F.sum("units").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("c", F.try_divide(F.col("target") - cap * F.col("given"), F.col("units_left") / 16.0))
    )
    of_source = Window.partitionBy("skey")
    c = F.max(F.when(F.col("c") * F.col("weight") <= cap, F.struct("cls", "c"))).over(of_source)["c"]
    rate = F.when(F.col("words") == 0, 0.0).otherwise(F.coalesce(F.least(c * F.col("weight"), F.lit(cap)), F.lit(cap)))
    return x.select("skey", "cls", F.greatest(rate, F.lit(0.0)).alias("rate"))


def _boundary(sums: DataFrame, need: DataFrame, bin_: str) -> DataFrame:
    """``need (skey, words_left)`` against bins of words: the bin in which it runs out, and what is left at its start."""
    order = Window.partitionBy("skey").orderBy(bin_)
    before = F.sum("words").over(order) - F.col("words")
    return (
        sums.withColumn("before", before)
        .join(need, "skey")
        .where((F.col("before") <= F.col("words_left")) & (F.col("before") + F.col("words") > F.col("words_left")))
        .select("skey", bin_, (F.col("words_left") - F.col("before")).alias("words_left"))
    )


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """Draw copies of documents so that each source gives its target of words.

    Every document has an expected number of copies, by its source and length class. Whole copies are allocated; the
    fraction left is an inclusion probability ``p``. Documents of a source are ranked by ``(u / (1 - u)) / (p / (1 - p))``,
    ``u`` a hash of id and seed, and taken in this order up to a fixed number of words (Rosén's Pareto sampling with its
    size fixed in words). The rank at which the words run out is found in two levels of 1,024 bins, so no task gets a
    source's rows together. One more document, the one whose size is nearest to what is still missing, closes the gap.

    Returns one row per input row: ``doc_id, source, size, source_size, target, copies, taken``. Null and empty texts
    have size 0 and are not taken; a null source is a source of its own, the last. Rows that share an id share ``u``, and
    ties go by id and size; repeated rows are drawn each for itself. No rows give no rows. Other columns are ignored.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0
    rows = stage(
        docs.select("doc_id", "source", skey.alias("skey"), word_count(F.col("text")).alias("size"), u.alias("u")).withColumn("cls", F.length(F.bin("size"))),
        "mix-sizes",
    )
    targets = stage(source_targets(rows.groupBy("skey", "cls").agg(F.sum("size").alias("size")), weights, share, cap), "mix-targets")
    rates = stage(class_rates(rows.groupBy("skey", "cls").agg(F.sum("size").alias("words")), targets, cap), "mix-rates")
    p = F.col("rate") - F.col("whole")
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    drawn = (
        rows.join(broadcast_if(rates), ["skey", "cls"])
        .withColumn("whole", F.floor("rate"))
        .withColumn("v", F.when((p > 0) & (F.col("size") > 0), q / (1 + q)))
        .withColumn("b1", F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)))
        .withColumn("b2", F.floor((F.col("v") * BINS - F.col("b1")) * BINS))
    )
    words = F.sum("size").alias("words")
    given = drawn.groupBy("skey").agg(F.sum(F.col("whole") * F.col("size")).alias("given"))
    need = targets.join(given, "skey").select("skey", F.greatest(F.floor(F.col("target") + 0.5) - F.col("given"), F.lit(0)).alias("words_left"))
    ranked = drawn.where(F.col("v").isNotNull())
    first = stage(_boundary(ranked.groupBy("skey", "b1").agg(words), need, "b1"), "mix-bins")
    inside = ranked.join(broadcast_if(first.select("skey", "b1")), ["skey", "b1"])
    second = stage(_boundary(inside.groupBy("skey", "b1", "b2").agg(words), first.select("skey", "words_left"), "b2"), "mix-bins")
    # rows of the last bin, one by one
    order = Window.partitionBy("skey").orderBy("v", "doc_id", "size")
    last = (
        inside
        .join(broadcast_if(second), ["skey", "b2"])
        .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("take", (F.col("upto") <= F.col("words_left")).cast("int"))
    )
    edge = stage(
        last.groupBy("skey").agg(
            F.max(F.when(F.col("take") == 1, F.struct("v", "doc_id", "size"))).alias("last_in"),
            (F.first("words_left") - F.coalesce(F.max(F.when(F.col("take") == 1, F.col("upto"))), F.lit(0))).alias("missing"),
        ),
        "mix-edge",
    )
    cut = stage(first.select("skey", F.col("b1").alias("cut1")).join(second.select("skey", F.col("b2").alias("cut2")), "skey", "left").join(edge, "skey", "left"), "mix-cut")
    inside_last = (F.col("b1") == F.col("cut1")) & (F.col("b2") == F.col("cut2"))
    chosen = (
        F.when(F.col("v").isNull(), False)
        .when(F.col("cut1").isNull(), True)
        .when(F.col("b1") != F.col("cut1"), F.col("b1") < F.col("cut1"))
        .when(~inside_last, F.col("b2") < F.col("cut2"))
        .otherwise(F.col("last_in").isNotNull() & (F.struct("v", "doc_id", "size") <= F.col("last_in")))
    )
    taken = drawn.join(broadcast_if(cut), "skey", "left").withColumn("chosen", chosen)
    # what is missing or, if smaller, what one more document would give too much
    closer = stage(
        taken.where(F.col("v").isNotNull() & ~F.col("chosen") & F.col("missing").isNotNull())
        .groupBy("skey")
        .agg(F.min(F.when(F.abs(F.col("size") - F.col("missing")) < F.col("missing"), F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "v", "doc_id", "size"))).alias("one"))
        .where(F.col("one").isNotNull()),
        "mix-close",
    )
    close = F.coalesce(
        F.col("one").isNotNull() & ~F.col("chosen") & (F.col("v") == F.col("one.v")) & F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("size") == F.col("one.size")),
        F.lit(False),
    )
    copies = F.col("whole") + (F.col("chosen") | close).cast("long")
    return (
        taken.join(broadcast_if(closer), "skey", "left")
        .join(broadcast_if(targets), "skey")
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with the default weights."""
    return mix_sources(documents(spark, sf_dir))


#: The same sampling with plain windows over whole sources.
ORACLE_OP1 = r"""
with d as (
  select doc_id, source, coalesce('s' || source, '~') as skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    (cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double as u
  from documents),
r as (select *, case when size = 0 then 1 else floor(log2(size::double))::bigint + 1 end as cls from d),
s as (select skey, sum(size)::bigint as source_size from r group by skey),
s1 as (select *, [3, 1, 2][(row_number() over (order by skey) - 1) % 3 + 1] as w from s),
s2 as (select *, 2.0::double * source_size / w as full_at, sum(source_size) over ()::bigint as total from s1),
s3 as (select *, coalesce(sum(source_size) over (order by full_at, skey rows between unbounded preceding and 1 preceding), 0)::bigint as given,
  sum(w) over (order by full_at, skey rows between current row and unbounded following)::bigint as w_left from s2),
s4 as (select *, (1.5::double * total - 2.0::double * given) / w_left as level from s3),
t as (select skey, source_size, coalesce(least((select level from s4 where level <= full_at order by full_at, skey limit 1) * w, 2.0::double * source_size), 2.0::double * source_size) as target from s4),
c as (select skey, cls, sum(size)::bigint as words from r group by skey, cls),
c1 as (select c.*, target, (16.0::double + cls) / 16.0::double as weight,
  coalesce(sum(words) over (partition by skey order by cls desc rows between unbounded preceding and 1 preceding), 0)::bigint as given,
  sum((16 + cls) * words) over (partition by skey order by cls desc rows between current row and unbounded following)::bigint as units_left
  from c join t using (skey)),
c2 as (select *, (target - 2.0::double * given) / (units_left / 16.0::double) as c from c1),
c3 as (select skey, cls, words, weight, (select max_by(b.c, b.cls) from c2 b where b.skey = a.skey and b.c * b.weight <= 2.0) as k from c2 a),
e as (select skey, cls, greatest(case when words = 0 then 0.0::double else coalesce(least(k * weight, 2.0::double), 2.0::double) end, 0.0::double) as rate from c3),
x as (select r.*, floor(rate)::bigint as whole, rate - floor(rate) as p from r join e using (skey, cls)),
x1 as (select *, case when p > 0 and size > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from x),
x2 as (select *, q / (1 + q) as v from x1),
n as (select skey, greatest(floor(any_value(target) + 0.5)::bigint - sum(whole * size), 0)::bigint as words_left from x2 join t using (skey) group by skey),
x3 as (select *, sum(size) over (partition by skey order by v, doc_id, size rows between unbounded preceding and current row) as upto from x2 where v is not null),
x4 as (select x3.*, words_left, upto <= words_left as take from x3 join n using (skey)),
m as (select skey, any_value(words_left) - coalesce(max(upto) filter (where take), 0) as missing, bool_or(not take) as cut from x4 group by skey),
o as (select x4.skey, x4.doc_id, x4.size, row_number() over (partition by x4.skey order by abs(size - missing), v, doc_id, size) as k
  from x4 join m using (skey) where not take and cut and abs(size - missing) < missing),
g as (select x2.*, coalesce(x4.take, false) as chosen, o.k is not null as close
  from x2 left join x4 on x2.skey = x4.skey and x2.doc_id = x4.doc_id
  left join o on o.k = 1 and o.skey = x2.skey and o.doc_id = x2.doc_id)
select doc_id, source, size, source_size, target, whole + (chosen or close)::bigint as copies, (whole + (chosen or close)::bigint) * size as taken
from g join t using (skey)
"""
