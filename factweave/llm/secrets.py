"""Secret scans: rules, and sliding-window entropy over candidate strings (operator 3; built-in functions only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import documents

#: Rules that every scan applies, in this order: kind, pattern, least length of the group that counts. A run of hex
#: digits, or of what may follow AKIA, is as long as it can be, so its least length can stand in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Cheap patterns that a text with such matches also matches.
ASSIGN_GATE = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: Strings that are tested for entropy: they have no blanks, and are longer than most words.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are never reported for their entropy: words, identifiers of lower-case words, UUIDs, paths, placeholders.
ALLOWED = (
    r"^[A-Z]?[a-z]+$",
    r"^[A-Z]+$",
    r"^[0-9_=+/-]+$",
    r"^[A-Za-z]+(?:[-_/=+][A-Za-z]+)*$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[-_]?(?:key|token|secret)|lorem|xxxx|abcdefgh|01234567|12345678",
)
#: Character classes: name, pattern of a candidate of this class, bits a character at which a window is reported.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 2.9), ("alnum", r"^[A-Za-z0-9]+$", 3.4), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.6))
WINDOW = 20


def _spans(text: Column, pattern: str, gate: str | None = None) -> Column:
    """Array of ``struct(at, end, hit)`` of the matches, left to right, in code points.

    The text is split at the matches; lengths of the pieces and of the matches add up to the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    empty = F.array().cast("array<struct<at:int,end:int,hit:string>>")

    def add(acc: Column, x: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + x["gap"]
        return F.concat(acc, F.array(F.struct(at.alias("at"), (at + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"))))

    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    found = F.aggregate(pairs, empty, add)
    return F.when(text.rlike(gate or pattern), found).otherwise(empty)


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits a character, of the windows of ``s``; strings that are shorter are one window.

    With ``S`` the sum of ``c log2 c`` over the counts ``c`` of a window of ``n`` characters, its entropy is
    ``log2 n - S / n``. A step changes two counts, so ``S`` is kept up by what those two add and take away.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    n = F.least(F.length(s), F.lit(window))

    def f(c: Column) -> Column:
        return F.element_at(table, c + 1)

    def count(part: Column, ch: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, ch, F.lit("")))

    first = F.substring(s, F.lit(1), n)
    start = F.aggregate(F.array_distinct(F.split(first, "")), F.lit(0.0), lambda a, ch: F.when(ch == "", a).otherwise(a + f(count(first, ch))))

    def step(acc: Column, i: Column) -> Column:
        old, new = F.substring(s, i, F.lit(1)), F.substring(s, i + window, F.lit(1))
        kept = F.substring(s, i + 1, F.lit(window - 1))
        a, b = count(kept, old), count(kept, new)
        now = acc["now"] - (f(a + 1) - f(a)) + (f(b + 1) - f(b))
        return F.struct(now.alias("now"), F.least(acc["least"], now).alias("least"))

    steps = F.when(F.length(s) > window, F.sequence(F.lit(1), F.length(s) - window)).otherwise(F.array().cast("array<int>"))
    least = F.aggregate(steps, F.struct(start.alias("now"), start.alias("least")), step)["least"]
    return F.when(n > 0, F.log2(n) - least / n).otherwise(0.0)


def scan_secrets(docs: DataFrame, allowed: Sequence[str] = ALLOWED, classes: Sequence[tuple] = CLASSES, window: int = WINDOW) -> DataFrame:
    """Find secrets in whole texts.

    Returns one row per input row: ``doc_id`` and ``found``, an array of ``struct(at, end, rank, kind, hit)`` in order of
    ``at``, then of kind: assign, access, hex, entropy. ``entropy`` spans are candidate strings, outside the other spans,
    that no allow-list pattern matches and one of whose windows reaches its class's entropy. Null and empty texts have
    no spans; rows are kept apart even if they repeat; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, ASSIGN_GATE), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    kinds = (("assign", assign), ("access", _spans(text, ACCESS)), ("hex", _spans(text, HEX)))

    def tag(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["hit"].alias("hit")))

    base = F.concat(*[tag(spans, k, kind) for k, (kind, spans) in enumerate(kinds)])

    def secret(x: Column) -> Column:
        s, ok = x["hit"], F.lit(True)
        for pattern in allowed:
            ok = ok & ~s.rlike(pattern)
        limit = F.lit(None).cast("double")
        for _, pattern, bits in reversed(classes):
            limit = F.when(s.rlike(pattern), F.lit(bits)).otherwise(limit)
        outside = ~F.exists(F.col("base"), lambda y: (y["at"] < x["end"]) & (x["at"] < y["end"]))
        return F.when(ok & outside, window_entropy(s, window) >= limit).otherwise(False)

    more = tag(F.filter(_spans(text, CANDIDATE), secret), 3, "entropy")
    # two steps, so that the rules run once
    with_base = docs.select("doc_id", "text", base.alias("base"))
    return with_base.select("doc_id", F.array_sort(F.concat("base", more)).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["end"].cast("string"))), ",")


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = F.col("found")

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan_secrets(documents(spark, sf_dir)).select(
        "doc_id", *map(count, ("assign", "access", "hex", "entropy")), F.sha2(_joined(F.filter(found, lambda x: x["rank"] < 3)), 256).alias("base_sha256"), _joined(found).alias("spans")
    )
