"""Text columns: words, sentences, dates, owners, snippets. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
TOKEN_STOP = "the and for with from this that discussion update changes change proposal announcement rollout thread notes week month new".split()
KEYWORD_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might can in on at to for of "
    "and or but not with from by into it its this that we our all use uses used than"
).split()
UNIT_STOP = "per hour hours min minute minutes day days week weeks month months second seconds".split()
# Words that don't tell what a claim is about.
CLAIM_STOP = "the and for are with per our all must can may will from that this have each not but should any been".split()
TOPIC_STOP = "services project company classic document created space pages https about which their there these those would could should other after before".split()
MONTHS = "january february march april may june july august september october november december".split()
MONTH = "(?:" + "|".join(MONTHS) + ")"
# ASCII word boundaries; Java's \b also takes accented letters for word characters.
#: White space of a class of characters, as the words of headlines and titles are parted.
SPACES = "\\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Fixed value: a phrase that names an owner, in a lower-case sentence.
OWNERSHIP = r"(?:owned|managed|handled|responsible|maintained|operated)\s+by\s+(?:the\s+)?(\w[\w\s]*?)\s*(?:team|group|squad|dept|department)?(?:\.|,|\z)"
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _without(words: Column, stop: Sequence[str]) -> Column:
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def normalize(c: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def tokenize(c: Column) -> Column:
    """Distinct tokens of two characters or more, without stop words."""
    return _without(F.filter(F.split(normalize(c), " "), lambda w: F.length(w) >= 2), TOKEN_STOP)


def keywords(c: Column) -> Column:
    """Distinct words of three characters or more, without stop words and units of time."""
    return _without(F.filter(F.split(F.lower(_text(c)), r"\W+"), lambda w: F.length(w) > 2), KEYWORD_STOP + UNIT_STOP)


def title_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_text(c)), r"\W+"), lambda w: F.length(w) > 3))


def topic_words(c: Column) -> Column:
    """Distinct words of five characters or more that are not common in documents."""
    return _without(F.filter(F.split(F.regexp_replace(F.lower(_text(c)), r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) >= 5), TOPIC_STOP)


def claim_stems(c: Column) -> Column:
    """Words of a claim of three characters or more that tell its topic, with common endings cut: ing over five characters, ed and es over four, s over three."""

    def stem(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when(w.endswith("ing") & (n > 5), F.substring(w, F.lit(1), n - 3))
            .when(w.endswith("ed") & (n > 4), F.substring(w, F.lit(1), n - 2))
            .when(w.endswith("es") & (n > 4), F.substring(w, F.lit(1), n - 2))
            .when(w.endswith("s") & (n > 3), F.substring(w, F.lit(1), n - 1))
            .otherwise(w)
        )

    words = F.filter(F.split(F.lower(_text(c)), r"\W+"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(_without(words, CLAIM_STOP), stem))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` if both are empty."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(empty)).otherwise(both / every)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Shared elements over the size of the smaller set; 0 if one is empty."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def long_sentences(c: Column) -> Column:
    """Lower-case trimmed sentences of more than 20 characters."""
    return F.filter(F.transform(F.split(_text(c), r"[.!?\n]+"), lambda s: F.lower(F.trim(s))), lambda s: F.length(s) > 20)


def sentences(c: Column) -> Column:
    return F.split(_text(c), r"[.!?\n]")


def _date(ref: Column) -> Column:
    """``YYYY-MM[-DD]`` or ``Month YYYY`` to a date; null where there is no such day."""
    iso = F.try_to_date(F.when(F.length(ref) == 7, F.concat(ref, F.lit("-01"))).otherwise(ref), "yyyy-MM-dd")
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(ref, r"^(\w+)", 1)))
    named = F.make_date(F.regexp_extract(ref, r"(\d{4})$", 1).cast("int"), number.cast("int"), F.lit(1))
    return F.when(ref.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), iso).otherwise(F.when(number > 0, named))


def dated_mentions(c: Column) -> Column:
    """``array<struct<label, date>>``: dates after "last updated", "updated", "modified", then those after "as of"."""
    when = rf"({MONTH}\s+\d{{4}}|\d{{4}}-\d{{2}}(?:-\d{{2}})?)"

    def found(lead: str) -> Column:
        hits = F.regexp_extract_all(_text(c), F.lit(rf"(?i){B0}{lead}{when}{B1}"), F.lit(0))
        return F.transform(hits, lambda x: F.struct(x.alias("label"), _date(F.regexp_extract(x, rf"(?i){when}$", 1)).alias("date")))

    return F.filter(F.concat(found(r"(?:last\s+updated|updated|modified)\s*:?\s*"), found(r"as\s+of\s+")), lambda x: x["date"].isNotNull())


def approximate_dates(c: Column) -> Column:
    """``array<date>`` of quarters (their first day), ``YYYY-MM`` and month names with a year."""
    text = _text(c)
    quarter = F.transform(F.regexp_extract_all(text, F.lit(rf"{B0}Q[1-4]\s20\d{{2}}{B1}"), F.lit(0)), lambda x: F.make_date(F.substring(x, -4, 4).cast("int"), (F.substring(x, 2, 1).cast("int") - 1) * 3 + 1, F.lit(1)))
    iso = F.transform(F.regexp_extract_all(text, F.lit(rf"{B0}20\d{{2}}-(?:0[1-9]|1[0-2]){B1}"), F.lit(0)), lambda x: F.try_to_date(F.concat(x, F.lit("-01")), "yyyy-MM-dd"))
    short = F.array(*[F.lit(m[:3]) for m in MONTHS])
    named = F.transform(
        F.regexp_extract_all(text, F.lit(rf"(?i){B0}(?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*\s+20\d{{2}}{B1}"), F.lit(0)),
        lambda x: F.make_date(F.substring(x, -4, 4).cast("int"), F.array_position(short, F.lower(F.substring(x, 1, 3))).cast("int"), F.lit(1)),
    )
    return F.array_compact(F.concat(quarter, iso, named))


def owner_of(text: Column, entity: Column) -> Column:
    """Lower-case owner, of two characters or more, that the first sentence with ``entity`` and an owner phrase names; null if none does."""
    about = F.filter(F.transform(sentences(text), lambda s: F.lower(s)), lambda s: s.contains(F.lower(entity)))
    names = F.filter(F.transform(about, lambda s: F.trim(F.regexp_extract(s, OWNERSHIP, 1))), lambda x: F.length(x) > 1)
    return F.try_element_at(names, F.lit(1))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def clean_excerpt(c: Column, limit: int = 250) -> Column:
    """Blanks collapsed, at most ``limit`` characters: cut after the last sentence that ends past 30, else at the last blank past 30, with dots."""
    flat = trimmed(F.regexp_replace(_text(c), rf"[{SPACES}]+", " "))
    head = F.substring(flat, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.{31,}[.!?]) ", 1)
    word = F.regexp_extract(head, r"(?s)^(.{31,}) ", 1)
    return F.when(F.length(flat) <= limit, flat).when(sentence != "", sentence).otherwise(F.concat(F.when(word != "", word).otherwise(head), F.lit("…")))


def headline(topic: Column, description: Column) -> Column:
    """The topic, else what stands before a colon within 60 characters, else at most 80 characters with dots."""
    colon = F.instr(description, ":")
    return F.coalesce(
        topic,
        F.when((colon > 1) & (colon <= 60), F.substring(description, F.lit(1), colon - 1)),
        F.when(F.length(description) <= 80, description),
        F.concat(F.substring(description, 1, 77), F.lit("...")),
    )


def snippet(c: Column, n: int = 500) -> Column:
    """Trimmed and cut at ``n`` characters, without a broken last word, with dots."""
    t = F.trim(_text(c))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n), r"\s+\S*\z", ""), F.lit("...")))


def redact_emails(c: Column) -> Column:
    """First character and domain of each address stay."""
    return F.regexp_replace(c, r"([\w.%+-])[\w.%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")


def is_uuid_list(c: Column) -> Column:
    """Whether the text is one UUID or several, parted by commas or blanks."""
    return F.trim(_text(c)).rlike(rf"(?i)^{UUID}(?:[\s,]+{UUID})*$")


def doc_type(title: Column, text: Column) -> Column:
    """Kind of a document by the first rule that its title and first 500 characters fit."""
    low = F.lower(F.concat_ws(" ", _text(title), F.substring(_text(text), 1, 500)))
    # Kinds and their patterns, in order
    rules = (
        ("meeting_notes", r"\d{4}-\d{2}-\d{2}.*meeting|meeting.*\d{4}|minutes|attendees|action items"),
        ("changelog", r"changelog|release notes|what'?s new|v\d+\.\d+"),
        ("config", r"configuration|settings|parameters|defaults|\.toml|\.yaml|\.json|\.env"),
        ("api_reference", r"endpoint|request.*response|status code|rate limit|api reference|swagger"),
        ("policy", rf"{B0}policy{B1}|{B0}must{B1}.*{B0}shall{B1}|compliance|requirement|guideline"),
        ("architecture", r"architecture|design doc|component.*diagram|system design|adr|decision record"),
        ("guide", rf"{B0}guide{B1}|tutorial|how to|getting started|step \d|walkthrough"),
    )
    kind = F.lit("general")
    for name, pattern in reversed(rules):
        kind = F.when(low.rlike(pattern), F.lit(name)).otherwise(kind)
    return kind


def naive_facts(c: Column) -> Column:
    """The first three sentences of more than 20 characters, on one line each."""
    parts = F.transform(F.split(_text(c), r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\n+", " ")))
    return F.slice(F.filter(parts, lambda s: F.length(s) > 20), 1, 3)


def keyword_entities(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names whose pattern the text matches; ``rules`` are (pattern, name)."""
    return F.array_compact(F.array(*[F.when(_text(c).rlike(p), F.lit(n)) for p, n in rules]))
