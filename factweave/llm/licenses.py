"""License scans: Aho-Corasick over tags and notices, and licence expressions (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import documents

#: Phrases that every scan counts, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method, as words, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
    "spdx license identifier": "spdx",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "server side public license": "sspl",
    "business source license": "busl",
    "open database license": "odbl",
    "sil open font license": "ofl",
    "free documentation license": "gfdl",
    "isc license": "isc",
    "zlib license": "zlib",
    "the unlicense": "public-domain",
    "dedicated to the public domain": "public-domain",
    "the software is provided as is without warranty of any kind": "no-warranty",
    "licensed under the apache license version 2 0": "apache",
    "attribution noncommercial": "cc-by-nc",
    "attribution sharealike": "cc-by-sa",
    "attribution noderivatives": "cc-by-nd",
    "for internal use only": "proprietary",
    "may not be reproduced": "proprietary",
    "without prior written permission": "restricted",
}
#: Families of SPDX identifiers by their lower-case beginnings, the longest that fits; label and how much it restricts use.
FAMILIES = (("agpl", "agpl", 0.9), ("lgpl", "lgpl", 0.6), ("gpl", "gpl", 0.8), ("apache", "apache", 0.2), ("mit", "mit", 0.1), ("bsd", "bsd", 0.1), ("isc", "isc", 0.1), ("mpl", "mpl", 0.5), ("cc0", "cc0", 0.0), ("cc-by-nc", "cc-by-nc", 0.9), ("cc-by-nd", "cc-by-nd", 0.8), ("cc-by-sa", "cc-by-sa", 0.6), ("cc-by", "cc-by", 0.3), ("unlicense", "public-domain", 0.0), ("licenseref", "other", 1.0),
            ("epl", "epl", 0.5), ("eupl", "eupl", 0.7), ("cddl", "cddl", 0.5), ("artistic", "artistic", 0.3), ("bsl", "bsl", 0.1), ("zlib", "zlib", 0.1), ("sspl", "sspl", 1.0), ("busl", "busl", 1.0), ("odbl", "odbl", 0.6), ("ofl", "ofl", 0.3), ("gfdl", "gfdl", 0.7),
            ("0bsd", "bsd", 0.0), ("psf", "psf", 0.2), ("python", "psf", 0.2), ("ms-pl", "ms-pl", 0.4), ("wtfpl", "public-domain", 0.0), ("cc-by-nc-sa", "cc-by-nc", 0.9), ("cc-by-nc-nd", "cc-by-nc", 1.0), ("afl", "afl", 0.2), ("osl", "osl", 0.7))
#: How much other labels restrict use.
RESTRICTS = {"reserved": 1.0, "proprietary": 1.0, "public-domain": 0.0, "cc": 0.3, "spdx": 0.0, "exception": 0.0, "no-warranty": 0.0, "restricted": 0.5, **{label: x for _, label, x in FAMILIES}}
TAG = re.compile(r"spdx-license-identifier\s*:?[ \t]*([^\r\n*]+)")
PIECE = re.compile(r"\(|\)|[a-z0-9.+:-]+")
NEEDS = {"or": 1, "and": 2, "with": 3}
#: Bytes of words stay, A-Z become a-z, all other ASCII becomes a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def parse_expression(text: str) -> list | None:
    """A licence expression in postfix order by the shunting-yard method; null if it isn't one.

    ``or`` binds weakest, then ``and``, then ``with``, whose right side names an exception.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand = False
    for piece in PIECE.findall(text.lower()):
        if piece in NEEDS:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and NEEDS[waiting[-1]] >= NEEDS[piece]:
                out.append(waiting.pop())
            waiting.append(piece)
            operand = False
        elif piece == "(":
            if operand:
                return None
            waiting.append(piece)
        elif piece == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif operand:  # what follows a whole expression is prose
            break
        else:
            out.append(piece)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels of all licences named, and how restrictive the expression is.

    ``or`` lets the user choose the least restrictive side, ``and`` binds to the most restrictive; an exception takes a
    quarter off. An unknown identifier is ``other`` and as restrictive as can be.
    """
    stack: list[tuple[set[str], float]] = []
    for x in postfix:
        if x not in NEEDS:
            family = max((f for f in FAMILIES if re.match(re.escape(f[0]) + r"(?![a-uw-z])", x)), key=lambda f: len(f[0]), default=("", "other", 1.0))
            stack.append(({family[1]}, family[2]))
            continue
        (b, weight_b), (a, weight_a) = stack.pop(), stack.pop()
        if x == "with":
            stack.append((a | {"exception"}, 0.75 * weight_a))
        else:
            stack.append((a | b, min(weight_a, weight_b) if x == "or" else max(weight_a, weight_b)))
    return stack[-1]


def build_automaton(base: dict[str, str], phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**phrases, **base}:
        found.add_word(f" {phrase} ", (len(phrase) + 2, base.get(phrase), phrases.get(phrase)))
    found.make_automaton()
    return found


def scan_text(text: str | None, automaton: ahocorasick.Automaton) -> tuple:
    """Words, base places, first and last of these, base labels, all labels, expressions and score of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(TABLE).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, base, labels = [], set(), set()
    done, before = 0, 0
    for end, (size, base_label, label) in automaton.iter(line):
        if base_label:
            start = end - size + 1
            before += line.count(" ", done, start) if start >= done else -line.count(" ", start, done)
            done = start
            places.append(before)
            base.add(base_label)
        labels.update(x for x in (base_label, label) if x)
    expressions, weight = [], None
    if "spdx" in labels:
        for m in TAG.finditer((text or "").lower()):
            if (postfix := parse_expression(m[1])) is not None:
                named, w = evaluate(postfix)
                labels |= named
                weight = w if weight is None else max(weight, w)
                expressions.append(" ".join(postfix))
    rest = [RESTRICTS.get(x, 1.0) for x in labels - {"spdx"}]
    score = weight if weight is not None else max(rest, default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), ";".join(expressions), float(score)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions string, score double"


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Licence notices and expressions of whole texts: ``doc_id`` and the columns of ``SCHEMA``, a row per input row.

    Text is A-Z lower-cased and cut into words; an Aho-Corasick automaton finds all places, overlapping ones too, where
    a phrase's words stand in a row. SPDX tags are parsed; ``score`` says how restrictive the strictest tagged
    expression is, or else the strictest notice (0: none). Null and empty texts have no words and no labels. Repeated
    rows are scanned each for itself; other columns are ignored. ``base`` and ``phrases`` map words to labels.
    """
    base = BASE_PHRASES if base is None else base
    phrases = PHRASES if phrases is None else phrases
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':') for x in SCHEMA.split(', '))}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(base, phrases)
        for texts in batches:
            got = pd.DataFrame([scan_text(t, automaton) for t in texts], columns=names)
            yield got.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan("text").alias("__scan")).select("doc_id", "__scan.*")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan_licenses(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions")
