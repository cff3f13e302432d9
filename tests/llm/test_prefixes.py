"""The prefix trie (operator 11) against plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

from factweave.llm import prefixes
from tests.llm.test_operators import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns of each conversation; ties by the digest of role and text."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - (c % 5 if c >= 0 else -(-c % 5)))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        gain = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += not kids[node]
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def same(got, rows, rebuild):
    convs = ordered(rows)
    assert sorted(map(tuple, got.select(*prefixes.RESULT).collect()), key=str) == plain_trie(rebuilt(convs) if rebuild else convs)


def conversations(seed, n):
    """Few texts, long and short conversations, copies of whole conversations, ids with gaps and below zero."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 3 * n), n):
        shared = r.random() < 0.5
        for t in range(r.choice([1, 2, 3, 9, 10, 14])):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", None]), f"text {t} é" if shared or r.random() < 0.7 else r.choice([None, "", f"own {c}"])))
    return rows


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(prefixes.op11_prefix_trie(spark, SF), rows, True)


def test_made_conversations(spark):
    """Rebuilt and as they are, over several ranges; a sketch too narrow to tell anything changes no row."""
    rows = conversations(1, 120)
    rows += [(777, None, "user", f"turn {k % 7}") for k in range(900)] + [(778, k, "user", f"turn {k}") for k in range(900)] + [(779, k, "user", f"turn {k}") for k in range(950)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that few rows have several ranges
    turns = prefixes.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert turns.where("conv_id = 778").select("part").distinct().count() > 1
    same(prefixes.prefix_trie(prefixes.borrowed_heads(turns)), rows, True)
    same(prefixes.prefix_trie(prefixes.with_roots(turns)), rows, False)
    same(prefixes.prefix_trie(prefixes.with_roots(turns), most_counters=1), rows, False)


def test_screening(spark, monkeypatch):
    """Only prefixes that more than one conversation has, or that a counter takes for such, are grouped."""
    rows = [(c, t, "user", f"{'hello' if t == 0 else c} {t}") for c in range(300) for t in range(8)]
    seen = {}
    keep = prefixes._screen
    monkeypatch.setattr(prefixes, "_screen", lambda rows, sketch, width, digests, name: seen.setdefault(name, keep(rows, sketch, width, digests, name)))
    monkeypatch.setattr(prefixes, "release", lambda *tables: None)
    same(prefixes.prefix_trie(prefixes.with_roots(prefixes.numbered_turns(spark.createDataFrame(rows, SCHEMA)))), rows, False)
    flagged = seen["own"].where("depth > 0")
    assert flagged.where("depth = 1 and not own").count() == 0
    assert flagged.where("depth > 1 and own").count() < 0.2 * 300 * 7


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "nobody"), (1, None, None, None), (1, None, None, None), (3, 2, "user", ""), (3, 2, "user", ""), (3, 1, None, "é" * 40_000), (9, 5, "user", "x"), (11, 5, "user", "x"), (10, 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as part", "3 as item", "4 as p1", "5 as depth", "6 as head", "7 as leaf", "8 as copy")
    same(prefixes.prefix_trie(prefixes.borrowed_heads(prefixes.numbered_turns(df))), rows, True)
    none = spark.createDataFrame([], SCHEMA)
    assert prefixes.prefix_trie(prefixes.borrowed_heads(prefixes.numbered_turns(none))).count() == 0
