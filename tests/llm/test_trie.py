"""The prefix trie against every prefix: ties, nulls, absent and short heads, conversations over many slices, counters that collide."""

import hashlib
import random
import re
import zlib

import pytest

from pulsework.llm import op13_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long"


def brute_force(rows, heads=4):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {p: 0 for p in nodes}
    leaves, saved = dict(kids), dict(kids)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * words
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if made[c] == p).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items()), key=str)


def some_rows():
    r = random.Random(3)
    rows = []
    for c in [*range(0, 30), *range(41, 60), 100, 121, 122]:  # 40 and 120 are absent
        n = r.choice([1, 2, 3, 5, 8])
        rows += [(c, t, r.choice(["user", "bot", None, ""]), r.choice(["a b", "a b c", "", None, "ü\tö"]), t) for t in range(n)]
    rows += [(200 + c, t, "user", f"copy of {t} words", 0) for c in range(40) for t in range(4)]  # exact copies
    rows += [(c, t, "user", f"line {t // 3}", 0) for c in (300, 301, 320) for t in range(60)]  # long, with one long common head
    rows += [(400, None, "x", "first"), (400, None, "x", "first"), (400, 5, "b", "tie"), (400, 5, "a", "tie"), (400, -1, "ab", "c"), (401, 0, "a", "bc"), (None, 1, "user", "no conversation"), (-41, 1, "u", "negative"), (-40, 1, "u", "base")]
    return [(*x, 1)[:5] for x in rows]


@pytest.mark.parametrize("slice_rows, counters, heads", [(1_000_000, None, 4), (7, 1, 4), (20, 64, 1)])
def test_against_every_prefix(spark, monkeypatch, slice_rows, counters, heads):
    monkeypatch.setattr(op13_trie, "ROWS_A_SLICE", slice_rows)
    rows = some_rows()
    got = op13_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), heads=heads, counters=counters)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, heads)


def test_turnless_conversations_and_empty_tables(spark):
    rows = [(41, 0, "u", "x", 0), (43, 0, "u", "y", 0)]  # their heads are absent
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 > 0] or [(next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4), 0, "u", "x", 0)]
    got = op13_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows) and got.count() == 1
    assert op13_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
