"""Prefix tries of conversations against a trie built in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from kiln.llm import listrank, prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
WORD = re.compile("[^\x20\x09-\x0d]+")


def by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), order, (role, text)))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = convs.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ms in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = {n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below}
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(built[c]) == len(node)))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), kids[node], sum(not k for k in kids.values()), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, depth int, digest string")
    out = prefixtrie.trie(df, **how)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 130), 90):
        for t in range(rng.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, t, rng.choice(("user", "assistant", None)) if t > 1 else "user", rng.choice(("hello there", "a b c", "", None)) if t else "same first turn"))
    return rows


def test_random_conversations(spark):
    rows = some_rows(1)
    assert got(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 5, "user", "x"), (1, 5, "user", "x"), (1, 5, "user", "a"), (None, 1, "user", "lost"),
            (20, 2, "ab", "c"), (20, 1, "a", "bc"), (21, 1, "user", "only one"), (22, None, "user", "é 中\x0b文 \x00"), (40, 1, "user", "w " * 3000)]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 240) for t in range(4)]
    assert got(spark, rows, piece=3) == by_hand(rows)


def test_one_long_conversation(spark):
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(400)] + [(1, 0, "user", "turn 0"), (1, 1, "user", "b"), (1, 2, "user", "c"), (1, 3, "user", "d")]
    assert got(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(df).collect() == []


@pytest.mark.parametrize("core", [1, 10, 1 << 14])
def test_list_ranks(spark, core):
    rng = random.Random(core)
    ids = rng.sample(range(10**6), 400)
    rows = [(a, b) for a, b in zip(ids, [*ids[1:], None])]
    rng.shuffle(rows)
    ranks = {r["id"]: r["rank"] for r in listrank.rank(spark.createDataFrame(rows, "id long, next long"), core).collect()}
    assert ranks == {x: i for i, x in enumerate(ids)}


def test_a_collision_is_not_passed_over(spark):
    with pytest.raises(Exception, match="two different prefixes"):  # at these bases every sequence has the same value
        got(spark, [(20, 0, "a", "b"), (40, 0, "a", "c")], bases=(0, 0))
