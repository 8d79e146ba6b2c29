"""Operator 13 against a dictionary of prefixes."""

import hashlib
import zlib

import numpy as np
import pytest

from mandisight.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, parts int, shard string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "s") for r in rows], SCHEMA)


def plain_key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain_trie(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, plain_key(role or "", text or ""),
                                                  (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in m if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p],
                    sum(kids[q] == 0 for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **bounds):
    got = [tuple(r) for r in conversation_trie.trie(rows_of(spark, rows), **bounds).collect()]
    assert sorted(got, key=str) == plain_trie(rows)


def random_rows(seed, n=120, span=400):
    rng = np.random.default_rng(seed)
    rows = []
    for c in sorted(set(rng.integers(-span // 2, span, n).tolist())):
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["hi", "yes", "été", "", "a b"]))))
    rng.shuffle(rows)
    return [(int(c), int(t), r, x) for c, t, r, x in rows]


@pytest.mark.parametrize("seed,bounds", [(1, {}), (2, {"shard_convs": 1}), (3, {"shard_convs": 30}), (4, {"shard_turns": 5})])
def test_trie_equals_prefix_dictionary(spark, seed, bounds):
    check(spark, random_rows(seed), **bounds)


def test_hot_turn_and_hot_conversation_over_many_shards(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 3000, 10) for t in range(7)]
    rows += [(c, t, "user", "first" if t == 0 else f"{c % 7} {t}") for c in range(3001, 6000, 11) for t in range(4)]
    check(spark, rows, shard_convs=16)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(0, None, None, None), (0, None, "user", None), (0, 1, None, "x"), (0, 1, "user", "x"), (0, 1, "user", "x"),
            (7, 5, "user", "late"), (250, 0, "a", "b"), (250, 0, "ab", ""), (-3, 2, "user", "minus"), (None, 1, "user", "no id")]
    check(spark, rows)
    assert any(r[1] == 0 and r[3] == 4 for r in plain_trie(rows))


def test_long_conversation_beside_short_ones(spark):
    rows = [(100, t, "user", f"t{t}") for t in range(300)] + [(c, t, "user", f"t{t}") for c in (101, 250) for t in range(20)]
    check(spark, rows, shard_convs=1)


def test_empty_table(spark):
    assert conversation_trie.trie(rows_of(spark, [])).count() == 0
