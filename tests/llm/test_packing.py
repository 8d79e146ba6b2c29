"""Operator 8: valid, gapless and near the lower bound."""

import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mandisight.llm import packing, vocab
from mandisight.llm.common import written
from tests.llm.helpers import TEXTS, documents, empty


def check(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_places_every_piece(lengths):
    plan = packing.Plan(Counter(lengths), capacity=40)
    seen, rows = Counter(), []
    for n in lengths:
        s, o = plan.place(np.array([n]), np.array([seen[n]]))
        rows.append({"sequence_id": int(s[0]), "offset": int(o[0]), "length": n})
        seen[n] += 1
    used = check(rows, 40)
    assert used == plan.sequences
    assert used <= max(1, 2 * -(-sum(lengths) // 40)) or not lengths


def test_planted_triple_is_consumed_as_often_as_counts_allow():
    # 47 + (25 + 17 + 11) alone is full; 11 runs out after four times.
    plan = packing.Plan({47: 9, 25: 7, 17: 6, 11: 4}, capacity=100)
    (number, first, offset), = plan.intervals[11]
    assert (number, offset, plan.used[11]) == (0, 89, 4)
    assert plan.intervals[25][0] == (0, first, 47) and plan.intervals[17][0] == (0, first, 72)
    assert plan.intervals[47][0] == (0, first, 0) and plan.intervals[47][1][0] == 4


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=8), st.integers(3, 60), st.integers(1, 30))
def test_sum_index_finds_what_a_search_finds(histogram, total, reserved):
    left = [histogram.get(n, 0) for n in range(100)]
    taken = {reserved: 1} if histogram.get(reserved) else {}
    index = packing.SumIndex(left)

    def possible(combination):
        return all(left[n] - taken.get(n, 0) >= k for n, k in Counter(combination).items())

    pairs = [(a, total - a) for a in range(1, total) if a >= total - a and possible((a, total - a))]
    triples = [(a, b, total - a - b) for a in range(1, total) for b in range(1, a + 1)
               if 1 <= total - a - b <= b and possible((a, b, total - a - b))]
    for _ in range(2):  # a second look finds the same
        assert index.pair(total, total, taken) == max(pairs, default=None)
        assert index.triple(total, taken) == max(triples, default=None)


def test_exact_complements_are_found():
    # Single, pair and triple complements: three full sequences.
    plan = packing.Plan({60: 1, 40: 1, 70: 1, 20: 1, 10: 1, 80: 1, 9: 1, 8: 1, 3: 1}, capacity=100)
    assert plan.sequences == 3
    assert packing.Plan({50: 7}, 100).sequences == 4
    assert packing.Plan({25: 8}, 100).sequences == 2
    assert packing.Plan({}, 100).sequences == 0
    assert packing.Plan({100: 5}, 100).sequences == 5


def test_pieces_bounds():
    assert packing.piece_bounds(1, 10) == [(0, 1)]
    assert packing.piece_bounds(10, 10) == [(0, 10)]
    assert packing.piece_bounds(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_op8_rows(spark):
    docs = documents(spark, extra=[(3, "x", None, None, 1, "", "", 0)])
    rows = packing.packed(docs, capacity=64).collect()
    n = check(rows, 64)
    total = 0
    for i, text in enumerate(TEXTS):
        ids = np.array(vocab.library(vocab.tokenizer_path(vocab.BYTE_BPE)).encode(
            text or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        if i == 3:  # the repeated row
            assert [r["piece"] for r in mine] == [0, 0]
            mine = mine[:1]
            total += len(ids)
        total += len(ids)
        assert [(r["start"], r["length"]) for r in mine] == packing.piece_bounds(len(ids), 64)
        assert [r["ids_crc32"] for r in mine] == [
            zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in mine]
    assert n <= -(-total // 64) + 1
    assert packing.packed(empty(spark)).count() == 0


def test_numbers_of_a_hot_length_are_dense(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_GROUP", 10)
    parts = written(spark.range(500).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 5 = 0, 7L, 9L) AS length", "1L AS ids_crc32"), "t8")
    rows = packing.numbered(parts, {7: 100, 9: 400}).collect()
    for length, n in ((7, 100), (9, 400)):
        assert sorted(r["number"] for r in rows if r["length"] == length) == list(range(n))
    check(packing.pack(parts, 16).collect(), 16)
