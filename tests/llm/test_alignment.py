"""Operator 11 against a token by token alignment."""

import collections
import functools
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mandisight.llm import token_alignment, vocab
from tests.llm.helpers import TEXTS, documents, empty

A, B = token_alignment.paths(None, None)
MORE = ["a▁b", "<s>hi</s> <0x0A> <unk>", "  two  spaces ", " one", "a\r\nb}\rc", "\x00\x01", "　wide", "ﬁ ﬂ Ａ", "🙂 é"]


BYTES_A, BYTES_B = vocab.token_bytes(A), token_alignment.piece_bytes(B)


@functools.cache
def library():
    tok = Tokenizer.from_file(A)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    return tok


def plain_tokens(text):
    """(A ids, B ids), both empty where the joined bytes are not a space and the text."""
    if not text:
        return [], []
    tok = library()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, token_alignment.piece_model(B).encode(text)
    wanted = (" " + text).encode()
    whole = b"".join(BYTES_A[i] for i in a) == wanted and b"".join(BYTES_B[i] for i in b) == wanted
    return (a, b) if whole else ([], [])


def plain_alignment(text):
    a, b = plain_tokens(text)
    ends_a = np.cumsum([len(BYTES_A[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(BYTES_B[i]) for i in b]).tolist()
    at_a, at_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
    cuts = sorted(set(ends_a) & set(ends_b))
    groups = []
    for start, stop in zip([0, *cuts], cuts):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if start < e <= stop)
                               for ids, ends in ((a, ends_a), (b, ends_b))))
    return a, b, [(at_a[c], at_b[c]) for c in cuts], ";".join(groups)


def check(texts):
    al = token_alignment.aligner(A, B).align(texts)
    for k, text in enumerate(texts):
        a, b, links, groups = plain_alignment(text)
        rows = slice(al.cuts_g[k], al.cuts_g[k + 1])
        assert al.a[al.cuts_a[k]:al.cuts_a[k + 1]].tolist() == a
        assert al.b[al.cuts_b[k]:al.cuts_b[k + 1]].tolist() == b
        assert list(zip(al.a[al.close_a[rows]].tolist(), al.b[al.close_b[rows]].tolist())) == links
        assert al.groups[k] == groups


def test_batch_equals_plain_alignment():
    check(TEXTS + MORE)
    check([])
    check([None, ""])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t▁ab"))), max_size=5))
def test_any_text(texts):
    check(texts)


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 20])
def test_stretches_change_nothing(stretch):
    rng = np.random.default_rng(stretch)
    ends, cuts = [[], []], [[0], [0]]
    for _ in range(20):
        total = int(rng.integers(1, 400))
        for k in range(2):
            own = np.union1d(rng.integers(1, total + 1, int(rng.integers(0, 60))), [total])
            ends[k] += own.tolist()
            cuts[k].append(len(ends[k]))
    i, j = token_alignment.lockstep(*(np.array(x, np.int64) for x in (ends[0], cuts[0], ends[1], cuts[1])), stretch)
    wanted = [(x, y) for t in range(20) for x in range(cuts[0][t], cuts[0][t + 1]) for y in range(cuts[1][t], cuts[1][t + 1])
              if ends[0][x] == ends[1][y]]
    assert list(zip(i.tolist(), j.tolist())) == wanted


def test_pair_table_holds_every_pair_that_can_end_together():
    a, b = [b"x", b"ab", b"cab", b"", b"ab"], [b"", b"b", b"ab", b"zcab", b"q"]
    pairs = token_alignment.PairTable(a, b)
    assert list(zip(pairs.a.tolist(), pairs.b.tolist())) == [
        (1, 1), (2, 1), (4, 1), (1, 2), (2, 2), (4, 2), (1, 3), (2, 3), (4, 3)]
    assert pairs.number(np.array([4, 1]), np.array([2, 1])).tolist() == [5, 0]
    assert pairs.best(np.array([1, 2, 2, 0, 0, 5, 1, 0, 0])).tolist() == [
        False, True, True, False, False, True, True, False, False]
    assert len(token_alignment.pair_table(A, B)) < 1_000_000


def test_op11_rows(spark):
    docs = documents(spark, TEXTS + MORE, extra=[(3, "x", "en", None, 1, "a", "b", 1), (None, "It's 12", None, None, 0, "", "", 0)])
    texts = {i: t for i, t in enumerate(TEXTS + MORE)} | {None: "It's 12"}
    found = token_alignment.with_counts(token_alignment.alignments(docs, keep_groups=True)).collect()
    assert len(found) == len(texts) + 1
    count = collections.Counter(p for r in found for p in plain_alignment(texts[r.doc_id])[2])
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    for r in found:
        a, b, links, groups = plain_alignment(texts[r.doc_id])
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(links), len(links))
        assert r.count_sum == sum(count[p] for p in links)
        assert r.n_best == sum(count[p] == top[p[1]] for p in links)
        assert r.groups == groups
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if a else "")
    assert token_alignment.with_counts(token_alignment.alignments(empty(spark))).count() == 0
