"""Operators 6 and 7 against the tokenizers library, and exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mandisight.llm import bpe_rank, token_planes, vocab
from mandisight.llm.common import fresh_path
from tests.llm.helpers import TEXTS, documents, empty

BYTE, WORD = vocab.tokenizer_path(vocab.BYTE_BPE), vocab.tokenizer_path(vocab.WORD_BPE)


def split(flat, counts):
    return [list(map(int, x)) for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else []


def wanted(path, texts):
    return [vocab.library(path).encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path,words", [(BYTE, False), (WORD, True)])
def test_cached_encoder_equals_library(path, words):
    assert split(*vocab.library_encoder(path, words)(TEXTS)) == wanted(path, TEXTS)


def test_rank_array_equals_library_and_decodes():
    bpe = bpe_rank.RankArrayBpe(BYTE)
    flat, counts = bpe.encode(TEXTS)
    ids = wanted(BYTE, TEXTS)
    assert split(flat, counts) == ids
    assert bpe.decode(flat, counts) == [vocab.library(BYTE).decode(x, skip_special_tokens=False) for x in ids]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=6))
def test_any_text_equals_library(texts):
    assert split(*bpe_rank.encoder(BYTE).encode(texts)) == wanted(BYTE, texts)
    assert split(*vocab.library_encoder(WORD, True)(texts)) == wanted(WORD, texts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aábcdeinost ", min_size=33, max_size=120))
def test_long_words_merge_like_the_library(text):
    word = text.replace(" ", "")
    assert split(*bpe_rank.encoder(BYTE).encode([word])) == wanted(BYTE, [word])


def test_cache_that_starts_afresh_keeps_results():
    bpe = bpe_rank.RankArrayBpe(BYTE)
    bpe.cache.limit = bpe.pieces.limit = 3
    for _ in range(3):
        assert split(*bpe.encode(TEXTS)) == wanted(BYTE, TEXTS)


def test_op7_rows(spark):
    docs = documents(spark, extra=[(3, "x", "en", None, 1, "a", "b", 1)])  # a repeated row
    rows = bpe_rank.encode_decode(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ids = vocab.library(BYTE).encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = vocab.library(BYTE).decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_rank.encode_decode(empty(spark)).count() == 0
    kept = bpe_rank.encode_decode(docs, keep_ids=True).where("doc_id = 4").first()
    assert kept.decoded == "..." and len(kept.ids) == kept.n_tokens


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 49408, n).astype("<u4")
    planes = token_planes.to_planes(ids, kind)
    assert (token_planes.from_planes(planes, n, kind) == ids).all()
    assert len(planes) <= (2 if kind == "byte" else 16)


def test_planes_of_wide_ids():
    ids = np.array([0, 2**32 - 1, 5], "<u4")
    for kind in ("bit", "byte"):
        assert (token_planes.from_planes(token_planes.to_planes(ids, kind), 3, kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_op6_round_trip(spark, kind):
    docs = documents(spark)
    manifest = token_planes.write_shards(docs, fresh_path(spark, "t6"), kind=kind, block=64, unit=200)
    rows = {r.doc_id: r for r in token_planes.read_units(manifest, keep_ids=True).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = vocab.library(WORD).encode(text or "", add_special_tokens=False).ids + [token_planes.END_ID]
        r = rows[i]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert manifest.count() > 1


def test_op6_repeats_null_ids_and_empty(spark):
    docs = documents(spark, ["b", "a"], [(None, "c", None, None, 1, "", "", 0), (0, "b", None, None, 1, "", "", 0)])
    rows = token_planes.read_units(token_planes.write_shards(docs, fresh_path(spark, "t6"))).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.start) for r in rows if r.doc_id is not None) == [
        (False, 0, 2), (False, 0, 4), (False, 1, 6)]
    none = token_planes.write_shards(empty(spark), fresh_path(spark, "t6"))
    assert token_planes.read_units(none).count() == 0


def test_damaged_block_is_refused(tmp_path):
    w = token_planes.ShardWriter(str(tmp_path / "s.tid"))
    w.add(1, np.arange(100, dtype="<u4"))
    w.chunks_before = list(w.chunks)
    w.close()
    r = token_planes.ShardReader(str(tmp_path / "s.tid"))
    r.chunks[0][2] ^= 1
    with pytest.raises(ValueError):
        r.chunk(0)
