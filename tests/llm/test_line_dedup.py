"""Operator 12 against a plain count of lines, and the perfect hash by itself."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from mandisight.llm import line_dedup
from tests.llm.helpers import TEXTS, documents, empty

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def plain(texts, min_docs, min_chars):
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def random_hashes(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    h1, h2 = random_hashes(n)
    places = line_dedup.PerfectHash.build(h1, h2)
    assert sorted(places.find(h1, h2).tolist()) == list(range(n))


def test_equal_first_halves_still_part():
    _, h2 = random_hashes(500)
    h1 = np.full(500, 7, np.uint64)
    assert sorted(line_dedup.PerfectHash.build(h1, h2).find(h1, h2).tolist()) == list(range(500))


def test_shard_file_round_trip_and_absent_hashes(tmp_path):
    h1, h2 = random_hashes(3000)
    counts = np.arange(3000) + 1
    counts[5] = 2**40
    line_dedup.LineShard.build(h1, h2, counts).write(str(tmp_path / "s.lines"))
    shard = line_dedup.LineShard.read(str(tmp_path / "s.lines"))
    assert shard.count(h1, h2).tolist() == np.minimum(counts, 2**32 - 1).tolist()
    other1, other2 = random_hashes(3000, seed=1)
    assert not shard.count(other1, other2).any()
    assert not shard.count(h1, other2).any()
    bits = sum(len(x) for x in shard.places.levels) * 64
    assert bits < 6 * 3000
    (tmp_path / "bad").write_bytes(b"nothing here")
    with pytest.raises(ValueError):
        line_dedup.LineShard.read(str(tmp_path / "bad"))


LINES = ["Shared Line", "  shared line\t", "rare", "", "   ", "ÉTÉ", "été", "two\r", "Two", "x" * 3000, "a\x0b", "\x1cz"]


@pytest.mark.parametrize("min_docs,min_chars,keys_per_shard", [(2, 1, 3), (3, 1, 1 << 20), (2, 4, 1), (1, 1, 2), (2, 0, 5)])
def test_drop_lines_equals_plain_count(spark, min_docs, min_chars, keys_per_shard):
    rng = np.random.default_rng(min_docs)
    texts = TEXTS + ["\n".join(rng.choice(LINES, int(rng.integers(1, 8)))) for _ in range(60)]
    docs = documents(spark, texts)
    index = line_dedup.build_index(docs, min_docs, min_chars, keys_per_shard)
    rows = {r.doc_id: r for r in line_dedup.drop_lines(docs, index, min_docs, min_chars).collect()}
    for i, wanted in enumerate(plain(texts, min_docs, min_chars)):
        assert (rows[i].n_lines, rows[i].n_dropped, rows[i].text) == wanted
    if keys_per_shard < 3:
        assert index.count() > 1


def test_index_serves_higher_thresholds(spark):
    texts = ["a\nb", "a\nc", "a\nb"]
    docs = documents(spark, texts)
    index = line_dedup.build_index(docs, least=2)
    assert [r.text for r in line_dedup.drop_lines(docs, index, 3).orderBy("doc_id").collect()] == ["b", "c", "b"]


def test_repeats_null_ids_empty_table_and_query(spark, tmp_path):
    docs = documents(spark, ["s\nown"] * 5, extra=[(None, "S \n\nmine", None, None, 0, "", "", 0)] * 5)
    rows = line_dedup.drop_lines(docs, line_dedup.build_index(docs)).collect()
    assert sorted(((r.doc_id is None), r.n_lines, r.n_dropped, r.text) for r in rows) == \
        [(False, 2, 1, "own")] * 5 + [(True, 3, 1, "\nmine")] * 5
    none = empty(spark)
    index = line_dedup.build_index(none)
    assert index.count() == 0 and line_dedup.drop_lines(none, index).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    digests = {r.kept_sha256 for r in line_dedup.op12_line_dedup(spark, str(tmp_path)).collect()}
    assert digests == {hashlib.sha256(x).hexdigest() for x in (b"own", b"\nmine")}
