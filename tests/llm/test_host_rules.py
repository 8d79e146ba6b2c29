"""Operator 4 against a plain count."""

import re
from collections import Counter

from mandisight.llm import host_rules
from tests.llm.helpers import TEXTS, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    texts = [*TEXTS, "a b c a b c", "a a a a", "a b c d a b c", "#x *y $z", "one two", "l\n\nl\n \nl2\nl2"]
    docs = documents(spark, texts).drop("n_words", "kept")
    for r in host_rules.measured(docs).collect():
        assert tuple(r[m] for m in host_rules.MEASURES) == brute(texts[r.doc_id]), texts[r.doc_id]
        n = brute(texts[r.doc_id])
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good if ok else bad, None, host, 0, "", "", 0) for i, (host, ok) in enumerate(
        [("bad", False)] * 40 + [("bad", True)] * 4 + [("good", True)] * 60 + [("good", False)] * 2
        + [("tiny", False)] + [("tiny", True)] + [(None, True)] * 3 + [(None, False)])]
    docs = spark.createDataFrame(rows, documents(spark, []).schema)
    got = host_rules.judge(docs).collect()
    assert len(got) == len(rows)
    kept = Counter((r.source, r.kept) for r in got)
    assert kept["bad", True] == 0 and kept["good", True] == 60 and kept["good", False] == 2
    assert kept["tiny", True] == 1  # two documents do not condemn a host
    assert kept[None, True] == 3 and kept[None, False] == 1
    rates = {r.source: r.host_rate for r in got}
    assert rates["bad"] > 0.6 > rates["tiny"] > rates["good"] and rates[None] is None


def test_one_host_repeats_and_empty(spark):
    row = (1, "x", None, "h", 0, "", "", 0)
    got = host_rules.judge(spark.createDataFrame([row, row], documents(spark, []).schema)).collect()
    assert [(r.host_docs, r.host_failed, r.kept, r.score) for r in got] == [(2, 2, False, "")] * 2
    assert host_rules.judge(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = host_rules.measured(documents(spark)).select("n_words", "base_failed")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_with_the_names_of_helpers_are_carried_on(spark):
    docs = documents(spark).selectExpr("*", "1 as _hashes", "2 as _SORTED", "3 as _places", "4 as _hashes_", "'x' as kept_")
    out = host_rules.judge(docs)
    assert {(r["_hashes"], r["_SORTED"], r["_places"], r["_hashes_"], r["kept_"]) for r in out.collect()} == {(1, 2, 3, 4, "x")}
    assert sorted(out.columns) == sorted({*docs.columns, *host_rules.MEASURES, "base_failed", "kept", "host_docs",
                                          "host_failed", "host_rate"})
    plain = {(r.doc_id, *[r[m] for m in host_rules.MEASURES]) for r in host_rules.judge(documents(spark)).collect()}
    assert {(r.doc_id, *[r[m] for m in host_rules.MEASURES]) for r in out.collect()} == plain
