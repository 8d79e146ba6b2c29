"""The corpus pipeline against the operators' brute-force forms."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
import __spark_entry__
from mandisight.llm import lang_id
from mandisight.llm.common import fresh_path
from tests.conftest import SF0001
from tests.llm.helpers import SCHEMA, TEXTS, documents, empty, passage
from tests.llm.test_host_rules import brute as measures
from tests.llm.test_near_duplicates import brute as near


def staged(spark, docs, stage):
    path = fresh_path(spark, "t")
    dict(corpus_pipeline.STAGES)[stage](spark, docs, SF0001).write.parquet(path)
    return spark.read.parquet(path)


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = [r for r in docs.collect() if lang_id.has_letter(r.text)]
    first = {r.doc_id for r in staged(spark, docs, "language_id").collect()}
    assert first <= {r.doc_id for r in rows} and len(first) >= 0.97 * len(rows)
    rows = sorted((r for r in rows if r.doc_id in first), key=lambda r: r.doc_id)

    def passes(text):
        n = measures(text)
        return n[0] >= 50 and 100 * n[4] <= 50 * n[0]

    rows = [r for r in rows if passes(r.text)]  # no host of these tables is bad
    groups = near([r.text for r in rows])
    want = {rows[i].doc_id for i, (_, root) in groups.items() if root == i}
    got = corpus_pipeline.run(spark, SF0001).collect()
    assert {r.doc_id for r in got} == want
    assert all(r.offset + r.length <= 2048 for r in got)


def test_stages_keep_columns_and_awkward_rows(spark):
    clean = " ".join(passage(70))
    docs = documents(spark, [*TEXTS, clean, clean], [(15, clean, "en", "src0", 1, "mine", "mine", 7),
                                                     (None, clean, "en", None, 1, "mine", "mine", 7)])
    for stage, _ in corpus_pipeline.STAGES[:-1]:
        out = staged(spark, docs, stage)
        assert out.columns == docs.columns
        assert {r.score for r in out.collect()} <= {"mine"}
        assert staged(spark, empty(spark), stage).count() == 0
    quality = [r.doc_id for r in staged(spark, docs, "quality_rules").collect()]
    assert sorted(map(str, quality)) == ["15", "None"]  # both hosts fail mostly; these rows have none
    single = [r.doc_id for r in staged(spark, docs, "near_duplicates").collect()]
    assert single.count(15) == 1 and 16 not in single and None in single and len(single) == len(TEXTS) + 2
    assert staged(spark, empty(spark), "packing").count() == 0


def test_language_stage_without_labels_and_with_one_language(spark):
    texts = ["ein kurzer deutscher Satz " * 3, "another English text of words", None, "123 456", ""]
    for lang, kept in ((None, [0, 1, 2, 3, 4]), ("de", [0, 1])):
        docs = documents(spark, texts * 12).withColumn("lang", F.lit(lang).cast("string"))
        ids = [r.doc_id % 5 for r in staged(spark, docs, "language_id").collect()]
        assert sorted(set(ids)) == kept and len(ids) == 12 * len(kept)


def test_language_stage_equals_plain_predictions(spark):
    """The stage keeps what the model, applied to each text alone, scores at its floor or above."""
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    model = lang_id.train(docs.where(~lang_id.held_out()).select("text", "lang"))
    want = set()
    for r in docs.collect():
        (pred,), (score,) = model.predict([r.text])
        if pred != lang_id.UNDETERMINED and score >= model.floor:
            want.add(r.doc_id)
    assert {r.doc_id for r in staged(spark, docs, "language_id").collect()} == want


def test_clashing_columns_are_carried_on(spark):
    clean = " ".join(passage(70))
    docs = documents(spark, [clean, clean + " more", "other " + clean]).selectExpr(
        "*", "1 as _key", "2 as _row", "3 as _judged", "4 as lang_pred", "5 as _hashes", "6 as key", "7 as _text")
    for stage, _ in corpus_pipeline.STAGES[:-1]:
        out = staged(spark, docs, stage)
        assert out.columns == docs.columns
        assert all((r["_key"], r["_row"], r["_judged"], r["lang_pred"], r["_hashes"]) == (1, 2, 3, 4, 5) for r in out.collect())


def test_registration():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and SCHEMA
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "packing"]
