"""The pipeline's stages: each acts on all it is given, keeps the columns, and leaves clean documents alone."""
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from fieldrounds.llm import common, decontaminate, jaccard, mixing, quality, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "mix"]


def test_run_equals_its_stages_one_by_one(spark):
    docs = common.table(spark, SMALL, "documents").cache()
    columns = docs.columns
    held = docs
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_table(docs, quality.fit(docs, common.table(spark, SMALL, "labels"))).collect()}
    held = held.where(F.col("doc_id").isin([d for d, p in scores.items() if p == 1]))
    classes = {r["doc_id"]: r["class_id"] for r in jaccard.classes(held).collect()}
    held = held.where(F.col("doc_id").isin([d for d, c in classes.items() if d == c]))
    bad = [r["doc_id"] for r in decontaminate.contaminated(held, common.table(spark, SMALL, "benchmark")).collect()]
    assert bad
    held = held.where(~F.col("doc_id").isin(bad))
    want_ids = {r["doc_id"] for r in held.select("doc_id").collect()}
    texts = {}
    for r in held.collect():
        t = r["text"]
        for m in reversed(list(re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""", t))):
            t = t[:m.start()] + "[secret]" + t[m.end():]
        texts[r["doc_id"]] = t
    changed = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").join(held.select("doc_id", "source"), "doc_id")
    copies = {r["doc_id"]: (r["copies"], r["taken"]) for r in mixing.mix(changed).collect()}
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == [*columns, "copies", "taken"]
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {i for i, (c, _) in copies.items() if c > 0} <= want_ids
    for r in rows:
        assert r["text"] == texts[r["doc_id"]] and (r["copies"], r["taken"]) == copies[r["doc_id"]] and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("empty", [False, True])
def test_each_stage_on_odd_rows(spark, empty):
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here and there again", "en", "a", 31), (3, "same words here and there again", "en", "a", 31),
            (None, "token = abcdefgh1234", None, None, 20), (5, "w " * 40_000, "en", "b", 80_000)]
    docs = spark.createDataFrame([] if empty else data, DOCS).withColumns({c: F.lit(1) for c in ("copies_", "blob", "size", "score", "_source", "_blob", "set_key")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert out.count() <= docs.count()
        assert out.count() > 0 or empty or name in ("quality", "mix"), name


def test_secrets_stage_changes_only_texts_with_secrets(spark):
    docs = common.table(spark, SMALL, "documents")
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, secrets.redact(docs, secrets.scanned(docs))))
    assert before.keys() == after.keys()
    assert {i for i in before if before[i] != after[i]} == {r["doc_id"] for r in secrets.report(docs, secrets.scanned(docs)).where("spans <> ''").collect()}
