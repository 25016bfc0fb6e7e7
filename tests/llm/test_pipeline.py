"""The pipeline's stages: which rows stay, and what they return."""

import collections

import corpus_pipeline
import numpy as np
from gridloom.llm import containment, pii

from test_texts import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    one = corpus_pipeline.language_id(spark, docs, SF).cache()
    assert one.columns == columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert kept == {d: t for d, t in before.items() if t and any(map(str.isalpha, t))}
    two = corpus_pipeline.near_duplicates(spark, one, SF).cache()
    comps = brute_components(list(kept.items()))
    assert {r.doc_id for r in two.collect()} == {c for _, _, c in comps} and two.columns == columns
    three = corpus_pipeline.decontamination(spark, two, SF).cache()
    dirty = {r.doc_id for r in containment.contained_items(two, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - dirty and three.columns == columns
    four = corpus_pipeline.personal_data(spark, three, SF).cache()
    assert four.columns == columns and four.count() == three.count()
    for r in four.collect():
        assert not pii.rule_spans(r.text) and r.n_chars == len(r.text)
    last = corpus_pipeline.pieces(spark, four, SF)
    texts = {r.doc_id: r.text for r in four.collect()}
    assert last.count() == len(texts)
    for r in last.collect():
        raw = texts[r.doc_id].encode()
        a, b = np.frombuffer(r.piece_starts, "<u4"), np.frombuffer(r.piece_ends, "<u4")
        assert len(r.piece_ids) == 4 * r.n_tokens == 4 * len(a) and b"".join(raw[x:y] for x, y in zip(a, b)) == raw
    run = corpus_pipeline.run(spark, SF)
    assert collections.Counter(map(tuple, run.collect())) == collections.Counter(map(tuple, last.collect()))


def test_stages_on_hard_rows(spark):
    """Null, empty and repeated rows through every stage; an empty table."""
    text = " ".join(f"the people of nation{i} are here" for i in range(12))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (3, "", "en", None, 0), (None, text + " more", "en", "s", 9), (4, "12 34", "en", "s", 5), (5, "write to a.b@c.de", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 1, 5] or sorted(r.doc_id or 0 for r in one.collect()) == []
    two = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id or 0 for r in two.collect()) == [0, 1, 2, 3, 4, 5]
    assert corpus_pipeline.decontamination(spark, docs, SF).count() == len(rows)
    four = corpus_pipeline.personal_data(spark, docs, SF)
    assert four.count() == len(rows) and {r.doc_id: (r.text, r.n_chars) for r in four.collect()}[5] == ("write to [EMAIL]", 16)
    assert corpus_pipeline.pieces(spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
