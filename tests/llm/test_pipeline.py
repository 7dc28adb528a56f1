from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.edge import edge_docs, empty_docs, prose


def test_stages_chain_and_keep_columns(spark, tmp_path):
    docs = edge_docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    stage = docs
    for _, run in corpus_pipeline.STAGES[:-1]:
        stage = run(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids == Counter(r.doc_id for r in stage.collect())
    assert not {4, 5, 6, 7, 12} & set(ids)  # without a letter
    assert {8, 9} - set(ids) and max(ids.values()) <= 2


def test_an_empty_table_passes_all_stages(spark):
    stage = empty_docs(spark)
    for _, run in corpus_pipeline.STAGES:
        stage = run(spark, stage, "")
    assert stage.count() == 0


def test_near_copies_without_ids_leave_one_document(spark):
    """One of each component stays: the one with an id, else one of those without."""
    def copies(seed, n):
        words = prose(seed, 80).split()
        return [" ".join(words[:20 + i] + [f"changed{i}"] + words[21 + i:]) for i in range(n)]

    named, unnamed = copies(1, 6), copies(2, 5)
    rows = [(7 if i == 3 else None, t) for i, t in enumerate(named)] + [(None, t) for t in unnamed]
    rows += [(None, "alone and short"), (None, None), (None, " "), (9, prose(3, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, group int")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, "").collect()]
    assert Counter(i for i, _ in got) == {7: 1, 9: 1, None: 4}
    assert (7, named[3]) in got and sum(t in unnamed for _, t in got) == 1 and sum(t in named for _, t in got) == 1
    assert {None, " ", "alone and short"} <= {t for _, t in got}
