import random

import corpus_pipeline
from keystrata.llm import mixing, quality_crf
from keystrata.llm.common import table

from ..conftest import SMALL
from .conftest import random_words
from .test_ngram_join import brute as components
from .test_suffix_dedup import brute as repeats
from .test_text_scans import windows_brute


def test_stages_on_a_small_corpus(spark):
    """Every stage on what its predecessor kept, against brute force, or the operator's own scores for quality."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL).cache()
        assert out.columns == columns
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality":  # whose scores and held-out accuracy are tested on their own
            scores = {r.doc_id: r.score for r in quality_crf.quality_scores(docs, table(spark, SMALL, "labels")).collect()}
            assert after == {k: t for k, t in before.items() if scores[k] >= quality_crf.GOOD_FROM} and 0 < len(after) < len(before)
        elif name == "ngram_jaccard":
            assert set(after) == {c for _, _, c in components(list(before.items()))}
            assert all(before[k] == t for k, t in after.items())
        elif name == "suffix_dedup":
            n = {d: b - gone for d, b, gone, _, _ in repeats(list(before.items()))}
            assert set(after) == set(before) and all(len(after[k].encode()) <= n[k] for k in n)
            assert all(n[k] - len(after[k].encode()) < 30 for k in n)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            clean = {r[0] for r in windows_brute(list(before.items()), items) if not r[5]}
            assert clean <= set(after) and all(after[k] == before[k] for k in clean)
            assert not any(r[5] for r in windows_brute(list(after.items()), items))
        docs = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    want = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect() if r.taken}
    assert {r.doc_id: r.taken for r in mixed} == want
    assert all(r.copies * r["size"] == r.taken for r in mixed)


def test_run_on_edge_rows(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", random_words(rng, 50), random_words(rng, 50), "!" * 500] * 2
    rows = [(k if k % 3 else None, t, None, None, None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "taken" in out.columns
