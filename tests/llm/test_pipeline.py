"""The pipeline against plain versions of what each stage decides."""

import corpus_pipeline
from terrace.llm import decontaminate, near_dedup, pii, quality
from tests.llm.helpers import ODD


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["quality classifier", "MinHash near-dedup"] and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stage(spark, before, sf_dir).persist()
        assert after.columns == columns, name
        kept = {r.doc_id for r in after.collect()}
        everything = {r.doc_id: r.text for r in before.collect()}
        if k == 0:
            model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert kept == {r.doc_id for r in quality.scored(before, model).where("predicted = 1").collect()} and kept < set(everything)
        elif k == 1:
            from tests.llm.test_near_dedup import brute

            how = near_dedup.NearDedup()
            assert (how.shingle, how.similarity) == (5, 80)
            assert kept == {d for d, _, c in brute(list(everything.items()), how) if d == c}
        elif k == 2:
            from tests.llm.test_decontaminate import brute as hits

            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert kept == {h[0] for h in hits(list(everything.items()), items) if not h[2]}
        else:
            clean = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
            for d, t in everything.items():
                expected = pii.redacted(t, pii.all_spans(t, pii.model())[1])
                assert clean[d] == (expected, len(expected))
        before = after
    packed = corpus_pipeline.STAGES[4][1](spark, before, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept


def test_odd_documents_go_through(spark, sf_dir):
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, key string")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, rows, sf_dir)
            assert out.columns == docs.columns and out.schema == docs.schema
            out.collect()
        assert corpus_pipeline.STAGES[4][1](spark, rows, sf_dir).count() >= rows.count()
    copies = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in copies if r.doc_id is not None) == [1, 3, 4, 5, 7, 8, 9, 10] and len(copies) == 10
    assert decontaminate.contamination(docs, docs.select(docs.doc_id.alias("item_id"), "text")).where("contaminated").count() == 7


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(found.columns)
