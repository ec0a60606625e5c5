"""The pipeline: each stage against what its operator says, and the clash with odd rows."""

from collections import Counter

import corpus_pipeline as pipeline
from tallyfield.llm import toxicity
from tallyfield.llm.decontaminate import contaminated
from tallyfield.llm.mixing import mix_plan
from tallyfield.llm.near_dedup import near_duplicates


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    steps = dict(pipeline.STAGES)

    one = steps["toxicity"](spark, docs, sf).persist()
    bad = toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("predicted = 1")
    assert one.columns == docs.columns and ids(one) == sorted(set(ids(docs)) - set(ids(bad)))

    two = steps["near_dedup"](spark, one, sf).persist()
    assert two.columns == docs.columns and ids(two) == sorted({r.class_id for r in near_duplicates(one).collect()})

    three = steps["decontamination"](spark, two, sf).persist()
    assert three.columns == docs.columns and ids(three) == sorted(set(ids(two)) - {r.doc_id for r in contaminated(two, bench).collect()})

    four = steps["mixing"](spark, three, sf).persist()
    assert four.columns == docs.columns
    assert Counter(ids(four)) == {r.doc_id: r.copies for r in mix_plan(three).collect() if r.copies}

    five = steps["token_ids"](spark, four, sf).collect()
    assert Counter(r.doc_id for r in five) == Counter(ids(four))
    assert sorted(pipeline.run(spark, sf).collect()) == sorted(five)


def test_stages_take_odd_and_empty_rows(spark, sf, odd, empty):
    out = odd
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, out, sf)
        kept[name] = out.count()
        assert name == "token_ids" or out.columns == odd.columns
    # of ten rows two are copies and two are empty, of which one of each stays
    assert (kept["toxicity"], kept["near_dedup"], kept["decontamination"]) == (10, 8 - 1, 7)
    assert kept["token_ids"] == kept["mixing"]
    assert out.where("n_tokens = 1").count() <= 2
    out = empty
    for _, stage in pipeline.STAGES:
        out = stage(spark, out, sf)
        assert out.count() == 0
