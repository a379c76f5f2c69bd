"""The pipeline's stages, each against what its operator says of its own input."""

import corpus_pipeline as C
from inspectra.llm.common import written
from inspectra.llm.toxicity import THRESHOLD, score, train
from tests.llm.test_line_edit_join import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == list(C.COLUMNS)
    texts = {k: {r["doc_id"]: r["text"] for r in v.collect()} for k, v in seen.items() if k != "packing"}
    model = train(seen["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = {r["doc_id"] for r in score(seen["documents"], model).where(f"_toxicity >= {THRESHOLD}").collect()}
    assert toxic and set(texts["toxicity"]) == set(texts["documents"]) - toxic
    some = dict(list(texts["toxicity"].items())[:60])
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").selectExpr("*", "'' lang", "'' source", "0L n_chars")
    want, _ = brute(spark, list(some.items()))
    assert {r["doc_id"]: r["text"] for r in C.line_dedup(spark, df, sf_dir).collect()} == {d: x for (d, _), x in want.items()}
    assert set(texts["line_dedup"]) == set(texts["toxicity"])
    assert set(texts["near_dedup"]) < set(texts["line_dedup"])
    assert all(texts["secret_scan"][d] == t or "[SECRET]" in texts["secret_scan"][d] for d, t in texts["near_dedup"].items())
    assert {r["doc_id"] for r in seen["packing"].collect()} == set(texts["secret_scan"])
    empty = seen["documents"].limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
