from modlens.llm import toxicity
from modlens.llm.queries import QUERIES, held_out

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = QUERIES["op4_toxicity"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    rows = scored.where("held_out AND toxic IS NOT NULL").collect()
    marked, clean = ([r for r in rows if r.toxic == k] for k in (1, 0))
    ahead = sum((m.score > c.score) + (m.score == c.score) / 2 for m in marked for c in clean)
    assert ahead / (len(marked) * len(clean)) > 0.95
    assert sum(r.predicted for r in marked) > 0.8 * len(marked)
    assert sum(r.predicted for r in clean) < 0.03 * len(clean)


def test_odd_texts_and_labels(spark, docs):
    texts = [None, "", "x", "word " * 100_000, "y" * 300_000] + [f"plain text number {k} of many" for k in range(40)]
    texts += [f"plain text number {k} with nasty{k % 7} words" for k in range(40)]
    frame = docs(list(enumerate(texts))).withColumnRenamed("source", "score").withColumnRenamed("lang", "__text")
    labels = spark.createDataFrame([(k, int("nasty" in (t or ""))) for k, t in enumerate(texts)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.where("toxic = 0"), labels.limit(0)):
        model = toxicity.train(frame, known)
        done = toxicity.toxicity_scores(frame, model)
        assert done.columns == ["doc_id", "text", "__text", "n_chars", "score"]
        assert all(0 <= r.score <= 1 for r in done.collect()) and done.count() == len(texts)
    assert toxicity.toxicity_scores(frame.limit(0), model).collect() == []
    assert [r.x for r in spark.createDataFrame([(None,)], "doc_id long").select(held_out().alias("x")).collect()] == [False]
