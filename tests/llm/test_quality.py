import numpy as np
import pyarrow as pa
import pytest

from modlens.llm import quality
from modlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = QUERIES["op11_quality"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    rows = scored.where("held_out AND quality IS NOT NULL").collect()
    good, bad = ([r for r in rows if r.quality == k] for k in (1, 0))
    ahead = sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad)
    assert len(bad) > 50 and ahead / (len(good) * len(bad)) > 0.99
    assert sum(r.predicted for r in good) > 0.98 * len(good)
    assert sum(r.predicted for r in bad) < 0.05 * len(bad)


def test_linear_time_equals_all_pairs():
    mixed = np.random.default_rng(1)
    model = quality.Model(0.3, np.zeros((0, 0)), mixed.normal(size=50), mixed.normal(size=(50, quality.RANK)))
    for n in (0, 1, 2, 20):
        f, x = mixed.permutation(50)[:n], mixed.normal(size=n)
        plain = 0.3 + sum(x[i] * model.weights[f[i]] for i in range(n))
        plain += sum(x[i] * x[j] * model.factors[f[i]] @ model.factors[f[j]] for i in range(n) for j in range(i))
        assert quality.margin(model, f, x) == pytest.approx(plain)


def test_interactions_are_learned():
    """Neither statistic tells alone, both together do; no word does."""
    mixed = np.random.default_rng(2)
    rows = []
    for _ in range(1200):
        a, b = mixed.integers(0, 2, 2)
        statistics = np.zeros(len(quality.STATISTICS))
        statistics[0], statistics[1] = a + mixed.uniform(0, 0.4), b + mixed.uniform(0, 0.4)
        rows.append((np.zeros(0, dtype=np.int64), np.zeros(0), statistics, np.zeros(0, dtype=np.int64), int(a ^ b), 1.0))
    model = quality.fit(rows[:900], 0, 0.5)
    right = [(quality.margin(model, *quality.assemble(model.edges, *r[:4])) > 0) == r[4] for r in rows[900:]]
    assert np.mean(right) > 0.95


def test_odd_texts_and_labels(spark, docs):
    texts = [None, "", " ", "x", "word " * 100_000, "y" * 300_000, "İ" * 50, "\n\n\n"] + [f"Plain text number {k}, one of many." for k in range(40)]
    texts += [f"BUY!! NOW!! {k % 7} $$$ BUY!! NOW!!" for k in range(40)]
    frame = docs(list(enumerate(texts))).withColumnRenamed("source", "score").withColumnRenamed("lang", "__text")
    labels = spark.createDataFrame([(k, int("BUY" not in (t or ""))) for k, t in enumerate(texts)] + [(3, None), (None, 1)], "doc_id long, quality int")
    for known in (labels, labels.where("quality = 0"), labels.limit(0)):
        model = quality.train(frame, known, metadata=("n_chars", "__text"))
        done = quality.quality_scores(frame, model, metadata=("n_chars", "__text"))
        assert done.columns == ["doc_id", "text", "__text", "n_chars", "score"]
        scores = {r.doc_id: r.score for r in done.collect()}
        assert len(scores) == len(texts) and all(0 <= s <= 1 for s in scores.values())
        if known is labels:
            assert min(scores[k] for k in range(8, 48)) > max(scores[k] for k in range(48, 88))
    assert all(s == pytest.approx(1e-6, rel=1e-3) for s in scores.values())
    assert quality.quality_scores(frame.limit(0), model, metadata=("n_chars", "__text")).collect() == []


def test_repeated_ids_stay_within_the_bound(spark, docs):
    frame = docs([(1, f"text {k}") for k in range(50)] + [(2, "BAD!!")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(frame, labels, sample_rows=3)
    assert model.weights.any() == False  # noqa: E712  an id with a 0 among its labels is of label 0


def test_metadata_buckets():
    numbers = quality.meta_buckets(pa.array([None, 0, 1, 2**40, -5, 7]))
    assert numbers[0] == 0 and len(set(numbers.tolist())) == 6 and numbers.max() < quality.META_BUCKETS
    floats = quality.meta_buckets(pa.array([float("nan"), float("inf"), -float("inf"), None]))
    assert floats.max() < quality.META_BUCKETS
    words = quality.meta_buckets(pa.array(["a", "b", None, "a"]))
    assert words[0] == words[3] != words[1] and words[2] == 0
