import collections

import corpus_pipeline
from brute import WORD, components, taken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modlens.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
        if name != "bpe":
            assert docs.columns == columns
    raw, clean, single, apart, mixed, coded = seen
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in raw} - {r.doc_id for r in clean}
    assert len(gone & toxic) > 0.6 * len(toxic)
    last = {}
    for r in clean:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in single) == sorted(last.values())
    found = components([(r.doc_id, r.text) for r in single])
    assert sorted(r.doc_id for r in apart) == sorted(k for k, (_, c) in found.items() if k == c)
    copies = {i: 1 if not n else int(w / n + 0.5) for i, n, _, _, w in taken([(r.doc_id, r.text, r.source) for r in apart])}
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter({k: n for k, n in copies.items() if n})
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    text = {r.doc_id: r.text or "" for r in apart}
    assert collections.Counter(r.doc_id for r in coded) == collections.Counter(r.doc_id for r in mixed)
    assert all(r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids for r in coded)


def test_odd_documents(spark, docs, tmp_path):
    """Nulls, repeated rows and rows of one id pass all stages."""
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (1, "quite another text of seven words", None), (None, None, None), (2, "", "t"), (2, "", "t"), (3, "a b c d e f g", "u")]
    for k, frame in enumerate((docs(rows), docs([]))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SMALL).write.parquet(str(tmp_path / f"{k}-{name}"))
            frame = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            if name == "near_dedup" and not k:
                assert sorted(((r.doc_id, r.text) for r in frame.collect()), key=str) == sorted([(3, "a b c d e f g"), (1, rows[2][1]), (2, "")], key=str)
        assert (frame.count() > 0) == (not k)


def test_columns_of_any_name_pass(spark, docs, tmp_path):
    """Extra columns keep their values, also those named like what the stages add for themselves."""
    names = ["__key", "__first", "__toxicity", "__row", "__copies", "__rows", "__own", "__copy", "row", "key", "score"]
    rows = [(k, f"document number {k} has some words of its own {k * 7}", f"s{k % 2}") for k in range(12)]
    frame = docs(rows)
    for name in names:
        frame = frame.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, frame, SMALL).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert set(frame.columns) == {"doc_id", "text", "lang", "source", "n_chars", *names}
        assert all(r[n] == f"{n} of {r.doc_id}" for r in frame.collect() for n in names), name
    assert {r.doc_id for r in frame.collect()} <= set(range(12)) and frame.count()  # the mix takes some not at all


def test_run_keeps_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    done = corpus_pipeline.run(spark, SMALL)
    assert done.count() > 0
    assert [p.name for p in (tmp_path / "pipeline").iterdir()] == ["4-bpe"]


def test_words_pattern():
    assert WORD.findall(" a b\x0bc ") == ["a b", "c"]
