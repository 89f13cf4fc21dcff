"""The registered queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.llm import alignment, bpe, chat, exact, lines, mixing, ngram_join, quality, records, search, token_counts, toxicity, trie
from modlens.session import shared_folder, ship_package

#: The end-of-document id that op3 appends.
END_ID = 0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; it is the same on all nodes."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.bpe_round_trip(table(spark, folder, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.document_sizes(table(spark, folder, "documents"))
    targets = mixing.source_targets(sizes)
    return mixing.taken_words(sizes, targets, mixing.mix(sizes, targets)).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_records(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "token-records")
    index = records.write_token_records(table(spark, folder, "documents"), out, vocabulary("byte_bpe_50k.json"), END_ID)
    return records.read_token_records(index, out, with_ids=False)


#: Rows with this remainder are held out from training.
FOLDS, HELD_OUT = 4, 2
TOXIC_FROM = 0.3


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels").where(~held_out()))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"))


CHAT_TEST = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tests = spark.createDataFrame([(-7, 0, "user", CHAT_TEST), (-7, 1, "assistant", CHAT_TEST)], turns.schema)
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))
    done = chat.format_chat(turns.unionByName(tests).withColumn("parts", F.array(part)))
    back = done.select("conv_id", "formatted", "loss", chat.read_back().alias("back"))
    back = back.withColumn("trained", chat.loss_text(F.col("back")))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_matches(table(spark, folder, "documents"))


def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.quantized(search.usable(table(spark, folder, "embeddings"), "vec_id", "embedding"), 1024)
    return search.top_k(rows, rows.where("vec_id % 100 = 0"), 10, queries_are_rows=True)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line's end counts where it begins."""
    counted = token_counts.section_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), "first", sections=None)
    return counted.where("section >= 0")


QUALITY_FROM = 0.7
#: The only column besides the text that op11 looks at.
METADATA = ("n_chars",)


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", *METADATA)
    model = quality.train(docs, table(spark, folder, "labels").where(~held_out()), metadata=METADATA)
    scored = quality.quality_scores(docs, model, metadata=METADATA)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= QUALITY_FROM, 1).otherwise(0).alias("predicted"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(trie.with_shared_starts(table(spark, folder, "conversations")))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))[0]


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


QUERIES = {
    q.__name__: shipped(q)
    for q in (
        op1_bpe_round_trip,
        op2_source_mix,
        op3_token_records,
        op4_toxicity,
        op5_chat_format,
        op6_exact_dedup,
        op7_line_dedup,
        op8_exact_top_k,
        op9_token_counts,
        op10_ngram_join,
        op11_quality,
        op12_conversation_trie,
        op13_token_alignment,
    )
}
