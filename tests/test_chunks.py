"""Texts in chunks against the functions for whole texts."""

import random

from pyspark.sql import functions as F

from modlens import schemas
from modlens.functions.text import blank_literals, strip_comments
from modlens.plans import chunks
from modlens.plans.corpus import EDGES


def frame(spark, texts):
    return spark.createDataFrame([(str(k), None, None, t) for k, t in enumerate(texts)], schemas.MODULES)


def texts():
    mixed = random.Random(5)
    parts = ["'", '"', "[", "]", "--", "-", "/*", "*/", "/", "*", "\n", "ab", "c d", "é漢", " ", "x y z ", "''", "]]"]
    return ["".join(mixed.choice(parts) for _ in range(mixed.randrange(60))) for _ in range(300)]


def test_equal_to_whole_texts(spark):
    """Whatever the chunks' length, also where comments, names and literals go over several of them."""
    rows = [*texts(), *EDGES, "", "x", "a '" + "lit eral " * 30 + "' b -- " + "com ment " * 30 + "\nc /* " + "block\n " * 30]
    modules = frame(spark, rows)
    whole = modules.select("module_id", F.expr(strip_comments("sql")).alias("code"))
    whole = {r.module_id: (r.code, r.blanked) for r in whole.withColumn("blanked", F.expr(blank_literals("code"))).collect()}
    for chars in (1, 4, 17, 100_000):
        found = chunks.chunked_code(modules, chars)
        got = {r.module_id: (r.code, r.blanked) for r in chunks.whole_texts(found, "code", "blanked").collect()}
        assert got == whole, chars
        if chars == 4:
            assert found.count() > 3 * len(rows)


def test_one_long_text_is_many_tasks(spark):
    """16 MB of one module: its chunks lie in many partitions, and together are the text."""
    unit = "SELECT 'it''s; -- no' AS [a]]b], \"q--\" /* c * / */ FROM t -- x\n;"
    n = 16_000_000 // len(unit)
    modules = spark.range(1).select(F.lit("m").alias("module_id"), F.repeat(F.lit(unit), n).alias("sql"))
    cut = chunks.text_chunks(modules, 600_000)
    sizes = [r.n for r in cut.select(F.length("chunk").alias("n")).collect()]
    assert len(sizes) > 25 and max(sizes) < 700_000 and sum(sizes) == n * len(unit)
    found = chunks.chunked_code(modules, 600_000)
    assert len(cut.inputFiles()) > 3
    code = "SELECT 'it''s; -- no' AS [a]]b], \"q--\"  FROM t \n;"
    total = found.agg(F.sum(F.length("code")).alias("code"), F.sum(F.length("blanked")).alias("blanked"), F.sum(F.regexp_count("blanked", F.lit("'"))).alias("quotes")).first()
    assert (total.code, total.blanked, total.quotes) == (n * len(code), n * len(code), 0)


def test_no_rows(spark):
    assert chunks.chunked_code(frame(spark, [])).collect() == []
    assert chunks.chunked_code(frame(spark, [None])).collect() == []
