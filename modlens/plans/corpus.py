"""Module corpora made from relational tables, for tests and measurements.

The TPC-H-like tables hold no SQL text. One module per order (16 templates) and one per
document (its prose in a comment and in a literal) are built by expressions any engine can
run, so that results can be compared across engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.sources.modules import spread

# Module k has template k % 16. Placeholders: {k} key, {a} k % 97,
# {b} 100 + k % 89, {d} order date, {p} order priority.
TEMPLATES = [
    "CREATE PROCEDURE dbo.SP_{k}\n    @ID INT\nAS\nBEGIN\n"
    "    SELECT ID FROM TB_{a} WHERE ID = @ID\nEND",
    "CREATE PROCEDURE SP_{k}\n    @ORDER_NO VARCHAR(20)\nAS\nBEGIN\n    INSERT INTO OUT_{b}\n"
    "    SELECT h.K, SUM(d.QTY) AS Q\n    FROM TB_{a} d\n    JOIN TB_{b} h ON d.K = h.K\n"
    "    GROUP BY h.K\nEND",
    "CREATE PROC job.RUN_{k} @WHAT SYSNAME AS\nDECLARE @S NVARCHAR(900) = N'DROP VIEW ' + @WHAT;\n"
    "EXEC (@S);\nEXEC job.LOG_{a};",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\nBEGIN\n    SELECT C FROM SRV.DB.dbo.TB_{a}\nEND",
    "CREATE PROC job.SEE_{k} AS\nSELECT * FROM TB_{b} WITH (NOLOCK)\nWHERE P <> '{p}'",
    "CREATE PROC job.ALL_{k} AS\nSET NOCOUNT ON;\nUPDATE TB_{b} SET STATUS = 5, D = '{d}';",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\nDELETE FROM TB_{a} -- WHERE P = '{p}'\n;\n"
    "SELECT C FROM TB_{b};",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\nINSERT INTO #T1 SELECT C FROM TB_{a};\n"
    "INSERT INTO #T2 SELECT C FROM #T1;\nINSERT INTO ##T3 SELECT DISTINCT C FROM #T2;",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\nDECLARE c CURSOR FOR SELECT C FROM TB_{a};\nOPEN c;",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\nBEGIN TRAN;\nUPDATE TB_{a} SET F = 1 WHERE P = '{p}';\n"
    "COMMIT;",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\nBEGIN TRY\n    UPDATE TB_{a} SET F = 1 WHERE ID = 1;\n"
    "END TRY\nBEGIN CATCH\n    SELECT ERROR_MESSAGE();\nEND CATCH",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\nSELECT C FROM TB_{a} WHERE D >= '{d}';",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\n/* UPDATE TB_X SET Y = 1 */\n"
    "UPDATE TB_{a} SET NOTE = 'it''s WHERE; {p}';\nDELETE FROM TB_{b} WHERE NOTE = 'WHERE';",
    "CREATE PROCEDURE dbo.SP_{k}\nAS\n"
    "MERGE INTO TB_{a} t USING TB_{b} s ON t.ID = s.ID WHEN MATCHED THEN DELETE;\n"
    "EXEC dbo.SP_{a};\nEXEC sp_executesql @S;",
    "ALTER PROC [job].[MIX_{k}]\n    @FROM DATE,\n    @N INT = 7 OUTPUT,\n"
    "    @TEXT NVARCHAR(99) = '{p}, or (none'\nAS\nSELECT C FROM [job].[TB_{b}];\nGO\n"
    "SELECT C FROM TB_{a} x JOIN TB_{b} y ON y.ID = x.ID",
    "SELECT 1;\nGO\nDELETE t\nFROM TB_{a} t\nJOIN TB_{b} s ON s.ID = t.ID\nWHERE s.F = 1",
]

# Texts at the edges of the rules for comments, literals, batches and names.
EDGES = [
    "CREATE PROC e.P_{k} AS SELECT C FROM TB_{a} /* open; DELETE FROM TB_{b}",
    'CREATE PROC e.P_{k} AS SELECT [a]]b--c], "q""--r" FROM TB_{a}; DELETE FROM TB_{b} -- x',
    "CREATE PROC e.P_{k} WITH EXECUTE AS OWNER AS EXEC e.Q_{a}; EXECUTE sp_who;",
    "SELECT C FROM TB_{a}\nGO 5\nDELETE FROM TB_{b}\n go \nSELECT 1",
    "CREATE PROC e.P_{k}\r\n@ID INT,\r\n@T CHAR(3) = 'a,b'\r\nAS\r\nSELECT C -- {p}\r\nFROM TB_{a};\r\nGO\r\nSELECT 2",
    "CREATE PROC e.P_{k} AS UPDATE x SET STATUS = 9 FROM TB_{a} x; UPDATE TB_{b} SET F = 2 WHERE(G = 3)",
    "ALTER PROCEDURE [e].[P_{k}] @S NVARCHAR(99) AS EXEC(@S); EXECUTE (@S)",
    "CREATE PROC e.P_{k} AS SELECT N'é漢; ' AS ü FROM TB_{a} WHERE Ä = 'ß; x'; DELETE FROM TB_{b} WHERE ö = 1",
    "PRINT 'a;b\nGO\n'; SELECT C FROM TB_{a} WHERE D = '{d}'",
    "SELECT C FROM TB_{a}, TB_{b} CROSS APPLY f(1) ; SELECT C FROM TB_{a} x JOIN TB_{a} y ON x.K = y.K",
    "SELECT * INTO #T_{k} FROM TB_{a}; SELECT C FROM #T_{k} JOIN ##G ON 1 = 1; DROP TABLE #X",
    "TRUNCATE TABLE TB_{a}; DELETE TB_{b}; MERGE TB_{a} USING TB_{b} ON 1 = 1;",
    "/* a /* b */ c */ SELECT C FROM TB_{a} --",
    "CREATE OR ALTER PROC e.P_{k} AS SELECT C FROM TB_{a} WHERE N = 'it''s'; BEGIN TRAN; INSERT INTO TB_{b} SELECT DISTINCT C FROM TB_{a}; ROLLBACK",
    "CREATE PROC e.P_{k} AS BEGIN BEGIN UPDATE TB_{a} SET F = 1; END; BEGIN TRY DELETE FROM TB_{b}; END TRY BEGIN CATCH THROW; END CATCH END",
    "SELECT C FROM [S].[D].[o].[TB_{a}]; SELECT C FROM D..TB_{b}; SELECT COUNT(*) FROM TB_{a} JOIN TB_{b} ON 1 = 1 GROUP  BY K",
]


def _fill(template: Column) -> Column:
    key = F.col("o_orderkey")
    values = {
        "{k}": key.cast("string"),
        "{a}": (key % 97).cast("string"),
        "{b}": (key % 89 + 100).cast("string"),
        "{d}": F.left(F.col("o_orderdate").cast("string"), F.lit(10)),
        "{p}": F.col("o_orderpriority"),
    }
    for placeholder, value in values.items():
        template = F.replace(template, F.lit(placeholder), value)
    return template


def order_modules(
    orders: DataFrame,
    template: Column | None = None,
    key: str = "o_orderkey",
    texts: list[str] = TEMPLATES,
) -> DataFrame:
    """One short module per order; ``template`` is a template number, k % 16 by default."""
    number = F.col("o_orderkey") % 16 if template is None else template
    texts = F.array(*[F.lit(t) for t in texts])
    key = F.col(key).cast("string")
    return orders.select(
        key.alias("module_id"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("snapshot"),
        _fill(F.get(texts, number.cast("int"))).alias("sql"),
    )


def document_modules(documents: DataFrame) -> DataFrame:
    """One long module per document."""
    doc = F.col("doc_id").cast("string")
    text = F.col("text")
    return documents.select(
        F.concat(F.lit("D"), doc).alias("module_id"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("snapshot"),
        F.concat(
            F.lit("CREATE PROCEDURE dbo.DOC_"),
            doc,
            F.lit("\nAS\n/* "),
            text,
            F.lit(" */\nUPDATE TB_"),
            (F.col("doc_id") % 97).cast("string"),
            F.lit(" SET NOTE = '"),
            F.replace(text, F.lit("'"), F.lit("''")),
            F.lit("' ;"),
        ).alias("sql"),
    )


def _slices(spark: SparkSession) -> int:
    """The given tables are one file each, so their few columns are dealt out on purpose."""
    return 2 * spark.sparkContext.defaultParallelism


def short_modules(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", "o_orderdate", "o_orderpriority"
    )
    # The keys are dealt out, not the texts made from them.
    return order_modules(spread(orders, _slices(spark)))


def edge_modules(spark: SparkSession, folder: str) -> DataFrame:
    """A module per order with one of the texts of ``EDGES``; keys have gaps, so number k / 4 decides."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return order_modules(spread(orders, _slices(spark)), F.floor(F.col("o_orderkey") / 4) % 16, texts=EDGES)


def long_modules(spark: SparkSession, folder: str) -> DataFrame:
    return document_modules(
        spread(
            spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"),
            _slices(spark),
        )
    )


def snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The short modules before and after a change: some removed, added, rewritten."""
    orders = spread(
        spark.read.parquet(f"{folder}/orders.parquet").select(
            "o_orderkey", "o_orderdate", "o_orderpriority"
        ),
        _slices(spark),
    )
    key = F.col("o_orderkey")
    changed = F.when(key % 5 == 0, (key + 1) % 16).otherwise(key % 16)
    before = order_modules(orders.filter(key % 11 != 0))
    after = order_modules(orders.filter(key % 7 != 0), changed)
    return before, after


def arrivals(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The short modules in three arrivals, and a fourth with a tenth of them rewritten."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", "o_orderdate", "o_orderpriority"
    )
    orders = spread(orders, _slices(spark))
    key = F.col("o_orderkey")
    changed = order_modules(orders.filter(key % 10 == 0), (key + 1) % 16)
    return [*[order_modules(orders.filter(key % 3 == n)) for n in range(3)], changed]


def nested_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Modules whose parameter defaults nest 1 to 40 calls, with marks inside literals."""
    key = F.col("o_orderkey")
    depth = (key % 40 + 1).cast("int")
    orders = spread(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey"), _slices(spark))
    return orders.select(
        key.cast("string").alias("module_id"),
        F.concat(
            F.lit("CREATE PROC p_"),
            key.cast("string"),
            F.lit(" @a INT = f(')', "),
            F.repeat(F.lit("g("), depth),
            F.lit("'x,=(', 1"),
            F.repeat(F.lit(")"), depth),
            F.lit("), @b CHAR("),
            (key % 9 + 1).cast("string"),
            F.lit(") = '=,', @c INT AS SELECT 1"),
        ).alias("sql"),
    )


def dense_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Modules of about 2,000 orders each, with two references per order and no semicolon."""
    key = F.col("o_orderkey")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    line = F.concat(
        F.lit(" INSERT INTO d.T"),
        (key % 997).cast("string"),
        F.lit(" SELECT C FROM d.T"),
        (key % 1009).cast("string"),
    )
    groups = orders.groupBy(F.floor(key / 8000).cast("string").alias("module_id")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return groups.select("module_id", F.concat(F.lit("CREATE PROC d.P AS"), text).alias("sql"))


def module_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, content``: a file for each part, with all that a folder scan must tell apart.

    Folders of three depths, upper-case endings, other endings, a folder to be left out, files
    without bytes, and files that are no UTF-8.
    """
    key = F.col("p_partkey")
    parts = spread(spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_brand"), _slices(spark))
    rows = parts.select(
        key.alias("o_orderkey"), F.lit("1998-10-03").alias("o_orderdate"), F.col("p_brand").alias("o_orderpriority")
    )
    number = F.col("module_id").cast("long")
    place = (
        F.when(number % 11 == 3, "out/")
        .when(number % 7 == 0, "")
        .when(number % 2 == 0, F.concat(F.lit("d"), number % 13, F.lit("/")))
        .otherwise(F.concat(F.lit("d"), number % 13, F.lit("/e"), number % 5, F.lit("/")))
    )
    ending = F.when(number % 10 == 9, ".txt").when(number % 4 == 1, ".SQL").otherwise(".sql")
    text = F.col("sql").cast("binary")
    content = (
        F.when(number % 19 == 7, F.lit(b""))
        .when(number % 17 == 5, F.concat(text, F.lit(b"\xff")))
        .otherwise(text)
    )
    return order_modules(rows).select(
        F.concat(place, F.lit("m"), number, ending).alias("name"), content.alias("content")
    )


def repeated_modules(spark: SparkSession, folder: str) -> DataFrame:
    """A module per order, of which ten or more have one text, and a third of all the same."""
    orders = spread(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey"), _slices(spark))
    key = F.col("o_orderkey")
    shared = F.when(key % 3 == 0, 0).otherwise(F.floor(key / 40)).cast("long")
    rows = orders.select(
        key.alias("own"),
        shared.alias("o_orderkey"),
        F.lit("1998-10-03").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    )
    return order_modules(rows, key="own")
