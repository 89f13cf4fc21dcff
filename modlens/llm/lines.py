"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct words (runs of other characters than white space of ASCII). A line is removed if
an earlier line, by (doc_id, line number), has the same text, or a token set of Jaccard similarity
`THRESHOLD` or more. Whether the earlier line is itself removed makes no difference.

1. Equal lines become one, with their first place; they meet by a 128-bit hash.
2. Rarity: words are counted in 2^`SLOT_BITS` slots by hash. Tokens go by log2 of their slot's count, then by hash; a
   token that is alone in its slot is in one line only and cannot match. The slots' classes are
   broadcast, a byte each, however large the table is.
3. Each line is listed under the tokens of its prefix: size - ceil(0.8 size) + 1, rarest first. Two lines of
   a list pass if their sizes allow the similarity, if what stands behind the positions of the shared token
   leaves enough to have in common, and if their parity maps (64 bits) differ in no more bits than their
   sets may differ in tokens.
4. Of each list come the pairs of its first line with all others, and of lists of a low class (before `COLD`), which are
   short, all pairs. A pair's shared tokens of low class are counted: one that shares too few of them is
   dropped before any text is looked at.
5. Pairs with the first line of a list are verified on the words first. What has no match by then meets all earlier
   lines of its lists, is verified, and loses nothing: the first pass only spares large groups of alike lines their
   pairs. Again shared tokens are counted first. Only lines whose bit in a map of 2^25 is set, those of
   pairs and few others, are moved.

Defined results: null texts have no lines; lines without words stay, and match none; ties of the place
(rows of equal ids) go by a number of the line; the line feed alone ends a line, so a text has one more line than line feeds;
null ids come first; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlens.session import shared_folder

THRESHOLD_PERCENT = 80
#: log2 of the rarity slots, and of those kept in one array.
SLOT_BITS, ROW_BITS = 22, 11
#: Tokens of classes below this have lists short enough for all pairs: less than 2^COLD lines.
COLD = 7
#: More is counted as this: class and token share a number of 64 bits.
MOST_CLASS = 31
#: log2 of the words, of 64 bits, in the map of the lines to be moved.
WORD_BITS = 19
PLACE = ("doc_id", "line_no", "id")


def lines_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line, and a 128-bit key of the line."""
    lines = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("line_no", "line"))
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def words(line: str) -> Column:
    """The words of a line, repeats too."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")) | F.contains(line, F.lit("\r"))
    return F.array_remove(F.split(F.when(other, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(F.col(line)), " "), "")


def tokens(line: str) -> Column:
    """Distinct words, as 64-bit hashes."""
    return F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w)))


def slot(token: Column) -> Column:
    return F.shiftrightunsigned(token, 64 - SLOT_BITS).cast("int")


def as_array(shown: DataFrame, bits: int, kind: str) -> DataFrame:
    """One row: the values of 2^bits slots in their order; 0 for a slot that is not in `shown`."""
    every = shown.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast(kind).alias("value"))
    full = shown.unionByName(every).groupBy("slot").agg(F.bit_or("value").alias("value"))
    rows = full.groupBy(F.shiftright("slot", ROW_BITS).alias("row")).agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("x"))
    rows = rows.select(F.struct("row", F.transform("x", lambda s: s["value"]).alias("v")).alias("r"))
    return rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"])).alias("values"))


def slot_classes(classes: DataFrame) -> DataFrame:
    """One row: log2 of the count of every slot (0: one token at most)."""
    counted = classes.select(F.explode_outer(tokens("line")).alias("token")).groupBy(slot(F.col("token")).alias("slot")).agg(F.count("*").alias("n"))
    return as_array(counted.select("slot", F.least(F.floor(F.log2("n")), F.lit(MOST_CLASS)).cast("byte").alias("value")).where("value > 0"), SLOT_BITS, "byte")


def listed(classes: DataFrame, rarity: DataFrame) -> DataFrame:
    """A row per line and prefix token: token, id, doc_id, line_no, n (tokens), cold (of them in the prefix), pos, map."""
    with_classes = classes.withColumn("classes", rarity.scalar())
    # Class and token in one number: both sort by it, without a comparison of structs.
    of = lambda t: F.coalesce(F.get("classes", slot(t)), F.lit(0).cast("byte")).cast("long")
    ranked = lambda t: F.call_function("shiftleft", of(t), F.lit(58)).bitwiseOR(F.shiftrightunsigned(t.bitwiseXOR(F.lit(-(1 << 63))), 6))
    rows = with_classes.select(*PLACE, F.array_sort(F.transform(tokens("line"), ranked)).alias("t"))
    n = F.size("t")
    prefix = n - F.ceil(F.lit(THRESHOLD_PERCENT) * n / 100).cast("int") + 1
    parity = F.aggregate("t", F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))
    rows = rows.select(*PLACE, n.alias("n"), parity.alias("map"), F.slice("t", 1, prefix).alias("t"))
    rows = rows.withColumn("cold", F.size(F.filter("t", lambda x: x < COLD << 58)))
    # A plain explode would compute all this once more for a filter by size.
    rows = rows.select(*PLACE, "n", "map", "cold", F.posexplode_outer("t").alias("pos", "token"))
    return rows.where(F.col("token") >= 1 << 58).select("token", *PLACE, "n", "cold", "pos", "map")


def enough(shared: Column, total: Column) -> Column:
    """Two sets of so many tokens together that share so many are similar."""
    return (100 + THRESHOLD_PERCENT) * shared >= THRESHOLD_PERCENT * total


def may_match(a: str, b: str) -> Column:
    """The filters by length, position and parity map. No division: lists have many pairs."""
    n_a, n_b, p_a, p_b, m_a, m_b = (F.col(f"{x}.{c}") for c in ("n", "pos", "map") for x in (a, b))
    length = (THRESHOLD_PERCENT * n_a <= 100 * n_b) & (THRESHOLD_PERCENT * n_b <= 100 * n_a)
    # Differing bits are as even or odd as differing tokens, so half of the rest is a whole number.
    differing = (100 + THRESHOLD_PERCENT) * (n_a + n_b - F.bit_count(m_a.bitwiseXOR(m_b))) >= 2 * THRESHOLD_PERCENT * (n_a + n_b)
    # Before the tokens at both positions at most the smaller number of earlier ones can be shared.
    position = enough(F.least(p_a, p_b) + F.least(n_a - p_a, n_b - p_b), n_a + n_b)
    return length & differing & position


def not_cold(a: str, b: str) -> Column:
    """Tokens that a pair can share besides those of low class in both prefixes: the line whose low classes end first shares what is behind."""
    n_a, n_b, c_a, c_b = (F.col(f"{x}.{c}") for c in ("n", "cold") for x in (a, b))
    return F.greatest(n_a - c_a, n_b - c_b)


def in_order(lists: DataFrame) -> DataFrame:
    """The lists with each line's number in its list, from 1."""
    order = Window.partitionBy("token").orderBy(F.col("doc_id").asc_nulls_first(), "line_no", "id")
    return lists.withColumn("at", F.row_number().over(order)).drop("doc_id", "line_no")


#: Of pairs: the lines, their tokens, the most of one, and whether they may be similar without a shared token of low class.
PAIR = ("a", "b", "total", "most", "open")


def pair() -> list[Column]:
    n_a, n_b, total = F.col("a.n"), F.col("b.n"), F.col("a.n") + F.col("b.n")
    values = (F.col("a.id"), F.col("b.id"), total, F.greatest(n_a, n_b), enough(not_cold("a", "b"), total))
    return [x.alias(name) for x, name in zip(values, PAIR, strict=True)]


def pairs_of(lists: DataFrame) -> DataFrame:
    """Pairs with n (shared tokens of low class) and led: those with the first line of a list, and all of lists of low class, that share enough."""
    cold = in_order(lists.where(F.col("token") < COLD << 58))
    both = cold.alias("a").join(cold.alias("b"), (F.col("a.token") == F.col("b.token")) & may_match("a", "b") & (F.col("a.at") < F.col("b.at")))
    others = not_cold("a", "b").alias("others")
    both = both.select(*pair(), others, (F.col("a.at") == 1).cast("int").alias("led"), F.lit(1).alias("n"))

    hot = lists.where(F.col("token") >= COLD << 58)
    own = ("id", "n", "cold", "pos", "map")
    front = Window.partitionBy("token").orderBy(F.col("doc_id").asc_nulls_first(), "line_no", "id").rowsBetween(Window.unboundedPreceding, 0)
    led = hot.select(*own, *[F.first(c).over(front).alias(f"first_{c}") for c in own])
    led = led.select(F.struct(*[F.col(f"first_{c}").alias(c) for c in own]).alias("a"), F.struct(*own).alias("b")).where(F.col("a.id") != F.col("b.id"))
    led = led.where(may_match("a", "b")).select(*pair(), others, F.lit(1).alias("led"), F.lit(0).alias("n"))
    counted = both.unionByName(led).groupBy(*PAIR, "others").agg(F.max("led").alias("led"), F.sum("n").alias("n"))
    return counted.where(enough(F.col("n") + F.col("others"), F.col("total"))).drop("others")


def hot_pairs(lists: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of lists of high class, b not done, that need share no token of a low class: all others are in `pairs_of`. A row per shared token."""
    hot = lists.where(F.col("token") >= COLD << 58)
    a, b = hot.alias("a"), hot.join(done, "id", "left_anti").alias("b")
    earlier = F.struct(*(F.col(f"a.{c}") for c in PLACE)) < F.struct(*(F.col(f"b.{c}") for c in PLACE))
    both = a.join(b, (F.col("a.token") == F.col("b.token")) & may_match("a", "b") & enough(not_cold("a", "b"), F.col("a.n") + F.col("b.n")) & earlier)
    return both.select(*pair(), F.lit(1).alias("n"))


def rest_of(pairs: DataFrame, lists: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of lines that are not done. Where all shared tokens of the prefixes were met, there must be enough: the line
    whose prefix ends first shares no others but those behind."""
    cold = pairs.select(*PAIR, "n").join(done.withColumnRenamed("id", "b"), "b", "left_anti")
    counted = cold.unionByName(hot_pairs(lists, done)).groupBy(*PAIR).agg(F.sum("n").alias("n"))
    behind = F.ceil(F.lit(THRESHOLD_PERCENT) * F.col("most") / 100) - 1
    return counted.where(~F.col("open") | enough(F.col("n") + behind, F.col("total"))).select("a", "b", "total")


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a before b) whose words are similar enough, with the place of a."""
    left = lines.select(F.col("id").alias("a"), F.col("line").alias("line_a"), "doc_id", "line_no")
    both = pairs.join(left, "a").join(lines.select(F.col("id").alias("b"), "line"), "b")
    shared = F.size(F.array_intersect(words("line_a"), words("line")))
    return both.where(enough(shared, F.col("total"))).select("a", "b", F.struct("doc_id", "line_no").alias("place"))


def shown_lines(classes: DataFrame, shown: DataFrame) -> DataFrame:
    """The lines whose bit is set, so that no others are moved."""
    key = F.xxhash64("id")
    bit = F.getbit(F.get(shown.scalar(), F.shiftrightunsigned(key, 64 - WORD_BITS).cast("int")), key.bitwiseAND(63).cast("int"))
    return classes.where(bit == 1).select("id", "line", "doc_id", "line_no")


def id_map(pairs: DataFrame) -> DataFrame:
    """One row: a bit for the hash of each id in the pairs."""
    key = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.xxhash64("id").alias("key"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(63).cast("int"))
    return as_array(key.select(F.shiftrightunsigned("key", 64 - WORD_BITS).cast("int").alias("slot"), bit.alias("value")), WORD_BITS, "long")


#: With it Spark deletes a query's shuffle files when the query ends, not when the driver next collects garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def line_matches(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line with words or without: doc_id, line_no, removed, match_doc_id, match_line (an earlier similar line)."""
    spark = df.sparkSession
    folder = shared_folder(spark, "line-dedup")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        with cleaned(spark):
            frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    lines = lines_of(df, doc_id, text)
    grouped = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("line").alias("line"), F.count("*").alias("copies"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("id"), "line", "first.*", "h1", "h2", "copies"), "classes")
    rarity = stored(slot_classes(classes), "rarity")
    lists = stored(listed(classes, rarity), "lists")
    pairs = stored(pairs_of(lists), "pairs")

    led = pairs.where("led = 1").select("a", "b", "total")
    first = stored(verified(led, stored(shown_lines(classes, stored(id_map(led), "led-map")), "led-lines")), "first")
    rest = stored(rest_of(pairs, lists, first.select(F.col("b").alias("id")).distinct()), "rest")
    second = verified(rest, stored(shown_lines(classes, stored(id_map(rest), "rest-map")), "rest-lines"))
    found = first.unionByName(second).groupBy(F.col("b").alias("id")).agg(F.min("place").alias("place"))
    decided = classes.select("id", "h1", "h2", "copies", F.struct("doc_id", "line_no").alias("own")).join(found, "id", "left")
    decided = stored(decided.where("copies > 1 or place is not null").select("h1", "h2", "own", "place"), "decided")
    marked = lines.select("doc_id", "line_no", "h1", "h2").join(decided, ["h1", "h2"], "left")
    copy = F.col("own").isNotNull() & ~F.col("own").eqNullSafe(F.struct("doc_id", "line_no"))
    match = F.when(copy, F.coalesce("place", "own")).otherwise(F.col("place"))
    return marked.select("doc_id", "line_no", match.isNotNull().alias("removed"), match["doc_id"].alias("match_doc_id"), match["line_no"].alias("match_line"))


def without_lines(df: DataFrame, matches: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents (of unique ids) without their removed lines."""
    gone = matches.where("removed").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    rows = df.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    cleaned = F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(kept)
    return rows.withColumn(text, cleaned).select(*[F.col(f"`{c}`") for c in df.columns])
