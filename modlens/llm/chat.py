"""Chat formatting of typed content parts, in DataFrame operations only.

A visitor goes over the parts of each turn: text is escaped, an image, an audio clip or a document becomes a
placeholder. A turn is written as `<turn role="ROLE">PARTS</turn>` and a line feed. In texts and roles `&`, `<` and
`"` are written as `&amp;`, `&lt;` and `&quot;`, so no text can hold a mark, and reading back is exact.

Result per conversation: `formatted`; `turns` (role and number of parts); `loss`, the spans that count in
training, one per text part of the trained roles: turn, start in the formatted text, start in the
turn, and length, in code points; `attachments` in the order of their placeholders: turn, kind, ref and tokens;
`expanded_tokens`, what the placeholders stand for in all.

Defined results: a null text or role counts as empty; null parts or part count as none; a part of unknown type is
text; a null or negative token count is 0; a null conversation is a conversation; turns go by number
(null first), then role, then content, so repeated rows follow each other; an empty table gives no rows.
One conversation is one value of the result, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("image", "audio", "document")
TRAINED = ("assistant",)
END = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def opening(role: Column) -> Column:
    return F.concat(F.lit('<turn role="'), escape(role), F.lit('">'))


def visit(part: Column) -> Column:
    """A part as it is written, with what is to be recorded of it."""
    kind = F.when(part["type"].isin(*KINDS), part["type"])
    written = F.when(kind.isNotNull(), F.concat(F.lit("<"), kind, F.lit("/>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
    tokens = F.greatest(F.coalesce(part["tokens"].cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    return F.struct(written.alias("written"), kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"), F.length(written).cast("long").alias("n"))


def format_chat(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """parts: array of structs with type, text, ref and tokens."""
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.filter(F.coalesce(F.col(f"`{parts}`"), F.array()), lambda p: p.isNotNull()).alias("given"))
    rows = rows.withColumn("visited", F.transform("given", visit))
    head = opening(F.col("role"))
    # The place of each part in its turn: a turn has few parts, so their ends are summed in an array.
    ends = F.aggregate("visited", F.array(F.length(head).cast("long")), lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v["n"])))
    rows = rows.select("conv_id", "turn", "role", "visited", F.concat(head, F.array_join(F.transform("visited", lambda v: v["written"]), ""), F.lit(END)).alias("written"), ends.alias("ends"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "written")
    rows = rows.withColumn("number", F.row_number().over(order) - 1)
    rows = rows.withColumn("at", F.sum(F.length("written").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("written"))
    spans = F.filter(
        F.transform("visited", lambda v, i: F.struct(F.col("number").alias("turn"), (F.col("at") + F.get("ends", i)).alias("start"), F.get("ends", i).alias("in_turn"), F.when(v["kind"].isNull(), v["n"]).alias("length"))),
        lambda s: s["length"].isNotNull(),
    )
    found = F.transform(F.filter("visited", lambda v: v["kind"].isNotNull()), lambda v: F.struct(F.col("number").alias("turn"), v["kind"].alias("kind"), v["ref"].alias("ref"), v["tokens"].alias("tokens")))
    rows = rows.select("conv_id", F.struct("number", "written", "role", F.size("visited").alias("parts"), F.when(F.col("role").isin(*trained), spans).otherwise(F.filter(spans, lambda s: F.lit(False))).alias("loss"), found.alias("found")).alias("t"))
    done = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["found"]))
    return done.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["written"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["parts"].alias("parts"))).alias("turns"),
        F.flatten(F.transform("t", lambda x: x["loss"])).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: str = "formatted") -> Column:
    """The turns of a formatted text: role, text (without placeholders) and the turn as written."""
    pieces = F.split(F.col(f"`{formatted}`"), END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, '^<turn role="([^"]*)">', 1)).alias("role"),
            unescape(F.regexp_replace(F.regexp_replace(p, '^<turn role="[^"]*">', ""), f"<({'|'.join(KINDS)})/>", "")).alias("text"),
            p.alias("written"),
        ),
    )


def loss_text(turns: Column, loss: str = "loss") -> Column:
    """The text under the mask; turns: of read_back."""
    return F.array_join(F.transform(F.col(loss), lambda s: unescape(F.substring(F.get(turns, s["turn"].cast("int"))["written"], s["in_turn"].cast("int") + 1, s["length"].cast("int")))), "")
