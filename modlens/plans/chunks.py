"""Comments and literals of very long texts, by many tasks.

What a character is depends on all before it: a quote far up may have opened a literal. So a text is cut into chunks,
and each chunk tells, for every state it may begin in, the state it ends in. These maps are small; composed in
order they give the state that each chunk really begins in, and then every chunk is stripped or blanked on its own.

A chunk that begins inside a literal, a quoted or bracketed name or a comment is read with the opening put in front. Cuts
lie between two characters that open or close nothing, so no mark is cut in two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.core import bind, each, regex, text
from modlens.functions.text import blank_literals, strip_comments
from modlens.session import shared_folder

#: Characters of a chunk, about.
CHARS = 4_000_000

#: The states, by what opens them: code, literal, quoted name, bracketed name, line comment, block comment.
OPENINGS = ["", "'", '"', "[", "--", "/*"]
CODE, BLOCK = 0, 5
_PLAIN = r"[^\-/*'\"\[\]]"
# All that is complete from the start on; group 1 has the opening of what is not.
_COMPLETE = (
    r"\A(?:[^'\"\[\-/]++|-(?!-)|/(?!\*)|'[^']*+'|\"[^\"]*+\"|\[(?:[^\]]++|\]\])*+\]"
    r"|--[^\n]*+\n|/\*(?:[^*]++|\*(?!/))*+\*/)*+([\s\S]{0,2})"
)


def _cuts(sql: str, chars: int) -> str:
    """Ends of the chunks, ascending; the last is the text's length."""

    def cut(k: str) -> str:
        near = f"regexp_instr(substr({sql}, {k} * {chars} + 1, 1000), {regex(_PLAIN * 2)})"
        far = f"regexp_instr(substr({sql}, {k} * {chars} + 1), {regex(_PLAIN * 2)})"
        chosen = bind(near, lambda n: f"CASE WHEN {n} > 0 THEN {n} ELSE {far} END")
        return bind(chosen, lambda n: f"CASE WHEN {n} > 0 THEN {k} * {chars} + {n} ELSE length({sql}) END")

    count = f"cast(ceil(length({sql}) / {chars}) AS int)"
    inner = each(f"CASE WHEN {count} > 1 THEN sequence(1, {count} - 1) ELSE cast(array() AS array<int>) END", cut)
    return f"array_distinct(concat({inner}, array(length({sql}))))"


def _ends_in(chunk: str, start: int) -> str:
    """The state at the end of a chunk that begins in a state."""

    def state(rest: str) -> str:
        marks = " ".join(f"WHEN startswith({rest}, {text(o)}) THEN {n}" for n, o in enumerate(OPENINGS) if o)
        return f"CASE {marks} ELSE {CODE} END"

    return bind(f"regexp_extract(concat({text(OPENINGS[start])}, {chunk}), {regex(_COMPLETE)}, 1)", state)


def text_chunks(modules: DataFrame, chars: int = CHARS) -> DataFrame:
    """``module_id, pos, last, chunk``: the texts in chunks, stored and dealt out. Empty texts are one empty chunk."""
    spark = modules.sparkSession
    cut = modules.where("sql IS NOT NULL").select("module_id", "sql", F.expr(_cuts("sql", chars)).alias("cuts"))
    parts = "transform(cuts, (c, i) -> named_struct('a', CASE WHEN i = 0 THEN 0 ELSE cuts[i - 1] END, 'b', c, 'last', i = size(cuts) - 1))"
    rows = cut.select("module_id", "sql", F.posexplode(F.expr(parts)).alias("pos", "p"))
    rows = rows.select("module_id", "pos", "p.last", F.expr("substr(sql, p.a + 1, p.b - p.a)").alias("chunk"))
    folder = shared_folder(spark, "chunks")
    # The number is given, as adaptive execution would join what is few bytes, but much work.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(partitions, "module_id", "pos").write.parquet(folder)
    return spark.read.schema("module_id string, pos int, last boolean, chunk string").parquet(folder)


def with_states(chunks: DataFrame) -> DataFrame:
    """The chunks with the state that each begins in (``state``) and ends in (``after``).

    Only the maps meet by module: six numbers a chunk.
    """
    maps = chunks.select("module_id", "pos", F.expr(f"array({', '.join(_ends_in('chunk', s) for s in range(len(OPENINGS)))})").alias("ends"))
    ordered = maps.groupBy("module_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ends"))).alias("maps"))
    begins = (
        f"aggregate(maps, array({CODE}), (a, m) -> concat(a, array(m.ends[element_at(a, -1)])))"
    )
    states = ordered.select("module_id", F.expr(begins).alias("s")).select("module_id", "s", F.posexplode(F.expr("slice(s, 1, size(s) - 1)")).alias("pos", "state"))
    states = states.select("module_id", "pos", "state", F.expr("s[pos + 1]").alias("after"))
    return chunks.join(states, ["module_id", "pos"])


def _stripped() -> str:
    """The chunk without comments, as the whole text has it there."""

    def opened(state: int) -> str:
        # A comment that goes on in the next chunk is closed, as only the text's end keeps a last character.
        closed = f"CASE WHEN after = {BLOCK} AND NOT last THEN '*/' ELSE '' END"
        whole = strip_comments(f"concat({text(OPENINGS[state])}, chunk, {closed})")
        kept = len(OPENINGS[state]) if state in (1, 2, 3) else 0
        return f"substr({whole}, {kept + 1})" if kept else whole

    return "CASE state " + " ".join(f"WHEN {s} THEN {opened(s)}" for s in range(len(OPENINGS))) + " END"


def chunked_code(modules: DataFrame, chars: int = CHARS) -> DataFrame:
    """``module_id, pos, code, blanked``: the text without comments, and that with its literals blanked, in chunks.

    Joined in order of ``pos`` (:func:`whole_texts`) they are what the functions for single texts give.
    """
    stored = shared_folder(modules.sparkSession, "code")
    with_states(text_chunks(modules, chars)).select("module_id", "pos", F.expr(_stripped()).alias("code")).write.parquet(stored)
    code = modules.sparkSession.read.schema("module_id string, pos int, code string").parquet(stored)
    # Every apostrophe of code opens or closes a literal, so its number says what the next chunk begins in.
    odd = code.select("module_id", "pos", ((F.length("code") - F.length(F.replace("code", F.lit("'")))) % 2).alias("odd"))
    ordered = odd.groupBy("module_id").agg(F.sort_array(F.collect_list(F.struct("pos", "odd"))).alias("m"))
    begins = "aggregate(m, array(0), (a, x) -> concat(a, array((element_at(a, -1) + x.odd) % 2)))"
    inside = ordered.select("module_id", F.posexplode(F.expr(f"slice({begins}, 1, size(m))")).alias("pos", "inside"))
    opened = blank_literals("concat('\\'', code)")
    blanked = f"CASE WHEN inside = 1 THEN substr({opened}, 2) ELSE {blank_literals('code')} END"
    return code.join(inside, ["module_id", "pos"]).select("module_id", "pos", "code", F.expr(blanked).alias("blanked"))


def whole_texts(chunks: DataFrame, *columns: str) -> DataFrame:
    """Chunks put together again, a row per module."""
    own = F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("c")
    joined = chunks.groupBy("module_id").agg(own)
    return joined.select("module_id", *[F.array_join(f"c.{c}", "").alias(c) for c in columns])
