"""Procedure header: name, parameter block, body, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens import schemas
from modlens.functions import patterns as P
from modlens.functions.core import bind, chunks_of, each, regex, trim, trim_end, where
from modlens.functions.text import collapse_whitespace, normalize_identifier, strip_comments


def _after(code: str, head: str) -> str:
    return f"substr({code}, length({head}) + 1)"


def up_to_name(code: str) -> str:
    """Everything up to the end of the first declared name; empty without declaration."""
    return f"regexp_extract({code}, {regex(P.UP_TO_NAME)}, 0)"


def up_to_as(declared: str, rest: str) -> str:
    """The text behind the name up to the AS that opens the body (EXECUTE AS does not)."""
    head = f"regexp_extract({rest}, {regex(P.UP_TO_AS)}, 0)"
    return f"CASE WHEN {declared} != '' THEN {head} ELSE '' END"


def body_of(code: str) -> str:
    """Body of one comment-free text; the whole text if no declaration opens one."""

    def cut(declared: str) -> str:
        def with_rest(rest: str) -> str:
            return bind(
                up_to_as(declared, rest),
                lambda head: trim(f"CASE WHEN {head} = '' THEN {code} ELSE {_after(rest, head)} END"),
            )

        return bind(_after(code, declared), with_rest)

    return bind(up_to_name(code), cut)


def _parse_item(item: str) -> str:
    declared = trim_end(f"regexp_replace({item}, {regex(r'(?i) OUTPUT\z')}, '')")
    words = (
        f"regexp_replace({collapse_whitespace(declared)},"
        f" {regex(r'(?i)(?: (?:AS|BEGIN|END))++\z')}, '')"
    )

    # White space is single blanks by now: Spark's own trim does, and texts are cut without a pattern.
    def fields(parts: str) -> str:
        return bind(f"substring_index({parts}, ' ', 1)", lambda name: bind(f"substr({parts}, length({name}) + 2)", lambda rest: typed(name, rest)))

    def typed(name: str, rest: str) -> str:
        def struct(kind: str) -> str:
            default = bind(f"trim(rtrim(',', substr({rest}, length({kind}) + 2)))", lambda d: f"CASE WHEN {d} != '' THEN {d} END")
            return f"named_struct('name', trim({name}), 'data_type', trim({kind}), 'default_value', {default})"

        return bind(f"substring_index({rest}, '=', 1)", struct)

    return bind(words, fields)


def _hidden(value: str) -> str:
    return f"translate({value}, ',=', '{P.MARK}{P.FIELD}')"


def _hide_nested(block: str) -> str:
    """Commas and equals signs inside literals and brackets to marks, at any depth.

    Literals first, each on its own. Then the text is cut into runs of brackets of one kind and the
    text between them, and one walk over these runs carries the depth, which closing brackets never
    take below zero. Brackets that stand together, however many, are one step. The runs go in
    chunks, so that what the walk has put together stays short: it costs their number, not its
    square. Blocks without a bracket are not walked over.
    """
    literals = f"regexp_extract_all({block}, {regex(P.LITERAL_OR_TEXT)}, 0)"
    plain = (
        f"CASE WHEN contains({block}, '\\'') THEN array_join("
        f"{each(literals, lambda t: f"CASE WHEN startswith({t}, '\\'') THEN {_hidden(t)} ELSE {t} END")}"
        f", '') ELSE {block} END"
    )

    def walk(chunk: str, depth: str) -> str:
        change = (
            "CASE WHEN endswith(t, '(') THEN length(t) - length(replace(t, '(', ''))"
            " WHEN endswith(t, ')') THEN length(replace(t, ')', '')) - length(t) ELSE 0 END"
        )
        return (
            f"aggregate({chunk}, named_struct('depth', {depth}, 'out', ''), (a, t) -> named_struct("
            f"'depth', greatest(a.depth + {change}, 0),"
            f" 'out', concat(a.out, CASE WHEN a.depth > 0 THEN {_hidden('t')} ELSE t END)))"
        )

    def chained(chunks: str) -> str:
        done = bind(
            walk("c", "s.depth"),
            lambda r: f"named_struct('depth', {r}.depth, 'out', concat(s.out, array({r}.out)))",
        )
        return (
            f"aggregate({chunks}, named_struct('depth', 0, 'out', cast(array() AS array<string>)),"
            f" (s, c) -> {done}, s -> array_join(s.out, ''))"
        )

    def brackets(text: str) -> str:
        runs = f"regexp_extract_all({text}, {regex(P.BRACKET_RUNS)}, 0)"
        walked = bind(runs, lambda r: bind(chunks_of(r), chained))
        return f"CASE WHEN contains({text}, '(') THEN {walked} ELSE {text} END"

    return bind(plain, brackets)


def _show_nested(value: str) -> str:
    return f"translate({value}, '{P.MARK}{P.FIELD}', ',=')"


def parameters_of(block: str) -> str:
    """``array<struct<name, data_type, default_value>>`` of one parameter block."""

    def parse(b: str) -> str:
        inner = (
            f"CASE WHEN startswith({b}, '(') AND endswith({b}, ')')"
            f" THEN {trim(f'substr({b}, 2, length({b}) - 2)')} ELSE {b} END"
        )
        shown = [
            f"'{field}', {_show_nested(f'p.{field}')}"
            for field in ("name", "data_type", "default_value")
        ]
        return f"transform({bind(_hide_nested(inner), items)}, p -> named_struct({', '.join(shown)}))"

    def items(b: str) -> str:
        bare = each(
            f"split({b}, ',')", lambda i: trim(f"rtrim(';', {trim(f"rtrim(',', {trim(i)})")})")
        )
        return each(where(bare, lambda i: f"startswith({i}, '@')"), _parse_item)

    none = f"cast(array() AS array<{schemas.PARAMETER}>)"
    return f"CASE WHEN contains({block}, '@') THEN {bind(trim(block), parse)} ELSE {none} END"


def _pair(free: str) -> str:
    unknown = chr(0xFFFD) * 2
    return f"CASE WHEN size({free}) < 2 THEN '{unknown}' ELSE concat({free}[0], {free}[1]) END"


def restored(value: str) -> str:
    """A text of the analysis as the module has it: see :func:`with_header`."""
    unchanged = f"swap = '' OR startswith(swap, '{chr(0xFFFD)}')"
    return f"CASE WHEN {unchanged} THEN {value} ELSE translate({value}, swap, '{P.MARK}{P.FIELD}') END"


def with_header(modules: DataFrame) -> DataFrame:
    """Add ``code`` (no comments), ``name``, ``parameter_block``, ``body`` and ``swap``.

    The marks of the analysis are noncharacters. In a text that holds one itself, two others
    that it does not hold stand for them, named in ``swap`` (else empty), until
    :func:`restored`. Should it hold them all, its marks become U+FFFD.
    """
    others = ", ".join(f"'{chr(c)}'" for c in range(0xFDD2, 0xFDF0))
    free = f"filter(array({others}), c -> NOT contains(sql, c))"
    swap = (
        f"CASE WHEN contains(sql, '{P.MARK}') OR contains(sql, '{P.FIELD}') THEN {bind(free, _pair)}"
        " ELSE '' END"
    )
    readable = (
        f"CASE WHEN swap = '' THEN coalesce(sql, '') ELSE translate(sql, '{P.MARK}{P.FIELD}', swap) END"
    )
    name = normalize_identifier(f"regexp_extract(_declared, {regex(P.NAME_AT_END)}, 0)")
    body = trim(f"CASE WHEN _head = '' THEN code ELSE {_after('_rest', '_head')} END")
    return (
        modules.withColumn("swap", F.expr(f"coalesce({swap}, '')"))
        .withColumn("_sql", F.expr(readable))
        .withColumn("code", F.expr(strip_comments("_sql")))
        .withColumn("_declared", F.expr(up_to_name("code")))
        .withColumn("_rest", F.expr(_after("code", "_declared")))
        .withColumn("_head", F.expr(up_to_as("_declared", "_rest")))
        .withColumns(
            {
                "name": F.expr(f"nullif({name}, '')"),
                "parameter_block": F.expr(
                    "CASE WHEN _declared = '' THEN '' WHEN _head = '' THEN _rest ELSE _head END"
                ),
                "body": F.expr(body),
            }
        )
        .drop("_sql", "_declared", "_rest", "_head")
    )
