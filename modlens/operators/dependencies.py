"""Read, write and execute references, temp tables."""

from __future__ import annotations

from modlens import schemas
from modlens.functions import patterns as P
from modlens.functions.core import bind, each, regex, starts_of, text, where, zipped

NO_HITS = f"cast(array() AS array<{schemas.HIT}>)"

# Two letters tell the keyword classes apart.
_SOURCES = {
    "FR": "FROM",
    "JO": "JOIN",
    "US": "USING",
    "IN": "INSERT INTO",
    "UP": "UPDATE",
    "DE": "DELETE FROM",
    "EX": "EXEC",
    "SE": "SELECT INTO",
    "ME": "MERGE INTO",
}
_SOURCE_CASE = " ".join(f"WHEN '{start}' THEN '{source}'" for start, source in _SOURCES.items())
_OPERATION_CASE = "WHEN 'FROM' THEN 'Read' WHEN 'JOIN' THEN 'Read' WHEN 'USING' THEN 'Read' WHEN 'EXEC' THEN 'Execute' ELSE 'Write'"
_NOT_PROCEDURES = ", ".join(text(word) for word in P.NOT_PROCEDURES)


def _plain_name(name: str) -> str:
    # An object reference holds no quote or blank, so only brackets at part edges go.
    edges = r"(?<![^.])[\[\]]++|(?<![\[\]])[\[\]]++(?![^.])"
    return (
        f"CASE WHEN contains({name}, '[') OR contains({name}, ']')"
        f" THEN regexp_replace({name}, {regex(edges)}, '') ELSE {name} END"
    )


def _hit(offset: str, stmt_index: str, name: str, source: str) -> str:
    return (
        f"named_struct('offset', {offset}, 'stmt_index', {stmt_index}, 'object', {name},"
        f" 'operation', CASE {source} {_OPERATION_CASE} END, 'source', {source})"
    )


def keep_first(hits: str) -> str:
    """First hit of each (object, source) of a bound, ordered array.

    Repeats are first looked for by hash. They are removed by sorting, not pairwise: a module
    may hold very many references.
    """
    keys = each(hits, lambda h: f"concat({h}.object, '{P.FIELD}', {h}.source)")
    keyed = each(
        hits,
        lambda h: f"named_struct('key', concat({h}.object, '{P.FIELD}', {h}.source), 'hit', {h})",
    )

    def distinct(found: str) -> str:
        first = zipped(
            found,
            f"concat(array(cast(null AS string)), transform({found}, k -> k.key))",
            lambda hit, last: f"CASE WHEN {hit}.key IS NOT NULL AND NOT ({hit}.key <=> {last})"
            f" THEN {hit}.hit END",
        )
        return f"sort_array(filter({first}, h -> h IS NOT NULL))"

    return (
        f"CASE WHEN size({hits}) < 2 OR size(array_distinct({keys})) = size({hits}) THEN {hits}"
        f" ELSE {bind(f'sort_array({keyed})', distinct)} END"
    )


def without_target_reads(hits: str) -> str:
    """Drop FROM reads of objects the same statement writes (JOIN and USING stay).

    ``hits`` has each (object, source) once. Sorted by object with writes in front of the one
    FROM read, that read stands right behind a write of its object, or stays.
    """
    ranked = each(
        hits,
        lambda h: f"named_struct('object', {h}.object, 'rank', CASE WHEN {h}.operation = 'Write'"
        f" THEN 0 WHEN {h}.source = 'FROM' THEN 1 ELSE 2 END, 'hit', {h})",
    )

    def others(found: str) -> str:
        written = f"transform({found}, k -> CASE WHEN k.rank = 0 THEN k.object END)"
        kept = zipped(
            found,
            f"concat(array(cast(null AS string)), {written})",
            lambda k, last: f"CASE WHEN {k}.rank != 1 OR NOT ({k}.object <=> {last})"
            f" THEN {k}.hit END",
        )
        return f"sort_array(filter({kept}, h -> h IS NOT NULL))"

    mixed = (
        f"exists({hits}, h -> h.operation = 'Write') AND exists({hits}, h -> h.source = 'FROM')"
    )
    return f"CASE WHEN {mixed} THEN {bind(f'sort_array({ranked})', others)} ELSE {hits} END"


def statement_hits(statement: str, stmt_index: str) -> str:
    """References of one statement, first of each kind, in text order.

    ``offset`` counts UTF-8 bytes from the start of the statement.
    """

    # a piece is [object, keyword with white space, text stepped over and what follows]
    def hit(piece: str, before: str) -> str:
        raw = f"{piece}[0]"
        return bind(
            bind(f"upper(left({piece}[1], 2))", lambda start: f"CASE {start} {_SOURCE_CASE} END"),
            lambda source: f"CASE WHEN startswith({raw}, '@') OR ({source} = 'EXEC'"
            f" AND lower({raw}) IN ({_NOT_PROCEDURES})) THEN null"
            f" ELSE {_hit(f'{before} + octet_length({piece}[1])', stmt_index, _plain_name(raw), source)}"
            " END",
        )

    def one(piece: str, head: str) -> str:
        return bind(
            hit(piece, f"octet_length({head})"),
            lambda h: f"CASE WHEN {h}.object != '' THEN array({h}) ELSE {NO_HITS} END",
        )

    def several(pieces: str, head: str) -> str:
        widths = each(pieces, lambda p: f"octet_length({p}[1]) + octet_length({p}[2])")
        located = bind(
            widths,
            lambda w: zipped(
                pieces, starts_of(w), lambda p, at: hit(p, f"octet_length({head}) + {at}")
            ),
        )
        return bind(
            f"filter({located}, h -> h.object != '')",
            lambda hits: f"CASE WHEN size({hits}) < 2 THEN {hits}"
            f" ELSE {bind(keep_first(hits), without_target_reads)} END",
        )

    def split_up(parts: str) -> str:
        pieces = each(f"slice({parts}, 2, size({parts}) - 1)", lambda p: f"split({p}, '{P.FIELD}')")
        # Most statements refer to one object.
        single = bind(f"split({parts}[1], '{P.FIELD}')", lambda p: one(p, f"{parts}[0]"))
        return (
            f"CASE WHEN size({parts}) = 2 THEN {single}"
            f" ELSE {bind(pieces, lambda p: several(p, f'{parts}[0]'))} END"
        )

    marked = f"regexp_replace({statement}, {regex(P.REFERENCE)}, '{P.REFERENCE_MARKED}')"
    return bind(
        marked,
        lambda m: f"CASE WHEN contains({m}, '{P.MARK}')"
        f" THEN {bind(f"split({m}, '{P.MARK}')", split_up)} ELSE {NO_HITS} END",
    )


def module_dependencies(hits: str) -> str:
    """All statements' hits to one list without repetition, by offset, then statement."""
    return (
        f"CASE WHEN size({hits}) = 1 THEN {hits}[0]"
        f" ELSE {bind(f'sort_array(flatten({hits}))', keep_first)} END"
    )


def temp_tables_of(body: str) -> str:
    names = f"regexp_extract_all({body}, {regex(P.TEMP_TABLE)}, 0)"
    return (
        f"CASE WHEN contains({body}, '#') THEN sort_array(array_distinct({names}))"
        " ELSE cast(array() AS array<string>) END"
    )


def objects_of(dependencies: str, operation: str) -> str:
    """Distinct objects of one operation, in order of first reference."""
    of_kind = where(dependencies, lambda d: f"{d}.operation = '{operation}'")
    return f"array_distinct({each(of_kind, lambda d: f'{d}.object')})"
