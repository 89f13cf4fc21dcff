"""Building blocks for expressions written as Spark SQL text.

The functions of this package take and return SQL expression text, to be wrapped in
``F.expr``. Nested lambdas made of Column objects cost one call to the JVM per node, several
thousand per plan; text is parsed there in one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from modlens.functions.patterns import WS_CHARS

CHUNK = 128
_names = itertools.count()


def regex(pattern: str) -> str:
    """Raw SQL literal of a pattern; the quote is written as its code."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def text(value: str) -> str:
    """SQL literal of any string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fresh() -> str:
    return f"v{next(_names)}"


def each(array: str, use: Callable[..., str], index: bool = False) -> str:
    v = _fresh()
    if index:
        return f"transform({array}, ({v}, {v}i) -> {use(v, v + 'i')})"
    return f"transform({array}, {v} -> {use(v)})"


def where(array: str, keep: Callable[[str], str]) -> str:
    v = _fresh()
    return f"filter({array}, {v} -> {keep(v)})"


def zipped(left: str, right: str, use: Callable[[str, str], str]) -> str:
    v = _fresh()
    return f"zip_with({left}, {right}, ({v}, {v}r) -> {use(v, v + 'r')})"


def bind(value: str, use: Callable[[str], str]) -> str:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Inside a lambda Spark shares no common subexpressions. Folding nothing binds the start
    value to the variable of the finishing lambda, without an array in between.
    """
    v = _fresh()
    return f"aggregate(cast(array() AS array<int>), {value}, (a, e) -> a, {v} -> {use(v)})"


def trim(value: str) -> str:
    """Trim all white space; Spark's own ``trim`` takes blanks only.

    A variable that begins and ends with a visible ASCII character is passed through: to look for
    each end among all white space costs many times that.
    """
    trimmed = f"btrim({value}, {text(WS_CHARS)})"
    if not re.fullmatch(r"[A-Za-z_]\w*", value):
        return trimmed
    visible = f"{value} >= '!' AND {value} < '\x7f' AND abs(ascii(substr({value}, -1)) - 80) < 47"
    return f"CASE WHEN {visible} THEN {value} ELSE {trimmed} END"


def trim_end(value: str) -> str:
    return f"rtrim({text(WS_CHARS)}, {value})"


def total(numbers: str) -> str:
    return f"aggregate({numbers}, 0, (a, n) -> a + n)"


def _running(lengths: str) -> str:
    a = _fresh()
    return (
        f"aggregate({lengths}, named_struct('total', 0, 'starts', cast(array() AS array<int>)),"
        f" ({a}, {a}n) -> named_struct('total', {a}.total + {a}n,"
        f" 'starts', concat({a}.starts, array({a}.total))), {a} -> {a}.starts)"
    )


def chunks_of(array: str) -> str:
    """A bound array variable as arrays of ``CHUNK`` items."""
    return each(
        f"CASE WHEN size({array}) = 0 THEN cast(array() AS array<int>)"
        f" ELSE sequence(0, cast(ceil(size({array}) / {CHUNK}) AS int) - 1) END",
        lambda i: f"slice({array}, {i} * {CHUNK} + 1, {CHUNK})",
    )


def starts_of(lengths: str) -> str:
    """Exclusive running sum of the bound ``array<int>`` variable ``lengths``.

    Short arrays are summed directly. Growing an array by one costs its length, so long ones
    are summed in chunks: a statement with 100,000 references must not cost 100,000 squared.
    """
    direct = each(lengths, lambda _, i: total(f"slice({lengths}, 1, {i})"), index=True)
    def join(parts: str) -> str:
        return "flatten(" + zipped(
            parts,
            _running(each(parts, total)),
            lambda part, at: each(_running(part), lambda n: f"{n} + {at}"),
        ) + ")"

    return f"CASE WHEN size({lengths}) <= 16 THEN {direct} ELSE {bind(chunks_of(lengths), join)} END"


def bullet_list(items: str) -> str:
    """Markdown list lines, ``- None`` for an empty array; ends with a newline."""
    return (
        f"CASE WHEN size({items}) = 0 THEN '- None\\n'"
        f" ELSE concat('- ', array_join({items}, '\\n- '), '\\n') END"
    )
