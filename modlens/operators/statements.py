"""Statement summaries: kind, target, sources."""

from __future__ import annotations

from modlens.functions import patterns as P
from modlens.functions.core import bind, each, regex, where, zipped
from modlens.functions.text import clean_for_summary
from modlens.operators.dependencies import statement_hits
from modlens.operators.procedures import body_of


def classify(statement: str) -> str:
    """Kind of a cleaned statement, decided by its first letters."""

    def kind(start: str) -> str:
        return (
            f"CASE WHEN startswith({start}, 'SELECT INTO') THEN 'Insert'"
            f" WHEN startswith({start}, 'SELECT') THEN 'Select'"
            f" WHEN startswith({start}, 'INSERT') THEN 'Insert'"
            f" WHEN startswith({start}, 'UPDATE') THEN 'Update'"
            f" WHEN startswith({start}, 'DELETE') THEN 'Delete'"
            f" WHEN startswith({start}, 'MERGE') THEN 'Merge'"
            f" WHEN startswith({start}, 'EXECUTE') OR startswith({start}, 'EXEC ')"
            f" OR {start} = 'EXEC' THEN 'Execute'"
            f" WHEN rlike({statement}, '(?i)BEGIN TRAN|COMMIT|ROLLBACK') THEN 'Transaction'"
            " ELSE 'Unknown' END"
        )

    return bind(f"upper(left({statement}, 11))", kind)


def _summary_hits(statement: str, hits: str) -> str:
    # A statement that declares another procedure (a later batch of the file) is
    # summarized by that procedure's body.
    inner = bind(body_of(statement), lambda body: statement_hits(body, "0"))
    return (
        f"CASE WHEN contains(upper({statement}), 'PROC')"
        f" AND rlike({statement}, {regex(P.DECLARATION)}) THEN {inner} ELSE {hits} END"
    )


def is_summarized(statement: str) -> str:
    """Whether a trimmed statement has a summary: cleaning empties END alone."""
    return f"upper(left({statement}, 4)) != 'END'"


def summarize(statements: str, hits: str) -> str:
    """``array<struct<index, kind, target, sources>>``; statements END alone are dropped."""

    def summary(cleaned: str, found: str) -> str:
        acting = each(where(found, lambda h: f"{h}.operation != 'Read'"), lambda h: f"{h}.object")
        read = each(where(found, lambda h: f"{h}.operation = 'Read'"), lambda h: f"{h}.object")
        return (
            f"named_struct('kind', CASE WHEN {cleaned} != '' THEN {classify(cleaned)} END,"
            f" 'target', get({acting}, 0), 'sources', {read})"
        )

    summaries = zipped(
        statements,
        hits,
        lambda s, h: bind(
            clean_for_summary(s), lambda c: bind(_summary_hits(c, h), lambda f: summary(c, f))
        ),
    )
    return each(
        where(summaries, lambda s: f"{s}.kind IS NOT NULL"),
        lambda s, i: f"named_struct('index', {i} + 1, 'kind', {s}.kind, 'target', {s}.target,"
        f" 'sources', {s}.sources)",
        index=True,
    )
