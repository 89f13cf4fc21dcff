"""Text normalization: comments, white space, identifiers, statements, literals."""

from __future__ import annotations

from modlens.functions import patterns as P
from modlens.functions.core import bind, each, regex, trim, where


def strip_comments(sql: str) -> str:
    """Drop ``--`` and ``/* */`` comments, keeping the newlines of block comments."""
    kept = each(
        f"regexp_extract_all({sql}, {regex(P.CODE_OR_COMMENT)}, 0)",
        lambda t: f"CASE WHEN startswith({t}, '--') THEN '' WHEN startswith({t}, '/*')"
        f" THEN regexp_replace({t}, {regex(r'[^\n]++')}, '') ELSE {t} END",
    )
    # Text without a comment mark, the common case, is passed through untouched.
    return (
        f"CASE WHEN contains({sql}, '--') OR contains({sql}, '/*')"
        f" THEN array_join({kept}, '') ELSE {sql} END"
    )


def collapse_whitespace(text: str) -> str:
    """Each run of white space to one blank, none at the ends."""
    return f"trim(regexp_replace({text}, {regex(P.WHITESPACE_TO_COLLAPSE)}, ' '))"


def normalize_identifier(name: str) -> str:
    """``[dbo].[T]`` to ``dbo.T``, part by part; case is kept."""
    quotes = "'[]\"\\'`'"
    parts = each(
        f"split(rtrim(';,', {trim(name)}), r'\\.')",
        lambda p: f"rtrim(';,)(', btrim({trim(p)}, {quotes}))",
    )
    return f"array_join({parts}, '.')"


def split_code(code: str) -> str:
    """Statements of comment-free text: split at ``;`` and at GO lines outside literals."""
    unix = f"concat('\\n', replace({code}, '\\r\\n', '\\n'))"
    runs = f"regexp_extract_all({unix}, {regex(P.STATEMENT)}, 1)"
    return where(each(runs, trim), lambda s: f"{s} != ''")


def split_statements(sql: str) -> str:
    """Statements of any module text, comments removed first."""
    return split_code(strip_comments(sql))


def blank_literals(code: str) -> str:
    """Literals to blanks of the same length, newlines kept."""
    tokens = f"regexp_extract_all({code}, {regex(rf"[^']++|{P.LITERAL}")}, 0)"
    blanked = each(
        tokens,
        lambda t: f"CASE WHEN startswith({t}, '\\'')"
        f" THEN regexp_replace({t}, {regex(r'[^\n]')}, ' ') ELSE {t} END",
    )
    return f"array_join({blanked}, '')"


def drop_literals(code: str) -> str:
    """Each literal to two blanks.

    The rules see the same as with :func:`blank_literals`: a literal is at least two
    characters of white space to them, whatever its length. One pass, short text.
    """
    return f"regexp_replace({code}, {regex(P.LITERAL)}, '  ')"


def clean_for_rules(statement: str) -> str:
    """Collapsed statement without leading BEGIN / END words; empty if nothing is left."""
    return f"regexp_replace({collapse_whitespace(statement)}, {regex(P.BLOCK_WORDS)}, '')"


def clean_for_summary(statement: str) -> str:
    """Statement without one leading BEGIN; empty for a lone END."""

    def clean(s: str) -> str:
        opened = f"regexp_replace({collapse_whitespace(s)}, {regex(r'(?i)\ABEGIN ')}, '')"
        return (
            f"CASE WHEN upper(left({s}, 4)) = 'END' THEN ''"
            f" WHEN upper(left({s}, 5)) = 'BEGIN' AND rlike({s}, {regex(P.OPENING_BEGIN)})"
            f" THEN {opened} ELSE {s} END"
        )

    return bind(trim(statement), clean)
