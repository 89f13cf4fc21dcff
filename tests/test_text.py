import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modlens.functions import identifiers, text


@pytest.fixture(scope="module")
def evaluate(spark):
    """Values of an expression over column ``s`` for a list of strings."""

    def run(expression, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
        found = rows.coalesce(1).select("i", F.expr(expression).alias("r")).collect()
        return [r.r for r in sorted(found)]

    return run


def test_strip_comments(evaluate):
    cases = {
        "SELECT 1 -- x\nFROM t": "SELECT 1 \nFROM t",
        "a /*\nGO\n*/ b": "a \n\n b",
        "a/**/b": "ab",
        "x /* abc": "x c",
        "x /*": "x ",
        "x /*y": "x y",
        "/*/ y */z": "z",
        "'/* no */'": "'/* no */'",
        "'it''s -- no' -- yes": "'it''s -- no' ",
        '"a--b" --c': '"a--b" ',
        "[T--x]]--y] --z": "[T--x]]--y] ",
        "/* a /* b */ c */": " c */",
        "1 - -2 / 3": "1 - -2 / 3",
        "'open -- x": "'open -- x",
        "": "",
        "é /* ü\n */ ö -- ä": "é \n ö ",
    }
    assert evaluate(text.strip_comments("s"), list(cases)) == list(cases.values())


def test_split_statements(evaluate):
    cases = {
        "SELECT 1;\nGO\nSELECT 2;": ["SELECT 1", "SELECT 2"],
        "'a;b\nGO\n'": ["'a;b\nGO\n'"],
        "a\n  go \t\nb\nGO 5\nc": ["a", "b\nGO 5\nc"],
        "GO\na": ["a"],
        "a\r\nGO\r\nb\r\nc": ["a", "b\nc"],
        "a;GO\nb": ["a", "GO\nb"],
        "GO;a": ["GO", "a"],
        '"a;b"': ['"a', 'b"'],
        "'a''b;c';d": ["'a''b;c'", "d"],
        " ; ;\n;": [],
        "a\nGO": ["a"],
        "it's;open": ["it's;open"],
        "a \nGO \nb": ["a", "b"],
    }
    assert evaluate(text.split_statements("s"), list(cases)) == list(cases.values())


def test_collapse_whitespace(evaluate):
    cases = {"  a \n\t b  c ": "a b c", "a b": "a b", "a b  c": "a b c", "": "", "\n": ""}
    assert evaluate(text.collapse_whitespace("s"), list(cases)) == list(cases.values())


def test_normalize_identifier(evaluate):
    cases = {
        "[dbo].[Table]": "dbo.Table",
        " [TB] ;,": "TB",
        "a..b": "a..b",
        '"a"."b"': "a.b",
        # Quotes are trimmed before the bracket gets to the edge.
        "`x`.[y](": "x.y]",
        "dbo.f(": "dbo.f",
        "[]": "",
    }
    assert evaluate(text.normalize_identifier("s"), list(cases)) == list(cases.values())


def test_blank_literals(evaluate):
    cases = {
        "a 'b''c' d": "a        d",
        "'x\ny' z": "  \n   z",
        "'open": "     ",
        "[it's] x 'y'": "[it" + " " * len("'s] x '") + "y ",
    }
    assert evaluate(text.blank_literals("s"), list(cases)) == list(cases.values())


def test_clean_for_rules(evaluate):
    cases = {
        "BEGIN UPDATE t": "UPDATE t",
        "begin try\n update t": "update t",
        "END TRY BEGIN CATCH SELECT 1": "SELECT 1",
        "BEGIN TRAN": "",
        "END": "",
        "BEGIN TRYX": "TRYX",
        "ENDING x": "ENDING x",
        "END END BEGIN x": "x",
    }
    assert evaluate(text.clean_for_rules("s"), list(cases)) == list(cases.values())


def test_clean_for_summary(evaluate):
    cases = {
        "END": "",
        " end ": "",
        "BEGIN": "BEGIN",
        "BEGIN\n SELECT  1": "SELECT 1",
        "BEGIN TRY\n x": "BEGIN TRY\n x",
        "BEGIN BEGIN x": "BEGIN x",
        "BEGIN TRYING": "TRYING",
        "SELECT  1": "SELECT  1",
        "END TRY": "END TRY",
    }
    assert evaluate(text.clean_for_summary("s"), list(cases)) == list(cases.values())


def test_keys_and_nodes(evaluate):
    names = ["dbo.SP_A", "[x] y--z", "__A__", "Ü-1"]
    assert evaluate(identifiers.report_key("s"), names) == ["dbo.sp_a", "x_y--z", "a", "-1"]
    assert evaluate(identifiers.file_stem("s"), ["/a/b.c.sql", "x.SQL", "/a/.sql", "/a/"]) == [
        "b.c",
        "x",
        ".sql",
        "unknown_procedure",
    ]
    assert evaluate(identifiers.node_id("s"), ["dbo.T", "#t", "a[", "..."]) == [
        "N_dbo_T",
        "N__t",
        "N_a",
        "N",
    ]
    assert evaluate(identifiers.is_external("s"), ["a.b.c.d", "a..c.d", "a.b.c"]) == [
        True,
        False,
        False,
    ]


# Random texts against plain definitions: a character lies in a literal if an odd number of
# quotes stands before it.

PIECES = ["'", '"', "[", "]", "-", "--", "/", "*", "/*", "*/", ";", "\n", "GO", "\nGO\n", " ", "a", "\r\n"]
TEXTS = st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=60, max_size=60)
RANDOM = settings(
    max_examples=8, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True
)


def quotes_before(value):
    return [value[:i].count("'") for i in range(len(value) + 1)]


@RANDOM
@given(TEXTS)
def test_blank_literals_at_random(evaluate, values):
    def plain(value):
        inside = quotes_before(value)
        return "".join(
            c if c == "\n" or (c != "'" and inside[i] % 2 == 0) else " "
            for i, c in enumerate(value)
        )

    assert evaluate(text.blank_literals("s"), values) == [plain(v) for v in values]


@RANDOM
@given(TEXTS)
def test_split_at_random(evaluate, values):
    def plain(value):
        value = value.replace("\r\n", "\n")
        inside = quotes_before(value)
        at, cut = 0, [";" == c and inside[i] % 2 == 0 for i, c in enumerate(value)]
        for line in value.split("\n"):
            if line.strip().upper() == "GO" and inside[at] % 2 == 0:
                cut[at : at + len(line)] = [True] * len(line)
            at += len(line) + 1
        marked = "".join("\0" if cut[i] else c for i, c in enumerate(value))
        return [s.strip() for s in marked.split("\0") if s.strip()]

    assert evaluate(text.split_code("s"), values) == [plain(v) for v in values]


@RANDOM
@given(TEXTS)
def test_strip_comments_at_random(evaluate, values):
    token = re.compile(
        r"""'[^']*'?|"[^"]*"?|\[(?:\]\]|[^\]])*\]?|--[^\n]*|/\*.*?\*/|/\*.*(?=.\Z)|/\*|.""", re.S
    )

    def plain(value):
        kept = []
        for t in token.findall(value):
            if t.startswith("/*"):
                t = "\n" * t.count("\n")
            kept.append("" if t.startswith("--") else t)
        return "".join(kept)

    assert evaluate(text.strip_comments("s"), values) == [plain(v) for v in values]
