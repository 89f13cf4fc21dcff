import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modlens.operators.dependencies import statement_hits


def deps(trace):
    return [(d.object, d.operation, d.source) for d in trace.dependencies]


def test_names_and_bodies(traces):
    found = traces(
        {
            "create": "CREATE PROCEDURE ops.Nightly\nAS\nBEGIN\nSELECT 7\nEND",
            "alter": "ALTER PROC [ops].[Nightly] AS\nSELECT 8",
            "or_alter": "create or\talter proc [ops].[Monthly_2]\nas SELECT 9",
            "none": " SELECT 1 AS x ",
            "no_as": "CREATE PROC p @a INT",
            "execute_as": "CREATE PROC p WITH EXECUTE AS OWNER AS SELECT 1",
            "exec_as": "CREATE PROC p WITH EXEC AS OWNER AS SELECT 1",
            "param_as": "CREATE PROC p @a AS INT AS SELECT 1",
            "comment": "/* CREATE PROC x AS */ CREATE PROC y -- AS\nAS SELECT 2",
            "nbsp": "CREATE PROC\u00a0p AS SELECT 1 FROM\u00a0t",
            "word": "RECREATE PROC x AS y",
            "empty": "",
        }
    )
    assert {k: t.name for k, t in found.items()} == {
        "create": "ops.Nightly",
        "alter": "ops.Nightly",
        "or_alter": "ops.Monthly_2",
        "none": None,
        "no_as": "p",
        "execute_as": "p",
        "exec_as": "p",
        "param_as": "p",
        "comment": "y",
        "nbsp": "p",
        "word": None,
        "empty": None,
    }
    bodies = {k: t.body for k, t in found.items()}
    assert bodies["create"] == "BEGIN\nSELECT 7\nEND"
    assert bodies["none"] == "SELECT 1 AS x"
    assert bodies["no_as"] == "CREATE PROC p @a INT"
    assert bodies["execute_as"] == "SELECT 1"
    assert bodies["exec_as"] == "OWNER AS SELECT 1"
    assert bodies["param_as"] == "INT AS SELECT 1"
    assert bodies["comment"] == "SELECT 2"
    assert bodies["empty"] == ""
    assert deps(found["nbsp"]) == [("t", "Read", "FROM")]
    assert found["none"].procedure == "none"  # the file stem
    assert found["empty"].metrics.risk_level == "Low"
    assert found["empty"].statements == []


def test_parameters(traces):
    def of(block):
        return f"CREATE PROCEDURE p{block}\nAS\nSELECT 1"

    found = traces(
        {
            "several": of(
                " @Sku CHAR(12),\n @Since DATETIME2 = NULL,\n @Deep BIT = 1"
            ),
            "decimal": of(" @a DECIMAL(10, 2) = 1.5, @b INT"),
            "output": of(" @a INT OUTPUT, @b INT = 2 output, @c INT OUTPUT"),
            "literal": of(" @a VARCHAR(9) = 'x, (@y' , @b CHAR(1) = ','"),
            "readonly": of(" @t dbo.Rows READONLY, @n INT OUT WITH RECOMPILE"),
            "brackets": of(" (@a INT, @b INT)"),
            "nested": of(" @a t(f((1),2), 3) = g((4),(5)), @b INT"),
            "unclosed": of(" @a VARCHAR(20, @b INT"),
            "bare": of(" @a, @b=1, c INT"),
            "empty_default": of(" @a INT = , @b INT"),
            "no_as": "CREATE PROCEDURE p (@a INT, @b CHAR(2) = 'x')",
            "semicolon": of(" @a INT;, @b INT"),
        }
    )

    def params(key):
        return [tuple(p) for p in found[key].parameters]

    assert params("several") == [
        ("@Sku", "CHAR(12)", None),
        ("@Since", "DATETIME2", "NULL"),
        ("@Deep", "BIT", "1"),
    ]
    assert params("decimal") == [("@a", "DECIMAL(10, 2)", "1.5"), ("@b", "INT", None)]
    # AS is still behind the last item when OUTPUT is looked for.
    assert params("output") == [
        ("@a", "INT", None),
        ("@b", "INT", "2"),
        ("@c", "INT OUTPUT", None),
    ]
    assert params("literal") == [("@a", "VARCHAR(9)", "'x, (@y'"), ("@b", "CHAR(1)", "','")]
    assert params("readonly") == [
        ("@t", "dbo.Rows READONLY", None),
        ("@n", "INT OUT WITH RECOMPILE", None),
    ]
    assert params("brackets") == []
    assert params("nested") == [("@a", "t(f((1),2), 3)", "g((4),(5))"), ("@b", "INT", None)]
    assert params("unclosed") == [("@a", "VARCHAR(20, @b INT", None)]
    assert params("bare") == [("@a", "", None), ("@b=1", "", None)]
    assert params("empty_default") == [("@a", "INT", None), ("@b", "INT", None)]
    assert params("no_as") == [("@a", "INT", None), ("@b", "CHAR(2)", "'x'")]
    assert params("semicolon") == [("@a", "INT", None), ("@b", "INT", None)]


def test_parameters_nested_deeply(traces):
    deep = "f(" * 12 + "1, 2 = '),(=''', 3" + ")" * 12
    uneven = "(" * 8 + "x)y(z(u, v = 1" + ")" * 9
    found = traces(
        {
            "deep": f"CREATE PROC p @a t = {deep}, @b INT = 1 OUTPUT, @c CHAR(1) = '=' AS SELECT 1",
            "uneven": f"CREATE PROC p @a t{uneven} = 2, @b INT AS SELECT 1",
            "many": "CREATE PROC p "
            + ", ".join(f"@p{i} DECIMAL({i}, 2) = {i}" for i in range(30))
            + " AS SELECT 1",
        }
    )
    assert [tuple(p) for p in found["deep"].parameters] == [
        ("@a", "t", deep),
        ("@b", "INT", "1"),
        ("@c", "CHAR(1)", "'='"),
    ]
    assert [tuple(p) for p in found["uneven"].parameters] == [
        ("@a", f"t{uneven}", "2"),
        ("@b", "INT", None),
    ]
    assert [tuple(p) for p in found["many"].parameters] == [
        (f"@p{i}", f"DECIMAL({i}, 2)", str(i)) for i in range(30)
    ]


def test_marks_in_the_text(traces):
    sql = f"SELECT '{chr(0xFDD0)}é' FROM a JOIN b ON '{chr(0xFDD1)}' = ''"
    trace = traces({"m": sql})["m"]
    assert [(d.object, d.offset) for d in trace.dependencies] == [("a", 20), ("b", 27)]
    assert trace.body == sql
    marks = "".join(map(chr, range(0xFDD0, 0xFDD6)))
    body = f"PRINT '{marks}'"
    other = traces({"m": f"CREATE PROC p @a CHAR(9) = '{marks},=' AS {body}"})["m"]
    assert (other.body, other.parameters[0].default_value) == (body, f"'{marks},='")
    assert chr(0xFFFD) in traces({"m": "PRINT '" + "".join(map(chr, range(0xFDD0, 0xFDF0))) + "'"})["m"].body


def test_dependencies(traces):
    found = traces(
        {
            "all": """CREATE PROC ops.Sweep @Day DATE WITH EXECUTE AS SELF AS
                MERGE INTO dim.City USING stage.City ON 1 = 1 JOIN ref.Zone ON 2 = 2
                SELECT INTO #Old FROM fact.Trip
                INSERT INTO log.Run SELECT 3 FROM fact.Fare
                UPDATE fact.Seat SET Free = 0 WHERE Free = 1
                DELETE FROM stage.Trip WHERE Day < @Day
                EXECUTE ops.Report""",
            "order": "SELECT 1 FROM later;X FROM b;SELECT 2 FROM later;FROM a",
            "repeat": "SELECT 1 FROM a JOIN a ON 1=1 JOIN a ON 2=2; SELECT 2 FROM a",
            "target": "MERGE INTO t USING t ON 1=1 JOIN t ON 1=1; SELECT 1 FROM t",
            "self": "DELETE t FROM t JOIN u ON 1=1",
            "exec": "EXEC @rc = p; EXECUTE AS USER; exec SP_EXECUTESQL @s; EXEC [a].[b] 1; EXEC self",
            "missed": "SELECT * INTO #t FROM a, b; INSERT c VALUES (1); TRUNCATE TABLE d; DELETE e",
            "alias": "UPDATE x SET a = 1 FROM dbo.[T] x; FROM @v; FROM (SELECT 1)",
            "when": "MERGE INTO t USING s ON 1=1 WHEN MATCHED THEN UPDATE SET a = 1",
            "overlap": "FROM UPDATE x; FROM FROM y; JOIN a.UPDATE z; FROM FROM FROM w",
            "literal": "PRINT 'copied FROM here'; PRINT [FROM x]",
            "word": "SELECT 1 FROMM x XFROM y _FROM z éFROM w",
            "bytes": "SELECT 'ééé' FROM a; SELECT 1234 FROM b",
        }
    )
    assert set(deps(found["all"])) == {
        ("dim.City", "Write", "MERGE INTO"),
        ("stage.City", "Read", "USING"),
        ("ref.Zone", "Read", "JOIN"),
        ("fact.Trip", "Read", "FROM"),
        ("fact.Fare", "Read", "FROM"),
        ("#Old", "Write", "SELECT INTO"),
        ("log.Run", "Write", "INSERT INTO"),
        ("fact.Seat", "Write", "UPDATE"),
        ("stage.Trip", "Write", "DELETE FROM"),
        ("ops.Report", "Execute", "EXEC"),
    }
    # by offset in the statement first
    assert [d.object for d in found["order"].dependencies] == ["a", "b", "later"]
    assert deps(found["repeat"]) == [("a", "Read", "FROM"), ("a", "Read", "JOIN")]
    assert deps(found["target"]) == [
        ("t", "Write", "MERGE INTO"),
        ("t", "Read", "FROM"),
        ("t", "Read", "USING"),
        ("t", "Read", "JOIN"),
    ]
    assert deps(found["self"]) == [("t", "Write", "DELETE FROM"), ("u", "Read", "JOIN")]
    assert deps(found["exec"]) == [("a.b", "Execute", "EXEC")]
    assert deps(found["missed"]) == [("a", "Read", "FROM")]
    assert deps(found["alias"]) == [("x", "Write", "UPDATE"), ("dbo.T", "Read", "FROM")]
    assert ("SET", "Write", "UPDATE") in deps(found["when"])
    assert deps(found["overlap"]) == [
        ("UPDATE", "Read", "FROM"),
        ("FROM", "Read", "FROM"),
        ("a.UPDATE", "Read", "JOIN"),
        ("x", "Write", "UPDATE"),
        ("z", "Write", "UPDATE"),
        ("w", "Read", "FROM"),
    ]
    assert deps(found["literal"]) == [("x", "Read", "FROM"), ("here", "Read", "FROM")]
    assert deps(found["word"]) == []
    # offsets count bytes: 8 + 6 for the literal text
    assert [(d.object, d.offset) for d in found["bytes"].dependencies] == [("b", 17), ("a", 21)]


def test_temp_tables(traces):
    found = traces(
        {
            "two": "CREATE PROC p AS SELECT 4 INTO #Two FROM u; INSERT INTO #One SELECT 1",
            "case": "FROM #a, #A, ##b, '#in_literal'; FROM #a -- #comment",
            "none": "SELECT 1 # 2",
        }
    )
    assert found["two"].temp_tables == ["#One", "#Two"]
    assert found["case"].temp_tables == ["##b", "#A", "#a", "#in_literal"]
    assert found["none"].temp_tables == []


def test_statements(traces):
    found = traces(
        {
            "basic": """CREATE PROC ops.Fill AS BEGIN
                INSERT INTO log.Run SELECT 5 FROM fact.Trip;
                UPDATE fact.Seat SET Free = 0 WHERE Row = 2;
                EXECUTE ops.Report;
                END""",
            "kinds": "SELECT INTO #x; SELECT\nINTO #y; merge into t; EXECUTE p; EXEC p; EXEC(@s);"
            "begin tran; COMMIT; x ROLLBACK; END; DECLARE @a INT; selected; EXEC\tp; BEGIN TRAN x",
            "sources": "INSERT INTO t SELECT 1 FROM a JOIN a ON 1=1 JOIN b ON 2=2; EXEC p; UPDATE u SET x=1",
            "batches": "CREATE PROC a AS SELECT 1 FROM x\nGO\n"
            "CREATE PROC b @p INT = 1 WITH EXECUTE AS OWNER AS UPDATE t SET a=1 FROM y",
        }
    )
    assert [(s.kind, s.target) for s in found["basic"].statements] == [
        ("Insert", "log.Run"),
        ("Update", "fact.Seat"),
        ("Execute", "ops.Report"),
    ]
    assert found["basic"].statements[0].sources == ["fact.Trip"]
    assert [s.kind for s in found["kinds"].statements] == [
        "Insert",
        "Select",
        "Merge",
        "Execute",
        "Execute",
        "Unknown",
        "Transaction",
        "Transaction",
        "Transaction",
        "Unknown",
        "Select",
        "Unknown",
        "Transaction",
    ]
    assert [s["index"] for s in found["kinds"].statements] == list(range(1, 14))
    assert [(s.target, s.sources) for s in found["sources"].statements] == [
        ("t", ["a", "a", "b"]),
        ("p", []),
        ("u", []),
    ]
    second = found["batches"].statements[1]
    assert (second.kind, second.target, second.sources) == ("Unknown", "t", ["y"])


WORDS = (
    "FROM JOIN USING UPDATE DELETE INSERT SELECT MERGE INTO EXEC execute from as x a.b [c].[d] #t @v "
    "a.FROM b.UPDATE x.INSERT [] . ; 'FROM sp_execute t"
).split()
LINES = st.lists(
    st.lists(
        st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", "\n", "", "  ", ","])), max_size=14
    ).map(lambda parts: "".join(w + gap for w, gap in parts)),
    min_size=80,
    max_size=80,
)
OBJECT = r"([A-Za-z0-9_#@\[\].]+)"
SEARCHES = [
    (r"\bSELECT\s+INTO\s+", "SELECT INTO"),
    (r"\bINSERT\s+INTO\s+", "INSERT INTO"),
    (r"\bUPDATE\s+", "UPDATE"),
    (r"\bDELETE(?:\s+[A-Za-z0-9_#@\[\].]+)?\s+FROM\s+", "DELETE FROM"),
    (r"\bMERGE\s+INTO\s+", "MERGE INTO"),
    (r"\bFROM\s+", "FROM"),
    (r"\bJOIN\s+", "JOIN"),
    (r"\bUSING\s+", "USING"),
    (r"\bEXEC(?:UTE)?\s+", "EXEC"),
]
NO_PROCEDURE = {"as", "caller", "owner", "self", "sp_executesql", "sp_prepare", "sp_execute"}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(LINES)
def test_references_at_random(spark, lines):
    """Each keyword searched on its own, against the single marked pass."""

    def plain(line):
        hits = []
        for keyword, source in SEARCHES:
            for m in re.finditer(keyword + OBJECT, line, re.I):
                raw = m.group(1)
                name = ".".join(part.strip("[]") for part in raw.split("."))
                if raw.startswith("@") or not name:
                    continue
                if source == "EXEC" and raw.lower() in NO_PROCEDURE:
                    continue
                hits.append((m.start(1), name, source))
        written = {n for _, n, s in hits if s not in ("FROM", "JOIN", "USING", "EXEC")}
        kept = sorted(h for h in hits if not (h[2] == "FROM" and h[1] in written))
        first = {}
        for at, name, source in kept:
            first.setdefault((name, source), at)
        return sorted((at, name, source) for (name, source), at in first.items())

    rows = spark.createDataFrame(list(enumerate(lines)), "i int, s string").coalesce(1)
    found = rows.select("i", F.expr(statement_hits("s", "1")).alias("h")).collect()
    for row in found:
        got = [(h.offset, h.object, h.source) for h in row.h]
        assert got == plain(lines[row.i]), lines[row.i]


@pytest.mark.parametrize("count", [15, 16, 17, 128, 129, 300])
def test_offsets_of_many_references(traces, count):
    """Short and chunked sums of offsets agree with the text."""
    sql = " ".join(f"FROM t{i}" for i in range(count))
    trace = traces({"m": sql})["m"]
    assert [d.object for d in trace.dependencies] == [f"t{i}" for i in range(count)]
    assert all(sql[d.offset :].split(" ")[0] == d.object for d in trace.dependencies)


def test_reads_of_written_objects_go(traces):
    text = "UPDATE a SET x = 1 FROM a JOIN a ON 1 = 1; DELETE FROM b FROM a; INSERT INTO c SELECT 1 FROM b"
    found = deps(traces({"m": text})["m"])
    assert ("a", "Read", "JOIN") in found and ("a", "Write", "UPDATE") in found
    assert [d for d in found if d[2] == "FROM"] == [("a", "Read", "FROM"), ("b", "Read", "FROM")]
