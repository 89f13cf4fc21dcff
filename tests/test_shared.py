"""Analysis by content, and diffs that look at changed texts only."""

import json

from golden import GOLDEN

from modlens import analyze, schemas
from modlens.operators import diff
from modlens.plans import documents
from modlens.plans.shared import analyze_shared

RICH = (
    "CREATE PROC dbo.p{n} @a INT = {n} AS\nSELECT * FROM t{n} WITH (NOLOCK);\nUPDATE u SET STATUS = 1;\n"
    "INSERT INTO #x SELECT c FROM v JOIN w ON v.k = w.k;\nEXEC dbo.q{n};"
)


def frame(spark, rows):
    return spark.createDataFrame([(i, f"/src/{i}.sql", "s1", sql) for i, sql in rows], schemas.MODULES)


def plain(rows):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in rows)


def test_each_text_is_analyzed_once(spark, tmp_path):
    """Nine of ten modules repeat a text; names that a text lacks come from the module's own file."""
    texts = [*GOLDEN.values(), *(RICH.format(n=n) for n in range(12)), "", "SELECT 1"]
    rows = [(f"m{k}", texts[k % len(texts)]) for k in range(10 * len(texts))]
    rows += [(f"hot{k}", "SELECT a FROM b") for k in range(300)]
    modules = frame(spark, rows).repartition(7)
    folder = str(tmp_path / "texts")
    found = analyze_shared(modules, folder=folder, hot_texts=50)
    assert spark.read.parquet(folder).count() == len({sql for _, sql in rows})
    assert plain(found.drop("copies").collect()) == plain(analyze(modules).collect())
    copies = {r.module_id: r.copies for r in found.select("module_id", "copies").collect()}
    assert copies["hot7"] == 300 and copies["m3"] == 10
    unnamed = found.where("module_id IN ('hot1', 'hot2')").select("procedure").collect()
    assert sorted(r.procedure for r in unnamed) == ["hot1", "hot2"]


def test_null_texts_and_empty_tables(spark):
    modules = frame(spark, [("a", None), ("b", "SELECT 1")]).drop("path", "snapshot")
    assert [r.module_id for r in analyze_shared(modules).collect()] == ["b"]
    assert analyze_shared(modules.limit(0)).collect() == []


def versions(spark):
    before = [(f"m{k}", RICH.format(n=k)) for k in range(40)]
    after = [(f"m{k}", RICH.format(n=k + 1) if k % 10 == 0 else RICH.format(n=k)) for k in range(5, 45)]
    before += [("x", "SELECT 1"), ("y", ""), ("z", GOLDEN["basic"])]
    after += [("x", "SELECT 1 "), ("y", ""), ("z", GOLDEN["edges"] if "edges" in GOLDEN else "DELETE FROM t")]
    return frame(spark, before), frame(spark, after)


def test_diff_by_text_equals_diff_of_all(spark):
    before, after = versions(spark)
    by_text = diff.diff_modules(before, after)
    assert plain(by_text.collect()) == plain(diff.diff_snapshots(analyze(before), analyze(after)).collect())
    assert diff.diff_modules(before.limit(0), after.limit(0)).collect() == []
    assert {r.presence for r in diff.diff_modules(before.limit(0), after).collect()} == {"added"}


def test_unchanged_modules_cost_no_extraction(spark):
    """The branch of equal texts finds no dependencies, parameters or statements."""
    before, _ = versions(spark)
    same = diff._unchanged(analyze(before))._jdf.queryExecution().optimizedPlan().toString()
    assert "select_star" in same
    assert "Execute" not in same and "= Write" not in same


def test_documents_of_a_diff(spark):
    before, after = versions(spark)
    found = documents.diff_documents(diff.diff_modules(before, after), "concat(pair_id, '@1')", "concat(pair_id, '@2')")
    docs = {r.pair_id: r for r in found.collect()}
    changed, added = docs["m10"], docs["m44"]
    assert changed.diff_md.startswith("# Module Diff Report\n\n## Overview\n- Before: m10@1\n- After: m10@2\n")
    assert "### New Tables Read\n- t11\n### Removed Tables Read\n- t10\n" in changed.diff_md
    assert "### Added\n- @a INT = 11\n### Removed\n- @a INT = 10\n" in changed.diff_md
    assert "- Before Procedure: Unknown\n- After Procedure: dbo.p44\n- Before Risk Level: None\n" in added.diff_md
    value = json.loads(added.diff_json)
    assert value["overview"]["before_procedure"] is None and value["change_summary"]["statement_delta"] == 4
    assert value["dependency_changes"]["new_procedures_executed"] == ["dbo.q44"]
    assert value["risk_changes"]["before_count"] == 0 and value["risk_changes"]["after_count"] == len(value["risk_changes"]["added"])
    quiet = json.loads(docs["m11"].diff_json)
    assert set(quiet["change_summary"].values()) == {0} and quiet["overview"]["after_risk_level"] == "High"
    assert list(quiet) == ["overview", "change_summary", "parameter_changes", "dependency_changes", "temp_table_changes", "risk_changes"]
