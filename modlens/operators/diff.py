"""Differences between two versions of modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions.core import text
from modlens.operators.dependencies import objects_of
from modlens.operators.rules import RULES, risk_level
from modlens.plans.analyze import analyze
from modlens.sources.config import RuleConfig

# Sets compared, with the category names of their additions and removals.
CATEGORIES = [
    "parameters",
    "tables_read",
    "tables_written",
    "procedures_executed",
    "temp_tables",
    "risks",
]


def _side(traces: DataFrame, key: str, side: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the comparison needs of a trace; the module text stays behind."""
    parameter = F.expr(
        "transform(parameters, p -> concat(p.name, ' ', p.data_type,"
        " coalesce(concat(' = ', p.default_value), '')))"
    )
    return traces.select(
        F.col("module_id").alias(key),
        F.struct(
            "name",
            "metrics",
            F.size("temp_tables").alias("temp_table_count"),
            F.size("rule_ids").alias("risk_count"),
            parameter.alias("parameters"),
            F.expr(objects_of("dependencies", "Read")).alias("tables_read"),
            F.expr(objects_of("dependencies", "Write")).alias("tables_written"),
            F.expr(objects_of("dependencies", "Execute")).alias("procedures_executed"),
            F.col("temp_tables").alias("temp_tables"),
            # Ids travel; their messages are put behind them in the result.
            F.col("rule_ids").alias("risks"),
        ).alias(side),
        *keep,
    )


_MESSAGES = " ".join(
    f"WHEN '{rule.rule_id}' THEN {text(f'{rule.rule_id}: {rule.message}')}" for rule in RULES
)


def _difference(left: str, right: str, field: str) -> Column:
    """Sorted distinct elements of one side's set that the other side's lacks."""

    def members(side: str) -> str:
        return f"coalesce({side}.{field}, cast(array() AS array<string>))"

    items = f"sort_array(array_distinct(array_except({members(left)}, {members(right)})))"
    if field == "risks":
        items = f"transform({items}, r -> CASE r {_MESSAGES} END)"
    return F.expr(items)


def _compare(joined: DataFrame) -> DataFrame:
    """``pair_id, before, after`` to one wide row of deltas and changed sets."""

    def delta(field: str) -> Column:
        return F.coalesce(F.col(f"after.{field}"), F.lit(0)) - F.coalesce(
            F.col(f"before.{field}"), F.lit(0)
        )

    changes = []
    for field in CATEGORIES:
        changes += [
            _difference("after", "before", field).alias(f"{field}_added"),
            _difference("before", "after", field).alias(f"{field}_removed"),
        ]
    return joined.select(
        "pair_id",
        F.when(F.col("before").isNull() & F.col("after").isNull(), "missing")
        .when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .otherwise("paired")
        .alias("presence"),
        F.col("before.name").alias("before_procedure"),
        F.col("after.name").alias("after_procedure"),
        F.col("before.metrics.risk_level").alias("before_risk_level"),
        F.col("after.metrics.risk_level").alias("after_risk_level"),
        delta("metrics.statement_count").alias("statement_delta"),
        delta("metrics.read_count").alias("read_delta"),
        delta("metrics.write_count").alias("write_delta"),
        delta("temp_table_count").alias("temp_table_delta"),
        delta("risk_count").alias("risk_delta"),
        F.coalesce("before.risk_count", F.lit(0)).alias("before_risk_count"),
        F.coalesce("after.risk_count", F.lit(0)).alias("after_risk_count"),
        *changes,
    )


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two snapshots' traces on ``module_id``, which is unique in each.

    One full outer join of compact rows. To compare modules by anything that may repeat, a
    name for instance, name the pairs (:func:`diff_pairs`).
    """
    return _compare(
        _side(before, "pair_id", "before").join(
            _side(after, "pair_id", "after"), "pair_id", "full_outer"
        )
    )


def _unchanged(traces: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """The comparison of modules whose text is the same on both sides, from one trace.

    Only the name and the broken rules are looked at: the analysis of all else is pruned.
    """
    no_names = F.array().cast("array<string>")
    no_counts = F.struct(
        *[F.lit(0).alias(c) for c in ("statement_count", "read_count", "write_count")],
        # Not the level in the metrics: that would keep the counts next to it, and what they count.
        risk_level(F.col("rule_ids"), config).alias("risk_level"),
    )
    side = F.struct(
        "name",
        no_counts.alias("metrics"),
        F.lit(0).alias("temp_table_count"),
        F.size("rule_ids").alias("risk_count"),
        *[no_names.alias(c) for c in CATEGORIES],
    )
    return _compare(traces.select(F.col("module_id").alias("pair_id"), side.alias("before"), side.alias("after")))


def diff_modules(before: DataFrame, after: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """:func:`diff_snapshots` from module texts, of which only the changed ones are compared.

    Both snapshots meet by module in one shuffle. A module whose text is equal on both sides is
    analyzed once and for its name and rules only; the others in full, both versions in the
    partition where they met, so that their comparison needs no further shuffle. ``module_id``
    is unique in each snapshot; of repeated rows the greatest text counts.
    """
    spark = before.sparkSession
    # A number of partitions that is given stays: texts are small for the work on them, and adaptive
    # execution, which looks at bytes, would put them into a few tasks.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    both = (
        before.select("module_id", F.lit(0).alias("side"), "sql")
        .unionByName(after.select("module_id", F.lit(1).alias("side"), "sql"))
        .repartition(parts, "module_id")
        .groupBy("module_id")
        .agg(*[F.max(F.when(F.col("side") == k, F.col("sql"))).alias(c) for k, c in enumerate(("b", "a"))])
    )
    same = both.where("a = b").select("module_id", F.col("a").alias("sql"))
    versions = F.filter(
        F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("sql")) for k, c in enumerate(("b", "a"))]),
        lambda v: v["sql"].isNotNull(),
    )
    changed = both.where("NOT a <=> b").select("module_id", F.explode(versions).alias("v"))
    traces = analyze(changed.select("module_id", "v.side", "v.sql"), config, keep=("side",))
    sides = _side(traces, "pair_id", "one", keep=("side",)).groupBy("pair_id")
    pairs = sides.agg(
        *[F.first(F.when(F.col("side") == k, F.col("one")), ignorenulls=True).alias(c) for k, c in enumerate(("before", "after"))]
    )
    return _compare(pairs).unionByName(_unchanged(analyze(same, config), config))


#: A module in more pairs than this is joined in ``SALTS`` parts.
HOT_PAIRS, SALTS = 100_000, 64


def _attach(pairs: DataFrame, side: DataFrame, key: str, hot_pairs: int) -> DataFrame:
    """Left join of pairs with a module side that has one row per key, hot keys in parts.

    Only hot keys are broadcast, which are fewer than the pairs divided by ``hot_pairs``. The
    side comes from the analysis, whose size no estimate knows, so it is never broadcast.
    """
    counted = pairs.groupBy(key).agg(F.count("*").alias("n"))
    hot = F.broadcast(counted.where(F.col("n") > hot_pairs).select(key, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("pair_id"), F.lit(SALTS))).otherwise(F.lit(0))
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    left = pairs.join(hot, key, "left").withColumn("salt", salt.cast("int")).drop("hot")
    right = side.join(hot, key, "left").withColumn("salt", F.explode(copies)).drop("hot")
    return left.join(right.hint("merge"), [key, "salt"], "left").drop("salt")


def diff_pairs(traces: DataFrame, pairs: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Compare the modules of each row of ``pair_id, before_id, after_id``.

    Any two modules can be paired, one module in many pairs: see :func:`_attach`.
    """
    pairs = pairs.select("pair_id", "before_id", "after_id")
    first = _attach(pairs, _side(traces, "before_id", "before"), "before_id", hot_pairs)
    return _compare(_attach(first, _side(traces, "after_id", "after"), "after_id", hot_pairs))


def diff_changes(diff: DataFrame) -> DataFrame:
    """Long form: ``pair_id, category, change, item``."""
    entries = ", ".join(
        f"transform({field}_{change}, x -> named_struct('category', '{field}',"
        f" 'change', '{change}', 'item', x))"
        for field in CATEGORIES
        for change in ("added", "removed")
    )
    return (
        diff.select("pair_id", F.explode_outer(F.expr(f"concat({entries})")).alias("c"))
        .filter(F.col("c").isNotNull())
        .select("pair_id", "c.*")
    )
