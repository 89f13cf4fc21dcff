"""Explicit schemas and closed value sets of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

MODULES = T.StructType(
    [
        T.StructField("module_id", T.StringType(), False),
        T.StructField("path", T.StringType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField("sql", T.StringType()),
    ]
)

PAIRS = T.StructType(
    [
        T.StructField("pair_id", T.StringType(), False),
        T.StructField("before_id", T.StringType()),
        T.StructField("after_id", T.StringType()),
    ]
)

RULE_CONFIG = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("severity", T.StringType()),
    ]
)

PARAMETER = "struct<name:string,data_type:string,default_value:string>"
HIT = "struct<offset:int,stmt_index:int,object:string,operation:string,source:string>"

# Fixed values.
SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3}
