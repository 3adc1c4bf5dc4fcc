"""Functions that the dialect's users call: vectors as arrays, and balance helpers, all as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BALANCE = "RETURN CASE WHEN old = 0D AND new = 0D AND amount <> 0D THEN -1D ELSE {} END"
FUNCTIONS = {
    "vec_dense(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "RETURN v",
    "vec_max(v ARRAY<DOUBLE>) RETURNS DOUBLE": "RETURN array_max(v)",
    "vec_argmax(v ARRAY<DOUBLE>) RETURNS INT": "RETURN CAST(array_position(v, array_max(v)) - 1 AS INT)",
    "getTypeCode(t STRING) RETURNS INT": "RETURN CASE WHEN t = 'TRANSFER' THEN 0 ELSE 1 END",
    "getOldBalanceOrigValue(old DOUBLE, new DOUBLE, amount DOUBLE) RETURNS DOUBLE": _BALANCE.format("old"),
    "getNewBalanceOrigValue(old DOUBLE, new DOUBLE, amount DOUBLE) RETURNS DOUBLE": _BALANCE.format("new"),
    "getOldBalanceDestValue(old DOUBLE, new DOUBLE, amount DOUBLE) RETURNS DOUBLE": _BALANCE.format("old"),
    "getNewBalanceDestValue(old DOUBLE, new DOUBLE, amount DOUBLE) RETURNS DOUBLE": _BALANCE.format("new"),
}


def macros(spark: SparkSession, bodies: dict[str, tuple[str, str]]) -> list[str]:
    """Registers functions by name, parameters and body, for the session; a body's type is that of its result on nulls."""
    for name, (parameters, body) in bodies.items():
        typed = ", ".join(f"CAST(NULL AS {p.split(None, 1)[1]}) AS {p.split(None, 1)[0]}" for p in parameters.split(","))
        result = spark.sql(f"SELECT {body} AS r FROM (SELECT {typed})").schema[0].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(bodies)


def register_all(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
