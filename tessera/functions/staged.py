"""Expressions in steps.

A formula is a list of steps, each a dict of name -> SQL expression over the
columns so far. Steps become projections that Catalyst keeps apart where a
value is used more than once, so that whole-stage code computes it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

Steps = list[dict[str, str]]


def apply(df: DataFrame, steps: Steps) -> DataFrame:
    """df with the columns of all steps."""
    for step in steps:
        df = df.withColumns({name: F.expr(text) for name, text in step.items()})
    return df


def matching(df: DataFrame, steps: Steps, condition: str) -> DataFrame:
    """Rows of df that meet a condition over the steps' columns.

    The optimizer would push the condition below the steps, which writes every
    step out in full wherever it is used: far beyond what the JIT compiles. A
    nondeterministic column that the condition reads keeps it where it is.
    """
    first, *rest = steps
    made = apply(df, [first | {"_lane": "spark_partition_id()"}, *rest])
    return made.where(f"({condition}) and _lane >= 0").drop("_lane")


def nested_sql(inner: str, steps: Steps) -> str:
    """The same as text: SELECT *, ... over SELECT *, ... over inner."""
    for step in steps:
        inner = "select *, " + ", ".join(f"{text} as {name}" for name, text in step.items()) + f" from ({inner}) as q"
    return inner
