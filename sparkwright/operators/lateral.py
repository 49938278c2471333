"""Errors as a table function, for SQL: ``SELECT ... FROM t, LATERAL row_errors(errors)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from sparkwright.operators.checks import ERRORS


@udtf(returnType="column string, error_type string, message string")
class RowErrors:
    """One row for each error of a checked row, in the order of the checks; a null or
    empty list gives none.  What is wrong with a row is found by ``checks.check``,
    inside the engine; this only hands it out."""

    def eval(self, errors: list) -> Iterator[tuple]:
        for e in errors or ():
            yield e["column"], e["error_type"], e["message"]


def register_errors(spark: SparkSession, name: str = "row_errors") -> None:
    """Makes the table function known to a session's SQL."""
    spark.udtf.register(name, RowErrors)


def error_rows(checked: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of checked rows beside each of their errors, through SQL."""
    spark = checked.sparkSession
    register_errors(spark)
    kept = "".join(f"t.`{c}`, " for c in keep)
    return spark.sql(f"SELECT {kept}e.* FROM {{t}} AS t, LATERAL row_errors(t.`{ERRORS}`) AS e", t=checked.select(*keep, ERRORS))
