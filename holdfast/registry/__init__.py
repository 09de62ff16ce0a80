"""Named queries over the star tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.registry import ingestion, marts, operations, reads, scoring, text
from holdfast.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (marts, reads, scoring, operations, text, ingestion)


def _shown(df: DataFrame) -> DataFrame:
    """Dates as ISO text, the form in which the read side hands them out."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({name: F.col(name).cast("string") for name in dates}) if dates else df


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(query(prepare(spark), sf_dir))

    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
