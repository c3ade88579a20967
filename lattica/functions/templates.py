"""Functions that a user defines once and calls by name: as SQL functions, which Spark inlines into the plan, so that they cost nothing."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _parameters(parameters: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in parameters.items())


def define(spark: SparkSession, name: str, parameters: dict[str, str], returns: str, body: str) -> None:
    """A function of columns for this session: F.call_function(name, ...) or in SQL. Arguments are cast to their kinds; other numbers of
    arguments, and ones that can't be cast, are errors when a query is analysed."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({_parameters(parameters)}) RETURNS {returns} RETURN {body}")


def define_table(spark: SparkSession, name: str, parameters: dict[str, str], columns: dict[str, str], query: str) -> None:
    """A function that gives rows, to be called in FROM; with LATERAL, once for each row that stands before it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({_parameters(parameters)}) RETURNS TABLE({_parameters(columns)}) RETURN {query}")
