"""Documents as data: JSON, YAML and CSV in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encodings import yaml_marshal, yaml_unmarshal


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, whole: bool = False) -> DataFrame:
    """A row for each line, or for each file if whole; _corrupt holds text that is no such JSON. The schema is not guessed from the data."""
    wide = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("_corrupt", "string")
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", whole).json(path)


def read_json_variant(spark: SparkSession, path: str) -> DataFrame:
    """path and value, a variant: fields that are null stay apart from absent ones, and long integers stay exact."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("value"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"').csv(path)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """path and value, a variant, for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), yaml_unmarshal(F.col("value")).alias("value"))


def with_origin(df: DataFrame, name: str = "origin") -> DataFrame:
    """df, read from files, with the folder that each row comes from."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1))


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of rows that stand in the program."""
    return spark.createDataFrame(rows, schema)


def exported(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that can be written, rows that lack a required field): what is incomplete is not exported."""
    whole = F.lit(True)
    for name in required:
        whole = whole & F.col(name).isNotNull()
    return df.where(whole), df.where(~whole)


def json_lines(df: DataFrame, sort: bool = True) -> DataFrame:
    """value: a line of compact JSON for each row, without its absent fields."""
    names: list[Column] = [F.col(f"`{n}`") for n in (sorted(df.columns) if sort else df.columns)]
    return df.select(F.to_json(F.struct(*names)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def write_yaml(df: DataFrame, path: str) -> None:
    """A document for each row, with a line of three dashes ahead."""
    df.select(F.concat(F.lit("---\n"), yaml_marshal(F.struct(*df.columns))).alias("value")).write.text(path)
