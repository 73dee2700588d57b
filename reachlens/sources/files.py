"""File readers: full tables, text copies, CSV files with and without header."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachlens import schemas
from reachlens.session import materialize

_RECORD, _FILE, _REASON = "__record", "__file", "__reason"


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text; a missing value stays missing."""
    return df.select([F.col(name).cast("string").alias(name) for name in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV with quoted fields; the schema is always given, never inferred."""
    return spark.read.schema(schema).option("quote", '"').option("escape", '"').csv(path, header=header)


@dataclass(frozen=True)
class Checked:
    """Rows that can be used, and those that can't, with the raw ``record``, the ``reason`` and the place they came from."""

    good: DataFrame
    rejects: DataFrame


def checked_csv(
    spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = (), header: bool = True
) -> Checked:
    """CSV rows, apart from those that do not fit the schema or lack a required value.

    Both frames come from one pass over the files, written to the shared folder, as the parser tells faulty records only
    while it reads whole rows. ``rejects`` has ``file, record, reason``; with several reasons the first in order of the columns is given.
    """
    faulty = T.StructField(_RECORD, T.StringType())
    reader = spark.read.schema(T.StructType([*schema, faulty])).option("quote", '"').option("escape", '"')
    raw = reader.option("columnNameOfCorruptRecord", _RECORD).csv(path, header=header)
    reason = F.when(F.col(_RECORD).isNotNull(), "does not fit the schema")
    for name in required:
        reason = reason.when(F.col(name).isNull(), f"{name} is missing")
    read = materialize(raw.select("*", F.col("_metadata.file_name").alias(_FILE), reason.alias(_REASON)), "checked")
    columns = schema.fieldNames()
    record = F.coalesce(_RECORD, F.to_csv(F.struct(*columns)))
    bad = read.where(F.col(_REASON).isNotNull())
    rejects = bad.select(F.col(_FILE).alias("file"), record.alias("record"), F.col(_REASON).alias("reason"))
    return Checked(read.where(F.col(_REASON).isNull()).select(*columns), rejects)


def with_footers(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files whose minima, maxima and counts are taken from the footers, without a look at the data.

    That holds for unfiltered aggregates of whole numbers, floating point numbers and dates. The reading session is one of its
    own, so no setting of the caller's changes.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)


def network_colors(spark: SparkSession, path: str) -> DataFrame:
    """``Network, HexCode`` with a header; network names in lower case."""
    return read_csv(spark, path, schemas.NETWORK_COLORS).withColumn("Network", F.lower("Network"))


def reference_cells(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Distinct cells of a channel reference file whose audience name starts with ``prefix``."""
    return (
        read_csv(spark, path, schemas.REF_CH_GROUP_TG_MKT)
        .where(F.col("TG_DISPLAY_NAME").startswith(prefix))
        .select("TG_MARKET_DISPLAY_NAME", "TG_KEY", "MARKET_KEY")
        .distinct()
    )


def search_terms(spark: SparkSession, path: str) -> DataFrame:
    """One search term per line, no header."""
    return read_csv(spark, path, schemas.SEARCH_TERMS, header=False)


def news_items(spark: SparkSession, path: str) -> DataFrame:
    """News rows without header, publish date as text."""
    return read_csv(spark, path, schemas.NEWS_TEXT, header=False)


def table_or(spark: SparkSession, name: str, otherwise: DataFrame) -> DataFrame:
    """A precomputed table when it exists, else the given frame."""
    return spark.table(name) if spark.catalog.tableExists(name) else otherwise
