"""Table writers: replace a table, replace single weeks, append, insert-ignore, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachlens.session import materialize, scratch_name, scratch_path, shared_folder

WEEK = "WEEK_KEY"
#: Partitions named one by one in a filter; thirteen years of days.
MOST_PARTITIONS = 5000
CHANNEL = "CHANNEL_GROUP_KEY"
#: A column of an arranged fact, and the shuffle partitions for which it has one value more.
SLICE = "SLICE"
SLICED = 50
#: Buckets of an arranged fact for each shuffle partition.
FINER = 4
CELL_ORDER = (WEEK, "TG_KEY", "MARKET_KEY", "ADVERTISERS_GROUP_KEY")


def scratch_database(spark: SparkSession, label: str) -> str:
    """A fresh database whose tables lie in the shared folder."""
    name = scratch_name(label)
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{shared_folder(spark)}/reachlens/{name}'")
    return name


def in_cell_order(df: DataFrame) -> DataFrame:
    """Rows of a file by week, cell and advertiser, as far as the table has them.

    A request reads two cells and one advertiser; in this order the minima and maxima in the Parquet
    files let it skip the rest.
    """
    return df.sortWithinPartitions(*[name for name in CELL_ORDER if name in df.columns])


def by_week(df: DataFrame) -> DataFrame:
    """Rows as they are written by week.

    They are rebalanced by week first: adaptive execution then joins small partitions and splits a large one over
    several tasks, so files have an even size whatever the week holds. Rows made from an arranged fact lie together by week
    already and are not moved again.
    """
    if SLICE in df.columns:
        return in_cell_order(df.drop(SLICE))
    return in_cell_order(df.hint("rebalance", F.col(WEEK)))


def arranged(fact: DataFrame) -> DataFrame:
    """The fact written once, bucketed by week and ``SLICE``, which follows from the channel.

    Roll-ups that have both in their keys are made from it, and written by week, without another shuffle. Slices keep a large
    week from being one task; as the number of shuffle partitions is what a session is set to for its data, there
    is a slice for every ``SLICED`` of them. Weeks are few and do not spread evenly, and a task aggregates and sorts all weeks of its
    bucket; so there are ``FINER`` times as many buckets, which keeps the fullest of them in memory.
    """
    spark = fact.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, partitions // SLICED)
    buckets = min(partitions * FINER, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    rows = fact.withColumn(SLICE, F.pmod(F.hash(CHANNEL), F.lit(slices))).repartition(buckets, WEEK, SLICE)
    table = f"{scratch_database(spark, 'fact')}.arranged"
    rows.write.bucketBy(buckets, WEEK, SLICE).sortBy(WEEK, CHANNEL).format("parquet").saveAsTable(table)
    return spark.table(table)


def replace_table(df: DataFrame, table: str, partition: str | None = None) -> None:
    """Create the table anew, with a partition column in files of even size."""
    if partition:
        df = by_week(df)
    writer = df.write.mode("overwrite").format("parquet")
    if partition:
        writer = writer.partitionBy(partition)
    writer.saveAsTable(table)


def replace_weeks(df: DataFrame, table: str, weeks: Sequence[int]) -> None:
    """Replace the rows of ``weeks`` in a table partitioned by week; other weeks stay untouched.

    ``df`` holds the new rows of those weeks. The overwrite runs in a session of its own, whose setting replaces only
    partitions that get rows, so writers next to it keep theirs. Weeks that end up empty lose their partition
    in one statement.
    """
    spark = df.sparkSession
    wanted = sorted({int(week) for week in weeks})
    chosen, path = df.where(F.col(WEEK).isin(wanted)).select(*spark.table(table).columns), scratch_path(spark, "weeks")
    chosen.write.parquet(path)
    own = spark.newSession()
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows = own.read.schema(chosen.schema).parquet(path)
    filled = {row[0] for row in rows.select(WEEK).distinct().collect()}
    if filled:
        in_cell_order(rows.hint("rebalance", F.col(WEEK))).write.mode("overwrite").insertInto(table)
    if empty := [week for week in wanted if week not in filled]:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION ({WEEK} = {week})" for week in empty))
    spark.catalog.refreshTable(table)


def create_if_missing(spark: SparkSession, table: str, schema: T.StructType, partition: Sequence[str] = ()) -> None:
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    partitioned = f" PARTITIONED BY ({', '.join(partition)})" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{partitioned}")


def append(df: DataFrame, table: str, partition: str | None = None) -> None:
    """Add rows to the table.

    With the table's partition column, rows are dealt by it first, so a partition gets one file and not one from every task.
    The number of tasks is stated: making files is the cost of many small partitions, and adaptive execution, which
    looks at bytes, would leave all of them to one task.
    """
    spark = df.sparkSession
    df = df.select(*spark.table(table).columns)
    if partition:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), partition)
    df.write.insertInto(table)


def insert_ignore(df: DataFrame, table: str, key: Sequence[str], prune: str | None = None) -> None:
    """Append the rows whose key is not in the table yet, each key once.

    ``prune`` names a partition column that follows from the key. The new rows are computed once and written to the
    shared folder; the distinct partitions they fall into go into the filter of the table as literals, so
    other partitions are not even listed as input, however far apart the new ones lie.
    """
    rows = materialize(df.dropDuplicates(list(key)), "new-rows")
    archived = df.sparkSession.table(table)
    if prune:
        archived = in_partitions_of(archived, rows, prune)
        if archived is None:
            return
    append(rows.join(archived.select(*key), list(key), "left_anti"), table, prune)


def in_partitions_of(df: DataFrame, rows: DataFrame, column: str, most: int = MOST_PARTITIONS) -> DataFrame | None:
    """Rows of ``df`` in the partitions that ``rows`` fall into; None if there are none.

    The values are literals, which prune partitions. There is one for each partition, not for each row, and beyond ``most`` of them
    their span is taken instead, so the filter stays bounded.
    """
    found = [row[0] for row in rows.select(column).dropna().distinct().limit(most + 1).collect()]
    if not found:
        return None
    if len(found) > most:
        return between(df, column, *rows.agg(F.min(column), F.max(column)).first())
    return df.where(F.col(column).isin(sorted(found)))


def between(df: DataFrame, column: str, first: object, last: object) -> DataFrame:
    """Rows from ``first`` to ``last``, as literals that prune partitions."""
    return df.where((F.col(column) >= F.lit(first)) & (F.col(column) <= F.lit(last)))


def _csv_options() -> dict[str, str | bool]:
    """Quotes are doubled and outer blanks are kept, so that text comes back as it was."""
    return {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV files at a new path."""
    df.write.mode("errorifexists").options(**_csv_options()).csv(path, header=header)


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to header-less CSV files."""
    df.write.mode("append").options(**_csv_options()).csv(path, header=False)
