"""Continuous news archive: feed documents in, deduplicated items appended to the archive table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reachlens.operators import news
from reachlens.schemas import FEED, NEWS_KEY
from reachlens.session import materialize

_ARRIVED = "arrived"


def unseen(items: DataFrame, remembered: str) -> DataFrame:
    """Complete items whose key has not arrived within ``remembered``, by keyed state that expires.

    The clock is that of arrival, the moment of the micro-batch, and not the day of publication: an item that turns up
    years late has arrived just now, so the watermark never drops it. A replayed batch has the moment it had before.
    """
    complete = items.select(*NEWS_KEY).dropna().withColumn(_ARRIVED, F.current_timestamp())
    return complete.withWatermark(_ARRIVED, remembered).dropDuplicatesWithinWatermark(list(NEWS_KEY)).drop(_ARRIVED)


def start(
    spark: SparkSession,
    feeds_path: str,
    table: str,
    checkpoint: str,
    remembered: str = f"{news.FRESH_DAYS} days",
    files_per_batch: int | None = None,
    tested: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Read all feed files that are there and archive their items, then stop.

    Feeds are fetched again and again, so most items are repeats. Those of the last ``remembered`` end at the state and never
    cost a look into the archive. What passes is compared with the archive itself, whatever its day, so an item
    whose state has expired is not archived twice, and a batch that runs again after a failure adds nothing. ``tested`` gets what passes, with
    the number of the batch. The state has a key for each item of the last ``remembered``, dealt over the shuffle
    partitions; on a cluster give the session the RocksDB state store, which keeps it on disk. The stream writes in a session of its
    own: who has read the table before refreshes it to see what was added.
    """

    def archive(batch: DataFrame, number: int) -> None:
        passed = materialize(batch, "passed") if tested else batch  # the state is asked once
        news.archive_items(passed, table)
        if tested:
            tested(passed, number)

    reader = spark.readStream.schema(FEED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        unseen(news.items(reader.parquet(feeds_path)), remembered)
        .writeStream.foreachBatch(archive)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
