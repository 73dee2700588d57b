"""News items: feeds to rows, search terms, freshness and visibility, deduplicated archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlens.functions import news as fields
from reachlens.functions.text import any_of
from reachlens.schemas import ARCHIVE, ARCHIVE_DAY, NEWS_KEY
from reachlens.session import materialize
from reachlens.sources import files, sinks

# Items taken from a feed, freshness and visibility windows, sources not shown.
FEED_ITEMS = 10
FRESH_DAYS = 14
VISIBLE_DAYS = 25 * 7
EXCLUDED_SOURCES = ("moneycontrol.com", "indiainfoline")

_FEED_TYPE = (
    "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string>>>"
)


def items(feeds: DataFrame) -> DataFrame:
    """One row per feed item, with its position in the feed (0 first)."""
    feed = F.from_xml("document", _FEED_TYPE)
    return _item_rows(feeds.select("SearchTerm", "feed_no", F.posexplode(feed["channel"]["item"]).alias("position", "item")))


def _item_rows(exploded: DataFrame) -> DataFrame:
    return exploded.select(
        F.col("item.title").alias("Title"),
        fields.feed_date(F.col("item.pubDate")).alias("PublishDate"),
        fields.link_target(F.col("item.link")).alias("Link"),
        fields.source_name(F.col("item.description")).alias("Source"),
        "SearchTerm",
        "feed_no",
        "position",
    )


def checked_items(feeds: DataFrame) -> files.Checked:
    """Items as ``items`` gives them, apart from feeds and items that can't be used.

    ``rejects`` has ``SearchTerm, feed_no, position, record, reason``: a feed whose document is no XML or has no items, with its document and without
    position, and an item whose date can't be read or whose link has no target, with its fields as JSON. An item
    with several faults is rejected for its date.
    """
    parsed = feeds.withColumn("feed", F.from_xml("document", f"{_FEED_TYPE}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    found = F.col("feed.channel.item")
    reason = F.when(F.col("document").isNull(), "no document").when(F.col("feed._corrupt").isNotNull(), "not XML")
    reason = reason.when(found.isNull() | (F.size(found) == 0), "no items")
    parsed = materialize(parsed.withColumn("reason", reason), "feeds")
    whole = parsed.where(F.col("reason").isNotNull()).select(
        "SearchTerm", "feed_no", F.lit(None).cast("int").alias("position"), F.col("document").alias("record"), "reason"
    )
    each = parsed.where(F.col("reason").isNull()).select("SearchTerm", "feed_no", F.posexplode(found).alias("position", "item"))
    each = each.withColumn(
        "reason",
        F.when(fields.feed_date(F.col("item.pubDate")).isNull(), "date not readable").when(
            fields.link_target(F.col("item.link")).isNull(), "link without target"
        ),
    )
    rejected = each.where(F.col("reason").isNotNull())
    rejected = rejected.select("SearchTerm", "feed_no", "position", F.to_json("item").alias("record"), "reason")
    return files.Checked(_item_rows(each.where(F.col("reason").isNull())), whole.unionByName(rejected))


def first_items(parsed: DataFrame, most: int = FEED_ITEMS) -> DataFrame:
    """The first items of each feed, in feed order."""
    return parsed.where(F.col("position") < most)


def deduplicated(df: DataFrame) -> DataFrame:
    """Each item once, by all five columns."""
    return df.dropDuplicates(list(NEWS_KEY))


def terms_to_fetch(terms: DataFrame, archive: DataFrame, now: Column, days: int = FRESH_DAYS) -> DataFrame:
    """Search terms, in lower case, without an archived item newer than ``days``; case doesn't tell terms apart."""
    fresh = archive.where(F.col("PublishDate") > now - F.make_dt_interval(F.lit(days)))
    asked = terms.select(F.lower("term").alias("term")).distinct()
    return asked.join(fresh.select(F.lower("SearchTerm").alias("term")).distinct(), "term", "left_anti")


def fresh_counts(archive: DataFrame, now: Column, days: int = FRESH_DAYS) -> DataFrame:
    """Number of fresh items per search term."""
    is_fresh = F.col("PublishDate") > now - F.make_dt_interval(F.lit(days))
    return archive.groupBy("SearchTerm").agg(F.count_if(is_fresh).alias("fresh_items"))


def recent(archive: DataFrame, now: Column, days: int = VISIBLE_DAYS) -> DataFrame:
    """Items young enough to show."""
    return archive.where(F.col("PublishDate") > now - F.make_dt_interval(F.lit(days)))


def visible(archive: DataFrame, now: Column, excluded=EXCLUDED_SOURCES, days: int = VISIBLE_DAYS) -> DataFrame:
    """Recent items, without those of excluded sources."""
    return recent(archive, now, days).where(~any_of(F.col("Source"), excluded))


def mapped_terms(chosen: DataFrame, mapping: DataFrame) -> DataFrame:
    """Search term of each choice: cleaned, then replaced by the first mapping row for it."""
    first = mapping.groupBy(F.col("searchterm").alias("query")).agg(
        F.min(F.struct("ordinal", "to_be_searched")).alias("entry")
    )
    return (
        chosen.withColumn("query", fields.query_term(F.col("term")))
        .join(first, "query", "left")
        .select("term", F.coalesce("entry.to_be_searched", "query").alias("search_term"))
    )


def ticker(archive: DataFrame, terms: DataFrame, now: Column, excluded=EXCLUDED_SOURCES) -> DataFrame:
    """Anchors to show per search term; a term without recent items shows one notice.

    Items are joined to the few terms and not the terms to their items, so the items of a frequent
    term stay spread over many tasks.
    """
    items_of_term = recent(archive, now).withColumnRenamed("SearchTerm", "term")
    shown = items_of_term.where(~any_of(F.col("Source"), excluded)).join(terms, "term")
    without = terms.join(items_of_term.select("term").distinct(), "term", "left_anti")
    return shown.select("term", fields.anchor(F.col("Title"), F.col("Link")).alias("anchor")).unionByName(
        without.select("term", F.lit(fields.NO_DATA).alias("anchor"))
    )


def ticker_of_choices(
    archive: DataFrame, chosen: DataFrame, mapping: DataFrame, now: Column, excluded=EXCLUDED_SOURCES
) -> DataFrame:
    """The ticker of chosen terms: each is cleaned, replaced by its mapping, and that term's items are shown."""
    mapped = mapped_terms(chosen, mapping)
    shown = ticker(archive, mapped.select(F.col("search_term").alias("term")).distinct(), now, excluded)
    return mapped.join(shown.withColumnRenamed("term", "search_term"), "search_term").select("term", "search_term", "anchor")


def create_archive(spark: SparkSession, table: str) -> None:
    """The archive: the five key columns, partitioned by day of publication."""
    sinks.create_if_missing(spark, table, ARCHIVE, [ARCHIVE_DAY])


def archive_items(rows: DataFrame, table: str) -> None:
    """Add the items that the archive does not hold yet, each once.

    Every column of the key is required. Only the days of the new items are read.
    """
    complete = rows.select(*NEWS_KEY).dropna().withColumn(ARCHIVE_DAY, F.to_date("PublishDate"))
    sinks.insert_ignore(complete, table, NEWS_KEY, prune=ARCHIVE_DAY)
