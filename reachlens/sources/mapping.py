"""The logical tables, derived from the given ones (``lineitem``, ``orders``, ... and ``pages``).

Joins carry no broadcast hints: Spark's own size threshold broadcasts small dimensions, larger ones are
shuffled, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachlens import schemas
from reachlens.functions import calendar

# Fixed values of the mapping.
RETURN_FLAGS = ("A", "N", "R")
MONTH_NAMES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
NEWER_OFFSET = 10
OTHERS_FROM_NETWORK = 20
ACCESS_CHANNELS = 20
NEWS_EPOCH = "2024-01-01 00:00:00"
FEED_PAGES = 100
# Calendar columns that follow from the day alone.
OF_DAY = ("CALENDAR_YEAR", "BARC_WEEK", "MONTH")


# Columns read from the given tables; a stated schema saves a footer-reading job per table.
GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{folder}/{name}.parquet")


def _money(column: str) -> Column:
    """Doubles become exact decimals before any arithmetic, so that sums do not depend on row order."""
    return F.col(column).cast("decimal(15,2)")


def _list_position(values: tuple[str, ...], column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(value) for value in values]), column).cast("int")


def _genres(spark: SparkSession, folder: str) -> DataFrame:
    """Every genre name once, with its dense rank; only distinct names are ranked."""
    names = table(spark, folder, "part").select("p_type").where(F.col("p_type").isNotNull()).distinct()
    return names.withColumn("GENRE_KEY", F.row_number().over(Window.orderBy("p_type")))


def _tg_key() -> Column:
    older = _list_position(RETURN_FLAGS, F.col("l_returnflag"))
    return (older + F.when(F.col("l_linestatus") == "O", NEWER_OFFSET).otherwise(0)).cast("int")


def _market_key() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int")


def _between(lines: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """A plain range on the ship date, which reaches the Parquet reader."""
    ship = F.col("l_shipdate")
    if first:
        lines = lines.where(ship >= _ntz(dt.datetime.combine(first, dt.time())))
    if last:
        lines = lines.where(ship < _ntz(dt.datetime.combine(last, dt.time()) + dt.timedelta(days=1)))
    return lines


def _calendar_columns(day: Column) -> list[Column]:
    return [
        F.year(day).alias("CALENDAR_YEAR"),
        F.weekofyear(day).alias("BARC_WEEK"),
        F.element_at(F.array(*[F.lit(name) for name in MONTH_NAMES]), F.month(day)).alias("MONTH"),
        calendar.week_key(day).alias("WEEK_KEY"),
    ]


def _net(price: Column, discount: Column) -> Column:
    return (price * (1 - discount)).cast("decimal(18,4)")


def _metric_columns() -> list[Column]:
    return [
        _money("l_quantity").alias("ADGRP"),
        _money("l_extendedprice").alias("FCT"),
        _net(_money("l_extendedprice"), _money("l_discount")).alias("TVT"),
    ]


def spots(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar columns and metrics of the fact, from its own table alone: for what needs no dimension."""
    return table(spark, folder, "lineitem").select(*_calendar_columns(F.to_date("l_shipdate")), *_metric_columns())


def _programs(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").join(_genres(spark, folder), "p_type")
    return parts.select(
        F.col("p_partkey").alias("PROGRAM_GROUP_KEY"),
        F.col("p_name").alias("PROGRAM_GROUP_DISPLAY_NAME"),
        "GENRE_KEY",
        F.col("p_type").alias("GENRE_DISPLAY_NAME"),
    )


def _channels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("CHANNEL_GROUP_KEY"),
        F.col("s_name").alias("CHANNEL_GROUP_DISPLAY_NAME"),
        F.col("s_nationkey").alias("NETWORK_KEY"),
    )


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ADVERTISERS_GROUP_KEY")
    )


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", _market_key().alias("MARKET_KEY")
    )


def _keyed_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        "l_orderkey",
        F.col("l_partkey").alias("PROGRAM_GROUP_KEY"),
        F.col("l_suppkey").alias("CHANNEL_GROUP_KEY"),
        _tg_key().alias("TG_KEY"),
        F.to_date("l_shipdate").alias("day"),
        *_metric_columns()[:2],
        _money("l_discount").alias("discount"),
    )


def keyed_fact(spark: SparkSession, folder: str) -> DataFrame:
    """The whole fact by its keys and its day, with the names that the large tables have.

    ``named`` makes the fact of it. What that adds follows from nations, the day and the price, so rows that are moved or
    written between the two need not carry it.
    """
    # Orders are fewer than their lines, so customers are joined to them.
    orders = _orders(spark, folder).join(_customers(spark, folder), "o_custkey")
    return (
        _keyed_lines(table(spark, folder, "lineitem"))
        .join(orders, "l_orderkey")
        .join(_programs(spark, folder), "PROGRAM_GROUP_KEY")
        .join(_channels(spark, folder), "CHANNEL_GROUP_KEY")
        .drop("l_orderkey", "o_custkey")
    )


def with_calendar(rows: DataFrame) -> DataFrame:
    """Calendar columns of the rows' day."""
    return rows.select("*", *_calendar_columns(F.col("day")))


def named(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """``FACT_TG_AFFINITY_AGG_WK`` from rows of ``keyed_fact``; their other columns, and a week key of their own, stay."""
    nation = table(spark, folder, "nation")
    network = nation.select(
        F.col("n_nationkey").alias("NETWORK_KEY"),
        F.when(F.col("n_nationkey") >= OTHERS_FROM_NETWORK, "Others")
        .otherwise(F.col("n_name"))
        .alias("NETWORK_DISPLAY_NAME"),
    )
    advertiser = nation.select(
        F.col("n_nationkey").alias("ADVERTISERS_GROUP_KEY"),
        F.col("n_name").alias("ADVERTISERS_GROUP_DISPLAY_NAME"),
    )
    joined = rows.join(network, "NETWORK_KEY").join(advertiser, "ADVERTISERS_GROUP_KEY")
    day, net = F.col("day"), _net(F.col("FCT"), F.col("discount")).alias("TVT")
    calendar_columns = _calendar_columns(day)[: -1 if "WEEK_KEY" in rows.columns else None]
    derived = joined.select("*", *calendar_columns, net)
    others = [name for name in rows.columns if name not in (*schemas.FACT.fieldNames(), "day", "discount")]
    return derived.select(*schemas.FACT.fieldNames(), *others)


def fact(
    spark: SparkSession,
    folder: str,
    weeks: tuple[int, int] | None = None,
    since: dt.date | None = None,
    base_cells: DataFrame | None = None,
) -> DataFrame:
    """``FACT_TG_AFFINITY_AGG_WK``, one row per line item.

    ``weeks`` and ``since`` add a plain date range on the ship date, which reaches the Parquet reader; the exact
    filter stays with the caller. ``base_cells`` has a genre or channel key with its cells: the rows are joined with
    it as soon as its key is known, before the other dimensions, once per row of it.
    """
    if weeks is None and since is None and base_cells is None:
        return named(spark, folder, keyed_fact(spark, folder))
    lines = table(spark, folder, "lineitem")
    if weeks:
        lines = _between(lines, calendar.week_first_day(weeks[0]), calendar.week_last_day(weeks[1]))
    lines = _between(lines, since, None)
    programs = _programs(spark, folder)
    joined = _keyed_lines(lines).join(_orders(spark, folder), "l_orderkey")
    if base_cells is not None and "CHANNEL_GROUP_KEY" in base_cells.columns:
        cell = ["CHANNEL_GROUP_KEY", "TG_KEY", "MARKET_KEY"]
        joined = joined.join(base_cells.select(*cell), cell).join(programs, "PROGRAM_GROUP_KEY")
    elif base_cells is not None:
        cell = ["GENRE_KEY", "TG_KEY", "MARKET_KEY"]
        joined = joined.join(programs, "PROGRAM_GROUP_KEY").join(base_cells.select(*cell), cell)
    else:
        joined = joined.join(programs, "PROGRAM_GROUP_KEY")
    joined = joined.join(_customers(spark, folder), "o_custkey").join(_channels(spark, folder), "CHANNEL_GROUP_KEY")
    # What follows from the day and the price is computed after the joins, which move rows.
    return named(spark, folder, joined.drop("l_orderkey", "o_custkey"))


def advertisers(spark: SparkSession, folder: str) -> DataFrame:
    """Key and name of the advertisers in ``FACT_TG_AFFINITY_AGG_WK``, once each.

    Lines only tell which orders count, and parts and channels which lines do: all three are semi-joins on keys. Names are
    joined to the few keys that are left.
    """
    nation = table(spark, folder, "nation")
    networks = nation.select(F.col("n_nationkey").alias("s_nationkey"))
    channels = table(spark, folder, "supplier").join(networks, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"))
    programs = table(spark, folder, "part").where(F.col("p_type").isNotNull()).select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    lines = lines.join(channels, "l_suppkey", "left_semi").join(programs, "l_partkey", "left_semi")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ADVERTISERS_GROUP_KEY")
    )
    keys = orders.join(lines.select("l_orderkey"), "l_orderkey", "left_semi").join(customers, "o_custkey")
    names = nation.select(
        F.col("n_nationkey").alias("ADVERTISERS_GROUP_KEY"), F.col("n_name").alias("ADVERTISERS_GROUP_DISPLAY_NAME")
    )
    return keys.select("ADVERTISERS_GROUP_KEY").distinct().join(names, "ADVERTISERS_GROUP_KEY")


def _ntz(moment: dt.datetime) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def _cell_names(tg: Column, market: Column) -> dict[str, Column]:
    tg_name = F.concat(F.lit("TG "), tg.cast("string"))
    market_name = F.concat(F.lit("MKT "), market.cast("string"))
    return {
        "TG_DISPLAY_NAME": tg_name,
        "MARKET_DISPLAY_NAME": market_name,
        "TG_MARKET_DISPLAY_NAME": F.concat_ws(" ", tg_name, market_name),
    }


def _source_of(tg: Column) -> Column:
    return F.when(tg < NEWER_OFFSET, schemas.SOURCE_OLDER).otherwise(schemas.SOURCE_NEWER)


def ref_tg_mkt(spark: SparkSession, folder: str) -> DataFrame:
    """``REF_TG_MKT``: every audience-market cell that occurs."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", _tg_key().alias("TG_KEY"))
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), _market_key().alias("MARKET_KEY")
    )
    cells = lines.join(orders, "l_orderkey").select("TG_KEY", "MARKET_KEY").distinct()
    return cells.withColumns(
        {**_cell_names(F.col("TG_KEY"), F.col("MARKET_KEY")), "SOURCE": _source_of(F.col("TG_KEY"))}
    ).select(*schemas.REF_TG_MKT.fieldNames())


def _with_base_cells(keyed: DataFrame, key: str) -> DataFrame:
    """Two base cells per key, one per measurement source."""
    offsets = F.explode(F.array(F.lit(0), F.lit(NEWER_OFFSET))).alias("offset")
    tg = (F.col(key) % 3 + 1 + F.col("offset")).cast("int")
    market = (F.col(key) % 5 + 1).cast("int")
    return keyed.select("*", offsets).select(
        *keyed.columns,
        tg.alias("TG_KEY"),
        market.alias("MARKET_KEY"),
        _source_of(tg).alias("SOURCE"),
        *[column.alias(name) for name, column in _cell_names(tg, market).items()],
    )


def ref_genre_tg_mkt(spark: SparkSession, folder: str) -> DataFrame:
    """``ref_genre_tg_mkt``: the base cells of each genre."""
    genres = _genres(spark, folder).select(
        "GENRE_KEY", F.upper("p_type").alias("GENRE_NAME"), F.col("p_type").alias("GENRE_DISPLAY_NAME")
    )
    return _with_base_cells(genres, "GENRE_KEY").select(*schemas.REF_GENRE_TG_MKT.fieldNames())


def dim_channel_group(spark: SparkSession, folder: str) -> DataFrame:
    """``DIM_CHANNEL_GROUP``."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("CHANNEL_GROUP_KEY"), F.col("s_name").alias("CHANNEL_GROUP_DISPLAY_NAME")
    )


def ref_ch_group_tg_mkt(spark: SparkSession, folder: str) -> DataFrame:
    """``ref_ch_group_tg_mkt``: the base cells of each channel."""
    return _with_base_cells(dim_channel_group(spark, folder), "CHANNEL_GROUP_KEY").select(
        *schemas.REF_CH_GROUP_TG_MKT.fieldNames()
    )


def dim_date(spark: SparkSession, folder: str) -> DataFrame:
    """``DIM_DATE``: every day of the years that ship dates fall into."""
    span = table(spark, folder, "lineitem").agg(
        F.trunc(F.min("l_shipdate"), "year").alias("first"),
        F.make_date(F.year(F.max("l_shipdate")), F.lit(12), F.lit(31)).alias("last"),
    )
    days = span.select(F.explode(F.sequence("first", "last")).alias("PRG_DATE"))
    day = F.col("PRG_DATE")
    return days.select(
        calendar.date_key(day).alias("DATE_KEY"),
        "PRG_DATE",
        calendar.week_number(day).alias("BARC_WEEK"),
        F.year(day).alias("BARC_YEAR"),
    )


def fact_cust_rev_agg_dly(spark: SparkSession, folder: str) -> DataFrame:
    """``FACT_CUST_REV_AGG_DLY``: program date and advertiser of each order."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ADVERTISERS_GROUP_KEY")
    )
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("ADVERTISERS_GROUP_KEY"),
        F.col("n_name").alias("ADVERTISERS_GROUP_DISPLAY_NAME"),
    )
    return (
        table(spark, folder, "orders")
        .select("o_custkey", F.to_date("o_orderdate").alias("PRG_DATE"))
        .join(customers, "o_custkey")
        .join(nation, "ADVERTISERS_GROUP_KEY")
        .select("PRG_DATE", "ADVERTISERS_GROUP_KEY", "ADVERTISERS_GROUP_DISPLAY_NAME")
    )


def fact_cust_break_agg_dly(spark: SparkSession, folder: str) -> DataFrame:
    """``fact_cust_break_agg_dly``: program date of each spot."""
    return table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("PRG_DATE"))


def ref_employee_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """``REF_EMPLOYEE_HIERARCHY``: one employee per supplier, managed by the employee with a third of the key."""
    people = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("EMPLOYEE_NAME")
    )
    people = people.withColumn("manager", F.when(F.col("key") > 0, F.floor(F.col("key") / 3).cast("long")))
    managers = people.select(F.col("key").alias("manager"), F.col("EMPLOYEE_NAME").alias("MANAGER_NAME"))
    heads = people.where("manager is not null").select(F.col("manager").alias("key")).distinct()
    heads = heads.withColumn("has_reports", F.lit(True))
    role = (
        F.when(F.col("key") == 0, "HO GROUP")
        .when(F.col("has_reports").isNull(), "SALES EXECUTIVE")
        .when(F.col("key") <= 3, "CLUSTER HEAD")
        .otherwise("BRANCH HEAD")
    )
    return (
        people.join(managers, "manager", "left")
        .join(heads, "key", "left")
        .select(
            F.col("key").cast("string").alias("EMPLOYEE_KEY"),
            F.concat(F.lit("U"), F.col("key").cast("string")).alias("EMPLOYEE_NT_ID"),
            "EMPLOYEE_NAME",
            role.alias("EMPLOYEE_ROLE"),
            F.when(F.col("key") % 7 != 0, "-").alias("SECONDARY_ROLE"),
            "MANAGER_NAME",
            F.concat(F.lit("Group "), (F.col("key") % 4 + 1).cast("string")).alias("AUTH_GROUP"),
        )
    )


def ref_employee_access(spark: SparkSession, folder: str) -> DataFrame:
    """``REF_EMPLOYEE_ACCESS``: channels and locations per employee, and an ``ALL`` row for key 0."""
    locations = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("location")
    )
    grants = (
        table(spark, folder, "lineitem")
        .select("l_suppkey", (F.col("l_partkey") % ACCESS_CHANNELS).alias("channel"))
        .distinct()
        .join(locations, "l_suppkey")
        .select(
            F.col("l_suppkey").cast("string").alias("EMPLOYEE_KEY"),
            F.col("channel").cast("string").alias("CHANNEL_GROUP_KEY"),
            F.concat(F.lit("Channel "), F.col("channel").cast("string")).alias("CHANNEL_GROUP_DISPLAY_NAME"),
            F.col("location").cast("string").alias("LOCATION_KEY"),
        )
    )
    everything = locations.where("l_suppkey = 0").select(
        F.lit("0").alias("EMPLOYEE_KEY"),
        F.lit("ALL").alias("CHANNEL_GROUP_KEY"),
        F.lit("ALL").alias("CHANNEL_GROUP_DISPLAY_NAME"),
        F.col("location").cast("string").alias("LOCATION_KEY"),
    )
    return grants.unionByName(everything)


def network_colors(spark: SparkSession, folder: str) -> DataFrame:
    """A color per network, and one for ``Others``."""
    hex_code = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("n_nationkey") * 104729 + 255), 6, "0")))
    nation = table(spark, folder, "nation")
    named = nation.where(F.col("n_nationkey") < OTHERS_FROM_NETWORK).select(
        F.col("n_name").alias("Network"), hex_code.alias("HexCode")
    )
    others = nation.agg(F.lit("Others").alias("Network"), F.lit("#ffffff").alias("HexCode"))
    return named.unionByName(others)


def news(spark: SparkSession, folder: str) -> DataFrame:
    """One news item per web page."""
    published = F.lit(NEWS_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("page_id").cast("int"))
    return table(spark, folder, "pages").select(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("Title"),
        published.alias("PublishDate"),
        F.col("url").alias("Link"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("Source"),
        F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1).alias("SearchTerm"),
        "page_id",
    )


def _xml(column: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(plain), F.lit(escaped))
    return column


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Feed documents as a news service would return them: the items of one term, newest page last.

    A feed covers ``FEED_PAGES`` consecutive pages, so no document grows with the data.
    """
    link = F.concat(F.lit("http://feed.example/url?sa=t&url="), F.col("Link"))
    description = F.concat(F.lit('<b><font color="#6f6f6f">'), F.col("Source"), F.lit("</font></b>"))
    published = F.concat(F.date_format("PublishDate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    item = F.concat(
        F.lit("<item><title>"),
        _xml(F.col("Title")),
        F.lit("</title><link>"),
        _xml(link),
        F.lit("</link><pubDate>"),
        published,
        F.lit("</pubDate><description>"),
        _xml(description),
        F.lit("</description></item>"),
    )
    feed_no = F.floor(F.col("page_id") / FEED_PAGES).alias("feed_no")
    items = news(spark, folder).select("SearchTerm", feed_no, F.struct("page_id", item.alias("item")).alias("entry"))
    ordered = F.array_sort(F.collect_list("entry"))
    body = F.array_join(F.transform(ordered, lambda entry: entry["item"]), "")
    document = F.concat(F.lit('<rss version="2.0"><channel><title>feed</title>'), body, F.lit("</channel></rss>"))
    return items.groupBy("SearchTerm", "feed_no").agg(document.alias("document"))
