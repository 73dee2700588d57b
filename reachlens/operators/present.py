"""Display frames: top rows, network bucketing, axis extents, formatted cells, bubbles, search, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlens import schemas
from reachlens.functions import text
from reachlens.operators.affinity import Level
from reachlens.operators.insights import METRIC_TITLES

# Bucket label, chart factors and the week up to which the older base text is shown.
OTHERS = "Others"
TOP_NETWORKS = 4
SHOW_ROWS = 100
X_PADDING_PERCENT = 8
Y_LOW_FACTOR = 0.9
Y_HIGH_FACTOR = 1.09
BUBBLE_SCALE = 10
OLDER_BASE_UNTIL = 201512

NAMES = ("category", "level", "genre", "ntwk")
SHARES = ("genre_share", "affinity", "client_genre_share", "overall_share")
VALUES = ("prog_metric", "genre_share", "affinity", "client_metric", "client_genre_share", "overall_share")


def _by_client_metric() -> list[Column]:
    return [F.desc_nulls_last("client_metric"), F.col("category"), F.col("level"), F.col("genre"), F.col("ntwk")]


def sorted_rows(data: DataFrame) -> DataFrame:
    """Advertiser metric descending, missing values last, ties by name."""
    return data.orderBy(*_by_client_metric())


def top_rows(data: DataFrame, rows: int = SHOW_ROWS) -> DataFrame:
    """The rows a large level shows: the highest advertiser metrics."""
    return sorted_rows(data).limit(rows)


def top_rows_by_total(data: DataFrame, rows: int = SHOW_ROWS) -> DataFrame:
    """Older choice of rows: advertiser present, highest total metric."""
    return (
        data.where(F.col("client_metric").isNotNull())
        .orderBy(F.desc_nulls_last("prog_metric"), "category", "level", "genre", "ntwk")
        .limit(rows)
    )


def top_networks(data: DataFrame, networks: int = TOP_NETWORKS) -> DataFrame:
    """Networks with the highest advertiser metric; the ``others`` network never counts as one."""
    return (
        data.select(F.lower("ntwk").alias("ntwk"), "client_metric")
        .where((F.col("ntwk") != OTHERS.lower()) & F.col("client_metric").isNotNull())
        .groupBy("ntwk")
        .agg(F.sum("client_metric").alias("client_metric"))
        .orderBy(F.desc("client_metric"), "ntwk")
        .limit(networks)
    )


def club_others(data: DataFrame, networks: int = TOP_NETWORKS) -> DataFrame:
    """Keep the top networks, label all other rows ``Others``, and average rows that now share their names.

    The result has lower-cased network names and only rows with an advertiser metric.
    """
    kept = top_networks(data, networks).select("ntwk", F.lit(True).alias("kept"))
    return (
        data.withColumn("ntwk", F.lower("ntwk"))
        .join(kept, "ntwk", "left")
        .withColumn("ntwk", F.when(F.col("kept"), F.col("ntwk")).otherwise(OTHERS))
        .groupBy(*NAMES)
        .agg(*[F.avg(value).alias(value) for value in VALUES])
        .where(F.col("client_metric").isNotNull())
    )


def axis_extents(bubbles: DataFrame) -> DataFrame:
    """One row: slider bounds of both axes, padded chart bounds, midpoint and largest bubble."""
    ends = bubbles.agg(
        F.min("affinity").alias("x_min"),
        F.max("affinity").alias("x_max"),
        F.min("prog_metric").alias("y_min"),
        F.max("prog_metric").alias("y_max"),
        F.min(F.coalesce("prog_metric", F.lit(0.0))).alias("y_min_or_zero"),
        F.max("client_metric").alias("bubble_max"),
    )
    x_pad = (F.col("x_max") - F.col("x_min")) * X_PADDING_PERCENT / 100
    x_single = (x_pad == 0).cast("double")
    # A single value on the y axis is widened by one before the padding.
    y_top = F.when(F.col("y_min") == F.col("y_max"), F.col("y_min") + 1).otherwise(F.col("y_max"))
    y_lo, y_hi = F.col("y_min") * Y_LOW_FACTOR, y_top * Y_HIGH_FACTOR
    return ends.select(
        F.floor("x_min").cast("double").alias("x_lo"),
        F.ceil("x_max").cast("double").alias("x_hi"),
        F.floor("y_min").cast("double").alias("y_lo"),
        F.ceil("y_max").cast("double").alias("y_hi"),
        (F.col("x_min") - x_pad - x_single).alias("chart_x_lo"),
        (F.col("x_max") + x_pad + x_single).alias("chart_x_hi"),
        y_lo.alias("chart_y_lo"),
        F.when(y_lo == y_hi, y_hi + 10).otherwise(y_hi).alias("chart_y_hi"),
        ((F.col("y_min_or_zero") + F.col("y_max")) / 2).alias("y_mid"),
        "bubble_max",
    )


def axis_range(bubbles: DataFrame, **chosen: float) -> DataFrame:
    """Rows within the slider bounds.

    ``x_lo``, ``x_hi`` (affinity) and ``y_lo``, ``y_hi`` (total metric) may be chosen; a bound that is
    not chosen is that of the data. Low bounds are rounded down and high bounds up, so an unset
    slider loses no row with an affinity.
    """

    def bound(name: str, column: str, aggregate, rounding) -> Column:
        if name in chosen:
            return rounding(F.lit(float(chosen[name])))
        return bubbles.agg(rounding(aggregate(column))).scalar()

    return bubbles.where(
        (F.col("affinity") >= bound("x_lo", "affinity", F.min, F.floor))
        & (F.col("affinity") <= bound("x_hi", "affinity", F.max, F.ceil))
        & (F.col("prog_metric") >= bound("y_lo", "prog_metric", F.min, F.floor))
        & (F.col("prog_metric") <= bound("y_hi", "prog_metric", F.max, F.ceil))
    )


def search(data: DataFrame, pattern: str) -> DataFrame:
    """Rows whose category, level, genre or network match a case-insensitive pattern."""
    searched = text.search_text(*[F.col(name) for name in NAMES])
    return data.where(text.matches(searched, pattern))


def row_slug() -> Column:
    """Identifier that links a table row and its bubble."""
    return F.concat_ws("-", text.slug(F.col("category")), text.slug(F.col("level")))


def formatted(rows: DataFrame, level: Level) -> DataFrame:
    """Table cells as raw value and text, with each share's part of its column maximum for the cell bar."""

    def bar(name: str) -> Column:
        return F.try_divide(F.col(name), rows.agg(F.max(name)).scalar()).alias(f"{name}_bar")

    strip = level.level_title if level.level_title == "Network" else None
    cells = {
        "category": text.name_cell(F.col("category")),
        "level": text.name_cell(F.col("level"), strip),
        "prog_metric": text.metric_cell(F.col("prog_metric")),
        "genre_share": text.share_cell(F.col("genre_share")),
        "affinity": text.affinity_cell(F.col("affinity")),
        "client_metric": text.metric_cell(F.col("client_metric")),
        "client_genre_share": text.share_cell(F.col("client_genre_share")),
        "overall_share": text.share_cell(F.col("overall_share")),
    }
    return rows.select(
        *[cell.alias(name) for name, cell in cells.items()],
        *[bar(name) for name in SHARES if name != "affinity"],
        row_slug().alias("row_slug"),
        text.search_text(*[F.col(name) for name in NAMES]).alias("search"),
    )


def bubbles(rows: DataFrame, networks: DataFrame, colors: DataFrame) -> DataFrame:
    """Bubble position, radius and color; only top networks keep their own color.

    ``rows`` come from :func:`club_others`, ``networks`` from :func:`top_networks`, ``colors`` has
    lower-cased network names.
    """
    largest = rows.agg(F.max("client_metric")).scalar()
    other_color = colors.where(F.col("Network") == OTHERS.lower()).agg(F.max("HexCode")).scalar()
    palette = networks.select("ntwk").join(
        colors.groupBy(F.col("Network").alias("ntwk")).agg(F.max("HexCode").alias("HexCode")), "ntwk"
    )
    is_other = F.col("ntwk") == OTHERS
    first_word = F.initcap(F.split_part("ntwk", F.lit(" "), F.lit(1)))
    return rows.join(palette, "ntwk", "left").select(
        "category",
        "level",
        "ntwk",
        F.coalesce("affinity", F.lit(0.0)).alias("x"),
        F.coalesce("prog_metric", F.lit(0.0)).alias("y"),
        F.coalesce(F.try_divide("client_metric", largest) * BUBBLE_SCALE, F.lit(0.0)).alias("radius"),
        F.coalesce("HexCode", F.coalesce(other_color, F.lit("#ffffff"))).alias("color"),
        row_slug().alias("row_slug"),
        F.when(is_other, OTHERS).otherwise(text.slug(first_word)).alias("network_slug"),
    )


def display_names(level: Level, metric: str) -> dict[str, str]:
    """Column titles of the display and of the export."""
    title = METRIC_TITLES[metric]
    return {
        "category": level.title,
        "level": level.level_title,
        "prog_metric": f"Total {title}",
        "genre_share": "Genre Share",
        "affinity": "Affinity",
        "client_metric": f"Client {title}",
        "client_genre_share": "Client Genre Share",
        "overall_share": "Overall Share",
    }


def export_rows(data: DataFrame, level: Level, metric: str) -> DataFrame:
    """Export frame: no helper columns, two decimals, titled columns."""
    rounded = {value: F.round(value, 2) for value in VALUES}
    titles = display_names(level, metric)
    return sorted_rows(data).withColumns(rounded).select(*[F.col(name).alias(title) for name, title in titles.items()])


def export_selection(spark: SparkSession, selection: dict[str, str]) -> DataFrame:
    """The leading rows of an export: what was selected."""
    rows = [(position, name, value) for position, (name, value) in enumerate(selection.items())]
    return spark.createDataFrame(rows, "position int, name string, value string")


def export_with_selection(rows: DataFrame, selection: dict[str, str]) -> DataFrame:
    """The lines of an export as texts: ``block`` 0 is the selection, 1 the column titles, 2 the rows.

    ``line`` orders the lines of the first two blocks; rows keep the export's own order by their values.
    """
    spark, names = rows.sparkSession, rows.columns
    columns = [f"c{i}" for i in range(len(names))]
    blank = [None] * (len(names) - 2)
    head = [(0, i, name, value, *blank) for i, (name, value) in enumerate(selection.items())] + [(1, 0, *names)]
    schema = "block int, line int, " + ", ".join(f"{column} string" for column in columns)
    texts = [
        F.col(f"`{name}`").cast("decimal(20,2)" if kind == "double" else "string").cast("string").alias(column)
        for (name, kind), column in zip(rows.dtypes, columns)
    ]
    body = rows.select(F.lit(2).alias("block"), F.lit(None).cast("int").alias("line"), *texts)
    return spark.createDataFrame(head, schema).unionByName(body)


def base_markets(reference: DataFrame, name: str) -> DataFrame:
    """Base cell text per name and measurement source; a missing one is empty."""
    pivoted = (
        reference.groupBy(F.col(name).alias("name"))
        .pivot("SOURCE", [schemas.SOURCE_OLDER, schemas.SOURCE_NEWER])
        .agg(F.max("TG_MARKET_DISPLAY_NAME"))
    )
    return pivoted.select(
        "name",
        F.coalesce(F.col(f"`{schemas.SOURCE_OLDER}`"), F.lit("")).alias("tam"),
        F.coalesce(F.col(f"`{schemas.SOURCE_NEWER}`"), F.lit("")).alias("barc"),
    )


def base_text(end_week: Column | int) -> Column:
    """Base cell text to show: the newer source after the changeover week, else the older one."""
    end = F.lit(end_week) if isinstance(end_week, int) else end_week
    return F.when(end > OLDER_BASE_UNTIL, F.col("barc")).otherwise(F.col("tam"))

