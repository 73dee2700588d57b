import datetime as dt

import pytest
from helpers import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reachlens.functions import news as fields
from reachlens.operators import news
from reachlens.schemas import FEED, NEWS, NEWS_KEY, NEWS_TEXT
from reachlens.session import scratch_path
from reachlens.sources import files, sinks
from reachlens.streaming import news_archive

NOW = dt.datetime(2015, 10, 1)


def now():
    return F.lit(str(NOW)).cast("timestamp_ntz")


def feed(*items):
    body = "".join(
        f"<item><title>{title}</title><link>http://f?a=1&amp;url=http://{title}</link><pubDate>{date}</pubDate>"
        f'<description>&lt;b&gt;&lt;font color="#6f6f6f"&gt;{source}&lt;/font&gt;</description></item>'
        for title, date, source in items
    )
    return f"<rss><channel><title>t</title>{body}</channel></rss>"


GOOD = "Fri, 25 Sep 2015 17:04:04 GMT"


def test_dates_of_a_feed(spark):
    texts = {GOOD: dt.datetime(2015, 9, 25, 17, 4, 4), "xx": None, "Fri, 25 Foo 2015 17:04:04 GMT": None, "": None}
    texts["Sat, 5 Sep 2015 07:04:04 EST"] = dt.datetime(2015, 9, 5, 7, 4, 4)
    texts["Sat, 31 Sep 2015 07:04:04 GMT"] = None
    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    found = {row.t: row.d for row in frame.select("t", fields.feed_date(F.col("t")).alias("d")).collect()}
    assert found == texts


def test_feed_with_one_and_with_many_items(spark):
    documents = [
        ("one", 0, feed(("a", GOOD, "s"))),
        ("many", 0, feed(*[(f"t{i}", GOOD, "s") for i in range(12)])),
        ("none", 0, feed()),
    ]
    parsed = news.items(spark.createDataFrame(documents, FEED))
    counts = {row.SearchTerm: row["count"] for row in parsed.groupBy("SearchTerm").count().collect()}
    assert counts == {"one": 1, "many": 12}
    (item,) = parsed.where("SearchTerm = 'one'").collect()
    assert (item.Title, item.Link, item.Source) == ("a", "http://a", "s")
    top = news.first_items(parsed).where("SearchTerm = 'many'")
    assert [row.Title for row in top.orderBy("position").collect()] == [f"t{i}" for i in range(10)]


def archive_rows(spark, *rows_):
    return spark.createDataFrame([(t, d, f"http://{t}", s, term) for t, d, s, term in rows_], NEWS)


def test_fresh_and_visible(spark):
    rows_ = archive_rows(
        spark,
        ("new", NOW - dt.timedelta(days=13), "A.com", "x"),
        ("old", NOW - dt.timedelta(days=15), "MoneyControl.com", "y"),
        ("older", NOW - dt.timedelta(days=174), "b.com", "y"),
        ("gone", NOW - dt.timedelta(days=176), "b.com", "y"),
    )
    terms = spark.createDataFrame([("x",), ("y",), ("z",)], "term string")
    mixed = spark.createDataFrame([("X",), ("Y",), ("y",), ("z",)], "term string")
    assert rows(news.terms_to_fetch(mixed, rows_, now()), "term") == [("y",), ("z",)]
    assert rows(news.fresh_counts(rows_, now()), "SearchTerm", "fresh_items") == [("x", 1), ("y", 0)]
    assert rows(news.visible(rows_, now()), "Title") == [("new",), ("older",)]
    anchors = rows(news.ticker(rows_, terms, now()), "term", "anchor")
    assert [term for term, _ in anchors] == ["x", "y", "z"]
    assert anchors[2][1] == "No Data Available"
    assert anchors[0][1] == '<a target = "blank" class="tab" href="http://new">new</a>'


def test_a_term_with_excluded_items_only_shows_nothing(spark):
    rows_ = archive_rows(spark, ("a", NOW, "indiainfoline", "x"))
    terms = spark.createDataFrame([("x",)], "term string")
    assert news.ticker(rows_, terms, now()).isEmpty()


def test_terms_are_cleaned_and_mapped(spark):
    chosen = spark.createDataFrame([("O'Neil \"X\"",), ("plain",)], "term string")
    mapping = spark.createDataFrame(
        [(2, "oneil%20x", "second"), (1, "oneil%20x", "first")], "ordinal int, searchterm string, to_be_searched string"
    )
    assert rows(news.mapped_terms(chosen, mapping), "term", "search_term") == [
        ("O'Neil \"X\"", "first"),
        ("plain", "plain"),
    ]
    compact = spark.range(1).select(fields.compact_term(F.lit("a b  c")).alias("v")).first().v
    assert compact == "abc"


def test_archive_keeps_each_item_once(spark):
    table = f"{sinks.scratch_database(spark, 'n')}.archive"
    news.create_archive(spark, table)
    news.create_archive(spark, table)
    day = dt.datetime(2015, 9, 1)
    first = archive_rows(spark, ("a", day, "s", "x"), ("a", day, "s", "x"), ("b", day, "s", "x"))
    news.archive_items(first, table)
    second = archive_rows(
        spark, ("a", day, "s", "x"), ("a", day, "s", "y"), ("a", day + dt.timedelta(days=1), "s", "x"), ("c", None, "s", "x")
    )
    news.archive_items(second, table)
    assert rows(spark.table(table), "Title", "PublishDate", "SearchTerm") == [
        ("a", day, "x"),
        ("a", day, "y"),
        ("a", day + dt.timedelta(days=1), "x"),
        ("b", day, "x"),
    ]


def uncoalesced(spark):
    """A session whose tasks stay as many as on a large table."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return own


def test_a_day_of_the_archive_is_one_file(spark):
    """Items of a day come from many tasks; the day gets one file all the same, in every run."""
    own = uncoalesced(spark)
    table = f"{sinks.scratch_database(own, 'n')}.archive"
    news.create_archive(own, table)
    for term in ("x", "y"):
        items = [(f"t{n}", dt.datetime(2015, 9, 1 + n % 3), "s", term) for n in range(60)]
        news.archive_items(archive_rows(own, *items), table)
    assert own.table(table).count() == 120
    assert len(own.table(table).inputFiles()) == 2 * 3


def test_a_day_of_the_streamed_archive_is_one_file(spark):
    path, checkpoint = scratch_path(spark, "feeds"), scratch_path(spark, "state")
    own = uncoalesced(spark)
    table = f"{sinks.scratch_database(own, 'n')}.archive"
    news.create_archive(own, table)
    items = [(f"t{n}", f"{'Fri' if n % 2 else 'Thu'}, {24 + n % 2} Sep 2015 17:04:04 GMT", "s") for n in range(40)]
    own.createDataFrame([("x", 0, feed(*items))], FEED).write.parquet(path)
    news_archive.start(own, path, table, checkpoint).awaitTermination()
    own.catalog.refreshTable(table)
    assert own.table(table).count() == 40
    assert len(own.table(table).inputFiles()) == 2


def test_headerless_file_round_trip(spark):
    path = scratch_path(spark, "csv")
    items = [('QQ, "beefing" up', GOOD, "http://x", "S, T", "Zenkai"), (" blank ", GOOD, "http://y", "s", "Zenkai")]
    frame = spark.createDataFrame(items, NEWS_TEXT)
    for _ in range(3):
        sinks.append_csv(frame, path)
    back = files.news_items(spark, path)
    assert back.count() == 6
    assert rows(news.deduplicated(back), *NEWS_KEY) == sorted(items)


def test_stream_takes_late_items_and_replays(spark):
    """Two runs over one checkpoint: the second takes only new files, and an old item is still archived."""
    path, checkpoint = scratch_path(spark, "feeds"), scratch_path(spark, "state")
    table = f"{sinks.scratch_database(spark, 'n')}.archive"
    news.create_archive(spark, table)
    late = "Mon, 05 Jan 2015 01:00:00 GMT"
    batches = [
        [("x", 0, feed(("a", GOOD, "s"), ("b", GOOD, "s")))],
        [("x", 1, feed(("b", GOOD, "s"), ("c", late, "s")))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, FEED).write.mode("append").parquet(path)
        news_archive.start(spark, path, table, checkpoint).awaitTermination()
    assert rows(spark.table(table), "Title") == [("a",), ("b",), ("c",)]


class Stream:
    """Feed files that arrive one after the other, each read by a new query on the same checkpoint."""

    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.path, self.checkpoint = scratch_path(spark, "feeds"), scratch_path(spark, "state")
        self.table = f"{sinks.scratch_database(spark, 'n')}.archive"
        news.create_archive(spark, self.table)

    def arrive(self, *titles, published=GOOD, fail=False):
        """Titles that passed the state, in this run."""
        seen = []

        def tested(batch, _):
            seen.extend(row.Title for row in batch.collect())
            if fail:
                raise RuntimeError("after the archive was written")

        rows_ = [("x", 0, feed(*[(title, published, "s") for title in titles]))]
        self.spark.createDataFrame(rows_, FEED).coalesce(1).write.mode("append").parquet(self.path)
        query = news_archive.start(self.spark, self.path, self.table, self.checkpoint, tested=tested, **self.options)
        query.awaitTermination()
        self.progress = query.recentProgress
        return sorted(seen)

    def archived(self):
        self.spark.catalog.refreshTable(self.table)
        return sorted(row.Title for row in self.spark.table(self.table).collect())


def test_repeats_end_at_the_state_and_late_items_pass(spark):
    stream = Stream(spark)
    assert stream.arrive("a", "b", "a") == ["a", "b"]
    assert stream.arrive("b", "c") == ["c"]
    assert stream.arrive("late", "a", published="Mon, 05 Jan 2009 01:00:00 GMT") == ["a", "late"]
    assert stream.arrive("late", "a", "b", published="Mon, 05 Jan 2009 01:00:00 GMT") == ["b"]
    assert stream.archived() == ["a", "a", "b", "b", "c", "late"]
    assert all(op["numRowsDroppedByWatermark"] == 0 for p in stream.progress for op in p["stateOperators"])


def test_expired_items_are_told_by_the_archive(spark):
    """With a short memory an item passes again after a while; the archive still has it once."""
    stream = Stream(spark, remembered="0 seconds")
    assert stream.arrive("a") == ["a"]
    again = [stream.arrive("a", f"other {turn}") for turn in range(4)]
    assert any("a" in passed for passed in again)
    assert stream.archived() == sorted(["a", *[f"other {turn}" for turn in range(4)]])


def test_failed_batch_runs_again(spark):
    """The archive was written, the checkpoint was not: the same rows pass once more and nothing is added."""
    stream = Stream(spark)
    stream.arrive("a")
    with pytest.raises(StreamingQueryException):
        stream.arrive("a", "b", fail=True)
    assert stream.archived() == ["a", "b"]
    assert stream.arrive("b", "c") == ["b", "c"]
    assert stream.archived() == ["a", "b", "c"]
