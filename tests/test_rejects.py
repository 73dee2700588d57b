"""Faulty CSV rows and feeds are set aside with a reason, and nothing else is."""

from helpers import rows
from pyspark.sql import types as T

from reachlens.operators import news
from reachlens.schemas import FEED
from reachlens.session import scratch_path
from reachlens.sources import files

GOOD = "Fri, 25 Sep 2015 17:04:04 GMT"
SCHEMA = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("name", T.StringType())])


def checked(spark, *lines, **options):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    found = files.checked_csv(spark, path, SCHEMA, **options)
    return rows(found.good, "key", "name"), rows(found.rejects, "record", "reason")


def test_rows_that_do_not_fit(spark):
    good, bad = checked(spark, "1,a", "x,b", "2", "3,c,d", '4,"d, ""e"""', ",n", "5,", header=False)
    assert good == [(1, "a"), (4, 'd, "e"'), (5, None), (None, "n")]
    fault = "does not fit the schema"
    assert bad == [("2", fault), ("3,c,d", fault), ("x,b", fault)]


def test_required_values(spark):
    good, bad = checked(spark, "key,name", "1,a", ",b", "2,", ",", required=("key", "name"))
    assert good == [(1, "a")]
    assert bad == [(",", "key is missing"), (",b", "key is missing"), ("2,", "name is missing")]


def test_no_rows(spark):
    assert checked(spark, "key,name", required=("key",)) == ([], [])


def test_one_column_alone_tells_the_same(spark):
    """Reading few columns of the result does not change which records count as faulty."""
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("x,b",), ("1,a",)], "value string").write.text(path)
    found = files.checked_csv(spark, path, SCHEMA, header=False)
    assert found.good.select("name").collect() == [("a",)] and found.good.count() == 1
    assert found.rejects.select("file").first().file.startswith("part-")


def item(title="t", link="http://f?url=http://t", date=GOOD):
    return f"<item><title>{title}</title><link>{link}</link><pubDate>{date}</pubDate><description>d</description></item>"


def test_feeds(spark):
    def whole(body):
        return f"<rss><channel><title>x</title>{body}</channel></rss>"

    documents = {
        1: whole(item("a") + item("b", date="yesterday") + item("c", link="http://f") + item("d")),
        2: whole(item("a"))[:-9],
        3: whole(""),
        4: None,
        5: "plain text",
        6: whole(item("e", date="x", link="y")),
        7: "",
    }
    found = news.checked_items(spark.createDataFrame([("x", n, d) for n, d in documents.items()], FEED))
    assert rows(found.good, "feed_no", "position", "Title") == [(1, 0, "a"), (1, 3, "d")]
    assert found.good.columns == news.items(spark.createDataFrame([], FEED)).columns
    faults = {(r.feed_no, r.position): r.reason for r in found.rejects.collect()}
    assert faults.pop((3, None)) == "no items" and faults.pop((4, None)) == "no document"
    assert {faults.pop((n, None)) for n in (2, 5)} == {"not XML"} and faults.pop((7, None)) in ("not XML", "no items")
    assert faults == {(1, 1): "date not readable", (1, 2): "link without target", (6, 0): "date not readable"}
    records = {r.feed_no: r.record for r in found.rejects.where("position is not null").collect()}
    assert '"pubDate":"x"' in records[6]


def test_whole_feeds_lose_nothing(spark, small):
    from reachlens.sources import mapping

    feeds = mapping.feeds(spark, small)
    found = news.checked_items(feeds)
    assert found.good.exceptAll(news.items(feeds)).isEmpty() and news.items(feeds).exceptAll(found.good).isEmpty()
    assert found.rejects.isEmpty()
