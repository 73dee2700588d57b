"""Tables that change together: crashes, conflicts, old builds, retention, vacuum."""

import subprocess
import sys
import textwrap
from decimal import Decimal
from pathlib import Path

import pytest
from helpers import fact, plan_text, rows

from reachlens.operators import weeks
from reachlens.plans import weekly
from reachlens.session import scratch_path
from reachlens.sources.builds import Builds, Conflict
from test_rollups import channel_reference, genre_reference

REPAIR = [201552, 201652]


def data(spark):
    return fact(
        spark,
        {"WEEK_KEY": 201552, "MONTH": "JAN", "ADGRP": 1},
        {"WEEK_KEY": 201552, "MONTH": "DEC", "ADGRP": 2},
        {"WEEK_KEY": 201652, "MONTH": "JAN", "CALENDAR_YEAR": 2016, "ADGRP": 4},
        {"WEEK_KEY": 201510, "ADGRP": 8},
        {"WEEK_KEY": 201452, "MONTH": "DEC", "CALENDAR_YEAR": 2014, "ADGRP": 16},
        {"WEEK_KEY": 201010, "CALENDAR_YEAR": 2010, "ADGRP": 32},
    )


def references(spark):
    return genre_reference(spark, (1, 1, 1)), channel_reference(spark, (1, 1, 1))


def published(spark, root=None):
    built = weekly.Rollups(data(spark), *references(spark))
    return weekly.publish_tables(built, Builds(spark, root or scratch_path(spark, "builds")))


def state(tables):
    """All rows of all tables."""
    return {name: rows(getattr(tables, name), *getattr(tables, name).columns) for name in weekly.WEEKLY_TABLES}


def reader(spark, builds, number=None):
    """What somebody else sees who opens the folder now."""
    return weekly.PublishedRollups(data(spark), *references(spark), Builds(spark, builds.root), number)


def repaired(spark):
    return weeks.repair_year_end(data(spark), REPAIR)


def test_rebuild_equals_full_build_and_old_build_stays(spark):
    first = published(spark)
    before = state(first)
    second = weekly.publish_weeks(first, repaired(spark), weeks.repaired_weeks(REPAIR))
    full = weekly.Rollups(repaired(spark), *references(spark))
    for name in weekly.WEEKLY_TABLES:
        found, expected = getattr(second, name), getattr(full, name)
        assert found.columns == expected.columns
        assert rows(found, *found.columns) == rows(expected, *found.columns), name
    assert (first.number, second.number) == (0, 1) and Builds(spark, first.builds.root).numbers() == [0, 1]
    assert state(reader(spark, first.builds, 0)) == before != state(reader(spark, first.builds))
    weeks_of = {r.WEEK_KEY for r in second.builds.contents().where("name = 'program'").collect()}
    assert weeks_of == {201552, 201510, 201452, 201010}


@pytest.mark.parametrize("name", ["program", "genre_channel", "genre_base"])
def test_failure_at_any_table_leaves_the_old_build(spark, monkeypatch, name):
    first = published(spark)
    before, write = state(first), Builds.write

    def failing(self, table, build, df):
        if table == name:
            raise OSError("disk gone")
        return write(self, table, build, df)

    monkeypatch.setattr(Builds, "write", failing)
    with pytest.raises(OSError):
        weekly.publish_weeks(first, repaired(spark), weeks.repaired_weeks(REPAIR))
    monkeypatch.undo()
    assert Builds(spark, first.builds.root).numbers() == [0]
    assert state(reader(spark, first.builds)) == before
    again = weekly.publish_weeks(first, repaired(spark), weeks.repaired_weeks(REPAIR))
    assert again.number == 1 and rows(again.program, "WEEK_KEY", "ADGRP")[-1] == (201552, Decimal(6))


def test_killed_process_leaves_the_old_build(spark, tmp_path):
    """The writer's process ends for good after two tables were written and before the third."""
    root = f"file://{tmp_path}/builds"
    first = published(spark, root)
    before = state(first)
    script = textwrap.dedent(f"""
        import os, sys
        sys.path[:0] = [{str(Path(__file__).parent)!r}, {str(Path(__file__).parents[1])!r}]
        import test_builds
        from reachlens.operators import weeks
        from reachlens.plans import weekly
        from reachlens.session import build_session
        from reachlens.sources.builds import Builds
        spark = build_session("killed", 2, spark__sql__shuffle__partitions="2", spark__sql__warehouse__dir={str(tmp_path / "w")!r})
        write = Builds.write
        def dying(self, name, build, df):
            if name == "genre_channel":
                os._exit(9)
            return write(self, name, build, df)
        Builds.write = dying
        old = weekly.PublishedRollups(test_builds.data(spark), *test_builds.references(spark), Builds(spark, {root!r}))
        weekly.publish_weeks(old, test_builds.repaired(spark), weeks.repaired_weeks(test_builds.REPAIR))
    """)
    ended = subprocess.run([sys.executable, "-c", script], timeout=300, capture_output=True, cwd=tmp_path)
    assert ended.returncode == 9, ended.stderr[-2000:]
    left = [p for p in (tmp_path / "builds" / "program").iterdir() if p.name.startswith("build=")]
    assert len(left) == 2  # the dead writer's rows are there, but no list names them
    assert Builds(spark, root).numbers() == [0] and state(reader(spark, first.builds)) == before
    first.builds.vacuum(older_than=-60)
    assert len(list((tmp_path / "builds" / "program").glob("build=*"))) == 1
    assert state(reader(spark, first.builds)) == before


def test_second_build_on_the_same_base_is_refused(spark):
    first = published(spark)
    weekly.publish_weeks(first, repaired(spark), weeks.repaired_weeks(REPAIR))
    after = state(reader(spark, first.builds))
    with pytest.raises(Conflict):
        weekly.publish_retention(first)
    assert first.builds.numbers() == [0, 1] and state(reader(spark, first.builds)) == after
    assert not [n for n in first.builds._names("_builds") if n.startswith(".") and not n.endswith(".crc")]


def test_retention_touches_no_data(spark, monkeypatch):
    first = published(spark)
    monkeypatch.setattr(Builds, "write", None)
    monkeypatch.setattr(Builds, "rows", None)
    kept = weekly.publish_retention(first)
    monkeypatch.undo()
    for name in weekly.WEEKLY_TABLES:
        expected = weeks.retain_recent(getattr(first, name)) if name == "program" else getattr(first, name).where("WEEK_KEY > 201452")
        columns = expected.columns
        assert rows(getattr(kept, name), *columns) == rows(expected, *columns)
    assert state(reader(spark, first.builds, 0)) == state(first)


def test_newest_week_reads_no_table(spark):
    first = published(spark)
    newest = first.builds.newest_week("program")
    assert newest.first().max_week == 201652 and "FileScan" not in plan_text(newest)
    assert Builds(spark, scratch_path(spark, "none")).newest_week("program").first().max_week is None


def test_week_range_prunes_folders(spark):
    first = published(spark)
    second = weekly.publish_weeks(first, repaired(spark), weeks.repaired_weeks(REPAIR))
    plan = plan_text(second.program.where("WEEK_KEY BETWEEN 201500 AND 201520"))
    assert "PartitionFilters: [" in plan and "DataFilters: []" in plan
    files = second.program.where("WEEK_KEY = 201510").inputFiles()
    assert files and all("WEEK_KEY" in f for f in files)


def test_vacuum_keeps_what_lists_name(spark):
    first = published(spark)
    second = weekly.publish_weeks(first, repaired(spark), weeks.repaired_weeks(REPAIR))
    third = weekly.publish_retention(second)
    last = state(third)
    third.builds.vacuum(keep=2)
    assert third.builds.numbers() == [1, 2] and state(reader(spark, third.builds, 1)) == state(second)
    third.builds.vacuum(keep=1, older_than=-60)
    assert third.builds.numbers() == [2] and state(reader(spark, third.builds)) == last
    found = {n for b in third.builds._names("program") for n in third.builds._names("program", b) if n.startswith("WEEK_KEY")}
    assert found == {"WEEK_KEY=201452", "WEEK_KEY=201510", "WEEK_KEY=201552"}


def test_rows_without_a_week_and_empty_tables(spark):
    builds = Builds(spark, scratch_path(spark, "builds"))
    stage = builds.stage()
    stage.replace("t", spark.createDataFrame([(1, None), (2, 201501)], "a int, WEEK_KEY int"))
    stage.replace("none", spark.createDataFrame([], "WEEK_KEY int, a string"))
    assert builds.newest() is None and stage.publish() == 0
    assert rows(builds.read("t"), "a", "WEEK_KEY") == [(1, None), (2, 201501)]
    assert builds.read("none").columns == ["WEEK_KEY", "a"] and builds.read("none").isEmpty()
    stage = builds.stage()
    stage.replace_weeks("t", spark.createDataFrame([], "a int, WEEK_KEY int"), [201501])
    stage.replace_weeks("none", spark.createDataFrame([(201502, "x")], "WEEK_KEY int, a string"), [201502])
    stage.publish()
    assert rows(builds.read("t"), "a", "WEEK_KEY") == [(1, None)] and rows(builds.read("none"), "a") == [("x",)]
    with pytest.raises(KeyError):
        builds.read("unknown")
