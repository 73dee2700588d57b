"""The weekly build: fact to roll-ups to base tables, as lazy frames or as written tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.operators import affinity, rollups
from reachlens.operators.weeks import RETAINED_SPAN
from reachlens.session import materialize
from reachlens.sources import sinks
from reachlens.sources.builds import Builds, Stage


class Rollups:
    """The tables a dashboard request reads, each built from the fact when first asked for.

    Filters of a request reach the fact scan through the aggregations, because they are on the keys.

    ``arranged`` gives the fact as ``sinks.arranged`` wrote it; a source that joins dimensions to its fact can write it
    before the small ones, which then neither are moved nor written. Without it the fact is written as it is.
    """

    def __init__(
        self,
        fact: DataFrame,
        genre_reference: DataFrame,
        channel_reference: DataFrame,
        names_follow_keys: bool = False,
        arranged: Callable[[], DataFrame] | None = None,
    ) -> None:
        self.fact = fact
        self.genre_reference = genre_reference
        self.channel_reference = channel_reference
        self.names_follow_keys = names_follow_keys
        self.arranged = arranged or (lambda: sinks.arranged(fact))

    @cached_property
    def program(self) -> DataFrame:
        return rollups.program_rollup(self.fact, self.names_follow_keys)

    @cached_property
    def genre_channel(self) -> DataFrame:
        return rollups.genre_channel_rollup(self.program)

    @cached_property
    def show(self) -> DataFrame:
        return rollups.show_rollup(self.fact, self.names_follow_keys)

    @cached_property
    def show_base(self) -> DataFrame:
        return rollups.show_base(self.show, self.channel_reference)

    @cached_property
    def channel_base(self) -> DataFrame:
        return rollups.channel_base(self.genre_channel, self.channel_reference)

    @cached_property
    def genre_base(self) -> DataFrame:
        return rollups.genre_base(self.genre_channel, self.genre_reference)

    def cells(self, selection: affinity.Selection, level: affinity.Level) -> affinity.CellTotals:
        """Cell totals of a request."""
        return affinity.cell_totals(self, selection, level)

    def denominator(self, selection: affinity.Selection, level: affinity.Level) -> DataFrame:
        """Affinity denominators of a request."""
        return affinity.affinity_denominator(getattr(self, level.base), selection, level)


class FactOnly(Rollups):
    """A request without roll-up tables.

    The cell sums of a level are one aggregation of the chosen cells, written once because totals, shares and the
    advertiser's sums all read it. Denominators are another one, of the base cells, and only made when asked for.
    Sums of sums are exact, so the results are those of the roll-ups. Needs a fact whose names follow from its keys.

    ``base_rows`` gives the fact in the base cells of a level; a source that joins dimensions to its fact can test the
    cell before those joins. Without it the fact is joined with the reference.
    """

    def __init__(
        self,
        fact: DataFrame,
        genre_reference: DataFrame,
        channel_reference: DataFrame,
        base_rows: Callable[[affinity.Level], DataFrame] | None = None,
    ) -> None:
        super().__init__(fact, genre_reference, channel_reference, names_follow_keys=True)
        self._base_rows = base_rows or self._joined
        self._cells: dict[tuple[affinity.Selection, affinity.Level], affinity.CellTotals] = {}

    def _joined(self, level: affinity.Level) -> DataFrame:
        reference = self.genre_reference if level is affinity.GENRE else self.channel_reference
        return affinity.at_base_cells(self.fact, reference, level)

    def cells(self, selection: affinity.Selection, level: affinity.Level) -> affinity.CellTotals:
        key = (selection, level)
        if key not in self._cells:
            sums = materialize(affinity.sums_of_request(self.fact, selection, level), "request")
            self._cells[key] = affinity.split_sums(sums)
        return self._cells[key]

    def denominator(self, selection: affinity.Selection, level: affinity.Level) -> DataFrame:
        return affinity.affinity_denominator(self._base_rows(level), selection, level)


class TableRollups(Rollups):
    """Roll-ups read from the tables of a database; a week range prunes their partitions."""

    def __init__(
        self, fact: DataFrame, genre_reference: DataFrame, channel_reference: DataFrame, database: str
    ) -> None:
        super().__init__(fact, genre_reference, channel_reference)
        self.database = database

    def _table(self, name: str) -> DataFrame:
        return self.fact.sparkSession.table(f"{self.database}.{name}")

    @cached_property
    def program(self) -> DataFrame:
        return self._table("program")

    @cached_property
    def genre_channel(self) -> DataFrame:
        return self._table("genre_channel")

    @cached_property
    def show(self) -> DataFrame:
        return self._table("show")

    @cached_property
    def show_base(self) -> DataFrame:
        return self._table("show_base")

    @cached_property
    def channel_base(self) -> DataFrame:
        return self._table("channel_base")

    @cached_property
    def genre_base(self) -> DataFrame:
        return self._table("genre_base")


LARGE_TABLES = ("program", "genre_channel", "show")
BASE_TABLES = ("show_base", "channel_base", "genre_base")
WEEKLY_TABLES = (*LARGE_TABLES, *BASE_TABLES)


def write_tables(built: Rollups, database: str, names: Sequence[str] = WEEKLY_TABLES) -> TableRollups:
    """Write roll-ups partitioned by week, the large ones from the fact arranged by week, the bases from the written tables.

    The fact is computed once; the result reads it as it was written. Tables that do not depend on each other are written at
    the same time. A table of ``names`` needs the tables it is built from among them.
    """
    rows = _arranged(built)
    written = TableRollups(rows.fact.drop(sinks.SLICE), built.genre_reference, built.channel_reference, database)

    def write(frames: dict[str, Callable[[], DataFrame]]) -> None:
        wanted = {name: frame for name, frame in frames.items() if name in names}
        _at_once(wanted, lambda name, df: sinks.replace_table(df, f"{database}.{name}", sinks.WEEK))

    write({name: lambda name=name: getattr(rows, name) for name in LARGE_TABLES})
    write({name: lambda name=name: _bases(written)[name]() for name in BASE_TABLES})
    return TableRollups(written.fact, built.genre_reference, built.channel_reference, database)


def _arranged(built: Rollups) -> Rollups:
    """The same roll-ups, made without a shuffle from the fact as it was written once."""
    return Rollups(built.arranged(), built.genre_reference, built.channel_reference, built.names_follow_keys)


def _at_once(frames: dict[str, Callable[[], DataFrame]], write: Callable[[str, DataFrame], None]) -> None:
    """Write tables that do not depend on each other at the same time."""
    with ThreadPoolExecutor(max_workers=max(len(frames), 1)) as pool:
        for job in [pool.submit(lambda name=name, frame=frame: write(name, frame())) for name, frame in frames.items()]:
            job.result()


def _bases(tables: Rollups) -> dict[str, Callable[[], DataFrame]]:
    return {
        "show_base": lambda: rollups.show_base(tables.show, tables.channel_reference),
        "channel_base": lambda: rollups.channel_base(tables.genre_channel, tables.channel_reference),
        "genre_base": lambda: rollups.genre_base(tables.genre_channel, tables.genre_reference),
    }


def rebuild_weeks(
    written: TableRollups,
    repaired_fact: DataFrame,
    weeks: Sequence[int],
    names: Sequence[str] = WEEKLY_TABLES,
    names_follow_keys: bool = False,
) -> TableRollups:
    """Replace single weeks in the roll-up tables.

    The week is part of every grain, so the coarser tables follow week by week as well: nothing
    outside ``weeks`` is read or written.
    """
    database = written.database
    rebuilt = TableRollups(repaired_fact, written.genre_reference, written.channel_reference, database)
    for name, frame in _frames_of_weeks(rebuilt, weeks, names_follow_keys).items():
        if name in names:
            sinks.replace_weeks(frame(), f"{database}.{name}", weeks)
    return TableRollups(repaired_fact, written.genre_reference, written.channel_reference, database)


def _frames_of_weeks(tables: Rollups, weeks: Sequence[int], names_follow_keys: bool) -> dict[str, Callable[[], DataFrame]]:
    """The rows of the weeks in every table, finer tables first; coarser ones are made from ``tables``."""
    listed = F.col(sinks.WEEK).isin([int(week) for week in weeks])
    of_weeks = tables.fact.where(listed)
    return {
        "program": lambda: rollups.program_rollup(of_weeks, names_follow_keys),
        "show": lambda: rollups.show_rollup(of_weeks, names_follow_keys),
        "genre_channel": lambda: rollups.genre_channel_rollup(tables.program.where(listed)),
        **{name: lambda frame=frame: frame().where(listed) for name, frame in _bases(tables).items()},
    }


class PublishedRollups(TableRollups):
    """Roll-ups as one build left them. All tables of a request are of the same build, whatever is published meanwhile."""

    def __init__(
        self, fact: DataFrame, genre_reference: DataFrame, channel_reference: DataFrame, builds: Builds, number: int | None = None
    ) -> None:
        super().__init__(fact, genre_reference, channel_reference, builds.root)
        self.builds = builds
        self.number = builds.newest() if number is None else number

    def _table(self, name: str) -> DataFrame:
        return self.builds.read(name, self.number)


class _StagedRollups(TableRollups):
    """Roll-ups with the changes of a build that is not published yet."""

    def __init__(self, tables: Rollups, stage: Stage) -> None:
        super().__init__(tables.fact, tables.genre_reference, tables.channel_reference, stage.builds.root)
        self._stage = stage

    def _table(self, name: str) -> DataFrame:
        return self._stage.read(name)


def publish_tables(built: Rollups, builds: Builds) -> PublishedRollups:
    """Write all roll-ups and publish them as one build: readers have the tables before it until the last one is complete."""
    stage, rows = builds.stage(), _arranged(built)
    staged = _StagedRollups(built, stage)
    _at_once({name: lambda name=name: getattr(rows, name) for name in LARGE_TABLES}, stage.replace)
    _at_once(_bases(staged), stage.replace)
    return PublishedRollups(rows.fact.drop(sinks.SLICE), built.genre_reference, built.channel_reference, builds, stage.publish())


def publish_weeks(
    published: PublishedRollups, repaired_fact: DataFrame, weeks: Sequence[int], names_follow_keys: bool = False
) -> PublishedRollups:
    """Replace single weeks in all roll-ups by one build.

    A failure at any point leaves every table as it was; running it again starts from there. The rebuild
    stands on the build it read: if another one was published meanwhile, this one is refused.
    """
    builds, references = published.builds, (published.genre_reference, published.channel_reference)
    stage = Stage(builds, published.number)
    staged = _StagedRollups(Rollups(repaired_fact, *references), stage)
    frames = _frames_of_weeks(staged, weeks, names_follow_keys)
    for step in (("program", "show"), ("genre_channel",), BASE_TABLES):
        _at_once({name: frames[name] for name in step}, lambda name, df: stage.replace_weeks(name, df, weeks))
    return PublishedRollups(repaired_fact, *references, builds, stage.publish())


def publish_retention(published: PublishedRollups, span: int = RETAINED_SPAN) -> PublishedRollups:
    """Drop the weeks that are not later than the newest one less ``span`` from all tables, by metadata alone.

    The newest week is that of the program roll-up. Rows without a week go, as they are not later either. ``Builds.vacuum`` frees
    the space later.
    """
    stage = Stage(published.builds, published.number)
    newest = max((week for week in stage.weeks("program") if week is not None), default=None)
    for name in stage.names() if newest is not None else []:
        stage.keep_weeks(name, lambda week: week is not None and week > newest - span)
    references = (published.genre_reference, published.channel_reference)
    return PublishedRollups(published.fact, *references, published.builds, stage.publish())
