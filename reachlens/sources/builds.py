"""Tables partitioned by week that change together: a build becomes visible by one rename, or not at all.

``<root>/<table>/build=<id>/WEEK_KEY=<week>/`` has the rows of a week as one build wrote them, never changed afterwards.
``<root>/_builds/<number>.json`` lists, for every table, its columns and which build each of its weeks is read from. Writing
rows changes nothing for readers. A build is published by renaming its finished list to the next number, which fails if that
number is taken, so of two builds on the same base the second one is refused. A writer that dies before leaves files that no list
names. Readers take the list of one number and so see all tables as that build left them, also while later ones are
published, until ``vacuum`` gives the number up.

Lists have a row per table and week and are read on the driver. Which weeks exist, and the newest of them, is known from
the list; dropping weeks is a new list. Neither reads any data.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachlens.sources.sinks import SLICE, WEEK, by_week

_LISTS = "_builds"
_BUILD = "build"
_NO_WEEK = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another build was published on the same base."""


@dataclass(frozen=True)
class _Table:
    """Columns in their order, and the build that each week is read from."""

    schema: T.StructType
    weeks: dict[int | None, str]


def _one_of(weeks: Sequence[int | None]) -> Column:
    known = [week for week in weeks if week is not None]
    found = F.col(WEEK).isin(known) if known else F.lit(False)
    return F.col(WEEK).isNull() | found if len(known) < len(weeks) else found


class Builds:
    """The builds under one folder, which all executors and writers share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[part for part in parts if part]]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [entry.getPath().getName() for entry in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        """Published builds that can still be read, oldest first."""
        return sorted(int(name.removesuffix(".json")) for name in self._names(_LISTS) if name[0].isdigit())

    def newest(self) -> int | None:
        return max(self.numbers(), default=None)

    def tables(self, number: int | None) -> dict[str, _Table]:
        """The list of a build; None stands for the state before the first one."""
        if number is None:
            return {}
        lines = self.spark.read.text(str(self._path(_LISTS, f"{number:010d}.json"))).collect()
        found = {}
        for line in lines:  # one for each table
            entry = json.loads(line.value)
            schema = T.StructType.fromJson(entry["schema"])
            found[entry["name"]] = _Table(schema, {week: build for week, build in entry["weeks"]})
        return found

    def contents(self, number: int | None = None) -> DataFrame:
        """``name, WEEK_KEY, build``: a row for each table and week of a build, the newest one by default."""
        listed = self.tables(self.newest() if number is None else number)
        rows = [(name, week, build) for name, table in listed.items() for week, build in table.weeks.items()]
        return self.spark.createDataFrame(rows, f"name string, {WEEK} int, {_BUILD} string")

    def newest_week(self, name: str, number: int | None = None) -> DataFrame:
        """``max_week`` of a table, from the list alone."""
        return self.contents(number).where(F.col("name") == name).agg(F.max(WEEK).alias("max_week"))

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as the build left it, the newest build by default."""
        return self.rows(name, self.tables(self.newest() if number is None else number)[name])

    def rows(self, name: str, table: _Table) -> DataFrame:
        """Only the folders of the listed builds are looked into; weeks that others replaced in them are pruned."""
        if not table.weeks:
            return self.spark.createDataFrame([], table.schema)
        by_build: dict[str, list[int | None]] = {}
        for week, build in table.weeks.items():
            by_build.setdefault(build, []).append(week)
        listed = [(F.col(_BUILD) == build) & _one_of(weeks) for build, weeks in by_build.items()]
        schema = T.StructType([*table.schema, T.StructField(_BUILD, T.StringType())])
        reader = self.spark.read.schema(schema).option("basePath", str(self._path(name)))
        found = reader.parquet(*[str(self._path(name, f"{_BUILD}={build}")) for build in by_build])
        return found.where(reduce(Column.__or__, listed)).select(*table.schema.fieldNames())

    def stage(self) -> Stage:
        """A new build on top of the newest one."""
        return Stage(self, self.newest())

    def write(self, name: str, build: str, df: DataFrame) -> dict[int | None, str]:
        """Rows by week in the folder of a build; the weeks that got some."""
        by_week(df).write.partitionBy(WEEK).parquet(str(self._path(name, f"{_BUILD}={build}")))
        return {week: build for week in self._weeks(name, build)}

    def _weeks(self, name: str, build: str) -> list[int | None]:
        values = [n.split("=", 1)[1] for n in self._names(name, f"{_BUILD}={build}") if n.startswith(f"{WEEK}=")]
        return [None if value == _NO_WEEK else int(value) for value in values]

    def publish(self, tables: dict[str, _Table], base: int | None) -> int:
        """Make a list visible as the build after ``base``, by one rename to a name that must be free."""
        number = 0 if base is None else base + 1
        lines = [
            json.dumps({"name": name, "schema": json.loads(table.schema.json()), "weeks": list(table.weeks.items())})
            for name, table in sorted(tables.items())
        ]
        waiting = self._path(_LISTS, f".{uuid.uuid4().hex}")
        stream = self._fs.create(waiting, False)
        try:
            stream.write(bytearray("\n".join(lines).encode()))
        finally:
            stream.close()
        final = self._path(_LISTS, f"{number:010d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(waiting, final, no_options)
        except Py4JJavaError as error:
            if not self._fs.exists(final):
                raise
            self._fs.delete(waiting, False)
            raise Conflict(f"build {number} is already published") from error
        return number

    def vacuum(self, keep: int = 2, older_than: float = 7 * 24 * 3600) -> None:
        """Give up all builds but the newest ``keep``, and delete the weeks that no list names.

        Folders changed within the last ``older_than`` seconds stay, as a build that is being written is in no list yet. Lists
        go before data, so a reader of a build that was given up finds no list rather than half a table.
        """
        for number in self.numbers()[:-keep] if keep else self.numbers():
            self._fs.delete(self._path(_LISTS, f"{number:010d}.json"), False)
        named = {
            (name, build, week)
            for number in self.numbers()
            for name, table in self.tables(number).items()
            for week, build in table.weeks.items()
        }
        latest = (time.time() - older_than) * 1000
        for name in self._names():
            if name == _LISTS:
                continue
            for build in [n.split("=", 1)[1] for n in self._names(name) if n.startswith(f"{_BUILD}=")]:
                folder = self._path(name, f"{_BUILD}={build}")
                if self._fs.getFileStatus(folder).getModificationTime() > latest:
                    continue
                unnamed = [week for week in self._weeks(name, build) if (name, build, week) not in named]
                if len(unnamed) == len(self._weeks(name, build)):
                    self._fs.delete(folder, True)
                else:
                    for week in unnamed:
                        self._fs.delete(self._path(name, f"{_BUILD}={build}", f"{WEEK}={_NO_WEEK if week is None else week}"), True)


class Stage:
    """Changes of several tables on top of a build, seen by nobody else until ``publish``.

    ``read`` gives a table with the changes made so far, so that a coarser table can be built from a finer one.
    """

    def __init__(self, builds: Builds, base: int | None) -> None:
        self.builds, self.base = builds, base
        self._id = f"b{uuid.uuid4().hex}"
        self._tables = dict(builds.tables(base))

    def read(self, name: str) -> DataFrame:
        return self.builds.rows(name, self._tables[name])

    def replace(self, name: str, df: DataFrame) -> None:
        """All rows of a table."""
        self._tables[name] = _Table(df.drop(SLICE).schema, self._write(name, df))

    def replace_weeks(self, name: str, df: DataFrame, weeks: Iterable[int]) -> None:
        """The rows of ``weeks``, which may have none left; other weeks stay with the build that wrote them."""
        table, wanted = self._tables[name], {int(week) for week in weeks}
        rows = df.where(F.col(WEEK).isin(sorted(wanted))).select(*table.schema.fieldNames())
        kept = {week: build for week, build in table.weeks.items() if week not in wanted}
        self._tables[name] = _Table(table.schema, {**kept, **self._write(name, rows)})

    def keep_weeks(self, name: str, kept: Callable[[int | None], bool]) -> None:
        """Drop the other weeks of a table, without touching any data."""
        table = self._tables[name]
        self._tables[name] = _Table(table.schema, {week: build for week, build in table.weeks.items() if kept(week)})

    def weeks(self, name: str) -> Sequence[int | None]:
        return list(self._tables[name].weeks)

    def names(self) -> list[str]:
        return list(self._tables)

    def _write(self, name: str, df: DataFrame) -> dict[int | None, str]:
        build = f"{self._id}-{uuid.uuid4().hex[:8]}"
        return self.builds.write(name, build, df)

    def publish(self) -> int:
        """The number of the build, which from now on readers get. Raises ``Conflict`` if another build was faster."""
        return self.builds.publish(self._tables, self.base)
