"""Sums over the batches of a stream, kept as a merge tree of committed ranges of batches.

Every batch is a range of its own at first. Where ``fanout`` ranges of one level
would stand side by side, the batch that completes them writes their sum instead, as
one range of the next level. So n batches are at most ``(fanout - 1) * log n`` ranges,
each row is written once a level, and every batch is a single write.

A version is a small file that names the ranges. It is written last, under a new
name, and is the commit: readers take the newest version, so they never see a batch
half-written or twice, and a batch that is tried again after its commit adds nothing.
The newest ``versions`` versions stay, with all that they name, for readers that
began earlier; what no kept version names is removed, and so is what a failed attempt
left behind. There may be one writer at a time, as a streaming query is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from triflux.functions.files import Folder
from triflux.functions.hashing import check_positive

FANOUT = 4
VERSIONS = 16


@dataclass(frozen=True)
class Range:
    """The batches ``low`` to ``high``, whose sums are in ``folder``."""

    level: int
    low: int
    high: int
    folder: str
    total: int


@dataclass(frozen=True)
class Version:
    """What is committed: the ranges of all batches up to ``batch``."""

    batch: int = -1
    ranges: tuple[Range, ...] = ()

    @property
    def total(self) -> int:
        """The sum of the measure over all batches."""
        return sum(r.total for r in self.ranges)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Version:
        found = json.loads(text)
        return cls(found["batch"], tuple(Range(**r) for r in found["ranges"]))


def carried(
    ranges: tuple[Range, ...], fanout: int
) -> tuple[tuple[Range, ...], tuple[Range, ...], int]:
    """Which ranges the next batch leaves alone, which it is added up with, and its level then.

    Full levels carry over into the next one, as in a counter.
    """
    stay, level = len(ranges), 0
    while stay >= fanout - 1 and ranges[stay - fanout + 1].level == level:
        stay -= fanout - 1
        level += 1
    return ranges[:stay], ranges[stay:], level


class MergeTree:
    """Rows ``(*keys, *values)`` of batches: values are sums, and add up where keys agree.

    Without values rows are only put together. ``measure`` names the column whose sum is known without reading the rows.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        values: Sequence[str],
        measure: str | None = None,
        fanout: int = FANOUT,
        versions: int = VERSIONS,
    ) -> None:
        check_positive(fanout=fanout - 1, versions=versions)
        self._spark, self._path = spark, path.rstrip("/")
        self._keys, self._values, self._measure = list(keys), list(values), measure
        self._fanout, self._kept = fanout, versions
        self._versions = Folder(spark, f"{self._path}/versions")
        self._data = Folder(spark, f"{self._path}/data")

    def version(self) -> Version:
        """The newest version; one without batches where nothing is committed."""
        names = [x for x in self._versions.names() if x.endswith(".json")]
        return Version.from_json(self._versions.read(names[-1])) if names else Version()

    def read(self, schema: StructType | str, version: Version | None = None) -> DataFrame:
        """The rows of all ranges of a version, by default the newest: not yet added up.

        No rows of the schema where nothing is committed.
        """
        ranges = (version or self.version()).ranges
        if not ranges:
            return self._spark.createDataFrame([], schema)
        folders = [self.folder(r.folder) for r in ranges]
        return self._spark.read.schema(schema).parquet(*folders)

    def summed(self, schema: StructType | str, version: Version | None = None) -> DataFrame:
        """The rows of a version with one row for all keys that agree."""
        return self._sum(self.read(schema, version))

    def add(self, rows: DataFrame, batch: int) -> Version:
        """Commits the next batch, unless it is committed, and returns the newest version."""
        before = self.version()
        if batch <= before.batch:
            return before
        stay, gone, level = carried(before.ranges, self._fanout)
        own = rows.select(*self._keys, *self._values)
        if gone:
            own = self._sum(own.unionByName(self.read(own.schema, replace(before, ranges=gone))))
        low = gone[0].low if gone else batch
        name = f"{low}-{batch}-{uuid.uuid4().hex}"
        own.write.parquet(self.folder(name))
        total = 0
        if self._measure:
            written = rows.sparkSession.read.schema(own.schema).parquet(self.folder(name))
            total = written.agg(F.sum(self._measure)).first()[0] or 0
        return self._commit(Version(batch, (*stay, Range(level, low, batch, name, total))))

    def replace(self, rows: DataFrame, batch: int) -> Version:
        """Commits rows in place of all that there are, unless the batch is committed."""
        before = self.version()
        if batch <= before.batch:
            return before
        name = f"0-{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(self.folder(name))
        return self._commit(Version(batch, (Range(0, 0, batch, name, 0),)))

    def _commit(self, after: Version) -> Version:
        self._versions.write(f"{after.batch:020d}.json", after.to_json())
        self._clean()
        return after

    def folder(self, name: str) -> str:
        """Where the rows of a range are."""
        return f"{self._path}/data/{name}"

    def _sum(self, rows: DataFrame) -> DataFrame:
        if not self._values:
            return rows
        kinds = dict(rows.dtypes)
        sums = [F.sum(x).cast(kinds[x]).alias(x) for x in self._values]
        return rows.groupBy(*self._keys).agg(*sums)

    def _clean(self) -> None:
        names = [x for x in self._versions.names() if x.endswith(".json")]
        kept = {
            r.folder
            for x in names[-self._kept :]
            for r in Version.from_json(self._versions.read(x)).ranges
        }
        for name in names[: -self._kept]:
            self._versions.remove(name)
        for name in self._data.names():
            if name not in kept:
                self._data.remove(name)
