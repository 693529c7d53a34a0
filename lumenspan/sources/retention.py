"""What a stored table keeps: one small file that a sweep replaces and every reader looks at.

The file names folders (``event_date=.../part=...``) that are gone, and folders whose rows before a time are gone.
It is the commit of a sweep: written beside the data under the next number and put in place by a rename.  Until then
nothing has changed for readers, afterwards everything has, whether or not the folders were deleted already.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_retention"
PARTITION, PART = "event_date", "part"


@dataclass(frozen=True)
class Retention:
    """Folders that are gone, and by folder the time before which its rows are gone."""

    version: int = 0
    gone: frozenset[str] = frozenset()
    trimmed: dict[str, int] = field(default_factory=dict)

    def live(self, table: DataFrame, time: str) -> DataFrame:
        """The rows of the table, with its two partition columns, that are still there."""
        if self.gone:
            table = table.filter(~_inside(self.gone))
        for cutoff in sorted(set(self.trimmed.values())):
            own = [name for name, at in self.trimmed.items() if at == cutoff]
            table = table.filter(~(_inside(own) & F.coalesce(F.col(time) < cutoff, F.lit(False))))
        return table


def folder_name(date: str, part: str) -> str:
    return f"{PARTITION}={date}/{PART}={part}"


def _inside(names) -> Column:
    """Whether the row is in one of the folders."""
    by_date: dict[str, list[str]] = {}
    for name in sorted(names):
        date, part = (piece.split("=", 1)[1] for piece in name.split("/", 1))
        by_date.setdefault(date, []).append(part)
    found = F.lit(False)
    for date, parts in by_date.items():
        found = found | ((F.col(PARTITION) == F.lit(date).cast("date")) & F.col(PART).isin(parts))
    return F.coalesce(found, F.lit(False))


class Store:
    """A table's folder in its file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, folder
        self.files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self) -> bool:
        return self.files.exists(self._path(self.folder))

    def delete(self, name: str) -> None:
        self.files.delete(self._path(f"{self.folder}/{name}"), True)

    def _versions(self) -> list[int]:
        root = self._path(f"{self.folder}/{FOLDER}")
        names = (e.getPath().getName() for e in self.files.listStatus(root)) if self.files.exists(root) else ()
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def retention(self) -> Retention:
        versions = self._versions()
        if not versions:
            return Retention()
        stream = self.files.open(self._path(f"{self.folder}/{FOLDER}/{versions[-1]}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Retention(versions[-1], frozenset(held["gone"]), held["trimmed"])

    def commit(self, after: Retention, gone: frozenset[str], trimmed: dict[str, int]) -> Retention:
        """Put the successor of a retention in place; another one meanwhile is an error."""
        version = after.version + 1
        place = self._path(f"{self.folder}/{FOLDER}/{version}.json")
        draft = self._path(f"{self.folder}/{FOLDER}/.{version}-{self._jvm.java.util.UUID.randomUUID()}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps({"gone": sorted(gone), "trimmed": trimmed}), "utf-8"))
        out.close()
        if self.files.exists(place) or not self.files.rename(draft, place):
            self.files.delete(draft, False)
            raise RuntimeError(f"another sweep of {self.folder} was committed meanwhile")
        for old in self._versions():
            # The version before stays for readers that have just listed it.
            if old < version - 1:
                self.delete(f"{FOLDER}/{old}.json")
        return Retention(version, gone, trimmed)
