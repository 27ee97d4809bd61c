"""Daily filing lists kept by day (``files.write_days``) as a data source of Spark: ``spark.read.format("filing_days")``.

A day is a partition; a condition on ``date`` is pushed down, so that other days aren't opened. As a stream its offset is the day: a
day is read once, when it or a later one has come. Folders of any file system that Arrow opens.
"""

from __future__ import annotations

import datetime as dt
import gzip
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from .files import FILING, FILING_NUMBERS

SCHEMA = "date date, " + ", ".join(f"{n} string" for n in FILING) + ", " + ", ".join(f"{n} int" for n in FILING_NUMBERS) + ", other map<string, string>"
_DAY = re.compile(r"date=(\d{4}-\d{2}-\d{2})/[^/]*$")


@dataclass
class Day(ds.InputPartition):
    day: str
    files: tuple[str, ...]


def _text(value: object) -> str | None:
    if value is None:
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _number(value: object) -> int | None:
    try:
        return int((_text(value) or "").strip())
    except ValueError:
        return None


def rows_of(text: str) -> Iterator[tuple]:
    """The results of a day's list; none of a text that is no JSON, an error of a status that isn't 200."""
    try:
        found = json.loads(text)
    except ValueError:
        return
    status = _text((found.get("metadata") or {}).get("status")) if isinstance(found, dict) else None
    if status is None:
        return
    if status != "200":
        raise ValueError(f"filing list with status {status}")
    for r in found.get("results") or []:
        known = [(_text(r.get(n)) or "").strip() or None for n in FILING] + [_number(r.get(n)) for n in FILING_NUMBERS]
        yield *known, {k: _text(v) for k, v in r.items() if k not in (*FILING, *FILING_NUMBERS)}


class _Folder:
    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def days(self) -> dict[str, list[str]]:
        """Files by day; only names are read."""
        found: dict[str, list[str]] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.path, recursive=True, allow_not_found=True)):
            day = _DAY.search(info.path)
            if info.type == fs.FileType.File and day and not info.path.rsplit("/", 1)[1].startswith((".", "_")):
                try:
                    found.setdefault(dt.date.fromisoformat(day[1]).isoformat(), []).append(info.path)
                except ValueError:
                    continue
        return found

    def read(self, day: Day) -> Iterator[tuple]:
        for name in sorted(day.files):
            with self.files.open_input_stream(name, compression=None) as stream:
                content = stream.read()
            try:
                text = (gzip.decompress(content) if name.endswith(".gz") else content).decode("utf-8")
            except (OSError, EOFError, UnicodeDecodeError):
                continue  # cut off: the day will come again
            for row in rows_of(text):
                yield (dt.date.fromisoformat(day.day), *row)


class _Reader(ds.DataSourceReader):
    def __init__(self, path: str):
        self.path, self.keeps = path, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        kinds = {ds.EqualTo: lambda d, v: d == v, ds.GreaterThan: lambda d, v: d > v, ds.GreaterThanOrEqual: lambda d, v: d >= v, ds.LessThan: lambda d, v: d < v,
                 ds.LessThanOrEqual: lambda d, v: d <= v, ds.In: lambda d, v: d in v}
        for f in filters:
            if type(f) in kinds and f.attribute == ("date",):
                self.keeps.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Day]:
        found = _Folder(self.path).days()
        return [Day(d, tuple(found[d])) for d in sorted(found) if all(keep(dt.date.fromisoformat(d), v) for keep, v in self.keeps)] or [Day("", ())]

    def read(self, partition: Day) -> Iterator[tuple]:
        return _Folder(self.path).read(partition)


class _Stream(ds.DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        return {"day": max(_Folder(self.path).days(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return [Day(d, tuple(f)) for d, f in sorted(_Folder(self.path).days().items()) if start["day"] < d <= end["day"]]

    def read(self, partition: Day) -> Iterator[tuple]:
        return _Folder(self.path).read(partition)


class FilingDays(ds.DataSource):
    """Option ``path``: the folder that ``files.write_days`` writes."""

    @classmethod
    def name(cls) -> str:
        return "filing_days"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: object) -> _Stream:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FilingDays)
