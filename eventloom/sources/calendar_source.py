"""A Python data source for folders of iCalendar files: spark.read.format("icalendar").load(dir).

One partition a file; files are listed on the driver, read and unfolded on the executors. The path
must be one that Python can open on every executor; for other stores read the files with
spark.read.text(wholetext=True) and use connectors.calendar."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, summary string, url string, location string, description string, dtstart string, dtend string"


class CalendarFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CalendarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [CalendarFile(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".ics")]

    def read(self, partition: CalendarFile) -> Iterator[tuple]:
        import re

        with open(partition.path, encoding="utf-8", errors="replace") as f:
            text = re.sub(r"\r?\n[ \t]", "", f.read())
        for body in re.findall(r"BEGIN:VEVENT(.*?)END:VEVENT", text, re.S):
            fields: dict[str, str] = {}
            for line in body.splitlines():
                key, sep, value = line.partition(":")
                if sep:
                    fields.setdefault(key.split(";")[0].upper(), re.sub(r"\\([,;\\])", r"\1", re.sub(r"\\[nN]", " ", value)).strip())
            yield (os.path.basename(partition.path), *(fields.get(k) for k in ("SUMMARY", "URL", "LOCATION", "DESCRIPTION", "DTSTART", "DTEND")))


class CalendarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "icalendar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CalendarReader(self.options["path"])


def register(spark: SparkSession) -> None:
    from eventloom.session import ship

    ship(spark)
    spark.dataSource.register(CalendarSource)
