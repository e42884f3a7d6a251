"""Folders of binary series as a Spark data source read by offset, and their writer.

calendars/day.txt has a date a line; features/<instrument>/<field>.day.bin holds
little-endian 32-bit floats, the first being the calendar row at which the rest
begin.  Paths may be of any file system that pyarrow opens.

Instruments and dates to read are options of the source and not filters pushed
to it: with Spark 4.1 a filter that one query pushed to a source in Python was
still in force when another query read the same frame without it.
"""

from __future__ import annotations

import bisect
import datetime
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "datetime date, instrument string, open double, high double, low double, close double, volume double, ret double, vwap double"
# Names of the files of these columns.
FILES = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "ret": "return"}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Instruments(InputPartition):
    """Folder names that one task reads, and the calendar rows [low, high) asked for."""

    def __init__(self, names: list[str], low: int, high: int):
        self.names, self.low, self.high = names, low, high


class SeriesReader(DataSourceReader):
    """Instruments and dates that the options leave are all that is opened and read."""

    def __init__(self, path: str, per_task: int, names: set[str] | None, start: str | None, end: str | None):
        self.path, self.per_task, self.names = path, per_task, names
        system, root = _opened(path)
        with system.open_input_stream(f"{root}/calendars/day.txt") as f:
            lines = f.read().decode().split("\n")
        self.days = [datetime.date.fromisoformat(d.strip()) for d in lines if d.strip()]  # ascending
        self.low = bisect.bisect_left(self.days, datetime.date.fromisoformat(start)) if start else 0
        self.high = bisect.bisect_right(self.days, datetime.date.fromisoformat(end)) if end else len(self.days)

    def partitions(self) -> list[Instruments]:
        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(f"{root}/features", allow_not_found=True))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory)
        if self.names is not None:
            names = [n for n in names if n.upper() in self.names]
        if self.low >= self.high or not names:
            return [Instruments([], 0, 0)]
        return [Instruments(names[i : i + self.per_task], self.low, self.high) for i in range(0, len(names), self.per_task)]

    def read(self, partition: Instruments) -> Iterator[pa.RecordBatch]:
        system, root = _opened(self.path)
        for name in partition.names:
            size = partition.high - partition.low
            cells = {c: self._field(system, f"{root}/features/{name}/{file}.day.bin", partition.low, partition.high) for c, file in FILES.items()}
            keep = np.isfinite(cells["close"][0])
            close = cells["close"][0][keep]

            def column(c: str, other: np.ndarray, cells=cells, keep=keep) -> pa.Array:
                value, held = cells[c]
                return pa.array(np.where(held[keep], value[keep], other))

            dates = pa.array(np.array(self.days, "M8[D]")[partition.low : partition.low + size][keep])
            zero = np.zeros(len(close))
            columns = [dates, pa.array([name.upper()] * len(close), pa.string()), *(column(c, close) for c in ("open", "high", "low", "close")), column("volume", zero), column("ret", zero), pa.array(close)]
            yield pa.RecordBatch.from_arrays(columns, names=["datetime", "instrument", "open", "high", "low", "close", "volume", "ret", "vwap"])

    @staticmethod
    def _field(system: fs.FileSystem, path: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of calendar rows [low, high), and which of them the file has; only that part of it is read."""
        value, held = np.full(high - low, np.nan), np.zeros(high - low, bool)
        if system.get_file_info(path).type != fs.FileType.File:
            return value, held
        with system.open_input_file(path) as f:
            floats = f.size() // 4
            if floats:
                first = int(np.frombuffer(f.read_at(4, 0), "<f4")[0])
                a, b = max(low, first), min(high, first + floats - 1)
                if a < b:
                    value[a - low : b - low] = np.frombuffer(f.read_at(4 * (b - a), 4 * (1 + a - first)), "<f4")
                    held[a - low : b - low] = True
        return value, held


class BinarySeries(DataSource):
    """Format binary_series; options: path, instruments_per_task, instruments (a JSON list), start, end."""

    @classmethod
    def name(cls) -> str:
        return "binary_series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SeriesReader:
        get = self.options.get
        names = {n.upper() for n in json.loads(get("instruments"))} if get("instruments") else None
        return SeriesReader(self.options["path"], int(get("instruments_per_task", 64)), names, get("start"), get("end"))


def read_series(spark: SparkSession, root: str, instruments: Sequence[str] | None = None, start: str | None = None, end: str | None = None, instruments_per_task: int = 64) -> DataFrame:
    """datetime, instrument, open, high, low, close, volume, ret, vwap of a folder of binary series.

    Only the given instruments (all without a list) are opened, and of their
    files only the days from start to end, both included.  Rows without a finite
    close are left out; fields that a file lacks are the close, and volume and
    ret 0.  A folder without instruments is an empty table.
    """
    spark.dataSource.register(BinarySeries)
    options = {"start": start, "end": end, "instruments": None if instruments is None else json.dumps(list(instruments))}
    reader = spark.read.format("binary_series").option("instruments_per_task", instruments_per_task)
    return reader.options(**{k: v for k, v in options.items() if v is not None}).load(root)


def write_series(panel: DataFrame, root: str, fields: Sequence[str] = ("open", "high", "low", "close", "volume")) -> int:
    """Writes a panel as such a folder, a task for each instrument; returns the number of instruments.

    Rows without instrument or datetime are left out; of rows of one key any one
    counts.  Days of the calendar, a row for each date, pass through the driver.
    A task that is run again writes the same files again.
    """
    panel = panel.select(F.col("datetime").cast("date").alias("datetime"), F.lower("instrument").alias("instrument"), *(F.col(f).cast("double").alias(f) for f in fields)).dropna(subset=["datetime", "instrument"])
    days = [r.datetime for r in panel.select("datetime").distinct().orderBy("datetime").collect()]
    calendar = np.array(days, "M8[D]")
    system, folder = _opened(root)
    system.create_dir(f"{folder}/calendars", recursive=True)
    with system.open_output_stream(f"{folder}/calendars/day.txt") as f:
        f.write("\n".join(str(d) for d in days).encode())
    names = [FILES.get(f, f) for f in fields]

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        system, folder = _opened(root)
        if "/" in key[0] or key[0] in ("", ".", ".."):
            raise ValueError(f"{key[0]!r} cannot name a folder")
        system.create_dir(f"{folder}/features/{key[0]}", recursive=True)
        at = np.searchsorted(calendar, rows["datetime"].to_numpy("M8[D]"))
        for field, name in zip(fields, names, strict=True):
            series = np.full(int(at.max() - at.min()) + 2, np.nan, "<f4")
            series[0] = at.min()
            series[1 + at - at.min()] = rows[field].to_numpy(float)
            with system.open_output_stream(f"{folder}/features/{key[0]}/{name}.day.bin") as f:
                f.write(series.tobytes())
        return pd.DataFrame({"n": [len(rows)]})

    return panel.groupBy("instrument").applyInPandas(write, "n long").count()
