"""Readers and writers of files: dispatch by extension, spreadsheets, snapshots, key-value caches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header and quoted, possibly multi-line cells; all columns are strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    for number, row in enumerate(sheet.iter(f"{_NS}row")):
        cells = []
        for c in row.iter(f"{_NS}c"):
            v = c.find(f"{_NS}v")
            if c.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{_NS}t")))
            elif v is None:
                cells.append("")
            else:
                cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text or "")
        yield number, cells


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells): the first sheet of each spreadsheet; a task reads whole files, which the format asks for."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, n, cells) for p, c in zip(part["path"], part["content"], strict=True) for n, cells in _sheet_rows(c)]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row int, cells array<string>")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A frame from a file, by its extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {
        "csv": read_csv,
        "xlsx": read_xlsx,
        "json": lambda s, p: s.read.json(p),
        "parquet": lambda s, p: s.read.parquet(p),
        "orc": lambda s, p: s.read.orc(p),
        "txt": lambda s, p: s.read.text(p),
    }
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](spark, path)


def list_files(spark: SparkSession, path: str, now: str) -> DataFrame:
    """(path, bytes, age_minutes) of the files under a folder at a stated time; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    age = (F.lit(now).cast("timestamp").cast("long") - F.col("modificationTime").cast("long")) / 60
    return found.select("path", F.col("length").alias("bytes"), F.floor(age).alias("age_minutes"))


def write_snapshot(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame as Parquet under its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").csv(folder, header=True, escape='"')


def fresh_entries(cache: DataFrame, now: int) -> DataFrame:
    """Entries (kind, key, value, expires) of a cache table that have not expired."""
    return cache.where(F.col("expires") > now)


def cache_stats(cache: DataFrame, now: int) -> DataFrame:
    alive = F.col("expires") > now
    return cache.groupBy("kind").agg(F.count("*").alias("entries"), F.count_if(~alive).alias("expired"))
