"""SubRip text: parsing, rendering, a Python data source (``format("srt")``) and a safe sink."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType

from cuewright.functions.timecode import format_ms, parse_ms

CLOCK = r"(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"
TAGS = r"<[^>]+>|\{\\[^}]*\}"
TIMES = r"\d+:\d{1,2}:\d{1,2}[,.]\d{1,3}\s*-->\s*\d+:\d{1,2}:\d{1,2}[,.]\d{1,3}"


def parse_srt(files: DataFrame, strip_tags: bool = True) -> DataFrame:
    """(film, cue_idx, start_ms, end_ms, text) of subtitle bodies (film, body).

    Blocks are divided by blank lines; a block's first line with times counts, whatever stands before
    it; blocks without text are dropped; cues are numbered from 0 by start.
    """
    body = F.regexp_replace(F.regexp_replace("body", "^﻿", ""), "\r\n?", "\n")
    blocks = files.select("film", F.posexplode(F.split(body, r"\n[ \t]*\n")).alias("block", "raw"))
    lines = blocks.select("film", "block", F.split("raw", "\n").alias("lines"))
    at = F.array_position(F.transform("lines", lambda x: x.rlike(TIMES)), True)
    found = lines.withColumn("at", at.cast("int")).where("at > 0")
    clock = F.element_at("lines", F.col("at"))
    text = F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines"), F.lit(1))), "\n")
    if strip_tags:
        text = F.regexp_replace(text, TAGS, "")
    text = F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    sides = F.split(clock, "-->")
    cues = found.select("film", "block", parse_ms(F.get(sides, F.lit(0))).alias("start_ms"), parse_ms(F.get(sides, F.lit(1))).alias("end_ms"), text.alias("text")).where("text <> ''")
    from cuewright.operators.sequence import order

    return cues.select("film", (F.row_number().over(order("start_ms", "block")) - 1).alias("cue_idx"), "start_ms", "end_ms", "text")


def render_srt(cues: DataFrame) -> DataFrame:
    """(film, body): numbered blocks in cue order. A film's cues are one file, so they are gathered per film."""
    block = F.concat(F.lit("\n"), format_ms(F.col("start_ms")), F.lit(" --> "), format_ms(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    listed = cues.groupBy("film").agg(F.sort_array(F.collect_list(F.struct("cue_idx", block.alias("b")))).alias("s"))
    numbered = F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), x.b))
    return listed.select("film", F.array_join(numbered, "\n").alias("body"))


def decoded(raw: bytes) -> str:
    """Text of a subtitle file: UTF-8 with or without a mark, else Windows-1252, else Latin-1."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


@pandas_udf(StringType())
def decode_bytes(content: pd.Series) -> pd.Series:
    return content.map(decoded, na_action="ignore")


def load_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all subtitle files under ``path``; ``film`` is the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.srt").load(path)
    return parse_srt(files.select(F.col("path").alias("film"), decode_bytes("content").alias("body")))


class SrtSource(DataSource):
    """``spark.read.format("srt").load(folder)``: one partition per file, from any file system that Arrow opens
    by its URI (``file``, ``hdfs``, ``s3``, ``gs``) or a path that driver and executors share.

    Files are decoded and parsed as by ``load_srt``, without a Spark plan of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return "film string, cue_idx int, start_ms bigint, end_ms bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return SrtReader(self.options["path"])


def _opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else Path(path.removeprefix("file:")).absolute().as_uri())


class SrtReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, top = _opened(self.path)
        if files.get_file_info(top).type == FileType.File:
            return [InputPartition(top)]
        found = files.get_file_info(FileSelector(top, recursive=True))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == FileType.File and f.extension == "srt"]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _opened(self.path)[0].open_input_stream(partition.value) as f:
            body = decoded(f.read())
        cues = []
        for block in re.split(r"\n[ \t]*\n", re.sub("\r\n?", "\n", body)):
            lines = iter(block.split("\n"))
            clock = next((x for x in lines if re.search(TIMES, x)), None)
            text = "\n".join(x for x in (re.sub(TAGS, "", x).strip(" ") for x in lines) if x) if clock else ""
            if text:
                begin, end = (int(h) * 3_600_000 + int(m) * 60_000 + int(s) * 1000 + int(f.ljust(3, "0")) for h, m, s, f in re.findall(CLOCK, clock)[:2])
                cues.append((begin, end, text))
        cues.sort(key=lambda c: c[0])
        yield from ((partition.value, i, *c) for i, c in enumerate(cues))


def place_output(part: str, target: str, may_replace: bool) -> bool:
    """Move a finished file into place. An existing target is only replaced if that is allowed; false otherwise."""
    if may_replace:
        os.replace(part, target)
        return True
    try:
        os.link(part, target)
    except FileExistsError:
        return False
    except OSError:
        if os.path.exists(target):
            return False
        os.rename(part, target)
        return True
    os.unlink(part)
    return True
