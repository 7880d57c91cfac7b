"""File listings: candidate videos, sidecar subtitles, and what still needs subtitles.

A listing has path, size and mtime (seconds). Everything is a filter or an equi-join on the folder, so
large libraries need no driver-side walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import rules as R
from cuewright.functions.text import glob_pattern

VIDEO_SUFFIXES = ["mkv", "mp4", "avi", "m4v", "mov", "ts", "wmv", "webm"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) below ``root``; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def is_ignored(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for glob in globs:
        out = out | F.lower(path).rlike(glob_pattern(glob.lower()))
    return out


def find_videos(files: DataFrame, now: float, globs: list[str] = (), min_age_s: float = 0, suffixes: list[str] = VIDEO_SUFFIXES) -> DataFrame:
    """Videos that are old enough and not ignored; order by (mtime, path) to get the oldest first."""
    path = F.col("path")
    return files.where(suffix(path).isin(suffixes) & ~is_ignored(path, list(globs)) & (F.lit(now) - F.col("mtime") >= min_age_s))


def stale_parts(files: DataFrame, now: float, after_s: float = 3600) -> DataFrame:
    """Unfinished outputs that nothing has touched for ``after_s``."""
    return files.where(F.col("path").endswith(".srt.part") & (F.lit(now) - F.col("mtime") > after_s))


def output_path(path: Column, tag: str, lang: Column) -> Column:
    return F.concat(folder(path), F.lit("/"), stem(path), F.lit(tag + "."), lang, F.lit(".srt"))


def sidecars(videos: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sidecar): subtitle files beside a video whose names begin with its stem and agree up to the first dot."""
    head = lambda c: F.split_part(stem(c), F.lit("."), F.lit(1))
    left = videos.select("path", folder(F.col("path")).alias("dir"), head(F.col("path")).alias("head"), stem(F.col("path")).alias("stem"))
    subs = files.where(suffix(F.col("path")).isin(R.SUBTITLE_SUFFIXES)).select(F.col("path").alias("sidecar"), folder(F.col("path")).alias("dir"), head(F.col("path")).alias("head"))
    return left.join(subs, ["dir", "head"]).where(file_name(F.col("sidecar")).startswith(F.col("stem"))).select("path", "sidecar")


def embedded_subtitles(streams: Column, text_only: bool = False) -> Column:
    """The subtitle streams of a probe's array of structs (codec_type, codec_name, language, ...)."""
    own = F.filter(streams, lambda s: s.codec_type == "subtitle")
    return F.filter(own, lambda s: F.coalesce(s.codec_name, F.lit("")).isin(R.TEXT_SUBTITLE_CODECS)) if text_only else own


def embedded_languages(streams: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(embedded_subtitles(streams), lambda s: F.coalesce(s.language, F.lit("?"))))), ", ")


def needs_subtitles(videos: DataFrame, files: DataFrame, tag: str = ".auto", lang: str = "*", probes: DataFrame | None = None) -> DataFrame:
    """``needs`` and ``reason``: an own output, another sidecar or an embedded track make a video done.

    ``probes`` (path, streams) is optional; a video without a probe is tried.
    """
    found = sidecars(videos, files)
    own = F.when(file_name(F.col("sidecar")).rlike("(?s)^.*" + glob_pattern(f"{tag}.{lang}.srt")[5:]) & file_name(F.col("sidecar")).startswith(F.concat(stem(F.col("path")), F.lit(tag))), F.col("sidecar"))
    sums = found.groupBy("path").agg(F.min(own).alias("own"), F.min("sidecar").alias("any"))
    out = videos.select("path").join(sums, "path", "left")
    reasons = [F.concat(F.lit("output already exists: "), file_name(F.col("own"))), F.concat(F.lit("external subtitles present: "), file_name(F.col("any")))]
    if probes is not None:
        out = out.join(probes.select("path", "streams"), "path", "left")
        reasons.append(F.when(F.size(embedded_subtitles(F.col("streams"))) > 0, F.concat(F.lit("embedded subtitles present ("), embedded_languages(F.col("streams")), F.lit(")"))))
    out = out.withColumn("reason", F.coalesce(*reasons))
    return out.select("path", F.col("reason").isNull().alias("needs"), F.coalesce("reason", F.lit("")).alias("reason"))


def inside_roots(path: Column, roots: list[str]) -> Column:
    """Whether a resolved path is a root or below one, by whole components."""
    out = F.lit(False)
    for root in roots:
        out = out | (path == root) | path.startswith(root.rstrip("/") + "/")
    return out & ~path.rlike(r"(^|/)\.\.(/|$)")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(video, reference, embedded) of a tab-separated list with # comments; ``embedded:n`` gives a track number."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="video string, reference string")
    return rows.withColumn("embedded", F.regexp_extract("reference", r"^embedded:(\d+)$", 1).try_cast("int"))
