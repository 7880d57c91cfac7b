"""Shot cuts: log lines, de-duplication, and cues snapped to cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright import rules as R
from cuewright.operators.sequence import cut_clusters, order
from cuewright.rules import DEFAULT_RULES, CueRules

__all__ = ["cut_clusters", "cut_list", "parse_cut_log", "pick_decoder", "snap_cues", "snap_starts"]

BUCKET_MS = 2000


def parse_cut_log(lines: DataFrame) -> DataFrame:
    """(film, t, score) of the detector's lines in (film, value)."""
    found = lambda i: F.regexp_extract("value", r"lavfi\.scd\.score:\s*([\d.]+),\s*lavfi\.scd\.time:\s*(-?[\d.]+)", i)
    return lines.where(found(2) != "").select("film", found(2).cast("double").alias("t"), found(1).cast("double").alias("score"))


def cut_list(cuts: DataFrame) -> DataFrame:
    """(film, cut_ms): distinct cuts at the first whole millisecond not before them."""
    return cuts.select("film", F.ceil(F.col("t") * 1000 - 1e-6).cast("bigint").alias("cut_ms")).distinct()


def pick_decoder(mode: Column, codec: Column) -> Column:
    """``nvdec`` for codecs the hardware knows, unless the mode forces ``cpu``; mode ``off`` gives null."""
    return F.when(mode == "off", None).when((mode == "cpu") | ~codec.isin(R.HARDWARE_CODECS), "cpu").otherwise("nvdec")


def _nearest(points: DataFrame, cuts: DataFrame, low: Column, high: Column, target: Column, name: str) -> DataFrame:
    """``name``: the cut in [low, high] nearest to target (the earlier of two), or null.

    An equi-join on film and time bucket, where a point visits the buckets its range touches, so one
    film with very many cuts is spread.
    """
    asked = points.withColumns({"__lo": low, "__hi": high, "__t": target})
    buckets = F.sequence(F.floor(F.col("__lo") / BUCKET_MS), F.floor(F.col("__hi") / BUCKET_MS))
    asked = asked.select("film", "cue_idx", "__lo", "__hi", "__t", F.explode(buckets).alias("__b"))
    near = cuts.select("film", "cut_ms", F.floor(F.col("cut_ms") / BUCKET_MS).alias("__b"))
    hit = asked.join(near, ["film", "__b"]).where("cut_ms between __lo and __hi")
    best = hit.groupBy("film", "cue_idx").agg(F.min(F.struct(F.abs(F.col("cut_ms") - F.col("__t")).alias("far"), "cut_ms")).alias("m"))
    return points.join(best.select("film", "cue_idx", F.col("m.cut_ms").alias(name)), ["film", "cue_idx"], "left")


def _frames(fps: float) -> tuple[int, int, float]:
    frame = 1000 / fps
    return round(R.SNAP_FRAMES * frame), round(R.SNAP_LATE_FRAMES * frame), frame


def _readable(start: Column, end: Column, old_cps: Column, chars: Column, rules: CueRules) -> Column:
    duration = (end - start) / 1000
    cps = F.when(duration > 0, chars / duration).otherwise(float("inf"))
    return (duration >= rules.min_duration) & (duration <= rules.max_duration) & ((cps <= rules.max_cps) | (cps <= old_cps))


def snap_starts(cues: DataFrame, cuts: DataFrame, fps: float = R.DEFAULT_FPS, rules: CueRules = DEFAULT_RULES) -> DataFrame:
    """Starts moved to the nearest cut from 12 frames before to 4 behind them, where the cue stays within its limits.

    Adds ``new_start_ms`` and ``start_result`` (snapped, skipped, or null where there is nothing to do).
    """
    window, late, frame = _frames(fps)
    gap = round(rules.min_gap * 1000)
    spec = order("start_ms", "cue_idx")
    chars = F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = cues.withColumns({"prev_end": F.lag("end_ms").over(spec), "next_start": F.lead("start_ms").over(spec), "chars": chars})
    rows = _nearest(rows, cuts, F.col("start_ms") - window, F.col("start_ms") + late, F.col("start_ms"), "cut")
    length = (F.col("end_ms") - F.col("start_ms")) / 1000
    old = F.when(length > 0, F.col("chars") / length).otherwise(float("inf"))
    clear = F.coalesce(F.col("cut") - F.col("prev_end") >= gap, F.lit(True)) & F.coalesce(F.col("next_start") - F.col("end_ms") >= gap, F.lit(True))
    ok = _readable(F.col("cut"), F.col("end_ms"), old, F.col("chars"), rules) & clear
    result = F.when(F.col("cut").isNull() | (F.col("cut") == F.col("start_ms")), None).when(ok, "snapped").otherwise("skipped")
    out = rows.withColumn("start_result", result)
    return out.withColumn("new_start_ms", F.when(F.col("start_result") == "snapped", F.col("cut")).otherwise(F.col("start_ms"))).drop("cut", "prev_end", "next_start", "chars")


def snap_cues(cues: DataFrame, cuts: DataFrame, fps: float = R.DEFAULT_FPS, rules: CueRules = DEFAULT_RULES) -> DataFrame:
    """Starts, then ends snapped to cuts (an end stays two frames, or the least gap, before its cut).

    An end's gap to the cue before depends on whether that cue's end moved; a moved end keeps the gap,
    so the only case left is an input that broke it, which is judged by the original ends.
    Adds new_start_ms, new_end_ms, start_result, end_result.
    """
    window, _, frame = _frames(fps)
    least = round(rules.min_gap * 1000)
    gap = max(round(R.GAP_FRAMES * frame), least)
    rows = snap_starts(cues, cuts, fps, rules)
    spec = order("start_ms", "cue_idx")
    target = F.col("end_ms") + gap
    rows = rows.withColumns({"next_start": F.lead("new_start_ms").over(spec), "prev_end": F.lag("end_ms").over(spec), "chars": F.length(F.replace("text", F.lit("\n"), F.lit("")))})
    rows = _nearest(rows, cuts, target - window, target + window, target, "cut")
    moved = F.col("cut") - gap
    length = (F.col("end_ms") - F.col("new_start_ms")) / 1000
    old = F.when(length > 0, F.col("chars") / length).otherwise(float("inf"))
    clear = F.coalesce(F.col("next_start") - moved >= least, F.lit(True))
    own = F.col("cut").isNotNull() & (moved != F.col("end_ms")) & _readable(F.col("new_start_ms"), moved, old, F.col("chars"), rules) & clear
    rows = rows.withColumns({"own_ok": own, "open": F.col("cut").isNotNull() & (moved != F.col("end_ms"))})
    # gap before: given by the input, or restored because the cue before was snapped. ok(k) = own(k) and
    # (gap(k) or ok(k-1)); in a stretch of own without gap it holds up to the last true gap before.
    gap_ok = F.coalesce(F.col("new_start_ms") - F.col("prev_end") >= least, F.lit(True))
    rows = rows.withColumns({"gap_ok": gap_ok, "pos": F.row_number().over(spec)})
    behind = spec.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"last_gap": F.max(F.when(F.col("gap_ok"), F.col("pos"))).over(behind), "last_bad": F.max(F.when(~F.col("own_ok"), F.col("pos"))).over(behind)})
    ok = F.col("own_ok") & (F.coalesce("last_gap", F.lit(0)) > F.coalesce("last_bad", F.lit(0)))
    result = F.when(~F.col("open"), None).when(ok, "snapped").otherwise("skipped")
    rows = rows.withColumn("end_result", result)
    new_end = F.when(F.col("end_result") == "snapped", moved).otherwise(F.col("end_ms"))
    return rows.withColumn("new_end_ms", new_end).drop("cut", "next_start", "prev_end", "chars", "own_ok", "open", "gap_ok", "pos", "last_gap", "last_bad")


def video_stream(streams: Column) -> Column:
    """The first video stream that is no attached picture, of structs (codec_type, attached_pic, ...)."""
    return F.get(F.filter(streams, lambda s: (s.codec_type == "video") & ~F.coalesce(s.attached_pic, F.lit(False))), F.lit(0))


def seconds_or_zero(value: Column) -> Column:
    """A probe's number of seconds; 0 where it is missing or no number."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def on_zero_clock(cuts: DataFrame, start_s: Column) -> DataFrame:
    """Cut times less the stream's start time, to six digits."""
    return cuts.withColumn("t", F.bround(F.col("t") - start_s, 6))
