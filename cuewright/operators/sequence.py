"""Ordered-sequence building blocks: islands, clamps, fills, clusters, rolling medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cuewright import rules as R
from cuewright.functions import text as T


def order(*columns: str, by: str = "film") -> WindowSpec:
    return Window.partitionBy(by).orderBy(*columns)


def islands(df: DataFrame, starts: Column, spec: WindowSpec, name: str = "island") -> DataFrame:
    """Number runs of rows; a run begins where ``starts`` is true (null counts as true)."""
    flag = F.coalesce(starts, F.lit(True)).cast("int")
    return df.withColumn("__starts", flag).withColumn(name, F.sum("__starts").over(spec.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def pause_runs(words: DataFrame, pause_ms: int = 600) -> DataFrame:
    """``run``: a new one after a pause of ``pause_ms`` or more since the previous word's end."""
    spec = order("idx")
    return islands(words, F.col("start_ms") - F.lag("end_ms").over(spec) >= pause_ms, spec, "run")


def clamp_words(words: DataFrame, most_ms: int = 2000) -> DataFrame:
    """Words end at most ``most_ms`` after they start and not after the next word starts."""
    limit = F.least("end_ms", F.col("start_ms") + most_ms, F.lead("start_ms").over(order("idx")))
    return words.withColumn("end_ms", F.greatest("start_ms", limit))


def collapse_loops(words: DataFrame, most: int = R.REPEATS_KEPT) -> DataFrame:
    """Keep ``most`` words of a run of equal ones; words without letters are always kept."""
    spec = order("idx")
    keyed = words.withColumn("key", T.word_key(F.col("text")))
    again = (F.col("key") != "") & (F.col("key") == F.lag("key").over(spec))
    runs = islands(keyed, ~again, spec, "loop")
    place = F.row_number().over(Window.partitionBy("film", "loop").orderBy("idx"))
    return runs.withColumn("place", place).where(F.col("place") <= most).drop("key", "loop", "place")


def loop_flags(words: DataFrame, least: int = 3) -> DataFrame:
    """``looped``: the word is one of ``least`` or more equal ones in a row."""
    spec = order("idx")
    keyed = words.withColumn("key", T.letters_key(T.edge_part(F.col("text"), "core")))
    again = (F.col("key") != "") & (F.col("key") == F.lag("key").over(spec))
    runs = islands(keyed, ~again, spec, "loop")
    return runs.withColumn("looped", (F.col("key") != "") & (F.count("*").over(Window.partitionBy("film", "loop")) >= least)).drop("loop")


def cut_clusters(candidates: DataFrame, gap: float = R.CLUSTER_S, dominance: float = R.DOMINANCE) -> DataFrame:
    """Cuts among candidates (film, t, score): the single ones, and of chains closer than ``gap`` the one
    that scores ``dominance`` times the next, if any. Chains are summed up, never gathered."""
    spec = order("t", "score")
    chained = islands(candidates, F.col("t") - F.lag("t").over(spec) >= gap, spec, "chain")
    rank = F.row_number().over(Window.partitionBy("film", "chain").orderBy(F.desc("score"), "t"))
    top = chained.withColumn("rank", rank).groupBy("film", "chain").agg(
        F.count("*").alias("n"), F.min_by("t", "rank").alias("t"), F.max("score").alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next")
    )
    return top.where((F.col("n") == 1) | (F.col("best") >= dominance * F.col("next"))).select("film", "t", F.col("best").alias("score"), "n")


def enforce_order(words: DataFrame) -> DataFrame:
    """Words start no earlier than any word before them ends; ends follow starts."""
    before = F.max("end_ms").over(order("idx").rowsBetween(Window.unboundedPreceding, -1))
    late = F.col("start_ms") < before
    return words.select(
        *(c for c in words.columns if c not in ("start_ms", "end_ms")),
        F.when(late, before).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(late, F.greatest("end_ms", before)).otherwise(F.col("end_ms")).alias("end_ms"),
    )


def fill_gaps(words: DataFrame) -> DataFrame:
    """Words without times take the space between the nearest timed ones on either side."""
    behind = order("idx").rowsBetween(Window.unboundedPreceding, -1)
    ahead = order("idx").rowsBetween(1, Window.unboundedFollowing)
    before, after = F.last("end_ms", True).over(behind), F.first("start_ms", True).over(ahead)
    low = F.coalesce(before, after)
    return words.select(
        *(c for c in words.columns if c not in ("start_ms", "end_ms")),
        F.coalesce("start_ms", low).alias("start_ms"), F.coalesce("end_ms", F.greatest(low, F.coalesce(after, before))).alias("end_ms"),
    )


def core_spans(segments: DataFrame, words: DataFrame) -> DataFrame:
    """``lo``, ``hi``: a segment's span with the spans of its words (film, seg, start_ms, end_ms), if it has any."""
    spans = words.groupBy("film", "seg").agg(F.min("start_ms").alias("w_start"), F.max("end_ms").alias("w_end"))
    rows = segments.join(spans, ["film", "seg"], "left")
    return rows.withColumns({"lo": F.least("start_ms", "w_start"), "hi": F.greatest("end_ms", "w_end")}).drop("w_start", "w_end")


def audio_windows(segments: DataFrame, pad_ms: int = 500, overlap_ms: int = 250) -> DataFrame:
    """``w_lo``, ``w_hi``: each segment with padding that reaches only a little into its neighbours
    (columns lo, hi: its core; total: the film's length)."""
    spec = order("seg")
    low = F.greatest(F.col("lo") - pad_ms, F.coalesce(F.least("lo", F.lag("hi").over(spec) - overlap_ms), F.col("lo") - pad_ms))
    high = F.least(F.col("hi") + pad_ms, F.coalesce(F.greatest("hi", F.lead("lo").over(spec) + overlap_ms), F.col("hi") + pad_ms))
    out = segments.withColumns({"w_lo": F.greatest(F.lit(0), low), "w_hi": F.least("total", high)})
    return out.withColumn("w_hi", F.greatest("w_lo", "w_hi"))


def local_offsets(anchors: DataFrame, neighbours: int = R.LOCAL_NEIGHBOURS) -> DataFrame:
    """``local``: each anchor's d less the median d of the ``neighbours`` anchors on either side of it
    in time, other than those equal to it. Films with fewer than three anchors give no rows."""
    spec = order("t", "d")
    # The first anchor with this time is the middle of the window, wherever equal times follow: all of a run take its list.
    ranked = anchors.withColumn("rn", F.row_number().over(spec) - 1).withColumn("n", F.count("*").over(Window.partitionBy("film")))
    ranked = ranked.withColumn("mid", F.min("rn").over(Window.partitionBy("film", "t")))
    near = F.collect_list(F.struct("t", "d")).over(spec.rowsBetween(-neighbours, neighbours))
    listed = ranked.withColumn("near", F.when(F.col("rn") == F.col("mid"), near)).withColumn("near", F.max("near").over(Window.partitionBy("film", "t")))
    others = F.filter("near", lambda a: ~((a.t == F.col("t")) & (a.d == F.col("d"))))
    values = F.sort_array(F.transform(others, lambda a: a.d))
    size = F.size("values")
    middle = (F.get("values", F.floor((size - 1) / 2).cast("int")) + F.get("values", F.floor(size / 2).cast("int"))) / 2
    out = listed.where("n >= 3").withColumn("values", values).where(F.size("values") > 0)
    return out.select("film", "t", "d", (F.col("d") - middle).alias("local"))
