"""Comparing cues with a reference: word errors, onset and end errors, offsets and drift."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright import rules as R
from cuewright.functions import text as T
from cuewright.operators.sequence import local_offsets, order


def tokens(cues: DataFrame) -> DataFrame:
    """(film, tok_idx, word, time, cue_idx, first, last): comparison words, timed by their place in the cue (s)."""
    spoken = T.spoken_text(F.col("text"))
    rows = cues.select("film", "cue_idx", "start_ms", "end_ms", spoken.alias("t"))
    rows = rows.withColumn("m", T.surface_words(F.col("t")))
    # Places of the words: each is searched behind the one before it.
    places = F.expr("""aggregate(m, named_struct('at', 1, 'out', cast(array() as array<int>)), (a, w) ->
        named_struct('at', locate(w, t, a.at) + length(w), 'out', concat(a.out, array(locate(w, t, a.at) - 1))), a -> a.out)""")
    rows = rows.withColumn("o", places).select("film", "cue_idx", "start_ms", "end_ms", "t", F.posexplode(F.arrays_zip("m", "o")).alias("p", "x"))
    time = F.col("start_ms") / 1000 + (F.col("end_ms") - F.col("start_ms")) / 1000 * F.col("x.o") / F.greatest(F.length("t"), F.lit(1))
    words = rows.select("film", "cue_idx", "p", time.alias("time"), F.posexplode(T.comparison_words(F.col("x.m"))).alias("q", "word"))
    cue = Window.partitionBy("film", "cue_idx")
    place = F.row_number().over(cue.orderBy("p", "q"))
    numbered = words.withColumns({"first": place == 1, "last": place == F.count("*").over(cue)})
    index = F.row_number().over(order("cue_idx", "p", "q")) - 1
    return numbered.withColumn("tok_idx", index).select("film", "tok_idx", "word", "time", "cue_idx", "first", "last")


def alignment(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(film, tag, i1, i2, j1, j2): edit operations between two token streams. A film's words are one group;
    20,000 against 20,000 take under a second."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left.sort_values("tok_idx")["word"].tolist(), right.sort_values("tok_idx")["word"].tolist()
        ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        return pd.DataFrame([(key[0], *op) for op in ops], columns=["film", "tag", "i1", "i2", "j1", "j2"])

    kind = reference.schema["film"].dataType.simpleString()
    # Aliases give both sides columns of their own where they come from one table.
    sides = [d.select(F.col("film").alias("film"), F.col("tok_idx").alias("tok_idx"), F.col("word").alias("word")).groupBy("film") for d in (reference, hypothesis)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, f"film {kind}, tag string, i1 bigint, i2 bigint, j1 bigint, j2 bigint")


def word_errors(ops: DataFrame) -> DataFrame:
    """(film, n_ref, n_hyp, substitutions, deletions, insertions, matched_ratio, wer, sub_del_rate)."""
    ref, hyp = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    pair = F.least(ref, hyp)
    when = lambda tag, value: F.when(F.col("tag") == tag, value).otherwise(0)
    sums = ops.groupBy("film").agg(
        F.sum(ref).alias("n_ref"), F.sum(hyp).alias("n_hyp"), F.sum(when("equal", ref)).alias("matched"), F.sum(when("replace", pair)).alias("substitutions"),
        F.sum(when("delete", ref) + when("replace", ref - pair)).alias("deletions"), F.sum(when("insert", hyp) + when("replace", hyp - pair)).alias("insertions"),
    )
    share = lambda c: F.coalesce(F.try_divide(c, F.col("n_ref")), F.lit(0.0))
    return sums.withColumns({"matched_ratio": share(F.col("matched")), "wer": share(F.col("substitutions") + F.col("deletions") + F.col("insertions")), "sub_del_rate": share(F.col("substitutions") + F.col("deletions"))})


def anchors(ops: DataFrame, reference: DataFrame, hypothesis: DataFrame, least_run: int = 2) -> DataFrame:
    """(film, kind, t, d): onset and end differences (hypothesis less reference) where matched words both begin, or both end, a cue.

    Ends compare the cues' ends, so tokens need ``cue_start`` and ``cue_end`` (see ``with_cue_times``).
    """
    runs = ops.where((F.col("tag") == "equal") & (F.col("i2") - F.col("i1") >= least_run))
    pairs = runs.select("film", F.posexplode(F.sequence("i1", F.col("i2") - 1)).alias("k", "i"), "j1").select("film", "i", (F.col("j1") + F.col("k")).alias("j"))
    side = lambda d, x, i: d.select("film", F.col("tok_idx").alias(i), *(F.col(c).alias(x + c) for c in ("first", "last", "cue_start", "cue_end")))
    both = pairs.join(side(reference, "r_", "i"), ["film", "i"]).join(side(hypothesis, "h_", "j"), ["film", "j"])
    kinds = F.array(
        F.when(F.col("r_first") & F.col("h_first"), F.struct(F.lit("onset").alias("kind"), F.col("r_cue_start").alias("t"), (F.col("h_cue_start") - F.col("r_cue_start")).alias("d"))),
        F.when(F.col("r_last") & F.col("h_last"), F.struct(F.lit("end").alias("kind"), F.col("r_cue_end").alias("t"), (F.col("h_cue_end") - F.col("r_cue_end")).alias("d"))),
    )
    return both.select("film", F.explode(F.array_compact(kinds)).alias("a")).select("film", "a.kind", "a.t", "a.d")


def with_cue_times(words: DataFrame, cues: DataFrame) -> DataFrame:
    times = cues.select("film", "cue_idx", (F.col("start_ms") / 1000).alias("cue_start"), (F.col("end_ms") / 1000).alias("cue_end"))
    return words.join(times, ["film", "cue_idx"])


def error_stats(points: DataFrame, value: str = "d", by: tuple[str, ...] = ("film", "kind")) -> DataFrame:
    """n, median, median and 90th percentile of the absolute error (s), and percentages within 100, 250 and 500 ms."""
    d = F.col(value)
    within = [(100 * F.avg((F.rint(F.abs(d) * 1000) <= ms).cast("int"))).alias(f"within_{ms}") for ms in R.WITHIN_MS]
    return points.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile(d, F.lit(0.5)).alias("median"), F.percentile(F.abs(d), F.lit(0.5)).alias("median_abs"), F.percentile(F.abs(d), F.lit(0.9)).alias("p90_abs"), *within
    )


def global_offset(points: DataFrame) -> DataFrame:
    """(film, offset): the median onset difference, else the median end difference."""
    of = lambda kind: F.percentile(F.when(F.col("kind") == kind, F.col("d")), F.lit(0.5))
    return points.groupBy("film").agg(F.coalesce(of("onset"), of("end")).alias("offset"))


def drift(points: DataFrame, cues: DataFrame) -> DataFrame:
    """(film, drift, n_early, n_late): how much later onsets are in the last third than in the first."""
    span = cues.groupBy("film").agg((F.min("start_ms") / 1000).alias("t0"), ((F.max("end_ms") - F.min("start_ms")) / 1000).alias("span"))
    rows = points.where("kind = 'onset'").join(span, "film")
    early, late = F.col("t") < F.col("t0") + F.col("span") / 3, F.col("t") >= F.col("t0") + 2 * F.col("span") / 3
    median = lambda test: F.percentile(F.when(test, F.col("d")), F.lit(0.5))
    return rows.groupBy("film").agg((median(late) - median(early)).alias("drift"), F.count_if(early).alias("n_early"), F.count_if(late).alias("n_late"))


def compare(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """One row per film: word errors, offset, corrected onset error, local onset error, drift."""
    ref, hyp = (with_cue_times(tokens(c), c) for c in (reference, hypothesis))
    ops = alignment(ref, hyp)
    points = anchors(ops, ref, hyp)
    offset = global_offset(points)
    fixed = points.join(offset, "film").withColumn("d", F.col("d") - F.col("offset"))
    onset = error_stats(fixed.where("kind = 'onset'"), by=("film",)).select("film", F.col("median_abs").alias("onset_error"), F.col("within_250").alias("onset_within_250"))
    ends = error_stats(fixed.where("kind = 'end'"), by=("film",)).select("film", F.col("median_abs").alias("end_error"))
    local = error_stats(local_offsets(points.where("kind = 'onset'")), "local", ("film",)).select("film", F.col("median_abs").alias("onset_local"))
    out = word_errors(ops)
    for part in (offset, onset, ends, local, drift(points, reference).select("film", "drift")):
        out = out.join(part, "film", "left")
    return out
