"""Quality of cues: per-cue metrics, violation counters, rates and histograms.

Durations and reading speeds are compared in seconds (doubles), gaps in whole milliseconds. A film
without cues has no row; counts of an empty film in a left join are the caller's to fill with zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright import rules as R
from cuewright.functions import text as T
from cuewright.operators.sequence import order
from cuewright.rules import DEFAULT_RULES, CueRules

#: The counters that sum up to violations.
VIOLATIONS = ("too_short", "too_long", "cps_over_max", "touching_or_overlap", "line_too_long", "too_many_lines", "consecutive_duplicate_text")
COUNTERS = ("too_short", "too_long", "very_long", "cps_over_target", "cps_over_max", "touching_or_overlap", "overlap", "consecutive_duplicate_text", "line_too_long", "too_many_lines", "whole_second_durations")


def cue_metrics(cues: DataFrame) -> DataFrame:
    """``duration`` (s), ``n_lines``, ``chars`` (without line breaks) and ``cps`` (infinite where nothing lasts)."""
    duration = (F.col("end_ms") - F.col("start_ms")) / 1000
    chars = F.length(F.replace("text", F.lit("\n"), F.lit("")))
    out = cues.withColumns({"duration": duration, "n_lines": F.size(F.split("text", "\n")), "chars": chars})
    return out.withColumn("cps", F.when(F.col("duration") > 0, F.col("chars") / F.col("duration")).otherwise(F.lit(float("inf"))))


def violations(cues: DataFrame, rules: CueRules = DEFAULT_RULES) -> DataFrame:
    """Each cue with a boolean for every counter; neighbours are by start."""
    spec = order("start_ms", "cue_idx")
    rows = cue_metrics(cues).withColumn("key", T.cue_key(F.col("text")))
    gap = F.lead("start_ms").over(spec) - F.col("end_ms")
    tests = {
        "too_short": F.col("duration") < rules.min_duration,
        "too_long": F.col("duration") > rules.max_duration,
        "very_long": F.col("duration") > rules.flag_duration,
        "cps_over_target": F.col("cps") > rules.target_cps,
        "cps_over_max": F.col("cps") > rules.max_cps,
        "touching_or_overlap": F.coalesce(gap < round(rules.min_gap * 1000), F.lit(False)),
        "overlap": F.coalesce(gap < 0, F.lit(False)),
        "consecutive_duplicate_text": F.coalesce((F.col("key") != "") & (F.col("key") == F.lead("key").over(spec)), F.lit(False)),
        "line_too_long": F.exists(F.split("text", "\n"), lambda x: F.length(x) > rules.max_line_chars),
        "too_many_lines": F.col("n_lines") > rules.max_lines,
        "whole_second_durations": (F.col("duration") > 0) & (F.abs(F.col("duration") - F.rint("duration")) <= 0.001),
    }
    return rows.withColumns(tests).drop("key")


def score(cues: DataFrame, rules: CueRules = DEFAULT_RULES) -> DataFrame:
    """One row per film: number of cues, every counter, violations per 100 cues and duration figures."""
    rows = violations(cues, rules)
    counts = [F.count_if(c).alias(c) for c in COUNTERS]
    out = rows.groupBy("film").agg(
        F.count("*").alias("cues"), *counts,
        F.percentile("duration", F.lit(0.5)).alias("median_duration"), F.percentile("duration", F.lit(0.95)).alias("p95_duration"),
        F.max("duration").alias("max_duration"), F.coalesce(F.percentile(F.when(F.col("duration") > 0, F.col("cps")), F.lit(0.5)), F.lit(0.0)).alias("median_cps"),
    )
    total = sum((F.col(c) for c in VIOLATIONS[1:]), F.col(VIOLATIONS[0]))
    return out.withColumn("violations_per_100", F.coalesce(F.try_divide(100 * total, F.col("cues")), F.lit(0.0)))


def rates(scores: DataFrame) -> DataFrame:
    """(film, counter, count, rate): the counters of ``score`` in rows, per cue."""
    pairs = F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("count")) for c in COUNTERS))
    rows = scores.select("film", "cues", F.explode(pairs).alias("p"))
    return rows.select("film", "p.counter", "p.count", F.coalesce(F.try_divide(F.col("p.count"), F.col("cues")), F.lit(0.0)).alias("rate"))


def report_rows(scores: DataFrame) -> DataFrame:
    """(film, label, value): a printable report."""
    rows = rates(scores).select("film", F.col("counter").alias("label"), F.concat(F.col("count").cast("string"), F.lit(" ("), T.one_decimal(F.col("rate") * 100), F.lit("%)")).alias("value"))
    last = scores.select("film", F.lit("violations / 100 cues").alias("label"), T.one_decimal(F.col("violations_per_100")).alias("value"))
    return rows.union(last)


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two reports joined by film and label."""
    return left.withColumnRenamed("value", "left_value").join(right.withColumnRenamed("value", "right_value"), ["film", "label"])


def histogram(scores: DataFrame, buckets: tuple[int, ...] = R.QA_BUCKETS) -> DataFrame:
    """(le, films): how many films have at most so many violations per 100 cues."""
    sums = scores.agg(*(F.count_if(F.col("violations_per_100") <= b).alias(str(b)) for b in buckets))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(str(b)).alias("films")) for b in buckets))).alias("b")).select("b.le", "b.films")


def merge_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same film."""
    names = [c for c in new.columns if c != "film"]
    both = old.select("film", F.struct(*names).alias("old")).join(new.select("film", F.struct(*names).alias("new")), "film", "full")
    return both.select("film", F.coalesce("new", "old").alias("row")).select("film", "row.*")
