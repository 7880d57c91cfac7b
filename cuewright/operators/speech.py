"""Segments that are no speech, and segments without punctuation.

A segment row has film, seg, start_ms, end_ms, text and mean_prob (the mean of its words).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cuewright import rules as R
from cuewright.functions import text as T
from cuewright.operators.sequence import order


def isolation(segments: DataFrame, isolation_s: float = R.ISOLATION_S) -> DataFrame:
    """``isolated``: no other segment within ``isolation_s`` before or after; film edges count as far."""
    spec, need = order("seg"), isolation_s * 1000
    before = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(spec) >= need, F.lit(True))
    after = F.coalesce(F.lead("start_ms").over(spec) - F.col("end_ms") >= need, F.lit(True))
    return segments.withColumn("isolated", before & after)


def classify_segments(segments: DataFrame, isolation_s: float = R.ISOLATION_S) -> DataFrame:
    """``drop_reason``: descriptor, caps, stock phrase, or null for speech. Isolation is judged among all segments."""
    low = F.col("isolated") & (F.col("mean_prob") < R.ISOLATED_BELOW)
    text = F.col("text")
    reason = (
        F.when(text.isNull() | F.col("mean_prob").isNull() | T.is_descriptor(text), "descriptor")
        .when(T.is_caps_line(text) & (low | (F.col("mean_prob") < R.CAPS_BELOW)), "caps")
        .when(T.is_stock_phrase(text) & low, "stock phrase")
    )
    return isolation(segments, isolation_s).withColumn("drop_reason", reason)


def filter_segments(segments: DataFrame, isolation_s: float = R.ISOLATION_S) -> tuple[DataFrame, DataFrame]:
    """The segments kept, and those dropped that have a text."""
    found = classify_segments(segments, isolation_s)
    return found.where("drop_reason is null").drop("isolated", "drop_reason"), found.where("drop_reason is not null and trim(text) <> ''")


def unpunctuated_groups(segments: DataFrame, most_s: float = R.REPAIR_SPAN_S) -> DataFrame:
    """(film, group, first_seg, last_seg, start_ms, end_ms): runs of adjacent unpunctuated segments,
    each run cut so that it spans at most ``most_s``. The cutting restarts its count at each run, so it
    is a fold over the run's segments, which the span and the segments' order bound."""
    spec = order("seg")
    rows = segments.withColumns({"bare": T.is_unpunctuated(F.col("text")), "place": F.row_number().over(spec)}).where("bare")
    rows = rows.withColumn("stretch", F.col("place") - F.row_number().over(spec))
    runs = rows.groupBy("film", "stretch").agg(F.sort_array(F.collect_list(F.struct("seg", "start_ms", "end_ms"))).alias("s"))
    most = int(most_s * 1000)
    fold = F.expr(f"""aggregate(s, cast(array() as array<struct<first: bigint, last: bigint, lo: bigint, hi: bigint>>), (acc, x) ->
        if(size(acc) > 0 and x.end_ms - element_at(acc, -1).lo <= {most},
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', cast(x.seg as bigint), 'lo', element_at(acc, -1).lo, 'hi', cast(x.end_ms as bigint)))),
           concat(acc, array(named_struct('first', cast(x.seg as bigint), 'last', cast(x.seg as bigint), 'lo', cast(x.start_ms as bigint), 'hi', cast(x.end_ms as bigint))))))""")
    out = runs.select("film", F.explode(fold).alias("g"))
    return out.select("film", F.col("g.first").alias("first_seg"), F.col("g.last").alias("last_seg"), F.col("g.lo").alias("start_ms"), F.col("g.hi").alias("end_ms"))


def repair_windows(groups: DataFrame, segments: DataFrame) -> DataFrame:
    """``decode_from`` and ``decode_to``: what to decode again for each group, clear of its neighbours."""
    pad = int(R.REPAIR_PAD_S * 1000)
    ends = segments.select("film", (F.col("seg") + 1).alias("first_seg"), F.col("end_ms").alias("before_ms"))
    starts = segments.select("film", (F.col("seg") - 1).alias("last_seg"), F.col("start_ms").alias("after_ms"))
    out = groups.join(ends, ["film", "first_seg"], "left").join(starts, ["film", "last_seg"], "left")
    return out.withColumns({
        "decode_from": F.greatest(F.coalesce("before_ms", F.lit(0)), F.col("start_ms") - pad, F.lit(0)),
        "decode_to": F.least(F.col("end_ms") + pad, F.coalesce(F.col("after_ms"), F.col("end_ms") + pad)),
    }).drop("before_ms", "after_ms")


@pandas_udf(StructType([StructField("ratio", DoubleType()), StructField("first", IntegerType()), StructField("last", IntegerType())]))
def _agreement(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Share of equal words of two word lists, and the ends of what matches in the new one (-1: nothing)."""
    out = []
    for a, b in zip(old, new):
        matcher = SequenceMatcher(None, [] if a is None else list(a), [] if b is None else list(b), autojunk=False)
        blocks = [m for m in matcher.get_matching_blocks() if m.size]
        out.append((matcher.ratio(), blocks[0].b, blocks[-1].b + blocks[-1].size - 1) if blocks else (matcher.ratio(), -1, -1))
    return pd.DataFrame(out, columns=["ratio", "first", "last"])


def repair(segments: DataFrame, decoded: DataFrame, groups: DataFrame, early_ms: int = 150, late_ms: int = 50) -> tuple[DataFrame, DataFrame]:
    """Unpunctuated runs replaced by what was decoded anew for them: (segments, verdicts).

    ``groups`` are those of ``unpunctuated_groups``; ``decoded`` (film, first_seg, idx, start_ms, end_ms,
    text, prob) holds the new words of each. Words that start more than ``early_ms`` before or ``late_ms``
    behind a run are its neighbours'; of the rest, what stands before the first and behind the last word that
    matches the old text goes. A replacement is refused (``reason``) if it is empty, still without
    punctuation, or of other words. Verdicts are (film, first_seg, reason); segments are numbered anew.
    """
    runs = groups.select("film", "first_seg", "last_seg", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))
    keys = lambda c: F.filter(F.transform(F.split(c, r"\s+"), T.word_key), lambda w: w != "")
    members = runs.select("film", "first_seg", F.explode(F.sequence("first_seg", "last_seg")).alias("seg"))
    inside = segments.select("film", "seg", "text").join(members, ["film", "seg"])
    said = inside.groupBy("film", "first_seg").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seg", "text")))["text"], " ").alias("old"))  # a run spans at most REPAIR_SPAN_S
    clipped = decoded.join(runs, ["film", "first_seg"]).where(F.col("start_ms").between(F.col("lo") - early_ms, F.col("hi") + late_ms) & (F.trim("text") != ""))
    clipped = clipped.withColumn("key", T.word_key(F.col("text"))).select("film", "first_seg", F.struct("idx", "start_ms", "end_ms", F.trim("text").alias("text"), "prob", "key").alias("w"))
    new = clipped.groupBy("film", "first_seg").agg(F.sort_array(F.collect_list("w")).alias("w"))
    rows = runs.join(said, ["film", "first_seg"]).join(new, ["film", "first_seg"], "left")
    rows = rows.withColumn("w", F.coalesce("w", F.array().cast(new.schema["w"].dataType)))
    keyed = F.filter("w", lambda x: x.key != "")
    rows = rows.withColumn("m", _agreement(keys(F.col("old")), F.transform(keyed, lambda x: x.key)))
    first, last = F.get(keyed, F.col("m.first")), F.get(keyed, F.col("m.last"))
    rows = rows.withColumn("w", F.when(F.col("m.first") < 0, F.col("w")).otherwise(F.filter("w", lambda x: x.idx.between(first["idx"], last["idx"]))))
    rows = rows.withColumns({"m": _agreement(keys(F.col("old")), F.transform(F.filter("w", lambda x: x.key != ""), lambda x: x.key)), "new": F.array_join(F.col("w.text"), " ")})
    reason = (
        F.when(F.col("new") == "", "empty").when(T.is_unpunctuated(F.col("new")), "still unpunctuated")
        .when(F.col("m.ratio") < R.REPAIR_SIMILARITY, "different words")
    )
    rows = rows.withColumn("reason", reason)
    taken = rows.where("reason is null").select("film", "first_seg", "last_seg", F.array_min("w.start_ms").alias("start_ms"), F.array_max("w.end_ms").alias("end_ms"), F.col("new").alias("text"), F.aggregate("w.prob", F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size("w")).alias("mean_prob"))
    gone = taken.select("film", F.explode(F.sequence("first_seg", "last_seg")).alias("seg"))
    columns = ["film", "seg", "start_ms", "end_ms", "text", "mean_prob"]
    spliced = segments.join(gone, ["film", "seg"], "left_anti").select(columns).union(taken.withColumnRenamed("first_seg", "seg").select(columns))
    return spliced.withColumn("seg", F.row_number().over(order("seg")) - 1), rows.select("film", "first_seg", "reason")
