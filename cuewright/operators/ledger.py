"""The processing ledger as an append-only event log, and its current state.

Events have seq, path, op (record, regen_fail, forget) and the recorded values. The state of a path is
its last record since it was last forgotten; counters are sums over the events, so nothing is updated
in place and concurrent appends need no merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = ["size", "mtime", "status", "reason", "language", "subtitle", "model", "duration_s", "elapsed_s", "pipeline", "sub_size", "sub_mtime", "qa_violations", "qa_json"]

#: Columns that older logs lack, with what they count as.
ADDED = {"pipeline": ("bigint", 0), "sub_size": ("bigint", None), "sub_mtime": ("double", None), "qa_violations": ("double", None), "qa_json": ("string", None)}


def migrate(events: DataFrame) -> DataFrame:
    """Add the columns that an older log lacks."""
    for name, (kind, default) in ADDED.items():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(default).cast(kind))
    return events


def current_state(events: DataFrame) -> DataFrame:
    """One row per known path: the last record's values, attempts, regen_attempts, reason and updated_seq.

    One aggregation by path: everything needed is a maximum or a conditional sum, so it combines before the shuffle.
    """
    values = [c for c in VALUES if c in events.columns]
    forgot = events.where("op = 'forget'").groupBy("path").agg(F.max("seq").alias("forgotten"))
    live = events.join(forgot, "path", "left").where("op <> 'forget' and seq > coalesce(forgotten, -1)")
    record = F.col("op") == "record"
    first = live.where(record).groupBy("path").agg(F.max("seq").alias("last"), F.min("seq").alias("born"))
    rows = live.join(first, "path").where("seq >= born")
    failed = (F.col("op") == "regen_fail") & (F.col("seq") > F.col("last"))
    state = rows.groupBy("path").agg(
        F.max_by(F.struct(*values), F.when(record, F.col("seq"))).alias("v"),
        F.count_if(record & F.coalesce(F.col("bump"), F.lit(False))).alias("attempts"),
        F.count_if(failed).alias("regen_attempts"),
        F.max_by("reason", F.when(record | failed, F.col("seq"))).alias("last_reason"),
        F.max("last").alias("updated_seq"),
    )
    return state.select("path", *(F.col(f"v.{c}").alias(c) for c in values if c != "reason"), F.col("last_reason").alias("reason"), "attempts", "regen_attempts", "updated_seq")


def history(state: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """The newest rows first, at most 1000."""
    rows = state.where(F.col("status") == status) if status else state
    return rows.orderBy(F.desc("updated_seq"), "path").limit(min(limit, 1000))


def counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def same_file(size: Column, mtime: Column, other_size: Column, other_mtime: Column) -> Column:
    return (size == other_size) & (F.abs(mtime - other_mtime) <= 1)


def should_skip(files: DataFrame, state: DataFrame, max_retries: int = 3) -> DataFrame:
    """``skip`` for every listed file: unchanged and finished, or tried often enough."""
    known = state.select("path", F.col("size").alias("l_size"), F.col("mtime").alias("l_mtime"), "status", "attempts")
    done = F.when(F.col("status").isin("done", "skipped"), True).otherwise(F.col("attempts") >= max_retries)
    skip = same_file(F.col("size"), F.col("mtime"), F.col("l_size"), F.col("l_mtime")) & done
    return files.join(known, "path", "left").select("path", F.coalesce(skip, F.lit(False)).alias("skip"))


def outdated_outputs(state: DataFrame, subtitles: DataFrame, pipeline: int, max_attempts: int = 2) -> DataFrame:
    """Finished rows of an older pipeline whose subtitle (path, size, mtime in ``subtitles``) is still as written."""
    files = subtitles.select(F.col("path").alias("subtitle"), F.col("size").alias("f_size"), F.col("mtime").alias("f_mtime"))
    old = state.where((F.col("status") == "done") & (F.coalesce("pipeline", F.lit(0)) < pipeline) & (F.col("regen_attempts") < max_attempts))
    return old.join(files, "subtitle").where(same_file(F.col("sub_size"), F.col("sub_mtime"), F.col("f_size"), F.col("f_mtime")))


def may_replace(force: Column, replaces: Column, target: Column, outdated: Column) -> Column:
    return force | F.coalesce((replaces == target) & outdated, F.lit(False))


def effective_pipeline(enabled: Column, failed: Column, aligned: Column, total: Column, current: int = 4) -> Column:
    """The version an output counts as: 1 if alignment was off, failed, or placed less than half of the segments."""
    poor = ~enabled | failed | (2 * aligned < total)
    return F.when(poor, 1).otherwise(current)


def progress_percent(done_s: Column, total_s: Column) -> Column:
    return F.when(total_s > 0, F.least(F.lit(100.0), F.bround(100 * done_s / total_s, 1))).otherwise(0.0)


def outdated_own(state: DataFrame, videos: DataFrame, subtitles: DataFrame, sidecars: DataFrame, pipeline: int, max_attempts: int = 2) -> DataFrame:
    """Outdated outputs whose video (path, size, mtime) is unchanged and has no sidecar (path, sidecar) but that output."""
    others = sidecars.join(state.select("path", "subtitle"), "path").where("sidecar <> subtitle").select("path")
    known = videos.select("path", F.col("size").alias("v_size"), F.col("mtime").alias("v_mtime"))
    old = outdated_outputs(state, subtitles, pipeline, max_attempts).join(known, "path")
    return old.where(same_file(F.col("size"), F.col("mtime"), F.col("v_size"), F.col("v_mtime"))).join(others, "path", "left_anti").drop("v_size", "v_mtime")


def superseded(results: DataFrame, outdated: DataFrame) -> DataFrame:
    """(path, replaces): old outputs to delete: a result (path, subtitle, replaces) went elsewhere, and the old one is still outdated."""
    return results.where("replaces is not null and replaces <> subtitle").join(outdated.select("path", F.col("subtitle").alias("replaces")), ["path", "replaces"], "left_semi").select("path", "replaces")


def scan_summary(actions: DataFrame) -> DataFrame:
    """One row of a scan's counts: queued, skipped, regen (``action`` of each file)."""
    return actions.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("queued", "skipped", "regen")))


def counters(events: DataFrame) -> DataFrame:
    """(name, value): what a service counts: jobs processed and failed, seconds of media, outcomes of alignment."""
    sums = events.agg(
        F.count_if(F.col("status") == "done").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("media_s"), F.lit(0.0)).alias("media_seconds"), F.count_if("align_error").alias("align_errors"),
    )
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in sums.columns))
    return sums.select(F.explode(pairs).alias("p")).select("p.name", "p.value")


def exposition(counts: DataFrame, prefix: str = "cuewright") -> DataFrame:
    """(line): counters (name, value) as text lines for a metrics scraper."""
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    return counts.select(F.concat(F.lit(f"{prefix}_"), "name", F.lit(" "), value).alias("line"))


def quality_json(scores: DataFrame) -> DataFrame:
    """(film, qa_json): a film's scores as JSON with sorted keys."""
    names = sorted(c for c in scores.columns if c != "film")
    return scores.select("film", F.to_json(F.struct(*names)).alias("qa_json"))
