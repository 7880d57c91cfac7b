"""Timed-text views over general tables, in Spark and as DuckDB SQL. Derived columns use integers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("film"), F.col("turn").alias("seg"), F.coalesce("text", F.lit("")).alias("text"))


def _gap(pos: str):
    return F.when(F.col(pos) == 0, 1000 + F.col("seg") * 977 % 6000).otherwise(0)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(film, seg, idx, start_ms, end_ms, text, prob_pct, prob): the words of each turn on one clock per film."""
    split = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = turns(spark, sf_dir).select("film", "seg", F.posexplode(split).alias("pos", "text"))
    rest = F.when(F.col("text").rlike("[.!?]$"), 700).when(F.col("text").endswith(","), 150).otherwise(0)
    rows = rows.withColumns({"dur": 80 + 60 * F.length("text"), "rest": rest, "gap": _gap("pos")})
    spec = Window.partitionBy("film").orderBy("seg", "pos")
    so_far = spec.rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("gap").over(so_far) + F.sum(F.col("dur") + F.col("rest")).over(so_far) - F.col("dur") - F.col("rest")
    rows = rows.withColumns({"start_ms": start.cast("bigint"), "idx": (F.row_number().over(spec) - 1).cast("int"), "prob_pct": (F.col("film") * 31 + F.col("seg") * 17 + F.col("pos") * 7) % 100})
    return rows.select("film", "seg", "idx", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "text", "prob_pct", (F.col("prob_pct") / 100).alias("prob"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(film, seg, start_ms, end_ms, text, mean_prob): one for each turn with words."""
    sums = words(spark, sf_dir).groupBy("film", "seg").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), (F.sum("prob_pct") / (100 * F.count("*"))).alias("mean_prob"))
    return sums.join(turns(spark, sf_dir), ["film", "seg"])


def noisy_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments, some of them shouted, bracketed, musical or a stock phrase, two in three with a low probability."""
    k = (F.col("film") * 7 + F.col("seg")) % 11
    text = F.when(k == 3, F.upper("text")).when(k == 5, F.concat(F.lit("["), F.trim("text"), F.lit("]"))).when(k == 7, "Thank you.").when(k == 9, "♪ ♪").otherwise(F.col("text"))
    return segments(spark, sf_dir).withColumns({"text": text, "mean_prob": F.when((F.col("film") + F.col("seg")) % 3 > 0, F.col("mean_prob") / 4).otherwise(F.col("mean_prob"))})


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(film, cue_idx, start_ms, end_ms, text): a cue per line; some are shortened, overlapped or repeated."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = turns(spark, sf_dir).select("film", "seg", F.posexplode(lines).alias("pos", "text"))
    rows = rows.withColumns({"dur": 400 + 55 * F.length("text"), "gap": _gap("pos")})
    spec = Window.partitionBy("film").orderBy("seg", "pos")
    so_far = spec.rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum(F.col("gap") + F.col("dur") + 120).over(so_far) - F.col("dur") - 120).cast("bigint")
    rows = rows.withColumns({"start_ms": start, "cue_idx": (F.row_number().over(spec) - 1).cast("int"), "before": F.lag("text").over(spec)})
    k = F.col("cue_idx")
    end = F.when(k % 7 == 3, F.col("start_ms") + 500).when(k % 11 == 5, F.col("start_ms") + F.col("dur") + 400).otherwise(F.col("start_ms") + F.col("dur"))
    text = F.when(k % 13 == 7, F.coalesce("before", "text")).otherwise(F.col("text"))
    return rows.select("film", "cue_idx", "start_ms", end.cast("bigint").alias("end_ms"), text.alias("text"))


def shifted_cues(spark: SparkSession, sf_dir: str, by_ms: int = 350) -> DataFrame:
    """The cues as another release has them: later, without every 17th cue, every 23rd with another text."""
    rows = cues(spark, sf_dir).where("cue_idx % 17 <> 16")
    text = F.when(F.col("cue_idx") % 23 == 11, F.concat(F.lit("Well, "), F.col("text"))).otherwise(F.col("text"))
    return rows.select("film", "cue_idx", (F.col("start_ms") + by_ms).alias("start_ms"), (F.col("end_ms") + by_ms).alias("end_ms"), text.alias("text"))


def cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("film"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("score"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select((F.col("event_id") % 100).alias("film"), (F.col("event_id") * 7919 % 600_000).alias("cut_ms")).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, size, mtime) of videos named after pages."""
    pages = table(spark, sf_dir, "pages")
    name = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    ext = F.element_at(F.array(*(F.lit(x) for x in (".mkv", ".mp4", ".txt", ".MKV"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/media"), name, F.lit(" ("), (1990 + F.col("page_id") % 30).cast("string"), F.lit(").v"), (F.col("page_id") % 5).cast("string"), ext)
    return pages.select("page_id", path.alias("path"), (F.col("page_id") * 1000).alias("size"), (F.col("page_id") * 60.0).alias("mtime"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos and, for every third, a subtitle file: some of our own making."""
    own = files(spark, sf_dir)
    base = F.regexp_replace("path", r"\.[^.]*$", "")
    tail = F.when(F.col("page_id") % 2 == 0, ".auto.en.srt").otherwise(".de.ass")
    subs = own.where("page_id % 3 = 0").select("page_id", F.concat(base, tail).alias("path"), F.lit(1).cast("bigint").alias("size"), "mtime")
    return own.union(subs)


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    op = F.when(kind == "click", "regen_fail").when(kind == "signup", "forget").otherwise("record")
    status = F.when(kind == "purchase", "done").when(kind == "view", "skipped").when(kind == "error", "failed")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("path"), op.alias("op"), (F.col("event_id") % 1000).alias("size"), F.col("value").alias("mtime"),
        status.alias("status"), F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("reason"), (kind == "error").alias("bump"), (F.col("event_id") % 5).alias("pipeline"),
        F.concat(F.lit("/media/"), F.col("user_id").cast("string"), F.lit(".srt")).alias("subtitle"), (F.col("event_id") % 7).alias("sub_size"), F.col("value").alias("sub_mtime"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("film"), F.col("vec_id").alias("block"), F.col("embedding").alias("samples"))


#: The same views for DuckDB, as common table expressions that build on one another.
SQL = {
    "turns": "SELECT conv_id AS film, turn AS seg, coalesce(text, '') AS text FROM conversations",
    "words": r"""
  SELECT film, seg, idx, start_ms, start_ms + dur AS end_ms, text, prob_pct, prob_pct / 100.0 AS prob FROM (
    SELECT *, CAST(row_number() OVER s - 1 AS INTEGER) AS idx, CAST(sum(gap + dur + rest) OVER s - dur - rest AS BIGINT) AS start_ms FROM (
      SELECT film, seg, pos, l[pos + 1] AS text, 80 + 60 * length(l[pos + 1]) AS dur,
        CASE WHEN regexp_matches(l[pos + 1], '[.!?]$') THEN 700 WHEN l[pos + 1] LIKE '%,' THEN 150 ELSE 0 END AS rest,
        CASE WHEN pos = 0 THEN 1000 + seg * 977 % 6000 ELSE 0 END AS gap, (film * 31 + seg * 17 + pos * 7) % 100 AS prob_pct
      FROM (SELECT film, seg, l, unnest(range(len(l))) AS pos FROM (SELECT film, seg, [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS l FROM turns)))
    WINDOW s AS (PARTITION BY film ORDER BY seg, pos ROWS UNBOUNDED PRECEDING))""",
    "segments": """
  SELECT film, seg, start_ms, end_ms, mean_prob, text FROM (
    SELECT film, seg, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(prob_pct) / (100.0 * count(*)) AS mean_prob FROM words GROUP BY film, seg) JOIN turns USING (film, seg)""",
    "noisy_segments": """
  SELECT film, seg, start_ms, end_ms, CASE WHEN (film + seg) % 3 > 0 THEN mean_prob / 4 ELSE mean_prob END AS mean_prob,
    CASE (film * 7 + seg) % 11 WHEN 3 THEN upper(text) WHEN 5 THEN '[' || trim(text) || ']' WHEN 7 THEN 'Thank you.' WHEN 9 THEN '♪ ♪' ELSE text END AS text FROM segments""",
    "shifted_cues": """
  SELECT film, cue_idx, start_ms + 350 AS start_ms, end_ms + 350 AS end_ms, CASE WHEN cue_idx % 23 = 11 THEN 'Well, ' || text ELSE text END AS text FROM cues WHERE cue_idx % 17 <> 16""",
    "cues": """
  SELECT film, cue_idx, start_ms,
    CAST(CASE WHEN cue_idx % 7 = 3 THEN start_ms + 500 WHEN cue_idx % 11 = 5 THEN start_ms + dur + 400 ELSE start_ms + dur END AS BIGINT) AS end_ms,
    CASE WHEN cue_idx % 13 = 7 THEN coalesce(prev, text) ELSE text END AS text FROM (
      SELECT *, CAST(row_number() OVER s - 1 AS INTEGER) AS cue_idx, lag(text) OVER (PARTITION BY film ORDER BY seg, pos) AS prev, CAST(sum(gap + dur + 120) OVER s - dur - 120 AS BIGINT) AS start_ms FROM (
        SELECT film, seg, pos, l[pos + 1] AS text, 400 + 55 * length(l[pos + 1]) AS dur, CASE WHEN pos = 0 THEN 1000 + seg * 977 % 6000 ELSE 0 END AS gap
        FROM (SELECT film, seg, l, unnest(range(len(l))) AS pos FROM (SELECT film, seg, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS l FROM turns)))
      WINDOW s AS (PARTITION BY film ORDER BY seg, pos ROWS UNBOUNDED PRECEDING))""",
    "cut_candidates": "SELECT user_id AS film, epoch_us(ts) / 1e6 AS t, value AS score FROM events",
    "cuts": "SELECT DISTINCT event_id % 100 AS film, event_id * 7919 % 600000 AS cut_ms FROM events",
    "files": r"""
  SELECT page_id, '/media' || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') || ' (' || (1990 + page_id % 30) || ').v' || (page_id % 5)
    || ['.mkv', '.mp4', '.txt', '.MKV'][page_id % 4 + 1] AS path, page_id * 1000 AS size, page_id * 60.0::DOUBLE AS mtime FROM pages""",
    "listing": r"""
  SELECT * FROM files UNION ALL SELECT page_id, regexp_replace(path, '\.[^.]*$', '') || CASE WHEN page_id % 2 = 0 THEN '.auto.en.srt' ELSE '.de.ass' END, 1, mtime FROM files WHERE page_id % 3 = 0""",
    "ledger_events": """
  SELECT event_id AS seq, user_id AS path, CASE event_type WHEN 'click' THEN 'regen_fail' WHEN 'signup' THEN 'forget' ELSE 'record' END AS op, event_id % 1000 AS size, value AS mtime,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'skipped' WHEN 'error' THEN 'failed' END AS status, event_type || ' ' || event_id AS reason, event_type = 'error' AS bump, event_id % 5 AS pipeline,
    '/media/' || user_id || '.srt' AS subtitle, event_id % 7 AS sub_size, value AS sub_mtime FROM events""",
    "samples": "SELECT label AS film, vec_id AS block, embedding AS samples FROM embeddings",
}
_NEEDS = {"words": ["turns"], "segments": ["turns", "words"], "noisy_segments": ["turns", "words", "segments"], "cues": ["turns"], "shifted_cues": ["turns", "cues"], "listing": ["files"]}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the views it uses and what they build on."""
    wanted: list[str] = []
    for name in names:
        for x in (*_NEEDS.get(name, []), name):
            if x not in wanted:
                wanted.append(x)
    return "WITH " + ",\n".join(f"{x} AS ({SQL[x]})" for x in wanted) + (",\n" + sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else "\n" + sql)
