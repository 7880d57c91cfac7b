"""The registered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright import rules as R
from cuewright.functions import text as T
from cuewright.functions import timecode as C
from cuewright.functions.sound import alignment_word, metaphone
from cuewright.operators import align, audio, context, correct, cues, evaluate, ledger, quality, sequence, shots, speech
from cuewright.plans import views as V
from cuewright.plans.views import with_views
from cuewright.session import remove_at_exit, shared_path
from cuewright.sources import listing, srt
from cuewright.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A gap that suits the events table, whose events are hours apart.
CHAIN_GAP_S = 4 * 3600.0
NOW = 1_000_000.0


def query(sql: str | None = None, *views: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- quality of cues ---------------------------------------------------------------------------

_METRICS = """
  SELECT *, (end_ms - start_ms) / 1000.0::DOUBLE AS duration, len(string_split(text, chr(10))) AS n_lines, length(replace(text, chr(10), '')) AS chars FROM cues"""
_VIOLATIONS = rf"""
WITH metrics AS ({_METRICS}), keyed AS (
  SELECT *, CASE WHEN duration > 0 THEN chars / duration ELSE 'infinity'::DOUBLE END AS cps,
    trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM metrics
), found AS (
  SELECT film, cue_idx, duration, cps, duration < 0.833 AS too_short, duration > 7 AS too_long, duration > 10 AS very_long, cps > 17 AS cps_over_target, cps > 20 AS cps_over_max,
    coalesce(lead(start_ms) OVER s - end_ms < 83, false) AS touching_or_overlap, coalesce(lead(start_ms) OVER s - end_ms < 0, false) AS overlap,
    coalesce(key <> '' AND key = lead(key) OVER s, false) AS consecutive_duplicate_text, list_max([length(x) FOR x IN string_split(text, chr(10))]) > 42 AS line_too_long, n_lines > 2 AS too_many_lines,
    duration > 0 AND abs(duration - round_even(duration, 0)) <= 0.001 AS whole_second_durations
  FROM keyed WINDOW s AS (PARTITION BY film ORDER BY start_ms, cue_idx)
)"""
_COUNTS = ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in quality.COUNTERS)
_SUM = " + ".join(quality.VIOLATIONS)
_SCORES = f"""{_VIOLATIONS}, sums AS (
  SELECT film, count(*) AS cues, {_COUNTS}, quantile_cont(duration, 0.5) AS median_duration, quantile_cont(duration, 0.95) AS p95_duration, max(duration) AS max_duration,
    coalesce(quantile_cont(cps, 0.5) FILTER (duration > 0), 0.0) AS median_cps FROM found GROUP BY film
), scores AS (SELECT *, 100.0::DOUBLE * ({_SUM}) / cues AS violations_per_100 FROM sums)"""
_FIGURES = ("median_duration", "p95_duration", "max_duration", "median_cps", "violations_per_100")
_ROUNDED_SCORES = f"SELECT film, cues, {', '.join(quality.COUNTERS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _FIGURES)} FROM"


@query(f"{_SCORES} {_ROUNDED_SCORES} scores", "cues")
def qa_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.score(V.cues(spark, sf_dir)), *_FIGURES)


@query(
    f"{_SCORES} SELECT film, counter, n AS count, round(n::DOUBLE / cues, 6) AS rate FROM scores, LATERAL (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {c})' for c in quality.COUNTERS)}) AS v(counter, n)", "cues"
)
def qa_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.rates(quality.score(V.cues(spark, sf_dir))), "rate")


@query(f"{_VIOLATIONS} SELECT film, cue_idx, {', '.join(quality.COUNTERS)} FROM found WHERE {' OR '.join(quality.VIOLATIONS)}", "cues")
def qa_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(V.cues(spark, sf_dir)).where(" or ".join(quality.VIOLATIONS)).select("film", "cue_idx", *quality.COUNTERS)


@query(f"{_SCORES} SELECT CAST(le AS INTEGER) AS le, (SELECT count(*) FROM scores WHERE violations_per_100 <= le) AS films FROM (SELECT unnest([1, 2, 5, 10, 20, 40, 80, 160]) AS le)", "cues")
def qa_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(quality.score(V.cues(spark, sf_dir)))


@query("SELECT film, cue_idx, round(duration, 6) AS duration, n_lines::INTEGER AS n_lines, chars::INTEGER AS chars, round(CASE WHEN duration > 0 THEN chars / duration ELSE 'infinity'::DOUBLE END, 6) AS cps FROM (" + _METRICS + ")", "cues")
def cue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.cue_metrics(V.cues(spark, sf_dir)).select("film", "cue_idx", "duration", "n_lines", "chars", "cps"), "duration", "cps")


_BOTH_SCORES = f"{_SCORES}, {_SCORES[5:].replace('FROM cues', 'FROM shifted_cues')}"
for _name in ("metrics", "keyed", "found", "sums", "scores"):  # the second chain under names of its own
    _head, _, _tail = _BOTH_SCORES.partition(_SCORES)
    _BOTH_SCORES = _SCORES + re.sub(rf"\b{_name}\b", f"{_name}2", _tail)


@query(
    f"""{_BOTH_SCORES}, labels AS (
      SELECT film, counter AS label, n, cues FROM scores, LATERAL (VALUES {', '.join(f"('{c}', {c})" for c in quality.COUNTERS)}) AS v(counter, n)
    ), labels2 AS (
      SELECT film, counter AS label, n, cues FROM scores2, LATERAL (VALUES {', '.join(f"('{c}', {c})" for c in quality.COUNTERS)}) AS v(counter, n)
    ), shown AS (SELECT film, label, printf('%d (%.1f%%)', n, n::DOUBLE / cues * 100) AS value FROM labels UNION ALL SELECT film, 'violations / 100 cues', printf('%.1f', violations_per_100) FROM scores),
    shown2 AS (SELECT film, label, printf('%d (%.1f%%)', n, n::DOUBLE / cues * 100) AS value FROM labels2 UNION ALL SELECT film, 'violations / 100 cues', printf('%.1f', violations_per_100) FROM scores2)
    SELECT a.film, a.label, a.value AS left_value, b.value AS right_value FROM shown a JOIN shown2 b USING (film, label)""", "cues", "shifted_cues",
)
def report_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (quality.report_rows(quality.score(x)) for x in (V.cues(spark, sf_dir), V.shifted_cues(spark, sf_dir)))
    return quality.side_by_side(left, right)


@query(f"{_BOTH_SCORES} {_ROUNDED_SCORES} (SELECT * FROM scores2 UNION ALL SELECT * FROM scores WHERE film NOT IN (SELECT film FROM scores2))", "cues", "shifted_cues")
def eval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all cues, replaced by those of another release where it has the film."""
    return rounded(quality.merge_scores(quality.score(V.cues(spark, sf_dir)), quality.score(V.shifted_cues(spark, sf_dir))), *_FIGURES)


# --- subtitle files ----------------------------------------------------------------------------

_CODE = "format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"


@query(f"SELECT film, cue_idx, {_CODE.format('start_ms')} AS start_code, {_CODE.format('end_ms')} AS end_code FROM cues", "cues")
def srt_timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cues(spark, sf_dir).select("film", "cue_idx", C.format_ms(F.col("start_ms")).alias("start_code"), C.format_ms(F.col("end_ms")).alias("end_code"))


@query("SELECT film, (row_number() OVER (PARTITION BY film ORDER BY start_ms, cue_idx) - 1)::INTEGER AS cue_idx, start_ms, end_ms, text FROM cues", "cues")
def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.parse_srt(srt.render_srt(V.cues(spark, sf_dir)), strip_tags=False)


# --- segments ----------------------------------------------------------------------------------

_ISOLATED = "coalesce(start_ms - lag(end_ms) OVER s >= 4000, true) AND coalesce(lead(start_ms) OVER s - end_ms >= 4000, true)"
_PHRASES = ", ".join(f"'{p}'" for p in R.STOCK_PHRASES)


@query(f"SELECT film, seg, {_ISOLATED} AS isolated FROM segments WINDOW s AS (PARTITION BY film ORDER BY seg)", "segments")
def isolated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.isolation(V.segments(spark, sf_dir)).select("film", "seg", "isolated")


_CLASSES = rf"""
WITH rows AS (
  SELECT *, {_ISOLATED} AS isolated, trim(text) AS t,
    [regexp_replace(x, '[^\p{{L}}]', '', 'g') FOR x IN regexp_split_to_array(trim(text), '\s+') IF x <> ''] AS w,
    trim(regexp_replace(regexp_replace(replace(lower(text), '.', ''), '[^a-z ]+', '', 'g'), ' +', ' ', 'g')) AS phrase
  FROM noisy_segments WINDOW s AS (PARTITION BY film ORDER BY seg)
), caps AS (
  SELECT *, [x FOR x IN w IF length(x) >= 3 AND x <> 'OK'] AS long, isolated AND mean_prob < 0.85 AS low FROM rows
), classed AS (
  SELECT film, seg, CASE
    WHEN regexp_matches(t, '^[\s♪♫¶#*~.…-]*$') OR (t LIKE '[%]') OR (t LIKE '(%)') THEN 'descriptor'
    WHEN regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '[\p{{Ll}}\p{{Lo}}\p{{Lt}}\p{{Lm}}]') AND len(long) > 0 AND (len(w) >= 2 OR list_sum([length(x) FOR x IN long]) >= 5) AND (low OR mean_prob < 0.5) THEN 'caps'
    WHEN phrase IN ({_PHRASES}) AND low THEN 'stock phrase' END AS drop_reason FROM caps
)"""


@query(f"{_CLASSES} SELECT film, seg, coalesce(drop_reason, 'kept') AS decision FROM classed", "noisy_segments")
def hallucination_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.classify_segments(V.noisy_segments(spark, sf_dir)).select("film", "seg", F.coalesce("drop_reason", F.lit("kept")).alias("decision"))


@query(f"{_CLASSES} SELECT drop_reason AS reason, count(*) AS n FROM classed WHERE drop_reason IS NOT NULL GROUP BY drop_reason", "noisy_segments")
def dropped_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.classify_segments(V.noisy_segments(spark, sf_dir)).where("drop_reason is not null").groupBy(F.col("drop_reason").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT film, seg, len(regexp_extract_all(lower(text), '[A-Za-z'']+')) >= 4 AND NOT regexp_matches(lower(text), '[A-Z.,?!;:]') AS unpunctuated FROM turns", "turns")
def unpunctuated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.turns(spark, sf_dir).select("film", "seg", T.is_unpunctuated(F.lower("text")).alias("unpunctuated"))


@query()
def repair_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = V.segments(spark, sf_dir).withColumn("text", F.when(F.col("seg") % 3 > 0, F.regexp_replace(F.lower("text"), "[.,?!;:]", "")).otherwise(F.col("text")))
    return speech.repair_windows(speech.unpunctuated_groups(bare), bare)


@query()
def punctuation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without marks, repaired by their own words with marks, some runs decoded to nothing, to other words or without marks."""
    whole = V.segments(spark, sf_dir)
    bare = whole.withColumn("text", F.when(F.col("seg") % 3 > 0, F.regexp_replace(F.lower("text"), "[.,?!;:]", "")).otherwise(F.col("text")))
    groups = speech.unpunctuated_groups(bare)
    words = V.words(spark, sf_dir).join(groups.select("film", "first_seg", "last_seg"), "film").where("seg between first_seg and last_seg")
    text = F.when(F.col("first_seg") % 7 == 2, F.lower(F.regexp_replace("text", "[.,?!;:]", ""))).when(F.col("first_seg") % 7 == 4, F.concat(F.lit("No"), "idx", F.lit("."))).otherwise(F.col("text"))
    decoded = words.where("first_seg % 7 <> 1").select("film", "first_seg", "idx", "start_ms", "end_ms", text.alias("text"), "prob")
    fixed, verdicts = speech.repair(bare, decoded, groups)
    kept = fixed.select("film", F.lit("segment").alias("kind"), F.col("seg").cast("bigint").alias("seg"), "start_ms", "end_ms", "text")
    return kept.union(verdicts.select("film", F.lit("verdict"), F.col("first_seg"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.coalesce("reason", F.lit("repaired"))))


# --- words -------------------------------------------------------------------------------------

_KEY = r"""trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_'']+', '', 'g'), '''')"""


@query(
    "SELECT film, run, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(CASE WHEN gap < 600 THEN 0 ELSE 1 END) OVER (PARTITION BY film ORDER BY idx) AS run FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY film ORDER BY idx) AS gap FROM words)) GROUP BY film, run", "words",
)
def pause_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequence.pause_runs(V.words(spark, sf_dir))
    return runs.groupBy("film", "run").agg(F.count("*").alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query("SELECT film, idx, start_ms, greatest(start_ms, least(end_ms, start_ms + 600, coalesce(lead(start_ms) OVER (PARTITION BY film ORDER BY idx), end_ms))) AS end_ms FROM words", "words")
def word_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.clamp_words(V.words(spark, sf_dir), 600).select("film", "idx", "start_ms", "end_ms")


_DOUBLED = "(SELECT film, idx * 5 + k AS idx, start_ms, end_ms, text FROM words, LATERAL (SELECT unnest(range(CASE WHEN idx % 9 = 0 THEN 5 ELSE 1 END)) AS k))"


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with every ninth said five times."""
    times = F.sequence(F.lit(0), F.when(F.col("idx") % 9 == 0, 4).otherwise(0))
    return V.words(spark, sf_dir).select("film", (F.col("idx") * 5).alias("i"), "start_ms", "end_ms", "text", F.explode(times).alias("k")).select("film", (F.col("i") + F.col("k")).alias("idx"), "start_ms", "end_ms", "text")


_LOOPS = """
WITH keyed AS (SELECT *, {key} AS key FROM {source}), marked AS (
  SELECT *, CASE WHEN key <> '' AND key = lag(key) OVER s THEN 0 ELSE 1 END AS starts FROM keyed WINDOW s AS (PARTITION BY film ORDER BY idx)
), runs AS (SELECT *, sum(starts) OVER (PARTITION BY film ORDER BY idx) AS loop FROM marked)"""


@query(_LOOPS.format(key=_KEY, source=_DOUBLED) + " SELECT film, idx, text FROM runs QUALIFY row_number() OVER (PARTITION BY film, loop ORDER BY idx) <= 3", "words")
def loop_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.collapse_loops(_doubled(spark, sf_dir)).select("film", "idx", "text")


_CORE = r"""regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"""


@query(_LOOPS.format(key=_CORE, source=_DOUBLED) + " SELECT film, idx FROM runs WHERE key <> '' QUALIFY count(*) OVER (PARTITION BY film, loop) >= 3", "words")
def loop_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.loop_flags(_doubled(spark, sf_dir)).where("looped").select("film", "idx")


@query(
    "SELECT film, idx, CASE WHEN start_ms < m THEN m ELSE start_ms END AS start_ms, CASE WHEN start_ms < m THEN greatest(m, end_ms) ELSE end_ms END AS end_ms FROM (SELECT film, idx, start_ms - idx % 3 * 400 AS start_ms, end_ms, max(end_ms) OVER (PARTITION BY film ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM words)", "words",
)
def enforce_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.words(spark, sf_dir).select("film", "idx", (F.col("start_ms") - F.col("idx") % 3 * 400).alias("start_ms"), "end_ms")
    return sequence.enforce_order(rows).select("film", "idx", "start_ms", "end_ms")


@query(
    """WITH holes AS (SELECT film, idx, CASE WHEN idx % 4 <> 1 THEN start_ms END AS s, CASE WHEN idx % 4 <> 1 THEN end_ms END AS e FROM words), near AS (
      SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY film ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(s IGNORE NULLS) OVER (PARTITION BY film ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM holes)
    SELECT film, idx, coalesce(s, b, a) AS start_ms, coalesce(e, greatest(coalesce(b, a), coalesce(a, b))) AS end_ms FROM near""", "words",
)
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = F.col("idx") % 4 == 1
    rows = V.words(spark, sf_dir).select("film", "idx", F.when(~hole, F.col("start_ms")).alias("start_ms"), F.when(~hole, F.col("end_ms")).alias("end_ms"))
    return sequence.fill_gaps(rows).select("film", "idx", "start_ms", "end_ms")


@query(
    """WITH cores AS (SELECT film, seg, start_ms AS lo, end_ms AS hi, max(end_ms) OVER (PARTITION BY film) + 200 AS total, lag(end_ms) OVER s AS p, lead(start_ms) OVER s AS n FROM segments WINDOW s AS (PARTITION BY film ORDER BY seg)), w AS (
      SELECT film, seg, greatest(0, greatest(lo - 500, coalesce(least(lo, p - 250), lo - 500))) AS w_lo, least(total, least(hi + 500, coalesce(greatest(hi, n + 250), hi + 500))) AS w_hi FROM cores)
    SELECT film, seg, w_lo, greatest(w_lo, w_hi) AS w_hi FROM w""", "segments",
)
def align_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.segments(spark, sf_dir).select("film", "seg", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"), (F.max("end_ms").over(Window.partitionBy("film")) + 200).alias("total"))
    return sequence.audio_windows(rows).select("film", "seg", "w_lo", "w_hi")


@query(
    rf"""WITH keyed AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key, regexp_extract(text, '^(?:\s*["''“‘(\[¿¡«-]*)(.)', 1) AS head FROM words)
    SELECT film, key FROM keyed WHERE regexp_matches(head, '\p{{Lu}}') AND key <> '' GROUP BY film, key HAVING count(*) >= 2 AND sum(prob_pct) >= 90 * count(*)""", "words",
)
def learned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.learned_names(V.words(spark, sf_dir))


@query("SELECT film, idx FROM words WHERE prob_pct < 60 AND regexp_replace(lower(text), '[^a-z0-9]', '', 'g') <> ''", "words")
def low_conf_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.flag_words(V.words(spark, sf_dir)).where("flag_prob").select("film", "idx")


_FIXED = ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in R.ALWAYS_CAPITAL)
_SHORT = ", ".join(f"'{w}'" for w in R.ABBREVIATIONS_IN_LINES)
_KNOWN = "learned AS (SELECT film, key FROM keyed WHERE regexp_matches(core, '^\\p{Lu}') AND key <> '' GROUP BY film, key HAVING count(*) >= 2 AND sum(prob_pct) >= 90 * count(*))"
_FLAGS = rf"""
WITH cored AS (SELECT *, regexp_extract(text, '(?s)^(\s*["''“‘(\[¿¡«-]*)(.*?)([.,!?;:…"''”’)\]»-]*)$', 2) AS core, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS letters FROM words
), keyed AS (SELECT *, regexp_replace(lower(core), '[^a-z0-9]', '', 'g') AS key FROM cored
), behind AS (
  SELECT *, lag(key) OVER s AS k1, lag(key, 2) OVER s AS k2, lead(key) OVER s AS n1, lead(key, 2) OVER s AS n2,
    coalesce(trim(lag(text) OVER s) <> '' AND NOT (regexp_matches(lag(text) OVER s, '[.!?…][''"”’)\]]*$') AND lag(letters) OVER s NOT IN ({_SHORT})), false) AS inside
  FROM keyed WINDOW s AS (PARTITION BY film ORDER BY idx)
), {_KNOWN}, flags AS (
  SELECT b.film, b.idx, b.key, b.core, b.key <> '' AND prob_pct < 60 AS flag_prob,
    b.inside AND regexp_matches(b.core, '^\p{{Lu}}') AND length(b.key) > 1 AND regexp_matches(b.core, '\p{{Ll}}') AND b.key NOT IN ({_FIXED}) AND lower(b.core) NOT IN ({_FIXED}) AS capital,
    coalesce(b.key <> '' AND ((b.key = k1 AND b.key = k2) OR (b.key = k1 AND b.key = n1) OR (b.key = n1 AND b.key = n2)), false) AS flag_loop
  FROM behind b
)"""


@query(
    f"""{_FLAGS}, named AS (SELECT f.*, capital AND l.key IS NULL AS flag_name FROM flags f LEFT JOIN learned l ON f.film = l.film AND f.key = l.key)
    SELECT film, idx, flag_prob, flag_name, flag_loop, flag_prob OR flag_name OR flag_loop AS flagged FROM named""", "words",
)
def flag_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.flag_words(V.words(spark, sf_dir)).select("film", "idx", "flag_prob", "flag_name", "flag_loop", "flagged")


@query()
def correction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.plan_windows(correct.flag_words(V.words(spark, sf_dir)))


@query()
def correction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words(spark, sf_dir)
    return correct.requests(correct.plan_windows(correct.flag_words(words)), words, "proofreader")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("film"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("original"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("text"))
    return part


@query(
    "SELECT p_partkey AS film, levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS distance, round(levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))::DOUBLE / greatest(length(split_part(p_name, ' ', 1)), length(split_part(p_name, ' ', 2)), 1), 6) AS share FROM part"
)
def lev_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.levenshtein("original", "text")
    return _pairs(spark, sf_dir).select("film", far.cast("bigint").alias("distance"), F.round(far / F.greatest(F.length("original"), F.length("text"), F.lit(1)), 6).alias("share"))


@query()
def metaphone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir).select("text").distinct().select("text", metaphone("text").alias("sound"), alignment_word("text").alias("folded"))


@query()
def judge_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = correct.judge_edits(_pairs(spark, sf_dir)).withColumns({"window": F.col("film") % 50, "pos": F.col("film"), "i": F.col("film") % 9, "n_flags": F.lit(8)})
    return correct.admit_edits(judged.withColumn("film", F.lit(0))).select("window", "pos", "i", "verdict", "reason", "admitted")


_EDGES = r"""'^(\s*["''“‘(\[¿¡«-]*)(.*?)([.,!?;:…"''”’)\]»-]*)$'"""


@query(
    rf"""WITH edited AS (
      SELECT *, coalesce(regexp_matches(lag(text) OVER s, '[.!?…][''"”’)\]]*$') AND regexp_replace(lower(lag(text) OVER s), '[^a-z0-9]', '', 'g') NOT IN ({', '.join(f"'{a}'" for a in R.ABBREVIATIONS_IN_LINES)}), true) AS initial,
        (end_ms - start_ms) AS span, regexp_extract(text, {_EDGES}, 1, 's') AS lead, regexp_extract(text, {_EDGES}, 3, 's') AS trail FROM words WINDOW s AS (PARTITION BY film ORDER BY idx))
    SELECT film, idx, 0 AS part, start_ms, end_ms, text, prob FROM edited WHERE idx % 19 <> 4
    UNION ALL SELECT film, idx, 0, start_ms, start_ms + span * 3 // 8, lead || CASE WHEN initial THEN 'Two' ELSE 'two' END, 1.0 FROM edited WHERE idx % 19 = 4
    UNION ALL SELECT film, idx, 1, start_ms + span * 3 // 8, end_ms, ' words' || trail, 1.0 FROM edited WHERE idx % 19 = 4""", "words",
)
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words(spark, sf_dir)
    edits = words.where("idx % 19 = 4").select("film", "idx", F.lit("two words").alias("rep"))
    return correct.apply_edits(words, edits)


# --- shots -------------------------------------------------------------------------------------

_CHAINS = f"""
WITH marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY film ORDER BY t, score) < {CHAIN_GAP_S} THEN 0 ELSE 1 END AS starts FROM cut_candidates),
chained AS (SELECT *, sum(starts) OVER (PARTITION BY film ORDER BY t, score ROWS UNBOUNDED PRECEDING) AS chain FROM marked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY film, chain ORDER BY score DESC, t) AS r FROM chained),
tops AS (SELECT film, chain, count(*) AS n, max(t) FILTER (r = 1) AS t, max(score) AS score, max(score) FILTER (r = 2) AS next FROM ranked GROUP BY film, chain)"""


@query(f"{_CHAINS} SELECT film, round(t, 6) AS t, score, n FROM tops WHERE n = 1 OR score >= 2 * next", "cut_candidates")
def cut_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.cut_clusters(V.cut_candidates(spark, sf_dir), CHAIN_GAP_S), "t")


@query("SELECT DISTINCT film, CAST(ceil(t * 1000 - 1e-6) AS BIGINT) AS cut_ms FROM (SELECT event_id % 100 AS film, event_id % 5000 / 8.0 AS t FROM events)")
def cut_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    return shots.cut_list(events.select((F.col("event_id") % 100).alias("film"), (F.col("event_id") % 5000 / 8.0).alias("t")))


_READ = "CASE WHEN {e} - {s} > 0 THEN chars / (({e} - {s}) / 1000.0) ELSE 'infinity'::DOUBLE END"
_FITS = "({e} - {s}) / 1000.0 BETWEEN 0.833 AND 7.0 AND (" + _READ + " <= 20 OR " + _READ + " <= {old})"
_SNAP = f"""
WITH c0 AS (SELECT *, length(replace(text, chr(10), '')) AS chars, lag(end_ms) OVER s AS pe, lead(start_ms) OVER s AS ns FROM cues WINDOW s AS (PARTITION BY film ORDER BY start_ms, cue_idx)),
n0 AS (SELECT film, cue_idx, arg_min(cut_ms, abs(cut_ms - start_ms) * 1000000000000 + cut_ms) AS cut FROM c0 JOIN cuts USING (film) WHERE cut_ms BETWEEN start_ms - 500 AND start_ms + 167 GROUP BY ALL),
s0 AS (SELECT c0.*, CASE WHEN cut IS NULL OR cut = start_ms THEN NULL
    WHEN {_FITS.format(s='cut', e='end_ms', old=_READ.format(s='start_ms', e='end_ms'))} AND coalesce(cut - pe >= 83, true) AND coalesce(ns - end_ms >= 83, true) THEN 'snapped' ELSE 'skipped' END AS start_result, cut
  FROM c0 LEFT JOIN n0 USING (film, cue_idx)),
s1 AS (SELECT * EXCLUDE (cut), CASE WHEN start_result = 'snapped' THEN cut ELSE start_ms END AS new_start_ms FROM s0)"""


@query(f"{_SNAP} SELECT film, cue_idx, start_result, new_start_ms FROM s1", "cues", "cuts")
def snap_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.snap_starts(V.cues(spark, sf_dir), V.cuts(spark, sf_dir)).select("film", "cue_idx", "start_result", "new_start_ms")


@query()
def snap_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.snap_cues(V.cues(spark, sf_dir), V.cuts(spark, sf_dir)).select("film", "cue_idx", "new_start_ms", "new_end_ms", "start_result", "end_result")


@query("SELECT film, cue_idx, arg_min(cut_ms, abs(cut_ms - start_ms) * 1000000000000 + cut_ms) AS cut_ms FROM cues JOIN cuts USING (film) WHERE cut_ms BETWEEN start_ms - 1000 AND start_ms + 1000 GROUP BY ALL", "cues", "cuts")
def nearest_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = shots._nearest(V.cues(spark, sf_dir), V.cuts(spark, sf_dir), F.col("start_ms") - 1000, F.col("start_ms") + 1000, F.col("start_ms"), "near")
    return near.where("near is not null").select("film", "cue_idx", F.col("near").alias("cut_ms"))


# --- comparison with a reference ---------------------------------------------------------------

_SPOKEN = r"""
  array_to_string([regexp_replace(regexp_replace(regexp_replace(trim(x), '^[-–—]+\s*', ''), '^[A-Z][A-Z0-9 .''\-]{1,30}:\s*', ''), '^[-–—]+\s*', '')
    FOR x IN string_split(regexp_replace(text, '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), chr(10)) IF NOT regexp_matches(x, '[♪♫#]') AND trim(x) <> ''], ' ')"""


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace({_SPOKEN}, '(\d),(\d\d\d)\b', '\1\2', 'g'), '(\d),(\d\d\d)\b', '\1\2', 'g')) AS spoken_md5 FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.spoken_text(F.col("text"))).alias("spoken_md5"))


@query(r"SELECT film, seg, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+(?:[''’][\p{L}\p{N}\p{M}]+)*')) AS n FROM turns", "turns")
def wordcount_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.turns(spark, sf_dir).select("film", "seg", F.size(T.surface_words(F.col("text"))).cast("bigint").alias("n"))


_BELOW_1000 = """concat_ws(' ', CASE WHEN {0} >= 100 THEN ones[{0} // 100 + 1] || ' hundred' END,
  CASE WHEN {0} % 100 = 0 THEN CASE WHEN {0} = 0 THEN 'zero' END WHEN {0} % 100 < 20 THEN ones[{0} % 100 + 1] WHEN {0} % 10 = 0 THEN tens[{0} % 100 // 10 - 1] ELSE tens[{0} % 100 // 10 - 1] || ' ' || ones[{0} % 10 + 1] END)"""


@query(
    f"""WITH n AS (SELECT o_orderkey AS n, 'zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen'.string_split(' ') AS ones,
      'twenty thirty forty fifty sixty seventy eighty ninety'.string_split(' ') AS tens FROM orders)
    SELECT n, CASE WHEN n BETWEEN 0 AND 999999 THEN CASE WHEN n < 1000 THEN {_BELOW_1000.format('n')} ELSE concat_ws(' ', {_BELOW_1000.format('(n // 1000)')}, 'thousand', CASE WHEN n % 1000 > 0 THEN {_BELOW_1000.format('(n % 1000)')} END) END ELSE n::VARCHAR END AS words FROM n"""
)
def num_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("n").between(0, 999_999), F.array_join(T.number_words(F.col("n")), " ")).otherwise(F.col("n").cast("string"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")).select("n", words.alias("words"))


@query()
def wer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = (evaluate.tokens(x) for x in (V.cues(spark, sf_dir), V.shifted_cues(spark, sf_dir)))
    return rounded(evaluate.word_errors(evaluate.alignment(ref, hyp)), "matched_ratio", "wer", "sub_del_rate")


@query()
def compare_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare(V.cues(spark, sf_dir), V.shifted_cues(spark, sf_dir))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onset differences that jump half-way through a film."""
    return V.cues(spark, sf_dir).select("film", F.lit("onset").alias("kind"), (F.col("start_ms") / 1000).alias("t"), ((F.col("cue_idx") * 37 % 101 + F.when(F.col("cue_idx") > 20, 5000).otherwise(0)) / 1000).alias("d"))


_POINTS = "(SELECT film, 'onset' AS kind, cue_idx, start_ms, start_ms / 1000.0::DOUBLE AS t, (cue_idx * 37 % 101 + CASE WHEN cue_idx > 20 THEN 5000 ELSE 0 END) / 1000.0::DOUBLE AS d FROM cues)"


@query(
    f"SELECT film, kind, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(abs(d), 0.5), 6) AS median_abs, round(quantile_cont(abs(d), 0.9), 6) AS p90_abs, "
    + ", ".join(f"round(100.0 * count(*) FILTER (round_even(abs(d) * 1000, 0) <= {w}) / count(*), 6)::DOUBLE AS within_{w}" for w in R.WITHIN_MS)
    + f" FROM {_POINTS} GROUP BY film, kind", "cues",
)
def onset_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.error_stats(_points(spark, sf_dir)), "median", "median_abs", "p90_abs", *(f"within_{w}" for w in R.WITHIN_MS))


@query(
    f"""WITH p AS {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY film ORDER BY t, d) - 1 AS rn, count(*) OVER (PARTITION BY film) AS n FROM p),
    m AS (SELECT *, min(rn) OVER (PARTITION BY film, t) AS mid FROM r)
    SELECT a.film, a.t, a.d, round(a.d - quantile_cont(b.d, 0.5), 6) AS local FROM m a JOIN m b ON a.film = b.film AND b.rn BETWEEN a.mid - 25 AND a.mid + 25 AND NOT (a.t = b.t AND a.d = b.d) WHERE a.n >= 3 GROUP BY a.film, a.rn, a.t, a.d""", "cues",
)
def local_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.local_offsets(_points(spark, sf_dir).drop("kind")), "local")


@query(
    f"""WITH p AS {_POINTS}, s AS (SELECT film, min(start_ms) / 1000.0::DOUBLE AS t0, (max(end_ms) - min(start_ms)) / 1000.0::DOUBLE AS span FROM cues GROUP BY film)
    SELECT film, round(quantile_cont(d, 0.5) FILTER (t >= t0 + 2 * span / 3) - quantile_cont(d, 0.5) FILTER (t < t0 + span / 3), 6) AS drift, count(*) FILTER (t < t0 + span / 3) AS n_early, count(*) FILTER (t >= t0 + 2 * span / 3) AS n_late FROM p JOIN s USING (film) GROUP BY film""", "cues",
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.drift(_points(spark, sf_dir), V.cues(spark, sf_dir)), "drift")


# --- composing ---------------------------------------------------------------------------------


@query()
def compose_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.compose(V.words(spark, sf_dir))


@query()
def glue_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut into letters and marks, which glue together again."""
    pieces = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    parts = V.words(spark, sf_dir).select("film", "idx", "start_ms", "end_ms", "prob", F.posexplode(pieces).alias("k", "piece"))
    text = F.when(F.col("k") == 0, F.concat(F.lit(" "), "piece")).otherwise(F.col("piece"))
    return cues.glue_words(parts.select("film", (F.col("idx") * 20 + F.col("k")).alias("idx"), "start_ms", "end_ms", "prob", text.alias("text")))


# --- alignment and audio -----------------------------------------------------------------------


@query()
def viterbi_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten embeddings of a label are a segment's frames over eight symbols."""
    rows = V.samples(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("film").orderBy("block")) - 1)
    frames = rows.select("film", F.floor(F.col("n") / 10).alias("seg"), (F.col("n") % 10).alias("frame"), F.transform(F.slice("samples", 1, 8), lambda x: -F.abs(x.cast("double"))).alias("logp"))
    spoken = frames.select("film", "seg").distinct().select("film", "seg", F.posexplode(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)), F.array(F.lit(5), F.lit(3)))).alias("idx", "tokens"))
    return align.align_segments(frames, spoken)


@query("SELECT film, CASE WHEN m > 0 THEN round(10 * log10(m), 4) ELSE '-infinity'::DOUBLE END AS dbfs FROM (SELECT film, sum(list_sum([x::DOUBLE * x::DOUBLE FOR x IN samples])) / sum(len(samples)) AS m FROM samples GROUP BY film)", "samples")
def rms_dbfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audio.level_dbfs(V.samples(spark, sf_dir)), "dbfs", digits=4)


@query("SELECT film, arg_min(block, e) AS block FROM (SELECT film, block, list_sum([x::DOUBLE * x::DOUBLE FOR x IN samples]) AS e FROM samples) GROUP BY film", "samples")
def quietest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.quietest_block(V.samples(spark, sf_dir))


@query()
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.chunk_bounds(V.samples(spark, sf_dir), rate=32, step_s=20.0, reach_s=4.0)


@query()
def emission_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.batches(V.segments(spark, sf_dir).select("film", F.col("seg").alias("idx"), (F.col("end_ms") - F.col("start_ms")).alias("length")), 60_000, 4)


@query("SELECT seg, n, greatest(0, (((((((n - 10) // 5 + 1 - 3) // 2 + 1 - 3) // 2 + 1 - 3) // 2 + 1 - 3) // 2 + 1 - 2) // 2 + 1 - 2) // 2 + 1)::BIGINT AS frames FROM (SELECT event_id AS seg, 400 + event_id * 16 AS n FROM events)")
def conv_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("seg"), (400 + F.col("event_id") * 16).alias("n")).withColumn("frames", audio.conv_frames(F.col("n")))


_TRACKS = "SELECT 'film' || p_partkey // 4 AS path, p_partkey % 4 AS index, p_partkey % 3 = 0 AS is_default, p_name LIKE '%ring%' AS comment, false AS visual_impaired, CASE WHEN p_name LIKE 'red%' THEN 'Director comments' ELSE p_name END AS title, ['eng', 'deu', 'fra'][p_partkey % 3 + 1] AS language FROM part"


@query(f"SELECT path, arg_min(index, ((comment OR lower(title) LIKE '%director%')::INT * 4 + (language <> 'deu')::INT * 2 + (NOT is_default)::INT) * 100 + index) AS index FROM ({_TRACKS}) GROUP BY path")
def pick_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    tracks = V.table(spark, sf_dir, "part").select(
        F.concat(F.lit("film"), F.floor(key / 4).cast("string")).alias("path"), (key % 4).alias("index"), (key % 3 == 0).alias("is_default"), name.contains("ring").alias("comment"), F.lit(False).alias("visual_impaired"),
        F.when(name.startswith("red"), "Director comments").otherwise(name).alias("title"), F.element_at(F.array(F.lit("eng"), F.lit("deu"), F.lit("fra")), (key % 3 + 1).cast("int")).alias("language"),
    )
    return audio.pick_track(tracks, "de")


# --- library and ledger ------------------------------------------------------------------------

_VIDEOS = f"SELECT * FROM listing WHERE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('mkv', 'mp4') AND NOT regexp_matches(lower(path), '^.*/de/.*$') AND {NOW} - mtime >= 600"
_STEM = r"regexp_replace(regexp_extract({}, '([^/]*)$', 1), '\.[^.]*$', '')"
_SIDECARS = f"""
WITH videos AS ({_VIDEOS}), subs AS (SELECT path AS sidecar FROM listing WHERE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('srt', 'ass', 'ssa', 'vtt', 'sub', 'idx', 'smi')),
found AS (SELECT path, sidecar FROM videos JOIN subs ON regexp_extract(path, '^(.*)/[^/]*$', 1) = regexp_extract(sidecar, '^(.*)/[^/]*$', 1)
  AND split_part({_STEM.format('path')}, '.', 1) = split_part({_STEM.format('sidecar')}, '.', 1) AND starts_with(regexp_extract(sidecar, '([^/]*)$', 1), {_STEM.format('path')}))"""


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.find_videos(V.listing(spark, sf_dir), NOW, ["*/de/*"], 600)


@query(f"SELECT path, size, mtime FROM ({_VIDEOS})", "listing")
def find_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _videos(spark, sf_dir).select("path", "size", "mtime")


@query("SELECT path FROM listing WHERE regexp_matches(lower(path), '^.*/de/.*$') OR regexp_matches(lower(path), '^.*/[0-9]7.*\\.v.\\.mkv$')", "listing")
def ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.listing(spark, sf_dir).where(listing.is_ignored(F.col("path"), ["*/de/*", "*/[0-9]7*.v?.mkv"])).select("path")


@query(f"{_SIDECARS} SELECT path, sidecar FROM found", "listing")
def sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.sidecars(_videos(spark, sf_dir), V.listing(spark, sf_dir))


@query(
    f"""{_SIDECARS}, sums AS (SELECT path, min(sidecar) FILTER (sidecar LIKE '%.auto.%.srt' AND starts_with(regexp_extract(sidecar, '([^/]*)$', 1), {_STEM.format('path')} || '.auto.')) AS own, min(sidecar) AS any_sub FROM found GROUP BY path)
    SELECT path, any_sub IS NULL AS needs, coalesce('output already exists: ' || regexp_extract(own, '([^/]*)$', 1), 'external subtitles present: ' || regexp_extract(any_sub, '([^/]*)$', 1), '') AS reason FROM videos LEFT JOIN sums USING (path)""", "listing",
)
def needs_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.needs_subtitles(_videos(spark, sf_dir), V.listing(spark, sf_dir))


_STATE = """
WITH forgot AS (SELECT path, max(seq) AS forgotten FROM ledger_events WHERE op = 'forget' GROUP BY path),
live AS (SELECT e.* FROM ledger_events e LEFT JOIN forgot USING (path) WHERE op <> 'forget' AND seq > coalesce(forgotten, -1)),
born AS (SELECT path, max(seq) AS last, min(seq) AS born FROM live WHERE op = 'record' GROUP BY path),
known AS (SELECT live.*, last FROM live JOIN born USING (path) WHERE seq >= born),
state AS (
  SELECT path, arg_max(size, seq) FILTER (op = 'record') AS size, arg_max(mtime, seq) FILTER (op = 'record') AS mtime, arg_max(status, seq) FILTER (op = 'record') AS status, arg_max(pipeline, seq) FILTER (op = 'record') AS pipeline,
    arg_max(subtitle, seq) FILTER (op = 'record') AS subtitle, arg_max(sub_size, seq) FILTER (op = 'record') AS sub_size, arg_max(sub_mtime, seq) FILTER (op = 'record') AS sub_mtime,
    arg_max(reason, seq) AS reason, count(*) FILTER (op = 'record' AND bump) AS attempts, count(*) FILTER (op = 'regen_fail' AND seq > last) AS regen_attempts, max(last) AS updated_seq FROM known GROUP BY path)"""
_STATE_COLUMNS = "path, size, mtime, status, pipeline, subtitle, sub_size, sub_mtime, reason, attempts, regen_attempts, updated_seq"


@query(f"{_STATE} SELECT {_STATE_COLUMNS} FROM state", "ledger_events")
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.current_state(V.ledger_events(spark, sf_dir)).select(*_STATE_COLUMNS.split(", "))


@query(f"{_STATE} SELECT path, status, reason, updated_seq FROM state WHERE status = 'failed' ORDER BY updated_seq DESC LIMIT 25", "ledger_events")
def ledger_history_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.history(ledger.current_state(V.ledger_events(spark, sf_dir)), "failed", 25).select("path", "status", "reason", "updated_seq")


@query(f"{_STATE} SELECT status, count(*) AS n FROM state GROUP BY status", "ledger_events")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts(ledger.current_state(V.ledger_events(spark, sf_dir)))


_SEEN = "SELECT user_id AS path, max(event_id) % 1000 AS size, arg_max(value, event_id) + 0.5 AS mtime FROM events GROUP BY user_id"


@query(f"{_STATE} SELECT f.path, coalesce(f.size = s.size AND abs(f.mtime - s.mtime) <= 1 AND (status IN ('done', 'skipped') OR attempts >= 3), false) AS skip FROM ({_SEEN}) f LEFT JOIN state s USING (path)", "ledger_events")
def should_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    seen = events.groupBy(F.col("user_id").alias("path")).agg((F.max("event_id") % 1000).alias("size"), (F.max_by("value", "event_id") + 0.5).alias("mtime"))
    return ledger.should_skip(seen, ledger.current_state(V.ledger_events(spark, sf_dir)))


@query(f"{_STATE} SELECT path, subtitle, pipeline, regen_attempts FROM state WHERE status = 'done' AND pipeline < 4 AND regen_attempts < 2 AND sub_size % 2 = 0", "ledger_events")
def outdated_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ledger.current_state(V.ledger_events(spark, sf_dir))
    files = state.select(F.col("subtitle").alias("path"), F.when(F.col("sub_size") % 2 == 0, F.col("sub_size")).otherwise(-1).alias("size"), F.col("sub_mtime").alias("mtime"))
    return ledger.outdated_outputs(state, files, 4).select("path", "subtitle", "pipeline", "regen_attempts")


@query("SELECT event_id, (extract('hour' FROM ts) * 60 + extract('minute' FROM ts) >= 1320 OR extract('hour' FROM ts) * 60 + extract('minute' FROM ts) < 390) AS allowed FROM events")
def work_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.hour("ts") * 60 + F.minute("ts")
    return V.table(spark, sf_dir, "events").select("event_id", C.in_window(minute, C.minute_of_day(F.lit("22:00")), C.minute_of_day(F.lit("6:30"))).alias("allowed"))


@query("SELECT event_id, CASE WHEN event_type = 'error' OR event_type = 'signup' OR 2 * (event_id % 100) < 100 THEN 1 ELSE 4 END AS pipeline FROM events")
def effective_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return V.table(spark, sf_dir, "events").select("event_id", ledger.effective_pipeline(kind != "signup", kind == "error", F.col("event_id") % 100, F.lit(100)).alias("pipeline"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' OR codec = 'prores' THEN 'cpu' ELSE 'nvdec' END AS decoder FROM (SELECT *, ['h264', 'hevc', 'prores', 'av1'][event_id % 4 + 1] AS codec FROM events)")
def pick_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.element_at(F.array(*(F.lit(x) for x in ("h264", "hevc", "prores", "av1"))), (F.col("event_id") % 4 + 1).cast("int"))
    mode = F.when(F.col("event_type") == "error", "off").when(F.col("event_type") == "click", "cpu").otherwise("auto")
    return V.table(spark, sf_dir, "events").select("event_id", shots.pick_decoder(mode, codec).alias("decoder"))


@query()
def media_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.parse_paths(V.files(spark, sf_dir).select("path").distinct())


@query(r"SELECT path, CASE WHEN regexp_matches(path, '/[^/]*[^/ ][^/]* \(\d{4}\)[^/]*$') THEN CAST(1990 + min(page_id % 30) AS INTEGER) END AS year FROM files GROUP BY path", "files")
def path_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.parse_paths(V.files(spark, sf_dir).select("path").distinct()).select("path", "year")


@query(
    f"""{_FLAGS}, given AS (SELECT DISTINCT film, key FROM keyed WHERE seg % 2 = 0 AND regexp_matches(core, '^\\p{{Lu}}') AND length(key) > 1
    ), names AS (SELECT * FROM learned UNION SELECT * FROM given)
    SELECT f.film, f.idx FROM flags f LEFT JOIN names k ON f.film = k.film AND f.key = k.key WHERE capital AND k.key IS NULL""", "words",
)
def names_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words within sentences that are no name: neither learned, nor a word of every second turn taken as the film's known names."""
    words = V.words(spark, sf_dir)
    given = words.where("seg % 2 = 0").select("film", T.edge_part(F.col("text"), "core").alias("name"))
    return correct.flag_words(words, given).where("flag_name").select("film", "idx")


# --- streams -----------------------------------------------------------------------------------


def _drained(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Everything that a stream over files gives, through a Parquet sink in the shared folder."""
    out, state = shared_path(spark, label), shared_path(spark, label + "-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    for path in (out, state):
        remove_at_exit(spark, path)
    return spark.read.schema(stream.schema).parquet(out)


@query(
    """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER s <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts)),
    runs AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS events FROM runs GROUP BY user_id, run"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions: those that the watermark closed, and at the end those still open."""
    V.table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parquet"
    closed = _drained(jobs.sessions(jobs.event_stream(spark, path)), spark, "sessions")
    events = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    found = jobs.with_open_sessions(closed, events)
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("SELECT user_id AS path, bool_or(event_type = 'error') AS forced FROM events GROUP BY user_id")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs queued once, and once more when forced."""
    V.table(spark, sf_dir, "events")
    events = jobs.event_stream(spark, f"{sf_dir}/events.parquet")
    queued = _drained(jobs.forced_queue(events.select(F.col("user_id").cast("string").alias("path"), (F.col("event_type") == "error").alias("force"))), spark, "queue")
    return queued.groupBy(F.col("path").cast("bigint").alias("path")).agg(F.bool_or("force").alias("forced"))
