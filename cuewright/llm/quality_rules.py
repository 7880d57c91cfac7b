"""Quality rules with risk-controlled cutoffs. DataFrame operations only.

Base rules are counts over the whole text. Further rules reject a document whose rate of some feature
reaches a cutoff. The cutoffs are chosen on labelled documents, per stratum and rule: among the good
ones (quality 1), k of n would be rejected; the cutoff is acceptable if, were the true rate of false
rejections above ``risk``, so few would be seen with a probability of at most the level (exact
binomial tail). Levels are corrected for the number of strata and rules (Bonferroni); within a rule
cutoffs are tested from the largest down and testing stops at the first that fails, so that needs no
further correction. With probability 1 - ``delta`` no stratum's rule then rejects more than ``risk`` of
its good documents. A rule without an acceptable cutoff rejects nothing.

Word windows are compared by 64-bit hashes within one text.

Defined results: null and empty texts have no words and fail the base. Null strata are a stratum of
their own. Label rows without a document teach nothing; of several labels for one id the smallest
quality counts, and repeated ids count once each. A stratum without labels rejects nothing beyond the
base. Null ids take no part in the choice of cutoffs. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import written

BREAKS = " \t\n\u000b\f\r"
WINDOW = 5
#: rule: cutoffs in ascending order (rates in thousandths).
RULES = {
    "symbols": (100, 200, 400, 600, 1000, 1500, 2000, 3000),  # symbols per 1000 words
    "shouting": (100, 200, 300, 400, 500, 700),  # capitals per 1000 word characters
    "repeats": (20, 50, 100, 150, 200, 300, 500),  # words in repeated windows per 1000 words
    "lines": (50, 100, 200, 300, 500),  # repeated lines per 1000 lines with words
}

#: The cutoffs of so many strata are broadcast; of more, they are joined, with a stratum's rows in so many parts.
FEW_STRATA, SALTS = 10_000, 32


def base_features(docs: DataFrame, id_col: str, text_col: str, extra: list[Column]) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals, lines, *extra)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(BREAKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BREAKS)) != "")
    rows = docs.select(
        F.col(id_col).alias("id"), *extra, words.alias("w"), lines.alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("capitals"),
    )
    names = [c for c in rows.columns if c not in ("w", "l")]
    n = F.size("w")
    windows = F.expr(f"if(size(w) >= {WINDOW}, transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(WINDOW))})), cast(array() as array<bigint>))")
    rows = rows.select(
        *names, n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), windows.alias("h"),
    )
    names = [c for c in rows.columns if c != "h"]
    # Sorted by hash, a repeated window has an equal neighbour; each place covers up to 5 words, less where the next comes sooner.
    covered = F.expr(f"""
        aggregate(
          transform(array(sort_array(transform(
            element_at(transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))),
              s -> filter(s, (x, k) -> x.h <=> get(s, k - 1).h or x.h <=> get(s, k + 1).h)), 1), x -> x.i))),
            p -> aggregate(transform(p, (v, k) -> least({WINDOW}, coalesce(get(p, k + 1) - v, {WINDOW}))), 0L, (a, x) -> a + x)),
          0L, (a, x) -> a + x)""")
    repeats = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("long")).otherwise(covered)
    return rows.select(*names, repeats.alias("n_repeat_words"))


def _rates(rows: DataFrame) -> DataFrame:
    per = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return rows.withColumns({"symbols": per("n_symbols", "n_words"), "shouting": per("capitals", "word_chars"), "repeats": per("n_repeat_words", "n_words"), "lines_rate": per("n_dup_lines", "lines")})


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1 by Stirling's series after a shift by 8; the error is below 1e-12."""
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), where k is below n * p; 1 elsewhere. Terms 40 deviations below the mean are left out."""
    k, n = k.cast("double"), n.cast("double")
    first = F.greatest(F.lit(0.0), F.floor(n * p - 40 * F.sqrt(n * p + 1)).cast("double"))
    term = lambda i: F.exp(log_gamma(n + 1) - log_gamma(i + 1) - log_gamma(n - i + 1) + i * F.log(F.lit(p)) + (n - i) * F.log(F.lit(1 - p)))
    total = F.aggregate(F.sequence(first.cast("long"), k.cast("long")), F.lit(0.0), lambda a, i: a + term(i.cast("double")))
    return F.when(k >= n * p, 1.0).when(k < first, 0.0).otherwise(F.least(total, F.lit(1.0)))


def cutoffs(features: DataFrame, labels: DataFrame, strata: int, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """(stratum, one nullable cutoff per rule). ``features`` has id, stratum (of ``strata`` values) and the rates; ``labels`` has id and quality."""
    good = labels.where("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality")).where("quality = 1").select("id")
    counts = [F.count("*").alias("n")]
    for rule, grid in RULES.items():
        column = "lines_rate" if rule == "lines" else rule
        counts += [F.count_if(F.col(column) >= c).alias(f"{rule}_{c}") for c in grid]
    per = features.where("n_words >= 10").join(good, "id").groupBy("stratum").agg(*counts)
    grid = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r, g in RULES.items() for c in g))
    tested = per.select("stratum", "n", F.explode(grid).alias("g"))
    passes = binomial_tail(F.col("g.k"), F.col("n"), risk) <= delta / (max(1, strata) * len(RULES))
    tested = tested.select("stratum", "g.rule", "g.cutoff", passes.alias("ok"))
    failed = tested.groupBy("stratum", "rule").agg(F.max(F.when(~F.col("ok"), F.col("cutoff"))).alias("failed"), F.sort_array(F.collect_list("cutoff")).alias("grid"))
    least = F.array_min(F.filter("grid", lambda c: F.col("failed").isNull() | (c > F.col("failed"))))
    chosen = failed.select("stratum", "rule", least.alias("cutoff"))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0")).alias("stratum")
    found = _rates(written(base_features(docs, id_col, text_col, [stratum]), "features"))
    labels = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"))
    strata = found.select("stratum").distinct().count()
    chosen = cutoffs(found, labels, strata, risk, delta)
    if strata <= FEW_STRATA:
        out = found.join(F.broadcast(chosen), "stratum", "left")
    else:  # a hot stratum's rows go to SALTS tasks
        salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["stratum", "salt"], "left").drop("salt")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    column = {r: "lines_rate" if r == "lines" else r for r in RULES}
    reasons = F.array_compact(F.array(F.when(failed, "base"), *(F.when(F.col(column[r]) >= F.col(f"cut_{r}"), r) for r in RULES)))
    out = out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array_join(reasons, ",").alias("reasons"))
    return out.withColumn("kept", F.col("reasons") == "")


def _oracle(risk: float = 0.01, delta: float = 0.05) -> str:
    column = {"symbols": "symbols", "shouting": "shouting", "repeats": "repeats", "lines": "lines_rate"}
    tests = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {c} AS cutoff, count(*) AS n, count(*) FILTER ({column[r]} >= {c}) AS k FROM good GROUP BY stratum" for r, g in RULES.items() for c in g
    )
    cuts = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)
    reasons = ", ".join(f"CASE WHEN {column[r]} >= cut_{r} THEN '{r}' END" for r in RULES)
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, stratum, text, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM docs
), grams AS (
  SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)
), repeated AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM repeated, (SELECT unnest(range({WINDOW})) AS j) GROUP BY doc_id
), features AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS capitals,
    CAST(len(l) AS BIGINT) AS lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)
), rates AS (
  SELECT *, floor(1000 * n_symbols / greatest(n_words, 1)) AS symbols, floor(1000 * capitals / greatest(word_chars, 1)) AS shouting,
    floor(1000 * n_repeat_words / greatest(n_words, 1)) AS repeats, floor(1000 * n_dup_lines / greatest(lines, 1)) AS lines_rate FROM features
), good AS (
  SELECT rates.* FROM rates JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE n_words >= 10
), tests AS ({tests}
), tails AS (
  SELECT stratum, rule, cutoff, CASE WHEN k >= n * {risk} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) FROM (SELECT unnest(range(k + 1)) AS i)) END AS tail FROM tests
), failed AS (
  SELECT stratum, rule, max(cutoff) FILTER (tail > {delta} / ((SELECT count(DISTINCT stratum) FROM docs) * {len(RULES)})) AS failed FROM tails GROUP BY ALL
), chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tails JOIN failed USING (stratum, rule) WHERE failed IS NULL OR cutoff > failed GROUP BY ALL
), cuts AS (SELECT stratum, {cuts} FROM chosen GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  concat_ws(',', CASE WHEN n_words < 10 OR 100 * n_repeat_words > 20 * n_words THEN 'base' END, {reasons}) AS reasons,
  concat_ws(',', CASE WHEN n_words < 10 OR 100 * n_repeat_words > 20 * n_words THEN 'base' END, {reasons}) = '' AS kept
FROM rates LEFT JOIN cuts USING (stratum)
"""


ORACLE = _oracle()
