import math
import re
from fractions import Fraction
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuewright.llm import language_id, quality_rules, toxicity
from cuewright.llm.common import text_buffer
from cuewright.llm.queries import QUERIES

SIZE = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SIZE}/{name}.parquet")


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op6_language_id"](spark, SIZE).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, odd_docs):
    model = language_id.train(odd_docs.unionByName(table(spark, "documents"), allowMissingColumns=True))
    rows = language_id.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    none = [r for r in rows if r.doc_id in (3, 4, 6)]
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in none)
    assert all(r.lang_pred != "und" for r in rows if r.doc_id in (1, 5, 8))
    nothing = language_id.train(odd_docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}
    assert language_id.identify(odd_docs.limit(0), model).collect() == []


def test_toxicity_of_held_out_documents(spark):
    labels = table(spark, "labels").select("doc_id", "toxic")
    rows = QUERIES["op10_toxicity"](spark, SIZE).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits >= 0.6 * sum(r.toxic for r in held) and hits >= 0.8 * sum(r.predicted for r in held)


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = table(spark, "labels").unionByName(spark.createDataFrame([(1, None, 1), (1, 0, 0), (None, 1, 1), (10**9, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int"))
    model = toxicity.train(table(spark, "documents"), labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    one_class = toxicity.train(table(spark, "documents"), labels.withColumn("toxic", F.lit(0)))
    assert all(r.score < 0.01 for r in toxicity.score(odd_docs, one_class).collect())
    assert toxicity.score(odd_docs.limit(0), model).collect() == []
    kept = toxicity.without_toxic(odd_docs, model, 0.3)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.score < 0.3 for r in rows)


def place_of(gram):
    """The documented hash of one n-gram, in plain integers."""
    whole = 0
    for c in gram:
        whole = (whole * 0x01000193 + (ord(c) + 1) * 0x9E3779B1) % 2**32
    return ((whole ^ whole >> 15) * (0x85EBCA6B + 2 * len(gram)) % 2**32) >> 14


def test_toxicity_features_and_scores_equal_brute_force():
    texts = ["Été à la plage", "", "漢字🙂かな漢字🙂かな", "ab", "abc", "Plain Text, plain text", "é", "🙂🙂🙂", "x" * 50 + "ß"]
    data, offsets = text_buffer(pa.array([*texts, None]))
    low = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts] + [""]
    grams = [{place_of(t[i : i + n]) for n in (3, 4, 5) for i in range(len(t) - n + 1)} for t in low]
    row, place = toxicity._hits(data, offsets, None)
    assert list(zip(row.tolist(), place.tolist())) == sorted((i, g) for i, own in enumerate(grams) for g in own)
    known = sorted(set().union(*grams))[::2]
    model = toxicity.ToxicityModel(np.array(known), np.linspace(-1, 1, len(known)), -0.5)
    weight = dict(zip(known, model.weights))
    exact = [1 / (1 + math.exp(0.5 - sum(weight.get(g, 0.0) for g in own))) for own in grams]
    assert model.score(data, offsets, model.table()).tolist() == pytest.approx(exact)


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set()
    covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_equal_brute_force(spark, odd_docs):
    texts = ["a b c d e f a b c d e g", "a a a a a a a a a a a a", "x\nx\n \nx y\n\nx", "one two three four five " * 3, "# a$ |b| é漢🙂", "a b c d e a b c d e a b c d e z"]
    more = spark.createDataFrame([(100 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    rows = quality_rules.apply_rules(docs, spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert found == sorted((r.doc_id is None, r.doc_id or 0, *base_of(r.text)) for r in docs.collect())
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert quality_rules.apply_rules(docs.limit(0), table(spark, "labels")).collect() == []


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 10, 400, 2000) for k in (0, 1, 3, 10) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        p = Fraction(1, 100)
        exact = float(sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)))
        assert r.p == (1.0 if r.k >= r.n * 0.01 else pytest.approx(exact, rel=1e-9))


@pytest.mark.parametrize("few", [quality_rules.FEW_STRATA, 0])
def test_cutoffs_hold_false_rejections_down(spark, monkeypatch, few):
    """Good documents of stratum a have few symbols and bad ones many; stratum b has too few labels to reject anything."""
    monkeypatch.setattr(quality_rules, "FEW_STRATA", few)  # both ways to join the cutoffs
    rows = [(i, "a" if i < 4000 else "b", " ".join(f"w{i}x{j}{'####' if i % 2 else ''}" for j in range(14))) for i in range(4040)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    out = quality_rules.apply_rules(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").where("not base_failed")
    share = {(r.lang, r.bad): r.kept for r in out.groupBy("lang", (F.col("doc_id") % 2 == 1).alias("bad")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[("a", True)] == 0 and share[("a", False)] >= 0.99 and share[("b", True)] == 1


def test_rules_match_sql(spark):
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.sql(f"create view {name} as select * from '{SIZE}/{name}.parquet'")
    found = quality_rules.apply_rules(table(spark, "documents"), table(spark, "labels"))
    sql = c.sql(quality_rules.ORACLE)
    assert sorted(tuple(r[k] for k in sql.columns) for r in found.collect()) == sorted(sql.fetchall())
