"""Every registered query against its SQL counterpart on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cuewright.plans import catalogue


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return round(float(v), 5) if math.isfinite(float(v)) else str(float(v))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    df, sql = catalogue.QUERIES[name](spark, small), duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    at = [sql.columns.index(c) for c in names]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=str)


def test_results_do_not_depend_on_partitions(spark, small):
    from cuewright.operators import cues, quality
    from cuewright.plans import views

    words = views.words(spark, small).where("film < 4")
    assert sorted(cues.compose(words).collect()) == sorted(cues.compose(words.repartition(7, "idx")).collect())
    rows = views.cues(spark, small)
    both = quality.score(rows.where("film < 5")).union(quality.score(rows.where("film >= 5")))
    assert sorted(map(str, quality.score(rows).collect())) == sorted(map(str, both.collect()))


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "qa_score" in e.queries()


def test_num_words_keeps_every_order(spark, tmp_path):
    keys = [1, 999_999, 1_000_000, 1_500_000, 6_000_000_000, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.n: r.words for r in catalogue.QUERIES["num_words"](spark, str(tmp_path)).collect()}
    assert found == {1: "one", 999_999: "nine hundred ninety nine thousand nine hundred ninety nine", 1_000_000: "1000000", 1_500_000: "1500000", 6_000_000_000: "6000000000", None: None}


def test_learned_names_equal_sql_at_the_threshold(spark, tmp_path):
    """Words of 85 and 95 hundredths, in turns 5 and 35, are certain enough; those of a turn without a number have no probability."""
    rows = [(0, 5, "Anna"), (0, 35, "Anna"), (1, 92, "Bob"), (1, 92, "Bob"), (1, None, "Bob")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = [tuple(r) for r in catalogue.QUERIES["learned_names"](spark, str(tmp_path)).collect()]
    assert found == c.sql(catalogue.ORACLES["learned_names"]).fetchall() == [(0, "anna")]


def test_every_doubtful_word_is_in_a_window(spark, small):
    doubtful = {(r.film, r.idx) for r in catalogue.QUERIES["flag_words"](spark, small).where("flagged").collect()}
    windows = catalogue.QUERIES["correction_windows"](spark, small).collect()
    assert doubtful and {(w.film, i) for w in windows for i in w.flags} == doubtful
    asked = {(r.film, r.window) for r in catalogue.QUERIES["correction_requests"](spark, small).collect()}
    assert asked == {(w.film, w.window) for w in windows}
