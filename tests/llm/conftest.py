import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    base = "the cat sat on the mat and then it went away to find some other place to sleep"
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, "", "en"), (4, None, None), (None, base + " now", "en"), (None, None, "fr"),
        (5, "word", "en"), (6, " \t\n ", "en"), (7, " ".join(f"w{i}" for i in range(30_000)), "de"), (8, "été à la plage, 漢字 🙂 x\x0by", "fr"), (-9, base.upper(), "en"),
    ]
    rows = [(i, t, lang, "src", len(t) if t else None, 1, "t", 2.5, None) for i, t, lang in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, t string, n double, node string")
