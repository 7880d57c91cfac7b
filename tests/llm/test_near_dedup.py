import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cuewright.llm import near_dedup
from cuewright.llm.near_dedup import deduplicated, near_duplicates, similarity_sketch


def shingles(text, k=5):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if sets[i]:
            ids[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [d for d in ids[find(i)] if d is not None] if sets[i] else [doc]
        comp = min(known) if known and known[0] is not None else None
        out.append((doc, len(sets[i]), comp, comp is None or doc == comp))
    return sorted(out, key=str)


def check(df, percent=85, **options):
    found = sorted(map(tuple, near_duplicates(df, percent=percent, **options).collect()), key=str)
    assert found == brute([(r.doc_id, r.text) for r in df.collect()], percent)


def copies(seed=3, groups=4, size=40):
    random.seed(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{random.randint(0, 60)}" for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3, 5, 8])):
                words[random.randrange(len(words))] = f"x{random.random()}"
            rows.append((len(rows) * 7 % 1000, " ".join(words)))
    return rows


def test_documents(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_rows(spark, odd_docs):
    check(odd_docs)
    check(odd_docs.limit(0))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("bucket", [1, 32])
def test_groups_of_copies_lose_no_link(spark, monkeypatch, percent, bucket):
    """With a small-bucket limit of 1 every open bucket goes through the exact prefix filter."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", bucket)
    check(spark.createDataFrame(copies(), "doc_id long, text string"), percent)


def test_prefix_filter_finds_all_pairs(spark):
    random.seed(9)
    base = list(range(100))
    sets = [sorted({*random.sample(base, random.randint(60, 100)), *random.sample(range(100, 130), 4)}) for _ in range(60)]
    members = spark.createDataFrame([(i, i) for i in range(60)], "node long, root long")
    items = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "node long, n long, items array<long>")
    found = {(r.a, r.b) for r in near_dedup._prefix_pairs(members, items, 80).collect()}
    true = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert true and true <= found


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    row = np.repeat([0, 1], 400)
    s = similarity_sketch(row, np.concatenate([a, b]), 2, 252)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    one = similarity_sketch(np.array([0]), np.array([5], np.uint64), 1, 252)
    assert (one != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_one_row_of_each_group_stays(spark, odd_docs):
    df = spark.createDataFrame(copies(), "doc_id long, text string")
    kept = {r[0] for r in brute([tuple(r) for r in df.collect()], 80) if r[3]}
    assert sorted(r.doc_id for r in deduplicated(df).collect()) == sorted(kept)
    rows = deduplicated(odd_docs).collect()
    assert rows[0].asDict().keys() == set(odd_docs.columns) and [sum(r.doc_id == d for r in rows) for d in (-9, 1, 2)] == [1, 0, 0]
    assert {3, 4, 5, 6, 7, 8, -9} <= {r.doc_id for r in rows}


def test_rows_that_share_an_id_are_judged_apart(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "abcdefgh"}
    near = texts["c"].replace("c59", "other")

    def kept(rows):
        return sorted(((r.doc_id, r.text) for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)

    for a, b in ("ab", "ba", "de", "ed", "fg", "gf"):
        a, b = texts[a], texts[b]
        assert kept([(5, a), (5, b), (3, b)]) == [(3, b), (5, a)]
    c, d, e = (texts[x] for x in "cde")
    assert kept([(5, c), (5, d), (5, c)]) == sorted([(5, c), (5, d)])
    assert len(kept([(5, c), (5, near)])) == 1
    # One null id that stays does not bring back the others; empty texts all stay.
    empty = [(None, ""), (None, ""), (None, None), (7, " \t"), (7, " \t")]
    found = kept([*empty, (None, d), (2, d), (None, e), (None, e), (None, c), (None, near)])
    assert found == sorted([*empty, (2, d), (None, e), (None, c), (None, near)], key=str)
