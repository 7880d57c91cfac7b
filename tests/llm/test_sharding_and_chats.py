import random
from collections import defaultdict
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from cuewright.llm.chat_format import ORACLE, render_chats
from cuewright.llm.sharding import Cell, Cuts, shard_by_bytes


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                used, load = used + 1, 0
            load += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def verify(docs, rows, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert len(rows) == docs.count()
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    total = defaultdict(int)
    for r in keyed:
        total[r.h] += size(r.text)
    crcs = {crc32((r.text or "").encode()): r.h for r in keyed}
    loads, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[crcs[r.text_crc32]].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert max(loads.values()) == least_capacity([total[h] for h in sorted(total)], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_documents_are_cut_optimally(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    verify(docs, shard_by_bytes(docs).collect(), 8)


def test_odd_rows_and_a_hot_text(spark, odd_docs):
    verify(odd_docs, shard_by_bytes(odd_docs, 3).collect(), 3)
    hot = spark.range(600).select("id", F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 50).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    verify(hot, shard_by_bytes(hot, 8).collect(), 8)


def test_empty_table(spark, odd_docs):
    assert shard_by_bytes(odd_docs.limit(0)).collect() == []


def test_coarse_cells_bound_the_optimum():
    random.seed(4)
    for _ in range(50):
        sizes = [random.randint(1, 60) for _ in range(random.randint(1, 40))]
        fine = [Cell(i, 0, s, 1) for i, s in enumerate(sizes)]
        coarse = [Cell(i, 2, sum(sizes[i * 4 : i * 4 + 4]), len(sizes[i * 4 : i * 4 + 4])) for i in range(-(-len(sizes) // 4))]
        best = least_capacity(sizes, 5)
        assert Cuts(fine, 5).capacity(False) == best
        assert Cuts(coarse, 5).capacity(True) <= best <= Cuts(coarse, 5).capacity(False)
        cuts = Cuts(fine, 5)
        ends = [0, *cuts.place(best), cuts.total]
        assert all(0 <= b - a <= best for a, b in zip(ends, ends[1:]))


def brute_chats(rows):
    convs = defaultdict(set)
    for r in rows:
        convs[r[0]].add(r[1:])
    key = lambda x: tuple((v is not None, v) for v in x)
    order = {c: [t[1:] for t in sorted(v, key=key)] for c, v in convs.items()}
    kept = {}
    for c, turns in order.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in order.values()):
            continue
        same = [x for x, o in order.items() if o == turns]
        if c == min(same, key=lambda x: (x is None, x)):
            kept[c] = "".join(f"<|{role or 'unknown'}|>\n{(text or '').replace('<|', '< |')}<|end|>\n" for role, text in turns)
    return kept


def test_snapshots_collapse(spark):
    random.seed(2)
    rows = []
    for c in range(60):
        base = random.randint(0, 5)
        for t in range(random.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {base} {t if random.random() < 0.8 else 'x'} <|"))
    rows += [(None, 0, None, None), (None, 1, "user", "hi"), (77, 0, None, None), (78, None, "user", ""), rows[0], (79, 3, "user", "a"), (79, 3, "user", "b")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, place int")
    found = {r.conv_id: r.rendered for r in render_chats(df).collect()}
    assert found == brute_chats(rows)


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(200)] + [(2, t, "user", f"t{t}") for t in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(render_chats(df).collect(), key=lambda r: r.first_turn)
    assert [r.conv_id for r in out] == [1] * 4 and [r.first_turn for r in out] == [1, 65, 129, 193]
    assert "".join(r.rendered for r in out) == brute_chats(rows)[1]
    assert render_chats(df.limit(0)).collect() == []


def test_many_turns_of_one_number_or_none(spark):
    """Rows without turn, id or both, of one turn number and with long roles, come in parts; equal conversations leave one."""
    random.seed(5)
    rows = [(None, None, "user", f"n{i}") for i in range(300)] + [(1, 7, "user", f"s{i}") for i in range(200)] + [(2, 7, "user", f"s{i}") for i in range(200)]
    rows += [(c, t, "user", f"same {t}") for c in range(10, 40) for t in range(c % 3 + 1)]
    rows += [(50, 1, "r" * n + x, f"{'p' * 70}{y}") for n in (63, 64, 70) for x in ("", "a", "b") for y in "zyx"] + [(51, None, None, None), (51, 1, None, "")]
    random.shuffle(rows)
    out = render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    parts = defaultdict(dict)
    for r in out:
        parts[r.conv_id][r.first_turn] = r.rendered
    assert {c: "".join(p[k] for k in sorted(p)) for c, p in parts.items()} == brute_chats(rows)
    assert all(sorted(p) == list(range(1, 64 * len(p), 64)) for p in parts.values())
    assert max(r.rendered.count("<|end|>") for r in out) == 64


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_chats_match_sql(spark, size):
    path = f"/root/testdata/{size}/conversations.parquet"
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{path}'")
    assert sorted(map(tuple, render_chats(spark.read.parquet(path)).collect())) == sorted(c.sql(ORACLE).fetchall())
