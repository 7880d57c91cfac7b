"""Hand-made cases and plain counterparts of the operators."""

import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.functions import timecode as C
from cuewright.functions.sound import fold_for_alignment, metaphone, sound_key
from cuewright.operators import align, audio, context, correct, cues, evaluate, ledger, quality, sequence, shots, speech
from cuewright.rules import DEFAULT_RULES, CueRules
from cuewright.sources import listing, srt


def cue_table(spark, rows, text="x"):
    rows = [(0, i, int(r[0] * 1000), int(r[1] * 1000), r[2] if len(r) > 2 else text) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "film long, cue_idx int, start_ms long, end_ms long, text string")


def values(spark, items, f):
    return [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").orderBy("i").select(f(F.col("x")).alias("v")).collect()]


def test_quality_counters(spark):
    gaps = quality.score(cue_table(spark, [(0, 2), (2, 4), (4.083, 6), (6.05, 8), (7.5, 9)])).first()
    assert (gaps.touching_or_overlap, gaps.overlap) == (3, 1)
    speed = quality.score(cue_table(spark, [(0, 2), (3, 4.5), (6, 9)], "x" * 36)).first()
    assert (speed.cps_over_target, speed.cps_over_max) == (2, 1)
    whole = quality.score(cue_table(spark, [(0.5, 1.5), (2, 4.001), (5, 6.5), (7.1, 10.1)])).first()
    assert whole.whole_second_durations == 3
    same = quality.score(cue_table(spark, [(0, 1, "Hello, you."), (2, 3, "hello you"), (4, 5, "other"), (6, 7, "Hello you")])).first()
    assert same.consecutive_duplicate_text == 1
    rate = quality.score(cue_table(spark, [(0, 0.5, "a"), (1, 2, "b"), (2.01, 4, "c"), (5, 7, "d")])).first()
    assert rate.violations_per_100 == 50.0
    assert quality.score(cue_table(spark, []).limit(0)).collect() == []


def test_text_predicates(spark):
    assert values(spark, ["PIANO PLAYS", "EXPLOSION", "STOP IT!", "NO!", "FBI!", "OK. OK.", "Stop"], T.is_caps_line) == [True, True, True, False, False, False, False]
    assert values(spark, ["[MUSIC]", "(GUNSHOT)", "♪♪", " ", "(a) b", "♪ la ♪"], T.is_descriptor) == [True, True, True, True, False, False]
    assert values(spark, ["Mr.", "end.", 'so."', "what?", "and,", "etc.", "♪", "word"], T.is_sentence_end) == [False, True, True, True, False, False, True, False]
    assert values(spark, ["No, no!", "Été", "it's", "--"], T.word_key) == ["nono", "été", "it's", ""]
    assert values(spark, ["- MAN: -Hey", "[door] Hi (low)", "♪ la\nMRS. FIGG: 1,000 cats", "Look: here"], T.spoken_text) == ["Hey", "Hi", "1000 cats", "Look: here"]
    assert values(spark, ["Don't", "21", "1995", "Um", "OK", "1000000", "0", "115"], lambda c: F.array_join(T.comparison_words(c), " ")) == ["dont", "twenty one", "one thousand nine hundred ninety five", "", "okay", "1000000", "zero", "one hundred fifteen"]
    assert values(spark, ["well-known it's naïve_x"], T.surface_words) == [["well", "known", "it's", "naïve", "x"]]
    assert values(spark, ["/a/De/x.mkv", "/a/b1.MKV", "/a/bx.mkv"], lambda c: listing.is_ignored(c, ["*/de/*", "*/b[0-9].mkv"])) == [True, True, False]
    assert values(spark, ["en", "xx"], T.language_code) == ["eng", "xx"]


def test_sound_keys(spark):
    words = {"Thompson": "0MPSN", "Dumbledore": "TMBLTR", "Austin": "ASTN", "": "", "Knight": "NFT", "Xavier": "SFR", "Which": "WX", "Science": "SNS", "Judge": "JJ"}
    for word in ("Thompson", "Dumbledore", "Austin", ""):
        assert sound_key(word) == words[word]
    assert values(spark, ["Patrona", None], metaphone) == [sound_key("Patrona"), None]
    assert [fold_for_alignment(w) for w in ("Hello,", "'cause", "Café", "4x4", "Don’t")] == ["hello", "cause", "cafe", "x", "don't"]


def test_timecodes(spark):
    rows = spark.createDataFrame([(0,), (3_723_004,), (-5,), (360_000_999,)], "ms long").select(C.format_ms(F.col("ms")).alias("c"))
    assert [r.c for r in rows.collect()] == ["00:00:00,000", "01:02:03,004", "00:00:00,000", "100:00:00,999"]
    assert values(spark, ["00:00:01,5", "01:00:00.25", "junk"], C.parse_ms) == [1500, 3_600_250, None]
    assert values(spark, ["24000/1001", "0/0", "25", ""], lambda c: F.round(C.frame_rate(c, F.lit("")), 3)) == [23.976, 24.0, 25.0, 24.0]
    assert values(spark, ["7035.754667", None], lambda c: F.round(C.duration_seconds(c, F.lit("02:07:25.696")), 3)) == [7035.755, 7645.696]
    inside = lambda m, a, b: F.col("x").isNotNull() & C.in_window(F.lit(m), C.minute_of_day(F.lit(a)), C.minute_of_day(F.lit(b)))
    got = spark.createDataFrame([("x",)], "x string").select(inside(60, "22:00", "6:30"), inside(700, "22:00", "6:30"), inside(540, "9:00", "17:00"), inside(1020, "9:00", "17:00")).first()
    assert list(got) == [True, False, True, False]


def test_subtitles_round_trip(spark, tmp_path):
    body = "﻿1\r\n00:00:05,000 --> 00:00:06.5\r\n<i>Second</i>\r\nline\r\n\r\n00:00:01,25 --> 00:00:02,000\r\nFirst\r\n\r\n3\r\n00:00:07,000 --> 00:00:08,000\r\n \r\n"
    found = [tuple(r)[1:] for r in srt.parse_srt(spark.createDataFrame([("f", body)], "film string, body string")).orderBy("cue_idx").collect()]
    assert found == [(0, 1250, 2000, "First"), (1, 5000, 6500, "Second\nline")]
    (tmp_path / "a.srt").write_bytes(body.encode())
    (tmp_path / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\nd\xe9j\xe0\n".encode("cp1252"))
    spark.dataSource.register(srt.SrtSource)
    for df in (srt.load_srt(spark, str(tmp_path)), spark.read.format("srt").load(str(tmp_path))):
        assert sorted((r.cue_idx, r.start_ms, r.text) for r in df.collect()) == [(0, 1000, "déjà"), (0, 1250, "First"), (1, 5000, "Second\nline")]
    odd = b"7\n0:0:1,5 --> 0:0:2.25 X1:2\n{\\an8}<b> caf\xe9 \x81</b>\n\n \n9\n00:00:03,000 --> 00:00:04,000\n<i></i>\n"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c d.srt").write_bytes(odd)
    read = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert read(spark.read.format("srt").load(str(tmp_path))) == read(srt.load_srt(spark, str(tmp_path))) and (0, 1500, 2250, "café \x81") in read(spark.read.format("srt").load(f"file://{tmp_path}"))
    part, target = tmp_path / "x.part", tmp_path / "x.srt"
    part.write_text("new")
    assert srt.place_output(str(part), str(target), False) and target.read_text() == "new"
    part.write_text("newer")
    assert not srt.place_output(str(part), str(target), False) and target.read_text() == "new"
    assert srt.place_output(str(part), str(target), True) and target.read_text() == "newer"


def test_cut_clusters_and_log(spark):
    cand = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "film int, t double, score double")
    pick = lambda rows: [r.t for r in sequence.cut_clusters(cand(rows)).orderBy("t").collect()]
    assert pick([(10.0, 9.8), (10.04, 6.7), (10.2, 6.2), (10.5, 7.0), (20.0, 12.0)]) == [20.0]
    assert pick([(2.84, 15.35), (2.88, 5.38)]) == [2.84]
    log = spark.createDataFrame([(1, "[scdet] lavfi.scd.score: 15.449, lavfi.scd.time: 91.306"), (1, "frame= 3")], "film int, value string")
    assert [(r.t, r.score) for r in shots.parse_cut_log(log).collect()] == [(91.306, 15.449)]


def snap_by_hand(rows, cut_times, fps=24.0):
    """Two passes over lists, in milliseconds."""
    frame, rules = 1000 / fps, DEFAULT_RULES
    win, late, least = round(12 * frame), round(4 * frame), 83
    gap = max(round(2 * frame), least)
    start, end = [r[0] for r in rows], [r[1] for r in rows]

    def ok(k, s, e):
        was = (end[k] - start[k]) / 1000
        old = rows[k][2] / was if was > 0 else float("inf")
        length = (e - s) / 1000
        cps = rows[k][2] / length if length > 0 else float("inf")
        if not rules.min_duration <= length <= rules.max_duration or (cps > rules.max_cps and cps > old):
            return False
        return (k == 0 or s - end[k - 1] >= least) and (k + 1 == len(rows) or start[k + 1] - e >= least)

    def nearest(lo, hi, target):
        near = [c for c in cut_times if lo <= c <= hi]
        return min(near, key=lambda c: (abs(c - target), c)) if near else None

    for k in range(len(rows)):
        c = nearest(start[k] - win, start[k] + late, start[k])
        if c is not None and c != start[k] and ok(k, c, end[k]):
            start[k] = c
    for k in range(len(rows)):
        c = nearest(end[k] + gap - win, end[k] + gap + win, end[k] + gap)
        if c is not None and c - gap != end[k] and ok(k, start[k], c - gap):
            end[k] = c - gap
    return list(zip(start, end))


@pytest.mark.parametrize("broken", [False, True])
def test_snapping_equals_two_passes(spark, broken):
    random.seed(7 + broken)
    films, cuts, expected = [], [], {}
    for film in range(12):
        at, rows = 1000, []
        for _ in range(20):
            length, chars = random.randint(900, 4000), random.randint(5, 40)
            rows.append((at, at + length, chars))
            at += length + (random.randint(-200, 700) if broken else random.randint(83, 900))
        times = sorted({random.randint(0, at) for _ in range(25)})
        films += [(film, i, s, e, "x" * n) for i, (s, e, n) in enumerate(rows)]
        cuts += [(film, c) for c in times]
        expected[film] = snap_by_hand(rows, times)
    out = shots.snap_cues(spark.createDataFrame(films, "film int, cue_idx int, start_ms long, end_ms long, text string"), spark.createDataFrame(cuts, "film int, cut_ms long")).collect()
    for film, own in expected.items():
        assert [(r.new_start_ms, r.new_end_ms) for r in sorted(out, key=lambda r: r.cue_idx) if r.film == film] == own


def test_alignment_path_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for tokens in ([1, 2, 1], [1, 1], [3], [2, 3]):
        logp = np.log(rng.dirichlet(np.ones(4), 6))
        path = align.best_path(logp, tokens)

        def collapsed(p):
            out = [k for k, _ in itertools.groupby(p)]
            return [x for x in out if x]

        best = max((p for p in itertools.product(range(4), repeat=6) if collapsed(p) == tokens), key=lambda p: sum(logp[t, x] for t, x in enumerate(p)))
        own = [tokens[i] if i >= 0 else 0 for i in path]
        assert sum(logp[t, x] for t, x in enumerate(own)) == pytest.approx(sum(logp[t, x] for t, x in enumerate(best)))
    sure = lambda ids: np.where(np.eye(4)[ids] > 0, -0.01, -5.0)
    assert align.best_path(sure([0, 0, 1, 1, 0, 2, 0, 3, 3, 0]), [1, 2, 3]).tolist() == [-1, -1, 0, 0, -1, 1, -1, 2, 2, -1]
    assert align.best_path(sure([1, 0, 1]), [1, 1]).tolist() == [0, -1, 1] and align.best_path(sure([1, 1]), [1, 1]) is None
    assert align.align_segment(sure([0, 1]), [[], []])[2] == "no_tokens" and align.align_segment(sure([0]), [[1, 2]])[2] == "too_short"
    assert align.align_segment(np.full((6, 4), -9.0), [[1]])[2] == "low_score"


def test_words_keep_their_order(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1200), (0, 1, 1000, 1100), (0, 2, 1500, 2000)], "film int, idx int, start_ms long, end_ms long")
    assert [(r.start_ms, r.end_ms) for r in sequence.enforce_order(rows).orderBy("idx").collect()] == [(0, 1200), (1200, 1200), (1500, 2000)]


def test_audio(spark):
    rate, n = 100, 30_000
    loud = np.ones(n)
    loud[11_000:11_100] = loud[21_500:21_600] = 0
    ends = audio.chunk_ends(loud, rate, 100.0)
    assert len(ends) == 3 and 11_000 <= ends[0] <= 11_100 and 21_500 <= ends[1] <= 21_600 and ends[2] == n
    assert audio.chunk_ends(loud[:100], rate, 100.0) == [100]
    frames = spark.createDataFrame([(16_000,), (400,), (399,)], "n long").select(audio.conv_frames(F.col("n")).alias("f"))
    assert [r.f for r in frames.collect()] == [49, 1, 0]
    items = spark.createDataFrame([(0, i, x) for i, x in enumerate([10, 50, 20, 45, 200])], "film int, idx long, length long")
    got = audio.batches(items, 100).orderBy("batch", "idx").collect()
    assert [r.idx for r in got if r.batch == 0] == [4]


def word_stream(seed, n=300):
    random.seed(seed)
    at, rows = 500, []
    for i in range(n):
        text = random.choice(["the", "and", "house", "river,", "end.", "what?", "Mr.", "a", "walking", "because", "of", "extraordinary"])
        length = random.randint(80, 600)
        rows.append((0, i, at, at + length, " " + text, 0.9))
        at += length + random.choice([0, 0, 20, 50, 200, 900, 3000] if i % 9 == 0 else [0, 20, 40])
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 7, 11])
def test_composed_cues_hold_the_rules(spark, seed):
    rules = DEFAULT_RULES if seed != 11 else CueRules(max_line_chars=32, max_duration=5.0)
    rows = word_stream(seed)
    out = cues.compose(spark.createDataFrame(rows, "film int, idx int, start_ms long, end_ms long, text string, prob double"), rules).orderBy("cue_idx").collect()
    assert " ".join(" ".join(r.text.split()) for r in out).split() == [w for w in " ".join(r[4].strip() for r in rows).split()]
    for a, b in zip(out, out[1:]):
        assert b.start_ms - a.end_ms >= 83
    for r in out:
        assert 0 <= r.start_ms < r.end_ms and (r.end_ms - r.start_ms) / 1000 <= rules.max_duration
        assert len(r.text.split("\n")) <= rules.max_lines and all(len(x) <= rules.max_line_chars or " " not in x for x in r.text.split("\n"))


def test_fragments_glue_together(spark):
    pieces = [" I", " don", "'t", " know", "...", " Harry", "'s", " wand", "?", " Mr.", " Weasley", ",", " well", "-known", " (", "ahem", ")"]
    rows = [(0, i, i * 300, i * 300 + 250, p, 0.9) for i, p in enumerate(pieces)]
    out = cues.glue_words(spark.createDataFrame(rows, "film int, idx int, start_ms long, end_ms long, text string, prob double")).orderBy("idx").collect()
    assert " ".join(r.text for r in out) == "I don't know... Harry's wand? Mr. Weasley, well-known (ahem)"


def test_loops_and_repeats(spark):
    rows = [(0, i, i * 300, i * 300 + 250, w, 0.9) for i, w in enumerate(["no"] * 7 + ["stop"])]
    out = sequence.collapse_loops(spark.createDataFrame(rows, "film int, idx int, start_ms long, end_ms long, text string, prob double")).orderBy("idx").collect()
    assert [r.text for r in out] == ["no", "no", "no", "stop"]
    thanks = "Thank you."
    assert len(cues.drop_repeats([(0, 1000, thanks), (1600, 2600, thanks)])) == 1 and len(cues.drop_repeats([(0, 1000, thanks), (4000, 5000, thanks)])) == 2


def test_flags_and_edits(spark):
    said = ["He", "saw", "Patrona", "there.", "Then", "Fig", "came", "no", "no", "no"]
    words = spark.createDataFrame([(0, i, i * 300, i * 300 + 250, w, 0.3 if i == 1 else 0.95) for i, w in enumerate(said)], "film int, idx int, start_ms long, end_ms long, text string, prob double")
    flagged = lambda **k: {r.idx for r in correct.flag_words(words, **k).where("flagged").collect()}
    assert flagged() == {1, 2, 5, 7, 8, 9}
    assert flagged(names=spark.createDataFrame([(0, "Fig Tree")], "film int, name string")) == {1, 2, 7, 8, 9}
    edits = [("Patrona", "Patronum"), ("dead", "Dementors"), ("fig", "Fig"), ("a", "one two three four"), ("a", "b\nc"), ("a", "x$y"), ("word", ""), ("a", None), ("night", "knight")]
    names = spark.createDataFrame([(0, "Dementors"), (0, "Patronum")], "film int, name string")
    judged = correct.judge_edits(spark.createDataFrame([(0, i, *e) for i, e in enumerate(edits)], "film int, k int, original string, text string"), names).orderBy("k").collect()
    assert [r.verdict for r in judged] == ["context name", "context name but not close", "casing/punctuation only", "4 words", "newline", "odd characters", "empty", "not a string", "close spelling"]
    rows = [(0, 0, p, i, 3, True, "close spelling") for p, i in enumerate([1, 9, 0, 1, 2, -1, 3])]
    out = correct.admit_edits(spark.createDataFrame(rows, "film int, window int, pos int, i long, n_flags int, ok boolean, verdict string"), 2).orderBy("pos").collect()
    assert [r.reason for r in out] == [None, "index not flagged", "index not flagged", "duplicate index", None, "index not flagged", "too many edits"]
    timed = correct.apply_edits(spark.createDataFrame([(0, 0, 2000, 3000, " Fig,", 0.4)], "film int, idx int, start_ms long, end_ms long, text string, prob double"), spark.createDataFrame([(0, 0, "arabella figgins")], "film int, idx int, rep string")).orderBy("part").collect()
    assert [(r.text, r.start_ms, r.end_ms, r.prob) for r in timed] == [(" Arabella", 2000, 2533, 1.0), (" figgins,", 2533, 3000, 1.0)]
    replies = spark.createDataFrame([(0, 0, '{"edits":[{"i":1,"text":"a b"},{"i":2}]}'), (0, 1, "oops")], "film int, window int, content string")
    assert [(r.i, r.text) for r in correct.parse_edits(replies).orderBy("pos").collect()] == [(1, "a b"), (2, None)]


def test_names_learned_at_the_very_mean(spark):
    """0.85 and 0.95 make 0.9 in whatever order; a probability that is missing counts as 0."""
    probs = {"At": [0.85, 0.95], "Turned": [0.95, 0.85], "Many": [0.87, 0.9, 0.93] * 7, "Under": [0.9, 0.899999999999], "Over": [0.9, 0.9000000001], "Once": [0.99], "Missing": [0.95, 0.95, None], "Odd": [0.99, float("nan")], "low": [0.95, 0.95]}
    rows = [(0, i, w, p) for i, (w, p) in enumerate((w, p) for w, all_of in probs.items() for p in all_of)]
    words = spark.createDataFrame(rows, "film int, idx int, text string, prob double")
    for parts in (1, 5):
        assert {r.key for r in correct.learned_names(words.repartition(parts, "idx")).collect()} == {"at", "turned", "many", "over"}


def test_windows_stay_in_budget():
    lines = [(i * 5, i * 5 + 5) for i in range(100)]
    spans = correct.place_windows(lines, [6] * 500, [50, 120, 200, 300, 420], budget=400)
    assert all(sum([38] * (min(100, b + 2) - max(0, a - 2))) <= 400 or b - a == 1 for a, b in spans)
    assert {50 // 5, 120 // 5, 200 // 5, 300 // 5, 420 // 5} <= {k for a, b in spans for k in range(a, b)}


def test_requests(spark):
    """Numbered lines, context, marks, the reply's schema, and the last request of a film."""
    said = [f"Line {i} has (word)." for i in range(40)]
    rows = [(f, 4 * i + j, 1000 * i + 200 * j, 1000 * i + 200 * j + 100, x, f == 0 and (i, j) in ((5, 3), (6, 0), (35, 2))) for f in (0, 1) for i, t in enumerate(said) for j, x in enumerate(t.split())]
    words = spark.createDataFrame(rows, "film int, idx int, start_ms long, end_ms long, text string, flagged boolean")
    media = spark.createDataFrame([(0, "Show", 1999, 2, 3, "Pilot", ["Ann Lee"] * 100, ["Oslo"])], "film int, title string, year int, season int, episode int, episode_title string, names array<string>, terms array<string>")
    windows = correct.plan_windows(words)
    found = [json.loads(r.body) for r in correct.requests(windows, words, "m", media).orderBy("film", "window").collect()]
    assert len(found) == windows.count() == 2
    first, last = found
    prompt = first["messages"][1]["content"].split("\n")
    assert prompt[0] == 'Title: Show (1999), S02E03 "Pilot"' and prompt[2:4] == ["Terms: Oslo", ""]
    assert len(prompt[1]) <= 7 + 700 and set(prompt[1][7:].split(", ")) == {"Ann Lee"}
    body = prompt[5:-2]
    numbered = [x for x in body if not x.startswith("  (")]
    assert [int(x[:3]) for x in numbered] == list(range(1, len(numbered) + 1)) and len(numbered) >= 12
    assert any(x.endswith("Line 5 has ([1:word]).") for x in body) and any("[2:Line] 6 has (word)." in x for x in body)
    assert all("[" not in x for x in body if x.startswith("  (")) and body[-1].startswith("  (after) Line ") and body[-2].startswith("  (after) Line ")
    assert first["format"]["properties"]["edits"]["maxItems"] == 2 == first["format"]["properties"]["edits"]["items"]["properties"]["i"]["maximum"]
    assert first["options"] == {"temperature": 0, "num_predict": 82} and last["options"]["num_predict"] == 57
    assert "keep_alive" not in first and last["keep_alive"] == 0 and first["stream"] is False is first["think"]
    assert last["messages"][1]["content"].split("\n")[5].startswith("  (before) Line ")
    own = spark.createDataFrame([(0, 0, 0, 1, " Har", True), (0, 1, 1, 2, "ry", False), (0, 2, 2, 3, " ran", False)], words.schema)
    bare = json.loads(correct.requests(correct.plan_windows(own), own, "m").first().body)["messages"][1]["content"]
    assert "\n  1  [1:Har]ry ran\n" in bare or "\n  1 [1:Har]ry ran\n" in bare


def test_word_errors_and_offsets(spark):
    one = "one two three four five six seven eight nine ten"
    stream = lambda t: spark.createDataFrame([(0, i, w) for i, w in enumerate(t.split())], "film int, tok_idx int, word string")
    r = evaluate.word_errors(evaluate.alignment(stream(one), stream(one.replace("three", "tree").replace("nine ", "")))).first()
    assert (r.substitutions, r.deletions, r.insertions, r.wer) == (1, 1, 0, 0.2)
    ref = cue_table(spark, [(i * 4, i * 4 + 2, f"word{i} and{i} so{i}") for i in range(90)])
    hyp = ref.select("film", "cue_idx", (F.col("start_ms") + 1500).alias("start_ms"), (F.col("end_ms") + 1500).alias("end_ms"), "text")
    r = evaluate.compare(ref, hyp).first()
    assert r.wer == 0 and abs(r.offset - 1.5) < 1e-6 and r.onset_error < 1e-6 and abs(r.drift) < 1e-6
    slow = ref.select("film", "cue_idx", (F.col("start_ms") * 25 / 23.976).cast("long").alias("start_ms"), (F.col("end_ms") * 25 / 23.976).cast("long").alias("end_ms"), "text")
    assert evaluate.compare(ref, slow).first().drift > 5


def test_paths_and_names(spark):
    paths = ["/m/Some Film (1999) [imdb-1]/Some Film (1999) - 1080p.mkv", "/m/Show (2010)/Season 2/Show - S02E03 - The End.mkv", "/m/The.Great.Film.2004.1080p.WEB-DL.mkv", "/m/Old One (1980)/movie.mkv"]
    found = {r.path: (r.title, r.year, r.season, r.episode, r.episode_title) for r in context.parse_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert [found[p] for p in paths] == [("Some Film", 1999, None, None, ""), ("Show", 2010, 2, 3, "The End"), ("The Great Film", 2004, None, None, ""), ("Old One", 1980, None, None, "")]
    people = [("Actor", "Harry Potter (voice)"), ("Director", "Nobody"), ("Actor", "Himself"), ("GuestStar", "young boy"), ("Actor", "Death Eater #2"), (None, "Vernon / Dudley Dursley")]
    df = spark.createDataFrame([(people, "At Hogwarts young Harry meets Umbridge. Then Harry runs.")], "people array<struct<type string, role string>>, overview string")
    r = df.select(context.character_names(F.col("people")).alias("n"), context.overview_terms(F.col("overview")).alias("t")).first()
    assert r.n == ["Harry Potter", "Vernon", "Dudley Dursley"] and r.t == ["Hogwarts", "Harry", "Umbridge"]
    items = spark.createDataFrame([("a", "Some Film", "/x/other.mkv", 1999), ("b", "Show", "/y/z.mkv", 2010), ("c", "Show", "/y/w.mkv", 2011)], "id string, name string, path string, year int")
    wanted = spark.createDataFrame([("/m/1.mkv", "some film", None), ("/y/z.mkv", "?", None), ("/m/2.mkv", "Show", 2011), ("/m/3.mkv", "Show", None)], "path string, title string, year int")
    assert {r.path: r.id for r in context.pick_items(wanted, items).collect()} == {"/m/1.mkv": "a", "/y/z.mkv": "b", "/m/2.mkv": "c"}
    series = spark.createDataFrame([("s", "/m/Show/")], "id string, path string")
    assert [r.id for r in context.series_of(spark.createDataFrame([("/m/Show/Season 1/a.mkv",), ("/m/Showcase/a.mkv",)], "path string"), series).collect()] == ["s"]


def ledger_by_hand(events):
    state = {}
    for seq, path, op, status, reason, bump in events:
        if op == "record":
            old = state.get(path, {"attempts": 0})
            state[path] = {"status": status, "reason": reason, "attempts": old["attempts"] + bump, "regen": 0, "seq": seq}
        elif op == "forget":
            state.pop(path, None)
        elif path in state:
            state[path]["regen"] += 1
            state[path]["reason"] = reason
    return {p: (s["status"], s["reason"], s["attempts"], s["regen"], s["seq"]) for p, s in state.items()}


def test_ledger_equals_updates_in_place(spark):
    random.seed(5)
    events = [(i, random.randint(0, 9), random.choice(["record", "record", "regen_fail", "forget"]), random.choice(["done", "failed"]), f"r{i}", random.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(events, "seq long, path long, op string, status string, reason string, bump boolean")
    found = {r.path: (r.status, r.reason, r.attempts, r.regen_attempts, r.updated_seq) for r in ledger.current_state(df).collect()}
    assert found == ledger_by_hand(events)
    old = ledger.migrate(df)
    assert {r.pipeline for r in old.collect()} == {0} and "qa_json" in old.columns


def test_segments(spark):
    rows = [("The end.", 0, 1000, 0.4), ("[MUSIC]", 9000, 9500, 0.9), ("STOP IT!", 20_000, 21_000, 0.4), ("thank you", 21_500, 22_000, 0.5), ("Fine then.", 22_100, 23_000, 0.9)]
    df = spark.createDataFrame([(0, i, s, e, t, p) for i, (t, s, e, p) in enumerate(rows)], "film int, seg int, start_ms long, end_ms long, text string, mean_prob double")
    kept, dropped = speech.filter_segments(df)
    assert [r.text for r in kept.orderBy("seg").collect()] == ["thank you", "Fine then."] and dropped.count() == 3
    bare = [("Hello there, all.", 0, 5), ("and so we went home", 5, 10), ("then it was dark", 10, 14), ("Yes.", 14, 16), ("now we have some time", 16, 20)]
    df = spark.createDataFrame([(0, i, s * 1000, e * 1000, t) for i, (t, s, e) in enumerate(bare)], "film int, seg int, start_ms long, end_ms long, text string")
    groups = lambda s: [(r.first_seg, r.last_seg) for r in speech.unpunctuated_groups(df, s).orderBy("first_seg").collect()]
    assert groups(28) == [(1, 2), (4, 4)] and groups(6) == [(1, 1), (2, 2), (4, 4)]


def test_streams(spark, tmp_path):
    from cuewright.streaming import jobs

    rows = [("a", False), ("b", False), ("a", True), ("a", True), ("a", False)]
    for i, r in enumerate(rows):
        pd.DataFrame([r], columns=["path", "force"]).to_parquet(tmp_path / f"{i}.parquet")
    stream = spark.readStream.schema("path string, force boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = jobs.forced_queue(stream).writeStream.format("memory").queryName("forced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("forced").collect())) == [("a", False), ("a", True), ("b", False)]
    timed = stream.select("path", F.lit("scan").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    both = timed.union(timed.withColumn("source", F.lit("hook")))
    once = jobs.queue(both).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp4")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert sorted((r.path, r.source) for r in spark.table("once").collect()) == [("a", "hook"), ("a", "scan"), ("b", "hook"), ("b", "scan")]
    (tmp_path / "timed").mkdir()
    for i, (path, day) in enumerate([("a", 1), ("b", 1), ("a", 2), ("b", 9), ("c", 20), ("a", 20)]):
        pd.DataFrame({"path": [path], "force": [False], "ts": [pd.Timestamp(2024, 1, day, tz="UTC")]}).to_parquet(tmp_path / "timed" / f"{i}.parquet", coerce_timestamps="us")
    timed = spark.readStream.schema("path string, force boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "timed"))
    kept = jobs.forced_queue(timed, keep="10 days").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp5")).trigger(availableNow=True).start()
    assert kept.awaitTermination(120)
    assert sorted(r.path for r in spark.table("kept").collect()) == ["a", "b", "c"]
    brief = jobs.forced_queue(timed, keep="3 days").writeStream.format("memory").queryName("brief").option("checkpointLocation", str(tmp_path / "cp6")).trigger(availableNow=True).start()
    assert brief.awaitTermination(120)
    # When b comes back, the watermark is still behind the requests before it; when a does, it is past a's three days.
    assert sorted(r.path for r in spark.table("brief").collect()) == ["a", "a", "b", "c"]
    done = jobs.run_jobs(stream, lambda d: d.withColumn("status", F.lit("done")), str(tmp_path / "ledger"), str(tmp_path / "cp2"))
    done.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == len(rows) and jobs.progress(done)["rows"] == len(rows)


def test_local_offsets_within_long_runs_of_equal_times(spark):
    import statistics

    rows = [(0, float(t), float(t * 7 % 11)) for t in range(40)] + [(0, 40.0, 100.0 + i * 37 % 150) for i in range(120)] + [(0, 41.0 + t, float(t)) for t in range(40)]
    ranked = sorted((t, d) for _, t, d in rows)
    expected = []
    for t, d in ranked:
        mid = next(i for i, r in enumerate(ranked) if r[0] == t)
        others = [x[1] for x in ranked[max(0, mid - 25) : mid + 26] if x != (t, d)]
        expected.append((0, t, d, d - statistics.median(others)))
    found = sequence.local_offsets(spark.createDataFrame(rows, "film int, t double, d double").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_repair_replaces_what_it_may(spark):
    bare = [("Hello there, all.", 0, 5), ("and so we went home", 5, 10), ("then it was dark", 10, 14), ("Yes.", 14, 16), ("now we have some time", 16, 20), ("Well.", 20, 21), ("one two three four", 21, 25)]
    df = spark.createDataFrame([(0, i, s * 1000, e * 1000, t, 0.5) for i, (t, s, e) in enumerate(bare)], "film int, seg int, start_ms long, end_ms long, text string, mean_prob double")
    groups = speech.unpunctuated_groups(df)
    new = {1: "early. And so we went home. Then it was dark. late", 4: "Something else was said here.", 6: "one two three four"}
    times = {1: [(4000, 4100)] + [(5000 + 800 * i, 5700 + 800 * i) for i in range(9)] + [(14_040, 14_200)], 4: [(16_000 + i, 16_500) for i in range(5)], 6: [(21_000 + i, 21_500) for i in range(4)]}
    rows = [(0, g, i, *times[g][i], w, 0.9) for g, t in new.items() for i, w in enumerate(t.split())]
    fixed, verdicts = speech.repair(df, spark.createDataFrame(rows, "film int, first_seg long, idx int, start_ms long, end_ms long, text string, prob double"), groups)
    assert {(r.first_seg, r.reason) for r in verdicts.collect()} == {(1, None), (4, "different words"), (6, "still unpunctuated")}
    out = fixed.orderBy("seg").collect()
    assert [r.seg for r in out] == [0, 1, 2, 3, 4, 5] and out[1].text == "And so we went home. Then it was dark." and (out[1].start_ms, out[1].end_ms) == (5000, 12_100)
    nothing = speech.repair(df, spark.createDataFrame([], "film int, first_seg long, idx int, start_ms long, end_ms long, text string, prob double"), groups)
    assert {r.reason for r in nothing[1].collect()} == {"empty"} and nothing[0].count() == df.count()


def test_episodes_casts_and_chunks(spark):
    wanted = spark.createDataFrame([("/a.mkv", "s", 1, 2), ("/b.mkv", "s", 1, 3), ("/c.mkv", "s", 9, 9)], "path string, series string, season int, episode int")
    items = spark.createDataFrame([("s", "/a.mkv", 5, 5, "by path"), ("s", "/x.mkv", 1, 2, "no"), ("s", "/y.mkv", 1, 3, "by number")], "series string, path string, season int, number int, id string")
    assert {r.path: r.id for r in context.episode_of(wanted, items).collect()} == {"/a.mkv": "by path", "/b.mkv": "by number", "/c.mkv": None}
    df = spark.createDataFrame([([("GuestStar", "Zoe Ray")], [("Actor", "Adam Fox"), ("Actor", "Zoe Ray")])], "g array<struct<type string, role string>>, r array<struct<type string, role string>>")
    assert df.select(context.cast_of(F.col("g"), F.col("r")).alias("n")).first().n == ["Zoe Ray", "Adam Fox"]
    segments = spark.createDataFrame([(0, 0, 0, 100, 900, None), (0, 1, 0, 0, 500, "de"), (0, 1, 1, 600, 700, "en")], "film int, chunk int, seg int, start_ms long, end_ms long, language string")
    chunks = spark.createDataFrame([(0, 0, 0, 32_000), (0, 1, 32_000, 64_000)], "film int, chunk int, start long, end long")
    got = audio.on_film_clock(segments, chunks).orderBy("seg").collect()
    assert [(r.seg, r.start_ms, r.end_ms, r.language) for r in got] == [(0, 100, 900, "de"), (1, 2000, 2500, "de"), (2, 2600, 2700, "de")]
    levels = spark.createDataFrame([(True, -60.0), (True, -20.0), (False, -90.0), (True, None)], "c boolean, d double")
    assert [r.x for r in levels.select(audio.needs_whole_mix(F.col("c"), F.col("d")).alias("x")).collect()] == [True, False, False, True]
    spans = sequence.core_spans(segments.select("film", F.col("chunk").alias("seg"), "start_ms", "end_ms").limit(1), spark.createDataFrame([(0, 0, 50, 950)], "film int, seg int, start_ms long, end_ms long")).first()
    assert (spans.lo, spans.hi) == (50, 950)
    streams = spark.createDataFrame([([("audio", False, 1), ("video", True, 2), ("video", None, 3)], "x", "1.5")], "s array<struct<codec_type string, attached_pic boolean, n int>>, bad string, good string")
    r = streams.select(shots.video_stream(F.col("s"))["n"].alias("n"), shots.seconds_or_zero(F.col("bad")).alias("b"), shots.seconds_or_zero(F.col("good")).alias("g")).first()
    assert (r.n, r.b, r.g) == (3, 0.0, 1.5)


def test_outputs_that_are_replaced(spark):
    state = spark.createDataFrame([("/v1", 5, 1.0, "done", 1, 0, "/v1.srt", 9, 2.0), ("/v2", 5, 1.0, "done", 1, 0, "/v2.srt", 9, 2.0), ("/v3", 5, 1.0, "done", 1, 0, "/v3.srt", 9, 2.0)], "path string, size long, mtime double, status string, pipeline int, regen_attempts int, subtitle string, sub_size long, sub_mtime double")
    videos = spark.createDataFrame([("/v1", 5, 1.5), ("/v2", 5, 1.0), ("/v3", 6, 1.0)], "path string, size long, mtime double")
    subs = spark.createDataFrame([(f"/v{i}.srt", 9, 2.0) for i in (1, 2, 3)], "path string, size long, mtime double")
    beside = spark.createDataFrame([("/v1", "/v1.srt"), ("/v2", "/v2.srt"), ("/v2", "/v2.de.srt")], "path string, sidecar string")
    old = ledger.outdated_own(state, videos, subs, beside, 4)
    assert [r.path for r in old.collect()] == ["/v1"]
    results = spark.createDataFrame([("/v1", "/new.srt", "/v1.srt"), ("/v2", "/v2.srt", "/v2.srt"), ("/v3", "/n.srt", None)], "path string, subtitle string, replaces string")
    assert [tuple(r) for r in ledger.superseded(results, old).collect()] == [("/v1", "/v1.srt")]
    assert tuple(ledger.scan_summary(spark.createDataFrame([("queued",), ("queued",), ("regen",)], "action string")).first()) == (2, 0, 1)
    events = spark.createDataFrame([("done", 60.5, True), ("failed", None, False)], "status string, media_s double, align_error boolean")
    assert [r.line for r in ledger.exposition(ledger.counters(events)).collect()] == ["cuewright_processed 1", "cuewright_failed 1", "cuewright_media_seconds 60.5", "cuewright_align_errors 1"]
    assert ledger.quality_json(spark.createDataFrame([(0, 2, 1)], "film int, b int, a int")).first().qa_json == '{"a":1,"b":2}'
