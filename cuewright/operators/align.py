"""Forced alignment behind the acoustic model: best paths through frame probabilities, and word times.

Emissions are rows (film, seg, frame, logp array). A segment is one group; its paths are computed in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME_MS = 20
LEAST_SCORE = -5.0


def least_frames(tokens: list[int]) -> int:
    """Frames that a path needs: one a token, and a blank between equal neighbours."""
    return len(tokens) + sum(a == b for a, b in zip(tokens, tokens[1:]))


def best_path(logp: np.ndarray, tokens: list[int], blank: int = 0) -> np.ndarray | None:
    """The token index of each frame (-1 for blank) on the most probable path, or None if there is none.

    States alternate blank and token. A state is reached by staying, or, only where strictly better, from
    the state before, or past a blank between two different tokens.
    """
    frames, n = len(logp), len(tokens)
    if frames < least_frames(tokens) or not frames:
        return None
    states = np.full(2 * n + 1, blank)
    states[1::2] = tokens
    may_skip = np.zeros(len(states), bool)
    may_skip[3::2] = states[3::2] != states[1:-2:2]
    score = np.full(len(states), -np.inf)
    score[:2] = logp[0, states[:2]]
    came = np.zeros((frames, len(states)), np.int8)
    for t in range(1, frames):
        best = score.copy()
        step = np.r_[-np.inf, score[:-1]]
        better = step > best
        best[better], came[t, better] = step[better], 1
        jump = np.where(may_skip, np.r_[-np.inf, -np.inf, score[:-2]][: len(states)], -np.inf)
        better = jump > best
        best[better], came[t, better] = jump[better], 2
        score = best + logp[t, states]
    state = len(states) - 1
    if n and score[-2] > score[-1]:
        state -= 1
    if score[state] == -np.inf:
        return None
    path = np.full(frames, -1)
    for t in range(frames - 1, -1, -1):
        path[t] = (state - 1) // 2 if state % 2 else -1
        state -= came[t, state]
    return path


def align_segment(logp: np.ndarray, words: list[list[int]], blank: int = 0, star: bool = True, least: float = LEAST_SCORE) -> tuple[list[tuple[int, int] | None], float | None, str | None]:
    """First and last frame of each word (None where it has no token), the score, and why it failed.

    With ``star`` a wildcard of probability one stands at both ends and takes up what is not said.
    """
    flat = [t for w in words for t in w]
    nothing: list[tuple[int, int] | None] = [None] * len(words)
    if not flat:
        return nothing, None, "no_tokens"
    own, shift = list(flat), 0
    if star:
        logp = np.hstack([logp, np.zeros((len(logp), 1))])
        own, shift = [logp.shape[1] - 1, *flat, logp.shape[1] - 1], 1
    path = best_path(logp, own, blank)
    if path is None:
        return nothing, None, "too_short"
    means, spans = [], []
    for i, token in enumerate(flat):
        at = np.flatnonzero(path == i + shift)
        spans.append((int(at[0]), int(at[-1])))
        means.append(float(logp[at, token].mean()))
    score = float(np.mean(means))
    if score < least:
        return nothing, score, "low_score"
    out, k = [], 0
    for w in words:
        out.append((spans[k][0], spans[k + len(w) - 1][1]) if w else None)
        k += len(w)
    return out, score, None


def align_segments(emissions: DataFrame, words: DataFrame, blank: int = 0, star: bool = True, least: float = LEAST_SCORE) -> DataFrame:
    """(film, seg, idx, first, last, score, reason): words are rows (film, seg, idx, tokens array)."""

    def run(key: tuple, frames: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        logp = np.array(frames.sort_values("frame")["logp"].to_list(), float) if len(frames) else np.zeros((0, 1))
        spans, score, why = align_segment(logp, [list(t) for t in own["tokens"]], blank, star, least)
        return pd.DataFrame({
            "film": key[0], "seg": key[1], "idx": own["idx"],
            "first": pd.array([s[0] if s else None for s in spans], "Int64"), "last": pd.array([s[1] if s else None for s in spans], "Int64"),
            "score": score, "reason": why,
        })

    kinds = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in ("film", "seg", "idx"))
    # Aliases give both sides columns of their own where they come from one table.
    left = emissions.select(*(F.col(c).alias(c) for c in ("film", "seg", "frame", "logp"))).groupBy("film", "seg")
    right = words.select(*(F.col(c).alias(c) for c in ("film", "seg", "idx", "tokens"))).groupBy("film", "seg")
    return left.cogroup(right).applyInPandas(run, f"{kinds}, first bigint, last bigint, score double, reason string")


def span_times(spans: DataFrame, frame_ms: int = FRAME_MS) -> DataFrame:
    """start_ms and end_ms of frames (first, last) in a window (w_lo, w_hi); null where a word was not placed."""
    return spans.withColumns({"start_ms": F.col("w_lo") + F.col("first") * frame_ms, "end_ms": F.least(F.col("w_lo") + (F.col("last") + 1) * frame_ms, F.col("w_hi"))})


def character_tokens(word: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz'", first: int = 1) -> Column:
    """A word's characters as ids; those outside the alphabet are left out."""
    ids = F.create_map(*(x for i, c in enumerate(alphabet) for x in (F.lit(c), F.lit(first + i))))
    return F.array_compact(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.try_element_at(ids, c)))


def alignment_stats(spans: DataFrame) -> DataFrame:
    """(film, aligned, fallback, mean_score) over segments."""
    segments = spans.groupBy("film", "seg").agg(F.first("score").alias("score"), F.first("reason").alias("reason"))
    return segments.groupBy("film").agg(F.count_if(F.col("reason").isNull()).alias("aligned"), F.count_if(F.col("reason").isNotNull()).alias("fallback"), F.avg(F.when(F.col("reason").isNull(), F.col("score"))).alias("mean_score"))
