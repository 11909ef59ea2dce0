"""Changed ranges between two texts, by the longest common subsequence of their tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = regex.compile(r"\s+|[\p{L}\p{N}_]+|.", regex.S)
MOST_CELLS = 250_000


def _runs(spans: list[tuple[int, int]], changed: np.ndarray) -> list[list[int]]:
    """[start, end) of each maximal run of changed tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], changed.astype(np.int8), [0]])))
    return [[spans[a][0], spans[b - 1][1]] for a, b in edge.reshape(-1, 2)]


def changed_ranges(a: str | None, b: str | None) -> tuple[list[list[int]], list[list[int]]]:
    """Ranges of `a` and of `b` that the other lacks; two very long texts are compared by common prefix and suffix."""
    a, b = a or "", b or ""
    xs, ys = [[(m.start(), m.end()) for m in TOKEN.finditer(t)] for t in (a, b)]
    if len(xs) * len(ys) > MOST_CELLS:
        p = next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))
        most = min(len(a), len(b)) - p
        s = next((i for i in range(most) if a[-1 - i] != b[-1 - i]), most)
        return tuple([[p, len(t) - s]] if p < len(t) - s else [] for t in (a, b))
    ids = {t: i for i, t in enumerate(dict.fromkeys([a[i:j] for i, j in xs] + [b[i:j] for i, j in ys]))}
    u, v = np.array([ids[a[i:j]] for i, j in xs], int), np.array([ids[b[i:j]] for i, j in ys], int)
    n, m = len(u), len(v)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        hit = np.where(v == u[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(hit[::-1])[::-1] if m else 0
    keep_a, keep_b = np.zeros(n, bool), np.zeros(m, bool)
    i = j = 0
    while i < n and j < m:
        if u[i] == v[j]:
            keep_a[i] = keep_b[j] = True
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return _runs(xs, ~keep_a), _runs(ys, ~keep_b)


def changed(a: Column, b: Column) -> Column:
    """struct(old, new): the changed ranges of each."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        got = [changed_ranges(i, j) for i, j in zip(x, y)]
        return pd.DataFrame({"old": [g[0] for g in got], "new": [g[1] for g in got]})

    return F.pandas_udf(run, "old array<array<int>>, new array<array<int>>")(a, b)
