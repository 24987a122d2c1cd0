"""Rules whose next step depends on the step before.

`in_order` streams sorted rows through a rule with a small state, so a task holds one batch
however long a key is; points go this way. `per_small_key` holds the rows of one key, and
`per_key` gives them to pandas: both are for runs (islands) and other short sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chainage.sources.shared import spread


def per_key(df: DataFrame, keys: list[str], order: list[str], schema: str, rule: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Applies a rule to each key's rows in order."""
    return df.groupBy(*keys).applyInPandas(lambda p: rule(p.sort_values(order, kind="stable").reset_index(drop=True)), schema)


def per_small_key(df: DataFrame, keys: list[str], order: list[str], schema: str, rule: Callable[[dict[str, np.ndarray]], list[tuple]]) -> DataFrame:
    """A rule from one key's columns to rows, for many small keys: sorted partitions are streamed and cut where the key changes.

    A task holds one batch and the rows of one key.
    """
    return per_small_keys(df, keys, order, schema, lambda parts: [r for c in parts for r in rule(c)], 1)


#: Rows of whole keys, about, that a rule on many keys gets at a time.
TOGETHER = 100_000


def per_small_keys(df: DataFrame, keys: list[str], order: list[str], schema: str, rule: Callable[[list[dict[str, np.ndarray]]], list[tuple]], rows: int = TOGETHER, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As `per_small_key`, with a rule from the columns of several whole keys of about so many rows together to rows.

    then: makes the rows that the rule gets of the sorted ones, row by row in their order.
    """

    def run(frames):
        names = [f.split()[0] for f in schema.split(", ")]
        held: list[pd.DataFrame] = []
        n, need = 0, rows

        def apply(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            columns = {c: frame[c].to_numpy() for c in frame.columns}
            return pd.DataFrame(rule([{c: x[a:b] for c, x in columns.items()} for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]), columns=names)

        def cut() -> tuple[pd.DataFrame, np.ndarray]:
            frame = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            return frame, np.flatnonzero((frame[keys] != frame[keys].shift()).any(axis=1).to_numpy())

        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            n += len(frame)
            if n < need:
                continue
            whole, cuts = cut()
            if len(cuts) > 1:
                yield apply(whole, cuts)
            held = [whole.iloc[cuts[-1] :]]
            n = len(held[0])
            need = n + rows
        if held:
            whole, cuts = cut()
            yield apply(whole, np.append(cuts, len(whole)))

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return (then(ordered) if then else ordered).mapInPandas(run, schema)


def in_order(df: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable[[object, dict[str, np.ndarray], bool], tuple[object, pd.DataFrame]], rows: int | None = None) -> DataFrame:
    """Streams each key's rows in order through step(state, columns, last) -> (state, rows).

    A key comes in pieces of about a batch; state is None in its first piece, and last is
    true in its last one, which always has the key's last row. rows, where it is known,
    is the number of rows that df was made from: as many partitions as these need.
    """

    def run(frames):
        held: pd.DataFrame | None = None
        state: object = None

        def pieces(frame: pd.DataFrame, end: bool):
            nonlocal state
            cuts = [*np.flatnonzero((frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()).tolist(), len(frame)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                last = end or k < len(cuts) - 2
                b = b if last else b - 1  # the row that tells whether the key goes on stays behind
                if b > a:
                    state, out = step(state, {c: frame[c].to_numpy()[a:b] for c in frame.columns}, last)
                    if len(out):
                        yield out
                if last:
                    state = None

        for frame in frames:
            if len(frame):
                frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
                yield from pieces(frame, False)
                held = frame.iloc[-1:]
        if held is not None:
            yield from pieces(held.reset_index(drop=True), True)

    dealt = df.repartition(*keys) if rows is None else spread(df, rows, *keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def absorb_short_runs(rank: list[int], length: list[float], least: float) -> list[list[int]]:
    """Groups of runs after short ones have joined a neighbour.

    rank: larger is worse. From the start, the first run (but the sequence's first) that is
    shorter than `least` and not worse than both neighbours joins the longer neighbour, the
    left one on a tie; then the search starts again. A group has the rank of its first run.
    """
    groups = [[i] for i in range(len(rank))]
    size = list(length)
    i = 1
    while i < len(groups):
        own, left = rank[groups[i][0]], rank[groups[i - 1][0]]
        right = rank[groups[i + 1][0]] if i + 1 < len(groups) else None
        worst = own > left and (right is None or own > right)
        if size[i] >= least or worst:
            i += 1
            continue
        at = i if right is not None and size[i + 1] > size[i - 1] else i - 1
        groups[at : at + 2] = [groups[at] + groups[at + 1]]
        size[at : at + 2] = [size[at] + size[at + 1]]
        # only neighbours of the merged group can have changed: going back two places equals starting again
        i = max(1, at - 1)
    return groups


def despeckle(state: list[int], length: list[float], least: float) -> list[tuple[int, float]]:
    """(state, length) of runs after short ones have taken a neighbour's state: the longer one's, the left one's on a tie.

    Ends count too. Runs that become equal join; then the search starts again.
    """
    out = [[s, n] for s, n in zip(state, length, strict=True)]
    i = 0
    while i < len(out):
        if out[i][1] >= least or len(out) == 1:
            i += 1
            continue
        left = out[i - 1][1] if i else -1.0
        right = out[i + 1][1] if i + 1 < len(out) else -1.0
        at = i - 1 if left >= right else i + 1
        out[i][0] = out[at][0]
        a, b = min(i, at), max(i, at)
        out[a : b + 1] = [[out[a][0], out[a][1] + out[b][1]]]
        for j in (a, a - 1):
            if 0 <= j and j + 1 < len(out) and out[j][0] == out[j + 1][0]:
                out[j : j + 2] = [[out[j][0], out[j][1] + out[j + 1][1]]]
        i = max(0, a - 2)
    return [(s, n) for s, n in out]


def thin_by_distance(x: np.ndarray, step: float, before: float | None = None, last: bool = True) -> np.ndarray:
    """Row numbers kept when each is at least `step` beyond the one kept before; the last stays.

    A sequence may come in pieces: before is the last kept position of the piece before.
    """
    kept: list[int] = []
    for i in range(len(x)):
        if before is None or x[i] - before >= step:
            kept.append(i)
            before = float(x[i])
    if last and len(x) and (not kept or kept[-1] != len(x) - 1):
        kept.append(len(x) - 1)
    return np.array(kept, np.int64)


def simplify(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Row numbers kept by the rule of Douglas and Peucker, without recursion."""
    n = len(xy)
    if n < 3:
        return np.arange(n)
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, p = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        far = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / np.hypot(*d) if d.any() else np.hypot(p[:, 0], p[:, 1])
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep)


def forward_speeds(limit_ms: np.ndarray, x_m: np.ndarray, grade: np.ndarray, acceleration: Callable, start_ms: float = 0.0) -> np.ndarray:
    """Speeds along x under limits, power-limited: v' = sqrt(v^2 + 2 a(v) dx), 1 m/s at least where the limit isn't lower; the grade is that of the row reached.

    limit_ms may have a row for each of several settings, which then advance together;
    acceleration takes what a step has: a speed, or an array of them.
    """
    v = np.empty(limit_ms.shape)
    if not len(x_m):
        return v
    now = v[..., 0] = np.minimum(start_ms, limit_ms[..., 0])
    for i, dx in enumerate(np.diff(x_m), 1):
        now = v[..., i] = np.minimum(limit_ms[..., i], np.sqrt(np.maximum(1.0, now * now + 2 * acceleration(now, grade[i]) * dx)))
    return v


def forward_speeds_of(limits: list[np.ndarray], x_m: list[np.ndarray], grades: list[np.ndarray], acceleration: Callable) -> list[np.ndarray]:
    """`forward_speeds` of many lines from rest, each limit with a row for each setting: lines of like length advance together, so a step costs one call for all of them."""
    out: list = [np.empty(limit.shape) for limit in limits]
    order = sorted((i for i in range(len(x_m)) if len(x_m[i])), key=lambda i: -len(x_m[i]))
    at = 0
    while at < len(order):
        longest = len(x_m[order[at]])
        group = [i for i in order[at:] if 2 * len(x_m[i]) >= longest or longest <= 16]
        at += len(group)
        settings, n = limits[group[0]].shape[0], [len(x_m[i]) for i in group]
        limit, dx, grade = np.zeros((longest, len(group), settings)), np.zeros((longest, len(group), 1)), np.zeros((longest, len(group), 1))
        for k, i in enumerate(group):
            limit[: n[k], k], dx[1 : n[k], k, 0], grade[: n[k], k, 0] = limits[i].T, np.diff(x_m[i]), grades[i]
        going = np.searchsorted(-np.array(n), -np.arange(longest))  # lines that have a row there
        v = np.zeros_like(limit)
        now = v[0] = np.minimum(0.0, limit[0])
        for r in range(1, longest):
            a = going[r]
            now = now[:a]
            now = v[r, :a] = np.minimum(limit[r, :a], np.sqrt(np.maximum(1.0, now * now + 2 * acceleration(now, grade[r, :a]) * dx[r, :a])))
        for k, i in enumerate(group):
            out[i] = np.ascontiguousarray(v[: n[k], k].T)
    return out


def circle_radii(x: np.ndarray, y: np.ndarray, half: int) -> np.ndarray:
    """Radius of the least-squares circle (Kasa) through the rows up to `half` before and after; infinite for a line.

    Moments come from prefix sums about the centre of all rows, so the cost is linear.
    """
    n = len(x)
    if n < 3:
        return np.full(n, np.inf)
    x, y = x - x.mean(), y - y.mean()
    z = x * x + y * y
    terms = np.stack([np.ones(n), x, y, z, x * x, x * y, y * y, x * z, y * z])
    sums = np.concatenate((np.zeros((9, 1)), np.cumsum(terms, axis=1)), axis=1)
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    m, sx, sy, sz, sxx, sxy, syy, sxz, syz = sums[:, hi] - sums[:, lo]
    cxx, cxy, cyy = sxx - sx * sx / m, sxy - sx * sy / m, syy - sy * sy / m
    cxz, cyz = sxz - sx * sz / m, syz - sy * sz / m
    det = cxx * cyy - cxy * cxy
    flat = det <= 1e-12 * np.maximum(cxx * cyy, 1e-300)
    det = np.where(flat, 1.0, det)
    a, b = (cxz * cyy - cyz * cxy) / det / 2, (cyz * cxx - cxz * cxy) / det / 2
    c = sz / m - 2 * a * sx / m - 2 * b * sy / m
    r = np.sqrt(np.maximum(c + a * a + b * b, 0))
    return np.where(flat | (r > 1e7), np.inf, r)


def merge_splits(splits: list[float], least: float) -> list[float]:
    """Ascending split positions, each at least `least` beyond the one kept before."""
    x = np.sort(np.array(splits, np.float64))
    return x[thin_by_distance(x, least, last=False)].tolist()


def inflections(kappa: np.ndarray, support: int, threshold: float) -> list[int]:
    """Rows between runs of opposite curvature sign that last `support` rows, at the least |kappa| from the one's last row to the other's first."""
    sign = np.where(np.abs(kappa) < threshold, 0, np.sign(kappa)).astype(int)
    edges = np.flatnonzero(np.diff(sign)) + 1
    cuts = np.concatenate(([0], edges, [len(sign)]))
    found = [(a, b, sign[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if sign[a] and b - a >= support]
    return [int(b0 - 1 + np.abs(kappa[b0 - 1 : a1 + 1]).argmin()) for (_, b0, s0), (a1, _, s1) in zip(found, found[1:], strict=False) if s0 != s1]

