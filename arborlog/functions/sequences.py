"""Functions of token sequences, and their column versions."""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _table(a: Sequence, b: Sequence, insert: float, delete: float, replace: float) -> np.ndarray:
    """Least edit costs of all prefixes, a row at a time: insertions within a row are a running minimum."""
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[t] for t in b])
    steps = np.arange(len(b) + 1) * insert
    rows = [steps.astype(float)]
    for t in a:
        up = rows[-1] + delete
        up[1:] = np.minimum(up[1:], rows[-1][:-1] + np.where(y == codes[t], 0, replace))
        rows.append(np.minimum.accumulate(up - steps) + steps)
    return np.stack(rows)


def align_cost(a: Sequence, b: Sequence, insert: float = 1, delete: float = 1, replace: float = 1) -> float:
    return float(_table(a, b, insert, delete, replace)[-1, -1])


def norm_align_cost(a: Sequence, b: Sequence) -> float:
    """The cost over the longer length; 0 of two empty sequences."""
    return align_cost(a, b) / max(len(a), len(b)) if len(a) or len(b) else 0.0


def align_score(a: Sequence, b: Sequence) -> float:
    n = max(len(a), len(b))
    return (n - align_cost(a, b) + 1) / (n + 1)


def align_pairs(a: Sequence, b: Sequence, insert: float = 1, delete: float = 1, replace: float = 1) -> list[tuple[int, int]]:
    """Positions of equal tokens that are aligned, (i, -1) and (-1, j) for those that aren't; a replacement is one of each."""
    cost, i, j, out = _table(a, b, insert, delete, replace), len(a), len(b), []
    while i or j:
        here = cost[i, j]
        if i and j and here == cost[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else replace):
            i, j = i - 1, j - 1
            out += [(i, j)] if a[i] == b[j] else [(-1, j), (i, -1)]
        elif i and here == cost[i - 1, j] + delete:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def matched(a: Sequence, b: Sequence) -> list[int]:
    """For each token of a, the first free position of b with it, or -1."""
    places: dict = defaultdict(deque)
    for j, t in enumerate(b):
        places[t].append(j)
    return [places[t].popleft() if places[t] else -1 for t in a]


def places(a: Sequence, b: Sequence, groups: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """(own, place) of each token of a that b has, in a's order: the position it takes and the one it counts at.

    The two differ only within an order group of b: there a token counts at the first place of its run of the group that lies
    behind all places so far, and one that would step back counts at the next place, if that is of the group.
    """
    group = [0] * len(b) if groups is None else list(groups)
    run = list(range(len(b)))  # where the neighbouring places of one group begin
    for j in range(1, len(b)):
        if group[j] > 0 and group[j] == group[j - 1]:
            run[j] = run[j - 1]
    out: list[tuple[int, int]] = []
    reach = -1
    for own in matched(a, b):
        if own < 0:
            continue
        place = max(run[own], min(own, reach + 1))
        behind = out and place <= out[-1][1]
        if behind and group[own] > 0 and reach + 1 < len(b) and group[reach + 1] == group[own]:
            place = reach + 1
        out.append((own, place))
        reach = max(reach, place)
    return out


def progress(a: Sequence, b: Sequence, groups: Sequence[int] | None = None, ordered: float = 2, unordered: float = 1, skip: float = 0.25) -> float:
    """How much of b a has: tokens met after the last one count ``ordered``, others ``unordered``, passed-over positions cost ``skip``; None tokens of b earn nothing."""
    at = np.array([place for _, place in places(a, b, groups)], np.int64)
    if not len(at):
        return 0.0
    step = np.diff(at, prepend=-1)
    worth = np.where(step > 0, ordered, unordered) - skip * np.maximum(step - 1, 0)
    return float(worth[[b[j] is not None for j in at.tolist()]].sum())


def reordered(a: Sequence, b: Sequence, groups: Sequence[int]) -> list[int]:
    """An order of b's positions in which its order groups stand as a has them; positions that a lacks fill the gaps in rising order."""
    moved = {place: own for own, place in places(a, b, groups)}
    rest = iter([j for j in range(len(b)) if j not in set(moved.values())])
    return [moved[j] if j in moved else next(rest) for j in range(len(b))]


def missing_count(a: Sequence, b: Sequence) -> int:
    """Tokens of b, with multiplicity, that a lacks."""
    return sum((Counter(b) - Counter(a)).values())


def context_distance(a: Sequence, i: int, b: Sequence, j: int, most: int = 3) -> float:
    """Mean of the normalised distances of what stands before and after two positions."""
    before = norm_align_cost(a[max(0, i - most) : i], b[max(0, j - most) : j])
    after = norm_align_cost(a[i + 1 : i + 1 + most], b[j + 1 : j + 1 + most])
    return (before + after) / 2


def distance_weight(d: float, base: float = 0.5, power: float = 2) -> float:
    return base**power / (base + d) ** power


def best_progress(a: Sequence, solutions: Sequence[Sequence]) -> float:
    """The best over solutions of minus the alignment cost (2, 2, 1) over twice the solution's length."""
    return max((-align_cost(a, s, 2, 2, 1) / (2 * len(s)) for s in solutions if len(s)), default=float("nan"))


def directed_distance(a: Sequence, b: Sequence) -> float:
    """How far a is from b where deleting costs nothing: what of b is to be inserted, over its length."""
    return align_cost(a, b, 1, 0, 1) / len(b) if len(b) else 0.0


def next_edit(a: Sequence, b: Sequence) -> list:
    """a after one step towards b: a token that stands in both but out of order moves, else one that b has is added, else one that b lacks goes."""
    now, goal = list(a), list(b)
    if now == goal:
        return now
    pairs = align_pairs(now, goal, 1, 1, 2)
    loose = [i for i, j in pairs if j < 0]
    open_ = [j for i, j in pairs if i < 0]

    def slot(j: int, without: int = -1) -> int:
        """Behind the last aligned token before place j of the goal."""
        before = [i for i, k in pairs if i >= 0 and 0 <= k < j]
        at = max(before) + 1 if before else 0
        return at - (0 <= without < at)

    for i in loose:
        j = next((j for j in open_ if goal[j] == now[i]), None)
        if j is not None:
            token, at = now[i], slot(j, i)
            rest = now[:i] + now[i + 1 :]
            return rest[:at] + [token] + rest[at:]
    if open_:
        at = slot(open_[0])
        return now[:at] + [goal[open_[0]]] + now[at:]
    return now[: loose[0]] + now[loose[0] + 1 :]


# --- columns ---


def align_cost_col(a: Column, b: Column, insert: float = 1, delete: float = 1, replace: float = 1) -> Column:
    """align_cost of two array columns, in Arrow batches; null if one is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else align_cost(list(p), list(q), insert, delete, replace) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def word_align_cost(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two strings' characters, JVM-side."""
    return F.levenshtein(a, b)


def missing_count_col(a: Column, b: Column) -> Column:
    """missing_count of two array columns without Python: of each distinct token of b, how many more b has."""
    n = lambda xs, t: F.size(F.filter(xs, lambda x: x.eqNullSafe(t)))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, t: acc + F.greatest(n(b, t) - n(a, t), F.lit(0)))


def progress_col(a: Column, b: Column, ordered: float = 2, unordered: float = 1, skip: float = 0.25) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else progress(list(p), list(q), None, ordered, unordered, skip) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def distance_weight_col(d: Column, base: float = 0.5, power: float = 2) -> Column:
    return F.pow(F.lit(base), F.lit(power)) / F.pow(F.lit(base) + d, F.lit(power))
