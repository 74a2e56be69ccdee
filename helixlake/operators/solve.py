"""Small dense solves on a Gram matrix: non-negative least squares and forward selection.

Inputs are k x k for the strains of one species; no vector of families comes here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

TINY = 1e-9
#: The names of the stop rules in a trace, other and paired.
STOPPED = ("cv", "cv_paired")


@dataclass
class Step:
    candidate: object
    residual: float
    error: float | None
    accepted: bool
    reason: str | None


@dataclass
class Selection:
    labels: list = field(default_factory=list)
    x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    residual: float = 0.0
    r2: float = 0.0
    steps: list[Step] = field(default_factory=list)

    @property
    def ra(self) -> np.ndarray:
        total = self.x.sum()
        return self.x / total if total > 0 else self.x


def rss(g: np.ndarray, b: np.ndarray, yty: float, x: np.ndarray) -> float:
    return float(max(x @ g @ x - 2 * x @ b + yty, 0.0))


def nnls(g: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x of least x'Gx - 2x'b by active sets; a singular G is met by least norm."""
    n = len(b)
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = 1e-10 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        slope = b - g @ x
        slope[free] = -np.inf
        if not n or slope.max() <= slack:
            break
        free[int(slope.argmax())] = True
        while True:
            at = np.flatnonzero(free)
            z = np.zeros(n)
            z[at] = np.linalg.lstsq(g[np.ix_(at, at)], b[at], rcond=1e-12)[0]
            low = at[z[at] <= 0]
            if not len(low):
                x = z
                break
            step = min(x[i] / (x[i] - z[i]) if x[i] > z[i] else 0.0 for i in low)
            x = x + step * (z - x)
            free &= ~(free & (x <= 1e-14))
            x[~free] = 0.0
    return x


def next_column(diagonal: np.ndarray, b: np.ndarray, yty: float, held: np.ndarray, order: list[int], priority: np.ndarray, band: float = 0.01) -> int:
    """The column that lowers the residual most beside those in order, whose Gram columns are held; near ties go to priority, residual, place.

    A candidate that does not correlate with what is left cannot lower the residual, so
    it isn't solved for.
    """
    slack = 1e-10 * max(1.0, float(np.abs(b).max(initial=0.0)))
    at = np.array(order, int)
    x = nnls(held[:, at], b[at])
    left = np.full(len(b), rss(held[:, at], b[at], yty, x))
    for j in np.flatnonzero(b - x @ held > slack):
        if j not in order:
            g = np.block([[held[:, at], held[:, [j]]], [held[:, [j]].T, diagonal[[j]][None]]])
            both = np.append(b[at], b[j])
            left[j] = rss(g, both, yty, nnls(g, both))
    left[at] = np.inf
    near = np.flatnonzero(left <= left.min() * (1 + band))
    return int(min(near, key=lambda j: (-priority[j], left[j], j)))


def forward(diagonal: np.ndarray, b: np.ndarray, yty: float, column: Callable[[int], np.ndarray], priority: np.ndarray, most: int = 12, band: float = 0.01) -> list[int]:
    """Columns in the order in which they lower the residual most.

    Of the Gram matrix only the diagonal and the columns of what has been chosen are asked for.
    """
    order: list[int] = []
    held = np.zeros((0, len(b)))
    while len(order) < min(most, len(b)):
        order.append(next_column(diagonal, b, yty, held, order, priority, band))
        held = np.vstack([held, column(order[-1])])
    return order


def fold_models(g: np.ndarray, b: np.ndarray, pieces: dict[int, tuple[np.ndarray, np.ndarray]], used: list[int]) -> list[tuple[int, int, int | None, float]]:
    """(fold, k, place, x) of the first k columns solved without each fold; place is None in the model of k = 0."""
    models = []
    for f in used:
        gf, bf = pieces.get(f, (np.zeros_like(g), np.zeros_like(b)))
        models.append((f, 0, None, 0.0))
        for k in range(1, len(b) + 1):
            x = nnls((g - gf)[:k, :k], (b - bf)[:k])
            models += [(f, k, i, float(v)) for i, v in enumerate(x)]
    return models


def stepwise(g: np.ndarray, b: np.ndarray, yty: float, tss: float, names: list, errors: list[list[float]], paired: bool, least_gain: float, unmoved: float = 0.0) -> Selection:
    """The selection that a stop rule makes of columns in order, with a step for each."""
    k = stop_paired(errors, least_gain, unmoved) if paired else stop_one_se(errors)
    result = finish(g, b, yty, tss, names, list(range(k)))
    for i, c in enumerate(names):
        left = rss(g[: i + 1, : i + 1], b[: i + 1], yty, nnls(g[: i + 1, : i + 1], b[: i + 1]))
        mean = float(np.mean(errors[i + 1])) if errors[i + 1] else None
        result.steps.append(Step(c, float(np.sqrt(left)), mean, i < k, None if i < k else STOPPED[paired]))
    return result


def stop_one_se(errors: list[list[float]]) -> int:
    """How many to take: go on while the mean falls by more than the standard error of the folds."""
    k = 0
    for now, then in zip(errors[:-1], errors[1:], strict=True):
        if len(now) < 2 or not len(then) or np.mean(now) - np.mean(then) <= np.std(now) / np.sqrt(len(now)):
            break
        k += 1
    return k


def stop_paired(errors: list[list[float]], least_gain: float = 0.02, unmoved: float = 0.0) -> int:
    """How many to take: go on while the paired falls exceed their standard error and a relative gain.

    The gain is relative to the mean error less `unmoved`, the part of it that no column can lower.
    """
    k = 0
    for now, then in zip(errors[:-1], errors[1:], strict=True):
        if len(now) != len(then) or not len(now):
            break
        fall = np.array(now) - np.array(then)
        mean = float(np.mean(now)) - unmoved
        if fall.mean() <= fall.std() / np.sqrt(len(fall)) or mean <= 0 or fall.mean() / mean < least_gain:
            break
        k += 1
    return k


def finish(g: np.ndarray, b: np.ndarray, yty: float, tss: float, labels: list, chosen: list[int]) -> Selection:
    """Solve on the chosen columns, drop those at zero, and solve once more."""
    at = np.array(chosen, int)
    if not len(at):
        return Selection(residual=float(np.sqrt(max(yty, 0.0))))
    x = nnls(g[np.ix_(at, at)], b[at])
    if (x <= TINY).any():
        at = at[x > TINY]
        x = nnls(g[np.ix_(at, at)], b[at]) if len(at) else np.zeros(0)
    left = rss(g[np.ix_(at, at)], b[at], yty, x)
    return Selection([labels[i] for i in at], x, float(np.sqrt(left)), 1 - left / tss if tss > 0 else 0.0)
