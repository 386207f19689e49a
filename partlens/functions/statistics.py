"""Statistics that Spark lacks, on the arrays of one group."""

from __future__ import annotations

import math

import numpy as np


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def hazen_quantile(x: np.ndarray, q: float) -> float:
    """Interpolated at (k - 0.5) / n, flat beyond."""
    y = np.sort(x[~np.isnan(x)])
    return float(np.interp(q, (np.arange(len(y)) + 0.5) / len(y), y)) if len(y) else math.nan


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def jaccard_distance(a: set, b: set) -> float:
    """1 for two empty sets."""
    return 1 - len(a & b) / len(a | b) if a | b else 1.0


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers by average linkage, merged while the least distance is below the cut (at the cut for two members)."""
    n = len(distance)
    members = {i: [i] for i in range(n)}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    if n == 2:
        return [0, 0] if distance[0, 1] <= cut else [0, 1]
    alive = list(range(n))
    while len(alive) > 1:
        part = d[np.ix_(alive, alive)]
        i, j = divmod(int(np.argmin(part)), len(alive))
        if part[i, j] >= cut:
            break
        a, b = sorted((alive[i], alive[j]))
        na, nb = len(members[a]), len(members[b])
        d[a] = d[:, a] = (na * d[a] + nb * d[b]) / (na + nb)
        d[a, a] = np.inf
        members[a] += members.pop(b)
        alive.remove(b)
    out = [0] * n
    for number, key in enumerate(sorted(members, key=lambda k: min(members[k]))):
        for i in members[key]:
            out[i] = number
    return out


def mean_abs_correlation(x: np.ndarray) -> float:
    """Over complete rows of the columns that vary; 1 for fewer than two such columns or three such rows."""
    known = ~np.isnan(x)
    varies = [known[:, j].sum() > 1 and np.ptp(x[known[:, j], j]) > 0 for j in range(x.shape[1])]
    x = x[:, varies]
    x = x[~np.isnan(x).any(axis=1)]
    if x.shape[1] < 2 or len(x) < 3:
        return 1.0
    centred = x - x.mean(axis=0)
    size = np.sqrt((centred**2).sum(axis=0))
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.abs(centred.T @ centred / np.outer(size, size))[np.triu_indices(x.shape[1], 1)]
    c = c[~np.isnan(c)]
    return float(c.mean()) if len(c) else 1.0


def predict_r2(x: np.ndarray, target: int) -> float:
    """How much of one column the others explain, at least 0; 0 under ten complete rows, without a varying predictor or for a constant."""
    x = x[~np.isnan(x).any(axis=1)]
    rest = np.delete(x, target, axis=1)
    if len(x) < 10 or not rest.shape[1]:
        return 0.0
    y, rest = x[:, target], rest[:, np.ptp(rest, axis=0) > 0]
    total = ((y - y.mean()) ** 2).sum()
    if not rest.shape[1] or total == 0:
        return 0.0
    design = np.column_stack([np.ones(len(y)), rest])
    off = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    return float(max(0.0, 1 - (off**2).sum() / total))


def tail_probability(margins: np.ndarray) -> float:
    """Chance of a negative margin by a generalised Pareto tail below the 10 % quantile; null under 40 margins or 15 exceedances.

    Where that quantile is itself 0 or less, the share of margins below it.
    """
    m = margins[~np.isnan(margins)]
    if len(m) < 40:
        return math.nan
    at = hazen_quantile(m, 0.10)
    over = at - m[m < at]
    if len(over) < 15:
        return math.nan
    if at <= 0:
        return len(over) / len(m)

    def profile(theta: float) -> tuple[float, float]:
        """The negative log likelihood of theta = shape / scale at its best shape, and that shape."""
        shape = np.log1p(theta * over).mean()
        return (math.log(shape / theta) + shape + 1, shape) if shape / theta > 0 else (math.inf, 0.0)

    grid = np.concatenate([-np.geomspace(1e-6, 0.999, 200) / over.max(), np.geomspace(1e-6, 50, 400) / over.mean()])
    theta = min(grid, key=lambda t: profile(t)[0])
    shape = profile(theta)[1]
    inner = 1 + theta * at
    return float(len(over) / len(m) * (inner ** (-1 / shape) if inner > 0 else 0.0))


def drifts(margins: np.ndarray, slack: float = 0.5, limit: float = 5.0, ahead: float = 0.5) -> bool:
    """Whether margins sink: a downward cumulative sum beyond the limit, or a falling line that is projected below the 1 % quantile."""
    m = margins[~np.isnan(margins)]
    if len(m) < 5 or not m.std(ddof=1) > 0:
        return False
    steps = (m - m.mean()) / m.std(ddof=1) + slack
    total = np.cumsum(steps)
    lowest = total - np.maximum.accumulate(np.concatenate([[0.0], total]))[:-1]  # since the sum was last at its highest
    if -min(0.0, lowest.min()) > limit:
        return True
    at = np.arange(1, len(m) + 1)
    slope = ((at - at.mean()) * (m - m.mean())).sum() / ((at - at.mean()) ** 2).sum()
    projected = m.mean() + slope * (len(m) + ahead * (len(m) - 1) - at.mean())
    return bool(slope < 0 and projected < hazen_quantile(m, 0.01))


def pooled_bounds(fails: np.ndarray, runs: np.ndarray, failed: np.ndarray, least: int = 5, confidence: float = 0.95) -> np.ndarray:
    """Upper bounds of a cluster's failure rates: fails and runs by test, failed as reports x tests (0/1).

    With enough tests and more spread than chance gives, a beta prior is fitted to the rates (empirical Bayes); else the runs
    are pooled, less by the tests' correlation (design effect). Tests never run are null; what stays open is 3 / runs.
    """
    out, valid = np.full(len(fails), np.nan), runs > 0
    if not valid.any():
        return out
    k, n = fails[valid], runs[valid]
    mean = k.sum() / n.sum()
    if len(k) >= least and k.sum() > 0:
        rates = k / n
        spread, chance = rates.var(ddof=1), mean * (1 - mean) / n.mean()
        if spread > chance and 0 < mean < 1:
            weight = mean * (1 - mean) / spread - 1
            if weight > 0:
                return np.array([beta_quantile(confidence, mean * weight + f, (1 - mean) * weight + max(r - f, 0)) for f, r in zip(fails, runs, strict=True)])
    together = 0.0
    if len(k) >= 2:
        x = failed[:, valid]
        x = x[:, x.std(axis=0) > 0] if len(x) else x[:, :0]
        if x.shape[1] >= 2:
            c = np.corrcoef(x, rowvar=False)[np.triu_indices(x.shape[1], 1)]
            together = float(np.clip(c[~np.isnan(c)].mean(), 0, 1)) if (~np.isnan(c)).any() else 0.0
    pooled = n.sum() / (1 + together * (len(k) - 1))
    for i, (f, r) in enumerate(zip(fails, runs, strict=True)):
        out[i] = beta_quantile(confidence, 0.5, pooled + 0.5) if f == 0 else beta_quantile(confidence, f + 0.5, max(r - f, 0) + 0.5)
    return out


def greedy_cut(modes: list[list], candidates: set, duration: dict, keep: int = 2) -> tuple[set, set]:
    """The tests that may be removed and those kept for coverage: every co-failure mode keeps min(keep, size) of its members.

    Modes are taken from the largest on. A member that isn't a candidate stays anyway and counts. Of the candidates the
    cheapest are kept first, those without a duration before all.
    """
    removed, kept = set(candidates), set()
    for mode in sorted(modes, key=lambda m: -len(m)):
        short = min(keep, len(mode)) - sum(t not in removed for t in mode)
        cheap = sorted((t for t in mode if t in removed), key=lambda t: (duration.get(t) is not None, duration.get(t) or 0.0))
        for test in cheap[: max(0, short)]:
            removed.discard(test)
            kept.add(test)
    return removed, kept


def distinct_modes(groups: list[set], similarity: float = 0.70) -> list[set]:
    """Largest first; a group inside a kept one, or that similar to it, is dropped."""
    kept: list[set] = []
    for g in sorted(groups, key=lambda g: (-len(g), sorted(g))):
        if not any(g <= k or len(g & k) / len(g | k) >= similarity for k in kept):
            kept.append(g)
    return kept
