"""Clustering models on one matrix in numpy, for tasks of the grid: each fit is small, and there are a great many."""

from __future__ import annotations

import numpy as np


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres."""
    out = [x[rng.integers(len(x))]]
    d = ((x - out[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = d.sum()
        out.append(x[rng.choice(len(x), p=d / total)] if total > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 4, most: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, inertia) of the best start; an emptied cluster takes the point its centre serves worst."""
    best: tuple[np.ndarray, np.ndarray, float] | None = None
    for _ in range(starts):
        c, old = _seeds(x, k, rng), None
        for _ in range(most):
            d = sq_distances(x, c)
            lab = d.argmin(axis=1)
            if old is not None and (lab == old).all():
                break
            old = lab
            n = np.bincount(lab, minlength=k)
            sums = np.stack([np.bincount(lab, x[:, j], k) for j in range(x.shape[1])], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            for e in np.flatnonzero(n == 0):
                c[e] = x[d.min(axis=1).argmax()]
        inertia = float(sq_distances(x, c)[np.arange(len(x)), lab].sum())
        if best is None or inertia < best[2]:
            best = lab, c, inertia
    assert best is not None
    return best


def mixture(x: np.ndarray, k: int, rng: np.random.Generator, kind: str = "full", reg: float = 1e-4, starts: int = 2, most: int = 100) -> dict:
    """A Gaussian mixture of covariance full, tied, diag or spherical: labels, posteriors, log-likelihood, bic and icl."""
    n, p = x.shape
    best: dict | None = None
    for _ in range(starts):
        lab = kmeans(x, k, rng, 1)[0]
        r, last = np.eye(k)[lab], -np.inf
        for _ in range(most):
            w = r.sum(axis=0) + 1e-10
            mu = r.T @ x / w[:, None]
            logs = np.empty((n, k))
            tied = sum((r[:, j, None] * (x - mu[j])).T @ (x - mu[j]) for j in range(k)) / n if kind == "tied" else None
            for j in range(k):
                d = x - mu[j]
                if kind in ("full", "tied"):
                    cov = (tied if tied is not None else (r[:, j, None] * d).T @ d / w[j]) + reg * np.eye(p)
                    chol = np.linalg.cholesky(cov)
                    z = np.linalg.solve(chol, d.T)
                    logs[:, j] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(chol)).sum()
                else:
                    v = r[:, j] @ d**2 / w[j] + reg
                    v = np.full(p, v.mean()) if kind == "spherical" else v
                    logs[:, j] = -0.5 * (d**2 / v).sum(axis=1) - 0.5 * np.log(v).sum()
            logs += np.log(w / w.sum()) - 0.5 * p * np.log(2 * np.pi)
            top = logs.max(axis=1, keepdims=True)
            ll = (top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))).sum()
            r = np.exp(logs - top)
            r /= r.sum(axis=1, keepdims=True)
            if ll - last < 1e-6 * abs(ll):
                break
            last = ll
        free = {"full": k * p * (p + 1) // 2, "tied": p * (p + 1) // 2, "diag": k * p, "spherical": k}[kind] + k * p + k - 1
        bic = -2 * ll + free * np.log(n)
        icl = bic - 2 * (r * np.log(np.maximum(r, 1e-300))).sum()
        if best is None or ll > best["loglik"]:
            best = {"labels": r.argmax(axis=1), "posterior": r, "loglik": ll, "bic": float(bic), "icl": float(icl), "kind": kind, "means": mu}
    assert best is not None
    return best


def mixture_ladder(x: np.ndarray, k: int, seed: int, kind: str = "full") -> dict:
    """The asked covariance, else diagonal, else spherical, else k-means."""
    for c in dict.fromkeys([kind, "diag", "spherical"]):
        try:
            return mixture(x, k, np.random.default_rng(seed), c)
        except np.linalg.LinAlgError:
            continue
    return {"labels": kmeans(x, k, np.random.default_rng(seed))[0], "kind": "kmeans", "bic": np.nan, "icl": np.nan}


def mixed_distances(x: np.ndarray, c: np.ndarray, nominal: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Gower's distances of rows to prototypes."""
    out = np.zeros((len(x), len(c)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] != c[None, :, j]) if nominal[j] else np.abs(x[:, j, None] - c[None, :, j]) / scale[j]
    return out / x.shape[1]


def prototypes(x: np.ndarray, lab: np.ndarray, k: int, nominal: np.ndarray, levels: list[np.ndarray | None], old: np.ndarray) -> np.ndarray:
    """Medians (at a level of ordinal columns), or the smallest mode of nominal ones."""
    out = old.copy()
    for i in range(k):
        mine = x[lab == i]
        if not len(mine):
            continue
        for j in range(x.shape[1]):
            if nominal[j]:
                v, n = np.unique(mine[:, j], return_counts=True)
                out[i, j] = v[n.argmax()]
            else:
                m = np.median(mine[:, j])
                out[i, j] = m if levels[j] is None else levels[j][np.abs(levels[j] - m).argmin()]
    return out


def kproto(x: np.ndarray, k: int, rng: np.random.Generator, nominal: np.ndarray, scale: np.ndarray, levels: list, starts: int = 4, most: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, prototypes, sum of distances) of the best start."""
    best: tuple[np.ndarray, np.ndarray, float] | None = None
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        for _ in range(k - 1):
            d = mixed_distances(x, c, nominal, scale).min(axis=1) ** 2
            c = np.concatenate([c, x[[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]]])
        old = None
        for _ in range(most):
            d = mixed_distances(x, c, nominal, scale)
            lab = d.argmin(axis=1)
            if old is not None and (lab == old).all():
                break
            old = lab
            c = prototypes(x, lab, k, nominal, levels, c)
            near = d.min(axis=1)
            for e in np.flatnonzero(np.bincount(lab, minlength=k) == 0):
                if near.max() > 0:
                    c[e] = x[near.argmax()]
        cost = float(mixed_distances(x, c, nominal, scale)[np.arange(len(x)), lab].sum())
        if best is None or cost < best[2]:
            best = lab, c, cost
    assert best is not None
    return best


def latent(codes: np.ndarray, counts: list[int], k: int, rng: np.random.Generator, starts: int = 5, most: int = 200, alpha: float = 0.1) -> dict:
    """Latent classes by EM from random hard starts: labels, posterior, loglik, bic, icl and normalised entropy."""
    n = len(codes)
    hot = [np.eye(c)[codes[:, j]] for j, c in enumerate(counts)]
    best: dict | None = None
    for _ in range(starts):
        r, last = np.eye(k)[rng.integers(k, size=n)], -np.inf
        for _ in range(most):
            pi = np.maximum(r.mean(axis=0), 1e-12)
            lj = np.tile(np.log(pi), (n, 1))
            for h in hot:
                t = r.T @ h + alpha
                lj += h @ np.log(t / t.sum(axis=1, keepdims=True)).T
            top = lj.max(axis=1, keepdims=True)
            ll = float((top[:, 0] + np.log(np.exp(lj - top).sum(axis=1))).sum())
            r = np.exp(lj - top)
            r /= r.sum(axis=1, keepdims=True)
            if ll - last < 1e-6 * abs(ll):
                break
            last = ll
        if best is None or ll > best["loglik"]:
            free = (k - 1) + k * sum(c - 1 for c in counts)
            entropy = -(r * np.log(np.maximum(r, 1e-300))).sum()
            bic = -2 * ll + free * np.log(n)
            best = {"labels": r.argmax(axis=1), "posterior": r, "loglik": ll, "bic": bic, "icl": bic + 2 * entropy, "entropy": 1 - entropy / (n * np.log(k)) if k > 1 else 1.0}
    assert best is not None
    return best


def linkage_labels(d: np.ndarray, k: int, how: str) -> np.ndarray:
    """k clusters of a distance matrix by average or ward linkage, with nearest-neighbour chains; d is used up."""
    n = len(d)
    d = d.astype(float) ** 2 if how == "ward" else d.astype(float)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((d[a, b], a, b))
        sa, sb, other = size[a], size[b], alive.copy()
        other[[a, b]] = False
        if how == "ward":
            s = size[other]
            new = ((sa + s) * d[a, other] + (sb + s) * d[b, other] - s * d[a, b]) / (sa + sb + s)
        else:
            new = (sa * d[a, other] + sb * d[b, other]) / (sa + sb)
        d[b, other] = d[other, b] = new
        d[a, :], d[:, a] = np.inf, np.inf
        alive[a], size[b] = False, sa + sb
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        root[find(a)] = find(b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def ari(a: np.ndarray, b: np.ndarray) -> float:
    cells = np.unique(np.stack([a, b]), axis=1, return_counts=True)[1]
    two = lambda n: (n * (n - 1) / 2).sum()
    ra, rb, every = two(np.unique(a, return_counts=True)[1]), two(np.unique(b, return_counts=True)[1]), len(a) * (len(a) - 1) / 2
    expected = ra * rb / every if every else 0.0
    most = (ra + rb) / 2
    return 1.0 if most == expected else float((two(cells) - expected) / (most - expected))


def silhouette(x: np.ndarray, lab: np.ndarray) -> float:
    k = lab.max() + 1
    n = np.bincount(lab, minlength=k)
    total = 0.0
    for i in range(0, len(x), 1024):
        d = np.sqrt(sq_distances(x[i : i + 1024], x))
        sums = np.stack([d[:, lab == c].sum(axis=1) for c in range(k)], axis=1)
        own, row = lab[i : i + 1024], np.arange(len(d))
        with np.errstate(divide="ignore", invalid="ignore"):
            a = sums[row, own] / (n[own] - 1)
            o = sums / n
            o[row, own] = np.inf
            b = o.min(axis=1)
            total += np.nan_to_num(np.where(n[own] > 1, (b - a) / np.maximum(a, b), 0.0)).sum()
    return float(total / len(x))


def indices(x: np.ndarray, lab: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Calinski-Harabasz and Davies-Bouldin."""
    k, n = len(c), np.bincount(lab, minlength=len(c))
    within = ((x - c[lab]) ** 2).sum()
    between = (n[:, None] * (c - x.mean(axis=0)) ** 2).sum()
    spread = np.bincount(lab, np.sqrt(((x - c[lab]) ** 2).sum(axis=1)), k) / np.maximum(n, 1)
    d = np.sqrt(sq_distances(c, c))
    np.fill_diagonal(d, np.inf)
    ch = (between / (k - 1)) / (within / (len(x) - k)) if within > 0 and k > 1 else 1.0
    return float(ch), float(((spread[:, None] + spread[None, :]) / np.maximum(d, 1e-12)).max(axis=1).mean())


def dip(x: np.ndarray) -> float:
    """Hartigan's dip: the largest distance of the empirical distribution from the nearest unimodal one, by convex fits around each mode interval."""
    x = np.sort(x)
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 1 / (2 * n) if n else 0.0

    def hull(t: np.ndarray, y: np.ndarray, sign: int) -> np.ndarray:
        keep: list[int] = []
        for i in range(len(t)):
            while len(keep) > 1 and sign * ((y[keep[-1]] - y[keep[-2]]) * (t[i] - t[keep[-1]]) - (y[i] - y[keep[-1]]) * (t[keep[-1]] - t[keep[-2]])) >= 0:
                keep.pop()
            keep.append(i)
        return np.interp(t, t[keep], y[keep])

    lo_y, hi_y = np.arange(n) / n, np.arange(1, n + 1) / n
    low, high, best = 0, n - 1, 0.0
    while True:
        t = x[low : high + 1]
        g, h = hull(t, lo_y[low : high + 1], 1), hull(t, hi_y[low : high + 1], -1)
        gap = h - g
        worst = int(gap.argmax())
        d = float(gap[worst])
        touch_g = np.flatnonzero(np.isclose(g, lo_y[low : high + 1]))
        touch_h = np.flatnonzero(np.isclose(h, hi_y[low : high + 1]))
        left, right = touch_g[touch_g <= worst].max(initial=0), touch_h[touch_h >= worst].min(initial=len(t) - 1)
        outer = max(float((hi_y[low : low + left + 1] - g[: left + 1]).max(initial=0.0)), float((h[right:] - lo_y[low + right : high + 1]).max(initial=0.0)))
        if d <= max(best, outer) or (left == 0 and right == len(t) - 1):
            return max(best, outer, d if left == 0 and right == len(t) - 1 else 0.0) / 2
        best = max(best, outer)
        low, high = low + left, low + right
        if high - low < 2:
            return best / 2
