"""Tree-structured Parzen search over parameter ranges.

After ``startup`` random trials, the best ``good`` share of trials and the rest give two
mixtures of normals per parameter, reflected at the ends of the unit interval; of
``candidates`` draws from the good one the draw with the largest ratio of densities is
proposed. Rates are searched on a log scale,
integers are rounded. Everything follows from the seed and the values told.
"""

from __future__ import annotations

import math

import numpy as np

LOG = {"learning_rate"}


class Search:
    def __init__(self, ranges: dict, seed: int, startup: int = 5, candidates: int = 8, good: float = 0.15):
        self.ranges, self.rng = ranges, np.random.default_rng(seed)
        self.startup, self.candidates, self.good = startup, candidates, good
        self.units: list[dict] = []
        self.values: list[float] = []

    def _value(self, name: str, u: float):
        lo, hi = self.ranges[name]
        if isinstance(lo, int) and isinstance(hi, int):
            return min(hi, lo + int(u * (hi - lo + 1)))
        if name in LOG:
            return math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))
        return lo + u * (hi - lo)

    def _unit(self, name: str, value) -> float:
        lo, hi = self.ranges[name]
        if isinstance(lo, int) and isinstance(hi, int):
            return (value - lo + 0.5) / (hi - lo + 1)
        if name in LOG:
            return (math.log(value) - math.log(lo)) / ((math.log(hi) - math.log(lo)) or 1.0)
        return (value - lo) / ((hi - lo) or 1.0)

    @staticmethod
    def _width(at: np.ndarray) -> float:
        return max(0.08, 0.35 / math.sqrt(max(len(at), 1)))

    def _log_density(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mixture of normals at the points and a flat part, each with the same weight."""
        width = self._width(at)
        z = (x[:, None] - np.concatenate([at, -at, 2 - at])[None, :]) / width
        return np.log((np.exp(-0.5 * z * z).sum(axis=1) / (width * math.sqrt(2 * math.pi)) + 1.0) / (len(at) + 1))

    def propose(self, n: int) -> list[dict]:
        out = []
        for _ in range(n):
            if len(self.values) < self.startup:
                u = {name: float(self.rng.random()) for name in self.ranges}
            else:
                order = np.argsort(-np.asarray(self.values), kind="stable")
                k = max(1, math.ceil(self.good * len(order)))
                u = {}
                for name in self.ranges:
                    at = np.array([self.units[i][name] for i in order])
                    best, rest = at[:k], at[k:]
                    near = self.rng.integers(0, k + 1, self.candidates)       # k: the flat part
                    x = best[np.minimum(near, k - 1)] + self._width(best) * self.rng.normal(size=self.candidates)
                    x = np.where(near < k, 1 - np.abs(1 - np.abs(x)), self.rng.random(self.candidates))
                    x = np.clip(x, 0.0, 1.0 - 1e-9)
                    u[name] = float(x[np.argmax(self._log_density(x, best) - self._log_density(x, rest))])
            out.append({name: self._value(name, v) for name, v in u.items()})
        return out

    def tell(self, trials: list[dict], values: list[float]):
        for t, v in zip(trials, values):
            self.units.append({name: self._unit(name, t[name]) for name in self.ranges})
            self.values.append(float(v))
