"""Histogram gradient boosting of many models at once (folds, trials).

Features are binned once over the whole table. A tree grows level by level from sums of
gradients by (model, node, feature, bin); all models share each pass, so five folds or a
generation of trials cost as many passes as one model. Rows are sampled by a hash of
(key, model seed, round), columns by the seed and the round, and a model stops when its
validation loss has not improved for ``early_stopping_rounds`` rounds.

Gradients are summed as integers (``SCALE`` steps per unit), so sums do not depend on
the order of rows or tasks and a model is the same however the table is partitioned.

* Of two sibling nodes the lighter one is summed over rows, the other one's sums are the
  parent's less those; a leaf's value comes from the split that made it.
* :func:`fit_grouped` runs one grouped aggregate per level over the partitioned table, whose
  rows are packed by blocks so that a pass costs no conversion of rows; the driver sees (nodes x features x bins) sums, never rows.
* :func:`fit_models` takes that way for every table above ``LOCAL_BYTES`` of binned rows. A
  smaller one (its size is counted first) is broadcast, and each model then grows in a task
  of its own by the same sums: the trees are equal, and a small table is spared a
  Spark job per level. When fewer models than cores are left, the rows of a model are dealt
  to several processes of its task.
"""

from __future__ import annotations

import mmap
import os
import pickle
import traceback
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from multiprocessing import Pipe

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from propel.functions.core import md5_mod
from propel.session import unique_dir

BINS, SCALE = 64, float(1 << 20)
LAMBDA, MIN_CHILD = 1.0, 1.0
#: bytes of binned rows up to which the table is broadcast and models grow in tasks of their own
LOCAL_BYTES = 256 << 20
#: rounds after which the margins are written anew in the grouped form
REWRITE = 4
#: rows that the grouped form packs into one row of a table, and the bytes of these that a task reads
BLOCK, TASK_BYTES = 1 << 16, 16 << 20
PARTS = 100
#: rows taken at once
ROWS = 1 << 15
#: cells that features may share in one table
SHARED = (1 << 12, 1 << 9, 1)
#: rows of a table that are worth a process of their own
HAND_ROWS = 1 << 17


@dataclass(frozen=True)
class Spec:
    """One model: settings and the parts of the table it trains on and stops by."""
    n_estimators: int = 200
    max_depth: int = 5
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    early_stopping_rounds: int = 20
    seed: int = 42
    train: tuple = tuple(range(PARTS))      # parts (md5 of the key modulo PARTS) that belong to the model
    valid: tuple = ()                       # second parts (of those) that only validate


@dataclass
class Tree:
    """Nodes in the order of their making; feature -1 marks a leaf. Rows with bin <= cut go left."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, f: int, cut: int, gain: float) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node], self.left[node], self.right[node] = int(f), int(cut), float(gain), n, n + 1
        for x, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0), (self.cover, 0.0)):
            x += [v, v]
        return n, n + 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def _once(self, what: str, make):
        """What follows from the nodes, worked out once until another is made."""
        known = self.__dict__.get("_known")
        if known is None or known[0] != len(self.feature):
            known = self.__dict__["_known"] = len(self.feature), {}
        return known[1][what] if what in known[1] else known[1].setdefault(what, make())

    def depth(self) -> int:
        return self._once("depth", self._depth)

    def _depth(self) -> int:
        deep = [0] * len(self.feature)
        for n, f in enumerate(self.feature):             # children come after their node
            if f >= 0:
                deep[self.left[n]] = deep[self.right[n]] = deep[n] + 1
        return max(deep)

    def route(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of every row (a right child follows its left one)."""
        return self.step(bins, np.zeros(len(bins), np.int64), self.depth())

    def step(self, bins: np.ndarray, node: np.ndarray, steps: int = 1, out: np.ndarray | None = None) -> np.ndarray:
        """Nodes so many splits below (a node of no split stays); ``out`` may be ``node``."""
        go, bits = self._once(f"go {bins.shape[1]}", lambda: self._go(bins.shape[1]))
        out, rows = node.copy() if out is None else out, min(ROWS, len(bins))
        first = (np.arange(rows) * bins.shape[1]).astype(go.dtype)
        tos, places, bins_at, at_bins = np.empty(rows, go.dtype), np.empty(rows, go.dtype), np.empty(rows, np.int64), np.empty(rows, bins.dtype)
        for at in range(0, len(bins), ROWS):             # a slice of rows stays in the processor's cache
            n = out[at:at + ROWS]
            flat, m = np.ascontiguousarray(bins[at:at + ROWS]).ravel(), len(n)
            to, i, place, v = tos[:m], places[:m], bins_at[:m], at_bins[:m]
            for _ in range(steps):
                go.take(n, mode="clip", out=to)
                np.bitwise_and(to, (1 << bits) - 1, out=i)
                i += first[:m]
                place[:] = i
                flat.take(place, mode="clip", out=v)
                to >>= bits
                to += v
                to >>= 8
                n[:] = to
        return out

    def _go(self, width: int) -> tuple[np.ndarray, int]:
        """Per node its feature in the low bits; above them a number to which the feature's bin (at most 255) is
        added: a bin above the cut carries into the child's number, from the left child to the right one."""
        bits = 8 if width <= 1 << 8 else 16
        f, n = np.asarray(self.feature, np.int64), np.arange(len(self.feature))
        go = np.where(f < 0, n << 8, (np.asarray(self.left) << 8) + 255 - np.asarray(self.cut)) << bits | np.maximum(f, 0)
        small = (len(n) + 1) << 8 + bits < 1 << 31 and ROWS * width < 1 << 31
        return go.astype(np.int32) if small else go, bits


@dataclass
class Model:
    """Boosted trees: margin = base + sum of leaf values (the rate is inside the values)."""
    spec: Spec
    features: list
    edges: list
    base: float = 0.0
    trees: list = field(default_factory=list)
    losses: list = field(default_factory=list)     # validation loss (as integers) after 0, 1, ... trees
    done: bool = False

    def best(self) -> int:
        """Trees up to the least validation loss; all without validation rows."""
        return int(np.argmin(self.losses)) if self.losses and self.spec.valid else len(self.trees)

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        z = np.full(len(bins), self.base) if start is None else start.copy()
        for t in self.trees[first:]:
            z += np.asarray(t.value).take(t.route(bins))
        return z

    def final(self) -> "Model":
        return replace(self, trees=self.trees[:self.best()], done=True)

    def gains(self) -> np.ndarray:
        """Share of the total gain by feature."""
        g = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(g, np.maximum(t.feature, 0), np.where(np.asarray(t.feature) >= 0, t.gain, 0.0))
        return g / g.sum() if g.sum() > 0 else g


# --- sums over rows ---------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def role(spec: Spec, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 train, 2 validate, 0 outside, by the two parts of a row."""
    out = np.isin(a, spec.train).astype(np.int8)
    out[(out == 1) & np.isin(b, spec.valid)] = 2
    return out


def sampled(spec: Spec, key: np.ndarray, rnd: int) -> np.ndarray:
    """Rows that a round uses."""
    seed = _mix(np.array([spec.seed * 1_000_003 + rnd + 1], np.uint64))
    # whole numbers below rate * 2^53: the same rows as fractions below the rate
    limit, out = np.uint64(int(np.ceil(spec.subsample * float(1 << 53)))), np.empty(len(key), bool)
    for at in range(0, len(key), ROWS):
        h = _mix(key[at:at + ROWS].view(np.uint64) ^ seed)
        out[at:at + ROWS] = (h >> np.uint64(11)) < limit
    return out


def columns(spec: Spec, n: int, rnd: int) -> np.ndarray:
    """Features that a round uses."""
    k = max(1, int(round(spec.colsample_bytree * n)))
    return np.sort(np.random.default_rng([spec.seed, rnd]).permutation(n)[:k])


def gradients(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-z))
    return np.rint((p - y) * SCALE), np.rint(np.maximum(p * (1 - p), 1e-12) * SCALE)


def loss(y: np.ndarray, z: np.ndarray) -> int:
    return int(np.rint(np.logaddexp(0, np.where(y == 1, -z, z)) * SCALE).sum())


def teams(sizes: Sequence[int], most: int) -> list:
    """Places of features that share a table: the product of a team's sizes is at most ``most`` (or the team has one)."""
    out, cells = [], []
    for j in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        k = next((k for k, c in enumerate(cells) if c * sizes[j] <= most), len(out))
        if k == len(out):
            out.append([])
            cells.append(1)
        out[k].append(j)
        cells[k] *= sizes[j]
    return out


class Codes:
    """Columns of bins joined by team: one number a row for all features of a team."""

    def __init__(self, bins: np.ndarray, sizes: Sequence[int]):
        self.bins, self.sizes, self.known, self.joined = bins, list(sizes), {}, {}

    def teams(self, rows: int, n_slots: int) -> tuple[list, list]:
        """Teams for so many rows and nodes, and the number of cells of each: few for many rows, as every row
        is added once for each (at more cost the less a cache holds), with small tables for many nodes."""
        def cost(found):
            cells = max(found[1]) * len(found[0]) * n_slots
            return rows * len(found[0]) * (7 + 1.5 * max(0.0, np.log2(cells / (1 << 15)))) + 5 * cells
        for most in SHARED:
            if most not in self.known:
                shared = teams(self.sizes, most)
                self.known[most] = shared, [int(np.prod([self.sizes[j] for j in t])) for t in shared]
        return min((self.known[most] for most in SHARED), key=cost)

    def column(self, team: list, cells: int) -> np.ndarray:
        """The joined column of a team."""
        if tuple(team) not in self.joined:
            kind = np.uint8 if cells <= 1 << 8 else np.uint16 if cells <= 1 << 16 else np.int64
            code = np.ascontiguousarray(self.bins[:, team[0]]).astype(kind)
            for j in team[1:]:
                code = code * kind(self.sizes[j]) + self.bins[:, j].astype(kind)           # the first has most bins
            self.joined[tuple(team)] = code
        return self.joined[tuple(team)]


def histogram(bins, g, h, slot, n_slots: int, n_bins: int, cols=None, sizes=None, codes: Codes | None = None) -> np.ndarray:
    """(2, slots, features, bins) exact sums of g and h over the features ``cols`` (of ``sizes`` bins); rows with slot -1 are left out.

    Features share a table by the product of their bins, so that a row is added once for all of a
    team; g and h are added as one complex number (``g`` holds both if ``h`` is None). All are whole
    numbers: sums of sums are exact."""
    cols = np.arange(bins.shape[1]) if cols is None else cols
    codes = codes or Codes(bins, [n_bins] * bins.shape[1] if sizes is None else sizes)
    out, place = np.zeros((2, n_slots, len(cols), n_bins)), {int(f): k for k, f in enumerate(cols)}
    sizes, (shared, cells) = codes.sizes, codes.teams(int(np.count_nonzero(slot >= 0)), n_slots)
    used = [k for k, team in enumerate(shared) if any(j in place for j in team)]
    most, columns = max(cells[k] for k in used), {k: codes.column(shared[k], cells[k]) for k in used}
    tables = {k: np.zeros(n_slots * most, complex) for k in used}
    for at in range(0, len(slot), ROWS):
        s, gh = slot[at:at + ROWS], g[at:at + ROWS]
        if h is not None:
            gh = gh + 1j * h[at:at + ROWS]
        rows = np.flatnonzero(s >= 0)
        if not len(rows):
            continue
        whole = len(rows) == len(s)
        s, gh = (s, gh) if whole else (s.take(rows, mode="clip"), gh.take(rows, mode="clip"))
        s = s.astype(np.int64)
        s *= most
        for k, table in tables.items():
            code = columns[k][at:at + ROWS]
            i = (code if whole else code.take(rows, mode="clip")).astype(np.int64)
            if n_slots > 1:
                i += s
            np.add.at(table, i, gh)
    for k, table in tables.items():
        table = table.reshape(n_slots, most)[:, :cells[k]].reshape(n_slots, *[sizes[j] for j in shared[k]])
        for x, j in enumerate(shared[k]):
            if j in place:
                one = table.sum(axis=tuple(y + 1 for y in range(len(shared[k])) if y != x))
                out[0, :, place[j], :sizes[j]], out[1, :, place[j], :sizes[j]] = one.real, one.imag
    return out


# --- one tree from sums -------------------------------------------------------

def best_splits(hist: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Per slot G, H and the best split's feature (-1: none), cut, gain, left G, left H; in units of 1.
    ``hist`` holds the features ``cols``."""
    out, bins = np.empty((hist.shape[1], 7)), hist.shape[3]
    step = max(1, ROWS // max(1, len(cols) * bins))      # so many slots stay in the processor's cache
    for at in range(0, len(out), step):
        cum = np.cumsum(hist[:, at:at + step], axis=3)
        cum /= SCALE
        total = cum[:, :, 0, -1]
        gl, hl = cum[0], cum[1]
        gr, hr = total[0][:, None, None] - gl, total[1][:, None, None] - hl
        parent = total[0] ** 2 / (total[1] + LAMBDA)
        gain = gl ** 2 / (hl + LAMBDA) + gr ** 2 / (hr + LAMBDA) - parent[:, None, None]
        gain = np.where((hl >= MIN_CHILD) & (hr >= MIN_CHILD), gain, -1.0).reshape(len(gl), -1)
        i, s = gain.argmax(axis=1), np.arange(len(gl))   # ties: first feature, then lowest cut
        f, c = np.divmod(i, bins)
        best = gain[s, i]
        out[at:at + step] = np.stack([total[0], total[1], np.where(best > 1e-9, np.asarray(cols)[f], -1), c, best, gl[s, f, c], hl[s, f, c]], axis=1)
    return out


def merged_splits(found: list) -> np.ndarray:
    """The best splits over all features from those over parts of them."""
    out = found[0]
    for x in found[1:]:
        better = (x[:, 2] >= 0) & ((out[:, 2] < 0) | (x[:, 4] > out[:, 4]) | ((x[:, 4] == out[:, 4]) & (x[:, 2] < out[:, 2])))
        out = np.where(better[:, None], x, out)
    return out


class Finder:
    """Sums of the open nodes over some features, and their best splits.

    Of two sibling nodes only one is summed over rows; the other one's sums are its parent's less those."""

    def __init__(self, cols: np.ndarray):
        self.cols, self.hist = cols, None

    def find(self, asked: np.ndarray, parents=None, right=None) -> np.ndarray:
        """``asked``: sums of the root, or of one child (the ``right`` one or not) of each of the nodes ``parents`` of the last call."""
        hist = asked
        if parents is not None:                          # left and right child of each parent in turn
            hist, place = np.empty((2, 2 * len(parents), *asked.shape[2:])), 2 * np.arange(len(parents)) + right
            hist[:, place], hist[:, place ^ 1] = asked, self.hist[:, parents] - asked
        self.hist = hist
        return best_splits(hist, self.cols)


class Grower:
    """The tree a model is growing: which nodes are open, and what their sums make of them.

    Of two sibling nodes only the lighter one is summed over rows (``ask``); the other one's
    sums are its parent's less those, exactly, since all are whole numbers. A leaf's value
    comes from the sums of the split that made it, so the last level needs no pass."""

    def __init__(self, model: Model, rnd: int):
        self.model, self.rnd, self.tree, self.depth = model, rnd, Tree(), 0
        self.cols = columns(model.spec, len(model.features), rnd)
        self.open, self.ask, self.parents, self.right, self.finder = [0], [0], None, None, Finder(self.cols)

    def slots(self) -> np.ndarray:
        """Place of each node in ``ask``, else -1."""
        at = np.full(len(self.tree.feature), -1)
        at[self.ask] = np.arange(len(self.ask))
        return at

    def _note(self, node: int, g: float, h: float):
        self.tree.cover[node] = h
        self.tree.value[node] = -self.model.spec.learning_rate * g / (h + LAMBDA)

    def take(self, asked: np.ndarray):
        self.split(self.finder.find(asked, self.parents, self.right))

    def split(self, found: np.ndarray):
        """Splits of the open nodes, from :func:`best_splits`."""
        nxt, ask, split_at, right = [], [], [], []
        for s, (node, (g, h, f, cut, gain, gl, hl)) in enumerate(zip(self.open, found.tolist())):
            if self.parents is None:
                self._note(node, g, h)
            if f >= 0 and self.depth < self.model.spec.max_depth:
                l, r = self.tree.split(node, f, cut, gain)
                self._note(l, gl, hl)
                self._note(r, g - gl, h - hl)
                nxt += [l, r]
                right.append(hl > h - hl)
                ask.append(r if right[-1] else l)
                split_at.append(s)
        self.depth += 1
        if self.depth >= self.model.spec.max_depth:
            nxt, ask = [], []
        self.open, self.ask, self.parents, self.right = nxt, ask, np.array(split_at, int), np.array(right, int)

    def finish(self) -> Tree:
        self.model.trees.append(self.tree)
        return self.tree


def note_loss(model: Model, value: int, stop: int):
    """Validation loss after len(trees) trees; decides whether the model goes on."""
    model.losses.append(value)
    n, spec = len(model.trees), model.spec
    stale = bool(spec.valid) and n - int(np.argmin(model.losses)) >= spec.early_stopping_rounds
    model.done = model.done or stale or n >= spec.n_estimators
    return model.done or n >= stop


def base_margin(pos: int, n: int) -> float:
    p = min(max(pos / n if n else 0.5, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


class _Rows:
    """Train and validation rows of one model in one process: their margins, and the nodes they are in.

    Process ``at`` leaves its sums in a part of memory that all share, and finds splits over its share of the features."""

    def __init__(self, model: Model, bins, y, key, r, at: int = 0, shared: Sequence = (None,)):
        self.at, self.shared, self.finder = at, shared, None
        train, valid = np.flatnonzero(r == 1), np.flatnonzero(r == 2)
        self.spec, self.own, self.seen = model.spec, bins[train], bins[valid]
        self.codes = Codes(self.own, [len(e) + 1 for e in model.edges])
        self.key, self.y, self.y_seen = key[train], y[train], y[valid]
        self.z, self.z_seen = model.margins(self.own), model.margins(self.seen)
        n = len(train)
        self.gh, self.rest, self.node, self.slot = np.empty(n, complex), np.empty(n, np.int32), np.empty(n, np.int64), np.empty(n, np.int32)

    def loss(self) -> int:
        at = range(0, len(self.y_seen), ROWS)
        return sum(loss(self.y_seen[i:i + ROWS], self.z_seen[i:i + ROWS]) for i in at)

    def begin(self, rnd: int):
        """The round's rows, their gradients; all at the root."""
        np.subtract(sampled(self.spec, self.key, rnd), 1, out=self.rest, dtype=np.int32)       # -1: not in the round
        for i in range(0, len(self.y), ROWS):
            gh = self.gh[i:i + ROWS]
            gh.real, gh.imag = gradients(self.y[i:i + ROWS], self.z[i:i + ROWS])
        self.node[:] = 0

    def level(self, rnd: int, tree: Tree, slots, asks: int, n_bins: int, cols):
        """Sums of the nodes asked for, of the round's rows."""
        if len(tree.feature) == 1:
            self.begin(rnd)
            self.finder = Finder(cols[self.at::len(self.shared)])
        else:
            tree.step(self.own, self.node, out=self.node)
        slots = slots.astype(np.int32)
        for i in range(0, len(self.node), ROWS):
            slot = self.slot[i:i + ROWS]
            slots.take(self.node[i:i + ROWS], mode="clip", out=slot)
            slot |= self.rest[i:i + ROWS]
        self.sums = histogram(self.own, self.gh, None, self.slot, asks, n_bins, cols, None, self.codes)
        if len(self.shared) > 1:
            np.frombuffer(self.shared[self.at], count=self.sums.size)[:] = self.sums.ravel()

    def find(self, parents, right):
        """Splits over this process's features, from the sums of all."""
        if not len(self.finder.cols):
            return None
        asked = self.sums
        if len(self.shared) > 1:
            parts = [np.frombuffer(x, count=asked.size).reshape(asked.shape)[:, :, self.at::len(self.shared)] for x in self.shared]
            asked = parts[0] + parts[1]
            for x in parts[2:]:
                asked += x
        return self.finder.find(asked, parents, right)

    def end(self, tree: Tree) -> int:
        """Margins with the tree's values; the validation loss."""
        value = np.asarray(tree.value)
        tree.step(self.own, self.node, out=self.node)
        for z, node in ((self.z, self.node), (self.z_seen, tree.route(self.seen))):
            for at in range(0, len(z), ROWS):
                z[at:at + ROWS] += value.take(node[at:at + ROWS], mode="clip")
        return self.loss()


class _Hands:
    """One model's rows dealt to so many processes (this one and its children), which do the same call on their own."""

    def __init__(self, model: Model, bins, y, key, r, n: int):
        ends = np.linspace(0, len(y), n + 1).astype(int)
        self.pipes, self.children = [], []
        # a level asks for half of its nodes; a node that is split has four rows at least
        asks = max(1, min(1 << max(model.spec.max_depth - 2, 0), len(y)))
        size = 16 * asks * len(model.features) * (max(len(e) for e in model.edges) + 1)
        shared = [mmap.mmap(-1, size) if n > 1 else None for _ in range(n)]
        for i, (lo, hi) in enumerate(zip(ends[1:-1], ends[2:]), 1):
            ours, theirs = Pipe()
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", DeprecationWarning)      # threads of Arrow: a child only calls numpy
                child = os.fork()
            if not child:
                try:
                    for p in (*self.pipes, ours):        # so that a child ends with its parent
                        p.close()
                    rows = _Rows(model, bins[lo:hi], y[lo:hi], key[lo:hi], r[lo:hi], i, shared)
                    while True:
                        name, args = pickle.loads(theirs.recv_bytes())
                        theirs.send_bytes(pickle.dumps(getattr(rows, name)(*args), 5))
                except EOFError:
                    os._exit(0)
                except BaseException:
                    traceback.print_exc()
                finally:
                    os._exit(1)
            theirs.close()
            self.pipes.append(ours)
            self.children.append(child)
        self.rows = _Rows(model, bins[:ends[1]], y[:ends[1]], key[:ends[1]], r[:ends[1]], 0, shared)

    def __call__(self, name: str, *args) -> list:
        """What each gives."""
        call = pickle.dumps((name, args), 5) if self.pipes else b""
        for p in self.pipes:
            p.send_bytes(call)
        return [getattr(self.rows, name)(*args), *[pickle.loads(p.recv_bytes()) for p in self.pipes]]

    def close(self):
        for p in self.pipes:
            p.close()
        for child in self.children:
            os.waitpid(child, 0)


def grow_alone(model: Model, bins, y, key, a, b, stop: int, hands: int = 1) -> Model:
    """Rounds of one model up to ``stop`` trees over a table in memory, whose rows are dealt to so many processes."""
    r = role(model.spec, a, b)
    if not model.losses and not model.trees:
        model.base = base_margin(int(y[r == 1].sum()), int((r == 1).sum()))
    n_bins = max(len(e) for e in model.edges) + 1
    hands = _Hands(model, bins, y, key, r, hands)
    try:
        value = sum(hands("loss"))
        while True:
            if len(model.losses) <= len(model.trees):
                if note_loss(model, value, stop):
                    return model
            elif model.done or len(model.trees) >= stop:
                return model
            grower = Grower(model, len(model.trees))
            while grower.open:
                hands("level", grower.rnd, grower.tree, grower.slots(), len(grower.ask), n_bins, grower.cols)
                grower.split(merged_splits([x for x in hands("find", grower.parents, grower.right) if x is not None]))
            value = sum(hands("end", grower.finish()))
    finally:
        hands.close()


# --- the table --------------------------------------------------------------

def edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list:
    """Ascending cut values of each feature from approximate quantiles; x goes to bin #(edges < x)."""
    qs = [i / bins for i in range(1, bins)]
    r = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), qs, 10000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.asarray(x or [0.0], float)) for x in r]


def bin_matrix(cols: list, cuts: list) -> np.ndarray:
    return np.stack([np.searchsorted(e, np.nan_to_num(np.asarray(c, float)), side="left") for c, e in zip(cols, cuts)], axis=1).astype(np.uint8)


def _numbers(c) -> np.ndarray:
    return np.nan_to_num(np.asarray(c.cast(pa.float64()).fill_null(0.0), float))


def _bin_batches(cuts):
    def run(batches):
        for b in batches:
            m = bin_matrix([_numbers(c) for c in b.columns[4:]], cuts)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _packed(m)], ["key", "y", "a", "b", "bins"])
    return run


def binned(df: DataFrame, features: Sequence[str], cuts: list, label: str = "target", key: str = "user_id") -> DataFrame:
    """(key, y, a, b, bins) written once; a and b are md5 parts of the key, bins one byte a feature."""
    k = F.col(f"`{key}`").cast("string")
    src = df.select(F.xxhash64(k).alias("key"), F.col(f"`{label}`").cast("int").alias("y"), md5_mod(k, PARTS).alias("a"),
                    md5_mod(F.concat(k, F.lit("#v")), PARTS).alias("b"), *[F.col(f"`{c}`").cast("double") for c in features])
    path = unique_dir(df.sparkSession, "binned")
    src.where("y IS NOT NULL AND a IS NOT NULL").mapInArrow(_bin_batches(cuts), "key long, y int, a int, b int, bins binary").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _packed(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows' bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _unpacked(column, kind) -> np.ndarray:
    """All values of a binary column, one after the other."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    found = [np.zeros(0, kind)]
    for c in chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset:c.offset + len(c) + 1]
            found.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind))
    return np.concatenate(found[1:] if len(found) > 1 else found)


def arrays(batch, nf: int):
    """(bins, y, key, a, b) of an Arrow batch or table of binned rows."""
    key, y, a, b = (batch.column(i).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(i).to_numpy() for i in range(4))
    return _unpacked(batch.column(4), np.uint8).reshape(-1, nf), y, key, a, b


def _alone_batches(table, models, stop, hands):
    def run(batches):
        data = None
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if data is None:
                    data = arrays(table.value, len(models.value[0].features))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pickle.dumps(grow_alone(models.value[i], *data, stop, hands[i]))], pa.binary())], ["i", "m"])
    return run


def deal_hands(models: list, stop: int, rows: int, slots: int, cores: int) -> list:
    """Processes for each model: of ``slots`` cores what its levels to come ask for, at most the ``cores``
    of an executor and one for every HAND_ROWS rows."""
    work = [m.spec.max_depth * max(min(stop, m.spec.n_estimators) - len(m.trees), 1) for m in models]
    most, out = min(cores, max(1, rows // HAND_ROWS)), [1] * len(models)
    for _ in range(slots - len(models)):
        open_ = [i for i, n in enumerate(out) if n < most]
        if open_:
            out[max(open_, key=lambda i: (work[i] / out[i], -i))] += 1
    return out


def cores_of(sc) -> tuple[int, int]:
    """Cores of the application, and of one executor."""
    slots = sc.defaultParallelism
    executors = 1 if sc.master.startswith("local[") else max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)    # less the driver
    return slots, max(1, int(sc.getConf().get("spark.executor.cores", "0")) or slots // executors)


def share(table: DataFrame, nf: int, local_bytes: int | None = None):
    """The table's rows as a broadcast for models that grow in tasks of their own, its rows counted first; None if it is too large."""
    if table.count() * (nf + 24) > (LOCAL_BYTES if local_bytes is None else local_bytes):
        return None
    return table.sparkSession.sparkContext.broadcast(table.toArrow().combine_chunks())       # sums do not depend on the order of rows


def fit_alone(table: DataFrame, models: list, stop: int, shared=None) -> list:
    """Each model in a task of its own over the broadcast table (of checked size)."""
    sc = table.sparkSession.sparkContext
    bt = shared or share(table, 0, 1 << 62)
    hands = deal_hands(models, stop, table.count(), *cores_of(sc))
    ids = table.sparkSession.range(0, len(models), 1, len(models))
    bm = sc.broadcast(models)
    got = ids.mapInArrow(_alone_batches(bt, bm, stop, hands), "i long, m binary").collect()
    bm.unpersist()
    if not shared:
        bt.unpersist()
    return [pickle.loads(r.m) for r in sorted(got, key=lambda r: r.i)]


BLOCK_COLUMNS = {"key": np.int64, "y": np.int32, "a": np.int32, "b": np.int32, "bins": np.uint8, "z": np.float64}
BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in BLOCK_COLUMNS)


def _block(bins, y, key, a, b, z=None) -> pa.RecordBatch:
    """Many rows as one row of packed columns."""
    z = np.zeros(0) if z is None else z
    packed = [np.ascontiguousarray(v, kind).tobytes() for v, kind in zip((key, y, a, b, bins, z), BLOCK_COLUMNS.values())]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in packed], list(BLOCK_COLUMNS))


def _blocks(batches, nf: int):
    """(bins, y, key, a, b, z by model) of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            key, y, a, b, bins, z = (np.frombuffer(c[i].as_py(), kind) for c, kind in zip(batch.columns, BLOCK_COLUMNS.values()))
            yield bins.reshape(-1, nf), y, key, a, b, z.reshape(-1, len(y))


def _pack_batches(nf: int):
    def run(batches):
        some, n = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(arrays(batch, nf))
                n += batch.num_rows
            if n >= BLOCK:
                yield _block(*[np.concatenate(v) for v in zip(*some)])
                some, n = [], 0
        if n:
            yield _block(*[np.concatenate(v) for v in zip(*some)])
    return run


def pack(table: DataFrame, nf: int, n_models: int, n: int) -> DataFrame:
    """The table's rows in blocks, written once, in parts of about TASK_BYTES (one per core at least)."""
    parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-n * (nf + 20 + 8 * n_models) // TASK_BYTES))
    path = unique_dir(table.sparkSession, "blocks")
    table.repartition(parts).mapInArrow(_pack_batches(nf), BLOCK_SCHEMA).write.parquet(path)
    return table.sparkSession.read.parquet(path)


def _newest(model: Model, kept: int) -> Model:
    """What a task needs of a model whose first ``kept`` trees are in the table's margins."""
    return replace(model, edges=[], losses=[], trees=model.trees[kept:])


def _level_batches(bc, nf: int, sizes: list, kept: int):
    """Rows (model, at, v): sums of one level, place by place; place -1: validation loss."""
    def run(batches):
        work, n_bins = bc.value, max(sizes)
        sums = {i: np.zeros((2, asks, len(cols), n_bins)) for i, _, _, _, _, cols, asks, _ in work}
        losses = {i: 0 for i, *_ in work}
        for bins, y, key, a, b, z0 in _blocks(batches, nf):
            for i, m, rnd, tree, slots, cols, asks, first in work:
                r = role(m.spec, a, b)
                use = np.flatnonzero((r == 1) & sampled(m.spec, key, rnd))
                if first:
                    valid = np.flatnonzero(r == 2)
                    losses[i] += loss(y[valid], m.margins(bins[valid], z0[i, valid] if kept else None))
                own = bins[use]
                g, h = gradients(y[use], m.margins(own, z0[i, use] if kept else None))
                sums[i] += histogram(own, g, h, slots[tree.route(own)], asks, n_bins, cols, sizes)
        for i, *_ in work:
            flat = sums[i].ravel()
            at = np.flatnonzero(flat)
            at_all, v = np.append(at, -1), np.append(flat[at].astype(np.int64), losses[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(at_all), pa.array(v)], ["model", "at", "v"])
    return run


def _margin_batches(bc, nf: int, kept: int):
    def run(batches):
        for bins, y, key, a, b, z0 in _blocks(batches, nf):
            yield _block(bins, y, key, a, b, np.stack([m.margins(bins, z0[i] if kept else None) for i, m in enumerate(bc.value)]))
    return run


def fit_grouped(table: DataFrame, models: list, stop: int) -> list:
    """All models level by level; each pass is one grouped aggregate over the table."""
    spark = table.sparkSession
    sc, nf = spark.sparkContext, len(models[0].features)
    sizes = [len(e) + 1 for e in models[0].edges]
    n_bins = max(sizes)
    for m in models:
        if not m.losses and not m.trees:
            r = table.where(F.col("a").isin(list(m.spec.train)) & ~F.col("b").isin(list(m.spec.valid or (-1,)))).agg(F.sum("y"), F.count("y")).first()
            m.base = base_margin(r[0] or 0, r[1])
    src, kept = pack(table, nf, len(models), table.count()), 0
    while True:
        growers = {i: Grower(m, len(m.trees)) for i, m in enumerate(models) if (not m.done and len(m.trees) < stop) or len(m.losses) <= len(m.trees)}
        first = {i: len(models[i].losses) <= len(models[i].trees) for i in growers}
        level = 0
        while any(g.open for g in growers.values()):
            work = [(i, g, level == 0 and first[i]) for i, g in growers.items() if g.open]
            bc = sc.broadcast([(i, _newest(g.model, kept), g.rnd, g.tree, g.slots(), g.cols, len(g.ask), x) for i, g, x in work])
            rows = src.mapInArrow(_level_batches(bc, nf, sizes, kept), "model int, at long, v long")
            got = rows.groupBy("model", "at").agg(F.sum("v").alias("v")).toArrow()      # models x nodes x features x bins sums
            bc.unpersist()
            model, at, v = (got.column(c).to_numpy() for c in range(3))
            for i, g, with_loss in work:
                own = model == i
                if with_loss and note_loss(models[i], int(v[own & (at == -1)].sum()), stop):
                    del growers[i]
                    continue
                hist = np.zeros((2, len(g.ask), len(g.cols), n_bins))
                hist.ravel()[at[own & (at >= 0)]] = v[own & (at >= 0)]
                g.take(hist)
            level += 1
        if not growers:
            return models
        for g in growers.values():
            g.finish()
        trees = max(len(m.trees) for m in models)
        if trees - kept >= REWRITE and all(len(m.trees) >= trees or m.done for m in models):
            path = unique_dir(spark, "margins")
            bc = sc.broadcast([_newest(m, kept) for m in models])
            src.mapInArrow(_margin_batches(bc, nf, kept), BLOCK_SCHEMA).write.parquet(path)
            src, kept = spark.read.parquet(path), trees


def start(specs: Sequence[Spec], features: Sequence[str], cuts: list) -> list:
    return [Model(s, list(features), cuts) for s in specs]


def fit_models(table: DataFrame, models: list, stop: int | None = None, local_bytes: int = LOCAL_BYTES, shared=None) -> list:
    """Grow all models up to ``stop`` trees (their own number by default); they may be grown on later.
    ``shared``: the rows of a table that several calls use, from :func:`share`."""
    stop = stop or max(m.spec.n_estimators for m in models)
    if shared is not None:
        return fit_alone(table, models, stop, shared)
    size = table.count() * (len(models[0].features) + 24)
    return (fit_alone if size <= local_bytes else fit_grouped)(table, models, stop)


# --- scoring ----------------------------------------------------------------

def margins(df: DataFrame, models: list, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of every row plus ``z``, the array of the models' margins."""
    bc = df.sparkSession.sparkContext.broadcast(models)
    feats = models[0].features

    def run(batches):
        for b in batches:
            ms = bc.value
            bins = bin_matrix([_numbers(c) for c in b.columns[1:]], ms[0].edges)
            z = [m.margins(bins) for m in ms]
            flat = pa.array(np.stack(z, axis=1).ravel())
            ends = pa.array(np.arange(0, len(flat) + 1, len(z), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], ["row", "z"])
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(feats)])
    out = StructType([src.schema["row"], StructField("z", ArrayType(DoubleType()))])
    return src.mapInArrow(run, out).select("row.*", "z")
