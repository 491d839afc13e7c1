"""Gradient-boosted regression trees, many fits at once.

A backtest fits the same trees on many training windows. Here all fits grow together: each level of each
round is one pass over the rows of all fits. A task counts, for every fit, the rows and gradients of its rows
by (node, feature, bin); the partial histograms of a fit are added up in a shuffle by fit, and the same
reducer chooses the splits of the level. So 50 rounds of depth 5 are 250 passes, however many fits there are,
and only splits, a few numbers a node, reach the driver.

* Bins are cut by a mergeable quantile summary for each fit and feature, made in the tasks from training rows
  alone (``quantiles``).
* Of two siblings only the smaller is counted; the other is the parent's histogram less that one.
* Missing values have a bin of their own, and both ways of sending it are scored at each split.
* Each tree sees a share of the rows, by a hash of the row and the round, and a share of the features.
* Gradients are whole numbers (residuals in units of about 2^-30 of the largest label), so sums do not depend
  on the order in which partial histograms meet, and a fit gives the same trees on any cluster.

The rows of a fit are kept in blocks, a few columns of bytes (bins, label, prediction), written to the
shared folder every ``write_every`` rounds; trees since then are applied on the way. Histograms of a level
are persisted until their round ends, with their lineage, so a lost executor costs at most one round.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quantiles import EMPTY, compressed, cuts, merged, summary
from tidemark.sources.tables import scratch

#: Rows of a block, points of a partial summary and of a merged one, bytes of histograms that a task gathers.
BLOCK_ROWS = 2048
PARTIAL_POINTS = 1024
MERGED_POINTS = 16_384
GATHERED_BYTES = 64 << 20
#: Labels are added up in units of 2^-20 for their mean.
LABEL_UNIT = 1 << 20


@dataclass(frozen=True)
class Settings:
    rounds: int = 50
    depth: int = 5
    rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    min_child: int = 5
    penalty: float = 1.0
    bins: int = 64
    seed: int = 41
    write_every: int = 5


@dataclass(frozen=True)
class Fit:
    """What one model learns from: feature columns, the column of its label (NULL: not a training row), first and last training date (None: no end)."""

    features: tuple[str, ...]
    label: str
    first: date | None = None
    last: date | None = None


@dataclass
class Trees:
    """Trees as arrays (round, node) over a heap of nodes; ``feature`` is -1 at leaves. ``cut`` is the largest value that goes left."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, rounds: int, depth: int) -> Trees:
        shape = (rounds, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape))

    def part(self, first: int, last: int) -> Trees:
        return Trees(*[a[first:last] for a in (self.feature, self.cut, self.missing_left, self.value, self.gain)])


@dataclass
class Booster:
    """A fitted model: the mean label and trees over features in their order."""

    features: tuple[str, ...]
    base: float
    trees: Trees

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        values = np.array(columns, float)
        out = np.full(values.shape[1], self.base)
        for k in range(len(self.trees.feature)):
            out += self.trees.value[k][_routed(self.trees, k, values, np.isnan(values))]
        return out

    def gains(self) -> dict[str, float]:
        """Gain of all splits, by feature."""
        inner = self.trees.feature >= 0
        total = np.bincount(self.trees.feature[inner], weights=self.trees.gain[inner], minlength=len(self.features))
        return dict(zip(self.features, total.tolist(), strict=True))

    def save(self, spark: SparkSession, path: str) -> None:
        """A row a node, and one (round -1) for the mean and the features."""
        t = self.trees
        rows = [(-1, 0, -1, self.base, False, 0.0, 0.0, list(self.features))]
        rows += [(r, n, int(t.feature[r, n]), float(t.cut[r, n]), bool(t.missing_left[r, n]), float(t.value[r, n]), float(t.gain[r, n]), None) for r, n in np.ndindex(*t.feature.shape)]
        spark.createDataFrame(rows, SAVED).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Booster:
        rows = spark.read.schema(SAVED).parquet(path).collect()  # as many as the model has nodes
        head = next(r for r in rows if r["round"] == -1)
        nodes = [r for r in rows if r["round"] >= 0]
        shape = (1 + max((r["round"] for r in nodes), default=-1), 1 + max((r["node"] for r in nodes), default=-1))
        trees = Trees(np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape))
        for r in nodes:
            at = (r["round"], r["node"])
            trees.feature[at], trees.cut[at], trees.missing_left[at], trees.value[at], trees.gain[at] = r["feature"], r["cut"], r["missing_left"], r["value"], r["gain"]
        return cls(tuple(head["features"]), head["cut"], trees)


SAVED = "round int, node int, feature int, cut double, missing_left boolean, value double, gain double, features array<string>"


def _routed(trees: Trees, k: int, values: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Node in which each row of ``values`` (feature, row) ends."""
    feature, node, every = trees.feature[k], np.zeros(values.shape[1], np.int32), np.arange(values.shape[1])
    while True:
        split = feature[node]
        inner = split >= 0
        if not inner.any():
            return node
        at = np.where(inner, split, 0)
        left = np.where(missing[at, every], trees.missing_left[k][node], values[at, every] <= trees.cut[k][node])
        node = np.where(inner, 2 * node + 2 - left, node)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit keys."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn_rows(keys: np.ndarray, number: int, settings: Settings) -> np.ndarray:
    """Which rows a round's tree sees."""
    if settings.subsample >= 1:
        return np.ones(len(keys), bool)
    salt = mixed(np.array([settings.seed * 1_000_003 + number + 1]))
    return (mixed(keys.astype(np.uint64) ^ salt) >> np.uint64(11)) < np.uint64(int(settings.subsample * (1 << 53)))


def drawn_features(n: int, number: int, settings: Settings) -> np.ndarray:
    """Which features a round's tree sees, in order."""
    held = max(1, round(n * settings.colsample))
    return np.sort(np.random.default_rng((settings.seed, number)).permutation(n)[:held])


def unit(largest: float) -> float:
    """Units of a gradient in one of the label: about 2^30 in the largest residual."""
    return 2.0 ** (30 - math.ceil(math.log2(2 * largest))) if largest > 0 else 1.0


@dataclass
class Splits:
    """The best split of each node of a level; feature -1 where none helps."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    total: np.ndarray


def best_splits(hist: np.ndarray, settings: Settings) -> Splits:
    """From histograms (node, feature, bin, gradient and rows), the last bin being that of missing values. Of equal gains the first feature, bin, and missing to the left count."""
    total = hist[:, 0].sum(axis=1)
    upto = np.cumsum(hist[:, :, :-1], axis=2)
    left = np.stack([upto + hist[:, :, -1:], upto], axis=3)  # (node, feature, bin, missing left or right, gradient and rows)
    right = total[:, None, None, None, :] - left
    score = lambda part: part[..., 0].astype(float) ** 2 / (part[..., 1] + settings.penalty)
    gain = score(left) + score(right) - score(total)[:, None, None, None]
    gain = np.where((left[..., 1] >= settings.min_child) & (right[..., 1] >= settings.min_child), gain, 0.0)
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(axis=1)
    feature, cut, way = np.unravel_index(best, gain.shape[1:])
    every = np.arange(len(hist))
    found = flat[every, best]
    return Splits(np.where(found > 0, feature, -1), cut, way == 0, found, left[every, feature, cut, way], total)


@dataclass
class _Growing:
    """One fit while it grows, on the driver: small tables only."""

    fit: Fit
    settings: Settings
    base: float
    unit: float
    edges: list[np.ndarray]
    trees: Trees
    active: list[int] = field(default_factory=list)
    built: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)

    def start(self) -> None:
        self.active, self.built, self.parents = [0], [0], []

    def take(self, number: int, found: dict) -> None:
        """Enter a level's splits into the tree and make out which nodes to count next."""
        trees, s = self.trees, self.settings
        worth = lambda pair: s.rate * (pair[0] / self.unit) / (pair[1] + s.penalty)
        chosen = drawn_features(len(self.fit.features), number, s)
        nodes, counted, built = self.active, [], []
        for k, node in enumerate(nodes):
            total, left = found["total"][k], found["left"][k]
            if node == 0:
                trees.value[number, 0] = worth(total)
            if found["feature"][k] < 0:
                continue
            feature = int(chosen[found["feature"][k]])
            edges = self.edges[feature]
            trees.feature[number, node] = feature
            # Beyond the last cut only missing values are apart from the rest.
            trees.cut[number, node] = edges[found["bin"][k]] if found["bin"][k] < len(edges) else np.inf
            trees.missing_left[number, node] = found["missing_left"][k]
            trees.gain[number, node] = found["gain"][k] / self.unit**2
            right = (total[0] - left[0], total[1] - left[1])
            trees.value[number, 2 * node + 1], trees.value[number, 2 * node + 2] = worth(left), worth(right)
            counted += [2 * node + 1, 2 * node + 2]
            built.append(2 * node + 1 if left[1] <= right[1] else 2 * node + 2)
        self.parents, self.active, self.built = nodes, counted, built


STATE = "fit int, bins binary, label binary, prediction binary, row_keys binary"
PARTS = "fit int, parent boolean, hist binary"
LEVEL = "fit int, feature array<int>, bin array<int>, missing_left array<boolean>, gain array<double>, left array<array<long>>, total array<array<long>>, hist binary"
_ARROW_LEVEL = [("fit", pa.int32()), ("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())), ("missing_left", pa.list_(pa.bool_())), ("gain", pa.list_(pa.float64())), ("left", pa.list_(pa.list_(pa.int64()))), ("total", pa.list_(pa.list_(pa.int64()))), ("hist", pa.binary())]


def _training(batch: pa.RecordBatch, fits: list[Fit]) -> Iterator[tuple[int, Fit, np.ndarray, np.ndarray]]:
    """For each fit with rows in the batch: its number, itself, which rows, and all labels."""
    number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    labels = {name: number(name).astype(float) for name in {f.label for f in fits}}
    days = batch.column("day").to_pandas().to_numpy(dtype=float)
    known = {name: ~np.isnan(label) for name, label in labels.items()}
    epoch = date(1970, 1, 1)
    for k, f in enumerate(fits):
        rows = known[f.label]
        if f.first is not None:
            rows = rows & (days >= (f.first - epoch).days)
        if f.last is not None:
            rows = rows & (days <= (f.last - epoch).days)
        if rows.any():
            yield k, f, rows, labels[f.label]


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {name: batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in names}


def _all_features(fits: list[Fit]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(name for f in fits for name in f.features))


def _summaries(fits: list[Fit]):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows_out = _columns(batch, _all_features(fits)), []
            for k, f, rows, label in _training(batch, fits):
                y = label[rows]
                total = sum(np.rint(y * LABEL_UNIT).astype(int).tolist())
                parts = [compressed(summary(values[name][rows]), PARTIAL_POINTS) for name in f.features]
                rows_out.append((k, len(y), float(np.abs(y).max()), str(total), [p.tobytes() for p, _ in parts], [w.tobytes() for _, w in parts]))
            names = ("fit", "n", "largest", "total", "points", "weights")
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows_out], kind) for c, kind in enumerate(kinds)], names=list(names))

    return summarise


SUMMARIES = "fit int, n long, largest double, total string, points array<binary>, weights array<binary>"
STARTS = "fit int, n long, largest double, total string, edges array<binary>"


def _edges(fits: list[Fit], bins: int):
    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key[0].as_py()
        n, largest, total, held = 0, 0.0, 0, [EMPTY] * len(fits[k].features)
        for batch in batches:
            for r in batch.to_pylist():
                n, largest, total = n + r["n"], max(largest, r["largest"]), total + int(r["total"])
                for c, (p, w) in enumerate(zip(r["points"], r["weights"], strict=True)):
                    held[c] = compressed(merged([held[c], (np.frombuffer(p), np.frombuffer(w))]), MERGED_POINTS)
        edges = [cuts(h, bins).tobytes() for h in held]
        arrays = [pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([largest]), pa.array([str(total)]), pa.array([edges], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["fit", "n", "largest", "total", "edges"])

    return merge


def _blocks(fits: list[Fit], sent, bins: int):
    """Rows of each fit as bytes: a bin for each feature and row, labels, predictions, keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growing = sent.value
        for batch in batches:
            values, out = _columns(batch, _all_features(fits)), []
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            for k, f, rows, label in _training(batch, fits):
                base, edges = growing[k]
                coded = np.empty((len(f.features), int(rows.sum())), np.uint8)
                for c, name in enumerate(f.features):
                    v = values[name][rows]
                    coded[c] = np.where(np.isnan(v), bins, np.searchsorted(edges[c], v, side="left"))
                y = label[rows]
                out.append((k, coded.tobytes(), y.tobytes(), np.full(len(y), base).tobytes(), keys[rows].tobytes()))
            yield _packed(out)

    return pack


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["fit", "bins", "label", "prediction", "row_keys"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        fit, bins, label, prediction, keys = (batch.column(c)[k] for c in ("fit", "bins", "label", "prediction", "row_keys"))
        y = np.frombuffer(label.as_buffer())
        yield fit.as_py(), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, len(y)), y, np.frombuffer(prediction.as_buffer()), np.frombuffer(keys.as_buffer(), np.int64)


def _in_bins(trees: Trees, edges: list[np.ndarray]) -> Trees:
    """The same trees with cuts as numbers of bins."""
    cut = np.zeros_like(trees.cut)
    for r, n in np.argwhere(trees.feature >= 0):
        own = edges[trees.feature[r, n]]
        cut[r, n] = np.searchsorted(own, trees.cut[r, n], side="left")
    return Trees(trees.feature, cut, trees.missing_left, trees.value, trees.gain)


def _ways(trees: Trees, k: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree whose cuts are numbers of bins, as tables: the feature that a node asks and the node that follows, by (node, bin). Leaves follow themselves."""
    inner, every = trees.feature[k] >= 0, np.arange(trees.feature.shape[1])
    left = np.arange(bins + 1) <= trees.cut[k][:, None]
    left[:, bins] = trees.missing_left[k]
    following = np.where(inner[:, None], 2 * every[:, None] + 2 - left, every[:, None])
    return np.where(inner, trees.feature[k], 0).astype(np.int64), following.astype(np.int64).ravel()


def _followed(ways: tuple[np.ndarray, np.ndarray], coded: np.ndarray, steps: int, bins: int) -> np.ndarray:
    """Node that each row of ``coded`` (feature, row; not spread in memory) has reached after so many steps."""
    feature, following = ways
    n, flat = coded.shape[1], coded.ravel()
    every, node = np.arange(n), np.zeros(n, np.int64)
    for _ in range(steps):
        node = following.take(node * (bins + 1) + flat.take(feature.take(node) * n + every))
    return node


def _applied(prediction: np.ndarray, pending: list[tuple], coded: np.ndarray, settings: Settings) -> np.ndarray:
    out = prediction.copy()
    for ways, value in pending:
        out += value.take(_followed(ways, coded, settings.depth, settings.bins))
    return out


def _pending(trees: Trees, settings: Settings) -> list[tuple]:
    return [(_ways(trees, k, settings.bins), trees.value[k]) for k in range(len(trees.feature))]


def _histograms(sent, number: int, settings: Settings):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, held, size, tables = sent.value, {}, 0, {}

        def flushed() -> pa.RecordBatch:
            arrays = [pa.array(list(held), pa.int32()), pa.array([False] * len(held)), pa.array([h.tobytes() for h in held.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["fit", "parent", "hist"])

        for batch in batches:
            for k, coded, y, prediction, keys in _unpacked(batch):
                if k not in plan:
                    continue
                pending, current, built, step = plan[k]
                if k not in tables:
                    tables[k] = (_pending(pending, settings), _ways(current, 0, settings.bins))
                before, ways = tables[k]
                node = _followed(ways, coded, (built[-1] + 1).bit_length() - 1, settings.bins)
                slot = np.full(len(current.feature[0]), -1)
                slot[built] = np.arange(len(built))
                rows = np.flatnonzero(slot.take(node) >= 0)
                rows = rows[drawn_rows(keys[rows], number, settings)]
                if len(rows) == 0:
                    continue
                # Only rows that count here need the trees since the last writing.
                coded, node = coded.take(rows, axis=1), node.take(rows)
                gradient = np.rint((y.take(rows) - _applied(prediction.take(rows), before, coded, settings)) * step)
                chosen = drawn_features(len(coded), number, settings)
                if k not in held:
                    held[k] = np.zeros((len(built), len(chosen), settings.bins + 1, 2), np.int64)
                    size += held[k].nbytes
                place, cells = slot.take(node) * (settings.bins + 1), len(built) * (settings.bins + 1)
                for c, feature in enumerate(chosen):
                    at = place + coded[feature]
                    held[k][:, c, :, 0] += np.bincount(at, weights=gradient, minlength=cells).astype(np.int64).reshape(len(built), -1)
                    held[k][:, c, :, 1] += np.bincount(at, minlength=cells).reshape(len(built), -1)
                if size > GATHERED_BYTES:
                    yield flushed()
                    held.clear()
                    size = 0
        if held:
            yield flushed()

    return count


def _levels(sent, number: int, settings: Settings):
    """Adds up a fit's histograms, works out the uncounted siblings, and chooses splits."""

    def choose(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key[0].as_py()
        if k not in sent.value:  # nothing of the fit was split at the level above
            return
        active, built, parents, n_features = sent.value[k]
        shape = (-1, len(drawn_features(n_features, number, settings)), settings.bins + 1, 2)
        above, counted = None, 0
        for batch in batches:
            for parent, hist in zip(batch.column("parent").to_pylist(), batch.column("hist"), strict=True):
                one = np.frombuffer(hist.as_buffer(), np.int64).reshape(shape)
                if parent:
                    above = one
                else:
                    counted = counted + one
        place = {node: j for j, node in enumerate(built)}
        over = {node: j for j, node in enumerate(parents)}
        full = [counted[place[n]] if n in place else above[over[(n - 1) // 2]] - counted[place[n + 1 if n % 2 else n - 1]] for n in active]
        hist = np.stack(full)
        s = best_splits(hist, settings)
        row = {"fit": k, "feature": s.feature, "bin": s.bin, "missing_left": s.missing_left, "gain": s.gain, "left": s.left, "total": s.total}
        row = {c: v.tolist() if isinstance(v, np.ndarray) else v for c, v in row.items()} | {"hist": hist.tobytes()}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema(_ARROW_LEVEL))

    return choose


def _updated(sent, settings: Settings):
    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for batch in batches:
            rows = []
            for k, coded, y, prediction, keys in _unpacked(batch):
                if k not in tables:
                    tables[k] = _pending(sent.value[k], settings)
                rows.append((k, coded.tobytes(), y.tobytes(), _applied(prediction, tables[k], coded, settings).tobytes(), keys.tobytes()))
            yield _packed(rows)

    return update


class _Folder:
    """Tables of one call in the shared folder; all are removed at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.number = spark, f"{scratch(spark)}/boosting-{uuid.uuid4().hex}", 0

    def write(self, rows: DataFrame, replaces: str | None = None) -> tuple[DataFrame, str]:
        self.number += 1
        path = f"{self.path}/{self.number}"
        rows.write.parquet(path)
        if replaces is not None:
            self.remove(replaces)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def remove(self, path: str | None = None) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or self.path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _grow(state: DataFrame, growing: list[_Growing], settings: Settings, number: int, written: int) -> None:
    """One tree for each fit, level by level."""
    context = state.sparkSession.sparkContext
    pending = [_in_bins(g.trees.part(written, number), g.edges) for g in growing]
    above, levels, held = None, [], []
    for g in growing:
        g.start()
    for _ in range(settings.depth):
        live = [k for k, g in enumerate(growing) if g.active]
        if not live:
            break
        tasks = context.broadcast({k: (pending[k], _in_bins(growing[k].trees.part(number, number + 1), growing[k].edges), growing[k].built, growing[k].unit) for k in live})
        plans = context.broadcast({k: (growing[k].active, growing[k].built, growing[k].parents, len(growing[k].fit.features)) for k in live})
        held += [tasks, plans]
        parts = state.mapInArrow(_histograms(tasks, number, settings), PARTS)
        if above is not None:
            parts = parts.unionByName(above.select("fit", F.lit(True).alias("parent"), "hist"))
        # A row a fit comes back, whatever the data's size: more tasks than fits would stay empty, level after level.
        dealt = parts.repartition(min(len(live), context.defaultParallelism), "fit")
        above = dealt.groupBy("fit").applyInArrow(_levels(plans, number, settings), LEVEL).persist()
        levels.append(above)
        found = {r["fit"]: r for r in above.drop("hist").collect()}
        for k in live:
            growing[k].take(number, found[k].asDict())
    for level in levels:
        level.unpersist()
    for sent in held:
        sent.destroy()


def fit_boosters(rows: DataFrame, fits: list[Fit], settings: Settings = Settings(), day: str = "forecast_date") -> list[Booster | None]:
    """A booster for each fit, or None where it has no training row.

    Rows are told apart, for sampling, by a hash of region, target and date, or of all columns where there are
    none of these, so a fit's trees do not depend on what is fitted beside it.
    """
    spark = rows.sparkSession
    names = _all_features(fits)
    labels = tuple(dict.fromkeys(f.label for f in fits))
    wanted = [*[F.col(n).cast("double").alias(n) for n in names], *[F.col(n).cast("double").alias(n) for n in labels if n not in names]]
    identity = [c for c in ("region_id", "target_timestamp_utc", day) if c in rows.columns] or rows.columns
    dated = F.unix_date(F.to_date(day)) if day in rows.columns else F.lit(None).cast("int")
    used = rows.select(F.xxhash64(*identity).alias("key"), dated.alias("day"), *wanted)
    folder = _Folder(spark)
    try:
        kept, place = folder.write(used.filter(F.coalesce(*labels).isNotNull()))
        blocks = kept.repartition(max(1, -(-kept.count() // BLOCK_ROWS)), "key")
        starts = blocks.mapInArrow(_summaries(fits), SUMMARIES).groupBy("fit").applyInArrow(_edges(fits, settings.bins), STARTS)
        growing: dict[int, _Growing] = {}
        for r in starts.collect():  # a row a fit: its cuts
            f, base = fits[r["fit"]], int(r["total"]) / r["n"] / LABEL_UNIT
            growing[r["fit"]] = _Growing(f, settings, base, unit(r["largest"]), [np.frombuffer(e) for e in r["edges"]], Trees.of(settings.rounds, settings.depth))
        sent = spark.sparkContext.broadcast({k: (g.base, g.edges) for k, g in growing.items()})
        state, at = folder.write(blocks.mapInArrow(_blocks(fits, sent, settings.bins), STATE), place)
        sent.destroy()
        order = sorted(growing)
        every = [growing[k] for k in order]
        if order != list(range(len(fits))):  # numbers of fits without rows are left out
            state = state.withColumn("fit", (F.array_position(F.array(*map(F.lit, order)), F.col("fit")) - 1).cast("int")) if order else state
        written = 0
        for number in range(settings.rounds if order else 0):
            if number - written == settings.write_every:
                sent = spark.sparkContext.broadcast([_in_bins(g.trees.part(written, number), g.edges) for g in every])
                state, at = folder.write(state.mapInArrow(_updated(sent, settings), STATE), at)
                sent.destroy()
                written = number
            _grow(state, every, settings, number, written)
        return [Booster(f.features, growing[k].base, growing[k].trees) if k in growing else None for k, f in enumerate(fits)]
    finally:
        folder.remove()


def predicted(boosters: dict[int, Booster], which: Column, features: tuple[str, ...], spark: SparkSession) -> Column:
    """Prediction of the booster that ``which`` numbers, NULL for a number that is not there. All boosters read the same features."""
    sent = spark.sparkContext.broadcast(boosters)

    @F.pandas_udf("double")
    def score(number: pd.Series, *columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
        out = np.full(len(number), np.nan)
        for k in number.dropna().unique():
            booster = sent.value.get(int(k))
            if booster is not None:
                mine = (number == k).to_numpy(dtype=bool, na_value=False)
                out[mine] = booster.predict([v[mine] for v in values])
        return pd.Series(out)  # what is no number becomes NULL

    return score(which.cast("int"), *[F.col(f).cast("double") for f in features])
