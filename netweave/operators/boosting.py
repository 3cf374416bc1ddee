"""Multiclass gradient boosting over histograms, all classes, folds and parameter sets at once.

One model has one tree per class and round, all under one softmax loss. Features are cut at exact quantiles once
and rows are kept as chunks of bin numbers, with the margins of every model (``Fit``) beside them.

A level of all trees of all models is one aggregation: tasks sum gradients, hessians and rows per model, class, node,
feature and bin; the sums are added up per model and class, where each node's best split is chosen; the driver
sees the splits, whose number depends on the trees, not on the rows. A node of at most ``FINISH`` rows needs
no further levels of its own: such nodes are put together to batches of at most ``FINISH`` rows, the rows are dealt out
by batch once, and what lies below each node is grown where its rows meet. Many rows thus take one job per level while nodes are
large, and few rows one job per round. Sums are of whole numbers (gradients in steps of 2**-24), so they are
the same in any order and both ways give the same trees. A search over many models of a small table (``tallies``) grows each
model in a task of its own.

Row samples of a round and column samples of a tree come from hashes, so every run agrees. Margins pass from round to
round as cached chunks and are written to the shared folder every ``WRITE_ROUNDS`` rounds, so a lost
executor repeats a few rounds at most.

Splits follow the second-order gain with L1 and L2: with T(G) = G shrunk by ``alpha`` towards 0, a node is worth
T(G)**2 / (H + ridge); a split must gain more than ``gamma``, each side's H must reach ``child_weight``, and a
leaf adds -rate * T(G) / (H + ridge) to its class. Ties go to the first feature and the lowest cut.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.constants import BOOSTING, CLASSES, SPLIT_SEED
from netweave.functions.scalars import col_of
from netweave.operators.clean import finite_features, scorable_rows
from netweave.operators.selection import quantile_cuts
from netweave.session import discard, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS, CHUNK, FINISH, WRITE_ROUNDS, FAN = 64, 1 << 15, 1 << 15, 20, 32
#: Bytes of binned rows up to which a table is sent to the tasks of many models, as a small table of a join is, and
#: bytes of margins up to which models of a larger one are boosted together.
SENT, MARGINS = 1 << 24, 1 << 32
STEP = float(1 << 24)

CHUNKS = "part long, n int, bins binary, target binary, weight binary, held binary, draw binary, margins binary, losses array<double>"
SUMS = "model int, class int, part long, sums binary"
SMALL = "batch int, model int, class int, node int, bins binary, slopes binary"
SPLITS = ("model int, class int, node int, feature int, bin int, gain double, g_left double, h_left double, n_left double, "
          "g_right double, h_right double, n_right double")


@dataclass(frozen=True)
class Fit:
    """One model: rows whose ``held`` number is this one's are kept out of its trees."""

    held: int = 1
    depth: int = BOOSTING["max_depth"]
    rate: float = BOOSTING["learning_rate"]
    subsample: float = BOOSTING["subsample"]
    columns: float = BOOSTING["column_sample"]
    gamma: float = 0.0
    alpha: float = 0.0
    ridge: float = 1.0
    child_weight: float = 1.0


@dataclass
class Grown:
    """What a fit leaves: per round and class a tree, and the losses on the held rows before each round."""

    trees: list[list[dict]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def best(self) -> int:
        """Number of rounds with the least loss; all rounds where none was measured."""
        return int(np.argmin(self.losses)) if self.losses else len(self.trees)


# --- numbers that every task agrees on ----------------------------------------------

def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to below 1 out of 64-bit keys and a salt."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def drawn_columns(features: int, share: float, number: int, kind: int, seed: int) -> np.ndarray:
    """The features a tree may use: those with the smallest draws."""
    most = max(1, int(share * features))
    draws = _spread(np.arange(features), seed + 7919 * (number * 64 + kind + 1))
    return np.sort(np.argsort(draws, kind="stable")[:most])


def drawn_rows(draw: np.ndarray, share: float, number: int, seed: int) -> np.ndarray:
    return _spread(draw, seed + 104_729 * (number + 1)) < share


def shares_of(margins: np.ndarray) -> np.ndarray:
    """Softmax over the first axis."""
    powers = np.exp(margins - margins.max(axis=0))
    return powers / powers.sum(axis=0)


def slopes(margins: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians per class and row, in whole steps."""
    p = shares_of(margins)
    one = np.arange(len(p))[:, None] == target
    g, h = weight * (p - one), np.maximum(2 * weight * p * (1 - p), 1e-16)
    return np.rint(g * STEP), np.rint(h * STEP)


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g: float, h: float, fit: Fit) -> float:
    return float(-fit.rate * _shrunk(g, fit.alpha) / (h + fit.ridge))


def best_splits(sums: np.ndarray, fit: Fit):
    """Per node of sums (g/h/n, node, feature, bin): feature's place, bin, gain, and g, h, n of the left and right side."""
    def worth(a, b):
        return _shrunk(a, fit.alpha) ** 2 / (b + fit.ridge)

    scale = np.array([STEP, STEP, 1.0])[:, None, None]
    left = np.cumsum(sums, axis=3)[..., :-1] / scale[..., None]
    whole = sums[:, :, 0].sum(axis=2)[:, :, None, None] / scale[..., None]
    right = whole - left
    gain = worth(left[0], left[1]) + worth(right[0], right[1]) - worth(whole[0], whole[1])
    gain[(left[1] < fit.child_weight) | (right[1] < fit.child_weight)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    node, place, cut = np.arange(len(gain)), at // gain.shape[2], at % gain.shape[2]
    return place, cut, flat[node, at], *left[:, node, place, cut], *right[:, node, place, cut]


def is_split(gain: np.ndarray, fit: Fit) -> np.ndarray:
    return gain > max(fit.gamma, 1e-9)


@dataclass
class Trees:
    """Trees side by side: (model, class, node) arrays; a node's right child follows its left one."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    heap: list[list[dict[int, int]]]

    def of(self, m: int, c: int) -> dict:
        n = len(self.heap[m][c])
        return {k: getattr(self, k)[m, c, :n].copy() for k in ("feature", "cut", "left", "value", "gain")}


def built(splits: dict[tuple[int, int], dict[int, tuple]], fits: dict[int, Fit], models: int, classes: int) -> Trees:
    """Trees out of splits by heap number (the children of i are 2i + 1 and 2i + 2)."""
    heap = [[{0: 0} for _ in range(classes)] for _ in range(models)]
    for (m, c), of in splits.items():
        places = heap[m][c]
        for i in sorted(of):
            for child in (2 * i + 1, 2 * i + 2):
                places[child] = len(places)
    shape = (models, classes, max(len(p) for of in heap for p in of))
    out = Trees(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape), heap)
    for (m, c), of in splits.items():
        places = heap[m][c]
        for i, (feature, cut, gain, gl, hl, _, gr, hr, _) in of.items():
            at, left = places[i], places[2 * i + 1]
            out.feature[m, c, at], out.cut[m, c, at], out.left[m, c, at], out.gain[m, c, at] = feature, cut, left, gain
            out.value[m, c, left], out.value[m, c, left + 1] = leaf_value(gl, hl, fits[m]), leaf_value(gr, hr, fits[m])
    return out


def walked(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Node where each row ends in each tree; arrays are (tree, node), ``feature`` -1 where there is no split."""
    node = np.zeros((len(feature), bins.shape[1]), np.int32)
    tree, row = np.arange(len(feature))[:, None], np.arange(bins.shape[1])
    while True:
        f = feature[tree, node]
        inner = f >= 0
        if not inner.any():
            return node
        right = bins[np.maximum(f, 0), row] > cut[tree, node]
        node = np.where(inner, left[tree, node] + right, node)


# --- tasks ---------------------------------------------------------------------------

def _binned(cuts: list[np.ndarray], models: int, classes: int):
    """Rows (target, weight, held, draw, features..) to chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(low, CHUNK)
                columns = [c.to_numpy(zero_copy_only=False) for c in piece.columns]
                bins = np.array([np.searchsorted(cut, v) for cut, v in zip(cuts, columns[4:])], np.uint8)
                margins = np.zeros((models, classes, piece.num_rows))
                row = [number, piece.num_rows, bins.tobytes(), columns[0].astype(np.int8).tobytes(), columns[1].astype(np.float64).tobytes(),
                       columns[2].astype(np.int8).tobytes(), columns[3].astype(np.int64).tobytes(), margins.tobytes()]
                number += 1
                row.append([])
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.float64())]
                names = ["part", "n", "bins", "target", "weight", "held", "draw", "margins", "losses"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)
    return run


class _Chunk:
    def __init__(self, batch: pa.RecordBatch, i: int, models: int, classes: int):
        n = batch.column(1)[i].as_py()
        take = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
        self.part = batch.column(0)[i].as_py()
        self.bins = take(2, np.uint8).reshape(-1, n)
        self.target, self.weight, self.held, self.draw = take(3, np.int8), take(4, np.float64), take(5, np.int8), take(6, np.int64)
        self.margins = take(7, np.float64).reshape(models, classes, n)


def _chunks(batches, models, classes) -> Iterator[_Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Chunk(batch, i, models, classes)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "lz4", asbytes=True)


def _sampled(chunk: _Chunk, fits: dict[int, Fit], number: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per model the rows of the chunk that this round's trees see."""
    drawn = {share: drawn_rows(chunk.draw, share, number, seed) for share in {f.subsample for f in fits.values()}}
    for m, fit in fits.items():
        rows = np.flatnonzero((chunk.held != fit.held) & drawn[fit.subsample])
        if len(rows):
            yield m, rows


def _sums(at_slot: np.ndarray, own: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """Sums (g/h/n, slot, feature, bin) of rows (feature, row) by their slot."""
    out = np.empty((3, slots, len(own), bins))
    for f, mine in enumerate(own):
        at = at_slot * bins + mine
        for k, v in enumerate((g, h, None)):
            out[k, :, f] = np.bincount(at, weights=v, minlength=slots * bins).reshape(slots, bins)
    return out


def _level_sums(fits: dict[int, Fit], models: int, classes: int, bins: int, number: int, feature, cut, left,
                slots: dict[tuple[int, int], np.ndarray], seed: int):
    """Sums of a task's chunks per model and class; ``slots`` numbers the open nodes, -1 for others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        part = 0
        for chunk in _chunks(batches, models, classes):
            part = chunk.part
            for m, rows in _sampled(chunk, fits, number, seed):
                wanted = [c for c in range(classes) if (m, c) in slots]
                if not wanted:
                    continue
                g, h = slopes(chunk.margins[m][:, rows], chunk.target[rows], chunk.weight[rows])
                own = chunk.bins[:, rows]
                node = walked(own, feature[m], cut[m], left[m])
                for c in wanted:
                    slot = slots[m, c]
                    at = slot[node[c]]
                    inside = at >= 0
                    columns = drawn_columns(len(own), fits[m].columns, number, c, seed)
                    one = _sums(at[inside], own[columns][:, inside], g[c][inside], h[c][inside], int(slot.max()) + 1, bins)
                    sums[m, c] = sums.get((m, c), 0) + one
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([part] * len(keys), pa.int64()),
            pa.array([_packed(v) for v in sums.values()], pa.binary())], ["model", "class", "part", "sums"])
    return run


def _shape(fit: Fit, features: int, bins: int, number: int, c: int, slot: np.ndarray, seed: int) -> tuple[np.ndarray, tuple]:
    columns = drawn_columns(features, fit.columns, number, c, seed)
    return columns, (3, int(slot.max()) + 1, len(columns), bins)


def _added(table: pa.Table, size: int) -> np.ndarray:
    total = np.zeros(size)
    for blob in table.column("sums"):
        total += np.frombuffer(pa.decompress(blob.as_buffer(), size * 8, "lz4"), np.float64)
    return total


def _merge(fits, features, bins, number, slots, seed):
    """Sums of some parts as those of one."""
    def run(table: pa.Table) -> pa.Table:
        m, c = table.column("model")[0].as_py(), table.column("class")[0].as_py()
        size = int(np.prod(_shape(fits[m], features, bins, number, c, slots[m, c], seed)[1]))
        return table.slice(0, 1).set_column(3, "sums", pa.array([_packed(_added(table, size))], pa.binary()))
    return run


def _told_splits(m: int, c: int, found: list) -> pa.Table:
    n = len(found[0])
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 7]
    return pa.Table.from_arrays(
        [pa.array([m] * n, pa.int32()), pa.array([c] * n, pa.int32()), *[pa.array(np.asarray(v), k) for v, k in zip(found, kinds)]],
        ["model", "class", "node", "feature", "bin", "gain", "g_left", "h_left", "n_left", "g_right", "h_right", "n_right"])


def _choose(fits, features, bins, number, slots, numbers: dict[tuple[int, int], list[int]], seed):
    """Each open node's best split; ``numbers`` are the nodes' heap numbers by slot."""
    def run(table: pa.Table) -> pa.Table:
        m, c = table.column("model")[0].as_py(), table.column("class")[0].as_py()
        columns, shape = _shape(fits[m], features, bins, number, c, slots[m, c], seed)
        place, cut, gain, *sides = best_splits(_added(table, int(np.prod(shape))).reshape(shape), fits[m])
        some = is_split(gain, fits[m])
        return _told_splits(m, c, [np.array(numbers[m, c])[some], columns[place[some]], cut[some], gain[some], *[v[some] for v in sides]])
    return run


def _small_rows(fits: dict[int, Fit], models: int, classes: int, number: int, feature, cut, left,
                small: dict[tuple[int, int], dict[int, tuple[int, int]]], seed: int):
    """The rows of small nodes: drawn columns' bins, gradients and hessians; ``small`` has heap number and batch by node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, models, classes):
            out: list[tuple] = []
            drawn = _all_columns(fits, classes, len(chunk.bins), number, seed)
            for m, rows in _sampled(chunk, fits, number, seed):
                wanted = [c for c in range(classes) if (m, c) in small]
                if not wanted:
                    continue
                g, h = slopes(chunk.margins[m][:, rows], chunk.target[rows], chunk.weight[rows])
                own = chunk.bins[:, rows]
                node = walked(own, feature[m], cut[m], left[m])
                for c in wanted:
                    columns = drawn[fits[m].columns, c]
                    for at, (heap, batch) in small[m, c].items():
                        inside = np.flatnonzero(node[c] == at)
                        if len(inside):
                            both = np.array([g[c][inside], h[c][inside]])
                            out.append((batch, m, c, heap, own[columns[:, None], inside].tobytes(), both.tobytes()))
            kinds = [*[pa.int32()] * 4, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["batch", "model", "class", "node", "bins", "slopes"])
    return run


def _all_columns(fits: dict[int, Fit], classes: int, features: int, number: int, seed: int) -> dict[tuple[float, int], np.ndarray]:
    return {(share, c): drawn_columns(features, share, number, c, seed) for share in {f.columns for f in fits.values()} for c in range(classes)}


def grown_below(root: int, own: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, fit: Fit, bins: int) -> list[np.ndarray]:
    """All splits at and below a node: heap numbers, features, cuts, gains, sides; ``own`` is (column, row).

    Only the child with fewer rows is summed; the other one has what is left of the sums of both.
    """
    found: list[list] = [[np.empty(0)] for _ in range(10)]
    open_nodes, at = np.array([root]), np.zeros(len(g), np.int64)
    depth = int(root + 1).bit_length() - 1
    sums = _sums(at, own, g, h, 1, bins) if depth < fit.depth else None
    while depth < fit.depth:
        place, cut, gain, *sides = best_splits(sums, fit)
        some = is_split(gain, fit)
        for to, v in zip(found, [open_nodes, columns[place], cut, gain, *sides]):
            to.append(v[some])
        depth += 1
        if depth == fit.depth or not some.any():
            break
        going = some[at]
        own, g, h, at = own[:, going], g[going], h[going], at[going]
        right = own[place[at], np.arange(len(at))] > cut[at]
        at, pairs = (np.cumsum(some) - 1)[at], np.arange(some.sum())
        open_nodes = (2 * open_nodes[some][:, None] + np.array([1, 2])).ravel()
        fewer = (sides[5] < sides[2])[some].astype(int)
        few = np.flatnonzero(right == fewer[at])
        both = np.empty((3, len(pairs), 2, len(own), bins))
        both[:, pairs, fewer] = _sums(at[few], own[:, few], g[few], h[few], len(pairs), bins)
        both[:, pairs, 1 - fewer] = sums[:, some] - both[:, pairs, fewer]
        sums, at = both.reshape(3, -1, len(own), bins), 2 * at + right
    return [np.concatenate(v) for v in found]


def _finish(fits, classes, features, bins, number, seed):
    """All splits below the small nodes of a batch, whose rows are all here."""
    def run(table: pa.Table) -> pa.Table:
        drawn = _all_columns(fits, classes, features, number, seed)
        parts: dict[tuple, list] = {}
        names = ("model", "class", "node", "bins", "slopes")
        for m, c, root, own, both in zip(*[table.column(k).to_pylist() for k in names]):
            columns = drawn[fits[m].columns, c]
            parts.setdefault((m, c, root), []).append((
                np.frombuffer(own, np.uint8).reshape(len(columns), -1), np.frombuffer(both, np.float64).reshape(2, -1)))
        out = []
        for (m, c, root), of in parts.items():
            own, both = (np.concatenate([p[i] for p in of], axis=1) for i in (0, 1))
            out.append(_told_splits(m, c, grown_below(root, own, *both, drawn[fits[m].columns, c], fits[m], bins)))
        return pa.concat_tables(out)
    return run


def _stepped(fits: dict[int, Fit], models: int, classes: int, feature, cut, left, value):
    """Chunks with the margins after a round's trees; ``losses`` are the held rows' summed log-losses by model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved, losses = [], []
            for i in range(batch.num_rows):
                chunk = _Chunk(batch, i, models, classes)
                margins, lost = chunk.margins.copy(), np.zeros(models)
                for m, fit in fits.items():
                    margins[m] += value[m][np.arange(classes)[:, None], walked(chunk.bins, feature[m], cut[m], left[m])]
                    out = np.flatnonzero(chunk.held == fit.held)
                    p = shares_of(margins[m][:, out])[chunk.target[out], np.arange(len(out))]
                    lost[m] = -np.log(np.maximum(p, 1e-16)).sum()
                moved.append(margins.tobytes())
                losses.append(lost)
            batch = batch.set_column(7, "margins", pa.array(moved, pa.binary()))
            yield batch.set_column(8, "losses", pa.array(losses, pa.list_(pa.float64())))
    return run


def _tallied(fits: dict[int, Fit], models: int, classes: int):
    """Per model how often each held row's class is taken for which; ties go to the first class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {m: np.zeros(classes * classes, np.int64) for m in fits}
        for chunk in _chunks(batches, models, classes):
            for m, fit in fits.items():
                out = chunk.held == fit.held
                pairs = chunk.target[out].astype(np.int64) * classes + chunk.margins[m][:, out].argmax(axis=0)
                counts[m] += np.bincount(pairs, minlength=classes * classes)
        rows = [(m, i // classes, i % classes, int(n)) for m, of in counts.items() for i, n in enumerate(of) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            ["model", "truth", "predicted", "n"])
    return run


def _alone(fits: dict[int, Fit], classes: int, bins: int, stops: list[int], seed: int):
    """Models whose rows are all here, boosted to the end: per number of rounds what ``_tallied`` tells."""
    def tallies(fit: Fit, chunks: list[_Chunk]) -> Iterator[tuple[int, int, int, int]]:
        own = np.concatenate([c.bins for c in chunks], axis=1)
        target, weight, held, draw = (np.concatenate([getattr(c, k) for c in chunks]) for k in ("target", "weight", "held", "draw"))
        margins, out = np.zeros((classes, len(target))), held == fit.held
        for number in range(max(stops)):
            rows = np.flatnonzero(~out & drawn_rows(draw, fit.subsample, number, seed))
            g, h = slopes(margins[:, rows], target[rows], weight[rows])
            splits = {}
            for c in range(classes):
                columns = drawn_columns(len(own), fit.columns, number, c, seed)
                found = grown_below(0, own[columns[:, None], rows], g[c], h[c], columns, fit, bins)
                splits[0, c] = {int(i): tuple(split) for i, *split in zip(*found)}
            trees = built(splits, {0: fit}, 1, classes)
            margins += trees.value[0][np.arange(classes)[:, None], walked(own, trees.feature[0], trees.cut[0], trees.left[0])]
            if number + 1 in stops:
                pairs = target[out].astype(np.int64) * classes + margins[:, out].argmax(axis=0)
                yield from ((number + 1, i // classes, i % classes, int(n)) for i, n in enumerate(np.bincount(pairs)) if n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list[_Chunk]] = {}
        for batch in batches:
            for i, m in enumerate(batch.column("model").to_pylist()):
                chunks.setdefault(m, []).append(_Chunk(batch, i, 0, classes))
        rows = [(m, *told) for m, of in chunks.items() for told in tallies(fits[m], of)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate([*[pa.int32()] * 4, pa.int64()])],
            ["model", "rounds", "truth", "predicted", "n"])
    return run


# --- the booster ------------------------------------------------------------------------

class Booster:
    """Boosts several models over one set of rows.

    ``rows`` has target (0, 1, ..), weight, held, draw (a 64-bit key) and the features.
    """

    def __init__(self, rows: DataFrame, features: list[str], fits: list[Fit], classes: int, bins: int = BINS, seed: int = SPLIT_SEED,
                 cuts: dict[str, list[float]] | None = None, finish: int = FINISH, kept: bool = True):
        self.spark, self.fits, self.classes, self.bins, self.seed = rows.sparkSession, dict(enumerate(fits)), classes, bins, seed
        self.features, self.finish, self.kept, self._older = features, finish, kept, None
        given = cuts or quantile_cuts(rows, features, bins)
        self.cuts = [np.unique(np.array(given[f], float)) for f in features]
        self.grown = [Grown() for _ in fits]
        self.models, self.number = len(fits), 0
        named = rows.select("target", "weight", "held", "draw", *[col_of(f).cast("double") for f in features])
        held = dict(named.groupBy("held").count().collect())
        number = sum(held.values())
        self.held = {m: held.get(fit.held, 0) for m, fit in self.fits.items()}
        self.rows = {m: number - n for m, n in self.held.items()}
        parts = max(-(-number // CHUNK), min(self.spark.sparkContext.defaultParallelism, -(-number // 512)), 1)
        chunks = named.repartition(parts).mapInArrow(_binned(self.cuts, self.models, classes), CHUNKS)
        chunks, self._files = written(chunks, "chunks")
        self.state = chunks.persist(StorageLevel.MEMORY_AND_DISK)
        self.wide = parts > FAN

    def _large(self, fits: dict[int, Fit], trees: Trees, slots, numbers) -> list:
        one = (len(self.features), self.bins, self.number)
        sums = self.state.mapInArrow(_level_sums(
            fits, self.models, self.classes, self.bins, self.number, trees.feature, trees.cut, trees.left, slots, self.seed), SUMS)
        if self.wide:
            salted = sums.groupBy("model", "class", F.pmod(F.xxhash64("part"), F.lit(FAN)).alias("salt"))
            sums = salted.applyInArrow(_merge(fits, *one, slots, self.seed), SUMS)
        return sums.groupBy("model", "class").applyInArrow(_choose(fits, *one, slots, numbers, self.seed), SPLITS).collect()

    def _small(self, fits: dict[int, Fit], trees: Trees, small) -> list:
        rows = self.state.mapInArrow(_small_rows(
            fits, self.models, self.classes, self.number, trees.feature, trees.cut, trees.left, small, self.seed), SMALL)
        grown = _finish(fits, self.classes, len(self.features), self.bins, self.number, self.seed)
        return rows.groupBy("batch").applyInArrow(grown, SPLITS).collect()

    def _batched(self, trees: Trees, small: dict[tuple[int, int], list[tuple[int, float]]]) -> dict:
        """Heap number and batch by node; a batch has at most ``finish`` rows, and batches enough for all cores."""
        total = sum(n for nodes in small.values() for _, n in nodes)
        room = min(self.finish, total / (2 * self.spark.sparkContext.defaultParallelism))
        out: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        batch, held = 0, 0.0
        for (m, c), nodes in small.items():
            for i, n in nodes:
                if held and held + n > room:
                    batch, held = batch + 1, 0.0
                held += n
                out.setdefault((m, c), {})[trees.heap[m][c][i]] = (i, batch)
        return out

    def round(self, live: list[int]) -> None:
        """One more tree per class for the ``live`` models."""
        fits = {m: self.fits[m] for m in live}
        splits: dict[tuple[int, int], dict[int, tuple]] = {(m, c): {} for m in live for c in range(self.classes)}
        large = {k: [0] for k in splits if self.rows[k[0]] > self.finish}
        small = {k: [(0, float(self.rows[k[0]]))] for k in splits if k not in large}
        trees = built(splits, fits, self.models, self.classes)
        while large:
            slots, numbers = {}, large
            for (m, c), nodes in large.items():
                slots[m, c] = np.full(trees.feature.shape[2], -1, np.int64)
                slots[m, c][[trees.heap[m][c][i] for i in nodes]] = np.arange(len(nodes))
            large = {}
            for m, c, i, *split in self._large(fits, trees, slots, numbers):
                splits[m, c][i] = tuple(split)
                for child, n in ((2 * i + 1, split[5]), (2 * i + 2, split[8])):
                    if (child + 1).bit_length() - 1 < fits[m].depth:
                        if n > self.finish:
                            large.setdefault((m, c), []).append(child)
                        else:
                            small.setdefault((m, c), []).append((child, n))
            trees = built(splits, fits, self.models, self.classes)
        if small:
            for m, c, i, *split in self._small(fits, trees, self._batched(trees, small)):
                splits[m, c][i] = tuple(split)
            trees = built(splits, fits, self.models, self.classes)
        if self.kept:
            for m in live:
                self.grown[m].trees.append([trees.of(m, c) for c in range(self.classes)])
        self.number += 1
        moved = self.state.mapInArrow(_stepped(
            fits, self.models, self.classes, trees.feature, trees.cut, trees.left, trees.value), CHUNKS)
        if self.number % WRITE_ROUNDS == 0:
            moved, files = written(moved, "chunks")
            discard(self.spark, self._files)
            self._files = files
        before, self.state = self.state, moved.persist(StorageLevel.MEMORY_AND_DISK)
        self._drop(self._older)
        self._older = before

    def measure(self, live: list[int]) -> None:
        """Note the live models' mean losses on their held rows; before the first round all classes are alike."""
        if not self.number:
            found = {m: self.held[m] * np.log(self.classes) for m in live}
        else:
            summed = self.state.select(F.posexplode("losses")).groupBy("pos").agg(F.sum("col"))
            found = dict(summed.collect())
        for m in live:
            if self.held[m]:
                self.grown[m].losses.append(float(found[m]) / self.held[m])

    @staticmethod
    def _drop(df: DataFrame | None) -> None:
        if df is not None:
            df.unpersist()

    def tally(self, live: list[int]) -> dict[int, np.ndarray]:
        """Per model the confusion matrix (truth, predicted) of its held rows."""
        fits = {m: self.fits[m] for m in live}
        rows = self.state.mapInArrow(_tallied(fits, self.models, self.classes), "model int, truth int, predicted int, n long")
        out = {m: np.zeros((self.classes, self.classes), np.int64) for m in live}
        for m, t, p, n in rows.groupBy("model", "truth", "predicted").agg(F.sum("n")).collect():
            out[m][t, p] = n
        return out

    def close(self) -> None:
        self._drop(self.state)
        self._drop(self._older)
        discard(self.spark, self._files)

    def thresholds(self, m: int, rounds: int | None = None) -> list[list[dict]]:
        """A model's trees with cuts as values: a row goes right where its feature is greater."""
        def told(tree: dict) -> dict:
            limit = np.zeros(len(tree["feature"]))
            for i in np.flatnonzero(tree["feature"] >= 0):
                limit[i] = self.cuts[tree["feature"][i]][tree["cut"][i]]
            return {"limit": limit, **{k: tree[k] for k in ("feature", "left", "value", "gain")}}

        return [[told(tree) for tree in of] for of in self.grown[m].trees[:rounds]]


def boost(booster: Booster, rounds: int, patience: int | None, live: list[int] | None = None) -> None:
    """Rounds for the ``live`` models (all) until ``rounds``, or ``patience`` of them without a lower loss on held rows."""
    live = list(booster.fits) if live is None else live
    if patience is not None:
        booster.measure(live)
    while booster.number < rounds and live:
        booster.round(live)
        if patience is not None:
            booster.measure(live)
            live = [m for m in live if not booster.grown[m].losses or booster.number - booster.grown[m].best() < patience]


def tallies(rows: DataFrame, features: list[str], fits: list[Fit], classes: int, stops: list[int], bins: int = BINS,
            seed: int = SPLIT_SEED) -> dict[tuple[int, int], np.ndarray]:
    """By model and number of rounds (each of ``stops``) the confusion matrix of the model's held rows.

    A small table goes to one task per model. Of a larger one as many models are boosted together as have at most
    ``MARGINS`` bytes of margins. The trees are the same.
    """
    cuts = quantile_cuts(rows, features, bins)
    number, out = rows.count(), {(m, stop): np.zeros((classes, classes), np.int64) for m in range(len(fits)) for stop in stops}
    if number * (len(features) + 18) <= SENT:
        named = rows.select("target", "weight", "held", "draw", *[col_of(f).cast("double") for f in features])
        chunks, files = written(named.mapInArrow(_binned([np.unique(np.array(cuts[f], float)) for f in features], 0, classes), CHUNKS), "chunks")
        # The deepest first, as they take longest.
        order = sorted(range(len(fits)), key=lambda m: -fits[m].depth)
        models = rows.sparkSession.range(0, len(fits), 1, len(fits)).select(F.get(F.array(*[F.lit(m) for m in order]), F.col("id").cast("int")).alias("model"))
        told = models.crossJoin(F.broadcast(chunks)).select(*chunks.columns, "model").mapInArrow(
            _alone(dict(enumerate(fits)), classes, bins, stops, seed), "model int, rounds int, truth int, predicted int, n long")
        for m, stop, t, p, n in told.collect():
            out[m, stop][t, p] = n
        discard(rows.sparkSession, files)
        return out
    room = max(1, MARGINS // (number * classes * 8))
    for low in range(0, len(fits), room):
        booster = Booster(rows, features, fits[low:low + room], classes, bins, seed, cuts, kept=False)
        for stop in sorted(stops):
            boost(booster, stop, None)
            out |= {(low + m, stop): matrix for m, matrix in booster.tally(list(booster.fits)).items()}
        booster.close()
    return out


def margins_of(trees: list[list[dict]], values: np.ndarray) -> np.ndarray:
    """Margins (class, row) of rows (feature, row) under trees with limits."""
    n = values.shape[1]
    out = np.zeros((len(trees[0]) if trees else 0, n))
    row = np.arange(n)
    for of in trees:
        for c, tree in enumerate(of):
            node = np.zeros(n, np.int64)
            while True:
                f = tree["feature"][node]
                inner = f >= 0
                if not inner.any():
                    break
                right = values[np.maximum(f, 0), row] > tree["limit"][node]
                node = np.where(inner, tree["left"][node] + right, node)
            out[c] += tree["value"][node]
    return out


@dataclass
class BoostedClassifier:
    """Trees of one multiclass model, ready to score rows in their own units."""

    features: list[str]
    trees: list[list[dict]]
    label_ids: list[int]
    losses: list[float] = field(default_factory=list)
    classes: list[str] = field(default_factory=lambda: list(CLASSES))
    kind: str = "boosted"

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities``, ``attack_type`` and ``confidence``; ties go to the first class."""
        shared = df.sparkSession.sparkContext.broadcast([[
            {k: tree[k] for k in ("feature", "limit", "left", "value")} for tree in of] for of in self.trees])
        wide = len(self.label_ids)

        @F.pandas_udf("array<double>")
        def shares(*columns: pd.Series) -> pd.Series:
            values = np.nan_to_num(np.array([c.to_numpy(float, na_value=0.0) for c in columns]), nan=0.0, posinf=0.0, neginf=0.0)
            margins = margins_of(shared.value, values) if shared.value else np.zeros((wide, values.shape[1]))
            return pd.Series(list(shares_of(margins).T))

        out = df.withColumn("probabilities", shares(*[col_of(f).cast("double") for f in self.features]))
        best = F.array_max("probabilities")
        names = F.array(*[F.lit(self.classes[i]) for i in self.label_ids])
        return out.withColumns({
            "confidence": best, "attack_type": F.element_at(names, F.array_position("probabilities", best).cast("int"))})

    def score_valid(self, df: DataFrame) -> DataFrame:
        """Score the rows whose features are all finite."""
        return self.score(scorable_rows(df, self.features))

    def importances(self) -> np.ndarray:
        """Each feature's mean gain per split, as shares of one."""
        gain, count = np.zeros(len(self.features)), np.zeros(len(self.features))
        for of in self.trees:
            for tree in of:
                at = tree["feature"] >= 0
                np.add.at(gain, tree["feature"][at], tree["gain"][at])
                np.add.at(count, tree["feature"][at], 1)
        mean = np.divide(gain, count, out=np.zeros_like(gain), where=count > 0)
        return mean / mean.sum() if mean.sum() else mean

    def info(self) -> dict:
        return {"kind": self.kind, "features": self.features, "n_features": len(self.features), "classes": self.classes,
                "label_ids": self.label_ids, "rounds": len(self.trees), "losses": self.losses}

    def save(self, spark: SparkSession, path: str) -> None:
        """The info as JSON, and the trees' nodes as a table."""
        rows = [
            (r, c, i, int(tree["feature"][i]), float(tree["limit"][i]), int(tree["left"][i]), float(tree["value"][i]), float(tree["gain"][i]))
            for r, of in enumerate(self.trees) for c, tree in enumerate(of) for i in range(len(tree["feature"]))]
        nodes = "round int, class int, node int, feature int, limit double, left int, value double, gain double"
        spark.createDataFrame(rows, nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(self.info()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedClassifier:
        info = json.loads(spark.read.text(f"{path}/info").first()[0])
        nodes = dict(list(spark.read.parquet(f"{path}/nodes").toPandas().groupby(["round", "class"])))
        trees = []
        for r in range(info["rounds"]):
            of = [nodes[r, c].sort_values("node") for c in range(len(info["label_ids"]))]
            trees.append([{k: one[k].to_numpy() for k in ("feature", "limit", "left", "value", "gain")} for one in of])
        return BoostedClassifier(info["features"], trees, info["label_ids"], info["losses"], info["classes"])


def boosting_rows(df: DataFrame, features: list[str], target, weight, held) -> DataFrame:
    """The rows of a ``Booster``; features that are not finite count as 0, draws come from the features' values."""
    ready = finite_features(df, features)
    return ready.select(
        target.cast("int").alias("target"), weight.cast("double").alias("weight"), held.cast("int").alias("held"),
        F.xxhash64(*[col_of(f) for f in features]).alias("draw"), *[col_of(f) for f in features])
