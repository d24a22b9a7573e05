"""A random forest as a table of nodes: no tree passes through the driver or is held whole by a task.

Values are put into at most 64 bins per column. A row takes part in a tree as often as a Poisson draw from
the hash of its key says, so a repeated task draws the same. A node's name is a hash of its way from the
root, which allows any depth. Each node looks at a block of columns in an order of its own and takes the
split of least Gini impurity; where no column of the block varies, it looks at the next block.

Nodes of more than ``small`` draws are split level by level: tasks count labels per node, column and bin,
Spark adds the counts, and the best split of each node is chosen where its sums meet. The rows of all
other nodes are sent, once per tree, to one task per few neighbouring nodes, which finishes their subtrees.
Both ways count whole numbers and share the choice, so ``small`` decides about work and memory, never about
the trees.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybird.sources.workspace import mounted_path

BINS = 64
SMALL = 400_000  # some 12 MB of rows where 42 columns tell them
FILE_NODES = 1 << 20
SPLIT, FRONTIER, HANDED, LEAF = range(4)
NODES = (
    "tree int, node long, depth int, feature int, bin int, n0 long, n1 long, gain double, state int, block int, "
    "low_child long, high_child long, "  # 0 for a leaf
    "part long"  # the node at which the task began that finished the subtree, 0 for a node made level by level
)
_NAMES = [field.split()[0] for field in NODES.split(", ")]
_DTYPES = [np.int32, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.float64, np.int32, np.int32, np.int64, np.int64, np.int64]
ROWS = 1 << 18  # that a task looks at in one go
TASKS = 4  # per core, where the work of a row is large against its bytes
_POISSON = np.array(
    [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**64) for k in range(10)], np.uint64
)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def root(tree: int, seed: int) -> int:
    return int(mixed(np.array([(seed << 32) + tree + 1], np.uint64)).view(np.int64)[0])


def child(node: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(node.astype(np.int64).view(np.uint64) ^ mixed(right.astype(np.uint64) + np.uint64(17))).view(np.int64)


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row takes part in a tree."""
    of_tree = np.array([root(tree, seed)], np.int64).view(np.uint64)
    return np.searchsorted(_POISSON, mixed(keys.view(np.uint64) ^ of_tree), side="right")


def column_order(nodes: np.ndarray, columns: int) -> np.ndarray:
    """The columns in each node's own order."""
    hashes = mixed(nodes.view(np.uint64)[:, None] ^ mixed(np.arange(columns) + 1)[None, :])
    return np.argsort(hashes, axis=1, kind="stable").astype(np.int32)


def histograms(bins, label, times, place, feature, nodes: int) -> np.ndarray:
    """(nodes, BINS, 2) draws by bin of each node's column and by label."""
    cell = (place * BINS + bins[np.arange(len(place)), feature[place]]) * 2 + label
    return np.bincount(cell, weights=times, minlength=nodes * BINS * 2).reshape(nodes, BINS, 2)


def _impurity(n0: np.ndarray, n1: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted Gini impurity times weight, of counts by label."""
    w0, w1 = n0 * weight[0], n1 * weight[1]
    whole = w0 + w1
    return whole - (w0 * w0 + w1 * w1) / np.maximum(whole, 1e-300)


def _gains(left: Sequence[np.ndarray], whole: Sequence[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """What a split takes away, from the counts by label on its left side and in all."""
    right = [a - b for a, b in zip(whole, left)]
    return np.maximum(_impurity(*whole, weight) - _impurity(*left, weight) - _impurity(*right, weight), 0.0)


def cuts(hist: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best last bin of the left side and its gain, per node; gain -1 where the column does not vary."""
    left = np.cumsum(hist, axis=1)
    whole = left[:, -1:]
    left = left[:, :-1]
    n = left.sum(-1)
    gain = _gains([left[..., 0], left[..., 1]], [whole[..., 0], whole[..., 1]], weight)
    gain = np.where((n > 0) & (n < whole.sum(-1)), gain, -1.0)
    best = gain.argmax(1)
    return best.astype(np.int32), gain[np.arange(len(gain)), best]


#: By a row's draws and label in five bits: the draws, and above 32 bits those of label 1.
_DRAWN = np.array([(k >> 1) * (1 + ((k & 1) << 32)) for k in range(32)], np.int64)


def _keys(marks: np.ndarray, place: np.ndarray, nodes: int) -> np.ndarray:
    """Each row's node above six bits for a bin, and below them its draws and label."""
    kind = np.uint32 if nodes < 1 << 20 else np.uint64
    keys = place.astype(kind)
    keys *= kind(BINS * 32)
    keys += marks
    return keys


def _ahead(n: np.ndarray) -> np.ndarray:
    """Draws of all nodes ahead of each, those of label 1 above 32 bits."""
    packed = n.sum(1) + (n[:, 1] << 32)
    return np.cumsum(packed) - packed


def sorted_cuts(value, marks, place, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cuts`` of nodes with the counts ``n`` by label, from their rows in order of node and bin: only bins that
    hold rows are looked at, so that small nodes cost what their rows cost. ``marks`` holds each row's draws and
    label in five bits."""
    return _cuts_of(value, _keys(marks, place, len(n)), n, _ahead(n), weight)


def _cuts_of(value, keys, n: np.ndarray, ahead: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, gain = np.zeros(len(n), np.int32), np.full(len(n), -1.0)
    kind = keys.dtype.type
    key = value.astype(kind)
    key <<= kind(5)
    key += keys
    key.sort()
    # where the bin is another one behind a row and the node the same: the last bin leaves nothing for the right side
    step = key[1:] ^ key[:-1]
    step -= kind(32)
    ends = np.flatnonzero(step < kind(BINS * 32 - 32))
    if not len(ends):
        return best, gain
    upto = np.cumsum(_DRAWN.take(key & kind(31))).take(ends)
    cell = (key.take(ends) >> kind(5)).astype(np.int64)
    at = cell // BINS
    upto -= ahead.take(at)
    left, left1 = upto & 0xFFFFFFFF, upto >> 32
    found = _gains([left - left1, left1], [n[:, 0].take(at), n[:, 1].take(at)], weight)
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    most = np.maximum.reduceat(found, starts)
    hits = np.flatnonzero(found == np.repeat(most, np.diff(np.append(starts, len(at)))))
    hits = hits[np.append(True, at[hits][1:] != at[hits][:-1])]  # of equal gains the lowest bin's
    best[at[hits]], gain[at[hits]] = cell[hits] % BINS, found[hits]
    return best, gain


def _first_columns(nodes: np.ndarray, columns: int, width: int) -> np.ndarray:
    """The first ``width`` of ``column_order``, which no two columns share a place in: hashes of a node differ."""
    if width >= columns:
        return column_order(nodes, columns)
    out, names = np.empty((len(nodes), width), np.int32), mixed(np.arange(columns) + 1)
    for lo in range(0, len(nodes), 4096):
        hashes = mixed(nodes[lo : lo + 4096].view(np.uint64)[:, None] ^ names[None, :])
        first = np.argpartition(hashes, width - 1, axis=1)[:, :width]
        order = np.argsort(np.take_along_axis(hashes, first, 1), axis=1)
        out[lo : lo + 4096] = np.take_along_axis(first, order, 1)
    return out


def _batch(columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(c).astype(d)) for c, d in zip(columns, _DTYPES)], names=_NAMES
    )


def grow(bins, label, times, tree: int, node, depth, weight, width: int, deepest: int | None, place=None) -> pa.Table:
    """The whole subtrees below (and with) one node or several of a tree, from their rows; ``place`` tells whose a
    row is. A level of all of them is made at once: what a level costs besides its rows is paid once."""
    columns = bins.shape[1]
    values, base = np.ascontiguousarray(bins).ravel(), np.arange(len(label)) * columns
    marks, times = (times.astype(np.uint32) * 2 + label).astype(np.uint32), times.astype(float)
    nodes, depth = np.atleast_1d(np.asarray(node, np.int64)), np.atleast_1d(np.asarray(depth, np.int64))
    part, place = nodes, np.zeros(len(label), np.int64) if place is None else place
    made = []
    while len(nodes):
        a = len(nodes)
        n = np.bincount(place * 2 + (marks & 1), weights=times, minlength=2 * a).reshape(a, 2).astype(np.int64)
        feature, cut, gain = np.full(a, -1, np.int32), np.full(a, -1, np.int32), np.zeros(a)
        open_ = (n.min(1) > 0) & (deepest is None or depth < deepest)
        todo = kept = np.flatnonzero(open_)
        at, mark, start, among = place, marks, base, a
        for block in range(0, columns, width):
            if not len(todo):
                break
            # few nodes come to a second block
            order = _first_columns(nodes[todo], columns, width) if block == 0 else column_order(nodes[todo], columns)[:, block:]
            number = np.full(among, -1)
            number[kept] = np.arange(len(todo))
            at = number.take(at)
            rows = np.flatnonzero(at >= 0)
            at, mark, start, among, whole = at.take(rows), mark.take(rows), start.take(rows), len(todo), n[todo]
            dense = len(rows) > len(todo) * BINS
            if dense:
                drawn, cell = (mark >> 1).astype(float), at * (2 * BINS) + (mark & 1)
            else:
                keys, ahead = _keys(mark, at, len(todo)), _ahead(whole)
            best = np.full(len(todo), -1.0)
            for j in range(min(width, columns - block)):
                f = order[:, j].astype(np.int64)
                here = f.take(at)
                here += start
                value = values.take(here)
                if dense:
                    hist = np.bincount(cell + 2 * value.astype(np.int64), weights=drawn, minlength=len(todo) * BINS * 2)
                    bin_, found = cuts(hist.reshape(len(todo), BINS, 2), weight)
                else:
                    bin_, found = _cuts_of(value, keys, whole, ahead, weight)
                better = found > best
                best = np.where(better, found, best)
                feature[todo[better]], cut[todo[better]], gain[todo[better]] = f[better], bin_[better], found[better]
            kept = np.flatnonzero(feature[todo] < 0)
            todo = todo[kept]
        split = feature >= 0
        parents = nodes[split]
        below = np.zeros((a, 2), np.int64)
        below[split] = np.stack([child(parents, np.zeros(len(parents))), child(parents, np.ones(len(parents)))], 1)
        made.append(
            _batch(
                [np.full(a, tree), nodes, depth, feature, cut, n[:, 0], n[:, 1], gain,
                 np.where(split, SPLIT, LEAF), np.zeros(a), below[:, 0], below[:, 1], part]
            )
        )
        rows = np.flatnonzero(split.take(place))
        base, marks, times, place = base.take(rows), marks.take(rows), times.take(rows), place.take(rows)
        right = values.take(base + feature.take(place)) > cut.take(place)
        after = (np.cumsum(split) - 1) * 2
        nodes = below[split].ravel()
        place = after.take(place) + right
        depth, part = np.repeat(depth[split] + 1, 2), np.repeat(part[split], 2)
    return pa.Table.from_batches(made)


@lru_cache(maxsize=2)
def _tops(paths: tuple[str, ...], small: int = SMALL) -> dict[int, dict[str, np.ndarray]]:
    """The nodes made level by level so far, sorted by name within each tree; a later line replaces an
    earlier one. At most two per ``small`` draws. Nodes to be handed over have a bundle: neighbours that begin
    within the same ``small`` draws of their tree, which are fewer than twice as many in all."""
    tables = [pq.read_table(path).select(_NAMES) for path in paths]
    table = {name: np.concatenate([t.column(name).to_numpy() for t in tables]) for name in _NAMES}
    order = np.lexsort((np.arange(len(table["node"])), table["node"], table["tree"]))
    table = {name: values[order] for name, values in table.items()}
    last = np.ones(len(order), bool)
    last[:-1] = (table["node"][1:] != table["node"][:-1]) | (table["tree"][1:] != table["tree"][:-1])
    table = {name: values[last] for name, values in table.items()}
    trees, first = np.unique(table["tree"], return_index=True)
    ends = np.append(first[1:], len(table["tree"]))
    found = {int(t): {k: v[lo:hi] for k, v in table.items()} for t, lo, hi in zip(trees, first, ends)}
    for tree in found.values():  # where the children of split nodes are
        tree["low"], tree["high"] = (np.searchsorted(tree["node"], tree[f"{side}_child"]) for side in ("low", "high"))
        # split nodes above open ones: no row has to go below the others while levels are counted
        split, open_ = np.flatnonzero(tree["state"] == SPLIT), tree["state"] == FRONTIER
        while True:
            more = open_[tree["low"][split]] | open_[tree["high"][split]]
            if (more == open_[split]).all():
                break
            open_[split] = more
        tree["above_open"] = open_ & (tree["state"] == SPLIT)
        handed = np.where(tree["state"] == HANDED, tree["n0"] + tree["n1"], 0)
        tree["bundle"] = (np.cumsum(handed) - handed) // max(small, 1)
    return found


def _descend(tree: dict[str, np.ndarray], values: np.ndarray, columns: int, rows: np.ndarray, start: int, goes: np.ndarray) -> np.ndarray:
    """Place in ``tree`` of the node at which each row's way ends for now: the first one from which it does not go
    on. ``values`` are the bins of all rows, one row behind the other."""
    here = np.full(len(rows), np.searchsorted(tree["node"], start))
    at, moving, base = here.copy(), np.arange(len(rows)), rows * columns
    while True:
        on = np.flatnonzero(goes.take(here))
        if not len(on):
            return at
        moving, here, base = moving.take(on), here.take(on), base.take(on)
        right = values.take(base + tree["feature"].take(here)) > tree["bin"].take(here)
        here = np.where(right, tree["high"].take(here), tree["low"].take(here))
        at[moving] = here


def _in_blocks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, keys, labels) of about ``ROWS`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append((_matrix(batch, columns), batch.column("key").to_numpy(), batch.column("label").to_numpy()))
        n += batch.num_rows
        if n >= ROWS:
            yield tuple(np.concatenate(part) for part in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(part) for part in zip(*held))


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, columns)


def _put_in_bins(edges: list[np.ndarray]):
    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
            values = values.reshape(batch.num_rows, len(edges))
            put = np.zeros(values.shape, np.uint8)
            for k, edge in enumerate(edges):
                put[:, k] = np.searchsorted(edge, values[:, k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array([r.tobytes() for r in put], pa.binary())],
                names=["key", "label", "bins"],
            )

    return bin_rows


def _values(columns: Sequence[str], vector: str | None) -> Column:
    """The columns as one array; ``vector`` names a column that holds them already."""
    return F.col(f"`{vector}`") if vector else F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def _binned(rows: DataFrame, values: Column, key: str, label: str | None, edges: list[np.ndarray]) -> DataFrame:
    label_value = F.lit(0) if label is None else F.col(f"`{label}`")
    plain = rows.select(F.col(f"`{key}`").alias("key"), label_value.cast("int").alias("label"), values.alias("v"))
    key_type = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(_put_in_bins(edges), f"key {key_type}, label int, bins binary")


@dataclass(frozen=True)
class ForestTable:
    """Where the nodes are, and what is needed to score: bounds of bins, weights of labels."""

    path: str
    columns: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    weight: tuple[float, float]
    trees: int
    seed: int
    bits: int = 0
    run: str = ""

    @property
    def files(self) -> str:
        return f"{mounted_path(self.path)}/{self.run}/files"

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/nodes")


def _level(tops: tuple[str, ...], trees: int, seed: int, columns: int, width: int):
    """Draws per frontier node, column of its block, bin and label, over the rows of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, keys, label in _in_blocks(batches, columns):
            values, label = bins.ravel(), label.astype(np.int64)
            for t in range(trees):
                tree = _tops(tops)[t]
                if not (tree["state"] == FRONTIER).any():
                    continue
                times = draws(keys, t, seed)
                rows = np.flatnonzero(times)
                at = _descend(tree, values, columns, rows, root(t, seed), tree["above_open"])
                wanted = np.flatnonzero((tree["state"] == FRONTIER).take(at))
                rows, at = rows.take(wanted), at.take(wanted)
                if not len(rows):
                    continue
                there = np.bincount(at, minlength=len(tree["node"])) > 0
                places, place = np.flatnonzero(there), (np.cumsum(there) - 1).take(at)
                order = column_order(np.ascontiguousarray(tree["node"][places]), columns)
                block, cell, times = tree["block"][places], place * BINS, times[rows]
                start, twice = rows * columns, label[rows]
                made = []
                for j in range(width):
                    inside = np.flatnonzero(block * width + j < columns)
                    feature = order[np.arange(len(places)), np.minimum(block * width + j, columns - 1)]
                    hist = np.bincount(
                        (cell + values.take(start + feature.take(place))) * 2 + twice, weights=times, minlength=len(places) * BINS * 2
                    ).reshape(len(places), BINS * 2).astype(np.int64)
                    made += [(int(places[k]), int(block[k]), int(feature[k]), hist[k].tobytes()) for k in inside]
                here = np.array([line[0] for line in made])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(made), t, np.int32)), pa.array(tree["node"][here]), pa.array(tree["depth"][here]),
                     *[pa.array([line[k] for line in made], pa.int32()) for k in (1, 2)],
                     pa.array([line[3] for line in made], pa.binary())],
                    names=["tree", "node", "depth", "block", "feature", "hist"],
                )

    return count


def _choose(columns: int, width: int, weight: np.ndarray, small: int, deepest: int | None):
    """The split of one node from the sums over all tasks, with its two children."""

    def choose(table: pa.Table) -> pa.Table:
        tree, node, depth, block = (table.column(c)[0].as_py() for c in ("tree", "node", "depth", "block"))
        sums: dict[int, np.ndarray] = {}
        for feature, raw in zip(table.column("feature").to_pylist(), table.column("hist")):
            hist = np.frombuffer(raw.as_buffer(), np.int64)
            sums[feature] = sums[feature] + hist if feature in sums else hist
        order = [f for f in column_order(np.array([node], np.int64), columns)[0] if f in sums]
        hist = np.stack([sums[f] for f in order]).reshape(len(order), BINS, 2)
        n = hist[0].sum(0)
        cut, gain = cuts(hist, weight)
        best = int(gain.argmax())
        closed = n.min() == 0 or (deepest is not None and depth >= deepest)
        if closed or gain[best] < 0:
            state = LEAF if closed or (block + 1) * width >= columns else FRONTIER
            return pa.Table.from_batches([_batch([[x] for x in (tree, node, depth, -1, -1, *n, 0.0, state, block + 1, 0, 0, 0)])])
        left = hist[best, : cut[best] + 1].sum(0)
        below = child(np.array([node, node], np.int64), np.array([0, 1]))
        lines = [(tree, node, depth, order[best], cut[best], *n, gain[best], SPLIT, 0, *below, 0)]
        for name, m in zip(below, (left, n - left)):
            state = FRONTIER if m.sum() > small else HANDED
            lines.append((tree, name, depth + 1, -1, -1, *m, 0.0, state, 0, 0, 0, 0))
        return pa.Table.from_batches([_batch(list(zip(*lines)))])

    return choose


def _hand_over(tops: tuple[str, ...], trees: int, seed: int, columns: int, small: int):
    """The rows of nodes that one task finishes, packed per block of rows and node, with the node's bundle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, keys, label in _in_blocks(batches, columns):
            values = bins.ravel()
            for t in range(trees):
                lines, tree, times = [], _tops(tops, small)[t], draws(keys, t, seed)
                rows = np.flatnonzero(times)
                at = _descend(tree, values, columns, rows, root(t, seed), tree["state"] == SPLIT)
                wanted = tree["state"][at] == HANDED
                rows, at = rows[wanted], at[wanted]
                order = np.argsort(at, kind="stable")
                rows, at = rows[order], at[order]
                packed = np.concatenate([bins[rows], label[rows, None], times[rows, None]], axis=1).astype(np.uint8)
                places, first = np.unique(at, return_index=True)
                for p, lo, hi in zip(places, first, np.append(first[1:], len(at))):
                    own = (int(tree[name][p]) for name in ("bundle", "node", "depth"))
                    lines.append((t, *own, packed[lo:hi].tobytes()))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in lines], k) for i, k in enumerate(kinds)],
                    names=["tree", "bundle", "node", "depth", "rows"],
                )

    return pack


def _finish(columns: int, width: int, weight: np.ndarray, deepest: int | None):
    def finish(table: pa.Table) -> pa.Table:
        tree, raw = table.column("tree")[0].as_py(), table.column("rows").to_pylist()
        nodes, first, place = np.unique(table.column("node").to_numpy(), return_index=True, return_inverse=True)
        place = np.repeat(place, [len(x) // (columns + 2) for x in raw])
        rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, columns + 2)
        return grow(
            rows[:, :columns], rows[:, columns], rows[:, columns + 1],
            tree, nodes, table.column("depth").to_numpy()[first], weight, width, deepest, place,
        )

    return finish


def _file(folder: str, tree: int, shard: int) -> str:
    return f"{folder}/{tree}-{shard}.nodes"


def _laid_out(node: np.ndarray, feature, cut, low, high, share) -> list[np.ndarray]:
    """The nodes of a file, level by level, each pair of children side by side: names of its uppermost nodes, which
    come first; names of nodes that are named here and live in another file; a step and a share per node.

    A step holds the place of the low child, the column and its last bin on the left; -1 is a leaf and -2 - k the
    k-th node of another file.
    """
    order = np.argsort(node)
    node, feature, cut, low, high, share = (x[order] for x in (node, feature, cut, low, high, share))
    inner = feature >= 0
    children = np.stack([low[inner], high[inner]], 1)
    # places by name, nodes of other files behind the own ones
    own = np.minimum(np.searchsorted(node, children), len(node) - 1)
    away = node[own] != children
    elsewhere = np.unique(children[away])
    own[away] = len(node) + np.searchsorted(elsewhere, children[away])
    unnamed = np.ones(len(node), bool)
    unnamed[own[~away]] = False
    first = node[unnamed]
    place = np.zeros((len(node), 2), np.int64)
    place[inner] = own
    inner = np.append(inner, np.zeros(len(elsewhere), bool))
    levels, at = [], np.searchsorted(node, first)
    while len(at):
        levels.append(at)
        at = place[at[inner[at]]].ravel()
    line = np.concatenate(levels)
    step = np.append(np.full(len(node), -1), -2 - np.arange(len(elsewhere)))[line]
    split = inner[line]
    low_at = len(first) + 2 * np.arange(split.sum())  # children follow in the order of their parents
    parents = line[split]
    step[split] = (low_at << 32) | (feature[parents].astype(np.int64) << 8) | cut[parents]
    return [first, elsewhere, step, np.append(share, np.full(len(elsewhere), np.nan))[line]]


def _write_files(folder: str):
    def write(table: pa.Table) -> pa.Table:
        node, split, share = (table.column(name).to_numpy() for name in ("node", "split", "share"))
        low, high = (child(node, np.full(len(node), side)) for side in (0, 1))
        parts = _laid_out(node, split >> 8, split & 0xFF, low, high, share)
        tree, shard = table.column("tree")[0].as_py(), table.column("shard")[0].as_py()
        os.makedirs(folder, exist_ok=True)
        target = _file(folder, tree, shard)
        draft = f"{target}.{uuid.uuid4().hex}"  # a repeated task writes the same and moves it into place
        with open(draft, "wb") as file:
            file.write(np.array([len(part) for part in parts[:3]], "<i8").tobytes())
            for part, kind in zip(parts, ("<i8", "<i8", "<i8", "<f8")):
                file.write(part.astype(kind).tobytes())
        os.replace(draft, target)
        return pa.table({"tree": pa.array([tree], pa.int32()), "shard": [shard], "n": [len(table)]})

    return write


def _tasks(spark: SparkSession, groups: int | None = None) -> int:
    """Tasks for work that is large against its bytes, by which Spark would gather it into few."""
    most = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return most if groups is None else max(1, min(most, groups))


def fit_forest_table(
    rows: DataFrame,
    columns: Sequence[str],
    path: str,
    key: str = "customer_id",
    label: str = "churned",
    trees: int = 200,
    seed: int = 42,
    small: int = SMALL,
    deepest: int | None = None,
    vector: str | None = None,
) -> ForestTable:
    """Grow a forest on ``rows`` (label 0 or 1; other labels and null ones are left out) and store it in
    ``path``, a folder that workers can open. Labels weigh alike in sum. Null and NaN values go to the
    highest bin; rows with the same key are drawn alike. Other columns are not read. The driver sees two
    counts, the bounds of bins (63 per column) and the number of open nodes; an empty table or one label
    alone gives trees of a single leaf, or none.
    """
    spark = rows.sparkSession
    run = uuid.uuid4().hex[:12]  # workers keep what they have read by its path
    folder = f"{mounted_path(path)}/{run}"
    width = max(1, math.isqrt(len(columns)))
    learned = rows.where(F.col(f"`{label}`").cast("int").isin(0, 1)).select(
        F.xxhash64(f"`{key}`").alias("_key"), f"`{label}`", _values(columns, vector).alias("_values")
    )
    at = [k / BINS for k in range(1, BINS)]
    value = F.col(f"`{label}`").cast("int")
    first = learned.agg(
        F.count_if(value == 0).alias("n0"),
        F.count_if(value == 1).alias("n1"),
        *[F.percentile_approx(F.nanvl(F.col("_values")[k], F.lit(None).cast("double")), at, 10_000).alias(f"e{k}")
          for k in range(len(columns))],
    ).first()
    edges = [np.unique(np.array(first[f"e{k}"] or [0.0], float)) for k in range(len(columns))]
    n = first["n0"] + first["n1"]
    weight = np.array([n / (2 * m) if m else 1.0 for m in (first["n0"], first["n1"])])

    # evenly dealt: each pass over these rows does the work of all trees
    dealt = _binned(learned, F.col("_values"), "_key", label, edges).repartition(spark.sparkContext.defaultParallelism)
    dealt.write.mode("overwrite").parquet(f"{path}/{run}/binned")
    binned = spark.read.parquet(f"{path}/{run}/binned")
    start = FRONTIER if n > small else HANDED
    roots = [(t, root(t, seed), 0, -1, -1, 0, 0, 0.0, start, 0, 0, 0, 0) for t in range(trees)]
    spark.createDataFrame(roots, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/{run}/level-0")
    tops, frontier = (f"{folder}/level-0",), trees if start == FRONTIER else 0
    while frontier:
        counted = binned.mapInArrow(
            _level(tops, trees, seed, len(columns), width),
            "tree int, node long, depth int, block int, feature int, hist binary",
        )
        level = f"level-{len(tops)}"
        counted.groupBy("tree", "node").applyInArrow(
            _choose(len(columns), width, weight, small, deepest), NODES
        ).write.mode("overwrite").parquet(f"{path}/{run}/{level}")
        tops = (*tops, f"{folder}/{level}")
        frontier = spark.read.parquet(f"{path}/{run}/{level}").where(F.col("state") == FRONTIER).count()

    done = spark.read.schema(NODES).parquet(*[f"{path}/{run}/level-{k}" for k in range(len(tops))])
    # subtrees differ in size: many small tasks end together
    finished = binned.mapInArrow(
        _hand_over(tops, trees, seed, len(columns), small), "tree int, bundle long, node long, depth int, rows binary"
    ).repartition(TASKS * _tasks(spark), "tree", "bundle").groupBy("tree", "bundle").applyInArrow(_finish(len(columns), width, weight, deepest), NODES)
    nodes = done.where(F.col("state").isin(SPLIT, LEAF)).unionByName(finished).drop("state", "block")
    model = ForestTable(
        path, tuple(columns), tuple(tuple(e.tolist()) for e in edges), tuple(weight.tolist()), trees, seed
    )
    return _stored(spark, model, nodes)


def _stored(spark: SparkSession, model: ForestTable, nodes: DataFrame) -> ForestTable:
    """Write the nodes as a table and as files, about ``FILE_NODES`` in each; subtrees that one task finished stay
    together, and where a tree has several files the nodes above its subtrees have one of their own."""
    path, weight = model.path, model.weight
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    nodes = model.nodes(spark)
    bits = max(0, math.ceil(math.log2(max(nodes.count(), 1) / max(model.trees, 1) / FILE_NODES)))
    model = replace(model, bits=bits, run=uuid.uuid4().hex[:12])
    shard = F.lit(0).cast("long")
    if bits:
        shard = F.when(F.col("part") == 0, F.lit(1 << bits)).otherwise(F.shiftrightunsigned("part", 64 - bits))
    # only what a file needs travels: names of children follow from the node's, column and bin share a number
    ill = F.col("n1") * F.lit(weight[1])
    needed = nodes.select(
        "tree",
        shard.alias("shard"),
        "node",
        F.when(F.col("feature") >= 0, F.col("feature") * 256 + F.col("bin")).otherwise(-1).alias("split"),
        F.try_divide(ill, F.col("n0") * F.lit(weight[0]) + ill).alias("share"),
    )
    needed.repartition(_tasks(spark, model.trees << bits), "tree", "shard").groupBy("tree", "shard").applyInArrow(
        _write_files(model.files), "tree int, shard long, n long"
    ).write.mode("overwrite").parquet(f"{path}/written")
    about = spark.createDataFrame([(json.dumps(model.__dict__),)], "value string")
    about.coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return model


def save_forest_table(spark: SparkSession, model: ForestTable, path: str) -> ForestTable:
    """A copy of the forest in another folder; in its own it is stored already."""
    return model if path == model.path else _stored(spark, replace(model, path=path), model.nodes(spark))


def load_forest_table(spark: SparkSession, path: str) -> ForestTable:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    about |= {"path": path, "columns": tuple(about["columns"]), "weight": tuple(about["weight"])}
    return ForestTable(**about | {"edges": tuple(tuple(e) for e in about["edges"])})


def _mapped(path: str) -> list[np.ndarray]:
    sizes = np.fromfile(path, "<i8", 3)
    arrays, at = [], sizes.nbytes
    for n, kind in zip((*sizes, sizes[2]), ("<i8", "<i8", "<i8", "<f8")):
        arrays.append(np.memmap(path, kind, "r", at, (int(n),)) if n else np.empty(0, kind))
        at += arrays[-1].nbytes
    return arrays


def _walk(file: list[np.ndarray], at: np.ndarray, bins: np.ndarray, rows: np.ndarray, share: np.ndarray):
    """Lead ``rows`` from their places to leaves, whose shares go to ``share``. Returns the rows that go on in
    another file, and the names of the nodes there."""
    _, elsewhere, steps, shares = file
    values, start = bins.ravel(), rows * bins.shape[1]
    gone, names = [], []
    while len(rows):
        step = steps[at]
        inner = step >= 0
        if not inner.all():
            here = np.flatnonzero(step == -1)
            share[rows[here]] = shares[at[here]]
            away = np.flatnonzero(step < -1)
            gone.append(rows[away])
            names.append(elsewhere[-2 - step[away]])
            inner = np.flatnonzero(inner)
            rows, start, step = rows[inner], start[inner], step[inner]
        at = (step >> 32) + (values[start + ((step >> 8) & 0xFFFFFF)] > (step & 0xFF))
    return np.concatenate([rows, *gone]), np.concatenate([np.empty(0, np.int64), *names])


def _leaf_share(folder: str, tree: int, bits: int, seed: int, bins: np.ndarray) -> np.ndarray:
    """Share of label 1 in the leaf that each row reaches, by the steps in mapped files."""
    share = np.full(len(bins), np.nan)
    rows, name = np.arange(len(bins)), np.full(len(bins), root(tree, seed), np.int64)
    above = _file(folder, tree, 1 << bits)
    if bits and os.path.exists(above):
        rows, name = _walk(_mapped(above), np.zeros(len(bins), np.int64), bins, rows, share)
    shards = (name.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rows), np.int64)
    for shard in np.unique(shards):
        file, here = _mapped(_file(folder, tree, shard)), np.flatnonzero(shards == shard)
        _walk(file, np.searchsorted(file[0], name[here]), bins, rows[here], share)
    return share


def score_forest_table(
    model: ForestTable, rows: DataFrame, key: str = "customer_id", keep: Sequence[str] = (),
    vector: str | None = None,
) -> DataFrame:
    """(key, keep..., churn_probability): the mean of the leaves' shares over all trees, NULL for a forest
    that was grown on nothing."""
    folder, edges = model.files, [np.array(e) for e in model.edges]
    trees, bits, seed, columns = model.trees, model.bits, model.seed, len(model.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch, columns)
            known = trees > 0 and os.path.isdir(folder)
            found = [_leaf_share(folder, t, bits, seed, bins) for t in range(trees)] if known else []
            mean = pa.array(np.mean(found, axis=0)) if found else pa.nulls(len(bins), pa.float64())
            kept = batch.column("key").flatten()
            yield pa.RecordBatch.from_arrays([*kept, mean], names=[*names, "churn_probability"])

    names = [key, *keep]
    held = rows.withColumn("_kept", F.struct(*[F.col(f"`{c}`") for c in names]))
    binned = _binned(held, _values(model.columns, vector), "_kept", None, edges)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in names]).schema)
    # a row costs little to send and the way down every tree to score
    dealt = binned.repartition(_tasks(rows.sparkSession))
    return dealt.mapInArrow(score, f"{fields}, churn_probability double")


def forest_importance(spark: SparkSession, model: ForestTable) -> DataFrame:
    """(feature, importance): impurity taken away, per tree as shares of 1, averaged over the trees that
    split at all. Columns that no tree uses have 0."""
    gains = model.nodes(spark).where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
    of_tree = gains.join(whole, "tree").select("feature", (F.col("gain") / F.col("whole")).alias("part"))
    trees = whole.agg(F.count("*")).scalar()
    names = spark.createDataFrame(list(enumerate(model.columns)), "feature int, name string")
    shares = of_tree.groupBy("feature").agg(F.sum("part").alias("part"))
    return names.join(shares, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce(F.col("part") / trees, F.lit(0.0)).alias("importance")
    )


def forest_checks(spark: SparkSession, model: ForestTable) -> DataFrame:
    """One row: trees, nodes that no split names, split nodes whose children's draws do not add up to
    theirs, importances in sum."""
    nodes = model.nodes(spark)
    wanted = nodes.where("feature >= 0").select(
        "tree", F.col("node").alias("parent"), "n0", "n1", F.explode(F.array("low_child", "high_child")).alias("node")
    )
    found = wanted.join(
        nodes.select("tree", "node", F.col("n0").alias("m0"), F.col("n1").alias("m1")), ["tree", "node"], "full"
    )
    sums = found.groupBy("tree", "parent").agg(
        F.max("n0").alias("n0"), F.max("n1").alias("n1"), F.sum("m0").alias("m0"), F.sum("m1").alias("m1"),
        F.count("*").alias("n"), F.count("m0").alias("n_found"),
    )
    inner = F.col("parent").isNotNull()
    whole = (F.col("n_found") == 2) & (F.col("n0") == F.col("m0")) & (F.col("n1") == F.col("m1"))
    return sums.agg(
        F.sum(F.when(~inner, F.col("n")).otherwise(0)).alias("n_roots"),
        F.count_if(inner & ~F.coalesce(whole, F.lit(False))).alias("n_apart"),
    ).select(
        F.lit(model.trees).cast("long").alias("n_trees"),
        "n_roots",
        "n_apart",
        F.round(forest_importance(spark, model).agg(F.sum("importance")).scalar(), 9).alias("importance"),
    )
