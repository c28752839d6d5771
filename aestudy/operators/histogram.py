"""Gradient histograms for boosting: one job sums a whole tree's worth of them.

Cells are held as blocks of numpy arrays, a few per partition, in a persisted RDD: a boosting run makes
thousands of small passes over the same numbers, and a pass over an RDD is one job without planning or
conversion. A pass adds up gradients, Hessians and cell counts per (node, feature, bin), and the
validation loss of the margins it works with.

The best split of a node is known only when its histogram is, so a tree would take a pass per level. But
trees of neighbouring rounds seldom differ: under every node, the split last chosen there is taken as a guess,
and the same pass also sums the histograms below it. The driver then grows the tree from exact
histograms; where a guess was wrong, one more pass fetches what is missing. Of two children only one is
summed, the other is the difference to the parent. What comes back is nodes x features x bins, whatever
the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy.operators.splits import MIN_GAIN, Features, SplitRules, number_value
from aestudy.operators.tree import Node, Tree

#: A split as (feature number, threshold, whether missing values go right); nodes are named by the way to them.
Split = tuple[int, float, bool]
Way = tuple[tuple[Split, int], ...]

CELLS_PER_BLOCK = 100_000


@dataclass(frozen=True)
class Block:
    """Cells of one partition: raw features, bins of training cells, sums and margins."""

    x: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    e: np.ndarray
    valid: np.ndarray
    f: np.ndarray


@dataclass
class Layout:
    """Features in the order of the histograms, with the values of their bins; the last bin is for missing ones."""

    names: list[str]
    values: list[np.ndarray]
    binned: list[bool]
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum([len(v) + 1 for v in self.values])])

    @property
    def width(self) -> int:
        return int(self.starts[-1])


def feature_layout(cells: DataFrame, features: Features) -> Layout:
    """Distinct training values per feature; wide features are cut to bins before, so these are few."""
    sets = [F.sort_array(F.collect_set(number_value(c))).alias(f"v{i}") for i, c in enumerate(features.columns)]
    row = cells.where("NOT __valid").agg(*sets).first()
    return Layout(features.columns, [np.array(row[f"v{i}"], dtype=float) for i in range(len(sets))], [c in features.binned for c in features.columns])


def block_cells(cells: DataFrame, layout: Layout) -> RDD:
    """The cells as blocks, with margins of 0."""
    names = layout.names
    values, starts = layout.values, layout.starts

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)])
                yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "cells": [columns.tobytes()]})

    def blocks(rows: Iterator) -> Iterator[Block]:
        held, size = [], 0

        def block() -> Block:
            data = np.concatenate(held)
            x = data[:, : len(names)]
            valid = data[:, -1] > 0
            bins = np.zeros(x.shape, dtype=np.int32)
            for j, known in enumerate(values):
                place = np.searchsorted(known, x[:, j])
                bins[:, j] = starts[j] + np.where(np.isnan(x[:, j]), len(known), np.minimum(place, len(known)))
            return Block(x, bins, data[:, -3], data[:, -2], valid, np.zeros(len(data)))

        for r in rows:
            held.append(np.frombuffer(r["cells"]).reshape(r["rows"], -1))
            size += r["rows"]
            if size >= CELLS_PER_BLOCK:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    numbers = [number_value(c) for c in names] + [F.col("__y"), F.col("__e"), F.col("__valid").cast("double")]
    packed = cells.select(*[n.cast("double").alias(f"c{i}") for i, n in enumerate(numbers)]).mapInArrow(gather, "rows long, cells binary")
    return packed.rdd.mapPartitions(blocks)


def with_margins(blocks: RDD, trees: Sequence[tuple]) -> RDD:
    """Blocks whose margins are those of ``trees``, added in order."""
    if not trees:
        return blocks
    shared = blocks.context.broadcast(list(trees))
    return blocks.map(lambda b: Block(b.x, b.bins, b.y, b.e, b.valid, walk(shared.value, b.x, b.f)))


def walk(trees: Sequence[tuple], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``start`` and the leaf values of flattened trees, added in order."""
    total = start
    rows = np.arange(len(x))
    for feature, threshold, yes, no, missing, leaf, depth in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            value = x[rows, feature[at]]
            at = np.where(np.isnan(value), missing[at], np.where(value < threshold[at], yes[at], no[at]))
        total = total + leaf[at]
    return total


@dataclass
class Sketch:
    """Splits below the root as arrays, and which nodes a pass sums."""

    feature: np.ndarray
    threshold: np.ndarray
    missing_right: np.ndarray
    left: np.ndarray  # the right child is the next; -1 for nodes without a split
    slot: np.ndarray
    depth: int
    slots: int


def sketch(ways: Sequence[Way], splits: dict[Way, Split], summed: set[Way]) -> tuple[Sketch, dict[Way, int]]:
    """The tree over ``ways`` (parents first) and the slot of each way that is to be summed."""
    place = {w: i for i, w in enumerate(ways)}
    slots = {w: k for k, w in enumerate(w for w in ways if w in summed)}
    own = [splits.get(w) if w + ((splits.get(w), 0),) in place else None for w in ways]
    return (
        Sketch(
            np.array([s[0] if s else 0 for s in own]),
            np.array([s[1] if s else 0.0 for s in own]),
            np.array([bool(s and s[2]) for s in own]),
            np.array([place[w + ((s, 0),)] if s else -1 for w, s in zip(ways, own)]),
            np.array([slots.get(w, -1) for w in ways]),
            max(len(w) for w in ways),
            len(slots),
        ),
        slots,
    )


def block_sums(block: Block, trees: Sequence[tuple], plan: Sketch, width: int, widen: float) -> np.ndarray:
    """Validation loss, and per slot the sums of g, h and cells of every bin, flat in one array."""
    margin = walk(trees, block.x, block.f)
    mean = block.e * np.exp(np.minimum(margin, 700.0))
    valid = block.valid
    loss = float((mean[valid] - block.y[valid] * margin[valid]).sum())
    train = ~valid
    bins, x = block.bins[train], block.x[train]
    g = mean[train] - block.y[train]
    h = mean[train] * widen
    sums = np.zeros((3, plan.slots * width))
    at = np.zeros(len(x), dtype=np.int64)
    for depth in range(plan.depth + 1):
        own = plan.slot[at]
        here = np.flatnonzero((own >= 0) & (at >= 0))
        if len(here):
            for j in range(bins.shape[1]):
                code = own[here] * width + bins[here, j]
                for k, weights in enumerate((g[here], h[here], None)):
                    sums[k] += np.bincount(code, weights=weights, minlength=plan.slots * width)
        if depth == plan.depth:
            break
        down = plan.left[at] >= 0
        rows, at = np.flatnonzero(down), at[down]
        x, bins, g, h = x[rows], bins[rows], g[rows], h[rows]
        value = x[np.arange(len(x)), plan.feature[at]]
        right = np.where(np.isnan(value), plan.missing_right[at], value >= plan.threshold[at])
        at = plan.left[at] + right
    return np.concatenate([[loss], sums.ravel()])


@dataclass
class Choice:
    split: Split
    gain: float
    total: tuple[float, float]
    left: tuple[float, float]
    right: tuple[float, float]


def gains(rules: SplitRules, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    size, total = np.abs(g), h + rules.reg_lambda
    if not rules.max_delta_step:
        return size * size / total
    weight = np.minimum(size / total, rules.max_delta_step)
    return weight * (2 * size - total * weight)


def best_choice(sums: np.ndarray, layout: Layout, rules: SplitRules) -> Choice | None:
    """The cut with the largest gain from one node's histogram; ties go to the feature's name and the lower threshold."""
    found: list[tuple[tuple, Choice]] = []
    for j, values in enumerate(layout.values):
        g, h, n = sums[:, layout.starts[j] : layout.starts[j + 1]]
        seen = n[:-1] > 0
        own, (miss_g, miss_h, miss_n) = values[seen], (g[-1], h[-1], n[-1])
        if not len(own):
            continue
        run_g, run_h = np.cumsum(g[:-1][seen]), np.cumsum(h[:-1][seen])
        tot_g, tot_h = run_g[-1] + miss_g, run_h[-1] + miss_h
        after = own[1:]
        middle = own[:-1] / 2 + after / 2 if np.abs(own[np.isfinite(own)]).max(initial=0) > 1e300 else (own[:-1] + after) / 2
        cut = after if layout.binned[j] else np.where((middle > own[:-1]) & (middle <= after), middle, after)
        sides = [(cut, run_g[:-1] + miss_g, run_h[:-1] + miss_h, False)]
        if miss_n > 0:
            beyond = own[-1] + abs(own[-1]) + MIN_GAIN
            sides.append((np.append(cut, beyond), run_g, run_h, True))
        for thresholds, left_g, left_h, missing_right in sides:
            right_g, right_h = tot_g - left_g, tot_h - left_h
            gain = gains(rules, left_g, left_h) + gains(rules, right_g, right_h) - gains(rules, tot_g, tot_h)
            fine = (np.minimum(left_h, right_h) >= rules.min_child_weight) & (gain > MIN_GAIN) & (gain >= rules.gamma)
            if not fine.any():
                continue
            k = int(np.argmax(np.where(fine, gain, -np.inf)))
            choice = Choice((j, float(thresholds[k]), missing_right), float(gain[k]), (float(tot_g), float(tot_h)), (float(left_g[k]), float(left_h[k])), (float(right_g[k]), float(right_h[k])))
            found.append(((-choice.gain, layout.names[j], choice.split[1], missing_right), choice))
    return min(found, key=lambda f: f[0])[1] if found else None


class TreeGrower:
    """Grows the trees of a boosting run, remembering under every way which split was chosen last."""

    def __init__(self, layout: Layout, rules: SplitRules, max_depth: int, eta: float) -> None:
        self.layout, self.rules, self.max_depth, self.eta = layout, rules, max_depth, eta
        self.last: dict[Way, Split] = {}
        self.passes = 0

    def sums(self, blocks: RDD, trees: Sequence[tuple], known: dict[Way, np.ndarray], chosen: dict[Way, Choice | None]) -> float:
        """One pass: adds histograms to ``known`` for the open nodes and for guesses below; the loss is returned."""
        ways: list[Way] = [()]
        splits: dict[Way, Split] = {}
        summed: set[Way] = set()
        differences: list[tuple[Way, Way, Way]] = []
        for way in ways:
            if not way and way not in known:
                summed.add(way)
            decided = chosen[way].split if chosen.get(way) else None
            split = decided if way in chosen else self.last.get(way)
            if split is None or len(way) + 1 >= self.max_depth:
                continue
            splits[way] = split
            left, right = way + ((split, 0),), way + ((split, 1),)
            ways += [left, right]
            if left not in known:
                summed.add(left)
                differences.append((way, left, right))
        plan, slots = sketch(ways, splits, summed)
        width, widen = self.layout.width, exp(self.rules.max_delta_step)
        fresh = list(trees)
        total = blocks.map(lambda b: block_sums(b, fresh, plan, width, widen)).treeReduce(np.add)
        self.passes += 1
        by_slot = total[1:].reshape(3, plan.slots, width)
        for way, k in slots.items():
            known[way] = by_slot[:, k]
        for way, left, right in differences:
            known[right] = known[way] - known[left]
        return float(total[0])

    def grow(self, blocks: RDD, trees: Sequence[tuple], known: dict[Way, np.ndarray]) -> Tree:
        """The next tree; ``known`` holds the root's histogram and whatever else the first pass has summed."""
        chosen: dict[Way, Choice | None] = {}
        level: list[Way] = [()]
        for _ in range(self.max_depth):
            if any(w not in known for w in level):
                self.sums(blocks, trees, known, chosen)
            following: list[Way] = []
            for way in level:
                choice = best_choice(known[way], self.layout, self.rules)
                chosen[way] = choice
                if choice is None:
                    self.last.pop(way, None)
                    continue
                self.last[way] = choice.split
                following += [way + ((choice.split, side),) for side in (0, 1)]
            level = following
            if not level:
                break
        return self.as_tree(chosen, known[()])

    def as_tree(self, chosen: dict[Way, Choice | None], root: np.ndarray) -> Tree:
        """Nodes numbered breadth-first."""

        def leaf(nodeid: int, depth: int, own: tuple[float, float]) -> Node:
            return Node(nodeid, depth, cover=own[1], leaf=self.eta * self.rules.leaf_weight(*own))

        first = root[:2, : self.layout.starts[1]].sum(axis=1)
        nodes = [leaf(0, 0, (float(first[0]), float(first[1])))]
        queue: list[tuple[Way, int]] = [((), 0)]
        for way, nodeid in queue:
            choice = chosen.get(way)
            if choice is None:
                continue
            j, threshold, missing_right = choice.split
            name, depth, yes = self.layout.names[j], len(way), len(nodes)
            nodes[nodeid] = Node(nodeid, depth, name, threshold, yes, yes + 1, yes + missing_right, choice.gain, choice.total[1], None, name)
            nodes += [leaf(yes, depth + 1, choice.left), leaf(yes + 1, depth + 1, choice.right)]
            queue += [(way + ((choice.split, 0),), yes), (way + ((choice.split, 1),), yes + 1)]
        return Tree(nodes)


def persist_blocks(blocks: RDD) -> RDD:
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)
