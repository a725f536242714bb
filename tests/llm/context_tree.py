"""The context tree of one process, whole, against which the tree in parts is tested."""

import math
from dataclasses import dataclass, field

import numpy as np

from lexengine.llm.ctw import Known, _log_kt, _prefix


@dataclass
class Tree:
    """Per depth and bit, sorted node keys (context and decision node), estimates of a one and weights.

    weight is the share that a node's own estimate has against its children's mixture; rest is the
    estimate of its contexts that are in no child.
    """

    depth: int
    keys: list[list[np.ndarray]] = field(default_factory=list)
    ones: list[list[np.ndarray]] = field(default_factory=list)
    weight: list[list[np.ndarray]] = field(default_factory=list)
    rest: list[list[np.ndarray]] = field(default_factory=list)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after its other bytes.

        Down a path, the mixture goes as deep as the tree knows both the context and the decision;
        where it ends, the estimate of the rest counts. A decision that no depth has seen is even.
        """
        byte = gram & np.uint64(255)
        out = np.zeros(len(gram))
        for bit in range(8):
            decision = _prefix(byte, bit)
            one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
            q = np.full(len(gram), np.nan)
            for d in range(self.depth, -1, -1):
                keys = self.keys[d][bit]
                if not len(keys):
                    continue
                want = (gram & np.uint64(((1 << 8 * (d + 1)) - 1) & ~255)) | decision
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                at = at[hit]
                deeper = q[hit]
                deeper = np.where(np.isnan(deeper), self.rest[d][bit][at], deeper)
                w = self.weight[d][bit][at]
                q[hit] = w * self.ones[d][bit][at] + (1 - w) * deeper
            q = np.where(np.isnan(q), 0.5, q)
            out += np.log10(np.where(one, q, 1 - q))
        return out

    def prepare(self) -> None:
        self.known = Known(self.grams, self.logs)

    def logs_of(self, gram: np.ndarray) -> np.ndarray:
        found, unknown = self.known.find(gram)
        found[unknown] = self.predict(gram[unknown])
        return found


def fit_tree(tables: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The weighted tree from (grams, counts) of each depth, from 0 up; grams are sorted."""
    depth = len(tables) - 1
    tree = Tree(depth)
    tree.keys, tree.ones, tree.weight, tree.rest = ([[None] * 8 for _ in tables] for _ in range(4))
    for bit in range(8):
        below = None
        for d in range(depth, -1, -1):
            gram, n = tables[d]
            byte = gram & np.uint64(255)
            node = (gram & ~np.uint64(255)) | _prefix(byte, bit)
            one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
            at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
            key = node[at]
            total = np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)
            ones = np.add.reduceat(n * one, at) if len(at) else np.zeros(0, np.int64)
            own = _log_kt(total - ones, ones)
            estimate = (ones + 0.5) / (total + 1)
            weight, rest, weighted = np.ones(len(key)), estimate.copy(), own
            if below is not None:
                child, child_weighted, child_total, child_ones = below
                parent = child & np.uint64((1 << 8 * (d + 1)) - 1)
                place = np.searchsorted(key, parent)
                product, left, left_ones = np.zeros(len(key)), total.astype(float), ones.astype(float)
                np.add.at(product, place, child_weighted)
                np.subtract.at(left, place, child_total)
                np.subtract.at(left_ones, place, child_ones)
                product += _log_kt(left - left_ones, left_ones)
                weight = 1 / (1 + np.exp(np.clip(product - own, -700, 700)))
                rest = np.where(left > 0, (left_ones + 0.5) / (left + 1), estimate)
                weighted = np.logaddexp(own, product) - math.log(2)
            tree.keys[d][bit], tree.ones[d][bit], tree.weight[d][bit], tree.rest[d][bit] = key, estimate.astype(np.float32), weight.astype(np.float32), rest.astype(np.float32)
            below = key, weighted, total, ones
    tree.grams = tables[depth][0]
    tree.logs = tree.predict(tree.grams)
    return tree
