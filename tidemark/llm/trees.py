"""Decision trees fitted by Spark, as plain nodes that compile into column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+.eE0-9]+)\)")
_LEAF = re.compile(r"Predict: ([-+.eE0-9]+)")


@dataclass(frozen=True)
class Node:
    """An inner node (feature at most ``cut`` goes left) or a leaf (``feature`` None)."""

    value: float = 0.0
    feature: int | None = None
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def paths(self, above: tuple = ()) -> list[tuple[tuple[int, str, float], ...]]:
        """The conditions from the root to every node below it."""
        if self.feature is None:
            return []
        found = []
        for child, side in ((self.left, "<="), (self.right, ">")):
            path = (*above, (self.feature, side, self.cut))
            found += [path, *child.paths(path)]
        return found

    def column(self, feature: Callable[[int], Column]) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(feature(self.feature) <= F.lit(self.cut), self.left.column(feature)).otherwise(self.right.column(feature))


def read_tree(text: str) -> Node:
    """The tree that a fitted model describes in its debug string."""
    lines = [line.strip() for line in text.splitlines() if _SPLIT.search(line) or _LEAF.search(line)]

    def node(at: int) -> tuple[Node, int]:
        if leaf := _LEAF.search(lines[at]):
            return Node(value=float(leaf[1])), at + 1
        split = _SPLIT.search(lines[at])
        left, after = node(at + 1)
        right, after = node(after + 1)  # skips the Else line
        return Node(feature=int(split[2]), cut=float(split[4]), left=left, right=right), after

    return node(0)[0]


def trees_of(model) -> list[Node]:
    return [read_tree(tree.toDebugString) for tree in model.trees]
