"""A prefix tree of sets whose elements stand in one global order, and linking by traversing it.

Sets hold the ranks of their shared elements in ascending order, frequent elements
first, so that alike sets share long paths. A query walks the tree once: the overlap with
a path counts for every set below it, and a subtree is left out where even all that remains
of the query and of its longest set would not reach the threshold for its smallest set,
or where everything in it is already linked to the query.
"""

from __future__ import annotations

import numpy as np


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class _Node:
    __slots__ = ("seg", "kids", "ends", "least", "most", "reach", "mark")

    def __init__(self, seg, least, most, reach, mark):
        self.seg, self.kids, self.ends = seg, {}, []
        self.least, self.most, self.reach, self.mark = least, most, reach, mark


class PrefixTree:
    """Sets ``items[i]`` (ascending ranks below ``vocabulary``) of full sizes ``sizes[i]``.

    Full sizes also count the elements that no other set holds; those are not
    stored. Two sets are linked where 100 * intersection >= ``percent`` * union.
    """

    def __init__(self, items: list[np.ndarray], sizes: list[int], vocabulary: int, union: Union, percent: int):
        self.items, self.sizes, self.union, self.percent = items, sizes, union, percent
        self.mask = np.zeros(vocabulary, np.uint8)
        self.root = _Node(np.zeros(0, np.int64), 1 << 60, 0, 0, None)
        self.added = 0

    def add(self, i: int) -> None:
        x, n, m = self.items[i], self.sizes[i], len(self.items[i])
        node, at = self.root, 0
        if not self.added:
            node.mark = i
        self._widen(node, i, n, m)
        while at < m:
            kid = node.kids.get(int(x[at]))
            if kid is None:
                kid = node.kids[int(x[at])] = _Node(x[at:], n, n, m, i)
                node, at = kid, m
                break
            width = min(len(kid.seg), m - at)
            differs = np.flatnonzero(kid.seg[:width] != x[at : at + width])
            same = int(differs[0]) if len(differs) else width
            if same < len(kid.seg):
                top = _Node(kid.seg[:same], kid.least, kid.most, kid.reach, kid.mark)
                kid.seg = kid.seg[same:]
                top.kids[int(kid.seg[0])] = kid
                node.kids[int(x[at])] = top
                kid = top
            self._widen(kid, i, n, m)
            node, at = kid, at + same
        node.ends.append(i)
        self.added += 1
        if self.added % 256 == 0:
            self._settle()

    def _widen(self, node: _Node, i: int, n: int, m: int) -> None:
        node.least, node.most, node.reach = min(node.least, n), max(node.most, n), max(node.reach, m)
        if node.mark is not None and self.union.find(node.mark) != self.union.find(i):
            node.mark = None

    def _settle(self) -> None:
        """Mark again the subtrees whose sets have all been linked since they were mixed."""
        order, stack = [], [self.root]
        while stack:
            order.append(stack.pop())
            stack.extend(order[-1].kids.values())
        for node in reversed(order):
            marks = [k.mark for k in node.kids.values()] + node.ends
            if marks and None not in marks and len({self.union.find(k) for k in marks}) == 1:
                node.mark = marks[0]

    def link(self, i: int) -> list[tuple[int, int]]:
        """Links of set ``i`` to sets of the tree that it was not yet connected to."""
        x, n, union, pc = self.items[i], self.sizes[i], self.union, self.percent
        found, mask = [], self.mask
        mask[x] = 1
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if pc * n > 100 * node.most or pc * node.least > 100 * n:
                continue
            if node.mark is not None and union.find(node.mark) == union.find(i):
                continue
            if len(node.seg):
                overlap += int(mask[node.seg].sum())
                depth += len(node.seg)
            for j in node.ends:
                if 100 * overlap >= pc * (n + self.sizes[j] - overlap) and j != i and union.join(i, j):
                    found.append((i, j))
            if not node.kids:
                continue
            left = len(x) - (int(np.searchsorted(x, node.seg[-1], side="right")) if len(node.seg) else 0)
            near = []
            for first, kid in node.kids.items():
                most = overlap + min(kid.reach - depth, left)
                if (100 + pc) * most >= pc * (n + kid.least):
                    (near if mask[first] else stack).append((kid, overlap, depth))
            stack.extend(near)
        mask[x] = 0
        return found


def link_sets(
    items: list[np.ndarray], sizes: list[int], vocabulary: int, percent: int,
    labels: list[int] | None = None, queries: list[int] | None = None,
) -> list[tuple[int, int]]:
    """Links that connect whatever the threshold connects.

    Without ``queries`` every set meets every other; with them, each query meets every set that is
    not a query. ``labels`` (set numbers) tell what is connected already.
    """
    union = Union(len(items))
    for i, j in enumerate(labels or ()):
        union.join(i, j)
    tree = PrefixTree(items, sizes, vocabulary, union, percent)
    out: list[tuple[int, int]] = []
    if queries is None:
        for i in range(len(items)):
            out += tree.link(i) if i else []
            tree.add(i)
        return out
    asked = set(queries)
    for i in range(len(items)):
        if i not in asked:
            tree.add(i)
    for i in queries:
        out += tree.link(i)
    return out
