"""Joining the boxes of one island. A small helper that runs inside a Spark task."""

import numpy as np

from zonespark.functions.words import collapse_text

_FAR = 1 << 62


class _Boxes:
    """Boxes under a tree of bounds, to find the earliest one near a rectangle without looking at all.

    The leaves stand in order of place on the raster, so a node bounds boxes close to each other. A node knows the rectangle around the
    boxes below it that are still there and the earliest of their numbers; a branch is entered only if it can improve on what is found.
    """

    def __init__(self, left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray):
        n = len(left)
        self.half = 1 << max(n - 1, 0).bit_length()
        # Strips from left to right, each from top to bottom.
        strips = max(int(n**0.5), 1)
        across = np.argsort(np.argsort(left + right, kind="stable"), kind="stable") * strips // max(n, 1)
        order = np.lexsort((top + bottom, across))
        self.leaf = np.empty(n, np.int64)
        self.leaf[order] = self.half + np.arange(n)
        self.leaf = self.leaf.tolist()
        levels = []
        for values, blank, widest in ((left, _FAR, np.minimum), (top, _FAR, np.minimum), (right, -_FAR, np.maximum),
                                      (bottom, -_FAR, np.maximum), (np.arange(n), _FAR, np.minimum)):
            tree = np.full(2 * self.half, blank, np.int64)
            tree[self.half : self.half + n] = values[order]
            first = self.half
            while first > 1:
                row = tree[first : 2 * first]
                first //= 2
                tree[first : 2 * first] = widest(row[0::2], row[1::2])
            levels.append(tree.tolist())
        self.left, self.top, self.right, self.bottom, self.number = levels

    def earliest_near(self, box: int, gap: int) -> int:
        """The first box whose distance from this one is within the gap on both axes; -1 if there is none."""
        own = self.leaf[box]
        low_x, low_y = self.left[own] - gap, self.top[own] - gap
        high_x, high_y = self.right[own] + gap, self.bottom[own] + gap
        left, top, right, bottom, number = self.left, self.top, self.right, self.bottom, self.number
        best, stack = _FAR, [1]
        while stack:
            node = stack.pop()
            if number[node] >= best or left[node] > high_x or right[node] < low_x or top[node] > high_y or bottom[node] < low_y:
                continue
            if node >= self.half:
                if node != own:
                    best = number[node]
                continue
            a, b = 2 * node, 2 * node + 1
            # The branch with the earlier boxes is entered first.
            stack += (b, a) if number[a] < number[b] else (a, b)
        return best if best < _FAR else -1

    def absorb(self, keeper: int, other: int) -> None:
        """Let a box grow around another, which goes."""
        own, gone = self.leaf[keeper], self.leaf[other]
        rectangle = self.left[gone], self.top[gone], self.right[gone], self.bottom[gone]
        node = own
        while node:
            # What holds the keeper now holds both.
            self.left[node], self.top[node] = min(self.left[node], rectangle[0]), min(self.top[node], rectangle[1])
            self.right[node], self.bottom[node] = max(self.right[node], rectangle[2]), max(self.bottom[node], rectangle[3])
            node //= 2
        self.left[gone] = self.top[gone] = self.number[gone] = _FAR
        self.right[gone] = self.bottom[gone] = -_FAR
        node = gone // 2
        while node:
            a, b = 2 * node, 2 * node + 1
            now = (
                min(self.left[a], self.left[b]), min(self.top[a], self.top[b]), max(self.right[a], self.right[b]),
                max(self.bottom[a], self.bottom[b]), min(self.number[a], self.number[b]),
            )
            if now == (self.left[node], self.top[node], self.right[node], self.bottom[node], self.number[node]):
                break
            self.left[node], self.top[node], self.right[node], self.bottom[node], self.number[node] = now
            node //= 2


def join_boxes(ord, x, y, width, height, text, confidence, gap: int) -> list[dict]:
    """Boxes (one array per column, in detection order) joined until no two are within `gap` on both axes.

    The earliest box that has a near neighbour takes in the first such neighbour and keeps its place; the
    weaker confidence stays. Until a box grows, the ones before it are known to have no neighbour left, so
    after a join only the grown box is compared again.
    """
    left, top = np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)
    boxes = _Boxes(left, top, left + np.asarray(width, dtype=np.int64), top + np.asarray(height, dtype=np.int64))
    confidence, texts = [int(c) for c in confidence], list(text)
    alive = [True] * len(texts)

    def absorb(keeper: int, other: int) -> None:
        boxes.absorb(keeper, other)
        confidence[keeper] = min(confidence[keeper], confidence[other])
        texts[keeper] = collapse_text(f"{texts[keeper]} {texts[other]}")
        alive[other] = False

    for box in range(len(texts)):
        # Boxes before this one have no neighbour left. A box that grows is settled at once, so that goes on to hold.
        while alive[box]:
            near = boxes.earliest_near(box, gap)
            if near < 0:
                break
            if near < box:
                absorb(near, box)
                box = near
            else:
                absorb(box, near)
    kept = [(i, boxes.leaf[i]) for i, here in enumerate(alive) if here]
    return [
        {
            "ord": int(ord[i]), "x": boxes.left[at], "y": boxes.top[at], "width": boxes.right[at] - boxes.left[at],
            "height": boxes.bottom[at] - boxes.top[at], "text": texts[i], "confidence": confidence[i],
        }
        for i, at in kept
    ]
