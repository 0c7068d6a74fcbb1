"""Enhanced suffix array over chosen suffixes, and the maximal repeats that its interval tree holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class EnhancedSuffixArray:
    """Suffixes of ``data`` that begin at ``starts`` and end at ``ends``, in order, with common prefix lengths."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        sizes = ends - starts
        width = int(sizes.max(initial=1))
        padded = np.concatenate((data, np.zeros(width, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, width)[starts].copy()
        rows[np.arange(width)[None, :] >= sizes[:, None]] = 0
        self.order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        ranked, size = rows[self.order], sizes[self.order]
        differ = ranked[1:] != ranked[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if len(ranked) > 1 else np.zeros(0, np.int64)
        #: ``common[i]``: the common prefix of the suffixes ranked i - 1 and i.
        self.common = np.concatenate(([0], np.minimum(first, np.minimum(size[1:], size[:-1]))))[: len(starts)]

    def maximal_repeats(
        self, least: int, left: np.ndarray, age: np.ndarray
    ) -> Iterator[tuple[int, int, int, list[int], int]]:
        """Scans the tree of common-prefix intervals with a stack.

        ``left[i]`` is the byte before suffix i, or under 0 if it has none or it is not known; ``age`` orders
        the suffixes from the earliest. Yields (length, first rank, last rank, later, earliest) for every
        interval of ``least`` bytes or more whose occurrences have different bytes before them, so that no
        longer string has the same occurrences. All its occurrences are the suffixes of these ranks;
        ``later`` lists those for which it is the longest repeat with an earlier occurrence.
        """
        order = self.order.tolist()
        lefts, ages = left[self.order].tolist(), age[self.order].tolist()
        common = [x if x >= least else 0 for x in self.common.tolist()]
        # an open interval: [length, first rank, earliest suffix, its age, byte before all or -1, later ones]
        stack: list[list] = []
        for i in range(len(order) + 1):
            depth = common[i] if i < len(order) else 0
            child = None if i == 0 else [0, i - 1, order[i - 1], ages[i - 1], lefts[i - 1], []]
            while stack and stack[-1][0] > depth:
                top = stack.pop()
                if child is not None:
                    self._join(top, child)
                if top[4] < 0:
                    yield top[0], top[1], i - 1, top[5], top[2]
                child = [0, top[1], top[2], top[3], top[4], []]
            if depth:
                if stack and stack[-1][0] == depth:
                    if child is not None:
                        self._join(stack[-1], child)
                else:
                    child[0] = depth
                    stack.append(child)

    @staticmethod
    def _join(interval: list, child: list) -> None:
        if child[3] < interval[3]:
            interval[5].append(interval[2])
            interval[2], interval[3] = child[2], child[3]
        else:
            interval[5].append(child[2])
        if interval[4] != child[4]:
            interval[4] = -1
