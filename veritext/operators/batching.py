"""Calls of a plugged model inside a task (E1, R7): batches of similar length,
and failing rows set apart.

A model pads a batch to its longest row, so a batch that mixes short and long
texts mostly computes padding.  The rows of an Arrow batch are ordered by
length and cut into calls whose padded size is limited; results return to
their rows.  Arrow batches are bounded, so this needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ModelBatches:
    """Limits of one call: rows, and rows times the longest length (in words, cut at ``max_length``)."""

    rows: int = 64
    padded: int = 8_192
    max_length: int = 512

    def length(self, text: str) -> int:
        return min(self.max_length, max(1, len(text.split())))

    def calls(self, lengths: Sequence[int]) -> list[np.ndarray]:
        """The rows of each call, by length; a row over the limit is a call of its own."""
        order, out, begin = np.argsort(np.asarray(lengths, dtype=np.int64), kind="stable"), [], 0
        for end in range(1, len(order) + 1):
            full = end == len(order) or end - begin >= self.rows or (end - begin + 1) * lengths[order[end]] > self.padded
            if full:
                out.append(order[begin:end])
                begin = end
        return out


def call_each(call: Callable[[list], Sequence], items: list) -> tuple[list, list]:
    """(results, errors) of a model call on ``items``, null where there is none.

    A call that fails, or gives another number of results, is halved until the
    failing items stand alone.
    """
    if not items:
        return [], []
    try:
        results = list(call(items))
        if len(results) != len(items):
            raise ValueError(f"{len(results)} results for {len(items)} rows")
        return results, [None] * len(items)
    except Exception as e:  # noqa: BLE001  whatever the plugged model raises
        if len(items) == 1:
            return [None], [f"{type(e).__name__}: {e}"[:500]]
        half = len(items) // 2
        first, second = call_each(call, items[:half]), call_each(call, items[half:])
        return first[0] + second[0], first[1] + second[1]


def call_batched(call: Callable[[list], Sequence], items: list, lengths: Sequence[int], batches: ModelBatches | None) -> tuple[list, list]:
    """``call_each`` over calls of similar length; results in the order of ``items``."""
    if batches is None:
        return call_each(call, items)
    results, errors = [None] * len(items), [None] * len(items)
    for rows in batches.calls(lengths):
        for i, r, e in zip(rows, *call_each(call, [items[i] for i in rows]), strict=True):
            results[i], errors[i] = r, e
    return results, errors
