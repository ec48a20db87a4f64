"""Label masking of chat sequences for supervised fine-tuning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def mask(ids: np.ndarray, marker: np.ndarray, eos: int, pad: int, ignored: int) -> np.ndarray:
    """Labels of one sequence; see :func:`sft_labels`."""
    n, k = len(ids), len(marker)
    labels = np.full(n, ignored, np.int64)
    if n <= k:
        return labels
    windows = np.lib.stride_tricks.sliding_window_view(ids, k)
    begins = np.flatnonzero((windows == marker).all(axis=1))
    ends, quiet = np.flatnonzero(ids == eos), np.flatnonzero((ids != eos) & (ids != pad))
    at = 1
    for begin in begins[begins >= 1].tolist():
        if begin < at:
            continue
        e = np.searchsorted(ends, begin)
        if e == len(ends):
            at = n
        else:  # through the end, and the pads and ends behind it
            q = np.searchsorted(quiet, ends[e])
            at = int(quiet[q]) if q < len(quiet) else n
        labels[begin - 1 : at - 1] = ids[begin:at]
    return labels


def sft_labels(ids: Column, marker: list[int], eos: int, pad: int = 0, ignored: int = IGNORED) -> Column:
    """Labels of a sequence: the ids of assistant turns, shifted left by one, ``ignored`` elsewhere.

    A turn begins at a ``marker`` (never at the first position), runs through the first ``eos``, and takes the pads and
    further ends right behind it; without ``eos`` it runs to the end. Null stays null. Linear in the length.
    """
    if not marker:
        raise ValueError("marker is empty")
    wanted = np.array(marker, np.int64)

    def run(lists: pa.Array) -> pa.Array:
        out = [None if x is None else mask(np.array(x, np.int64), wanted, eos, pad, ignored).astype(np.int32) for x in lists.to_pylist()]
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(ids.cast("array<int>"))
