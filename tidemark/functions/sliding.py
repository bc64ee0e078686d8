"""Running counts over sliding windows, on arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need not have this package


def first_start(pane: int, size: int, slide: int) -> int:
    """Start of the first window that has the pane."""
    return ((pane - size) // slide + 1) * slide


def running_windows(at: np.ndarray, codes: np.ndarray, cnt: np.ndarray, n_codes: int, start: int, end: int,
                    size: int, slide: int, top: int | None) -> Iterator[tuple]:
    """(window start, codes, counts) of the windows from ``start`` to ``end`` that have panes (``at``, ascending).

    Panes enter and leave a running count by code; with ``top`` only its highest are given, ties to the smaller code."""
    total, i, j = np.zeros(n_codes, dtype=np.int64), 0, 0
    while start <= end:
        lo, hi = np.searchsorted(at, (start, start + size))
        if lo == hi:                                      # no pane in it: on to the first window that has the next
            if lo == len(at):
                return
            start = max(start + slide, first_start(int(at[lo]), size, slide))
            continue
        np.add.at(total, codes[j:hi], cnt[j:hi])
        np.subtract.at(total, codes[i:lo], cnt[i:lo])
        i, j = int(lo), int(hi)
        some = np.unique(codes[i:j]) if j - i < n_codes // 8 else np.flatnonzero(total)
        if top is not None and len(some) > top:
            rank = total[some] * n_codes + (n_codes - 1 - some)
            some = some[np.argpartition(rank, -top)[-top:]]
        yield start, some, total[some]
        start += slide


def window_rows(found: list[tuple], names: list, start_col: str) -> pd.DataFrame:
    """Rows (start, key, count) of what :func:`running_windows` gave."""
    lengths = [len(some) for _, some, _ in found]
    keys = np.array([*names, None], dtype=object)[np.concatenate([some for _, some, _ in found])]
    return pd.DataFrame({start_col: np.repeat([s for s, _, _ in found], lengths), "key": keys,
                         "cnt": np.concatenate([c for _, _, c in found])})


def coded(keys, number: bool) -> tuple[list, np.ndarray]:
    """The distinct keys in ascending order (null first; strings by their bytes), and each key's place among them."""
    keys = [k if isinstance(k, str) else None for k in keys]
    names = sorted(set(keys), key=lambda k: (k is not None, (int(k) if number else k.encode()) if k is not None else 0))
    code = {k: i for i, k in enumerate(names)}
    return names, np.fromiter((code[k] for k in keys), dtype=np.int64, count=len(keys))


def top_of_block(block: int, panes: pd.DataFrame, size: int, slide: int, width: int, top: int, number: bool) -> pd.DataFrame:
    """The ``top`` highest counts of each window that starts in a block."""
    panes = panes.sort_values("pane_us", kind="stable")
    at = panes["pane_us"].to_numpy(dtype=np.int64)
    names, codes = coded(panes["key"].tolist(), number)
    start = max(first_start(int(at[0]), size, slide), -(-block * width // slide) * slide)
    end = min(((block + 1) * width - 1) // slide, int(at[-1]) // slide) * slide
    found = [*running_windows(at, codes, panes["cnt"].to_numpy(dtype=np.int64), len(names), start, end, size, slide, top)]
    return window_rows(found, names, "start_us") if found else pd.DataFrame({"start_us": [], "key": [], "cnt": []})
