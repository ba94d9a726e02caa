"""Composition and repeat metrics of a base string, one pass of array kernels over each text."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

METRICS = (
    "gc_pct double, gc_skew double, max_window_gc double, min_window_gc double, max_homopolymer int, max_repeat int, hairpin boolean"
)
STEM = 6
_COMPLEMENT = dict(zip(map(ord, "ACGT"), map(ord, "TGCA")))


def _longest_equal_stretch(bases: np.ndarray, shift: int) -> int:
    """Longest stretch of positions equal to the one ``shift`` later (0 if none)."""
    ends = np.flatnonzero(bases[shift:] != bases[:-shift]) if len(bases) > shift else np.empty(0, np.int64)
    return int(np.diff(np.concatenate(([-1], ends, [max(len(bases) - shift, 0)]))).max()) - 1


def _has_hairpin(bases: np.ndarray) -> bool:
    """Whether the reverse complement of some ``STEM`` bases starts right after them or further down.

    Stems are numbered by halves, so letters of any alphabet fit a 64-bit number, and the last place of each number answers for all.
    """
    if len(bases) < 2 * STEM:
        return False
    letters, codes = np.unique(np.concatenate((bases, np.array(list(_COMPLEMENT), bases.dtype))), return_inverse=True)
    paired = np.searchsorted(letters, [_COMPLEMENT.get(x, x) for x in letters.tolist()])
    forward = codes[: len(bases)].astype(np.int64)
    other = paired[forward]
    wide, half = len(letters), STEM // 2
    ahead = (forward[:-2] * wide + forward[1:-1]) * wide + forward[2:]
    back = (other[2:] * wide + other[1:-1]) * wide + other[:-2]
    kinds, place = np.unique(np.concatenate((ahead, back)), return_inverse=True)
    ahead, back = place[: len(ahead)], place[len(ahead) :]
    stems = ahead[:-half] * len(kinds) + ahead[half:]
    wanted = back[half:] * len(kinds) + back[:-half]
    found, at = np.unique(stems, return_inverse=True)
    last = np.zeros(len(found), np.int64)
    np.maximum.at(last, at, np.arange(len(stems)))
    hit = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
    return bool(((found[hit] == wanted) & (last[hit] >= np.arange(len(wanted)) + STEM)).any())


def _measure(text: str, window: int) -> tuple:
    bases = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size, width = len(bases), min(window, len(bases))
    g, c = int((bases == ord("G")).sum()), int((bases == ord("C")).sum())
    held = np.concatenate(([0], np.cumsum((bases == ord("G")) | (bases == ord("C")))))
    windows = held[width:] - held[:-width]
    repeats = [(m + k) // k * k if (m := _longest_equal_stretch(bases, k)) >= k else 0 for k in (2, 3)]
    return (
        (g + c) * 100.0 / size, (g - c) / (g + c) if g + c else 0.0, int(windows.max()) * 100.0 / width, int(windows.min()) * 100.0 / width,
        _longest_equal_stretch(bases, 1) + 1, max(repeats), _has_hairpin(bases),
    )


def sequence_metrics(seq: Column, window: int = 20) -> Column:
    """Struct of GC percent and skew, extreme window GC, longest homopolymer and tandem repeat,
    and a flag for a six-base stem whose reverse complement follows downstream.

    Runs and repeats are measured as whole stretches, which is what the metric is meant to be.
    A text costs about its own length; an empty or missing one has no metrics.
    """
    names = [field.split()[0] for field in METRICS.split(", ")]

    @F.pandas_udf(METRICS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = [_measure(x, window) if x else (None,) * len(names) for x in texts]
        kinds = dict(zip(names, ["float64"] * 4 + ["Int32"] * 2 + ["boolean"]))
        return pd.DataFrame(rows, columns=names).astype(kinds)

    return measured(F.upper(seq))
