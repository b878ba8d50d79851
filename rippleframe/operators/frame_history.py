"""Statistics of the last frames of a node, at every frame.

Each frame is a vector of cells (antennas times subcarriers). A key's frames are cut into
chunks with the few frames before them repeated, so no task holds a whole key, and a
chunk is worked on as one matrix per run of equally long frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.operators.sequence import CHUNK, CORE, POS, chunked

STATS = ("mean_amplitude", "amplitude_variance", "temporal_delta", "motion_energy", "phase_variance", "subcarrier_variance", "mean_rssi")
#: Frames of a chunk, and frames whose windows are held at once.
CHUNK_FRAMES, BLOCK_FRAMES = 4096, 256


def _runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive frames of equal length."""
    edges = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
    yield from zip(edges.tolist(), np.append(edges[1:], len(size)).tolist())


def _jumps(levels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Steps above mean + 2 deviations in each row of ``levels``, whose last ``counts`` values are set."""
    step = np.abs(np.diff(levels, axis=1))
    set_ = np.arange(step.shape[1]) >= step.shape[1] - (counts[:, None] - 1)
    n = np.maximum(set_.sum(1), 1)
    mean = np.where(set_, step, 0.0).sum(1) / n
    spread = np.sqrt(np.where(set_, (step - mean[:, None]) ** 2, 0.0).sum(1) / n)
    over = (step > (mean + 2 * spread)[:, None]) & set_
    return np.where(counts >= 3, over.sum(1), 0)


def _windows(amp: np.ndarray, phase: np.ndarray, rssi: np.ndarray, antennas: np.ndarray, first: int, rows: int) -> dict[str, list]:
    """Statistics at frames ``first`` and later of one run; each looks back over at most ``rows`` frames."""
    t, cells = amp.shape
    turn = np.diff(phase, axis=0)
    wrapped = (turn + np.pi) % (2 * np.pi) - np.pi
    phase = np.cumsum(np.vstack([phase[:1], np.where(np.abs(turn) < np.pi, turn, wrapped)]), axis=0)
    out: dict[str, list] = {name: [] for name in (*STATS, "change_points", "frame_count", "cells")}
    for start in range(first, t, BLOCK_FRAMES):
        at = np.arange(start, min(start + BLOCK_FRAMES, t))
        index = at[:, None] - np.arange(rows - 1, -1, -1)
        here = index >= 0
        index = np.maximum(index, 0)
        n = here.sum(1)

        def over(values, mask, count):
            return np.where(mask, values, 0.0).sum(1) / np.maximum(count, 1)[:, None]

        mask, a, p = here[:, :, None], amp[index], phase[index]
        mean, p_mean = over(a, mask, n), over(p, mask, n)
        spread = np.where(mask, (a - mean[:, None]) ** 2, 0.0).sum(1)
        step, both = a[:, 1:] - a[:, :-1], mask[:, :-1]
        level = mean.mean(1)
        out["mean_amplitude"] += level.tolist()
        out["amplitude_variance"] += (np.where(mask, (a - level[:, None, None]) ** 2, 0.0).sum((1, 2)) / (n * cells)).tolist()
        out["temporal_delta"] += over(np.abs(step), both, n - 1).mean(1).tolist()
        out["motion_energy"] += over(step**2, both, n - 1).mean(1).tolist()
        out["phase_variance"] += over((p - p_mean[:, None]) ** 2, mask, n).mean(1).tolist()
        out["subcarrier_variance"] += (spread / np.maximum(n - 1, 1)[:, None]).mean(1).tolist()
        out["mean_rssi"] += (np.where(here, rssi[index], 0.0).sum(1) / n).tolist()
        out["change_points"] += _jumps(np.where(here, a.mean(2), 0.0), n).tolist()
        out["frame_count"] += n.tolist()
        out["cells"] += [m.reshape(k, -1).mean(0) if k and cells % k == 0 else m for m, k in zip(mean, antennas[at])]
    return out


def frame_history(seq: DataFrame, key: Sequence[str], keep: Sequence[str], rows: int = 16) -> DataFrame:
    """``key``, ``keep`` and the statistics of the last ``rows`` frames at every frame of ``seq``.

    ``seq`` is a sequence (see ``sequence``) with columns amplitude and phase (arrays of equal length), rssi
    and antennas. The first frames of a key have shorter windows. A frame of another length than the
    one before starts a new window. Frames without cells have null statistics and no cells.
    ``cells`` is the mean amplitude of each subcarrier over frames and antennas.
    """
    key, keep = list(key), list(keep)
    numbers = {name: pa.float64() for name in STATS} | {"change_points": pa.int64(), "frame_count": pa.int64()}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        core = table.column(CORE).to_numpy(zero_copy_only=False)
        rssi, antennas = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rssi", "antennas"))
        amp, phase = (table.column(c).combine_chunks() for c in ("amplitude", "phase"))
        size = amp.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        parts: list[dict[str, list]] = []
        for start, stop in _runs(size):
            n, own = stop - start, core[start:stop]
            if not own.any():
                continue
            first = int(np.argmax(own))
            if size[start] == 0:
                parts.append({name: [None] * (n - first) for name in (*STATS, "change_points", "frame_count")} | {"cells": [[]] * (n - first)})
                continue
            a, p = (v.slice(start, n).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for v in (amp, phase))
            parts.append(_windows(a, p, rssi[start:stop].astype(float), antennas[start:stop], first, rows))
        own = table.filter(pa.array(core))
        columns = {name: pa.array([v for part in parts for v in part[name]], kind) for name, kind in numbers.items()}
        cells = pa.array([v for part in parts for v in part["cells"]], pa.list_(pa.float64()))
        return pa.table({c: own.column(c) for c in (*key, *keep)} | columns | {"cells": cells})

    kinds = {f.name: f.dataType.simpleString() for f in seq.schema.fields}
    schema = [f"{c} {kinds[c]}" for c in (*key, *keep)] + [f"{c} double" for c in STATS] + ["change_points bigint", "frame_count bigint", "cells array<double>"]
    need = seq.select(*key, *dict.fromkeys([*keep, POS, "amplitude", "phase"]), F.col("rssi"), F.col("antennas"))
    cut = chunked(need, before=rows - 1, size=CHUNK_FRAMES)
    return cut.groupBy(*key, CHUNK).applyInArrow(run, ", ".join(schema))
