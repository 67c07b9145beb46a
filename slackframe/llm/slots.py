"""Counts of binary decisions in hashed slots, gathered from all tasks.

A slot holds two counts, of zeros and of ones. Each task counts into an array of its own and sends
what isn't empty in chunks; chunks are summed in groups of tasks first, then as a whole, and reach
the driver as 12-bit states: 6 bits for each count, both shrunk alike where one is over 63.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import map_arrow, written

CHUNK = 1 << 16
#: Tasks whose counts are summed first, before the sums are.
GROUP = 16
ROWS = "chunk int, part int, data binary"
#: Bits and greatest value of a count in a state, and the number of states.
BITS = 6
MOST = (1 << BITS) - 1
STATES = 1 << 2 * BITS


def _counts() -> tuple[np.ndarray, np.ndarray]:
    """The counts of every state as it is, with one zero taken out, and with a one; a count of MOST may stand for more and stays."""
    state = np.arange(STATES)
    zeros, ones = state & MOST, state >> BITS
    less = lambda n: np.where(n == MOST, n, np.maximum(n - 1, 0))
    return np.concatenate([zeros, less(zeros), zeros]).astype(np.float32), np.concatenate([ones, ones, less(ones)]).astype(np.float32)


ZEROS, ONES = _counts()
TOTAL = ZEROS + ONES
#: The stretched probability of a one, for each state; then for those without one of their decisions.
STRETCH = np.log((ONES + np.float32(0.2)) / (ZEROS + np.float32(0.2)))


def states(counts: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones in turn -> a state for each pair."""
    zeros, ones = counts[::2].astype(np.float64), counts[1::2].astype(np.float64)
    scale = np.maximum(np.maximum(zeros, ones) / MOST, 1)
    return np.rint(zeros / scale).astype(np.uint16) | (np.rint(ones / scale).astype(np.uint16) << np.uint16(BITS))


def squash(t):
    return 1 / (1 + np.exp(-np.clip(t, -12, 12)))


def in_steps(step: np.ndarray, gate: np.ndarray, gates: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of decisions by step of learning and weight set, and how many there are of each (steps x gates)."""
    key = gate + step.astype(np.uint16) * np.uint16(gates)
    return np.argsort(key, kind="stable"), np.bincount(key, minlength=(int(step[-1]) + 1) * gates).reshape(-1, gates)


def learned(weights: np.ndarray, x: np.ndarray, bit: np.ndarray, sizes: np.ndarray, rate: float) -> np.ndarray:
    """Move weights (a row for each set) online over decisions in the order of in_steps(): their combined inputs, each before its step. x is used up."""
    t, low = np.empty(len(bit), np.float32), 0
    rates = np.where(sizes, rate / np.sqrt(sizes + 1.0), 0.0)
    ends = np.cumsum(sizes, axis=1)
    first = np.minimum(ends - sizes, ends[:, -1:] - 1)
    for k, n in enumerate(ends[:, -1].tolist()):
        if not n:
            continue
        part = x[:, low : low + n]
        now = np.einsum("kn,kn->n", part, weights.T.repeat(sizes[k], axis=1))
        part *= bit[low : low + n] - squash(now)
        weights += (np.add.reduceat(part, first[k], axis=1) * rates[k]).T
        t[low : low + n] = now
        low += n
    return t


def without(bit: np.ndarray, own) -> np.ndarray:
    """What to add to a state to look it up without a decision of the given bit, where own holds."""
    return ((bit > 0).astype(np.uint16) + np.uint16(1)) * np.uint16(STATES) * own


def _packed(part: np.ndarray) -> bytes:
    wide = bool(part.max(initial=0) >= 1 << 16)
    return bytes([wide]) + zlib.compress(part.astype("<u8" if wide else "<u2").tobytes(), 1)


def _opened(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), "<u8" if data[0] else "<u2")


def emitted(flat: np.ndarray, part: int):
    """A task's counts (two for each slot) as rows of ROWS."""
    import pyarrow as pa

    for chunk in range(-(-len(flat) // (2 * CHUNK))):
        piece = flat[2 * chunk * CHUNK : 2 * (chunk + 1) * CHUNK]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part // GROUP], pa.int32()), pa.array([_packed(piece)], pa.binary())], ["chunk", "part", "data"])


def _summed(last: bool):
    """Rows sorted by (chunk, part) -> one for each, or one state row for each chunk."""

    def run(batches):
        import pyarrow as pa

        live, total = None, None

        def done():
            data = states(total).tobytes() if last else _packed(total)
            return pa.RecordBatch.from_arrays([pa.array([live[0]], pa.int32()), pa.array([live[1]], pa.int32()), pa.array([data], pa.binary())], ["chunk", "part", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column(0)[i].as_py(), 0 if last else batch.column(1)[i].as_py()
                piece = _opened(batch.column(2)[i].as_py())
                if at != live:
                    if live is not None:
                        yield done()
                    live, total = at, piece.astype(np.uint64)
                else:
                    total += piece
        if live is not None:
            yield done()

    return run


def gathered(rows: DataFrame, slots: int) -> np.ndarray:
    """Rows of ROWS -> the state of every slot. The driver gets two bytes for each slot, whatever the input."""
    some = rows.repartition("chunk", "part").sortWithinPartitions("chunk", "part")
    whole = map_arrow(some, _summed(False), ROWS).repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros(slots, np.uint16)
    for r in written(map_arrow(whole, _summed(True), ROWS), "states").toLocalIterator():  # the tasks' counts go before
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.data, np.uint16)
    return out
