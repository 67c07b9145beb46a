"""The spelling of a word, bit by bit.

Bytes are cut into binary decisions along a Huffman code of the training bytes. For each decision
several predictors, looked up by a hash of the last 0 to 6 bytes, of the word so far, and of the
place in the code, give a probability from counts over the distinct training words. They are
combined in the logistic domain by weights, of which a set is chosen by how far back the contexts
are known; the weights are learned online, word by word, with each word's own share taken out of the
counts. An adaptive table then refines the combined probability by the last byte.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import binary_values, map_arrow, written
from slackframe.llm.slots import ROWS, STRETCH, TOTAL, emitted, gathered, in_steps, learned, without
from slackframe.llm.slots import squash as _squash

#: Bytes of context of each predictor; -1 is the word so far.
ORDERS = (0, 1, 2, 3, 4, 6, -1)
#: Slots of each predictor as a power of two: at most these, less for few training words.
MOST_BITS = (13, 16, 18, 19, 20, 20, 20)
K = len(ORDERS)
GATES = 5 * 4 * 3
PAD = 6
#: Step of the online learning of the mixing weights.
RATE = 0.02
STEP_WORDS = 256
#: Steps whose inputs are made ready at once, and their bytes.
STEPS, STEP_BYTES = 4, 30_000
#: Distinct words, about, of a block in which mixing weights are learned, and the fewest blocks; counts and weights come from all words.
BLOCK_WORDS, LEARN_BLOCKS = 25_000, 8
BUCKETS = 24
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: The parts of the weight set, by how often the word so far, and contexts of 4 and 6 bytes, were met.
_GATE = {
    6: (np.digitize(TOTAL, (0.5, 1.5, 4, 20)) * 12).astype(np.uint8),
    4: (np.digitize(TOTAL, (0.5, 3, 30)) * 3).astype(np.uint8),
    5: np.digitize(TOTAL, (0.5, 3)).astype(np.uint8),
}


def table_bits(words: int) -> tuple[int, ...]:
    """Slots grow with the number of distinct training words, two for each, up to MOST_BITS."""
    return tuple(min(b, max(17, (2 * max(words, 1)).bit_length())) for b in MOST_BITS)


def offsets(bits) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([1 << b for b in bits])])


def huffman(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of 256 bytes -> for each byte its decisions: nodes and bits (256 x longest), and how many."""
    heap = [(int(n) + 1, b, b) for b, n in enumerate(histogram)]
    heapq.heapify(heap)
    parent, nxt = {}, 256
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (nxt, 0), (nxt, 1)
        heapq.heappush(heap, (n + m, nxt, nxt))
        nxt += 1
    paths = []
    for b in range(256):
        path, at = [], b
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        paths.append(path[::-1])
    longest = max(map(len, paths))
    nodes, bits = np.zeros((256, longest), np.uint64), np.zeros((256, longest), np.uint8)
    for b, path in enumerate(paths):
        for k, (node, bit) in enumerate(path):
            nodes[b, k], bits[b, k] = node, bit
    return nodes, bits, np.array([len(p) for p in paths])


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


class Decisions:
    """All binary decisions of some words: slot of each predictor, bit, last byte, word."""

    def __init__(self, words: list[bytes], code, table: tuple[int, ...]):
        nodes, bits, depth = code
        pad = b"\0" * PAD
        flat = np.frombuffer(b"".join([pad + w + b" " for w in words]), np.uint8)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.cumsum(sizes + PAD) - sizes
        where = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        wide = flat.astype(np.uint64)
        contexts = []
        for order in ORDERS:
            if order >= 0:
                h = np.full(len(where), order + 1, np.uint64)
                for k in range(1, order + 1):
                    h = (h ^ (h >> np.uint64(31))) * _MIX + wide[where - k]
                if order == 0:
                    h = h + np.minimum(where - np.repeat(starts, sizes), 15).astype(np.uint64)
            else:
                power = np.cumprod(np.full(len(flat) + 1, _ODD, np.uint64))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * power[:-1], dtype=np.uint64)])
                first = np.repeat(starts, sizes)
                undo = np.cumprod(np.full(len(flat) + 1, _INVERSE, np.uint64))
                h = (sums[where] - sums[first]) * undo[first] + np.uint64(77)
            contexts.append((h ^ (h >> np.uint64(29))) * _MIX)
        byte = flat[where]
        times = depth[byte]
        of = np.repeat(np.arange(len(where)), times)
        step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        node = nodes[byte[of], step]
        self.bit = bits[byte[of], step].astype(np.float32)
        self.last = flat[where - 1][of]
        self.word = np.repeat(np.arange(len(words)), sizes)[of]
        self.sizes = sizes
        self.slots = np.empty((K, len(of)), np.int32)
        first = offsets(table)
        node *= _ODD
        for k in range(K):
            mixed = np.repeat(contexts[k], times)
            mixed += node
            mixed *= _MIX
            mixed >>= np.uint64(64 - table[k])
            self.slots[k] = mixed
            self.slots[k] += np.int32(first[k])


def starting_weights() -> np.ndarray:
    w = np.zeros((GATES, K + 1), np.float32)
    w[:, :K] = 1.2 / K
    return w


def _slices(words: list[bytes], size: int = 8_000):
    part, held = [], 0
    for w in words:
        part.append(w)
        held += len(w) + 1
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _byte_counts(batches):
    import pyarrow as pa

    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b" ".join([*binary_values(batch.column(0)), b""]), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])


def _count(code, table):
    """Words -> the task's counts of all slots."""

    def run(batches):
        from pyspark import TaskContext

        flat = np.zeros(2 * int(offsets(table)[-1]), np.uint32)
        for batch in batches:
            for part in _slices(binary_values(batch.column(0))):
                d = Decisions(part, code.value, table)
                np.add.at(flat, (2 * d.slots + d.bit.astype(np.int32)).ravel(), np.uint32(1))
        yield from emitted(flat, TaskContext.get().partitionId())

    return run


class Speller:
    """log10 P(word) by the bit model: code, bits of each table, states of all slots, weights, refinement."""

    def __init__(self, code, table, met, weights, refine):
        self.code, self.table, self.met, self.weights, self.refine = code, table, met, weights, refine

    def inputs(self, d: Decisions, own: bool):
        """Stretched probabilities and weight sets; own takes each word's own share out of the counts."""
        x, gate = np.empty((K, len(d.bit)), np.float32), np.zeros(len(d.bit), np.uint8)
        mine = without(d.bit, True) if own else np.uint16(0)
        for k in range(K):
            met = (self.met.take(d.slots[k]) + mine).astype(np.int64)
            x[k] = STRETCH.take(met)
            if k in _GATE:
                gate += _GATE[k].take(met)
        return x, gate

    def combined(self, x, gate):
        w, gate = np.ascontiguousarray(self.weights.T), gate.astype(np.int64)
        t = 0.3 * w[K].take(gate)
        for k in range(K):
            t += x[k] * w[k].take(gate)
        return t

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out, low = np.zeros(len(words)), 0
        for part in _slices(words):
            d = Decisions(part, self.code, self.table)
            t = self.combined(*self.inputs(d, False))
            place = (np.clip(t, -7.99, 7.99) + 8) * ((BUCKETS - 1) / 16)
            down = place.astype(np.int64)
            place -= down
            down += d.last.astype(np.int64) * BUCKETS
            p = 0.5 * _squash(t) + 0.5 * (self.refine.take(down) * (1 - place) + self.refine.take(down + 1) * place)
            p = np.clip(p, 1e-6, 1 - 1e-6)
            out[low : low + len(part)] = np.bincount(d.word, np.log10(np.where(d.bit > 0, p, 1 - p)), minlength=len(part))
            low += len(part)
        return out

    def learn(self, words: list[bytes], hit: np.ndarray, one: np.ndarray) -> None:
        """A pass over training words: weights move online, hit and one gather the refinement (256 x BUCKETS)."""
        for at in range(0, len(words), STEP_WORDS * STEPS):
            for part in _slices(words[at : at + STEP_WORDS * STEPS], STEP_BYTES):
                d = Decisions(part, self.code, self.table)
                x, gate = self.inputs(d, True)
                order, sizes = in_steps(d.word // STEP_WORDS, gate, GATES)
                x = np.concatenate([x, np.full((1, len(order)), 0.3, np.float32)]).take(order, axis=1)
                bit = d.bit.take(order)
                t = learned(self.weights, x, bit, sizes, RATE)
                place = (np.clip(t, -7.99, 7.99) + 8) * ((BUCKETS - 1) / 16)
                cell = d.last.take(order).astype(np.int64) * BUCKETS + np.rint(place).astype(np.int64)
                hit += np.bincount(cell, minlength=hit.size).reshape(hit.shape)
                one += np.bincount(cell, bit, minlength=one.size).reshape(one.shape)


def _learning(model):
    """Words sorted within blocks -> for each block, weights and refinement learned online over it, as sums weighted by words."""

    def run(batches):
        import pyarrow as pa

        block, live, hit, one, n, made = None, None, None, None, 0, []

        def finish():
            if n:
                made.append({"n": n, "sums": np.concatenate([live.weights.ravel() * n, hit.ravel(), one.ravel()]).astype(np.float64).tolist()})

        for batch in batches:
            blocks, words = batch.column(0).to_numpy(zero_copy_only=False), binary_values(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(words)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if block != int(blocks[low]):
                    finish()
                    block, n, hit, one = int(blocks[low]), 0, np.zeros((256, BUCKETS)), np.zeros((256, BUCKETS))
                    live = Speller(*model.value, starting_weights(), None)
                live.learn(words[low:high], hit, one)
                n += high - low
        finish()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.float64()))]))

    return run


def summed(learned: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """(n, sums) -> the sum of sums, a fixed number of parameters, and of n."""
    out, seen = np.zeros(size), 0
    learned = written(learned, "learned")  # the texts it was shuffled with go
    for r in learned.select("n", F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
        out[r.i], seen = r.v, r.n
    return out, seen


def fit(vocabulary: DataFrame, types: int) -> tuple:
    """Distinct words (column word) -> the parts of a Speller: counts of all of them, and the mean of weights learned of all, block by block."""
    sc, words = vocabulary.sparkSession.sparkContext, vocabulary.select("word")
    histogram = np.zeros(256, np.int64)
    for r in map_arrow(words, _byte_counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[r.byte] = r.n
    code, table = huffman(histogram), table_bits(types)
    met = gathered(map_arrow(words, _count(sc.broadcast(code), table), ROWS), int(offsets(table)[-1]))
    blocks = max(LEARN_BLOCKS, -(-types // BLOCK_WORDS))
    tasks = max(LEARN_BLOCKS, int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = words.select(F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(blocks)).alias("block"), "word").repartition(tasks, "block").sortWithinPartitions("block", "word")
    learned = map_arrow(dealt, _learning(sc.broadcast((code, table, met))), "n long, sums array<double>")
    n_weights, n_cells = GATES * (K + 1), 256 * BUCKETS
    sums, seen = summed(learned, n_weights + 2 * n_cells)
    weights = (sums[:n_weights].reshape(GATES, K + 1) / seen).astype(np.float32) if seen else starting_weights()
    hit, one = (sums[at : at + n_cells].reshape(256, BUCKETS) for at in (n_weights, n_weights + n_cells))
    middle = _squash(np.arange(BUCKETS) / (BUCKETS - 1) * 16 - 8)
    return code, table, met, weights, (one + 20 * middle) / (hit + 20)
