"""The words of a text, predicted bit by bit from the words before them.

Frequent words, one symbol for all others, and the end of a text are leaves of a Huffman tree, so a
word is a path of binary decisions. Predictors that look a decision up by a hash of the place in the
tree and of the previous word or the previous two, and one that knows the place alone, each give a
probability from counts over all training texts. They are combined in the logistic domain by
weights, of which a set is chosen by how well the contexts are known, and an adaptive table refines
the combined probability. A training text is scored with each of its own
decisions taken out of the counts once.
"""

from __future__ import annotations

import heapq

import numpy as np

from slackframe.llm.slots import BITS, MOST, STATES, STRETCH, TOTAL, in_steps, learned, squash, without

#: Hashed predictors: the previous word, the previous two.
HASHED = 2
K = HASHED + 1
#: Slots of a hashed predictor, as a power of two: one for 4 training tokens, within these limits.
LEAST_BITS, MOST_BITS = 18, 21
GATES = 5 * 4
#: Steps of the combined, stretched probability in the table of refined ones, for -8 to 8.
FINE = 2048
BUCKETS = 24
RATE = 0.02
#: Decisions in a step of learning, and words in a slice of scoring.
STEP = 4_000
#: Steps whose inputs are made ready at once.
STEPS = 16
SLICE = 2_000
#: Words of a slice of whole texts in learning; a longer text is one.
LEARN_SLICE = 20_000
#: Decisions by which paths are told apart; without 2^37 training tokens none is longer.
PATH = 52
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(int(_MIX) * int(_ODD) & 0xFFFFFFFFFFFFFFFF)
_GATE = (
    (np.digitize(TOTAL, (0.5, 2.5, 12, 100)) * 4).astype(np.uint8),
    np.digitize(TOTAL, (0.5, 2.5, 12)).astype(np.uint8),
)


def slot_bits(tokens: int) -> int:
    return int(np.clip((int(max(tokens, 1)) >> 2).bit_length(), LEAST_BITS, MOST_BITS))


class Code:
    """A Huffman code of symbols by their counts: symbol s takes nodes[start[s] : start[s] + length[s]] and the bits there.

    path[s] are the same bits as a number, the first one PATH - 1 places up. steps holds a node twice, plus the bit.
    """

    def __init__(self, counts):
        n = len(counts)
        heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        nxt = n
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left] = parent[right] = nxt
            side[right] = 1
            heapq.heappush(heap, (a + b, nxt))
            nxt += 1
        self.__setstate__((parent[:nxt].astype(np.int32), side[:nxt]))

    def __getstate__(self):
        return self.tree

    def __setstate__(self, tree):
        """Tasks get parent and side of each node, and make the paths again."""
        self.tree = parent, side = tree
        n = (len(parent) + 1) // 2
        at, who, steps = np.arange(n), np.arange(n), []
        while True:
            live = at < len(parent) - 1
            at, who = at[live], who[live]
            if not len(at):
                break
            steps.append((who, parent[at] - n, side[at]))
            at = parent[at]
        self.length = np.zeros(n, np.int64)
        for who, _, _ in steps:
            self.length[who] += 1
        self.start = np.cumsum(self.length) - self.length
        self.nodes, self.bits = np.zeros(int(self.length.sum()), np.int32), np.zeros(int(self.length.sum()), np.uint8)
        for up, (who, node, bit) in enumerate(steps):  # the first step is the last decision
            place = self.start[who] + self.length[who] - 1 - up
            self.nodes[place], self.bits[place] = node, bit
        self.path, self.steps = paths(self.bits, self.length), 2 * self.nodes + self.bits
        self.n_nodes = max(n - 1, 1)


def paths(bits: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The bits of each path, of which times[i] follow one another, as a number."""
    if not len(bits):
        return np.zeros(len(times), np.int64)
    begin = np.cumsum(times) - times
    depth = np.arange(len(bits)) - np.repeat(begin, times)
    out = np.zeros(len(times), np.int64)
    some = np.flatnonzero(times)
    out[some] = np.add.reduceat(np.where(depth < PATH, bits.astype(np.int64) << np.maximum(PATH - 1 - depth, 0), 0), begin[some])
    return out


def contexts(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hashed contexts of every word: h are word hashes of whole texts one after another, place the words before each in its text."""
    one = np.where(place >= 1, np.roll(h, 1), np.uint64(1))
    two = np.where(place >= 2, np.roll(h, 2), np.uint64(2))
    both = (one ^ (one >> np.uint64(31))) * _MIX + two
    return np.stack([(c ^ (c >> np.uint64(29))) * _ODD for c in (one, both)])


def _taken(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many decisions each word has, and node and bit of each decision."""
    times = code.length.take(symbols)
    ends = np.cumsum(times)
    at = np.repeat(code.start.take(symbols) - ends + times, times)
    at += np.arange(len(at))
    node = code.steps.take(at)
    bit = (node & 1).astype(np.uint8)
    node >>= 1
    return times, node, bit


def _salt(node: np.ndarray) -> np.ndarray:
    """What a node adds to a context times _ODD."""
    salt = node.astype(np.uint64)
    salt *= _STEP
    return salt


def _slots(salt: np.ndarray, times: np.ndarray, ctx: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The slot of each decision for hashed predictor k, in one array of all tables; salt is from _salt()."""
    mixed = np.repeat(ctx * _ODD, times)
    mixed += salt
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    mixed >>= np.uint64(64 - bits)
    out = mixed.view(np.int64)
    out += k << bits
    return out


def decisions(code: Code, symbols: np.ndarray, ctx: np.ndarray, bits: int):
    """Word of each decision, node, bit, and the slot of each hashed predictor (of all tables in one array)."""
    times, node, bit = _taken(code, symbols)
    salt = _salt(node)
    return np.repeat(np.arange(len(symbols)), times), node, bit, np.stack([_slots(salt, times, ctx[k], k, bits) for k in range(HASHED)])


def add_counts(flat: np.ndarray, code: Code, symbols, ctx, bits: int) -> None:
    """Count the decisions: flat[2 * slot + bit]."""
    order = np.argsort(symbols)  # equal paths are read together
    symbols, ctx = symbols.take(order), ctx.take(order, axis=1)
    for low in range(0, len(symbols), SLICE):
        times, node, bit = _taken(code, symbols[low : low + SLICE])
        salt = _salt(node)
        for k in range(HASHED):
            cell = _slots(salt, times, ctx[k, low : low + SLICE], k, bits)
            cell += cell
            cell += bit
            np.add.at(flat, cell, np.uint32(1))


def node_counts(code: Code, counts) -> np.ndarray:
    """The stretched probability of each node from the symbols' counts."""
    weight = np.repeat(np.asarray(counts, np.float64), code.length)
    pairs = np.bincount(2 * code.nodes.astype(np.int64) + code.bits, weight, minlength=2 * code.n_nodes)
    return np.log((pairs[1::2] + 0.2) / (pairs[::2] + 0.2)).astype(np.float32)


def starting_weights() -> np.ndarray:
    w = np.zeros((GATES, K + 1), np.float32)
    w[:, :HASHED], w[:, HASHED] = 0.3, 0.5
    return w


def starting_refinement() -> np.ndarray:
    return np.tile(squash(np.arange(BUCKETS) / (BUCKETS - 1) * 16 - 8), (GATES, 1)).astype(np.float32)


class Mixer:
    """The learned model: code, stretched node probabilities, states of all slots, weights, refinement."""

    def __init__(self, code: Code, nodes, table, bits: int, weights, refine):
        self.code, self.nodes, self.table, self.bits, self.weights, self.refine = code, nodes, table, bits, weights, refine
        if refine is not None:
            self.priced = _priced(refine)
            w = np.asarray(weights, np.float32).reshape(5, 4, K + 1)
            # the part of each predictor, by its state and the other's share of the weight set
            self.first = (np.float32(0.3) * w[_GATE[0] >> 2, :, K] + STRETCH[:, None] * w[_GATE[0] >> 2, :, 0]).T.ravel()
            self.second = (STRETCH[:, None] * w[:, _GATE[1], 1].T).T.ravel()
            self.third = np.ascontiguousarray(w[:, :, 2].ravel())

    def log10(self, symbols: np.ndarray, ctx: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """log10 probability of every symbol; own says whose decisions are taken out."""
        out = np.zeros(len(symbols))
        order = np.argsort(symbols)  # equal paths are read together
        symbols, ctx = symbols.take(order), ctx.take(order, axis=1)
        own = own.take(order) if own is not None else None
        for low in range(0, len(symbols), SLICE):
            part = slice(low, low + SLICE)
            times, node, bit = _taken(self.code, symbols[part])
            salt = _salt(node)
            mine = without(bit, np.repeat(own[part], times)) if own is not None else None
            met = []
            for k in range(HASHED):
                state = self.table.take(_slots(salt, times, ctx[k, part], k, self.bits))
                if mine is not None:
                    state += mine
                met.append(state.astype(np.int64))
            one, two = _GATE[0].take(met[0]), _GATE[1].take(met[1])
            gate = (one + two).astype(np.int64)
            met[0] += two.astype(np.int64) * (3 * STATES)
            one >>= 2
            met[1] += one.astype(np.int64) * (3 * STATES)
            t = self.first.take(met[0])
            t += self.second.take(met[1])
            t += self.nodes.take(node) * self.third.take(gate)
            t += np.float32(8)
            t *= np.float32(FINE / 16)
            np.clip(t, 0, FINE - 1, out=t)
            gate *= 2 * FINE
            gate += t.astype(np.int32)
            gate += bit.astype(np.int32) * np.int32(FINE)
            out[order[part]] = np.add.reduceat(self.priced.take(gate), np.cumsum(times) - times)  # every symbol has a decision
        return out

    def _others(self, slot: np.ndarray, bit: np.ndarray, times: np.ndarray, ctx: np.ndarray, doc: np.ndarray, path: np.ndarray | None = None) -> np.ndarray:
        """Where in STRETCH the state of each decision's slot is, without all that its own text put there under the same context.

        Words of a text after the same context stand together by their paths, so the decisions that they share are runs at each depth.
        """
        met = self.table.take(slot)
        out = met + without(bit, True)  # a context that a text has once gave one decision
        who, group = _repeated(ctx ^ (doc.astype(np.uint64) * _ODD))
        if not len(who):
            return out
        path = (paths(bit, times) if path is None else path).take(who)
        order = np.lexsort((path, group))
        who, path, group = who.take(order), path.take(order), group.take(order)
        length = times.take(who)
        shared = np.zeros(len(who) + 1, np.int64)  # decisions in common with the word before
        apart = np.frexp((path[1:] ^ path[:-1]).astype(np.float64))[1]  # places from the first bit that differs
        shared[1:-1] = np.minimum(PATH + 1 - apart, np.minimum(length[1:], length[:-1])) * (group[1:] == group[:-1])
        reach = np.maximum(shared[:-1], shared[1:])
        live, place, depth = np.flatnonzero(reach > 0), (np.cumsum(times) - times).take(who), 0
        while len(live):
            at = place.take(live)
            at += depth
            first = np.flatnonzero(shared.take(live) <= depth)
            size = np.diff(np.append(first, len(live)))
            ones = np.add.reduceat(bit.take(at), first, dtype=np.int64)
            state = met.take(at.take(first)).astype(np.int64)
            zeros, ones = (np.where(n == MOST, n, np.maximum(n - own, 0)) for n, own in ((state & MOST, size - ones), (state >> BITS, ones)))
            out[at] = np.repeat(zeros | ones << BITS, size)
            depth += 1
            live = live[reach.take(live) > depth]
        return out

    def learn(self, symbols: np.ndarray, ctx: np.ndarray, left: np.ndarray, starts: np.ndarray, hit: np.ndarray, one: np.ndarray) -> None:
        """Learn from training texts (text i has the positions from starts[i] to starts[i + 1]) at the words where left holds.

        Weights move online, hit and one gather the refinement (GATES x BUCKETS). All that a text itself
        put into the counts is taken out.
        """
        seen = np.zeros(2 * hit.size, np.int64)
        cuts = starts[np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], LEARN_SLICE)), len(starts) - 1))]
        for low, high in zip(cuts, cuts[1:]):
            part = slice(low, high)
            times, node, bit = _taken(self.code, symbols[part])
            salt, path = _salt(node), self.code.path.take(symbols[part])
            doc = np.searchsorted(starts, np.arange(low, high), "right") - 1
            doc -= doc[0]
            met = [self._others(_slots(salt, times, ctx[k, part], k, self.bits), bit, times, ctx[k, part], doc, path) for k in range(HASHED)]
            mine = np.flatnonzero(np.repeat(left[part], times))
            for at in range(0, len(mine), STEP * STEPS):
                seen += self._steps(mine[at : at + STEP * STEPS], met, node, bit)
        seen = seen.reshape(*hit.shape, 2)
        hit += seen.sum(axis=2)
        one += seen[:, :, 1]

    def _steps(self, which, met, node, bit) -> np.ndarray:
        """Some steps of learning; zeros and ones in turn by weight set and bucket of the combined probability."""
        state = [m.take(which) for m in met]
        gate = _GATE[0].take(state[0])
        gate += _GATE[1].take(state[1])
        order, sizes = in_steps(np.arange(len(which)) // STEP, gate, GATES)
        which = which.take(order)
        x = np.empty((K + 1, len(which)), np.float32)
        for k in range(HASHED):
            x[k] = STRETCH.take(state[k].take(order))
        x[HASHED] = self.nodes.take(node.take(which))
        x[K] = 0.3
        bit = bit.take(which)
        t = learned(self.weights, x, bit, sizes, RATE)
        cell = np.rint((np.clip(t, -7.99, 7.99) + np.float32(8)) * np.float32((BUCKETS - 1) / 16)).astype(np.int64)
        cell += gate.take(order).astype(np.int64) * BUCKETS
        cell += cell
        cell += bit
        return np.bincount(cell, minlength=2 * GATES * BUCKETS)


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values stand that occur more than once (by their high bits), equal ones together, and a number for each value."""
    low = np.uint64((1 << len(key).bit_length()) - 1)
    order = np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64))
    same = np.append(False, (order[1:] ^ order[:-1]) <= low)
    again = same | np.append(same[1:], False)
    return (order[again] & low).view(np.int64), np.cumsum(~same[again])


def _priced(refine: np.ndarray) -> np.ndarray:
    """log10 of the refined probability of a zero and of a one, at the middle of each of FINE steps, for each weight set."""
    t = (np.arange(FINE) + 0.5) / FINE * 16 - 8
    place = (np.clip(t, -7.99, 7.99) + 8) * ((BUCKETS - 1) / 16)
    low = place.astype(np.int64)
    part = place - low
    p = 0.5 * squash(t) + 0.5 * (refine[:, low] * (1 - part) + refine[:, low + 1] * part)
    return np.log10(np.clip(np.stack([1 - p, p], axis=1), 1e-6, 1 - 1e-6)).ravel().astype(np.float32).astype(np.float64)


def refinement(hit: np.ndarray, one: np.ndarray) -> np.ndarray:
    return ((one + 20 * starting_refinement()) / (hit + 20)).astype(np.float32)
