"""Language-model scores against plain Python."""

from __future__ import annotations

import collections
import itertools
import math
import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from slackframe.llm import mixlm, slots, spelling, wordbits
from slackframe.llm.common import map_arrow
from tests.llm.test_operators import awkward, docs_of, empty, sample, shuffled, without_new_files  # noqa: F401

FULL = (1 << 64) - 1
MIX, ODD = int(mixlm._MIX), int(mixlm._ODD)


def is_train(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 != 1


def lowered(text) -> list[bytes]:
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def scored(sample):  # noqa: F811
    return {r.doc_id: r for r in mixlm.report(sample).collect()}


def test_base_score_equals_plain_python(sample, scored):  # noqa: F811
    rows = [(r.doc_id, lowered(r.text)) for r in sample.collect()]
    counts = collections.Counter(w for i, t in rows if is_train(i) for w in t)
    ends = sum(is_train(i) for i, _ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    assert len(scored) == len(rows)
    for i, words in rows:
        each, r = [*(counts[w] for w in words), ends], scored[i]
        assert r.n_tokens == len(each) and r.n_known == sum(c > 0 for c in each) and r.train_tokens == n
        assert abs(r.base_score - sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in each)) < 1e-6
        assert r.score < 0 and r.held_out != is_train(i)


def fold(values) -> int:
    """The hash of some words in a row, one value after another."""
    out = 0
    for x in values:
        out = ((out ^ (out >> 31)) * MIX + x) & FULL
    return out


def anchored(h):
    """(place, gram, continuation) of every anchor: the least gram of some window."""
    g = []
    for i in range(len(h) - mixlm.ANCHOR + 1):
        x = fold(h[i : i + mixlm.ANCHOR])
        x = ((x ^ (x >> 29)) * ODD) & FULL
        g.append(x ^ (x >> 32))
    w = min(mixlm.WINDOW, len(g))
    at = sorted({i for low in range(len(g) - w + 1) for i in range(low, low + w) if g[i] == min(g[low : low + w])}) if g else []
    out = []
    for a, b in zip(at, [*at[1:], at[-1] + mixlm.WINDOW if at else 0]):
        out.append((a, g[a], tuple(x >> 48 for x in h[a + mixlm.ANCHOR : b + mixlm.ANCHOR])))
    return out


class Plain:
    """The score of a text from counts in dictionaries, a decision at a time."""

    def __init__(self, model, rows):
        self.model, self.code = model, model.mixer[0]
        self.bits, self.weights, self.refine = model.mixer[3], model.mixer[4], model.mixer[5]
        self.symbols = {w: i for i, w in enumerate(model.words)}
        self.words = collections.Counter(w for _, t in rows for w in t)
        self.slots = collections.defaultdict(lambda: [0, 0])
        self.nodes = collections.defaultdict(lambda: [0, 0])
        self.said = collections.defaultdict(collections.Counter)
        for _, t in rows:
            h = [xxhash.xxh3_64_intdigest(w) for w in t] + [int(mixlm.END_HASH)]
            for i in range(len(h)):
                for node, bit, places in self.decisions(t, h, i):
                    self.nodes[node][bit] += 1
                    for x in places:
                        self.slots[x][bit] += 1
            for gram, cont in {(g, c) for _, g, c in anchored(h[:-1])}:
                self.said[gram][cont] += 1
        self.spell = spelling.Speller(*model.speller)

    def symbol(self, t, i):
        return len(self.symbols) + 1 if i == len(t) else self.symbols.get(t[i], len(self.symbols))

    def decisions(self, t, h, i):
        one, two = h[i - 1] if i >= 1 else 1, h[i - 2] if i >= 2 else 2
        ctx = [((c ^ (c >> 29)) * ODD) & FULL for c in (one, ((one ^ (one >> 31)) * MIX + two) & FULL)]
        s = self.symbol(t, i)
        for at in range(self.code.start[s], self.code.start[s] + self.code.length[s]):
            node, places = int(self.code.nodes[at]), []
            for k, c in enumerate(ctx):
                x = ((c + node * MIX) * ODD) & FULL
                places.append((k, (((x ^ (x >> 32)) * MIX) & FULL) >> (64 - self.bits)))
            yield node, int(self.code.bits[at]), places

    def state(self, place, bit, own):
        n = list(self.slots[place]) if place in self.slots else [0, 0]
        scale = max(1, max(n) / 63)
        n = [round(x / scale) for x in n]
        n[bit] -= own and 0 < n[bit] < 63
        return n

    def word(self, t, h, i, own):
        out = 0.0
        for node, bit, places in self.decisions(t, h, i):
            met = [self.state(x, bit, own) for x in places]
            x = [math.log((b + 0.2) / (a + 0.2)) for a, b in met]
            x.append(math.log((self.nodes[node][1] + 0.2) / (self.nodes[node][0] + 0.2)))
            n = [sum(m) for m in met]
            gate = sum(n[0] >= e for e in (0.5, 2.5, 12, 100)) * 4 + sum(n[1] >= e for e in (0.5, 2.5, 12))
            w = self.weights[gate].astype(float)
            s = 0.3 * w[-1] + sum(a * b for a, b in zip(x, w))
            s = (math.floor(min(max((s + 8) / 16 * wordbits.FINE, 0), wordbits.FINE - 1)) + 0.5) / wordbits.FINE * 16 - 8
            at = (min(max(s, -7.99), 7.99) + 8) * (wordbits.BUCKETS - 1) / 16
            low = int(at)
            p = 0.5 / (1 + math.exp(-min(max(s, -12), 12))) + 0.5 * (self.refine[gate][low] * (1 - at + low) + self.refine[gate][low + 1] * (at - low))
            p = min(max(p if bit else 1 - p, 1e-6), 1 - 1e-6)
            out += math.log10(p)
        return out + (self.price(t[i]) if i < len(t) and t[i] not in self.symbols else 0.0)

    def price(self, word):
        m, c = self.model, self.words[word]
        share = min(max(m.discount * m.other_types, 1.0) / max(m.others, 1), 1.0)
        return math.log10(max(c - m.discount, 0) / max(m.others, 1) + share * 10 ** float(self.spell([word])[0]))

    def __call__(self, t, own):
        h = [xxhash.xxh3_64_intdigest(w) for w in t] + [int(mixlm.END_HASH)]
        told = {}
        for a, gram, cont in anchored(h[:-1]):
            n = self.said[gram] if gram in self.said else {}
            ranked = sorted(((k - (own and c == cont), k, c) for c, k in n.items()), key=lambda x: -x[0])
            if ranked and ranked[0][0] > 0:
                best = [x for x in ranked if x[0] == ranked[0][0]]
                if len(best) > 1:  # ties: the one of most texts in all, then the least hash
                    key = lambda x: (-x[1], np.uint64(xxhash.xxh3_64_intdigest(np.array(x[2], "<u2").tobytes())).astype(np.int64))
                    best.sort(key=key)
                for k, x in enumerate(best[0][2]):
                    if a + mixlm.ANCHOR + k < len(t):
                        told[a + mixlm.ANCHOR + k] = x
        total, last, spot, latest = 0.0, {}, {}, None
        held, runs = [], collections.defaultdict(lambda: [0, 0])
        for i in range(len(t) + 1):
            at = None
            if i < len(t):
                if i >= mixlm.REPEAT:
                    back = tuple(h[i - mixlm.REPEAT : i])
                    at = last.get(back)
                    last[back] = i
                if at is not None:
                    latest, spot = i, at
                elif latest is not None and i - latest <= mixlm.ON:
                    at = spot + i - latest
            outer = i in told
            hit = False
            if at is not None or outer:
                hit = told[i] == h[i] >> 48 if outer else h[at] == h[i]
                s = (0 if not held or not held[-1] else 1 if len(held) < 2 or not held[-2] else 2) + 3 * outer
                yes, seen = runs[s]
                rate = (yes + mixlm.PRIOR[s, 0]) / (seen + mixlm.PRIOR[s].sum())
                total += math.log10(rate if hit else 1 - rate)
                runs[s] = [yes + hit, seen + 1]
                held.append(hit)
            if not hit:
                total += self.word(t, h, i, own)
        return total


def test_scores_equal_plain_python(sample, scored):  # noqa: F811
    """Held-out and training texts, a decision at a time, with counts from the texts themselves."""
    rows = [(r.doc_id, lowered(r.text)) for r in sample.collect()]
    wanted = sample.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), ~mixlm.held_out(F.col("doc_id")), "text").toDF("id", "key", "train", "text")
    plain = Plain(mixlm.fit(wanted), [x for x in rows if is_train(x[0])])
    some = [x for x in rows if not is_train(x[0])][:25] + [x for x in rows if is_train(x[0])][:15]
    for i, t in some:
        assert abs(plain(t, is_train(i)) - scored[i].score) < 1e-3 * (1 + len(t) / 100), i


def speller(train, weights=None):
    histogram = np.bincount(np.frombuffer(b" ".join([*train, b""]), np.uint8), minlength=256)
    code, table = spelling.huffman(histogram), spelling.table_bits(len(train))
    flat = np.zeros(2 * int(spelling.offsets(table)[-1]), np.uint32)
    for part in spelling._slices(train):
        d = spelling.Decisions(part, code, table)
        np.add.at(flat, (2 * d.slots + d.bit.astype(np.int32)).ravel(), 1)
    middle = spelling._squash(np.arange(spelling.BUCKETS) / (spelling.BUCKETS - 1) * 16 - 8)
    return spelling.Speller(code, table, slots.states(flat), spelling.starting_weights() if weights is None else weights, np.tile(middle, (256, 1)))


def test_spelling_is_a_distribution():
    """Over all words of up to two bytes of a small alphabet, probabilities don't exceed 1 and come near it when spelt so in training."""
    words = [bytes(x) for n in (1, 2) for x in itertools.product(b"ab", repeat=n)]
    p = 10 ** speller(words)([*words, b"zz", b"a" * 300])
    assert 0.2 < p[:6].sum() <= 1 and p[6] < p[:6].min() and p[7] < 1e-20


def test_learned_weights_beat_the_starting_ones(spark, sample):  # noqa: F811
    """Of the spelling, in bits over words that aren't in training; of words in text, over held-out texts."""
    rows = [(r.doc_id, lowered(r.text)) for r in sample.collect()]
    train = sorted({w for i, t in rows for w in t if is_train(i)})
    fresh = sorted({w for _, t in rows for w in t if len(w) < 64} - set(train))
    live = speller(train)
    before = -live(fresh).sum()
    live.learn(train, np.zeros((256, spelling.BUCKETS)), np.zeros((256, spelling.BUCKETS)))
    assert len(fresh) > 100 and -live(fresh).sum() < before and np.abs(live.weights).max() < 5

    larger = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = larger.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), ~mixlm.held_out(F.col("doc_id")), "text").toDF("id", "key", "train", "text")
    model = mixlm.fit(wanted)
    held = mixlm.with_told(wanted.where("not train"), model.told).toArrow().combine_chunks().to_batches()[0]
    texts = mixlm.Texts(mixlm.Lexicon(model.words), held.column("text"))
    left = ~mixlm.predictions(texts, held.column("told"))[1]  # what copies give isn't left to the mixer
    ctx = wordbits.contexts(texts.h, texts.place)[:, left]
    bits = lambda *learned: -wordbits.Mixer(*model.mixer[:4], *learned).log10(texts.symbol[left], ctx, None).sum()
    assert bits(*model.mixer[4:]) < bits(wordbits.starting_weights(), wordbits.starting_refinement())
    assert np.abs(model.mixer[4]).max() < 5


def test_words_before_matter(spark):
    """A word is likelier after the word it always follows; the place in the tree alone wouldn't tell."""
    rng = random.Random(4)
    pairs = [(f"left{k}", f"right{k}") for k in range(30)]
    train = [" ".join(" ".join(rng.choice(pairs)) for _ in range(60)) for _ in range(40)]
    right = " ".join(" ".join(p) for p in pairs)
    wrong = " ".join(f"{a} {pairs[k - 7][1]}" for k, (a, _) in enumerate(pairs))
    got = {r.id: r for r in mixlm.score(docs_of(spark, [*train, right, wrong]), F.col("doc_id") < 40).collect()}
    assert got[40].score > got[41].score + 20 and abs(got[40].base_score - got[41].base_score) < 1e-6


def test_copies_find_their_source(spark):
    """Short texts, a passage in a longer text, and a text made of passages of several training texts that also share a line."""
    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    short = [fresh(12) for _ in range(30)]
    passage, line, own = fresh(70), fresh(40), [fresh(60) for _ in range(5)]
    train = [*short, f"{fresh(200)} {passage} {fresh(200)}", *[f"{line} {x}" for x in own]]
    asked = [*short, f"{fresh(150)} {passage} {fresh(150)}", f"{own[2]} {own[4]} {line}", fresh(160)]
    got = {r.id: r for r in mixlm.score(docs_of(spark, [*train, *asked]), F.col("doc_id") < len(train)).collect()}
    first = len(train)
    assert sum(got[first + k].score > got[k].score + 3 for k in range(30)) >= 20  # the training text itself has no other to copy
    per_word = lambda k: got[first + k].score / got[first + k].n_tokens
    assert per_word(30) > 0.95 * per_word(32) and per_word(31) > 0.5 * per_word(32)


def test_scores_of_copies_and_repeats(spark):
    """A held-out copy of a training text scores far above one that isn't."""
    rng = random.Random(2)
    fresh = lambda: " ".join("".join(rng.choice(["th", "er", "on", "in", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(80))
    first = fresh()
    d = spark.createDataFrame([(1, first), (2, fresh()), (3, first), (4, fresh()), (5, "\n".join(["one line is here again"] * 40))], "doc_id long, text string")
    got = {r.id: r for r in mixlm.score(d, F.col("doc_id").isin(1, 2)).collect()}
    assert got[3].score > 0.6 * got[4].score and got[3].score > got[3].base_score
    assert got[5].score > 0.5 * got[5].base_score


def test_scores_awkward(awkward, empty, spark):  # noqa: F811
    got = mixlm.report(awkward).collect()
    assert len(got) == awkward.count() and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].n_tokens == by[2][0].n_tokens == 1
    assert abs(by[4][0].score - by[4][1].score) < 1e-9 or len({r.n_tokens for r in by[4]}) == 2
    assert mixlm.report(empty).count() == 0
    alone = mixlm.score(docs_of(spark, ["some text"]), F.lit(False)).collect()
    assert alone[0].n_known == 0 and alone[0].train_tokens == 0 and math.isfinite(alone[0].score)


def test_weights_are_learned_of_all_training_texts_and_words(spark, monkeypatch):
    """More texts and words than the samples of 4,000 and 200,000 that once taught the weights."""
    seen, summed = [], spelling.summed
    monkeypatch.setattr(spelling, "summed", lambda *a: seen.append(summed(*a)) or seen[-1])
    texts = [" ".join(f"w{45 * i + k}" for k in range(45)) for i in range(6_000)]
    rows = spark.createDataFrame([(i, i, True, t) for i, t in enumerate(texts)], "id long, key long, train boolean, text string")
    mixlm.fit(rows)
    assert sorted(n for _, n in seen) == [6_000 * 45, 6_000 * 46]


def test_learning_takes_out_all_of_a_text(monkeypatch):
    rng = np.random.default_rng(3)
    code, bits, n = wordbits.Code(np.array([40, 9, 7, 3, 2, 1])), 22, 400
    starts = np.array([0, 1, 150, 151, 320, n])
    symbols, doc = rng.integers(0, 6, n), np.searchsorted(starts, np.arange(n), "right") - 1
    ctx = wordbits.contexts(rng.integers(1, 12, n).astype(np.uint64) * ODD, np.arange(n) - starts[doc])
    flat = np.zeros(2 * wordbits.HASHED << bits, np.uint32)
    wordbits.add_counts(flat, code, symbols, ctx, bits)
    mixer = wordbits.Mixer(code, wordbits.node_counts(code, np.ones(6)), slots.states(flat), bits, wordbits.starting_weights(), None)
    of, node, bit, slot = wordbits.decisions(code, symbols, ctx, bits)
    for k in range(wordbits.HASHED):
        got = mixer._others(slot[k], bit, code.length[symbols], ctx[k], doc)
        for i, s in enumerate(slot[k]):
            mine = (slot[k] == s) & (doc[of] == doc[of[i]])
            for counts, b, shift in ((slots.ZEROS, 0, 0), (slots.ONES, 1, slots.BITS)):
                had = int(mixer.table[s]) >> shift & slots.MOST
                assert counts[got[i]] == (had if had == slots.MOST else max(had - int((bit[mine] == b).sum()), 0))
    hits = []
    for size in (20_000, 100):
        monkeypatch.setattr(wordbits, "LEARN_SLICE", size)
        hit, one = np.zeros((2, wordbits.GATES, wordbits.BUCKETS))
        mixer.weights = wordbits.starting_weights()
        mixer.learn(symbols, ctx, np.ones(n, bool), starts, hit, one)
        hits.append((hit.sum(), one.sum()))
    assert hits[0] == hits[1] == (len(bit), bit.sum())


def test_counts_and_weights_leave_no_shuffle_files(spark):
    """What tasks counted and learned, and the texts they read, are gone before the next pass."""
    spark.sparkContext._jvm.System.gc()
    before = shuffled(spark)
    rows = map_arrow(spark.range(4, numPartitions=1), lambda b: slots.emitted(np.ones(8, np.uint32), 0), slots.ROWS)
    assert (slots.gathered(rows, 4) == 1 + (1 << slots.BITS)).all()
    assert without_new_files(spark, before)
    learned = spark.range(4).repartition(2, "id").select(F.lit(3).cast("long").alias("n"), F.array(F.lit(0.5)).alias("sums"))
    sums, seen = spelling.summed(learned, 1)
    assert sums[0] == 2 and seen == 12
    assert without_new_files(spark, before, 1)  # the sums' own grouping may stay


def test_words_are_hashed_at_once(monkeypatch):
    """As xxhash does it, word by word; words of up to 16 bytes take no call each, and a lexicon knows its words by hash."""
    rng, calls, one = random.Random(6), [], xxhash.xxh3_64_intdigest
    some = [rng.randbytes(n).translate(bytes.maketrans(bytes(range(33)) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"a" * 59)).replace(b"\xff", b"y") for n in range(1, 41) for _ in range(50)]
    lexicon = pickle.loads(pickle.dumps(mixlm.Lexicon(sorted({*some[::2]}))))
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or one(w))
    lines = [b" ".join(some[:300]), b"", None, b" \t", b"\n".join(some[300:])]
    raw = pa.array(lines, pa.binary()).buffers()
    texts = mixlm.Texts(lexicon, pa.StringArray.from_buffers(len(lines), *raw[1:], raw[0]))
    assert texts.h[texts.word].tolist() == [one(w) for w in some] and all(len(w) > 16 for w in calls)
    assert (~texts.word).sum() == 5 and (texts.symbol[~texts.word] == lexicon.end).all() and (texts.h[~texts.word] == mixlm.END_HASH).all()
    known = {w: i for i, w in enumerate(sorted({*some[::2]}))}
    assert texts.symbol[texts.word].tolist() == [known.get(w, lexicon.other) for w in some]


def test_tasks_get_a_code_as_its_tree():
    code = wordbits.Code(np.arange(3, 3000))
    sent = pickle.dumps(code)
    again = pickle.loads(sent)
    assert len(sent) < 12 * 3000 and all((getattr(code, k) == getattr(again, k)).all() for k in ("nodes", "bits", "start", "length", "path"))
