"""Language-model scoring by online logistic context mixing.

A text is a sequence of lower-cased words and an end. Each word is a sequence of binary decisions:

* where a copy is going on, whether the word is the one that the copy predicts. A copy goes on where
  the last three words stood earlier in the text, or where training texts have the same five words
  in a row; the rate at which predictions of the text held so far, by what became of the last two,
  gives the probability (copied()). A miss goes on to
* the path of the word in a Huffman tree of frequent words, one leaf for all others and one for the
  end, each decision by logistic mixing over the words before (wordbits.py), and for other words
* the count c of the word among the training tokens R of such words, and its spelling:
  max(c - D, 0) / R + share * P(word), P by logistic mixing over bytes (spelling.py).

Word counts and the continuations of anchors (five words in a row) are distributed tables that grow
with the corpus; hashed slots grow up to a stated size. Training texts are scored without their own
decisions and continuations.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackframe.llm import spelling, wordbits
from slackframe.llm.common import crc_mod, map_arrow, written
from slackframe.llm.slots import ROWS, emitted, gathered
from slackframe.llm.wordhash import hashes

#: Most frequent words (of up to 64 bytes), which the tree holds; the others meet their prices in a join.
FREQUENT = 200_000
#: Occurrences that a word of the tree needs: what is left out stands for words never met.
LEAST_COUNT = 3
#: Rows of a batch.
ROWS_AT_ONCE = 2_000
ANCHOR = 5
#: The least hash of so many anchors in a row is kept, so texts that share 36 words in a row share one; a text of five words has one.
WINDOW = 32
#: Words in a row that a copy within the text needs, and how far it goes on after a changed word.
REPEAT, ON = 3, 4
#: Hits and misses that copied() starts from, by source (own text, training texts) and how many of the last two predictions held.
PRIOR = np.array([[0.5, 2], [1, 1], [2, 0.5], [2, 1], [4, 0.5], [8, 0.25]])
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
END_HASH = np.uint64(0xA0761D6478BD642F)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _split(texts):
    """An Arrow string array -> lists of its lower-cased words; a text without words is a list of one empty string."""
    import pyarrow.compute as pc

    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))


def _binary(array):
    import pyarrow as pa

    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).cast(pa.binary())


def _count_words(batches):
    """(text) -> (word, c), summed over each batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        for low in range(0, whole.num_rows, 5000):
            counted = _split(whole.column(0).slice(low, 5000)).flatten().value_counts()
            words = counted.field("values")
            full = pc.greater(pc.binary_length(words), 0)
            yield pa.RecordBatch.from_arrays([_binary(words).filter(full), counted.field("counts").cast(pa.int64()).filter(full)], ["word", "c"])


class Lexicon:
    """The frequent words and the hash of each; symbols are their places, then other words, then the end of a text."""

    def __init__(self, words):
        import pyarrow as pa

        self.words, self.other, self.end = pa.array(words, pa.binary()), len(words), len(words) + 1
        self.hashes = np.append(hashes(self.words), np.uint64(0))
        self._place()

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k not in ("shift", "table")}

    def __setstate__(self, parts):
        self.__dict__.update(parts)
        self._place()

    def _place(self):
        # a word's symbol stands at the high bits of its hash, or where the next place is free
        self.shift = np.uint64(64 - max(4 * self.other, 2).bit_length())
        order = np.argsort(self.hashes[:-1])
        at = np.arange(len(order))
        at += np.maximum.accumulate((self.hashes[order] >> self.shift).astype(np.int64) - at)
        self.table = np.full(max((1 << 64 - int(self.shift)), int(at[-1]) + 1 if len(at) else 0) + 1, self.other, np.int32)
        self.table[at] = order

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbol of every word hash."""
        out = np.zeros(len(h), np.int32)
        for low in range(0, len(h), 1 << 14):
            part = h[low : low + (1 << 14)]
            place = (part >> self.shift).view(np.int64)
            out[low : low + len(part)] = met = self.table.take(place)
            left = np.flatnonzero((self.hashes.take(met) != part) & (met != self.other))
            while len(left):
                place[left] += 1
                met = self.table.take(place[left])
                out[low + left] = met
                left = left[(self.hashes.take(met) != part[left]) & (met != self.other)]
        return out


class Texts:
    """Some texts as one sequence of symbols, each text with its end.

    symbol, h (word hash), word (whether it is one, not an end), place (words before it in its text)
    and doc of every position; text i has the positions from starts[i] to starts[i + 1]. flat are
    the words, without ends.
    """

    def __init__(self, lexicon: Lexicon, texts):
        import pyarrow as pa

        split = _split(texts)
        self.flat = _binary(split.flatten())
        ends = split.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        full = np.diff(np.frombuffer(self.flat.buffers()[1], np.int32)[self.flat.offset : self.flat.offset + len(self.flat) + 1]) > 0 if len(self.flat) else np.zeros(0, bool)
        if not full.all():  # a text without words is split into one empty string
            ends, self.flat = np.append(0, np.cumsum(full))[ends], self.flat.filter(pa.array(full))
        h = hashes(self.flat)
        sizes = np.diff(ends) + 1
        self.starts = np.append(0, np.cumsum(sizes))
        n = int(self.starts[-1])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(n) - np.repeat(self.starts[:-1], sizes)
        self.word = np.ones(n, bool)
        self.word[self.starts[1:] - 1] = False
        at = np.flatnonzero(self.word)
        self.symbol, self.h = np.full(n, lexicon.end), np.full(n, END_HASH)
        self.symbol[at], self.h[at] = lexicon.symbols(h), h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words that stand together."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * _MIX + h[k : len(h) - n + 1 + k]
    out = (out ^ (out >> np.uint64(29))) * _ODD
    return out ^ (out >> np.uint64(32))


def _sliding(x: np.ndarray, window: int, least) -> np.ndarray:
    had = 1
    while had < window:
        step = min(had, window - had)
        x, had = least(x[:-step], x[step:]), had + step
    return x


def anchors(texts: Texts, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the least hash of every window grams in a row of a text (of all, if there are fewer), and the hash of each."""
    n = len(texts.h)
    sizes = np.diff(texts.starts) - 1  # words
    ahead = sizes[texts.doc] - texts.place  # words from here on
    g = np.full(n, FULL, np.uint64)
    whole = grams(texts.h, ANCHOR)
    g[: len(whole)] = whole
    g[ahead < ANCHOR] = FULL
    least = np.zeros(n, np.uint64)
    if n >= window:
        least[: n - window + 1] = _sliding(g, window, np.minimum)
    least[ahead < window + ANCHOR - 1] = 0  # no whole window of one text
    most = _sliding(np.concatenate([np.zeros(window - 1, np.uint64), least]), window, np.maximum)
    short = (sizes >= ANCHOR) & (sizes < window + ANCHOR - 1)
    low = np.minimum.reduceat(g, texts.starts[:-1])
    at = np.flatnonzero((ahead >= ANCHOR) & (np.where(short, low, 0)[texts.doc] + np.where(short[texts.doc], 0, most) == g))
    return at, g[at]


def marks(h: np.ndarray) -> np.ndarray:
    """16 bits of a word hash, by which a continuation names its words."""
    return (h >> np.uint64(48)).astype("<u2")


def _anchored(lexicon, train_only: bool):
    """(id, key, train, text) -> for training texts (gram, cont, next, n), n texts of a batch; or for all texts (gram, id, key, pos, own).

    next are the marks of the words after an anchor up to the end of the next one (WINDOW words
    after the last), cont a hash of them. Places of a training text with the same gram and
    continuation count once; own is null for other texts.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        lex = lexicon.value
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                texts = Texts(lex, batch.column(3))
                train = batch.column(2).to_numpy(zero_copy_only=False)
                at, gram = anchors(texts)
                if not len(at):
                    continue
                doc, place = texts.doc[at], texts.place[at]
                last = np.append(doc[1:] != doc[:-1], True)
                begin = at + ANCHOR
                end = np.where(last, np.minimum(begin + WINDOW, texts.starts[doc + 1] - 1), np.append(begin[1:], 0))
                raw, mine = marks(texts.h).tobytes(), train[doc]
                said = [raw[a:b] if t else b"" for a, b, t in zip((2 * begin).tolist(), (2 * end).tolist(), mine.tolist())]
                conts = np.fromiter(map(xxhash.xxh3_64_intdigest, said), np.uint64, len(said))
                if train_only:
                    of = np.lexsort((conts, gram, doc))
                    new = np.append(True, (doc[of][1:] != doc[of][:-1]) | (gram[of][1:] != gram[of][:-1]) | (conts[of][1:] != conts[of][:-1]))
                    of = of[new]
                    of = of[np.lexsort((conts[of], gram[of]))]
                    first = np.flatnonzero(np.append(True, (gram[of][1:] != gram[of][:-1]) | (conts[of][1:] != conts[of][:-1])))
                    n, of = np.diff(np.append(first, len(of))), of[first]
                    columns = [pa.array(gram[of].view(np.int64)), pa.array(conts[of].view(np.int64)), pa.array([said[k] for k in of.tolist()], pa.binary()), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "cont", "next", "n"])
                else:
                    of = pa.array(doc)
                    columns = [pa.array(gram.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(place.astype(np.int32)), pa.array(conts.view(np.int64), mask=~mine)]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "id", "key", "pos", "own"])

    return run


def continuations(rows: DataFrame, lexicon) -> DataFrame:
    """(id, key, train, text) -> id, key, told: the places of a text's anchors and what most training texts, itself aside, say next.

    Ties go to the least continuation hash. Two continuations of a gram are enough to leave any one text out.
    """
    known = map_arrow(rows.where("train"), _anchored(lexicon, True), "gram long, cont long, next binary, n long")
    known = known.repartition("gram").groupBy("gram", "cont").agg(F.sum("n").alias("n"), F.any_value("next").alias("next"))
    best = Window.partitionBy("gram").orderBy(F.col("n").desc(), "cont")
    known = known.withColumn("nth", F.row_number().over(best)).where("nth <= 2")
    known = known.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("nth", "cont", "n", "next"))).alias("top"))
    asked = map_arrow(rows, _anchored(lexicon, False), "gram long, id long, key long, pos int, own long")
    met = asked.hint("merge").join(known.withColumnRenamed("gram", "g"), F.col("gram") == F.col("g"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    others = lambda x: F.coalesce(x["n"] - F.col("own").eqNullSafe(x["cont"]).cast("long"), F.lit(0))
    said = F.when((others(first) > 0) & (others(first) >= others(second)), first["next"]).when(others(second) > 0, second["next"])
    met = met.select("id", "key", F.struct("pos", said.alias("next")).alias("t")).where("t.next is not null and length(t.next) > 0")
    return met.groupBy("id", "key").agg(F.sort_array(F.collect_set("t")).alias("told"))


def predictions(texts: Texts, told) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every position: whether a word is predicted, whether rightly, whether by training texts. told is an Arrow list array of (pos, next)."""
    n = len(texts.h)
    word = texts.word
    # within the text: where the words before stood last
    back = np.zeros(n, np.uint64)
    for k in range(1, REPEAT + 1):
        back = (back ^ (back >> np.uint64(31))) * _MIX + np.roll(texts.h, k)
    back = (back ^ texts.doc.astype(np.uint64) * _ODD) * _MIX
    here = np.flatnonzero(word & (texts.place >= REPEAT))
    low = np.uint64((1 << max(n, 1).bit_length()) - 1)
    order = (np.sort((back[here] & ~low) | here.astype(np.uint64)) & low).astype(np.int64)  # by the hash's high bits, then by place
    again = np.flatnonzero(back[order][1:] == back[order][:-1]) + 1
    at = np.full(n, -1)
    at[order[again]] = order[again - 1]
    spots = np.arange(n)
    last = np.maximum.accumulate(np.where(at >= 0, spots, -1))
    on = (at < 0) & (last >= 0) & (spots - last <= ON) & word
    on[on] = texts.doc[last[on]] == texts.doc[spots[on]]  # after a changed word the copy goes on for a while
    at[on] = at[last[on]] + spots[on] - last[on]
    said = at >= 0
    hit = said & (texts.h[at] == texts.h)
    # by training texts
    outer = np.zeros(n, bool)
    if told is not None:
        import pyarrow as pa
        import pyarrow.compute as pc

        many = pc.fill_null(pc.list_value_length(told), 0).to_numpy().astype(np.int64)
        flat = told.flatten()
        if len(flat):
            tails = flat.field("next")
            sizes = pc.binary_length(tails).to_numpy().astype(np.int64) // 2
            doc = np.repeat(np.arange(len(many)), many)
            begin = texts.starts[doc] + flat.field("pos").to_numpy() + ANCHOR
            marked = np.frombuffer(b"".join(tails.to_pylist()), "<u2")
            to = np.arange(len(marked)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
            fits = to < np.repeat(texts.starts[doc + 1] - 1, sizes)
            to, marked = to[fits], marked[fits]
            says = np.zeros(n, "<u2")
            outer[to], says[to] = True, marked  # of several the last, whose anchor is nearest
            hit = np.where(outer, says == marks(texts.h), hit)
            said |= outer
    return said, hit & said, outer


def copied(texts: Texts, said, hit, outer) -> np.ndarray:
    """log10 of what each prediction's outcome had as probability: running rates within the text, 0 where nothing is predicted."""
    out = np.zeros(len(said))
    at = np.flatnonzero(said)
    if not len(at):
        return out
    doc, held = texts.doc[at], hit[at]
    one = np.append(False, held[:-1] & (doc[1:] == doc[:-1]))
    two = one & np.append([False, False], held[:-2] & (doc[2:] == doc[:-2]))[: len(at)]
    state = one.astype(np.int64) + two + 3 * outer[at]
    first = np.searchsorted(at, texts.starts[:-1])
    rate = np.zeros(len(at))
    for s in range(len(PRIOR)):
        mine = state == s
        yes, all_ = (np.append(0, np.cumsum(x)) for x in (mine & held, mine))
        hits, seen = (x[:-1] - x[first[doc]] for x in (yes, all_))
        rate = np.where(mine, (hits + PRIOR[s, 0]) / (seen + PRIOR[s].sum()), rate)
    out[at] = np.log10(np.where(held, rate, 1 - rate))
    return out


def _count_decisions(lexicon, code, bits: int):
    """(text) of training rows -> the task's counts of all slots."""

    def run(batches):
        from pyspark import TaskContext

        lex = lexicon.value
        flat = np.zeros(2 * wordbits.HASHED << bits, np.uint32)
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                texts = Texts(lex, whole.column(0).slice(low, ROWS_AT_ONCE))
                wordbits.add_counts(flat, code.value, texts.symbol, wordbits.contexts(texts.h, texts.place), bits)
        yield from emitted(flat, TaskContext.get().partitionId())

    return run


def _learn(lexicon, model):
    """(text, told) -> n and sums of weights (times n) and refinement counts, for the rows of a task, from words that no copy gives."""

    def run(batches):
        import pyarrow as pa

        lex, live, n = lexicon.value, wordbits.Mixer(*model.value, wordbits.starting_weights(), None), 0
        hit, one = np.zeros((wordbits.GATES, wordbits.BUCKETS)), np.zeros((wordbits.GATES, wordbits.BUCKETS))
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(low, ROWS_AT_ONCE)
                texts = Texts(lex, part.column(0))
                left = ~predictions(texts, part.column(1))[1]
                ctx = wordbits.contexts(texts.h, texts.place)
                live.learn(texts.symbol, ctx, left, texts.starts, hit, one)
                n += int(left.sum())
        if n:
            sums = np.concatenate([live.weights.ravel() * n, hit.ravel(), one.ravel()]).astype(np.float64).tolist()
            yield pa.RecordBatch.from_pylist([{"n": n, "sums": sums}], schema=pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.float64()))]))

    return run


SCHEMA = "id long, key long, word binary, n long, open long, known long, base double, score double, bytes long"


def score_batch(texts: Texts, mixer: wordbits.Mixer, train: np.ndarray, told) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every position, prices of other words aside, and which words no copy gave."""
    said, hit, outer = predictions(texts, told)
    out = copied(texts, said, hit, outer)
    left = ~hit
    ctx = wordbits.contexts(texts.h, texts.place)
    out[left] += mixer.log10(texts.symbol[left], ctx[:, left], train[texts.doc[left]] if train.any() else None)
    return out, left


def _score(lexicon, model, base):
    """(id, key, train, text, told) -> a row of sums for each text, and one for each other word of it."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        lex, mixer = lexicon.value, wordbits.Mixer(*model.value)
        price = base.value  # of symbols
        names = ["id", "key", "word", "n", "open", "known", "base", "score", "bytes"]
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                many = batch.num_rows
                if not many:
                    continue
                texts = Texts(lex, batch.column(3))
                logs, left = score_batch(texts, mixer, batch.column(2).to_numpy(zero_copy_only=False), batch.column(4))
                other = texts.symbol == lex.other
                sums = [np.bincount(texts.doc, x, minlength=many) for x in (price[texts.symbol], logs)]
                known = np.bincount(texts.doc[~other], minlength=many) - 1  # the end is known where there are training texts
                size = pc.fill_null(pc.binary_length(batch.column(3)), 0).cast(pa.int64())
                none, count = pa.nulls(many, pa.int64()), pa.array(np.diff(texts.starts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(many, pa.binary()), count, none, pa.array(known), pa.array(sums[0]), pa.array(sums[1]), size], names)
                at = np.flatnonzero(other)
                coded = texts.flat.take(pa.array(at - texts.doc[at])).dictionary_encode()  # every text before has one end
                distinct = coded.dictionary
                pair = texts.doc[at] * len(distinct) + coded.indices.to_numpy()
                pair, back, n = np.unique(pair, return_inverse=True, return_counts=True)
                free = np.bincount(back, left[at], minlength=len(pair)).astype(np.int64)
                doc = pa.array(pair // max(len(distinct), 1))
                none, void = pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(doc), batch.column(1).take(doc), distinct.take(pa.array(pair % max(len(distinct), 1))), pa.array(n), pa.array(free), none, void, void, none], names
                )

    return run


def _spelled(model):
    """(word, c) -> word, c, spelling (log10 P)."""

    def run(batches):
        import pyarrow as pa

        from slackframe.llm.common import binary_values

        spell = spelling.Speller(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spell(binary_values(batch.column(0))))], ["word", "c", "spelling"])

    return run


class Model:
    """What fit() learns: sizes, the vocabulary table, frequent words, word mixer, speller."""

    def __init__(self, **parts):
        self.__dict__.update(parts)

    def base(self, c):
        """The add-half base probability of a word of count c."""
        return (c + 0.5) / (self.tokens + 0.5 * (self.types + 1))


def fit(rows: DataFrame, frequent: int = FREQUENT) -> Model:
    """(id, key, train, text) -> a model of the rows with train, and told, the continuations of all rows.

    Counts and weights come from all training rows. Each task of the pass that learns the weights of
    words starts from the same ones; their mean counts, so they vary a little with how rows are dealt.
    """
    sc = rows.sparkSession.sparkContext
    texts = rows.where("train")
    ends = texts.count()
    counted = map_arrow(texts.select("text").where("text is not null"), _count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocabulary = written(counted, "vocabulary")
    t = vocabulary.agg(F.count("*"), F.sum("c"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    tokens = (t[1] or 0) + ends
    discount = min(max(t[2] / (t[2] + 2 * t[3]) if t[2] else 0.5, 0.1), 0.9)
    top = vocabulary.where((F.length("word") <= 64) & (F.col("c") >= LEAST_COUNT)).orderBy(F.col("c").desc(), "word").limit(frequent).toArrow()  # a fixed number of words
    words, counts = top.column("word").to_pylist(), top.column("c").to_numpy()
    others = tokens - ends - int(counts.sum())
    counts = np.append(counts, [others, ends])
    lexicon, code, bits = sc.broadcast(Lexicon(words)), wordbits.Code(counts), wordbits.slot_bits(tokens)
    met = gathered(map_arrow(texts.select("text"), _count_decisions(lexicon, sc.broadcast(code), bits), ROWS), wordbits.HASHED << bits)
    told = written(continuations(rows, lexicon), "told")

    parts = (code, wordbits.node_counts(code, counts), met, bits)
    learned = map_arrow(with_told(texts, told).select("text", "told"), _learn(lexicon, sc.broadcast(parts)), "n long, sums array<double>")
    n_weights, n_cells = wordbits.GATES * (wordbits.K + 1), wordbits.GATES * wordbits.BUCKETS
    sums, seen = spelling.summed(learned, n_weights + 2 * n_cells)
    weights = (sums[:n_weights].reshape(wordbits.GATES, -1) / seen).astype(np.float32) if seen else wordbits.starting_weights()
    refine = wordbits.refinement(*(sums[at : at + n_cells].reshape(wordbits.GATES, -1) for at in (n_weights, n_weights + n_cells)))
    return Model(
        ends=ends, tokens=tokens, types=t[0] + (ends > 0), discount=discount, others=others, other_types=t[0] - len(words), told=told,
        vocabulary=vocabulary, words=words, counts=counts, lexicon=lexicon, mixer=(*parts, weights, refine), speller=spelling.fit(vocabulary, t[0]),
    )


def with_told(rows: DataFrame, told: DataFrame) -> DataFrame:
    told = told.select(F.col("id").alias("i"), F.col("key").alias("k"), "told").hint("merge")
    return rows.join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").select("id", "key", "train", "text", "told")


def priced(words: DataFrame, model: Model) -> DataFrame:
    """(word, c) of words out of the tree -> word, c, b (base) and s (log10 probability among such words)."""
    speller = words.sparkSession.sparkContext.broadcast(model.speller)
    spelt = map_arrow(words.select("word", "c"), _spelled(speller), "word binary, c long, spelling double")
    whole = float(max(model.others, 1))
    share = min(max(model.discount * model.other_types, 1.0) / whole, 1.0)
    c, name = F.col("c"), F.col("spelling")
    unseen = math.log10(share) + name
    full = F.log10(F.greatest(c - model.discount, F.lit(0.0)) / whole + share * F.pow(F.lit(10.0), name))
    # a spelling that underflows as a power stays a logarithm
    s = F.when(c == 0, unseen).when(name < -300, F.greatest(unseen, F.log10(F.greatest(c - model.discount, F.lit(1e-9)) / whole))).otherwise(full)
    return spelt.select("word", "c", F.log10(model.base(c)).alias("b"), s.alias("s"))


def score(docs: DataFrame, is_train, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Every row of docs under a model of those where is_train (a condition) holds: id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Scores are log10 probabilities; the base is add-half over the training tokens. A training text's
    own decisions and continuations are left out of its score. Null and empty texts are the end
    token alone. Without training rows no token is known and every count is 0. Texts of any length
    are read whole, a batch of rows at a time. Repeated rows get equal scores; ties between
    continuations go to the least hash. An empty table gives an empty table; a table's own columns
    can't clash, as only id and text are read beside the condition.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.coalesce(is_train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    model = fit(rows, frequent)
    base = np.log10(model.base(model.counts.astype(np.float64)))
    base[-2] = 0.0  # other words are priced on their own
    parts = written(map_arrow(with_told(rows, model.told), _score(model.lexicon, sc.broadcast(model.mixer), sc.broadcast(base)), SCHEMA), "parts")

    rare = parts.where("word is not null")
    needed = rare.select("word").distinct().join(model.vocabulary, "word", "left").select("word", F.coalesce("c", F.lit(0)).alias("c"))
    more = (
        rare.select("id", "key", "word", "n", "open").join(priced(needed, model), "word").groupBy("id", "key")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
            F.sum(F.col("n") * F.col("b")).alias("more_base"),
            F.sum(F.col("open") * F.col("s")).alias("more_score"),
        )
        .select(F.col("id").alias("i"), F.col("key").alias("k"), "more", "more_base", "more_score")
    )
    same = parts.where("word is null").groupBy("id", "key").agg(  # equal for repeated rows, and more has them all
        F.count("*").alias("m"), F.max("n").alias("n"), F.max("known").alias("known"), F.max("base").alias("base"), F.max("score").alias("score"), F.max("bytes").alias("bytes")
    )
    each = lambda c: F.coalesce(F.col(c) / F.col("m"), F.lit(0.0))
    out = same.join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    total = F.col("score") + each("more_score")
    return out.select(
        "id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.round(each("more")).cast("long") + F.lit(int(model.ends > 0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + each("more_base")).alias("base_score"),
        total.alias("score"),
        (-total * F.lit(math.log2(10)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
        F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int"))).alias("copy"),
    ).drop("copy")


def held_out(id_col):
    """Whether a document stays out of training: crc32 of its id as text, modulo 5, is 1."""
    return F.coalesce(crc_mod(id_col, 5) == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    scored = score(docs, ~held_out(F.col("doc_id")))
    return scored.withColumn("held_out", held_out(F.col("id"))).withColumnRenamed("id", "doc_id")
