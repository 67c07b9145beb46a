"""Benchmark decontamination with templates.

Numbers, names and units become typed placeholders, so a question with other numbers or names has
the same template. Windows of template tokens of the benchmark and of the documents meet in a hash
join; templates are then compared as text, and the values that stand in the placeholders must map
one to one between question and document. A document is reported with every item of which enough
aligned windows agree. An item needs only its rarest windows to be proposed: where k of its n windows
have to agree, one of any n - k + 1 of them does, so what many items share proposes none of them.
Items of a few words are found where a whole line of a document is that item.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackframe.llm.common import alone, binary_values, map_arrow, written

WINDOW = 8
#: Aligned windows that make a leak: 6 windows of 8 tokens are 13 tokens in a row. Shorter items need all of theirs.
ENOUGH = 6
#: Items of fewer tokens say too little to be searched for within a text; a line has to equal them.
SHORTEST = 5
_LINE = "\n"

# Words that stand for a placeholder.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters dollar dollars cent cents euro euros percent mph kmh degrees celsius fahrenheit"
NAMES = "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew kevin brian george edward peter henry jack sam tom tim ben alex mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley emily emma olivia anna maria laura julia alice jane kate lucy carlos juan jose luis miguel sofia carmen pierre jean marie claire louis hans karl fritz greta heidi klaus"

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*%?\Z")
_QUANTITY = re.compile(r"([+-]?\d[\d.,]*)([a-z]+)\Z")
_WORDS = dict.fromkeys(NUMBER_WORDS.split(), "<num>") | dict.fromkeys(UNITS.split(), "<unit>")
_NAMES = frozenset(NAMES.split())
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "+-$%") + "«»“”‘’„¿¡…"


def canonical(word: str) -> tuple[str, str, str, str, bool]:
    """A word -> token and slot value at the start of a sentence, token and slot value within one, whether it ends a sentence."""
    ends = word.rstrip("\"')]}»”’").endswith((".", "!", "?", ":"))
    core = word.strip(_EDGE) or word
    low = core.lower()
    if _NUMBER.match(low):
        return "<num>", low.rstrip(".,"), "<num>", low.rstrip(".,"), ends
    if low in _WORDS:
        return _WORDS[low], low, _WORDS[low], low, ends
    if (m := _QUANTITY.match(low)) and _WORDS.get(m[2]) == "<unit>":
        return "<num><unit>", low, "<num><unit>", low, ends
    if core[:1].isupper() and low in _NAMES:
        return "<name>", low, "<name>", low, ends
    if core[:1].isupper() and core[1:].islower():
        return low, "", "<name>", low, ends
    return low, "", low, "", ends


def _hashed(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token.encode())


class Lexicon(dict):
    """Words seen, as rows of growing arrays: both hashes, and whether the word ends a sentence."""

    def __init__(self):
        self.first, self.inner, self.ends = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, bool)
        self.forms: list[tuple] = []

    def __missing__(self, word: bytes) -> int:
        at = len(self.forms)
        if at == len(self.first):
            self.first, self.inner, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.inner, self.ends))
        form = canonical(word.decode("utf-8", "replace"))
        self.first[at], self.inner[at], self.ends[at] = _hashed(form[0]), _hashed(form[2]), form[4]
        self.forms.append(form)
        self[word] = at
        return at

    def read(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text -> rows of its words, hashes of its tokens, which tokens stand within a sentence."""
        words = raw.split()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        inner = np.concatenate([[False], ~self.ends[rows[:-1]]]) if len(rows) else np.zeros(0, bool)
        return rows, np.where(inner, self.inner[rows], self.first[rows]), inner


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every n tokens, modulo 2^64."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(tokens) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : len(tokens) - n + 1 + k]
    return out ^ (out >> np.uint64(29))


def _window(forms: list[tuple[str, str]]) -> tuple[str, list[str]]:
    return " ".join(t for t, _ in forms), [f"{t}={v}" for t, v in forms if v]


def _plain(forms: list[tuple]) -> str:
    """A whole line as text: its tokens as they stand in a sentence, numbers and names with their values."""
    return _LINE + " ".join(v if t.startswith("<") else t for _, _, t, v, _ in forms)


def _signed(text: str) -> int:
    return int(np.uint64(_hashed(text)).astype(np.int64))


_LEXICON: list[Lexicon] = []


def _lexicon(most: int = 200_000) -> Lexicon:
    if not _LEXICON or len(_LEXICON[0].forms) > most:
        _LEXICON[:] = [Lexicon()]
    return _LEXICON[0]


def _item_windows(batches):
    """(item, text) -> every template window of every item, by its place. The first word may stand within a sentence elsewhere."""
    import pyarrow as pa

    alone(_LEXICON)
    for batch in batches:
        out = []
        for item, raw in zip(batch.column(0).to_pylist(), binary_values(batch.column(1))):
            lex = _lexicon()
            rows, _, inner = lex.read(raw)
            n = min(WINDOW, len(rows))
            if n < SHORTEST:
                if n:
                    line = _plain([lex.forms[r] for r in rows])
                    out.append({"hash": _signed(line), "n": 0, "item": item, "at": 0, "of": 1, "template": line, "slots": []})
                continue
            forms = [lex.forms[r][2:4] if i else lex.forms[r][:2] for r, i in zip(rows, inner)]
            variants = [forms] + ([[lex.forms[rows[0]][2:4], *forms[1:]]] if lex.forms[rows[0]][:2] != lex.forms[rows[0]][2:4] else [])
            for v, each in enumerate(variants):
                hashes = window_hashes(np.array([_hashed(t) for t, _ in each], np.uint64), n)
                for at in range(len(hashes) if v == 0 else 1):
                    template, slots = _window(each[at : at + n])
                    out.append({"hash": int(hashes[at].astype(np.int64)), "n": n, "item": item, "at": at, "of": len(rows) - n + 1, "template": template, "slots": slots})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("hash", pa.int64()), ("n", pa.int32()), ("item", pa.int64()), ("at", pa.int64()), ("of", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string()))]))


def _doc_windows(sieve, lengths):
    """(id, key, text) -> those windows that a fixed-size sieve lets through."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("hash", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string()))])
        alone(_LEXICON)
        table = np.frombuffer(sieve.value, np.uint8)
        shift = np.uint64(64 - (len(table).bit_length() - 1))
        for batch in batches:
            out = []
            for id_, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2))):
                lex = _lexicon()
                rows, tokens, inner = lex.read(raw)
                for n in lengths:
                    if not n:
                        for line in {x for x in raw.split(b"\n") if 0 < len(x.split(None, SHORTEST)) < SHORTEST}:
                            line = _plain([lex.forms[lex[w]] for w in line.split()])
                            h = _signed(line)
                            if table[np.uint64(h & 0xFFFFFFFFFFFFFFFF) >> shift]:
                                out.append({"hash": h, "id": id_, "key": key, "at": 0, "template": line, "slots": []})
                        continue
                    hashes = window_hashes(tokens, n)
                    for at in np.flatnonzero(table[hashes >> shift]):
                        forms = [lex.forms[r][2:4] if i else lex.forms[r][:2] for r, i in zip(rows[at : at + n], inner[at : at + n])]
                        template, slots = _window(forms)
                        out.append({"hash": int(hashes[at].astype(np.int64)), "id": id_, "key": key, "at": int(at), "template": template, "slots": slots})
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _sieve(items: DataFrame, bits: int) -> bytes:
    """A table of 2^bits bytes: 1 where some window hash begins with these bits. Its size doesn't depend on the benchmark."""
    table = np.zeros(1 << bits, np.uint8)
    heads = items.select(F.shiftrightunsigned("hash", 64 - bits).alias("h")).distinct()
    for r in heads.toLocalIterator():
        table[r.h] = 1
    return table.tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bits: int = 22) -> DataFrame:
    """Pairs of a document and an item found in it: id, key, item, n_windows, of, coverage, n_slots, reworded.

    Each pair once, with its best alignment; of equal ones the one that isn't reworded, then the one
    of more slots. A leak has ENOUGH aligned windows (or all, of a shorter item) with equal templates
    and placeholder values that map one to one; reworded says that some value differs. Windows of
    which more than half the tokens are placeholders need equal values. Items under SHORTEST words
    are found as whole lines, values and all. Texts and items are read whole. Repeated rows of one id
    and text count as one document; null and blank texts and items hold nothing. An empty table gives
    no pair. Only id and text are read, so other columns can't clash.
    """
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    items = written(map_arrow(rows, _item_windows, "hash long, n int, item long, at long, of long, template string, slots array<string>"), "items")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # at most WINDOW of them
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(items, bits))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    found = map_arrow(texts, _doc_windows(sieve, lengths), "hash long, id long, key long, at long, template string, slots array<string>")
    # mostly placeholders: the values have to agree as well
    values = F.when(2 * F.size("slots") > F.size(F.split("template", " ")), F.array_join("slots", " ")).otherwise("")
    found = written(found.withColumn("values", values), "windows")
    window = ["hash", "template", "values"]
    b = items.select("hash", "item", "template", "of", values.alias("values"), F.col("at").alias("b_at"), F.col("slots").alias("b_slots"))
    enough = F.least(F.lit(ENOUGH), F.col("of"))
    shared = b.groupBy(*window).agg(F.count("*").alias("freq"))
    rarest = Window.partitionBy("item", "of").orderBy("freq", "b_at", "hash")
    # the first window may have two forms, so one place more than needed
    probes = b.join(shared, window).withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= F.col("of") - enough + 2)
    proposed = found.join(probes.select(*window, "item", "of", "b_at"), window).select("id", "key", "item", "of", (F.col("at") - F.col("b_at")).alias("shift")).distinct()
    due = proposed.join(b, ["item", "of"]).withColumn("at", F.col("b_at") + F.col("shift"))
    mine = found.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("at").alias("a"), *[F.col(c).alias(f"d_{c}") for c in window], "slots")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("at") == F.col("a"))
    for c in window:
        same = same & (F.col(c) == F.col(f"d_{c}"))
    pairs = due.join(mine, same)
    both = F.transform(F.arrays_zip(F.col("b_slots").alias("b"), F.col("slots").alias("d")), lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d")))
    runs = (
        pairs.groupBy("id", "key", "item", "of", "shift")
        .agg(F.collect_set("b_at").alias("places"), F.flatten(F.collect_set(both)).alias("slots"))
        .withColumn("slots", F.array_distinct("slots"))
    )
    one = lambda side: F.size(F.array_distinct(F.transform("slots", lambda x: x[side]))) == F.size("slots")
    good = runs.where(one("b") & one("d") & (F.size("places") >= F.least(F.lit(ENOUGH), F.col("of"))))
    said = good.select(
        "id", "key", "item", F.size("places").cast("long").alias("n_windows"), "of",
        F.size("slots").cast("long").alias("n_slots"), F.exists("slots", lambda x: x["b"] != x["d"]).alias("reworded"),
    )
    best = F.max_by(F.struct("n_windows", "of", "n_slots", "reworded"), F.struct("n_windows", ~F.col("reworded"), "n_slots"))
    return said.groupBy("id", "key", "item").agg(best.alias("x")).select("id", "key", "item", "x.*", (F.col("x.n_windows") / F.col("x.of")).alias("coverage"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = leaks(docs, benchmark)
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"), F.max("n_slots").alias("n_slots"), F.min("reworded").alias("reworded")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs in which no item of the benchmark is found, with their columns as they were.

    Null and blank texts stay, repeated rows stay or go together, and an empty table stays one; an
    empty benchmark drops nothing. Columns of docs may have any names but __sf_id and __sf_key.
    """
    found = leaks(docs, benchmark).select(F.col("id").alias("__sf_id"), F.col("key").alias("__sf_key")).distinct()
    return docs.join(found.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__sf_id")) & (F.xxhash64(docs["text"]) == F.col("__sf_key")), "left_anti")
