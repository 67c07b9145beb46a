"""Token-ID files in a word-aligned integer coding.

Simple-8b: each 64-bit word holds a 4-bit selector and as many equal-width ids as fit in 60 bits.
The selectors, in the order tried (most ids first):

    selector   0  1  2  3  4  5  6  7  8  9 10 11 12 13 14 15
    ids      240 120 60 30 20 15 12 10  8  7  6  5  4  3  2  1   (per word)
    bits       0  0  1  2  3  4  5  6  7  8 10 12 15 20 30 60

Selectors 0 and 1 stand for runs of 240 and 120 equal zeros. An id that needs more than 60 bits
can't occur in a word; it is written as an escape: selector 15 with payload 2^60 - 1, then the raw
64-bit id (an id equal to 2^60 - 1 is escaped too).

A file, little-endian: magic "SF8B", u32 version, u64 documents, u64 ids, u64 blocks, u64 words;
then i64 doc_id and u32 length for each document; u64 first word and u32 ids of each block; then
the words. Blocks hold BLOCK ids (the last fewer), start on a word boundary, and decode on their
own, so a reader can go to any id by its block. Files cover ascending ranges of doc_id.
"""

from __future__ import annotations

import array
import json
import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import alone, fresh_path, local_path, map_arrow, tokenizer_file, written

COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
BLOCK = 65_536
#: What may follow the letters of a word and is tokenised apart from them; no apostrophe, which starts contractions.
PUNCTUATION = b".,!?;:%&*$#|"
MAGIC = b"SF8B"
_HEAD = struct.Struct("<4sIQQQQ")


def pack_block(ids: np.ndarray) -> np.ndarray:
    """Ids (uint64) -> words (uint64).

    For each selector, fits[i] says whether the next COUNTS ids from i are narrow enough; it comes
    from running counts of the wide ids. The greedy walk over start positions is then a chain of
    look-ups in one table, and all words are filled together.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    choice = np.full(n, -1, np.int8)
    wide = np.zeros(n + 1, np.int32)
    for s in range(len(COUNTS) - 1, -1, -1):  # a later, denser selector replaces an earlier one
        take = int(COUNTS[s])
        if take > n:
            break
        np.cumsum(ids >= (np.uint64(ESCAPE) if s == 15 else np.uint64(1) << np.uint64(BITS[s])), dtype=np.int32, out=wide[1:])
        if n - wide[n] < take:  # fewer narrow ids than a word takes: denser selectors can't do either
            break
        choice[: n + 1 - take][wide[take:] == wide[: n + 1 - take]] = s
    step = np.where(choice < 0, 1, COUNTS[choice]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    kind = choice[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(kind < 0)[:-1]])
    words = np.zeros(len(starts) + int((kind < 0).sum()), np.uint64)
    for s in range(len(COUNTS)):
        mine = kind == s
        if not mine.any():
            continue
        word = np.full(int(mine.sum()), np.uint64(s) << np.uint64(60), np.uint64)
        if BITS[s]:
            for k in range(int(COUNTS[s])):
                word |= ids[starts[mine] + k] << np.uint64(k * int(BITS[s]))
        words[place[mine]] = word
    far = kind < 0
    words[place[far]] = (np.uint64(15) << np.uint64(60)) | np.uint64(ESCAPE)
    words[place[far] + 1] = ids[starts[far]]
    return words


def unpack_block(words: np.ndarray) -> np.ndarray:
    """Words of one block -> ids, all words of a selector at once."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    mark = (np.uint64(15) << np.uint64(60)) | np.uint64(ESCAPE)
    raw = np.zeros(n, bool)
    if (words == mark).any():  # a raw id may look like an escape, so these are told apart in order
        hits, last = np.flatnonzero(words == mark), -2
        for i in hits:
            if not (i == last + 1 and raw[i]):
                raw[i + 1] = True
                last = i
    kind = (words >> np.uint64(60)).astype(np.int64)
    escape = np.concatenate([raw[1:], [False]])
    width = np.where(raw, 1, COUNTS[kind])
    width[escape] = 0
    start = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(int(start[-1]), np.uint64)
    for s in range(2, len(COUNTS)):
        mine = np.flatnonzero((kind == s) & ~raw & ~escape)
        if len(mine):
            full = np.uint64((1 << int(BITS[s])) - 1)
            for k in range(int(COUNTS[s])):
                out[start[mine] + k] = (words[mine] >> np.uint64(k * int(BITS[s]))) & full
    out[start[:-1][raw]] = words[raw]
    return out


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    first = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    counts = np.array([min(BLOCK, len(ids) - i) for i in range(0, len(ids), BLOCK)], "<u4")
    head = _HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), len(blocks), int(first[-1]))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), first[:-1].tobytes(), counts.tobytes(), *[b.astype("<u8").tobytes() for b in blocks]])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A file's bytes -> doc ids, lengths, all ids."""
    magic, version, docs, n, blocks, words = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token file")
    at = _HEAD.size
    parts = []
    for kind, count in (("<i8", docs), ("<u4", docs), ("<u8", blocks), ("<u4", blocks), ("<u8", words)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += np.dtype(kind).itemsize * count
    doc_ids, lengths, first, counts, body = parts
    ends = np.append(first[1:], words).astype(np.int64)
    ids = [unpack_block(body[int(a) : int(b)])[: int(c)] for a, b, c in zip(first, ends, counts)]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    if len(ids) != n:
        raise ValueError("a token file is damaged")
    return doc_ids, lengths, ids


def _open_store(uri: str):
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


_memo: dict[bytes, bytes] = {}
_library: dict = {}


class Encoder:
    """Whole texts to ids with the tokenizers library, one distinct word at a time.

    No token of this kind of vocabulary spans white space, and a run of letters and a run of
    punctuation after it are tokenised apart, so a text's ids are those of its words' parts in
    order. Ids of words are remembered up to a bound. New words of letters go to the library joined
    by spaces; as each ends in exactly one piece with the end-of-word mark, the ids are cut there.
    """

    def __init__(self, spec: bytes, most: int = 700_000):
        from tokenizers import Tokenizer

        alone(_memo, _library)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        key = zlib.crc32(spec)
        if key not in _library:
            _memo.clear()
            _library.clear()
            tokenizer = Tokenizer.from_str(spec.decode())
            suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
            ends = np.zeros(tokenizer.get_vocab_size(), bool)
            if suffix:
                ends[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
            _library[key] = tokenizer, ends
        (self.tokenizer, self.ends), self.most = _library[key], most

    def _each(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                _memo[word] = array.array("I", e.ids).tobytes()

    def _joined(self, words: list[bytes]) -> None:
        """Words of letters only."""
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or (len(ids) and cuts[-1] != len(ids)):
                self._each(part)
                continue
            raw, low = ids.tobytes(), 0
            for word, high in zip(part, (4 * cuts).tolist()):
                _memo[word] = raw[low:high]
                low = high

    def _learn(self, new: set[bytes]) -> None:
        tails = {w: w.rstrip(PUNCTUATION) for w in new}
        plain = {w: core for w, core in tails.items() if core.isalpha() or (core and core.decode().isalpha())}
        parts = {core for core in plain.values()}.difference(_memo)
        self._joined(sorted(parts))
        rest = {w[len(core) :] for w, core in plain.items() if len(core) < len(w)} | (new - plain.keys())
        self._each(sorted(rest.difference(_memo)))
        for w, core in plain.items():
            if len(core) < len(w):
                _memo[w] = _memo[core] + _memo[w[len(core) :]]

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """An Arrow string array without nulls -> ids of all texts in order, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(_memo) > self.most:
            _memo.clear()
        if self.ends.any():
            # ASCII case is folded here, as the vocabulary's normaliser does, but not where a special token could appear
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        kind = pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()
        distinct = coded.dictionary.cast(kind).to_pylist()
        found = list(map(_memo.get, distinct))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            new = [distinct[i] for i in gaps]
            if self.ends.any():
                self._learn(set(new))
            else:
                self._each(new)
            for i, w in zip(gaps, new):
                found[i] = _memo[w]
            for w in new:
                if len(w) > 256:  # too long to be met again
                    _memo.pop(w, None)
                    _memo.pop(w.rstrip(PUNCTUATION), None)
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy()
        length = sizes[word]
        ends = np.cumsum(length)
        shift = (np.cumsum(sizes) - sizes)[word] - (ends - length)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.arange(total) + np.repeat(shift, length)]
        at = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(at)


def _write(spec, folder: str, end_id: int, file_ids: int):
    """(doc_id, text) batches in order -> token files; one row for each file written."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = Encoder(spec.value), TaskContext.get().partitionId()
        store, top = _open_store(folder)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, number, made = 0, 0, []

        def flush():
            nonlocal held, size, number
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held))
            name = f"part-{part:06d}-{number:06d}.s8b"
            hidden = f"{top}/.{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(hidden) as f:
                f.write(encode_file(doc_ids, lengths, ids))
            store.move(hidden, f"{top}/{name}")  # a repeated task writes the same bytes
            made.append({"part": part, "number": number, "name": name, "docs": len(doc_ids), "ids": len(ids)})
            held, size, number = [], 0, number + 1

        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                doc_ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                ids, lengths = encoder(batch.column(1))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                held.append((doc_ids, lengths + 1, ids))
                size += len(ids)
                if size >= file_ids:
                    flush()
        if held:
            flush()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("part", pa.int64()), ("number", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", spec: bytes | None = None, end_id: int = 2, file_ids: int = 4_000_000) -> DataFrame:
    """Write the ids of all texts, in ascending doc_id order, as token files under folder; returns the manifest.

    Manifest: name, docs, ids, start (ids in all files before it), in order of the files. Null texts
    count as empty and give the end id alone; rows with the same id stand next to each other, by
    text; null ids come first (stored as the least integer). No rows give no files.
    """
    spark = docs.sparkSession
    store, top = _open_store(folder)
    store.create_dir(top, recursive=True)
    spec = spec if spec is not None else open(tokenizer_file("word_bpe_49k.json"), "rb").read()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    made = map_arrow(dealt, _write(spark.sparkContext.broadcast(spec), folder, end_id, file_ids), "part long, number long, name string, docs long, ids long")
    made = written(made, "token-manifest")
    total, starts = 0, []
    for r in made.orderBy("part", "number").collect():  # a row for each file of file_ids ids
        starts.append((r.name, r.docs, r.ids, total))
        total += r.ids
    manifest = spark.createDataFrame(starts, "name string, docs long, ids long, start long")
    with store.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps([dict(zip(("name", "docs", "ids", "start"), x)) for x in starts]).encode())
    return manifest


def _read(folder: str, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        store, top = _open_store(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{top}/{name}") as f:
                    doc_ids, lengths, ids = decode_file(f.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * int(a) : 4 * int(b)]) for a, b in zip(begins, ends)]
                columns = [pa.array(doc_ids, mask=doc_ids == -(2**63)), pa.array(begins + start), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.append(begins, len(ids)).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents as the files have them: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = manifest.select("name", "start").repartition(max(1, manifest.count()))
    return map_arrow(files, _read(folder, with_ids), schema)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, **options), folder)
