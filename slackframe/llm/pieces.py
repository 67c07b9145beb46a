"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Each node knows its failure link, the node whose path is what remains of
the node's path after the pieces that greedy longest-first matching would certainly cut off, and
how many pieces those are. A word is read once: where the trie has no edge, the failure link is
taken and its number of popped pieces added, so no piece is ever built and no byte read twice.
"""

from __future__ import annotations

import json
import zlib
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import alone, binary_values, map_arrow, tokenizer_file

#: The byte that ends a word in the vocabulary; white space, so no word holds it.
END = 0x20
NONE = -1


class Machine:
    """edges[node << 8 | byte] -> node; fail[node] and pops[node] as in the module's description. Node 0 is the root."""

    def __init__(self, pieces):
        edges, final, depth = {}, [False], 1
        for piece in pieces:
            at = 0
            for c in piece:
                key = at << 8 | c
                if key not in edges:
                    edges[key] = depth
                    final.append(False)
                    depth += 1
                at = edges[key]
            final[at] = at > 0
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in edges.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        fail, pops = [NONE] * depth, [0] * depth
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children.get(u, ()):
                if final[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, n = fail[u], pops[u]
                    while z != NONE and (z << 8 | c) not in edges:
                        z, n = fail[z], n + pops[z]
                    if z != NONE:
                        fail[v], pops[v] = edges[z << 8 | c], n
                queue.append(v)
        self.edges, self.fail, self.pops = edges, fail, pops

    def length(self, word: bytes) -> int:
        """Number of pieces of a word with its end mark; 0 if no sequence of greedy matches covers it."""
        edges, fail, pops = self.edges.get, self.fail, self.pops
        at = n = 0
        for c in word:
            to = edges(at << 8 | c)
            while to is None:
                n += pops[at]
                at = fail[at]
                if at == NONE:
                    return 0
                to = edges(at << 8 | c)
            at = to
        while at > 0:
            n += pops[at]
            at = fail[at]
        return n if at == 0 else 0


class _Lengths(dict):
    """Lengths of words seen; words of more than 64 bytes aren't kept."""

    def __init__(self, machine):
        self.machine = machine

    def __missing__(self, word):
        n = self.machine.length(word + b" ")
        if len(word) <= 64:
            self[word] = n
        return n


_known: dict[int, _Lengths] = {}


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, with its word-end mark as END."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    mark = model.get("end_of_word_suffix") or ""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = []
    for piece in model["vocab"]:
        ended = bool(mark) and piece.endswith(mark)
        core = piece[: len(piece) - len(mark)] if ended else piece
        if all(c in back for c in core):
            out.append(bytes(back[c] for c in core) + bytes([END]) * ended)
    return sorted(out)


def _counting(pieces, most: int):
    def run(batches):
        import pyarrow as pa

        alone(_known)
        vocabulary = pieces.value
        key = zlib.crc32(b"\0".join(vocabulary))
        if key not in _known:
            _known.clear()
            _known[key] = _Lengths(Machine(vocabulary))
        known = _known[key]
        get = known.__getitem__
        for batch in batches:
            texts = binary_values(batch.column(batch.num_columns - 1))
            n_words, n_tokens, n_unknown = [], [], []
            for raw in texts:
                if len(known) > most:
                    known.clear()
                words = (raw.lower() if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()).split()
                lengths = list(map(get, words))
                missed = lengths.count(0)
                n_words.append(len(words))
                n_tokens.append(sum(lengths) + missed)  # an unknown word is one token
                n_unknown.append(missed)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_words", "n_tokens", "n_unknown"])

    return run


def count_tokens(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text", most: int = 600_000) -> DataFrame:
    """id, n_words, n_tokens, n_unknown for every row.

    Texts are lower-cased and cut into words at ASCII white space. Each word with its end mark takes
    the longest piece that matches, again and again; a word that can't be covered is one unknown
    token. Null and empty texts count 0. Repeated rows are counted one by one.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    return map_arrow(rows, _counting(shared, most), f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")


def standard_pieces() -> list[bytes]:
    return byte_level_vocabulary(tokenizer_file("word_bpe_49k.json"))
