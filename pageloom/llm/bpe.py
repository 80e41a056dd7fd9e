"""BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token its encoding can end in.
A generalised suffix automaton of the vocabulary gives, at each place, the
tokens that end there. The one to keep is the one that is compatible with the
last token of the prefix before it: the two, undone merge by merge along their
border, hold no merge that would have come earlier. Following the back-pointers
from the end gives the exact ids, without merging anything.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.pieces import byte_letters, chunks, pieces
from pageloom.llm.suffix import Automaton

END = "</w>"
CACHED = 300_000  # distinct pieces a worker remembers; a bound on memory, not on the input


@dataclass
class Vocabulary:
    """What the driver reads from the tokenizer file; its size is the vocabulary's."""

    names: list[str]  # the token of each id
    merges: list[tuple[int, int]]  # pairs in order of rank
    first: int  # id of the first merged token
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        ids = dict(found["model"]["vocab"])
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
        special = {t["content"]: t["id"] for t in found["added_tokens"]}
        names = [""] * (max([*ids.values(), *special.values()]) + 1)
        for name, number in {**ids, **special}.items():
            names[number] = name
        first = len(ids) - len(merges)
        for rank, (a, b) in enumerate(merges):
            if ids[a + b] != first + rank:
                raise ValueError("ids of merged tokens must follow the order of merges")
        return cls(names, [(ids[a], ids[b]) for a, b in merges], first, special)


class Encoder:
    """Encodes single pieces; one per worker, with a bounded cache."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.names = vocabulary.names
        self.special = vocabulary.special
        self.first = vocabulary.first
        self.pair = {pair: self.first + rank for rank, pair in enumerate(vocabulary.merges)}
        self.parts = vocabulary.merges
        ids = {name: i for i, name in enumerate(vocabulary.names[: self.first])}
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + END] for c in letters]
        self._valid: dict[int, bool] = {}
        self._build()

    def _build(self) -> None:
        """Symbols of every token, the automaton, and the tokens that end in each state."""
        symbols: list[tuple[int, ...]] = [(i,) for i in range(self.first)]
        usable = [True] * self.first
        for a, b in self.parts:
            symbols.append(symbols[a] + symbols[b])
            # A token that its own letters do not merge to is never emitted.
            usable.append(usable[a] and usable[b] and self._merges(symbols[-1]) == [len(symbols) - 1])
        automaton = Automaton(self.first)
        for s in symbols:
            automaton.add(s)
        own: dict[int, list[tuple[int, int]]] = {}
        for token, s in enumerate(symbols):
            if usable[token]:
                own.setdefault(automaton.walk(s), []).append((len(s), token))
        automaton.finish()
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(automaton.length)
        for state in sorted(range(1, len(ends)), key=automaton.length.__getitem__):
            shorter = ends[automaton.link[state]]
            ends[state] = tuple(sorted(own[state], reverse=True)) + shorter if state in own else shorter
        self.step, self.link, self.length, self.ends, self.width = automaton.step, automaton.link, automaton.length, ends, self.first

    def _merges(self, symbols: Iterable[int]) -> list[int]:
        """Textbook merging, for the vocabulary's own tokens only."""
        row = list(symbols)
        while len(row) > 1:
            ranked = [self.pair.get(p, 1 << 60) for p in zip(row, row[1:], strict=False)]
            best = min(ranked)
            if best == 1 << 60:
                break
            at = ranked.index(best)
            row[at : at + 2] = [best]
        return row

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' text is just these two tokens."""
        if len(self._valid) > 1_000_000:
            self._valid.clear()
        known = self._valid[left << 20 | right] = self._holds(left, right)
        return known

    def _holds(self, a: int, b: int) -> bool:
        pair, parts, first = self.pair, self.parts, self.first
        limit = 1 << 60
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:  # the later merge is undone first
                limit = a
                if a >= first:
                    a = parts[a - first][1]
                    continue
                limit = b + 1
                if b < first:
                    return True
                b = parts[b - first][0]
            else:
                limit = b + 1
                if b >= first:
                    b = parts[b - first][0]
                    continue
                limit = a
                if a < first:
                    return True
                a = parts[a - first][1]

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        found = [self.inner[b] for b in raw]
        found[-1] = self.final[raw[-1]]
        return found

    def encode(self, piece: str) -> list[int]:
        """The ids of one piece."""
        if piece in self.special:
            return [self.special[piece]]
        symbols = self.symbols(piece)
        step, link, length, ends, width = self.step, self.link, self.length, self.ends, self.width
        valid = self._valid.get
        last = [-1]  # the token each prefix ends in
        back = [0]  # and its length
        state = size = i = 0
        for symbol in symbols:
            i += 1
            to = step.get(state * width + symbol)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step.get(state * width + symbol)
            if to is not None:
                state = to
                size += 1
            kept, span = -1, 0
            for n, token in ends[state]:
                if n <= size:
                    before = last[i - n]
                    if before < 0:
                        if i != n:
                            continue
                    else:
                        fits = valid(before << 20 | token)
                        if fits is None:
                            fits = self.compatible(before, token)
                        if not fits:
                            continue
                    kept, span = token, n
                    break
            last.append(kept)
            back.append(span)
        out, i = [], len(symbols)
        while i:
            out.append(last[i])
            i -= back[i]
        out.reverse()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decoding of a tokenizer without decoder: tokens with spaces between."""
        return " ".join([self.names[i] for i in ids])


class Pieces(dict):
    """Piece to its ids; misses are encoded and kept while there is room."""

    def __init__(self, encode: Callable[[str], list[int]], room: int = CACHED) -> None:
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, piece: str) -> list[int]:
        made = self.encode(piece)
        if len(self) < self.room and len(piece) < 64:
            self[piece] = made
        return made


class Memo(dict):
    """Chunk of a text to (ids as text, number of ids, decoded text)."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder
        self.known = Pieces(encoder.encode)

    def __missing__(self, chunk: str) -> tuple[str, int, str]:
        known = self.known
        ids = [i for piece in pieces(chunk) for i in known[piece]]
        made = (" ".join(map(str, ids)), len(ids), self.encoder.decode(ids))
        if len(self) < CACHED and len(chunk) < 64:
            self[chunk] = made
        return made


_WORKER: dict[int, Memo] = {}


def _memo(shared: Broadcast) -> Memo:
    """This worker's encoder; built once per process, then reused by later tasks."""
    key = shared.value["key"]
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Memo(shared.value["encoder"])
    return _WORKER[key]


def _digest(parts: list[str]) -> str:
    return hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per row of ``docs``.

    A narrow map: no shuffle, nothing gathered. A text that is null or empty has
    no tokens; its digests are those of the empty string. Rows with equal or null
    ids stay rows of their own. Other columns are not read, whatever their names.
    """
    encoder = Encoder(Vocabulary.read(vocabulary))
    shared = spark.sparkContext.broadcast({"key": vocabulary, "encoder": encoder})
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(shared)
        get = memo.__getitem__
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                found = [x for x in map(get, chunks(text)) if x[1]] if text else []
                texts, ns, names = zip(*found, strict=True) if found else ((), (), ())
                counts.append(sum(ns))
                ids.append(_digest(texts))
                decoded.append(_digest(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_column, text_column).mapInArrow(
        run, f"`{id_column}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def token_ids(memo: Memo, text: str) -> np.ndarray:
    """The ids of a text as an array, for callers that need them whole."""
    return np.array([int(i) for c in chunks(text) for i in memo[c][0].split()], dtype=np.uint32)
