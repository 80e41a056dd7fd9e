"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every
id, level 1 the next chunk of those ids that have one, and so on. A bitmap per
level says which ids go on, and a directory of running counts of its set bits
says where they go on: token ``i`` of level ``k`` is token ``rank(i)`` of level
``k + 1``. So any token is read with a few look-ups, without decoding others.

A store is a folder of Parquet files. A row is a segment: whole documents, one
after the other, with their directory and the code as bytes. Segments follow the
order of ids: by ``part``, then ``seq``. ``manifest`` holds the tokens before
each part. One row per written partition, so it is small by construction.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.pieces import chunks, plain_pieces

SEGMENT = 1 << 18  # tokens after which a segment is closed; a longer document makes a longer one
BLOCK = 512  # bits for each entry of a rank directory
CACHED = 800_000  # chunks, and pieces, that a worker remembers: bounds memory, not the input
PIECES_AT_ONCE = 50_000  # new pieces in one call of the library
CHARS_AT_ONCE = 1 << 22  # letters of the texts that are encoded together, unless one text has more
_HEAD = struct.Struct("<4sQB")
_LEVEL = struct.Struct("<Q")
_MAGIC = b"DAC1"


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable code of an array of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = np.unpackbits(bits).reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint64) - ones).astype("<u4")
        levels.append(_LEVEL.pack(len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    return _HEAD.pack(_MAGIC, len(ids), len(levels)) + b"".join(levels)


class Packed:
    """A code in memory; reads single tokens or all of them."""

    def __init__(self, raw: bytes) -> None:
        magic, self.size, n = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        at, self.levels = _HEAD.size, []
        for _ in range(n):
            (count,) = _LEVEL.unpack_from(raw, at)
            at += _LEVEL.size
            blocks = -(-count // BLOCK)
            low = np.frombuffer(raw, np.uint8, count, at)
            bits = np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at + count)
            ranks = np.frombuffer(raw, "<u4", blocks, at + count + len(bits))
            at += count + len(bits) + ranks.nbytes
            self.levels.append((low, bits, ranks))

    def __getitem__(self, i: int) -> int:
        """Token ``i``: a byte, a bit and a rank for each level it reaches."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            start = block * BLOCK // 8
            before = int(np.bitwise_count(bits[start : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + before
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        values = np.zeros(self.size, np.uint32)
        where = None
        for level, (low, bits, _) in enumerate(self.levels):
            part = low.astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                values[:] = part
                where = np.flatnonzero(np.unpackbits(bits, count=len(low), bitorder="little"))
            else:
                values[where] |= part
                where = where[np.flatnonzero(np.unpackbits(bits, count=len(low), bitorder="little"))]
        return values


class LibraryEncoder:
    """Ids of texts by the tokenizers library, which sees every distinct piece once.

    A piece is encoded on its own, whatever stands around it, so the new pieces of many
    texts go to the library as one text with spaces between, and its ids are cut after
    each token that ends a word. Chunks and pieces are remembered up to ``CACHED`` each;
    then the memory starts anew.
    """

    def __init__(self, config: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        raw = np.fromiter(chain.from_iterable(made), "<u4").tobytes()
        ends = list(accumulate((4 * len(ids) for ids in made), initial=0))
        return [raw[a:b] for a, b in pairwise(ends)]

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) != len(pieces):  # a vocabulary without word ends
            return self._ids(pieces)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in pairwise([0, *stops.tolist()])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null is empty.

        The library sees pieces of plain chunks, and other texts whole.
        """
        found = [chunks(text) if text else [] for text in texts]
        whole = [i for i, parts in enumerate(found) if len(parts) == 1 and (parts[0] is texts[i] or len(texts[i]) >= 64)]
        alone = dict(zip(whole, self._ids([texts[i] for i in whole]), strict=True)) if whole else {}
        known, pieces = self.chunks, self.pieces
        new = set().union(*[parts for i, parts in enumerate(found) if i not in alone]).difference(known)
        if new:
            cut = {c: plain_pieces(c) for c in new}
            if len(known) + len(new) > CACHED:
                old = set().union(*[parts for i, parts in enumerate(found) if i not in alone]).intersection(known)
                self.chunks = known = {c: known[c] for c in old}
            unseen = list({p for parts in cut.values() for p in parts}.difference(pieces))
            if len(pieces) + len(unseen) > CACHED:
                self.pieces = pieces = {p: pieces[p] for parts in cut.values() for p in parts if p in pieces}
            for at in range(0, len(unseen), PIECES_AT_ONCE):
                some = unseen[at : at + PIECES_AT_ONCE]
                pieces.update(zip(some, self._ids_of_pieces(some), strict=True))
            known.update((c, b"".join([pieces[p] for p in parts])) for c, parts in cut.items())
        return [alone[i] if i in alone else b"".join([known[c] for c in parts]) for i, parts in enumerate(found)]


_WORKER: dict[str, LibraryEncoder] = {}


def _encoder(tokenizer: str, config: str) -> LibraryEncoder:
    """The worker's encoder, which outlives a task. Found by name: a nested function would carry an empty copy of the table."""
    if tokenizer not in _WORKER:
        _WORKER[tokenizer] = LibraryEncoder(config)
    return _WORKER[tokenizer]


SEGMENTS = "part int, seq int, token_start long, n_tokens long, docs array<struct<doc_id: long, n_tokens: long, first: long>>, payload binary"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.int64())]))
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int64()), ("docs", _DOCS), ("payload", pa.binary())])


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every text and write the store to ``folder``, in ascending ``doc_id``.

    One range exchange on the id; equal ids are told apart by a hash of the text,
    so no id is hot. Null ids come first, null texts are empty; a document without
    tokens holds just the end id. The folder must not exist.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        encode = _encoder(tokenizer, shared.value).encode
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, chars = 0, 0
            for i, text in enumerate(texts):
                chars += len(text or "")
                if chars > CHARS_AT_ONCE or i == len(texts) - 1:
                    yield from zip(ids[start : i + 1], encode(texts[start : i + 1]), strict=True)
                    start, chars = i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        names: list[dict] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"part": part, "seq": seq, "token_start": start, "n_tokens": len(ids), "docs": list(names), "payload": pack(ids)}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for doc_id, ids in encoded(batches):
            raw = ids + end
            held.append(raw)
            names.append({"doc_id": doc_id, "n_tokens": len(raw) // 4, "first": size})
            size += len(raw) // 4
            if size >= SEGMENT:
                yield close()
                seq, start, size = seq + 1, start + size, 0
                held.clear()
                names.clear()
        if names:
            yield close()

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)
    ordered.mapInArrow(run, SEGMENTS).write.parquet(f"{folder}/segments")
    # One row for each partition that was written: this window is as long as that list.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base")).coalesce(1).write.parquet(f"{folder}/manifest")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    # A row for each file of the store: bounded by its partitions, not by its tokens.
    return F.broadcast(spark.read.schema("part int, base long").parquet(f"{folder}/manifest"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a store: where it starts among all tokens, its length and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, at = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                ids = Packed(batch.column(3)[row].as_py()).all().astype("<u4")
                out: tuple[list, ...] = ([], [], [], [], [])
                done = 0
                for doc in batch.column(2)[row].as_py():
                    n = doc["n_tokens"]
                    for column, value in zip(out, (part, doc["doc_id"], at + done, n, zlib.crc32(ids[done : done + n].tobytes())), strict=True):
                        column.append(value)
                    done += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])],
                    names=["part", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").select("part", "token_start", "docs", "payload")
    read = segments.mapInArrow(run, "part int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return read.join(_manifest(spark, folder), "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The token at each (doc_id, position) of ``wanted``, read by address.

    Positions outside their document, and ids that the store lacks, give no row; a
    repeated position gives as many. A segment is read once for all that is asked of
    it, and no more can be asked than it has tokens.
    """
    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    listed = segments.select("part", "seq", F.explode("docs").alias("doc")).select("part", "seq", "doc.*")
    times = wanted.select("doc_id", "position").groupBy("doc_id", "position").agg(F.count(F.lit(1)).alias("times"))
    asked = times.join(listed, "doc_id").where("position >= 0 AND position < n_tokens")
    asked = asked.groupBy("part", "seq").agg(F.collect_list(F.struct((F.col("first") + F.col("position")).alias("at"), "doc_id", "position", "times")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                code, rows = Packed(batch.column(1)[row].as_py()), batch.column(0)[row].as_py()
                out = [(x["doc_id"], x["position"], code[x["at"]]) for x in rows for _ in range(x["times"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "position", "token_id"])

    found = segments.select("part", "seq", "payload").join(asked, ["part", "seq"]).select("asked", "payload")
    return found.mapInArrow(run, "doc_id long, position long, token_id long")
