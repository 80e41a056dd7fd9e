"""Ranked lexical search: every item against every document, as products of dense tiles.

Items are taken in blocks. The words of a block's items are its vocabulary, and its
items are rows of zeros and ones over that vocabulary. A document is a column of
impacts, whole numbers below 2**36, so that the product of the two is the score of
every item for every document. Products are taken in float64, one tile of the
vocabulary and one batch of documents at a time: a sum over ``TILE`` impacts stays
below 2**53, so no product is rounded, and the sums of tiles are added as integers.

A task keeps the best documents of each item while it goes through its batches,
ties by document id, and gives at most ``top`` of them; two rounds of ranks over
what all tasks gave leave the best of all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.session import Scratch

TOP = 50
TILE = 1024  # words of the vocabulary in a product: 1024 * 2**36 < 2**53
BLOCK_ITEMS = 1000  # items whose scores are held at once
BLOCK_CHARS = 1 << 22  # letters of their texts, unless one item alone has more
HELD = 1 << 17  # candidates that a task gathers before it drops all but the best
SALTS = 16
# On lower-cased UTF-8: digits, letters of ASCII, and every byte of what is beyond ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order; A-Z alone are lower-cased, as ``bytes.lower`` does."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Items:
    """A block of items: their ids, their vocabulary, and which words each holds."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        self.ids = [item for item, _ in rows]
        sets = [sorted(set(terms(text))) for _, text in rows]
        self.slots = {term: slot for slot, term in enumerate(sorted({t for s in sets for t in s}))}
        # Sparse: the tiles of zeros and ones are made where they are multiplied.
        self.rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.columns = np.array([self.slots[t] for s in sets for t in s], np.int64)

    def tile(self, start: int) -> np.ndarray:
        mine = (self.columns >= start) & (self.columns < start + TILE)
        made = np.zeros((len(self.ids), min(TILE, len(self.slots) - start)))
        made[self.rows[mine], self.columns[mine] - start] = 1
        return made


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items, a bounded number and length at a time."""
    rows, chars = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        if rows and (len(rows) == BLOCK_ITEMS or chars + len(row.text or "") > BLOCK_CHARS):
            yield Items(rows)
            rows, chars = [], 0
        rows.append((row.item_id, row.text))
        chars += len(row.text or "")
    if rows:
        yield Items(rows)


def counted(docs: DataFrame, block: Items) -> DataFrame:
    """doc_id, n, and slots and counts of the block's words, for every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(block.slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_of = shared.value
        known = slot_of.keys()
        for batch in batches:
            sizes, held, slots, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                times = Counter(found)
                mine = sorted((slot_of[t], times[t]) for t in times.keys() & known)
                sizes.append(len(found))
                held.append(len(mine))
                slots.extend(s for s, _ in mine)
                counts.extend(c for _, c in mine)
            offsets = pa.array(np.r_[0, np.cumsum(held)].astype(np.int32))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(slots, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "slots", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, slots array<int>, counts array<long>").where("n > 0")


def weights(found: DataFrame, block: Items, n_docs: int) -> np.ndarray:
    """Weight of each slot; 0 for words that no document holds, as they add to no score."""
    made = np.zeros(len(block.slots), np.int64)
    # A row for each word of the block, whatever the number of documents.
    for slot, df in found.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1))).collect():
        made[slot] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return made


class Best:
    """The best documents of each item so far: by score, then id, null ids last."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.least = np.ones(items, np.int64)  # what a score must reach
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """``scores``: items by documents. Equal scores pass, so that ids can decide."""
        item, doc = np.nonzero(scores >= self.least[:, None])
        if len(item):
            self.parts.append((item, scores[item, doc], nulls[doc], ids[doc]))
            self.held += len(item)
        if self.held > HELD:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        item, score, null, doc = (np.concatenate(x) for x in zip(empty, *self.parts, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item, score, null, doc = item[order], score[order], null[order], doc[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        last = place == self.top - 1
        self.least[item[last]] = score[last]
        kept = place < self.top
        self.parts = [(item[kept], score[kept], null[kept], doc[kept])]
        self.held = int(kept.sum())
        return self.parts[0]


def impacts(counts: np.ndarray, weight: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a word adds to the score of a document, in 64-bit integers."""
    return weight * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


def _best_of_tasks(found: DataFrame, block: Items, n_docs: int, n_terms: int, top: int) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast((block, weights(found, block, n_docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        starts = range(0, len(items.slots), TILE)
        tiles = [items.tile(s) for s in starts]
        best = Best(len(items.ids), top)
        for batch in batches:
            n = batch.column(1).to_numpy()
            m = 50 + (50 * n * n_docs) // n_terms
            slots = batch.column(2).flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            impact = impacts(batch.column(3).flatten().to_numpy(), weight[slots], m[doc])
            scores = np.zeros((len(items.ids), batch.num_rows), np.int64)
            for start, tile in zip(starts, tiles, strict=True):
                mine = (slots >= start) & (slots < start + TILE)
                if mine.any():
                    dense = np.zeros((tile.shape[1], batch.num_rows))
                    dense[slots[mine] - start, doc[mine]] = impact[mine]
                    scores += (tile @ dense).astype(np.int64)
            ids = batch.column(0)
            best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, null, ids = best.shrink()
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    made = found.mapInArrow(run, "item long, doc_id long, score long")
    by_rank = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*by_rank))).where(F.col("rank") <= top)
    ranked = some.drop("rank", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by_rank))).where(F.col("rank") <= top)
    # The ids of a block, a bounded number.
    names = found.sparkSession.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, run: Scratch | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of every item.

    Every document is scored for every item; a document scores by the item's words
    that it holds, each once, weighted by how few documents hold it and by how often
    and in how long a text. Null and empty texts have no terms and are in no result.
    Equal scores stand in the order of ids, null ids last. Rows that repeat an id are
    documents, or items, of their own. Without items, or documents, there are no rows.
    A text of any length is one row of a batch; memory goes with the longest text.
    """
    run = run or Scratch(docs.sparkSession)
    made = None
    for block in _blocks(items):
        if not block.slots:
            continue
        found = run.settle(counted(docs, block))
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs:
            part = _best_of_tasks(found, block, n_docs, n_terms, top)
            made = part if made is None else made.union(part)
    return made if made is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
