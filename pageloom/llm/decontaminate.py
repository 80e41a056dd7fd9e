"""Benchmark passages in documents.

Windows as long as an item, or the whole of a shorter text, get a SimHash of
their shingles. Blocks of the
fingerprint are looked up within a small distance of the items' blocks, which
finds every item within the radius; for those the weighted similarity of the
shingle multisets decides. A window without any shingle of an item has
similarity zero to all, so windows are only laid where such a shingle stands.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.hashing import shingles, word_hashes

SHINGLE = 5
SIMILAR = 0.8
BLOCKS = 8  # of eight bits each
NEAR = 2  # bits that one block may differ in
RADIUS = BLOCKS * (NEAR + 1) - 1  # farther in all blocks by NEAR + 1 at least: nothing within the radius is missed
PER_PASS = 20_000  # items that are matched at once; more are matched in further passes over the documents

_BITS = np.arange(64, dtype=np.uint64)
_CLOSE = np.array([[(a ^ b).bit_count() <= NEAR for b in range(256)] for a in range(256)])


def simhash(rows: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of signed bits, one row of 64 sums each."""
    return ((rows > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def _weighted(a: Counter, b: Counter) -> float:
    """Jaccard similarity of multisets: a shingle weighs as often as it occurs."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


@dataclass
class Group:
    """Items of one length in words."""

    size: int
    items: list[int]  # positions in the index
    prints: np.ndarray
    tables: list[np.ndarray]  # per block: value by item, whether the item's block is within NEAR


class Index:
    """Items of one pass, by length."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int = SHINGLE, similar: float = SIMILAR) -> None:
        self.shingle, self.similar = shingle, similar
        self.ids: list[int | None] = []
        self.counts: list[Counter] = []
        by_size: dict[int, list[int]] = {}
        for item, text in items:
            words = word_hashes(text)
            if len(words):  # an item without words is nowhere
                by_size.setdefault(len(words), []).append(len(self.ids))
                self.ids.append(item)
                self.counts.append(Counter(shingles(words, shingle).tolist()))
        self.groups: dict[int, list[Group]] = {}  # by shingle length, which short items lower
        self.owners: dict[int, dict[int, set[int]]] = {}  # shingle to the lengths of items that have it
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.uint64]] = {}
        for size, members in sorted(by_size.items()):
            prints = np.array([simhash(_signs(np.array(list(self.counts[m].elements()), np.uint64)).sum(axis=0)[None])[0] for m in members], np.uint64)
            blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
            self.groups.setdefault(min(size, shingle), []).append(Group(size, members, prints, [_CLOSE[:, blocks[:, b]] for b in range(BLOCKS)]))
        for k, groups in self.groups.items():
            owners = self.owners.setdefault(k, {})
            for g, group in enumerate(groups):
                for m in group.items:
                    for s in self.counts[m]:
                        owners.setdefault(s, set()).add(g)
            known = np.array(sorted(owners), np.uint64)
            # A table of leading bits, sixteen places per shingle, turns most others away.
            shift = np.uint64(64 - max(16, (16 * len(known)).bit_length()))
            table = np.zeros(1 << (64 - int(shift)), bool)
            table[known >> shift] = True
            self.known[k] = (known, table, shift)

    def leaks(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item found."""
        words = word_hashes(text)
        best: dict[int, tuple[float, int, int]] = {}
        for k, groups in self.groups.items():
            if len(words) < k:
                continue
            all_ = shingles(words, k)
            known, table, shift = self.known[k]
            hits = np.flatnonzero(table[all_ >> shift])
            if len(hits):
                place = np.minimum(np.searchsorted(known, all_[hits]), len(known) - 1)
                hits = hits[known[place] == all_[hits]]
            # Windows of a length need a shingle of some item of that length.
            by_group: dict[int, list[int]] = {}
            for hit in hits.tolist():
                for g in self.owners[k][int(all_[hit])]:
                    by_group.setdefault(g, []).append(hit)
            for g, at in by_group.items():
                self._windows(all_, np.array(at), k, groups[g], best)
        return [(self.ids[m], *best[m]) for m in sorted(best)]

    def _windows(self, all_: np.ndarray, hits: np.ndarray, k: int, group: Group, best: dict) -> None:
        span = group.size - k + 1  # shingles in a window
        last = len(all_) - span
        if last < 0:
            # A text shorter than the items is one window; it can't share more shingles than it has.
            if len(all_) >= self.similar * span - 1e-9:
                self._judge(all_, np.zeros(1, np.int64), len(all_), group, best, len(all_) + k - 1)
            return
        lows, highs = np.maximum(hits - span + 1, 0), np.minimum(hits, last) + 1
        marks = np.zeros(len(all_) + 2, np.int32)
        np.add.at(marks, lows, 1)
        np.add.at(marks, np.maximum(highs, lows), -1)
        starts = np.flatnonzero(np.cumsum(marks)[: last + 1] > 0)
        for at in range(0, len(starts), 4096):
            self._judge(all_, starts[at : at + 4096], span, group, best, group.size)

    def _judge(self, all_: np.ndarray, starts: np.ndarray, span: int, group: Group, best: dict, n_words: int) -> None:
        if not len(starts):
            return
        low, high = int(starts[0]), int(starts[-1]) + span
        if high - low <= 8 * len(starts) + 64 * span:
            sums = np.zeros((high - low + 1, 64), np.int32)
            np.cumsum(_signs(all_[low:high]), axis=0, out=sums[1:])
            rows = sums[starts - low + span] - sums[starts - low]
        else:  # few windows far apart
            rows = np.stack([_signs(all_[s : s + span]).sum(axis=0) for s in starts.tolist()])
        prints = simhash(rows)
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        near = group.tables[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            near |= group.tables[b][blocks[:, b]]
        w, g = np.nonzero(near)
        close = np.bitwise_count(prints[w] ^ group.prints[g]) <= RADIUS
        for i, j in zip(w[close].tolist(), g[close].tolist(), strict=True):
            member, start = group.items[j], int(starts[i])
            if member in best and best[member][0] == 1.0:
                continue
            value = _weighted(Counter(all_[start : start + span].tolist()), self.counts[member])
            if value >= self.similar and (member not in best or value > best[member][0]):
                best[member] = (value, start, n_words)


def indexes(benchmark: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, per_pass: int = PER_PASS) -> Iterator[Index]:
    """The benchmark in parts of about ``per_pass`` items, so that a part fits every worker."""
    passes = max(1, -(-benchmark.count() // per_pass))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for i in range(passes):
        rows = benchmark.where(part == i).select(F.col("item_id").cast("long"), F.col("text").cast("string")).collect()
        yield Index([(r[0], r[1]) for r in rows], shingle, similar)


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, per_pass: int = PER_PASS) -> DataFrame:
    """A row per document and item found in it: doc_id, item_id, similarity, start_word, n_words.

    Whole texts are read, in a narrow map per pass over the items. Null and empty
    texts hold nothing; an empty benchmark gives no rows. Repeated documents and
    items are reported each. An item with fewer words than a shingle is found
    where its words stand in a row.
    """
    spark, found = docs.sparkSession, None
    names = ["doc_id", "item_id", "similarity", "start_word", "n_words"]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    for index in indexes(benchmark, shingle, similar, per_pass):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            leaks = shared.value.leaks
            for batch in batches:
                rows = [(d, *leak) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in leaks(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        part = part.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, per_pass: int = PER_PASS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item."""
    for index in indexes(benchmark, shingle, similar, per_pass):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            leaks = shared.value.leaks
            for batch in batches:
                yield batch.filter(pa.array([not leaks(text) for text in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
