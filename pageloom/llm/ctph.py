"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes ends a chunk wherever it hits a value that the
block size makes rare, so chunk borders depend on the text around them and not
on its position. Each chunk gives one letter; a fingerprint is the block size
and the letters at that size and at twice that size. Two fingerprints are
compared where their block sizes meet, by the edit distance of their letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.hashing import POWERS
from pageloom.session import settle

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH = 64  # letters at one block size; the last one stands for all that is left
WINDOW = 7
SHARED = 4  # letters in a row that two signatures must share to be alike at all
_ROLL = np.uint32(0x01000193)
_TABLE = np.frombuffer(LETTERS.encode(), np.uint8)


def _letters(sums: np.ndarray, cuts: np.ndarray) -> str:
    """A letter per chunk; ``cuts`` are the places after each chunk's last byte."""
    if len(cuts) > LENGTH:
        cuts = np.r_[cuts[: LENGTH - 1], cuts[-1:]]
    starts = np.r_[0, cuts[:-1]]
    h = (sums[cuts] - sums[starts]) * POWERS.down[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _TABLE[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(raw: bytes) -> str:
    """``size:letters:letters``; of the bytes alone, so equal texts have equal ones."""
    n = len(raw)
    if not n:
        return "1::"
    x = np.frombuffer(raw, np.uint8)
    POWERS.reach(n + 1)
    with np.errstate(over="ignore"):
        roll = np.zeros(n, np.uint32)
        wide = x.astype(np.uint32) + np.uint32(1)
        factor = np.uint32(1)
        for back in range(min(WINDOW, n)):
            roll[back:] += wide[: n - back] * factor
            factor = np.uint32(int(factor) * int(_ROLL) & 0xFFFFFFFF)
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x85EBCA6B)
        roll ^= roll >> np.uint32(13)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * POWERS.up[:n], out=sums[1:])
        size = 1
        while size * LENGTH < n:
            size *= 2

        def cut(block: int, among: np.ndarray | None) -> np.ndarray:
            mask = np.uint32(block - 1)
            if among is None:
                return np.flatnonzero(roll & mask == mask)
            return among[roll[among] & mask == mask]

        at = cut(size, None)
        while size > 1 and len(at) + 1 < LENGTH // 2:
            size //= 2
            at = cut(size, None)

        def signature(places: np.ndarray) -> str:
            ends = places + 1
            return _letters(sums, ends if len(ends) and ends[-1] == n else np.r_[ends, n])

        return f"{size}:{signature(at)}:{signature(cut(2 * size, at))}"


def _short_runs(s: str) -> str:
    """No letter more than three times in a row: long runs say little."""
    out = []
    for c in s:
        if len(out) < 3 or not (out[-1] == out[-2] == out[-3] == c):
            out.append(c)
    return "".join(out)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a whole row of the table per step."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def alike(a: str, b: str) -> float:
    """1 less the edit distance of two signatures, insertions and deletions only, by their length."""
    a, b = _short_runs(a), _short_runs(b)
    if not a or not b:
        return float(a == b)
    k = min(SHARED, len(a), len(b))
    grams = {a[i : i + k] for i in range(len(a) - k + 1)}
    if not any(b[i : i + k] in grams for i in range(len(b) - k + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where block sizes do not meet."""
    if one == other:
        return 1.0
    (p, a, aa), (q, b, bb) = one.split(":"), other.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(alike(a, b), alike(aa, bb))
    if p == 2 * q:
        return alike(a, bb)
    if q == 2 * p:
        return alike(aa, b)
    return 0.0


_OUT = pa.schema(
    [
        ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
    ]
)
_DDL = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_WHOLE, _FIRST, _LAST = 0, 1, 2


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _compared(doc_id: int | None, text: str, mark: str, after: str, after_mark: str) -> tuple:
    half = len(text) // 2
    raw = _raw(text[: len(text) - half] + after[:half])
    edited = fingerprint(raw)
    return (_WHOLE, None, doc_id, len(text), hashlib.sha256(raw).hexdigest(), mark, edited, likeness(mark, edited), likeness(mark, after_mark), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and how like they and the next text are.

    The edited text has its last half replaced by the start of the next document
    in order of ``doc_id``; the last document is followed by the first. Texts move
    once, in one range exchange. What a partition cannot know, the text after its
    last row, it leaves to a second step over one row per partition.

    A null text is empty. Null ids come first, equal ids in order of a hash of
    the text. A table of one row is its own next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                mark = fingerprint(_raw(text))
                if held is None:
                    rows.append((_FIRST, part, doc_id, len(text), None, mark, None, None, None, text))
                else:
                    rows.append(_compared(*held, text, mark))
                held = (doc_id, text, mark)
            if rows:
                yield _batch(rows)
        if held is not None:
            yield _batch([(_LAST, part, held[0], len(held[1]), None, held[2], None, None, None, held[1])])

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)
    done = settle(ordered.mapInArrow(run, _DDL))

    # From here on one row per partition, texts of those rows included.
    first = done.where(F.col("kind") == _FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("after"), F.col("fingerprint").alias("after_mark"))
    parts = done.where(F.col("kind") == _FIRST).select("part")
    order = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(order), F.first("part").over(order))
    last = done.where(F.col("kind") == _LAST).join(parts.select("part", after.alias("next_part")), "part").join(first, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compared(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _batch(rows)

    ends = last.select("doc_id", "text", "fingerprint", "after", "after_mark").mapInArrow(finish, _DDL)
    return done.where(F.col("kind") == _WHOLE).unionByName(ends).drop("kind", "part", "text")
