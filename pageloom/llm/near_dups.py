"""Near-duplicate documents by edit similarity of their words.

Texts are sketched by Order MinHash. Every pair of neighbouring words is labelled with
its number among its equals; a sketch hashes the labelled pairs with a seed of its own,
takes the two smallest, and is the hash of these two in the order of the text. Texts
of high edit similarity share many pairs in the same order, so most likely one sketch,
and texts that share one meet in a bucket. There each is compared with the bucket's
anchors, and with members of other groups: by the parities of its words inside the
join, so that no pair of unlike texts is written, then by an alignment within a band
of diagonals. Verified pairs are joined into groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.anchors import anchored_links, several
from pageloom.llm.components import components
from pageloom.llm.hashing import mix, shingles, word_hashes
from pageloom.session import Scratch

SIMILAR = 0.8
SALTS = 8
SKETCHES = 20
GRAM = 2  # words that are hashed together
PICKED = 2  # of them in a sketch, in the order of the text
PARITIES = 2048  # bits
BAND = 4096  # words: longer texts are aligned row by row, shorter ones bit by bit
_FLIPS = [f"f{i}" for i in range(PARITIES // 64)]
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))


def sketches(words: np.ndarray) -> np.ndarray:
    """A key for each sketch of a text; none without words."""
    grams = shingles(words, GRAM)
    if not len(grams):
        return grams
    # The number of each gram among its equals, so that repeats count.
    order = np.argsort(grams, kind="stable")
    first = np.r_[True, grams[order][1:] != grams[order][:-1]]
    place = np.arange(len(grams))
    times = np.empty(len(grams), np.uint64)
    times[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    labelled = mix(grams + mix(times))
    if len(grams) <= PICKED:
        at = np.tile(place, (SKETCHES, 1))
    else:
        # A few sketches at a time, as many as a bounded table takes.
        step = max(1, (1 << 16) // len(grams))
        at = [np.argpartition(mix(labelled ^ _SEEDS[i : i + step, None]), PICKED - 1)[:, :PICKED] for i in range(0, SKETCHES, step)]
        at = np.sort(np.concatenate(at), axis=1)
    keys = _SEEDS.copy()
    for k in range(at.shape[1]):
        keys = mix(keys * np.uint64(31) + grams[at[:, k]])
    return keys


def parities(words: np.ndarray) -> np.ndarray:
    """For every place, whether an odd number of words fall on it, 64 places a number: an edit changes two places at most."""
    places = np.bincount((words >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES)
    return np.packbits(places & 1).view(np.int64)


def _by_bits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance with a row of the table in the bits of whole numbers: differences of neighbours, up or down."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left, y in zip(range(len(b) - 1, -1, -1), b.tolist(), strict=True):
        same = where.get(y, 0)
        level = (((same & up) + up) ^ up) | same | down
        rises, falls = down | (full & ~(level | up)), level & up
        score += bool(rises & last) - bool(falls & last)
        if score - left > most:  # each word to come can take one off
            return None
        rises = (rises << 1 | 1) & full
        up, down = (falls << 1 | full & ~(level | rises)) & full, rises & level
    return score if score <= most else None


def _by_rows(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance row by row over the diagonals of the band; memory goes with the band."""
    side = np.arange(2 * most + 1)
    far = np.int64(1) << 40
    row = np.where(side >= most, side - most, far)
    # What lies outside b equals nothing.
    values, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], np.concatenate([np.full(most + 1, -1), codes[len(a) :], np.full(2 * most + 2, -1)])
    for i, x in enumerate(a):
        step = row + (b[i + 1 : i + 2 + 2 * most] != x)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - side) + side
        if row.min() > most:
            return None
    return int(row[len(b) - 3 * most - 3 - len(a) + most])


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    if not len(a):
        return len(b)
    if len(a) <= BAND:
        return _by_bits(a, b, most)
    found = _by_rows(a, b, most)
    return found if found is not None and found <= most else None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether 1 less the edit distance by the longer length is at least ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return True
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    # What both begin or end with needs no edit.
    shorter = min(len(a), len(b))
    differ = np.flatnonzero(a[:shorter] != b[:shorter])
    start = int(differ[0]) if len(differ) else shorter
    a, b = a[start:], b[start:]
    shorter = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:shorter] != b[::-1][:shorter])
    stop = int(differ[0]) if len(differ) else shorter
    a, b = a[: len(a) - stop], b[: len(b) - stop]
    longer = max(len(a), len(b))
    if longer <= most:
        return True
    # Words that the other text lacks must each be edited: a cheap bound first.
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    shared = np.minimum(np.bincount(where[: len(a)], minlength=len(values)), np.bincount(where[len(a) :], minlength=len(values))).sum()
    return longer - shared <= most and distance(a, b, most) is not None


def _key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame) -> DataFrame:
    """Who a row is (``row``: id, nulls last, and a hash of the text), key of its words, their number, sketches, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, marks, flips = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = word_hashes(text)
                keys.append(_key(words))
                sizes.append(len(words))
                marks.append(sketches(words).view(np.int64))
                flips.append(parities(words))
            offsets = np.r_[0, np.cumsum([len(m) for m in marks])].astype(np.int32)
            flat = np.concatenate(marks) if marks else np.zeros(0, np.int64)
            told = np.concatenate(flips).reshape(-1, len(_FLIPS)) if flips else np.zeros((0, len(_FLIPS)), np.int64)
            columns = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            columns += [pa.array(told[:, i].copy()) for i in range(len(_FLIPS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "mark", "key", "n_words", "sketches", *_FLIPS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(run, "doc_id long, mark long, key binary, n_words int, sketches array<long>, " + ", ".join(f"{c} long" for c in _FLIPS))
    who = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark").alias("row")
    return made.select(who, "key", "n_words", "sketches", *_FLIPS)


def _rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` met with ``wanted`` by its column ``row``; ids are spread evenly, so no key is hot."""
    met = F.col("_text.doc_id").cast("long").eqNullSafe(F.col("_want.row.doc_id")) & (F.xxhash64("_text.text") == F.col("_want.row.mark"))
    return docs.alias("_text").join(wanted.alias("_want"), met)


def _with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and words of the wanted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(word_hashes(text) >> np.uint64(32)).astype("<u4").tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["key", "words"])

    met = _rows_of(docs.select("doc_id", F.col("text").cast("string").alias("text")), wanted)
    return met.select("_want.key", "_text.text").mapInArrow(run, "key binary, words binary").dropDuplicates(["key"])


def _met(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs (u, v) with the values a and b of both. An anchor in very many pairs is dealt over salts."""
    anchors = pairs.select(F.col("u").alias("key")).distinct().join(values, "key")
    anchors = anchors.select(F.col("key").alias("u"), F.col("value").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    others = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    met = others.join(values.select(F.col("key").alias("v"), F.col("value").alias("b")), "v").join(anchors, ["u", "salt"])
    return met.drop("salt")


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similar(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), least) for a, b in zip(one, other, strict=True)]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    met = _met(pairs, words.select("key", F.col("words").alias("value")))
    return met.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def links(docs: DataFrame, classes: DataFrame, run: Scratch, least: float = SIMILAR) -> DataFrame:
    """Verified pairs of different texts: columns u and v, keys of ``classes``."""
    members = classes.where("n_words > 0").select(F.explode(F.array_distinct("sketches")).alias("bucket"), "key")
    # Few texts share a bucket, and only these carry their parities into it.
    left = several(members).join(classes.select("key", F.struct("n_words", *_FLIPS).alias("info")), "key")
    left = run.settle(left.select("bucket", "key", "info"))

    def fits(a: Column, b: Column) -> Column:
        longer = F.greatest(a["n_words"], b["n_words"])
        sizes = F.least(a["n_words"], b["n_words"]) >= F.lit(least) * longer - 1e-9
        flipped = reduce(lambda x, y: x + y, [F.bit_count(a[c].bitwiseXOR(b[c])) for c in _FLIPS])
        return sizes & (flipped <= 2 * F.floor(F.lit(1 - least) * longer + F.lit(1e-9)))

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
        words = run.settle(_with_words(docs, classes.join(wanted, "key").select("key", "row")))
        return _verified(pairs, words, least)

    return anchored_links(left, fits, verified, run)


def _grouped(docs: DataFrame, least: float, run: Scratch) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of ``docs``, and per key of a group of several rows: first row and size of the group."""
    rows = run.settle(sketched(docs))
    classes = rows.groupBy("key").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches"), *[F.first(c).alias(c) for c in _FLIPS]
    )
    classes = run.settle(classes)
    held = Scratch(docs.sparkSession)
    roots = components(links(docs, classes, held, least), held)
    named = classes.select("key", "row", "n").join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    groups = named.groupBy("root").agg(F.min("row").alias("first"), F.sum("n").alias("size")).where("size > 1")
    made = run.settle(named.select("key", "root").join(groups, "root").select("key", "first", "size"))
    held.drop()
    return rows.select("row", "key"), made


def _marked(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Every row with the first row and the size of its group; a key with very many copies is dealt over salts."""
    dealt = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["key", "salt"], "left").select("row", F.coalesce("first", "row").alias("first"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))


def near_duplicates(docs: DataFrame, least: float = SIMILAR, run: Scratch | None = None) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row of ``docs``.

    ``class_id`` is the smallest id in the group; the row that has it is kept.
    Texts with the same words are one class from the start and are never paired.
    Null and empty texts, and texts without words, are one such class. Null ids
    are larger than all others. Rows that repeat both id and text are marked alike.
    """
    rows, several = _grouped(docs, least, run or Scratch(docs.sparkSession))
    return _marked(rows, several).select(
        F.col("row.doc_id").alias("doc_id"), F.col("first.doc_id").alias("class_id"), F.col("size").alias("class_size"), (F.col("row") == F.col("first")).alias("kept")
    )


def deduplicated(docs: DataFrame, least: float = SIMILAR, run: Scratch | None = None) -> DataFrame:
    """One row of ``docs`` per group, with all its columns; see ``near_duplicates``."""
    run = run or Scratch(docs.sparkSession)
    rows, several = _grouped(docs, least, run)
    kept = _marked(rows, several).where(F.col("row") == F.col("first")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    kept = run.settle(kept)
    names = [F.col(f"_text.`{c}`").alias(c) for c in docs.columns]
    once = _rows_of(docs, kept.where("n = 1").select("row")).select(*names)
    # Rows that repeat id and text: one of them stays.
    repeated = _rows_of(docs, kept.where("n > 1").select("row")).select(*names)
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
