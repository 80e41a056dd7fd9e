"""Quality rules: how much a text is like a trusted part of the corpus. DataFrame functions only.

The words and neighbouring pairs of words of all texts are counted by hash in
``SLOTS`` places, once over the whole corpus and once over its trusted documents.
With both as multinomials, a text's score is the mean log-likelihood ratio of its
own words and pairs: about 0 for texts like the corpus, above it for those like the
trusted part, far below for what the trusted part never says. Every document is
kept or dropped by the same threshold; nothing is drawn at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.base import let

SLOTS = 1 << 16
PRIOR = 5.0  # added to both counts of a place
CUT = -0.15  # scores from here on are kept
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
WINDOW = 8  # words
BROADCAST = 200_000  # ids that may be sent to every executor; more are joined by a shuffle
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    """The words of a text, between spaces of ASCII; none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != "")


def hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def slots(found: Column) -> Column:
    """A place for each word, then one for each pair of neighbours. ``found`` has the hashes of the words."""

    def place(value: Column) -> Column:
        return F.pmod(value, F.lit(SLOTS)).cast("int")

    pairs = F.transform(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda h, i: place(F.xxhash64(F.get(found, i), h)))
    return F.concat(F.transform(found, place), pairs)


def repeated_words(found: Column) -> Column:
    """Of the words with hashes ``found``, those that stand in a window of ``WINDOW`` words found twice or more in the text, compared by 64-bit hash.

    Windows are sorted with their places, so that long repetitive texts cost n log n.
    """
    starts = F.sequence(F.lit(0), F.size(found) - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(found, i + 1, WINDOW)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    def of_sorted(s: Column) -> Column:
        again = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"])), covered)

    def of_windows(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.sort_array(placed), of_sorted)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(found) > WINDOW, let(windows, of_windows)).otherwise(F.lit(0).cast("long"))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of documents that are labelled good, each once."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with ``weights``: for each place, the log ratio of its shares in trusted texts and in all.

    The corpus is scaled to the trusted total, and both get ``PRIOR`` added, so that
    places which neither knows weigh nothing and rare ones little.
    """
    mine = trusted.withColumn("trusted", F.lit(1))
    if trusted.limit(BROADCAST + 1).count() <= BROADCAST:
        mine = F.broadcast(mine)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashes(words(F.col("text"))).alias("found")).join(mine, "doc_id", "left")
    places = rows.select("trusted", F.explode(let(F.col("found"), slots)).alias("slot"))
    counts = places.groupBy("slot").agg(F.count("trusted").alias("t"), F.count(F.lit(1)).alias("r"))
    # SLOTS rows, whatever the size of the corpus.
    every = docs.sparkSession.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("slot"))
    filled = every.join(counts, "slot", "left").select("slot", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    made = filled.agg(F.sort_array(F.collect_list(F.struct("slot", "t", "r"))).alias("all"), F.sum("t").alias("ts"), F.sum("r").alias("rs"))
    share = F.when(F.col("rs") > 0, F.col("ts") / F.col("rs")).otherwise(F.lit(0.0))
    return made.select(let(share, lambda s: F.transform("all", lambda x: F.log((x["t"] + PRIOR) / (x["r"] * s + PRIOR)))).alias("weights"))


def judged(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, counts, base_failed, score and kept of every row of ``docs``.

    A text is kept if it passes the base rules (``LEAST_WORDS`` words or more, no more
    than ``MOST_REPEATED`` per cent of them in repeated windows) and its score is
    ``cut`` or more. Trusted are all documents that ``labels`` marks with quality 1;
    without any, all scores are near 0. A null or empty text has no words, score 0,
    and fails. Rows that repeat an id are counted and judged one by one; a null id is
    never trusted. A text is one row, and takes memory as its words do.
    """
    weights = ratios(docs, trusted_ids(labels)).scalar()
    text = F.col("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, words(text).alias("found"), weights.alias("weights"))

    def score(places: Column) -> Column:
        total = F.aggregate(places, F.lit(0.0), lambda a, slot: a + F.get("weights", slot))
        return F.when(F.size(places) > 0, total / F.size(places)).otherwise(F.lit(0.0))

    def of_hashes(h: Column, chars: Column) -> Column:
        return F.struct(F.size(h).cast("long").alias("n_words"), chars.alias("word_chars"), repeated_words(h).alias("n_repeat_words"), let(slots(h), score).alias("score"))

    told = let(F.col("found"), lambda w: let(hashes(w), lambda h: of_hashes(h, F.length(F.array_join(w, "")).cast("long"))))
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_SYMBOLS)).cast("long")
    rows = found.select("doc_id", told.alias("told"), symbols.alias("n_symbols"), repeated_lines(text).alias("n_dup_lines"))
    failed = (F.col("told.n_words") < LEAST_WORDS) | (100 * F.col("told.n_repeat_words") > MOST_REPEATED * F.col("told.n_words"))
    return rows.select(
        "doc_id", "told.n_words", "told.word_chars", "n_symbols", "n_dup_lines", "told.n_repeat_words",
        failed.alias("base_failed"), "told.score", (~failed & (F.col("told.score") >= cut)).alias("kept"),
    )
