"""Words of a corpus that differ by one letter, found by walking a trie level by level.

The words that occur often enough are counted, and their trie is a table of edges:
a node is a prefix where words part or end, known by a hash of its letters, and an
edge carries the letters from one such node to the next. Without an edit a word goes
its own way down that trie, which is known; from each node of it, past half of the
word, it may spend its one edit on an edge. From there states (word, position in it,
node) are joined with the one edge that goes on by the next letter, step by step.
States that end together with a word of the trie are its neighbours. The number of
steps is that of nodes on the longest path, not of letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.hashing import POWERS, mix
from pageloom.session import Scratch

LEAST_LETTERS = 6
LEAST_TIMES = 5
RATIO = 5  # a form occurs so many times as often as the word
EVERY = 199  # one run in so many loses a letter
ROOT, BACK = 0, 1  # of the words, and of the words read backwards
END = -1
PIECE = 1 << 16  # prefixes in an Arrow batch
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"


def vocabulary(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word and n of the words that are long and frequent enough.

    One run in ``every``, by the crc32 of its document and letters, is misspelt: it
    loses the letter that the same number names. A null id counts as an empty one.
    """
    # Shorter runs can give no word, so they are not looked at.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(_RUN), 0)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    made = rows.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))
    return made.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def _prefixes(texts: list[str], roots: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every prefix of every text, the empty one first: which text, its length, its node, and the letter after it.

    A node is a hash of the letters and the root; all are computed at once, linear in the letters.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    POWERS.reach(int(sizes.max(initial=0)) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * POWERS.up[np.arange(len(codes)) - np.repeat(starts, sizes)], out=sums[1:])
    row = np.repeat(np.arange(len(texts)), sizes + 1)
    at = np.arange(len(row)) - np.repeat(starts + np.arange(len(texts)), sizes + 1)
    place = starts[row] + at
    nodes = mix(mix(sums[place] - sums[starts[row]] + at.astype(np.uint64)) + roots.astype(np.uint64)[row]).view(np.int64)
    nodes[at == 0] = roots
    letters = np.where(at < sizes[row], np.r_[codes, np.uint32(0)].astype(np.int32)[place], END)
    return row, at.astype(np.int32), nodes, letters.astype(np.int32)


def _places(texts: DataFrame) -> DataFrame:
    """text_node, at, node and letter: every prefix of every text, and the letter that follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at, nodes, letters = _prefixes(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            own = nodes[letters == END][row]
            made = pa.RecordBatch.from_arrays([pa.array(x) for x in (own, at, nodes, letters)], names=["text_node", "at", "node", "letter"])
            for start in range(0, made.num_rows, PIECE):
                yield made.slice(start, PIECE)

    return texts.select("text", "root").mapInArrow(run, "text_node long, at int, node long, letter int")


def _with_nodes(texts: DataFrame) -> DataFrame:
    """text, root and n with ``node``, that of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, nodes, letters = _prefixes(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes[letters == END])], names=["text", "root", "n", "node"])

    return texts.select("text", "root", "n").mapInArrow(run, "text string, root long, n long, node long")


def trie(texts: DataFrame, run: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of the tries below all roots, the texts with their nodes, and the texts with their ``path``.

    An edge has parent, letter (its first), label, child, ``follow`` (the first letters
    of the edges below its child) and ``ends`` (whether its child is a text). A path
    lists the places and nodes a text passes, from the root to its own.
    """
    places = run.settle(_places(texts))
    parting = places.groupBy("node").agg(F.min("letter").alias("low"), F.max("letter").alias("high")).where("low < high").select("node")
    inner = places.where(f"at > 0 AND letter <> {END}").select("text_node", "at", "node").join(parting, "node")
    inner = inner.groupBy("text_node").agg(F.sort_array(F.collect_set(F.struct("at", "node"))).alias("inner"))
    ends = run.settle(_with_nodes(texts))
    stop = lambda at, node: F.struct(at.cast("int").alias("at"), node.cast("long").alias("node"))
    path = F.concat(F.array(stop(F.lit(0), F.col("root"))), F.coalesce("inner", F.array().cast("array<struct<at:int,node:bigint>>")), F.array(stop(F.length("text"), F.col("node"))))
    rows = run.settle(ends.join(inner, ends["node"] == inner["text_node"], "left").select("text", path.alias("path")))
    steps = F.transform(F.slice("path", 2, F.size("path") - 1), lambda to, i: F.struct(
        F.get("path", i)["node"].alias("parent"), F.substr("text", F.get("path", i)["at"] + 1, to["at"] - F.get("path", i)["at"]).alias("label"), to["node"].alias("child")
    ))
    edges = rows.select(F.explode(steps).alias("edge")).select("edge.*").distinct()
    edges = run.settle(edges.select("parent", F.substr("label", F.lit(1), F.lit(1)).alias("letter"), "label", "child"))
    # A node has no more edges than there are letters.
    below = edges.groupBy("parent").agg(F.array_join(F.collect_set("letter"), "").alias("follow")).withColumnRenamed("parent", "child")
    words = ends.select(F.col("node").alias("child"), F.lit(True).alias("ends"))
    edges = edges.join(below, "child", "left").join(words, "child", "left")
    return run.settle(edges.select("parent", "letter", "label", "child", F.coalesce("follow", F.lit("")).alias("follow"), F.coalesce("ends", F.lit(False)).alias("ends"))), ends, rows


def _edited(text: Column, at: Column, label: Column) -> Column:
    """The places a text comes to along an edge with its one edit inside the edge."""
    size = F.length(label)
    moves = []
    # A changed letter, one that the text lacks, one that it has more: by how much of the text is taken.
    for more in (0, -1, 1):
        part = F.substr(text, at + 1, size + more)
        one = (F.length(part) == size + more) & (F.call_function("levenshtein", part, label, F.lit(1)) == 1)
        moves.append(F.when(one, at + size + more))
    return F.filter(F.array(*moves), lambda m: m.isNotNull())


def neighbours(words: DataFrame, run: Scratch) -> DataFrame:
    """word, near and near_n: all pairs of words, both ways, that differ by exactly one letter.

    What two such words share before and after their edit is half of either or more.
    So each word is walked forwards and, in a second trie, backwards, and may spend
    its edit only once half of its letters are behind it, where few edges part.
    """
    both = F.explode(F.array(F.struct(F.col("word").alias("text"), F.lit(ROOT).cast("long").alias("root")), F.struct(F.reverse("word").alias("text"), F.lit(BACK).cast("long").alias("root")))).alias("x")
    edges, ends, paths = trie(words.select("n", both).select("x.text", "x.root", "n"), run)
    # Without an edit a text goes its own way, which is known: it begins at the last node
    # on its first half, and may leave its way at that node and at each one after it.
    half = F.floor(F.length("text") / 2)
    stops = F.slice("path", F.size(F.filter("path", lambda p: p["at"] <= half)), F.size("path"))
    spent = paths.select("text", half.alias("half"), F.explode(stops).alias("stop")).select("text", "half", "stop.at", F.col("stop.node").alias("parent"))
    free = F.col("at") >= F.col("half")
    # Before its half, and after its edit, a text follows the one edge that begins with its next letter.
    bound = spent.where(~free).withColumn("letter", F.substr("text", F.col("at") + 1, F.lit(1))).join(edges, ["parent", "letter"])
    open_ = spent.where(free).join(edges.drop("letter"), "parent")
    edited = _edited(F.col("text"), F.col("at"), F.col("label"))
    moved = bound.select("text", "child", "follow", "ends", edited.alias("to")).union(open_.select("text", "child", "follow", "ends", edited.alias("to")))
    moved = moved.select("text", "child", "follow", "ends", F.explode("to").alias("at"))
    # A letter that the text has more, at its end: the word of the node before is one letter shorter.
    last = spent.where(free & (F.col("at") == F.length("text") - 1)).select("text", F.col("parent").alias("node")).join(ends.select("node"), "node", "left_semi")
    found = last.select("text", "node")
    while True:
        # With its edit spent, a text must end here, or go on by its next letter.
        over = F.col("at") == F.length("text")
        goes_on = F.when(over, F.col("ends")).otherwise(F.instr("follow", F.substr("text", F.col("at") + 1, F.lit(1))) > 0)
        states = run.settle(moved.where(goes_on).select("text", "at", F.col("child").alias("node")))
        if states.isEmpty():
            break
        found = found.union(states.where(over).select("text", "node"))
        rows = states.where(~over).withColumnRenamed("node", "parent").withColumn("letter", F.substr("text", F.col("at") + 1, F.lit(1)))
        met = rows.join(edges, ["parent", "letter"]).where(F.substr("text", F.col("at") + 1, F.length("label")) == F.col("label"))
        moved = met.select("text", "child", "follow", "ends", (F.col("at") + F.length("label")).alias("at"))
    of_node = ends.select("node", F.col("text").alias("other"), "root", F.col("n").alias("near_n"))
    # Hashes only lead here; the letters themselves decide.
    pairs = found.join(of_node, "node").where(F.call_function("levenshtein", F.col("text"), F.col("other"), F.lit(1)) == 1)
    forward = lambda c: F.when(F.col("root") == ROOT, F.col(c)).otherwise(F.reverse(c))
    return run.settle(pairs.select(forward("text").alias("word"), forward("other").alias("near"), "near_n").distinct())


def roots(forms: DataFrame, run: Scratch) -> DataFrame:
    """word and root of every word that has a form: the word at the end of its forms.

    A form occurs ``RATIO`` times as often as its word, so there are no circles; every
    round doubles the steps that were followed.
    """
    ends = run.settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = run.settle(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ends = met.select("word", "root")
        if met.where("moved").isEmpty():
            return ends


def variants(docs: DataFrame, every: int = EVERY, run: Scratch | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word of the corpus.

    ``form`` is the near word of largest n, at a tie the first in code-point order, if
    it occurs ``RATIO`` times as often as the word; ``root`` is where forms lead, the
    word itself if it has none. Null and empty texts have no words, nor do tables
    without rows; rows that repeat id and text count again. Runs of any length are
    words: a word costs as much as it has letters, and a step of the walk for each
    place on it where words part.
    """
    run = run or Scratch(docs.sparkSession)
    words = run.settle(vocabulary(docs, every))
    near = neighbours(words, run)
    told = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    rows = words.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best")).alias("best"))
    rows = run.settle(rows.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL"), run)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
