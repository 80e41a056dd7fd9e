"""Pairs within buckets, without pairing all with all.

Every member of a bucket is compared with the bucket's anchors; those that come
into the group of one leave, in a few rounds of more anchors. Members that came into
one group, here or in any other bucket, need no further comparison with each other.
All others do: in a bucket, those outside its largest group are compared with every
member of another group, linked or not. So no similar pair of a bucket stays
apart, and a large group of copies costs as many pairs as it has members.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.components import components
from pageloom.session import Scratch

ANCHORS = (1, 8)  # of a bucket in each round, before groups are compared


def several(left: DataFrame) -> DataFrame:
    """The members of buckets of two or more."""
    crowded = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return left.join(crowded, "bucket").select(*left.columns)


def _labelled(members: DataFrame, found: DataFrame, run: Scratch) -> DataFrame:
    """bucket, key and label of ``members``: the group that ``found`` puts them into."""
    label = components(found, run).select(F.col("node").alias("key"), F.col("root").alias("label"))
    return members.select("bucket", "key").join(label, "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))


def _apart(left: DataFrame, found: DataFrame, fits: Callable[[Column, Column], Column], run: Scratch) -> DataFrame:
    """Pairs (u, v), u < v, of members of a bucket that ``found`` leaves in different groups.

    One of the two is outside the largest group of the bucket.
    """
    narrow = run.settle(_labelled(left, found, run))
    groups = narrow.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = groups.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    # Infos are wide: only those of mixed buckets are moved.
    narrow = run.settle(narrow.join(mixed, "bucket").select("bucket", "key", "label", "main"))
    named = run.settle(left.join(narrow, ["bucket", "key"]).select("bucket", "key", "info", "label", "main"))
    others = named.where("label <> main").select("bucket", F.col("key").alias("u"), F.col("info").alias("of_u"), F.col("label").alias("group"))
    # Two outside the main group meet once, from the smaller key.
    once = F.col("group") != F.col("label")
    once &= (F.col("label") == F.col("main")) | (F.col("u") < F.col("key"))
    pairs = named.join(others, "bucket").where(once & fits(F.col("of_u"), F.col("info")))
    return pairs.select(F.least("u", "key").alias("u"), F.greatest("u", "key").alias("v")).distinct()


def anchored_links(left: DataFrame, fits: Callable[[Column, Column], Column], verified: Callable[[DataFrame], DataFrame], run: Scratch) -> DataFrame:
    """Verified pairs (u, v) that join all similar members of common buckets into groups.

    ``left`` has bucket, key and info (a struct) of members of buckets of two or
    more. ``fits`` is a cheap test of two infos that no similar pair fails;
    ``verified`` keeps the similar ones of distinct pairs (u, v), u < v.
    """
    whole, found, tested = left, None, None
    left = left.withColumn("label", F.col("key"))
    for anchors in ANCHORS:
        # The same order in all buckets, so that a group's members meet the same few anchors.
        # Every task passes on the first few of its part of a bucket; the join with
        # the anchors can be split where a bucket is large.
        first = Window.partitionBy("bucket").orderBy(F.xxhash64("key"), "key")
        heads = left.withColumn("place", F.row_number().over(first)).where(F.col("place") <= anchors)
        heads = heads.select("bucket", F.col("key").alias("u"), F.col("info").alias("of_u"), F.col("label").alias("group"))
        pairs = left.join(heads, "bucket").where("key <> u AND label <> group").where(fits(F.col("of_u"), F.col("info")))
        new = pairs.select(F.least("u", "key").alias("u"), F.greatest("u", "key").alias("v")).distinct()
        if tested is not None:
            new = new.join(tested, ["u", "v"], "left_anti")
        new = run.settle(new)
        good = run.settle(verified(new))
        found = good if found is None else found.union(good)
        tested = new if tested is None else tested.union(new)
        if anchors == ANCHORS[-1]:
            break
        # What is left of a bucket: what did not come into the group of an anchor, by whatever bucket.
        narrow = run.settle(_labelled(left, found, run))
        done = narrow.join(heads.select("bucket", F.col("u").alias("key")), ["bucket", "key"]).select("bucket", "label")
        narrow = run.settle(narrow.join(done.distinct(), ["bucket", "label"], "left_anti"))
        left = run.settle(left.drop("label").join(several(narrow), ["bucket", "key"]))
        if left.isEmpty():
            break
    new = run.settle(_apart(whole, found, fits, run).join(tested, ["u", "v"], "left_anti"))
    return found if new.isEmpty() else found.union(run.settle(verified(new)))
