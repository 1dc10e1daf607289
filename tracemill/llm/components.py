"""Classes of linked rows from shared buckets, without listing the pairs of a bucket. DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept, together, written


#: So many bucket numbers (one long each, 16 MB) are broadcast at most; beyond, the join shuffles.
BROADCAST_BUCKETS = 2_000_000
#: Where buckets are many, they are gone through in so many passes, so that the rows that one shuffles are gone before the next one's are made.
PASSES = 4
#: Buckets of more rows are parted by the classes of their rows' sizes too.
LARGE = 32
#: So many rows of a bucket are compared with the others in one task, about.
PART = 1024


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (long columns a, b).

    Alternates large-star and small-star steps until only stars are left: about log(diameter) rounds, each a
    minimum per node and a join. A hub's edges are never gathered in one row."""

    def stars(df: DataFrame) -> bool:
        """Whether every edge leads from a node with no other edge to a root."""
        ends = df.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root"))
        ends = ends.union(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root")).filter("child + root > 1").isEmpty()

    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not e.isEmpty() and not stars(e):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        nxt = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        dropped(e)
        e = nxt
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = out.union(out.select("root", "root").distinct())
    out._tm_path = e._tm_path  # so that dropped() finds the edges
    return out


def size_class(size: Column, ratio: float) -> Column:
    """A number that differs by one at most between positive sizes of which the lesser is at least `ratio` of the greater."""
    return F.floor(F.log(size) / (-math.log(ratio) * 1.000001)).cast("int")


def of_pass(rows: DataFrame, i: int, passes: int) -> DataFrame:
    """The rows whose bucket is in the i-th of so many passes."""
    return rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("bucket", F.lit(11)), F.lit(passes)) == i)


def in_company(members: DataFrame, passes: int = 1) -> DataFrame:
    """The distinct rows (bucket, node) of members whose bucket has two nodes at least, as written tables."""
    met = []
    for i in range(passes):
        some = of_pass(members, i, passes)
        several = written(some.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("bucket"), "several")
        few = several.count() <= BROADCAST_BUCKETS
        met.append(written(some.join(F.broadcast(several) if few else several, "bucket", "left_semi").distinct(), "met"))
        dropped(several)
    return together(met)


def bucket_classes(members: DataFrame, *tests: Callable | None) -> DataFrame:
    """classes() of the members in buckets of two nodes at least. members: long columns bucket, node; a node may be in many buckets, and rows may be repeated."""
    return classes(in_company(members), *tests)


def classes(
    met: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    facts: Callable[[DataFrame], DataFrame] | None = None,
    possible: Callable[[str, str], Column] | None = None,
    settled: Callable[[str, str], Column] | None = None,
    passes: int = 1,
) -> DataFrame:
    """node and root of the components of all verified pairs that share a bucket; nodes without a link are left out.

    met: what in_company() gives; it is removed. verify takes distinct pairs (a, b) and returns those that hold.

    First every bucket is a star: its member with the most company is compared with the others. Then, only in
    buckets whose members are still in several components, the rows outside the leader's component are
    compared with the rows of all other components. Pairs inside one component need no test, so a bucket of
    thousands of alike rows costs thousands of tests and not millions, and no link between components is lost.

    facts gives for the nodes of the second step a struct column `fact` and an int `size`; possible("x", "y") says of two such
    structs whether their nodes can be a link at all, and the sizes of a link differ by one at most. Both must hold for every
    link; they spare the second step pairs, the sizes as a key of the join, so that they are not even listed. settled is a dearer test
    of the same kind, made once a pair inside the join. The second step compares the buckets in so many passes.

    The result of verify may be a table made by written(); it is removed when it is no longer needed."""
    if met.isEmpty():
        return met.select("node", F.col("node").alias("root"))
    shared = written(met.join(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket"), "shared")
    dropped(met)
    company = shared.groupBy("node").agg(F.sum("n").alias("w"))
    # One row a bucket in one pass; the part under 1 parts nodes of equal company alike in all buckets.
    rank = F.col("w") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(1 << 20)
    lead = shared.select("bucket", "node").join(company, "node").groupBy("bucket").agg(F.max_by("node", rank).alias("lead"))
    crowd = written(shared.join(lead, "bucket").select("bucket", "node", "n", "lead"), "crowd")
    dropped(shared)
    star = crowd.filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    links = kept(verify(star), "links")
    stars = connected(links)
    roots = written(stars, "roots")
    dropped(stars)
    big = crowd.filter("n > 2")
    own = big.join(roots, big.node == roots.node, "left").select("bucket", big.node, "n", "lead", F.coalesce("root", big.node).alias("cls"))
    of_lead = roots.select(F.col("node").alias("lead"), F.col("root").alias("lroot"))
    own = own.join(of_lead, "lead", "left").select("bucket", "node", "n", "lead", "cls", F.coalesce("lroot", "lead").alias("lcls"))
    mixed = own.filter("cls <> lcls").groupBy("bucket").agg(F.count(F.lit(1)).alias("u"))
    left = written(own.join(mixed, "bucket").filter("node <> lead").select("bucket", "node", "n", "cls", "lcls"), "mixed")
    dropped(crowd)
    if left.isEmpty():
        dropped(left, links)
        return roots
    own = left.groupBy("node").agg(F.collect_list("bucket").alias("own"))  # as many as a node has buckets
    can, fact = F.lit(True), [F.lit(0).alias("near")]
    rows = left.join(own, "node")
    if facts is None:
        rows = rows.withColumn("fact", F.lit(None).cast("int")).withColumn("size", F.lit(0))
    else:
        rows = rows.join(facts(left.select("node").distinct()), "node")
        near = F.when(F.col("n") > LARGE, F.array(*[F.col("size") + i for i in (-1, 0, 1)])).otherwise(F.array(F.lit(0)))
        can, fact = possible("x", "y"), [F.col("fact").alias("x"), F.explode(near).alias("near")]
    rows = written(rows, "mixed-facts")
    parts = F.ceil(F.col("n") / PART)  # the left side of a bucket's join is dealt over so many tasks

    def crossed(rows: DataFrame) -> DataFrame:
        odd = rows.filter("cls <> lcls").select("bucket", F.col("node").alias("xn"), F.col("cls").alias("xc"), F.col("lcls").alias("xl"), F.col("own").alias("xown"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("xpart"), *fact)
        rest = rows.withColumnRenamed("fact", "y").withColumn("size", F.when(F.col("n") > LARGE, F.col("size")).otherwise(F.lit(0)))
        rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).drop("n")
        differ = (F.col("cls") != F.col("xc")) & ((F.col("cls") == F.col("xl")) | (F.col("node") < F.col("xn")))
        once = F.array_min(F.array_intersect("own", "xown")) == odd.bucket  # a pair counts in the first bucket it shares
        met = (odd.bucket == rest.bucket) & (F.col("near") == F.col("size")) & (F.col("xpart") == F.col("part")) & differ & can & once
        if settled is not None:
            met = met & settled("x", "y")
        return odd.join(rest, met).select(F.least("node", "xn").alias("a"), F.greatest("node", "xn").alias("b")).distinct()

    cross = crossed(rows) if passes == 1 else together([written(crossed(of_pass(rows, i, passes)), "cross") for i in range(passes)])
    more = kept(verify(cross), "links")
    out = roots
    if not more.isEmpty():
        joined = connected(links.union(more))
        out = written(joined, "roots")
        dropped(joined, roots)
    dropped(left, rows, links, more, cross)
    return out
