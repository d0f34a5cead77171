"""Distributed union-find, and links inside groups without all their pairs.

Only DataFrame operations: nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, label) for every id in ``links(a, b)``: the smallest id reachable.

    Alternating large-star and small-star steps: each node is pointed at the
    smallest of its neighbours until only stars are left, in a number of
    rounds that grows with the logarithm of the component.  The edges of a
    round are checkpointed.  A hub's edges are spread by the skew join.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = settle(links.where("a != b").select(high.alias("a"), low.alias("b")).distinct())
    before = _signature(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: neighbours above u point at the smallest neighbour of u (or u)
        both = edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(smallest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below u, and u itself, point at the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        edges = settle(small.where("a != b").distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionAll(roots.select("id", F.col("id").alias("label")))


#: Groups of at least so many ids get pivots, and how many in a round.
HOT, PIVOTS = 16, 4


def _meet(posts: DataFrame, matches: bool) -> DataFrame:
    """(a, b, need) at each key where members of two components meet.

    Components are paired at a key first, then the smaller one's members are
    brought in, then the other's, so two members of one component are never
    brought together.  With ``matches`` a member x that meets a component at
    K keys and needs l of them is left out if K < l.  Else the j = l // 2 keys
    at which most of the component's members stand are passed over, and a pair
    needs j keys less: whoever shares l of K keys shares l - j of any K - j.
    """
    counts = posts.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    met = posts.groupBy("key", "label").agg(F.min("size").alias("s"), F.max("most").alias("m"), F.min("need").alias("q"), F.count(F.lit(1)).alias("n")).join(counts, "label")
    met = met.select("key", "label", "s", "m", "q", "n", "c")
    met = met.toDF("key", "l1", "s1", "m1", "q1", "n1", "c1").join(met.toDF("key", "l2", "s2", "m2", "q2", "n2", "c2"), "key")
    # which of two is the smaller doesn't depend on the key
    smaller = (F.col("c1") < F.col("c2")) | (F.col("c1") == F.col("c2")) & (F.col("l1") < F.col("l2"))
    met = met.where(smaller & F.expr("s1 <= m2 AND s2 <= m1")).select("key", F.col("l1").alias("la"), F.col("l2").alias("lb"), "s2", "m2", "q2", "n2")
    sides = posts.select("key", "label", "id", "need", "size", "most")
    one, two = sides.toDF("key", "la", "x", "nx", "sx", "mx"), sides.toDF("key", "lb", "y", "ny", "sy", "my")
    one = met.join(one, ["key", "la"]).where("sx <= m2 AND s2 <= mx")
    if matches:
        own = Window.partitionBy("x", "lb")
        one = one.select("key", "lb", "x", "nx", "sx", "mx", F.count(F.lit(1)).over(own).alias("k"), F.min(F.least("nx", "q2")).over(own).alias("l"), F.row_number().over(own.orderBy("n2", "key")).alias("place"))
        one = one.withColumn("j", F.expr("l div 2").cast("int")).where("k >= l AND place <= k - j")
    else:
        one = one.withColumn("j", F.lit(0))
    fit = (one["key"] == two["key"]) & (one["lb"] == two["lb"]) & (F.col("sx") <= F.col("my")) & (F.col("sy") <= F.col("mx"))
    return one.join(two, fit).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.least("nx", "ny") - F.col("j")).alias("need"))


def _try_pivots(
    posts: DataFrame, verify: Callable[[DataFrame], DataFrame], links: DataFrame | None, labels: DataFrame | None, turns: int, lots: Column
) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(open, links, labels): the posts at keys where components still meet (None: nowhere), with their label and their key's ``members``.

    Each of a key's ``lots`` has a pivot.
    """
    before = None
    for turn in range(turns):
        if labels is None:
            named = posts.withColumn("label", F.col("id"))
        else:
            named = posts.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        # an id that is bound to partners smaller than all of its group meets nobody there
        least = named.groupBy("key").agg(F.min("size").alias("least"))
        named = settle(named.join(least, "key").where("most >= least").drop("least"))
        sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
        sizes = sizes.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        mixed = settle(sizes.where("labels > 1"))
        rows, across, largest = mixed.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.max("n")).first()
        if not rows:
            return None, links, labels
        open_posts = settle(named.join(mixed.select("key", F.col("n").alias("members")), "key"))
        if across <= rows or largest < HOT or turn == turns - 1 or before is not None and 3 * across > 2 * before:
            break  # few pairs are left, or pivots no longer help
        before = across
        order = F.struct("rank", "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)).alias("rank"), "id")
        hot = open_posts.where(F.col("members") >= HOT)
        pivots = hot.groupBy("key", lots.alias("lot")).agg(F.min(F.struct(order.alias("o"), "label", "size", "most")).alias("p"))
        pivots = pivots.select("key", F.col("p.o.id").alias("pivot"), F.col("p.label").alias("pl"), F.col("p.size").alias("ps"), F.col("p.most").alias("pm"))
        tried = hot.join(pivots, "key").where("label != pl AND size <= pm AND ps <= most")
        pairs = tried.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        found = settle(verify(pairs))
        if not found.take(1):
            break
        links = found if links is None else links.unionAll(found)
        labels = settle(components(links))
    return open_posts, links, labels


def link_groups(
    posts: DataFrame, verify: Callable[[DataFrame], DataFrame], matches: bool = False, refine: Callable[[DataFrame], DataFrame] | None = None, turns: int = 12
) -> DataFrame:
    """(id, label): components of the verified links between ids that share a key.

    ``posts(key, id, rank, need, size, most)`` holds distinct (key, id).  Two
    ids meet at a key if neither's ``size`` exceeds the other's ``most`` there.
    ``verify`` turns candidate pairs (a, b) into those that are links.  With
    ``matches``, a pair is a candidate if it meets at as many keys as the
    smaller ``need`` of the two.

    A large group is not expanded into its pairs.  First each of its members is
    tried against a few pivots (those of lowest rank), which join a group of
    copies at once.  Members that are then in one component need no further
    pair.  While more pairs across components are left than rows, and pivots
    take a third of them or more, further pivots are tried; at the end every
    pair across components is tried, so no link between components is missed.
    ``refine`` (not with ``matches``) may then replace the posts of the ids in
    large groups by posts at finer keys, of which any two linked ids share one.
    These get pivots as well, one for each eleventh of difference in size: a
    member that shares no key with its group's pivot would else be compared
    with all of the group's component.
    """
    open_posts, links, labels = _try_pivots(posts, verify, None, None, turns, F.pmod(F.xxhash64("id"), F.lit(PIVOTS)))
    if refine is not None and open_posts is not None:
        large = open_posts.where(F.col("members") >= HOT).select("id").distinct()
        if large.take(1):
            small = open_posts.where(F.col("members") < HOT).select("key", "id", "rank", "need", "size", "most")
            # at a fine key, parts of lines meet whole ones, and would be pivots that few can link with
            open_posts, links, labels = _try_pivots(small.unionByName(refine(large)), verify, links, labels, turns, F.floor(8 * F.log2("size")))
    if open_posts is None:
        return labels if labels is not None else posts.select("id", F.col("id").alias("label")).limit(0)
    pairs = _meet(open_posts, matches)
    if matches:
        pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    else:
        pairs = pairs.select("a", "b").distinct()
    found = verify(pairs)
    return components(found if links is None else links.unionAll(found))
