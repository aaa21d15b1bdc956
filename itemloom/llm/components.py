"""Connected components of a link table, and of groups of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.set_match import Stars
from itemloom.llm.shared import discard, settle

#: Rounds in which a group's nodes are compared with one of them.
ROUNDS = 2
#: Up to so many nodes of a group are compared pair by pair.
SMALL = 16


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the links (a, b) reach.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest node beside it, until nothing changes; rounds grow with the
    logarithm of the links. Minima are aggregated before they are joined, so a
    node with very many links is spread like any other row. Nodes without links
    aren't in the result.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        count = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("mark")).first()
        if not count.n or (count.n, count.mark) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        seen = count.n, count.mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        last, edges = edges, settle(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), "links")
        discard(last)


def connect(groups: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[Column, Column], Column], stars_of: Callable[[DataFrame], Stars] | None = None, links: DataFrame | None = None) -> DataFrame:
    """(node, component) of the links among nodes that share a group, and of
    ``links`` (a, b) that are known before.

    ``groups`` has (sign, node, n: the node's size); ``verify`` keeps those pairs
    (a, b) that are linked; ``fits`` says whether two sizes allow it. Only pairs
    of a group's first node with the others are verified, and only while they
    lie in different components: a group of copies costs as many comparisons as
    it has members. After ``ROUNDS`` first nodes, pairs of a group whose
    components still differ are verified one by one if the group is small (or
    there is no ``stars_of``). In a larger one all nodes are compared through a
    reference, the node in the most such groups (``Stars``). So no link that
    connects is lost.
    """
    given = links is not None and not links.isEmpty()
    if not given:
        links = None
    named = groups.select("node", F.col("node").alias("component")).limit(0)

    def learn(pairs: DataFrame) -> None:
        nonlocal links, named
        fresh = settle(verify(pairs), "verified")
        links = fresh if links is None else links.unionByName(fresh)
        last, named = named, settle(components(links), "components")
        discard(last)

    if given:
        named = settle(components(links), "components")

    def open_groups() -> DataFrame:
        """Groups with nodes of several components."""
        if links is None:
            placed = groups.withColumn("component", F.col("node"))
        else:
            placed = groups.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = placed.groupBy("sign").agg(F.min(F.struct("node", "n", "component")).alias("first"), F.min("component").alias("low"), F.max("component").alias("top"), F.count("*").alias("members")).where("low < top")
        first = first.select("sign", "members", F.col("first.node").alias("a"), F.col("first.n").alias("a_n"), F.col("first.component").alias("a_component"))
        return placed.join(first, "sign")

    for step in range(ROUNDS):
        placed = open_groups()
        pairs = settle(placed.where("a <> node AND a_component <> component").where(fits(F.col("a_n"), F.col("n"))).select("a", F.col("node").alias("b")).distinct(), "pairs")
        # A first node has now met all others of its group.
        rest = settle(placed.where("node <> a").select("sign", "node", "n"), "groups")
        if step:
            discard(groups)
        groups = rest
        if not pairs.isEmpty():
            learn(pairs)
        discard(pairs)

    left = settle(open_groups().select("sign", "node", "n", "component", "members"), "groups")
    small = left if stars_of is None else left.where(F.col("members") <= SMALL)
    other = small.select("sign", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_component"))
    mine = small.select(F.col("sign").alias("own_sign"), "node", "n", "component")
    met = other.join(mine, (F.col("sign") == F.col("own_sign")) & (F.col("a") < F.col("node")) & (F.col("a_component") != F.col("component")) & fits(F.col("a_n"), F.col("n")))
    pairs, stars = met.select("a", F.col("node").alias("b")), None
    large = None if stars_of is None else left.where(F.col("members") > SMALL)
    if large is not None and not large.isEmpty():
        # A node in many of these groups has few differences of its own. Each node prefers
        # the one that is in most of them, and a group takes what a member prefers most:
        # so groups of the same nodes have one star, and few nodes are in several.
        common = large.groupBy("node").agg(F.count("*").alias("groups"))
        first = large.join(common, "node").groupBy("sign").agg(F.max(F.struct("groups", "node")).alias("most"))
        liked = large.join(first, "sign").groupBy("node").agg(F.max("most").alias("liked"))
        chosen = large.join(liked, "node").groupBy("sign").agg(F.max("liked").alias("most")).select("sign", F.col("most.node").alias("reference"))
        stars = settle(large.join(chosen, "sign").select("reference", "node", "n").distinct(), "stars")
    pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if not pairs.isEmpty():
        learn(pairs)
    discard(pairs, left)
    if stars is not None:
        compared = stars_of(stars)
        for found in (compared.leads, lambda: compared.others(named)):
            pairs = settle(found().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
            if not pairs.isEmpty():
                learn(pairs)
            discard(pairs)
        discard(stars, compared.rows, compared.items)
    return named
