"""Walks and strong components of graphs of any size and depth, as joins.

A node with one entering edge is reached through that edge only. Such nodes form trees below the other nodes, and trees
are climbed by doubling: after k rounds a node knows its ancestor 2**k steps up. So a chain, however long, costs the
logarithm of its length, and only nodes with several entries are left for rounds of the usual kind. Every round writes
its table to the shared folder: lineage stays short and a lost executor costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codequarry.session import cut


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _met(rows: DataFrame, others: DataFrame, end: str, scope: list[str], how: str = "inner") -> DataFrame:
    """Join by (scope, end). A hash leads the sort: a scope is the same for many rows, so sorting by it compares whole names."""
    key = F.xxhash64(*scope, end)
    return rows.withColumn("__hash", key).join(others.withColumn("__hash", key), ["__hash", *scope, end], how).drop("__hash")


@dataclass
class Climb:
    """``tops``: scope, node, root (its first ancestor outside the trees), steps. ``levels[k]``: scope, node, up: the ancestor
    2**k steps up, where that is a tree node too. ``rings``: scope, node, low: tree nodes that close a ring, and the ring's
    smallest node."""

    tops: DataFrame
    levels: list[DataFrame]
    rings: DataFrame


def climbed(parents: DataFrame, scope: list[str]) -> Climb:
    """Climb the trees given by (scope, node, up), one row per node."""
    inside = parents.select(*scope, F.col("node").alias("up"), F.lit(True).alias("inside"))
    now = cut(
        parents.join(inside, [*scope, "up"], "left").select(
            *scope, "node", F.col("up").alias("root"), F.lit(1).alias("steps"), F.least("node", "up").alias("low"), F.coalesce("inside", F.lit(False)).alias("open"),
        )
    )
    tops, levels = [], []
    still, reach = now.where("open"), 1
    tops.append(now.where("not open"))
    size, before = still.count(), -1
    # the top of what is open below a root closes in each round; once nothing closes, only rings and what hangs on them are open
    while size and (size != before or reach < size):
        if size != before:
            levels.append(still.select(*scope, "node", F.col("root").alias("up")))
        ahead = union([*tops, still]).select(
            *scope, F.col("node").alias("root"), F.col("root").alias("far"), F.col("steps").alias("more"), F.col("low").alias("lower"), F.col("open").alias("further"),
        )
        now = cut(
            still.join(ahead, [*scope, "root"]).select(
                *scope, "node", F.col("far").alias("root"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "lower").alias("low"), F.col("further").alias("open"),
            )
        )
        tops.append(now.where("not open"))
        still, reach = now.where("open"), reach * 2
        size, before = still.count(), size
    # ``reach`` steps up from any open node lies a ring node, and every ring node is met; the way there covers the ring
    on_ring = still.select(*scope, F.col("root").alias("node")).distinct()
    rings = still.join(on_ring, [*scope, "node"], "left_semi").select(*scope, "node", "low")
    return Climb(union(tops).select(*scope, "node", "root", "steps"), levels, rings)


def _numbered(edges: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (s, t) between numbers, and the numbers: (scope, node, id). Rounds then move two longs a row, not names."""
    ends = edges.select(*scope, F.col("s").alias("node")).union(edges.select(*scope, F.col("t").alias("node"))).distinct()
    numbers = cut(ends.withColumn("id", F.monotonically_increasing_id()))
    s = numbers.select(*scope, F.col("node").alias("s"), F.col("id").alias("from"))
    t = numbers.select(*scope, F.col("node").alias("t"), F.col("id").alias("to"))
    pairs = _met(_met(edges, s, "s", scope), t, "t", scope).select(F.col("from").alias("s"), F.col("to").alias("t"))
    return cut(pairs.distinct()), numbers


def distances(edges: DataFrame, seeds: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, node, depth): the fewest edges (scope, s, t) from a seed (scope, node) to each node it leads to; seeds have 0.

    Edges from nodes that nothing enters lead nowhere, and nodes that nothing leaves are met last, in one join. Only what
    is between takes part in the rounds.
    """
    scope = scope or []
    starts = cut(seeds.select(*scope, "node").distinct())
    hops = edges.select(*scope, "s", "t").where("s <> t")
    entered = hops.select(*scope, F.col("t").alias("s")).union(starts.select(*scope, F.col("node").alias("s"))).distinct()
    # nothing is learnt from edges into seeds
    hops = cut(_met(_met(hops, entered, "s", scope, "left_semi"), starts.withColumnRenamed("node", "t"), "t", scope, "left_anti"))
    between = _met(hops, hops.select(*scope, F.col("s").alias("t")).distinct(), "t", scope, "left_semi")
    inner, numbers = _numbered(cut(between), scope)
    first = cut(numbers.join(starts, [*scope, "node"], "left_semi").select(F.col("id").alias("node")))
    depths = _depths(inner, first).where("depth > 0").withColumnRenamed("node", "id")
    known = starts.withColumn("depth", F.lit(0)).unionByName(numbers.join(depths, "id").select(*scope, "node", "depth"))
    known = cut(known)
    last = _met(hops, known.select(*scope, F.col("node").alias("s"), "depth"), "s", scope)
    last = last.groupBy(*scope, F.col("t").alias("node")).agg((F.min("depth") + 1).alias("depth"))
    last = _met(last, known.select(*scope, "node"), "node", scope, "left_anti")
    return known.unionByName(last)


def _depths(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth) over distinct edges (s, t) between numbers, none of them into ``starts``."""
    entered = hops.groupBy(F.col("t").alias("node")).agg(F.count("*").alias("n"), F.min("s").alias("up"))
    trees = climbed(entered.where("n = 1").select("node", "up"), [])
    above = trees.tops.select(F.col("node").alias("s"), "root", "steps")
    several = entered.where("n > 1").select(F.col("node").alias("t"))
    single = entered.where("n = 1").select(F.col("node").alias("s"), F.lit(True).alias("single"))
    # a tree node without a root hangs on a ring that nothing enters
    core = (
        hops.join(several, "t", "left_semi").join(above, "s", "left").join(single, "s", "left")
        .where("root is not null or single is null")
        .groupBy(F.coalesce("root", "s").alias("s"), "t").agg(F.min(F.coalesce("steps", F.lit(0)) + 1).alias("w"))
    )
    core = cut(core)
    known = starts.withColumn("depth", F.lit(0))
    frontier, levels = known, [known]
    while True:
        offers = frontier.withColumnRenamed("node", "s").join(core, "s").groupBy(F.col("t").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        old = known.select("node", F.col("depth").alias("before"))
        frontier = cut(offers.join(old, "node", "left").where("before is null or depth < before").select("node", "depth"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        known = union(levels).groupBy("node").agg(F.min("depth").alias("depth"))
        if len(levels) >= 8:
            known = cut(known)
            levels = [known]
    below = trees.tops.join(known.select(F.col("node").alias("root"), "depth"), "root").select("node", (F.col("depth") + F.col("steps")).cast("int").alias("depth"))
    return known.select("node", F.col("depth").cast("int").alias("depth")).unionByName(below)


@dataclass
class Step:
    """One contraction: edges (scope, node, root, x) from tree nodes below ``root`` to nodes x outside the trees, and the trees."""

    exits: DataFrame
    trees: Climb


def _trimmed(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Edges whose source is entered and whose target is left again: others lie on no ring."""
    entered = edges.select(*scope, F.col("t").alias("s")).distinct()
    left_again = edges.select(*scope, F.col("s").alias("t")).distinct()
    return cut(_met(_met(edges, entered, "s", scope, "left_semi"), left_again, "t", scope, "left_semi"))


def _contracted(edges: DataFrame, scope: list[str], backwards: bool) -> tuple[DataFrame, Step]:
    """The graph without its tree nodes: their edges start at their roots."""
    s, t = ("t", "s") if backwards else ("s", "t")
    hops = edges.select(*scope, F.col(s).alias("node"), F.col(t).alias("x"))
    entered = hops.groupBy(*scope, "x").agg(F.count("*").alias("n"), F.min("node").alias("up"))
    single = cut(entered.where("n = 1").select(*scope, F.col("x").alias("node"), "up"))
    trees = climbed(single, scope)
    inside = single.select(*scope, "node", F.lit(True).alias("inside"))
    out = hops.join(single.select(*scope, F.col("node").alias("x")), [*scope, "x"], "left_anti")
    out = out.join(trees.tops.select(*scope, "node", "root"), [*scope, "node"], "left").join(inside, [*scope, "node"], "left")
    out = cut(out.where("root is not null or inside is null").select(*scope, "node", F.coalesce("root", "node").alias("root"), "x"))
    core = out.where("root <> x").select(*scope, F.col("root").alias(s), F.col("x").alias(t)).select(*scope, "s", "t").distinct()
    return cut(core), Step(out.where("node <> root"), trees)


def _expanded(members: DataFrame, step: Step, scope: list[str]) -> DataFrame:
    """Members of components with the tree nodes that belong to them: those above an edge back into their root's component."""
    colour = members.select(*scope, F.col("node").alias("root"), F.col("colour").alias("own"))
    other = members.select(*scope, F.col("node").alias("x"), F.col("colour").alias("theirs"))
    back = step.exits.join(colour, [*scope, "root"], "left").join(other, [*scope, "x"], "left").where(F.coalesce("own", "root") == F.coalesce("theirs", "x"))
    back = cut(back.select(*scope, "node", "root", F.coalesce("own", "root").alias("colour")))
    found = back.select(*scope, "node", "colour").distinct()
    for k, level in enumerate(step.trees.levels, 1):
        found = found.join(level, [*scope, "node"], "left").select(*scope, F.explode(F.array_compact(F.array("node", "up"))).alias("node"), "colour").distinct()
        found = cut(found) if k % 4 == 0 else found
    roots = back.select(*scope, F.col("root").alias("node"), "colour")
    return cut(union([members, found, roots]).distinct())


def strong_components(edges: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, node, colour): nodes of strongly connected components of two nodes or more; a colour names a component.

    A first trim, before anything is made distinct, leaves the edges that can lie on a ring; these are numbered. Trees below single entries, then trees above single exits, are contracted in turn, with a trim before each, while that
    takes a tenth of the edges. Of what is left every node takes the largest name that reaches it; walking back from the
    owners of these names inside their colours gives one component for each of them, all in one join a round.
    """
    scope = scope or []
    left, numbers = _numbered(_trimmed(edges.select(*scope, "s", "t").where("s <> t"), scope), scope)
    members = cut(_components(left).select(F.col("node").alias("id"), "colour"))
    return numbers.join(members, "id").select(*scope, "node", "colour")


def _components(left: DataFrame) -> DataFrame:
    """(node, colour) over distinct edges (s, t) between numbers."""
    size, backwards, idle = left.count(), False, 0
    steps: list[Step] = []
    rings: list[DataFrame] = []
    while size and idle < 2:
        left, step = _contracted(_trimmed(left, []), [], backwards)
        steps.append(step)
        rings.append(step.trees.rings.select("node", F.col("low").alias("colour")))
        before, size = size, left.count()
        idle = idle + 1 if size > 0.9 * before else 0
        backwards = not backwards
    members = _coloured(left, []) if size else left.select(F.col("s").alias("node"), F.col("s").alias("colour")).where("false")
    for step, ring in zip(reversed(steps), reversed(rings)):
        members = _expanded(members, step, []).unionByName(ring)
    return members


def _coloured(left: DataFrame, scope: list[str]) -> DataFrame:
    """Components of a graph without trees, many in a round: colour by the largest name, then walk back inside colours."""
    done = [left.select(*scope, F.col("s").alias("node"), F.col("s").alias("colour")).where("false")]
    while True:
        left = _trimmed(left, scope)
        if left.isEmpty():
            return union(done)
        colour = largest_reaching(left, scope)
        here = left.join(colour.select(*scope, F.col("node").alias("s"), F.col("colour").alias("cs")), [*scope, "s"])
        here = here.join(colour.select(*scope, F.col("node").alias("t"), F.col("colour").alias("ct")), [*scope, "t"])
        inner = cut(here.where("cs = ct").select(*scope, F.col("cs").alias("colour"), F.col("t").alias("s"), F.col("s").alias("t")))
        owners = colour.where("node = colour").select(*scope, "colour", "node")
        members = cut(_levels(inner, owners, [*scope, "colour"]))
        done.append(members.select(*scope, "node", "colour"))
        gone = members.select(*scope, "node").distinct()
        left = left.join(gone.withColumnRenamed("node", "s"), [*scope, "s"], "left_anti").join(gone.withColumnRenamed("node", "t"), [*scope, "t"], "left_anti")


def _levels(edges: DataFrame, seeds: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, node): what seeds lead to, level by level; as many rounds as the colours took to spread."""
    frontier = cut(seeds.select(*scope, "node").distinct())
    seen = [frontier]
    while True:
        step = edges.join(frontier.select(*scope, F.col("node").alias("s")), [*scope, "s"]).select(*scope, F.col("t").alias("node")).distinct()
        frontier = cut(step.join(union(seen), [*scope, "node"], "left_anti"))
        if frontier.isEmpty():
            return union(seen)
        seen = [*seen, frontier] if len(seen) < 8 else [cut(union([*seen, frontier]))]


def largest_reaching(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Per node the largest node name that reaches it; only changed nodes send in the next round."""
    key = [*scope, "node"]
    nodes = edges.select(*scope, F.col("s").alias("node")).union(edges.select(*scope, F.col("t").alias("node"))).distinct()
    colour = cut(nodes.select(*key, F.col("node").alias("colour"), F.lit(True).alias("changed")))
    while True:
        senders = colour.where("changed").select(*scope, F.col("node").alias("s"), F.col("colour").alias("offer"))
        offers = edges.join(senders, [*scope, "s"]).groupBy(*scope, F.col("t").alias("node")).agg(F.max("offer").alias("offer"))
        colour = cut(
            colour.select(*key, "colour").join(offers, key, "left").select(
                *key, F.greatest("colour", F.coalesce("offer", "colour")).alias("colour"), F.coalesce(F.col("offer") > F.col("colour"), F.lit(False)).alias("changed"),
            )
        )
        if colour.where("changed").isEmpty():
            return colour.drop("changed")
