"""Reachability on the street graph: stress subgraphs, components, isochrones.

The iterative operators keep what they need between rounds in tables written to the checkpoint folder, and stop
when nothing is left to do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbflow.functions import geo
from kerbflow.functions.skew import salted_lookup
from kerbflow.session import cut_lineage, work_path

LEVELS = (1, 2, 3, 4)


def stress_subgraph(edges: DataFrame, nodes: DataFrame | None, level: int) -> DataFrame:
    """Edges rated 1 to ``level`` whose end nodes, where rated, are too."""
    kept = edges.where(F.col("LTS").between(1, level))
    if nodes is None:
        return kept
    bad = nodes.where((F.col("LTS") > level) | (F.col("LTS") == 0)).select(F.col("osmid").alias("_bad"))
    return kept.join(bad, kept["u"] == bad["_bad"], "left_anti").join(bad, kept["v"] == bad["_bad"], "left_anti")


def travel_minutes(edges: DataFrame, kmh: float) -> DataFrame:
    return edges.withColumn("minutes", F.col("length") / (kmh * 1000 / 60))


#: A graph of at most so many links is finished in one task.
REST = 20_000


def components(nodes: DataFrame, edges: DataFrame, rest: int = REST) -> DataFrame:
    """Weakly connected component of every node, named by its smallest node id. Ids may have any type with an order."""
    own, label = nodes.select("osmid").distinct(), linked_components(edges, rest)
    if label is None:
        return own.withColumn("component", F.col("osmid"))
    return own.join(label.withColumnRenamed("node", "osmid"), "osmid", "left").withColumn(
        "component", F.coalesce("component", "osmid"))


def linked_components(edges: DataFrame, rest: int = REST) -> DataFrame | None:
    """``node, component`` of the nodes that are linked with another one; None if there are none.

    The graph is contracted until at most ``rest`` links are left, which one task finishes. In a round every node joins its best
    neighbour or stays: first the nodes with the most links, if they have more than a small share of all, then the smallest hash,
    dealt anew in every round. So a star or a clique is gone after one round and a path keeps about a third of its nodes; what
    a round reads shrinks with the graph. Then the names go back through the rounds. A node's share of the links decides whether
    its rows are split (:func:`salted_lookup`), so no task gets much more than the others, however large the graph is.
    """
    links = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    links = cut_lineage(links)
    shares = 4 * int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    names = None
    while total := links.count():
        limit = max(total // shares, 1)
        joins = cut_lineage(_finished(links) if total <= rest else _best_neighbours(links, limit, len(rounds)))
        if total <= rest and names is None:
            return joins.select("node", F.col("rep").alias("component"))
        low = joins.withColumn("low", F.col("node")) if names is None else joins.join(names, "node")
        names = low.groupBy("rep").agg(F.min("low").alias("low"))
        if total <= rest:
            rounds.append((joins, names))
            break
        names = cut_lineage(names)
        rounds.append((joins, names))
        names = names.withColumnRenamed("rep", "node")
        to = joins.select(F.col("node").alias("_node"), F.col("rep").alias("_rep"))
        moved = salted_lookup(links, to, "a", "_node", ["b"], limit).select(F.col("_rep").alias("x"), "b")
        moved = salted_lookup(moved, to, "b", "_node", ["x"], limit).select("x", F.col("_rep").alias("y"))
        links = cut_lineage(moved.where(F.col("x") != F.col("y")).select(
            F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    label = None
    for joins, names in reversed(rounds):
        if label is not None:
            names = names.join(label.toDF("rep", "label"), "rep", "left").select("rep", F.coalesce("label", "low").alias("low"))
        named = names.select(F.col("rep").alias("_rep"), F.col("low").alias("component"))
        limit = max(joins.count() // shares, 1)
        label = cut_lineage(salted_lookup(joins, named, "rep", "_rep", ["node"], limit).select("node", "component"))
    return label


def _best_neighbours(links: DataFrame, limit: int, turn: int) -> DataFrame:
    """``node, rep``: the best of each node and its neighbours."""
    a, b = F.col("a"), F.col("b")
    ends = links.select(F.inline(F.array(*[F.struct(x.alias("node"), y.alias("near")) for x, y in ((a, b), (b, a), (a, a), (b, b))])))
    # at most 2 * links / limit of them, whatever the size of the graph
    hubs = ends.where(F.col("node") != F.col("near")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > limit).select(F.col("node").alias("near"), F.negative("n").alias("rank"))
    order = F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), F.xxhash64("near", F.lit(turn)).alias("h"), F.col("near"))
    return ends.join(F.broadcast(hubs), "near", "left").groupBy("node").agg(F.min(order)["near"].alias("rep"))


def _finished(links: DataFrame) -> DataFrame:
    """``node, rep`` of a small graph: the smallest node of each component, found in one task."""
    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                above[max(x, y)] = min(x, y)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above)), pa.array([root(x) for x in above])], names=["node", "rep"])

    if links.schema["a"].dataType == T.LongType():  # such ids need no names
        return links.coalesce(1).mapInArrow(smallest, "node bigint, rep bigint")

    def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[str, str] = {}

        def root(x: str) -> str:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                above[root(x)] = root(y)
        if above:
            yield pa.RecordBatch.from_pydict({"key": list(above), "root": [root(x) for x in above]})

    key = lambda c: F.to_json(F.struct(c))  # noqa: E731  (a name for ids of any type)
    roots = links.select(key(F.col("a").alias("id")), key(F.col("b").alias("id"))).coalesce(1).mapInArrow(union_find, "key string, root string")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("key", key(F.col("node").alias("id")))
    found = cut_lineage(ends.join(roots, "key").select("node", "root"))
    return found.join(found.groupBy("root").agg(F.min("node").alias("rep")), "root").select("node", "rep")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("osmid")).unionByName(edges.select(F.col("v").alias("osmid"))).distinct()
    return nodes.select("osmid").join(ends, "osmid", "left_anti")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest weak component that have an edge (the smallest id wins a tie)."""
    labels = components(nodes, edges)
    best = component_sizes(labels).agg(
        F.min(F.struct(F.negative("n_nodes").alias("k"), F.col("component"))).alias("b")).select("b.component")
    inside = labels.join(best, "component", "left_semi")
    return inside.join(isolated_nodes(nodes, edges), "osmid", "left_anti").select("osmid", "component")


def edges_inside(edges: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.select(F.col("osmid").alias("_id"))
    return edges.join(ids, edges["u"] == ids["_id"], "left_semi").join(ids, edges["v"] == ids["_id"], "left_semi")


def level_edges(edges: DataFrame, nodes: DataFrame | None = None, only_largest: bool = False) -> DataFrame:
    """The edges of every stress level's subgraph, tagged with the level.

    Rated ``nodes`` that are too stressful for a level go with their edges. With ``only_largest`` each subgraph is cut to its
    largest weak component; all levels are searched together.
    """
    usable = edges.where(F.col("LTS").between(1, LEVELS[-1]))
    out = usable.withColumn("level", F.explode(F.sequence(F.col("LTS"), F.lit(LEVELS[-1]))))
    if nodes is not None:
        # levels on which a node is too stressful; an unrated one (0) is on all of them
        above = F.when(F.col("LTS") == 0, F.lit(LEVELS[-1])).otherwise(F.least(F.col("LTS") - 1, F.lit(LEVELS[-1])))
        bad = nodes.where((F.col("LTS") == 0) | (F.col("LTS") > 1)).select(
            F.col("osmid").alias("_bad"), F.explode(F.sequence(F.lit(1), above)).alias("_level"))
        for end in ("u", "v"):
            out = out.join(bad, (F.col(end) == F.col("_bad")) & (F.col("level") == F.col("_level")), "left_anti")
    return largest_by_level(out) if only_largest else out


def level_components(edges: DataFrame) -> DataFrame:
    """Weak component of every node that has an edge, per level: ``level, osmid, component``. All levels are searched together."""
    place = lambda c: F.struct("level", F.col(c).alias("id"))
    pairs = edges.select(place("u").alias("u"), place("v").alias("v"))
    labels = components(pairs.select(F.explode(F.array("u", "v")).alias("osmid")), pairs)
    return labels.select("osmid.level", F.col("osmid.id").alias("osmid"), F.col("component.id").alias("component"))


def level_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("level", "component").agg(F.count(F.lit(1)).alias("n_nodes"))


def largest_of_levels(labels: DataFrame) -> DataFrame:
    """The nodes of the largest component of every level (the smallest id wins a tie)."""
    best = level_sizes(labels).groupBy("level").agg(
        F.min(F.struct(F.negative("n_nodes").alias("k"), F.col("component")))["component"].alias("component"))
    return labels.join(best, ["level", "component"], "left_semi").select("level", "osmid", "component")


def largest_by_level(edges: DataFrame) -> DataFrame:
    """The edges of the largest weak component of every level."""
    edges = cut_lineage(edges)
    inside = largest_of_levels(level_components(edges)).select("level", F.col("osmid").alias("u"))
    # a component has both ends of an edge or none
    return edges.join(inside, ["level", "u"], "left_semi").select(*edges.columns)


def isochrone_network(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The network of every level: the largest component of the whole graph, from it the level's edges without
    nodes that are too stressful, and of these the largest component again."""
    base = largest_by_level(edges.withColumn("level", F.lit(0))).drop("level")
    return level_edges(base, nodes, only_largest=True)


def contracted(roads: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace chains of nodes with two neighbours by single edges, on every level.

    Returns the roads between the remaining nodes, and for each node of a chain the minutes to it from the ends of its chain
    (``level, node, via, minutes``). Nodes of ``kept`` remain. A chain is followed by pointer doubling from each of its
    arcs, so the number of rounds is the logarithm of its length. Rings without any other node are left out; nothing leads to them.
    """
    both = roads.select("level", F.col("u").alias("tail"), F.col("v").alias("head"), F.col("minutes").alias("there"),
                        F.lit(None).cast("double").alias("back")).unionAll(
        roads.select("level", F.col("v").alias("tail"), F.col("u").alias("head"), F.lit(None).cast("double"), "minutes"))
    arcs = cut_lineage(both.groupBy("level", "tail", "head").agg(F.min("there").alias("there"), F.min("back").alias("back")))
    inner = arcs.groupBy("level", "tail").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("x"), F.max("head").alias("y")).where("n = 2")
    inner = inner.join(kept.select(F.col("origin").alias("tail")).distinct(), "tail", "left_anti").select(
        "level", F.col("tail").alias("node"), "x", "y")
    inner = cut_lineage(inner)
    marks = inner.select("level", F.col("node").alias("tail"), F.lit(True).alias("from_inner"))
    turn = inner.select("level", F.col("node").alias("head"), "x", "y")
    # the arc behind an arc to a chain's node leads to its other neighbour
    walk = arcs.join(marks, ["level", "tail"], "left").join(turn, ["level", "head"], "left").select(
        "level", "tail", "head", "there", "back", F.col("from_inner").isNotNull().alias("from_inner"), F.col("head").alias("end"),
        F.when(F.col("x").isNotNull(), F.struct(F.col("head").alias("tail"), F.when(F.col("x") == F.col("tail"), F.col("y")).otherwise(F.col("x")).alias("head"))).alias("next"))
    walk = cut_lineage(walk)
    plain = walk.where(~F.col("from_inner") & F.col("next").isNull())
    walk = walk.where(F.col("from_inner") | F.col("next").isNotNull())
    left = None
    while True:
        todo = walk.where(F.col("next").isNotNull()).count()
        if todo in (0, left):
            break
        left = todo
        on = walk.select("level", F.struct("tail", "head").alias("next"), F.col("there").alias("_there"), F.col("back").alias("_back"),
                         F.col("end").alias("_end"), F.col("next").alias("_next"))
        open_, done = walk.where(F.col("next").isNotNull()), walk.where(F.col("next").isNull())
        walk = cut_lineage(done.unionByName(open_.join(on, ["level", "next"]).select(
            "level", "tail", "head", (F.col("there") + F.col("_there")).alias("there"), (F.col("back") + F.col("_back")).alias("back"),
            "from_inner", F.col("_end").alias("end"), F.col("_next").alias("next"))))
    ended = walk.where(F.col("next").isNull())
    short = plain.unionByName(ended.where(~F.col("from_inner"))).where(F.col("there").isNotNull() & (F.col("tail") != F.col("end")))
    roads = short.groupBy("level", F.col("tail").alias("u"), F.col("end").alias("v")).agg(F.min("there").alias("minutes"))
    within = ended.where(F.col("from_inner") & F.col("back").isNotNull()).groupBy(
        "level", F.col("tail").alias("node"), F.col("end").alias("via")).agg(F.min("back").alias("minutes"))
    return cut_lineage(roads), cut_lineage(within)


def isochrone(edges: DataFrame, origins: DataFrame, budget: float) -> DataFrame:
    """Shortest minutes from each origin to every node within ``budget``, per stress level.

    ``edges``: ``level, u, v, minutes``; ``origins``: ``origin``. Chains are contracted first, so the rounds follow the
    crossings on the way. All origins and levels advance together. A round extends only the nodes improved in the last one
    and appends what it improves to a table bucketed by level, origin and node, which therefore is read in place: only the
    new minutes are shuffled. The nodes of the chains get their minutes at the end.
    """
    spark = edges.sparkSession
    roads = cut_lineage(edges.where(F.col("u") != F.col("v")).groupBy("level", "u", "v").agg(F.min("minutes").alias("minutes")))
    starts = cut_lineage(origins.select("origin").distinct())
    # an origin starts only on the levels whose network has it
    there = edges.select("level", F.explode(F.array("u", "v")).alias("origin")).distinct()
    front = cut_lineage(starts.join(there, "origin").select("level", "origin", F.col("origin").alias("node"), F.lit(0.0).alias("minutes")))
    roads, within = contracted(roads, starts)
    keys = ["level", "origin", "node"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"isochrone_{uuid.uuid4().hex}"
    path = work_path(spark, name)
    try:
        while not front.isEmpty():
            front.repartition(buckets, *keys).write.mode("append").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
            step = front.withColumnsRenamed({"node": "u", "minutes": "spent"}).join(roads, ["level", "u"]).select(
                "level", "origin", F.col("v").alias("node"), (F.col("spent") + F.col("minutes")).alias("minutes")).where(F.col("minutes") <= budget)
            step = step.groupBy(*keys).agg(F.min("minutes").alias("minutes"))
            front = cut_lineage(improving(step, spark.table(name), keys))
            # the table has changed; its next reader must list the files anew
            spark.catalog.refreshTable(name)
        reached = spark.table(name) if spark.catalog.tableExists(name) else front
        reached = cut_lineage(reached.groupBy(*keys).agg(F.min("minutes").alias("minutes")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    chains = reached.withColumnsRenamed({"node": "via", "minutes": "spent"}).join(within, ["level", "via"]).select(
        "level", "origin", "node", (F.col("spent") + F.col("minutes")).alias("minutes")).where(F.col("minutes") <= budget)
    return reached.unionByName(chains.groupBy(*keys).agg(F.min("minutes").alias("minutes")))


def improving(step: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``step`` (``minutes`` and one row per ``keys``) that beat every row of ``table`` with the same keys.

    Most of the table is of no concern to a step, above all in the late rounds. So it is only passed by: each task holds the step's
    rows of its own bucket and keeps what they don't beat; neither an aggregate nor a sort sees the others.
    """
    new = step.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("minutes").alias("_minutes")).hint("shuffle_hash")
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in keys])
    unbeaten = table.join(new, same & (F.col("minutes") <= F.col("_minutes")), "left_semi").select(*keys)
    return step.join(unbeaten, keys, "left_anti").select(*keys, "minutes")


def lowest_level(reached: DataFrame) -> DataFrame:
    """Each reached node with the lowest stress level that reaches it."""
    return reached.groupBy("origin", "node").agg(F.min("level").alias("level"))


def isochrone_counts(reached: DataFrame) -> DataFrame:
    """Reachable nodes per origin and level, one column per level."""
    return reached.groupBy("origin").agg(*[
        F.sum((F.col("level") == k).cast("bigint")).alias(f"lts{k}") for k in LEVELS])


def reach_share(counts: DataFrame) -> DataFrame:
    """Reach relative to the best origin at the highest level."""
    best = counts.agg(F.max(f"lts{LEVELS[-1]}")).scalar()
    return counts.withColumns({f"share{k}": F.col(f"lts{k}") / best for k in LEVELS})


def top_origins(counts: DataFrame, k: int = 15, level: int = 2) -> DataFrame:
    return counts.orderBy(F.desc(f"lts{level}"), "origin").limit(k)


def nearest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nearest node of each point (``point_id, lat, lon``), by great-circle distance, smallest id on ties."""
    targets = nodes.select("osmid", F.col("y").alias("t_lat"), F.col("x").alias("t_lon"))
    return geo.nearest_of_all(points, targets, ["point_id"], ["osmid"], ["osmid"])


def grid_points(nodes: DataFrame, n: int) -> DataFrame:
    """Evenly spaced points over the extent of the network, ``n + 1`` per axis, rounded to 4 digits."""
    box = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def place(lo: str, hi: str, i: str) -> Column:
        return F.round(F.col(lo) + F.col(i) * (F.col(hi) - F.col(lo)) / (n + 1), 4)

    return (
        box.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n))))
        .select((F.col("i") * (n + 1) + F.col("j")).alias("point_id"), place("x0", "x1", "i").alias("lon"),
                place("y0", "y1", "j").alias("lat")))


def snapped_points(points: DataFrame, nodes: DataFrame, network: DataFrame, near_m: float) -> DataFrame:
    """The level-1 node that each point starts from: ``point_id, lat, lon, osmid``.

    Points farther than ``near_m`` from any node lie outside. One search serves both questions: its targets are the nodes
    as they are and, as a group of their own, those that the level-1 ``network`` has.
    """
    own = network.where("level = 1").select(F.explode(F.array("u", "v")).alias("osmid")).distinct()
    place = nodes.select("osmid", F.col("y").alias("t_lat"), F.col("x").alias("t_lon"))
    targets = place.withColumn("level", F.lit(0)).unionByName(place.join(own, "osmid", "left_semi").withColumn("level", F.lit(1)))
    asked = points.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1))))
    found = geo.nearest(asked, targets, ["point_id"], ["osmid"], ["osmid"], by=["level"])
    inside = found.where((F.col("level") == 0) & (F.col("distance") <= near_m)).select("point_id")
    return found.where("level = 1").join(inside, "point_id", "left_semi").select("point_id", "lat", "lon", "osmid")


def isochrone_grid(network: DataFrame, nodes: DataFrame, n: int, budget: float, near_m: float) -> DataFrame:
    """Reach counts of grid points, each from its nearest node of the level-1 network."""
    snapped = cut_lineage(snapped_points(grid_points(nodes, n), nodes, network, near_m))
    reached = isochrone(network, snapped.select(F.col("osmid").alias("origin")), budget)
    counts = isochrone_counts(reached)
    return snapped.join(counts, snapped["osmid"] == counts["origin"]).select(
        "point_id", "lon", "lat", "origin", *[f"lts{k}" for k in LEVELS])
