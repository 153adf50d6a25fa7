"""Road graphs: components by label contraction and shortest paths from many origins."""

from __future__ import annotations

import heapq
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="monsoonway-"))
    return f"{sc.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder.

    A written table is computed once, has sizes that joins can go by, and does not carry the constraints of its plan
    along, which double with every self-join of an iteration; ``checkpoint()`` keeps them.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges that one task ties; of larger graphs, or what rounds leave of them, no task holds all.
TIED_EDGES = 500_000


def _tied(table: pa.Table) -> pa.Table:
    """Each end of the edges (a, b) and the smallest end that it reaches."""
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    kind = table.schema.field("a").type
    return pa.table([pa.array(nodes, kind), pa.array(nodes[label], kind)], names=["a", "to"])


def components(nodes: DataFrame, edges: DataFrame, tied: int = TIED_EDGES) -> DataFrame:
    """Rows (node, component): the smallest node that can be reached; isolated nodes are their own.

    In a round each node follows its smallest neighbour, if smaller; these trees are flattened by doubling and their
    roots take over the edges that leave them. A component's smallest node is always a root, so it remains. Both
    the rounds and the doublings grow with a logarithm, also on long chains, and edges fall away as trees merge. Ends of edges
    need not be listed as nodes.

    Edges are read in the direction in which they come and are not made distinct before the first round, after which few are left in dense graphs. Once
    at most ``tied`` are left, one task ties them.
    """
    open_ = checkpointed(edges.select("a", "b").where("a <> b"))
    labels = nodes.select("node").distinct().withColumn("component", F.col("node"))
    kind = open_.schema["a"].dataType.simpleString()

    def moved(labels: DataFrame, root: DataFrame) -> DataFrame:
        joined = labels.join(root.select(F.col("a").alias("component"), "to"), "component", "left")
        return checkpointed(joined.select("node", F.coalesce("to", "component").alias("component")))

    while open_.count() > tied:
        both = open_.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        root = checkpointed(both.groupBy("e.a").agg(F.min("e.b").alias("b")).select("a", F.least("a", "b").alias("to")))
        while True:
            further = checkpointed(root.join(root.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", "to", "next"))
            root = further.select("a", F.col("next").alias("to"))
            if further.where("next <> to").isEmpty():
                break
        labels = moved(labels, root)
        ends = open_.join(root.select("a", F.col("to").alias("from")), "a").join(root.select(F.col("a").alias("b"), "to"), "b").where("`from` <> to")
        open_ = checkpointed(ends.select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct())
    return moved(labels, open_.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_tied, f"a {kind}, to {kind}"))


#: Links of one graph that a task can hold; larger graphs are relaxed as tables.
HELD_LINKS = 2_000_000
#: Origins that one task starts from, and keys of graphs.
ORIGINS = 4
#: Light links a node to begin with; graphs of fewer than four times as many are not thinned.
LIGHT_LINKS = 32


def _dijkstra(start: np.ndarray, to: np.ndarray, w: np.ndarray, origin: int) -> np.ndarray:
    """Costs from node ``origin`` over links grouped by their first node: those of node i lie at start[i] to start[i + 1]."""
    cost = np.full(len(start) - 1, np.inf)
    cost[origin] = 0.0
    queue = [(0.0, origin)]
    while queue:
        far, node = heapq.heappop(queue)
        if far > cost[node]:
            continue
        span = slice(start[node], start[node + 1])
        reached, sums = to[span], far + w[span]
        better = sums < cost[reached]
        for n, c in zip(reached[better].tolist(), sums[better].tolist()):
            if c < cost[n]:
                cost[n] = c
                heapq.heappush(queue, (c, n))
    return cost


def _costs_of_graph(keys: list[str], origins: np.ndarray):
    """Costs of one graph's links from every ``origins[part::parts]``; the table holds one value of the keys and of part."""

    def run(table: pa.Table) -> pa.Table:
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
        part, parts = table.column("part")[0].as_py(), table.column("parts")[0].as_py()
        own = origins[part::parts]
        nodes = np.unique(np.concatenate([a, b, own]))
        a, b = np.searchsorted(nodes, np.concatenate([a, b])), np.searchsorted(nodes, np.concatenate([b, a]))
        order = np.argsort(a, kind="stable")
        start = np.searchsorted(a[order], np.arange(len(nodes) + 1))
        to, cost = b[order], np.concatenate([w, w])[order]
        out = []
        for o in own.tolist():
            found = _dijkstra(start, to, cost, int(np.searchsorted(nodes, o)))
            reached = np.flatnonzero(np.isfinite(found))
            out.append((np.full(len(reached), o), nodes[reached], found[reached]))
        o, n, c = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        same = [pa.array([table.column(k)[0].as_py()] * len(o), table.schema.field(k).type) for k in keys]
        return pa.table([*same, pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.float64())], names=[*keys, "origin", "node", "cost"])

    return run


def graph_costs(origins: list[int], edges: DataFrame, keys: list[str], held: int = HELD_LINKS) -> DataFrame:
    """Rows (keys, origin, node, cost) over the graphs of undirected ``edges(keys, a, b, w >= 0)``, one for each value of ``keys``.

    Dense graphs are thinned first (``telling_links``). A task reads the links of one graph and walks it from ``ORIGINS`` origins by Dijkstra's method. Graphs of
    more than ``held`` links, whose size is checked first, are relaxed as tables instead.
    """
    own = np.unique(np.array(origins, np.int64))
    merged = checkpointed(edges.groupBy(*keys, F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).agg(F.min("w").cast("double").alias("w")))
    return telling_links(own, merged, keys, held)[1]


def _walked(own: np.ndarray, merged: DataFrame, keys: list[str], held: int) -> DataFrame:
    """Costs over links of which each pair (keys, a, b) has one."""
    most, graphs = merged.groupBy(*keys).count().agg(F.max("count"), F.count("*")).first()
    if (most or 0) > held:
        return _relaxed(own, merged, keys)
    # many graphs are tasks enough, so each travels less often
    parts = max(1, -(-len(own) // (ORIGINS * max(graphs, 1))))
    dealt = merged.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("parts", F.lit(parts))
    kinds = "".join(f"`{k}` {merged.schema[k].dataType.simpleString()}, " for k in keys)
    return dealt.groupBy(*keys, "part").applyInArrow(_costs_of_graph(keys, own), f"{kinds}origin long, node long, cost double")


def telling_links(own: np.ndarray, merged: DataFrame, keys: list[str], held: int = HELD_LINKS, light: int = LIGHT_LINKS) -> tuple[DataFrame, DataFrame]:
    """Links (keys, a, b, w) of ``merged`` that give all costs from the origins ``own``, and these costs (keys, origin, node, cost).

    About the ``light`` lightest links of each node come first. Costs over them are final once no other link undercuts one of them: no link (a, b, w) and
    origin with the cost of a and w below the cost of b. Links that do are added, until none is left; so nothing is lost, and heavy links of dense
    graphs, which no route takes, are read but not walked. Parts that no origin reaches undercut nothing. ``merged`` is read in each round; a pair that repeats costs no more than its lightest link.
    """
    near = [*keys] or [F.lit(1).alias("__all")]
    sizes = merged.groupBy(*near).agg(F.count("*").alias("n"), F.greatest(F.approx_count_distinct("a"), F.approx_count_distinct("b")).alias("nodes"))
    dense = sizes.agg(F.max(F.col("n") / F.greatest(F.col("nodes"), F.lit(1)))).first()[0] or 0.0
    if dense < 4 * light:
        return merged, _walked(own, merged, keys, held)
    share = F.least(F.lit(1.0), light * F.col("nodes") / F.col("n"))
    # one row for each graph; weights of all graphs are cut at the same shares, the largest that one of them needs
    most = float(sizes.agg(F.max(share)).first()[0])
    cuts = F.broadcast(merged.groupBy(*near).agg(F.percentile_approx("w", most).alias("__cut")))
    marked = merged.join(cuts, keys) if keys else merged.crossJoin(cuts.drop("__all"))
    held_back = marked.where("w > __cut").drop("__cut")
    taken = checkpointed(marked.where("w <= __cut").drop("__cut"))
    at = {o: i for i, o in enumerate(own.tolist())}
    slot = F.element_at(F.create_map(*(F.lit(x) for pair in at.items() for x in pair)), F.col("origin")) if at else F.lit(0)
    far = F.lit(float("inf"))
    while True:
        costs = checkpointed(_walked(own, taken, keys, held))
        # the least and the greatest cost of a node decide for most links, the costs from all origins for the others
        row = costs.withColumn("slot", slot).groupBy(*keys, "node").agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"), F.count("*").alias("k"), F.map_from_entries(F.collect_list(F.struct("slot", "cost"))).alias("of"))
        ends = checkpointed(row.select(*keys, "node", "lo", F.when(F.col("k") < len(own), far).otherwise(F.col("hi")).alias("hi"), F.transform(F.sequence(F.lit(0), F.lit(max(len(own), 1) - 1)), lambda i: F.coalesce(F.col("of")[i], far)).alias("of")))
        end = lambda name, *more: ends.select(*keys, F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in more))
        maybe = held_back.join(end("a", "lo", "hi"), [*keys, "a"], "left").join(end("b", "lo", "hi"), [*keys, "b"], "left")
        none = lambda c: F.coalesce(F.col(c), far)
        maybe = checkpointed(maybe.where((none("lo_a") + F.col("w") < none("hi_b")) | (none("lo_b") + F.col("w") < none("hi_a"))).select(*keys, "a", "b", "w"))
        under = maybe.join(end("a", "of"), [*keys, "a"], "left").join(end("b", "of"), [*keys, "b"], "left")
        whole = lambda c: F.coalesce(F.col(c), F.array_repeat(far, max(len(own), 1)))
        gains = lambda x, y: F.exists(F.zip_with(whole(x), whole(y), lambda p, q: p + F.col("w") < q), lambda v: v)
        more = checkpointed(under.where(gains("of_a", "of_b") | gains("of_b", "of_a")).select(*taken.columns))
        if more.isEmpty():
            return taken, costs
        taken = checkpointed(taken.unionByName(more))
        held_back = held_back.join(more.select(*keys, "a", "b"), [*keys, "a", "b"], "left_anti")


def _relaxed(origins: np.ndarray, links: DataFrame, keys: list[str]) -> DataFrame:
    """All origins relax together: a round extends only the costs that the last one improved, keyed by (keys, origin, node)."""
    spark = links.sparkSession
    both = checkpointed(links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    first = spark.createDataFrame([(int(o),) for o in origins], "origin long")
    # as many rows as graphs times origins
    start = first if not keys else links.select(*keys).distinct().join(first)
    best = checkpointed(start.select(*keys, "origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")))
    while True:
        reach = best.where("fresh").withColumnRenamed("node", "a").drop("fresh").join(both, [*keys, "a"]).select(*keys, "origin", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("new"))
        none = F.lit(None).cast("double")
        merged = best.select(*keys, "origin", "node", F.col("cost").alias("old"), none.alias("new")).unionByName(reach.select(*keys, "origin", "node", none.alias("old"), "new"))
        merged = merged.groupBy(*keys, "origin", "node").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        best = checkpointed(merged.select(*keys, "origin", "node", F.least("old", "new").alias("cost"), (F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))).alias("fresh")))
        if best.where("fresh").isEmpty():
            return best.select(*keys, "origin", "node", "cost")


def shortest_costs(origins: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (origin, node, cost) of all nodes each origin reaches over undirected edges (a, b, w >= 0), itself included; origins are few."""
    start = origins.select(F.col("origin").cast("long").alias("origin")).distinct()
    found = graph_costs([r["origin"] for r in start.collect()], edges, [])
    return found.unionByName(start.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"))).groupBy("origin", "node").agg(F.min("cost").alias("cost"))


def route_steps(trips: DataFrame, costs: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (origin, dest, step, a, b, w) of a cheapest route of each trip (origin, dest), steps from 1.

    ``costs`` are those of ``shortest_costs`` and weights are above 0. The last node before another is the smallest
    that a cheapest route may come from. All trips walk back together, a hop a round. Trips to the origin itself and to
    nodes out of reach have no steps.

    Links too heavy for any route, by the least and the greatest cost of their ends, are left out first; a round asks only for the links into nodes where a trip stands.
    """
    span = costs.groupBy("node").agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"))
    span = checkpointed(span)
    of = lambda end: span.select(F.col("node").alias(end), F.col("lo").alias(f"lo_{end}"), F.col("hi").alias(f"hi_{end}"))
    held = edges.select("a", "b", "w").join(of("a"), "a").join(of("b"), "b").where("lo_a + w <= hi_b or lo_b + w <= hi_a")
    held = checkpointed(held.select("a", "b", "w"))
    both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    here, there = costs.select("origin", F.col("node").alias("a"), F.col("cost").alias("before")), costs.select("origin", F.col("node").alias("b"), "cost")
    at = checkpointed(trips.select("origin", "dest").where("origin <> dest").distinct().select("origin", "dest", F.col("dest").alias("b")))
    walked, back = None, 0
    while True:
        ends = checkpointed(at.select("origin", "b").distinct().join(there, ["origin", "b"]))
        into = ends.join(both, "b").join(here, ["origin", "a"]).where("before + w = cost").groupBy("origin", "b").agg(F.min(F.struct("a", "w")).alias("m")).select("origin", "b", "m.a", "m.w")
        hop = checkpointed(at.join(into, ["origin", "b"]).select("origin", "dest", "a", "b", "w", F.lit(back).alias("back")))
        walked = hop if walked is None else walked.unionByName(hop)
        if hop.isEmpty():
            break
        back += 1
        at = hop.select("origin", "dest", F.col("a").alias("b"))
    step = F.max("back").over(Window.partitionBy("origin", "dest")) - F.col("back") + 1
    return walked.select("origin", "dest", step.cast("long").alias("step"), "a", "b", "w")


def spanning_links(edges: DataFrame) -> DataFrame:
    """Rows (a, b, w) of the minimum spanning forest, by rounds in which each component takes its least link.

    Ties go to the smaller (a, b), so the forest is unique. A round contracts the components that its links join, so
    each holds at most half as many as the one before; links inside a component are dropped.
    """
    open_ = checkpointed(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b", "w"))
    chosen = open_.select("a", "b", "w").limit(0)
    while True:
        ends = F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("d")), F.struct(F.col("v").alias("c"), F.col("u").alias("d"))))
        least = open_.select(ends.alias("end"), "a", "b", "w").groupBy("end.c").agg(F.min(F.struct("w", "a", "b", "end.d")).alias("link"))
        links = checkpointed(least.select("c", "link.a", "link.b", "link.w", "link.d"))
        if links.isEmpty():
            return chosen
        chosen = chosen.unionByName(links.select("a", "b", "w").distinct())
        # the only cycles are pairs that take the same link: the smaller of a pair stays, the others follow their links to it
        back = links.select(F.col("c").alias("d"), F.col("d").alias("back"))
        root = checkpointed(links.join(back, "d").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("to")))
        while True:
            further = checkpointed(root.join(root.select(F.col("c").alias("to"), F.col("to").alias("next")), "to").select("c", "to", "next"))
            root = further.select("c", F.col("next").alias("to"))
            if further.where("next <> to").isEmpty():
                break
        for end in ("u", "v"):
            open_ = open_.join(root.select(F.col("c").alias(end), F.col("to").alias(f"new_{end}")), end)
        open_ = checkpointed(open_.where("new_u <> new_v").select(F.col("new_u").alias("u"), F.col("new_v").alias("v"), "a", "b", "w"))


#: Lines of orders that a task sorts.
TASK_LINES = 1_000_000


def successive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (l_orderkey, s, t, w): each line of an order and the next one. Tasks are as many as the lines need, so that what one sorts does not grow with them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = -(-lines.count() // TASK_LINES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").repartition(parts, "l_orderkey")
    total = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.select("l_orderkey", F.col("l_suppkey").alias("s"), F.lead("l_suppkey").over(total).alias("t"), F.col("l_quantity").alias("w")).where("t is not null and s <> t")


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of suppliers: successive lines of an order are an edge, in whatever weeks they ship."""
    return successive(spark, sf_dir).groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.min("w").alias("w"))
