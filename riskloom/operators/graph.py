"""Network measures per snapshot, all snapshots at once.

Rounds of joins and aggregations over edge and node tables; no snapshot is
gathered in one task. Lineage is cut by storing the state every few rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.temporal import month_start, next_month_start
from riskloom.functions.values import seeded_hash
from riskloom.operators.ordering import row_numbers
from riskloom.session import at_once, materialize, materialize_counting


def monthly_edges(df: DataFrame, date: str = "FlightDate", src: str = "Origin", dst: str = "Dest") -> DataFrame:
    """Directed weighted edges per month; busier routes are shorter."""
    month = month_start(F.col(date)).alias("network_month")
    edges = df.groupBy(month, F.col(src).alias("src"), F.col(dst).alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    return edges.withColumn("length", 1.0 / F.sqrt("weight"))


def nodes_of(edges: DataFrame, snapshot: str = "network_month") -> DataFrame:
    return edges.select(snapshot, F.explode(F.array("src", "dst")).alias("node")).distinct()


def shares(edges: DataFrame, snapshot: str = "network_month") -> DataFrame:
    """Each node's share of the snapshot's departing and arriving weight."""
    sides = edges.select(
        snapshot, "weight",
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1.0).alias("o"), F.lit(0.0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("o"), F.lit(1.0).alias("i")),
            )
        ),
    )
    per_node = sides.groupBy(snapshot, "node").agg(
        F.sum(F.col("weight") * F.col("o")).alias("out_weight"), F.sum(F.col("weight") * F.col("i")).alias("in_weight")
    )
    totals = edges.groupBy(F.col(snapshot).alias("_snapshot")).agg(F.greatest(F.sum("weight"), F.lit(1.0)).alias("total"))
    return per_node.join(totals, F.col(snapshot) == F.col("_snapshot")).select(
        snapshot, "node",
        (F.col("out_weight") / F.col("total")).alias("network_weighted_out_share"),
        (F.col("in_weight") / F.col("total")).alias("network_weighted_in_share"),
    )


def normalized(edges: DataFrame, by: str = "src", snapshot: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Edge weights divided by the total weight of the node on side ``by``."""
    key = [*snapshot, by]
    totals = edges.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.sum("weight").alias("_total"))
    joined = edges.join(totals, [F.col(c) == F.col(f"_{c}") for c in key])
    share = F.col("weight") / F.greatest("_total", F.lit(1.0))
    return joined.select(*edges.columns, share.alias(name))


def neighbour_mean(edges: DataFrame, features: DataFrame, values: Sequence[str], out: bool = True) -> DataFrame:
    """Weighted mean of the neighbours' features, over departing or arriving edges."""
    near, far = ("src", "dst") if out else ("dst", "src")
    weighted = normalized(edges, near).select(F.col(near).alias("node"), F.col(far).alias("_far"), "share")
    other = features.select(F.col("node").alias("_other"), *values)
    return weighted.join(other, F.col("_far") == F.col("_other")).groupBy("node").agg(
        *[F.sum(F.col("share") * F.col(v)).alias(f"neighbour_{v}") for v in values]
    )


def node_profile(df: DataFrame, origin: str, dest: str, label: str, duration: str) -> DataFrame:
    """Volume, label rate, distinct neighbours and mean duration per node and side.

    Route totals are aggregated first; every node keeps its row even when it
    only ever appears on one side. The totals are stored, because both sides read them.
    """
    route = materialize(df.groupBy(origin, dest).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).alias("labels"), F.count(label).alias("known"),
        F.sum(duration).alias("minutes"), F.count(duration).alias("timed"),
    ), "route-totals")

    def side(node: str, prefix: str) -> DataFrame:
        return route.groupBy(F.col(node).alias(f"{prefix}_node")).agg(
            F.sum("rows").alias(f"{prefix}_flights"),
            F.try_divide(F.sum("labels"), F.sum("known").cast("double")).alias(f"{prefix}_delay_rate"),
            F.count(F.lit(1)).alias(f"{prefix}_unique_neighbors"),
            F.try_divide(F.sum("minutes"), F.sum("timed").cast("double")).alias(f"{prefix}_mean_duration"),
        )

    joined = side(origin, "out").join(side(dest, "in"), F.col("out_node") == F.col("in_node"), "full")
    return joined.withColumn("node", F.coalesce("out_node", "in_node")).drop("out_node", "in_node")


def standardize_nodes(profile: DataFrame, counts: Sequence[str], others: Sequence[str]) -> DataFrame:
    """log1p of counts, median then 0 for missing values, population z-scores."""
    columns = [*counts, *others]
    logged = profile.withColumns({c: F.log1p(F.col(c).cast("double")) for c in counts})
    # The profile has one row per node; the fitted statistics are one number per column.
    medians = logged.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    filled = logged.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]), F.lit(0.0)) for c in columns})
    moments = filled.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("spread")).alias(c) for c in columns]).first()
    z = lambda c: (F.col(c) - F.lit(moments[c]["mean"])) / F.lit(max(moments[c]["spread"], 1e-6))
    return filled.withColumns({c: z(c) for c in columns})


def pagerank(
    edges: DataFrame,
    snapshot: str = "network_month",
    damping: float = 0.85,
    tolerance: float = 1e-6,
    max_rounds: int = 100,
    rounds: int | None = None,
    store_every: int = 5,
) -> DataFrame:
    """Weighted PageRank of every snapshot.

    Each snapshot stops at its own first round whose summed change is below
    ``nodes * tolerance``; with ``rounds`` all run exactly that many. The mass
    of nodes without departures is spread evenly.
    """
    edges = materialize(edges, "edges")
    out = edges.groupBy(F.col(snapshot).alias("_s"), F.col("src").alias("_n")).agg(F.sum("weight").alias("_out"))
    nodes = nodes_of(edges, snapshot)
    sizes = nodes.groupBy(F.col(snapshot).alias("_z")).agg(F.count(F.lit(1)).cast("double").alias("size"))
    known, dangling = materialize_counting(
        nodes.join(sizes, F.col(snapshot) == F.col("_z"))
        .join(out, (F.col(snapshot) == F.col("_s")) & (F.col("node") == F.col("_n")), "left")
        .select(snapshot, "node", "size", F.col("_out").isNull().alias("dangling"), "_out"),
        F.col("dangling"), "nodes",
    )
    flows = edges.join(out, (F.col(snapshot) == F.col("_s")) & (F.col("src") == F.col("_n"))).select(
        F.col(snapshot).alias("_s"), "src", "dst", (F.col("weight") / F.col("_out")).alias("share"), F.lit(False).alias("own")
    )
    # A weightless edge to itself carries a node's own state into the next round.
    own = known.select(F.col(snapshot).alias("_s"), F.col("node").alias("src"), F.col("node").alias("dst"),
                       F.lit(0.0).alias("share"), F.lit(True).alias("own"))
    links = materialize(flows.unionByName(own), "links")
    has_dangling = dangling > 0
    # A round that spreads lost mass reads its input twice, so its plan doubles.
    step = min(store_every, 3) if has_dangling else store_every

    def advance(state: DataFrame) -> DataFrame:
        last = F.element_at("ranks", -1)
        moved = links.join(state, (F.col("_s") == F.col(snapshot)) & (F.col("src") == F.col("node")))
        kept = moved.groupBy("_s", "dst").agg(
            F.sum(last * F.col("share")).alias("_flow"),
            *[F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in ("size", "dangling", "ranks")],
        ).withColumnsRenamed({"_s": snapshot, "dst": "node"})
        lost = F.lit(0.0)
        if has_dangling:
            spilt = state.where("dangling").groupBy(F.col(snapshot).alias("_s")).agg(F.sum(last).alias("_lost"))
            kept = kept.join(spilt, F.col(snapshot) == F.col("_s"), "left")
            lost = F.coalesce("_lost", F.lit(0.0)) / F.col("size")
        rank = damping * (F.col("_flow") + lost) + (1 - damping) / F.col("size")
        return kept.select(snapshot, "node", "size", "dangling", F.concat("ranks", F.array(rank)).alias("ranks"))

    state = known.select(snapshot, "node", "size", "dangling", F.array(1.0 / F.col("size")).alias("ranks"))
    finished: list[DataFrame] = []
    limit, done = (rounds if rounds is not None else max_rounds), 0
    while done < limit:
        width = min(step, limit - done)
        state = materialize(reduce(lambda s, _: advance(s), range(width), state), "ranks")
        done += width
        if rounds is None:
            change = lambda i: F.sum(F.abs(F.col("ranks")[i] - F.col("ranks")[i - 1]))
            settled = [F.when(change(i) < F.max("size") * tolerance, i) for i in range(1, width + 1)]
            stops = state.groupBy(F.col(snapshot).alias("_s")).agg(F.coalesce(*settled).alias("stop"))
            joined = state.join(stops, F.col(snapshot) == F.col("_s"))
            finished.append(joined.where("stop IS NOT NULL").select(
                snapshot, "node", F.get("ranks", F.col("stop")).alias("network_pagerank")))
            state = joined.where("stop IS NULL").drop("_s", "stop")
            if stops.where("stop IS NULL").isEmpty():
                return reduce(DataFrame.unionByName, finished)
        state = state.withColumn("ranks", F.array(F.element_at("ranks", -1)))
    if rounds is None:
        raise RuntimeError(f"PageRank did not settle within {max_rounds} rounds")
    return state.select(snapshot, "node", F.element_at("ranks", -1).alias("network_pagerank"))


def betweenness(
    edges: DataFrame, snapshot: str = "network_month", max_sources: int | None = None, seed: int = 42
) -> DataFrame:
    """Shortest-path betweenness by edge length, exact unless ``max_sources`` asks for an estimate.

    Distances relax round by round from all sources of all snapshots; path
    counts and dependencies then flow along the shortest-path edges, one hop
    per round. With ``max_sources`` only that many seeded sources of each snapshot are
    followed and the sums are scaled up.
    """
    edges = materialize(edges, "edges")
    nodes = nodes_of(edges, snapshot)
    sizes = nodes.groupBy(F.col(snapshot).alias("_z")).agg(F.count(F.lit(1)).cast("double").alias("size"))
    hashed = nodes.withColumn("_hash", seeded_hash(F.col("node"), seed))
    picked = hashed
    if max_sources is not None:
        picked = row_numbers(hashed, [F.col("_hash"), F.col("node")], [snapshot], "_pick").where(F.col("_pick") <= max_sources)
    sources = materialize(picked.select(snapshot, F.col("node").alias("source")), "sources")
    hops = materialize(
        edges.where("src <> dst").select(F.col(snapshot).alias("_s"), F.col("src").alias("_u"), F.col("dst").alias("_v"), "length"), "hops"
    )
    key = [snapshot, "source", "node"]

    def follow(state: DataFrame) -> DataFrame:
        return state.join(hops, (F.col(snapshot) == F.col("_s")) & (F.col("node") == F.col("_u")))

    reached = sources.select(snapshot, "source", F.col("source").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh"))
    while True:
        tried = follow(reached.where("fresh")).select(
            snapshot, "source", F.col("_v").alias("node"), (F.col("d") + F.col("length")).alias("d"), F.lit(None).cast("double").alias("old"))
        known = reached.select(*key, "d", F.col("d").alias("old"))
        best = known.unionByName(tried).groupBy(*key).agg(F.min("d").alias("d"), F.min("old").alias("old"))
        shorter = F.col("old").isNull() | (F.col("d") < F.col("old"))
        reached, changed = materialize_counting(best.select(*key, "d", shorter.alias("fresh")), F.col("fresh"), "reached")
        if not changed:
            break

    ends = reached.select(F.col(snapshot).alias("_es"), F.col("source").alias("_esrc"), F.col("node").alias("_ev"), F.col("d").alias("_ed"))
    tight = follow(reached).join(
        ends, (F.col(snapshot) == F.col("_es")) & (F.col("source") == F.col("_esrc")) & (F.col("_v") == F.col("_ev"))
        & (F.col("d") + F.col("length") == F.col("_ed"))
    )
    paths = materialize(tight.select(snapshot, "source", F.col("_u").alias("u"), F.col("_v").alias("v")), "paths")

    def spread(start: DataFrame, along: DataFrame, near: str, far: str, weight) -> DataFrame:
        """Push a value along the path edges until none is left; sum what each node saw."""
        seen, wave = [start], start
        while True:
            edge = along.select(F.col(snapshot).alias("_s"), F.col("source").alias("_src"), F.col(near).alias("_near"),
                                F.col(far).alias("_far"), weight.alias("_w"))
            hop = wave.join(edge, (F.col(snapshot) == F.col("_s")) & (F.col("source") == F.col("_src")) & (F.col("node") == F.col("_near")))
            reach = hop.groupBy(snapshot, "source", F.col("_far").alias("node")).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))
            wave, moved = materialize_counting(reach, F.lit(True), "wave")
            if not moved:
                break
            seen.append(wave)
        return reduce(DataFrame.unionByName, seen).groupBy(*key).agg(F.sum("value").alias("value"))

    start = sources.select(snapshot, "source", F.col("source").alias("node"), F.lit(1.0).alias("value"))
    counts = materialize(spread(start, paths, "u", "v", F.lit(1.0)), "counts")
    of = lambda end, name: counts.select(F.col(snapshot).alias(f"_{end}s"), F.col("source").alias(f"_{end}src"),
                                         F.col("node").alias(f"_{end}n"), F.col("value").alias(name))
    split = paths
    for end, name in (("u", "_cu"), ("v", "_cv")):
        split = split.join(of(end, name), (F.col(snapshot) == F.col(f"_{end}s")) & (F.col("source") == F.col(f"_{end}src")) & (F.col(end) == F.col(f"_{end}n")))
    split = materialize(split.select(snapshot, "source", "u", "v", (F.col("_cu") / F.col("_cv")).alias("part")), "split")
    first = split.groupBy(snapshot, "source", F.col("u").alias("node")).agg(F.sum("part").alias("value"))
    depends = spread(first, split, "v", "u", F.col("part"))

    used = sources.groupBy(F.col(snapshot).alias("_k")).agg(F.count(F.lit(1)).cast("double").alias("picked"))
    total = depends.where("node <> source").groupBy(F.col(snapshot).alias("_s"), F.col("node").alias("_n")).agg(F.sum("value").alias("_sum"))
    size = F.col("size")
    scale = F.when(size > 2, size / F.col("picked") / ((size - 1) * (size - 2))).otherwise(1.0)
    return (
        nodes.join(sizes, F.col(snapshot) == F.col("_z"))
        .join(used, F.col(snapshot) == F.col("_k"))
        .join(total, (F.col(snapshot) == F.col("_s")) & (F.col("node") == F.col("_n")), "left")
        .select(snapshot, "node", (F.coalesce("_sum", F.lit(0.0)) * scale).alias("network_betweenness"))
    )


def lagged_measures(edges: DataFrame, max_sources: int | None = None, seed: int = 42) -> DataFrame:
    """All node measures of a month, dated to the month after it."""
    edges = materialize(edges, "edges")
    tables = at_once(edges.sparkSession, lambda: pagerank(edges), lambda: betweenness(edges, max_sources=max_sources, seed=seed), lambda: shares(edges))
    joined = reduce(lambda a, b: a.join(b, ["network_month", "node"]), tables)
    return joined.select(
        next_month_start(F.col("network_month")).alias("flight_month"), F.col("node").alias("airport"),
        "network_pagerank", "network_betweenness", "network_weighted_out_share", "network_weighted_in_share",
    )
