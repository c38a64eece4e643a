"""Registered queries: network measures and node features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.temporal import next_month_start
from riskloom.functions.values import positive_or_null
from riskloom.operators import graph as G, history, joins, sampling
from riskloom.plans import binding as B, flights as P
from riskloom.plans.binding import HUBS_SQL, RAW_SQL, labelled_flights, sql_with
from riskloom.plans.feature_queries import TRAILING_SQL, eligible_flights
from riskloom.plans.registry import query
from riskloom.session import materialize

EDGES_SQL = """edges AS (
  SELECT CAST(date_trunc('month', "FlightDate") AS DATE) AS network_month, "Origin" AS src, "Dest" AS dst,
         CAST(count(*) AS DOUBLE) AS weight, 1 / sqrt(count(*)) AS length FROM flights GROUP BY ALL
)"""
NODES_SQL = """nodes AS (SELECT network_month, node, CAST(count(*) OVER (PARTITION BY network_month) AS DOUBLE) AS n FROM (
  SELECT network_month, src AS node FROM edges UNION SELECT network_month, dst FROM edges)
), outs AS (SELECT network_month, src, sum(weight) AS total FROM edges GROUP BY ALL
), links AS (SELECT network_month, src, dst, weight / total AS share FROM edges JOIN outs USING (network_month, src)
), r0 AS MATERIALIZED (SELECT network_month, node, n, 1 / n AS r FROM nodes)"""
ROUNDS = 8


def _round_sql(i: int) -> str:
    return f"""r{i} AS MATERIALIZED (
  SELECT p.network_month, p.node, p.n, 0.85 * (coalesce(f.flow, 0) + coalesce(d.lost, 0) / p.n) + 0.15 / p.n AS r FROM r{i - 1} p
  LEFT JOIN (SELECT l.network_month, l.dst, sum(l.share * q.r) AS flow FROM links l JOIN r{i - 1} q ON l.network_month = q.network_month AND l.src = q.node GROUP BY ALL) f
    ON f.network_month = p.network_month AND f.dst = p.node
  LEFT JOIN (SELECT q.network_month, sum(q.r) AS lost FROM r{i - 1} q LEFT JOIN outs o ON q.network_month = o.network_month AND q.node = o.src WHERE o.src IS NULL GROUP BY ALL) d
    ON d.network_month = p.network_month
)"""


PAGERANK_SQL = ",".join(_round_sql(i) for i in range(1, ROUNDS + 1))
SETTLE_ROUNDS = 60


def _settled_sql(i: int) -> str:
    """One round in which the months that have settled stay as they are."""
    step = _round_sql(i).replace(f"r{i} AS MATERIALIZED", f"t{i} AS MATERIALIZED")
    return step + f""", s{i} AS MATERIALIZED (
  SELECT t.network_month, coalesce(max(x.done), false) OR sum(abs(t.r - p.r)) < max(p.n) * 1e-6 AS done FROM t{i} t JOIN r{i - 1} p USING (network_month, node)
  LEFT JOIN {f's{i - 1}' if i > 1 else '(SELECT NULL::DATE AS network_month, false AS done)'} x ON x.network_month = t.network_month GROUP BY t.network_month
), r{i} AS MATERIALIZED (
  SELECT p.network_month, p.node, p.n, CASE WHEN coalesce(x.done, false) THEN p.r ELSE t.r END AS r FROM r{i - 1} p JOIN t{i} t USING (network_month, node)
  LEFT JOIN {f's{i - 1}' if i > 1 else '(SELECT NULL::DATE AS network_month, false AS done)'} x ON x.network_month = p.network_month
)"""


SETTLED_SQL = ",".join(_settled_sql(i) for i in range(1, SETTLE_ROUNDS + 1))


def month_edges(spark, sf_dir):
    return G.monthly_edges(labelled_flights(spark, sf_dir, "FlightDate", "Origin", "Dest"))


@query("monthly_edges", "GR1 AG12", sql_with(RAW_SQL, EDGES_SQL, body="SELECT * FROM edges"))
def monthly_edges(spark, sf_dir):
    return month_edges(spark, sf_dir)


@query(
    "pagerank_fixed_rounds", "GR2",
    sql_with(RAW_SQL, EDGES_SQL, NODES_SQL, PAGERANK_SQL, body=f"SELECT network_month, node, round(r, 9) AS network_pagerank FROM r{ROUNDS}"),
)
def pagerank_fixed_rounds(spark, sf_dir):
    ranks = G.pagerank(month_edges(spark, sf_dir), rounds=ROUNDS)
    return ranks.withColumn("network_pagerank", F.round("network_pagerank", 9))


@query(
    "pagerank_converged", "GR2",
    sql_with(RAW_SQL, EDGES_SQL, NODES_SQL, SETTLED_SQL, body=f"SELECT network_month, node, round(r, 9) AS network_pagerank FROM r{SETTLE_ROUNDS}"),
)
def pagerank_converged(spark, sf_dir):
    ranks = G.pagerank(month_edges(spark, sf_dir))
    return ranks.withColumn("network_pagerank", F.round("network_pagerank", 9))


SHARES_SQL = """totals AS (SELECT network_month, greatest(sum(weight), 1) AS total FROM edges GROUP BY network_month
), shares AS (
  SELECT n.network_month, n.node, coalesce(o.w, 0) / t.total AS network_weighted_out_share, coalesce(i.w, 0) / t.total AS network_weighted_in_share
  FROM nodes n JOIN totals t USING (network_month)
  LEFT JOIN (SELECT network_month, src AS node, sum(weight) AS w FROM edges GROUP BY ALL) o USING (network_month, node)
  LEFT JOIN (SELECT network_month, dst AS node, sum(weight) AS w FROM edges GROUP BY ALL) i USING (network_month, node)
)"""


@query("network_shares", "GR4", sql_with(RAW_SQL, EDGES_SQL, NODES_SQL, SHARES_SQL, body="SELECT * FROM shares"))
def network_shares(spark, sf_dir):
    return G.shares(materialize(month_edges(spark, sf_dir), "edges"))


@query(
    "previous_month_shares", "GR5 JN5 SCL4",
    sql_with(RAW_SQL, EDGES_SQL, NODES_SQL, SHARES_SQL, body="""SELECT row_key, o.network_weighted_out_share AS origin_network_weighted_out_share,
      d.network_weighted_in_share AS destination_network_weighted_in_share FROM flights f
      LEFT JOIN shares o ON o.node = f."Origin" AND o.network_month + INTERVAL 1 MONTH = date_trunc('month', f."FlightDate")
      LEFT JOIN shares d ON d.node = f."Dest" AND d.network_month + INTERVAL 1 MONTH = date_trunc('month', f."FlightDate")"""),
)
def previous_month_shares(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "FlightDate", "Origin", "Dest").withColumn("flight_month", F.trunc("FlightDate", "MM"))
    # Edges and shares are small and read several times, so the flights are joined once for them.
    shares = G.shares(materialize(month_edges(spark, sf_dir), "edges"))
    lagged = materialize(shares.withColumn("flight_month", next_month_start(F.col("network_month"))).drop("network_month"), "shares")
    for role, prefix in (("Origin", "origin_"), ("Dest", "destination_")):
        df = joins.lookup_join(df, lagged, {"flight_month": "flight_month", role: "node"}, prefix)
    return df.select("row_key", "origin_network_weighted_out_share", "destination_network_weighted_in_share")


HOPS = 10


def _betweenness_sql(max_sources: int) -> str:
    """Shortest paths relaxed for a fixed number of hops, then path counts and dependencies hop by hop."""
    parts = [f"""sources AS MATERIALIZED (SELECT network_month AS m, node AS s FROM nodes
      QUALIFY row_number() OVER (PARTITION BY network_month ORDER BY md5(node || '-42'), node) <= {max_sources}
    ), hop AS MATERIALIZED (SELECT network_month AS m, src AS u, dst AS v, length FROM edges WHERE src <> dst
    ), b0 AS MATERIALIZED (SELECT m, s, s AS v, 0.0::DOUBLE AS d FROM sources)"""]
    for i in range(1, HOPS + 1):
        parts.append(f"""b{i} AS MATERIALIZED (SELECT m, s, v, min(d) AS d FROM (SELECT * FROM b{i - 1}
          UNION ALL SELECT b.m, b.s, h.v, b.d + h.length FROM b{i - 1} b JOIN hop h ON b.m = h.m AND b.v = h.u) GROUP BY m, s, v)""")
    parts.append(f"""tight AS MATERIALIZED (SELECT b.m, b.s, h.u, h.v FROM b{HOPS} b JOIN hop h ON b.m = h.m AND b.v = h.u
      JOIN b{HOPS} c ON c.m = b.m AND c.s = b.s AND c.v = h.v AND b.d + h.length = c.d
    ), w0 AS MATERIALIZED (SELECT m, s, s AS v, 1.0::DOUBLE AS x FROM sources)""")
    for i in range(1, HOPS + 1):
        parts.append(f"w{i} AS MATERIALIZED (SELECT t.m, t.s, t.v, sum(w.x) AS x FROM w{i - 1} w JOIN tight t ON t.m = w.m AND t.s = w.s AND t.u = w.v GROUP BY ALL)")
    every = lambda name, start: " UNION ALL ".join(f"SELECT * FROM {name}{i}" for i in range(start, HOPS + 1))
    parts.append(f"""paths AS MATERIALIZED (SELECT m, s, v, sum(x) AS x FROM ({every('w', 0)}) GROUP BY m, s, v
    ), parts AS MATERIALIZED (SELECT t.*, a.x / z.x AS part FROM tight t JOIN paths a ON a.m = t.m AND a.s = t.s AND a.v = t.u
      JOIN paths z ON z.m = t.m AND z.s = t.s AND z.v = t.v
    ), d1 AS MATERIALIZED (SELECT m, s, u AS v, sum(part) AS x FROM parts GROUP BY ALL)""")
    for i in range(2, HOPS + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT p.m, p.s, p.u AS v, sum(p.part * d.x) AS x FROM parts p JOIN d{i - 1} d ON d.m = p.m AND d.s = p.s AND d.v = p.v GROUP BY ALL)")
    parts.append(f"""summed AS (SELECT m, v, sum(x) AS x FROM ({every('d', 1)}) WHERE v <> s GROUP BY m, v
    ), picked AS (SELECT m, count(*) AS k FROM sources GROUP BY m
    ), central AS (SELECT n.network_month, n.node, round(coalesce(x, 0) * CASE WHEN n > 2 THEN n / k / ((n - 1) * (n - 2)) ELSE 1 END, 9) AS network_betweenness
      FROM nodes n JOIN picked p ON p.m = n.network_month LEFT JOIN summed s ON s.m = n.network_month AND s.v = n.node)""")
    return ",".join(parts)


@query("betweenness", "GR3", sql_with(RAW_SQL, EDGES_SQL, NODES_SQL, _betweenness_sql(75), body="SELECT * FROM central"))
def betweenness(spark, sf_dir):
    out = G.betweenness(month_edges(spark, sf_dir))
    return out.withColumn("network_betweenness", F.round("network_betweenness", 9))


@query("sampled_betweenness", "GR3", sql_with(RAW_SQL, EDGES_SQL, NODES_SQL, _betweenness_sql(10), body="SELECT * FROM central"))
def sampled_betweenness(spark, sf_dir):
    out = G.betweenness(month_edges(spark, sf_dir), max_sources=10)
    return out.withColumn("network_betweenness", F.round("network_betweenness", 9))


LAGGED_SQL = f"""lagged AS (
  SELECT CAST(s.network_month + INTERVAL 1 MONTH AS DATE) AS flight_month, s.node AS airport, round(r.r, 9) AS network_pagerank,
    c.network_betweenness, s.network_weighted_out_share, s.network_weighted_in_share
  FROM shares s JOIN r{SETTLE_ROUNDS} r ON r.network_month = s.network_month AND r.node = s.node
  JOIN central c ON c.network_month = s.network_month AND c.node = s.node
)"""
_LAGGED_PARTS = (EDGES_SQL, NODES_SQL, SETTLED_SQL, SHARES_SQL, _betweenness_sql(1_000_000_000), LAGGED_SQL)


def lagged(spark, sf_dir, flights=None):
    """All measures of a month, dated to the next one; stored, because each role looks them up."""
    measures = G.lagged_measures(month_edges(spark, sf_dir) if flights is None else G.monthly_edges(flights))
    rounded = {c: F.round(c, 9) for c in ("network_pagerank", "network_betweenness")}
    return materialize(measures.withColumns(rounded), "measures")


@query("lagged_network_measures", "GR5 JN5", sql_with(RAW_SQL, *_LAGGED_PARTS, body="SELECT * FROM lagged"))
def lagged_network_measures(spark, sf_dir):
    return lagged(spark, sf_dir)


_MEASURES = ["network_pagerank", "network_betweenness", "network_weighted_out_share", "network_weighted_in_share"]
_ENRICHED = ["row_key", "flight_date", "origin_airport", "destination_airport", "scheduled_duration_minutes", "origin_recent_delay_rate",
             "destination_recent_delay_rate", "route_recent_delay_rate", *[f"{p}_{m}" for p in ("origin", "destination") for m in _MEASURES],
             "origin_faa_hub_category", "destination_faa_hub_category", "arrival_delay_15min"]


@query(
    "enriched_sample", "JN3 JN4 JN5 JN6 GR5 TK6 PRJ1",
    sql_with(RAW_SQL, TRAILING_SQL, HUBS_SQL, *_LAGGED_PARTS, """chosen AS (
      SELECT * FROM flights WHERE primary_eligible = 1 ORDER BY md5(row_key || '-42') LIMIT 3000
    ), enriched AS (SELECT f.row_key, f."FlightDate" AS flight_date, f."Origin" AS origin_airport, f."Dest" AS destination_airport,
      CASE WHEN f."CRSElapsedTime" > 0 THEN CAST(f."CRSElapsedTime" AS DOUBLE) END AS scheduled_duration_minutes, t.origin_recent_delay_rate,
      t.destination_recent_delay_rate, t.route_recent_delay_rate, """ + ", ".join(f"{a}.{m} AS {p}_{m}" for p, a in (("origin", "lo"), ("destination", "ld")) for m in _MEASURES) + """,
      ho.faa_hub_category AS origin_faa_hub_category, hd.faa_hub_category AS destination_faa_hub_category, f."ArrDel15" AS arrival_delay_15min
      FROM chosen f LEFT JOIN rates t ON t."FlightDate" = f."FlightDate" AND t."Origin" = f."Origin" AND t."Dest" = f."Dest"
      LEFT JOIN lagged lo ON lo.flight_month = date_trunc('month', f."FlightDate") AND lo.airport = f."Origin"
      LEFT JOIN lagged ld ON ld.flight_month = date_trunc('month', f."FlightDate") AND ld.airport = f."Dest"
      LEFT JOIN hubs ho ON ho.airport = f."Origin" LEFT JOIN hubs hd ON hd.airport = f."Dest")""",
             body="SELECT * FROM enriched"),
)
def enriched_sample(spark, sf_dir):
    flights = materialize(
        eligible_flights(spark, sf_dir, "row_key", "FlightDate", "year", "Origin", "Dest", "CRSElapsedTime", "ArrDel15"), "flights"
    )
    sample = sampling.exact_sample(flights, 3000, "row_key", 42)
    hubs = materialize(P.hub_dimension(B.hub_classes(spark, sf_dir)).select("airport", "faa_hub_category"), "hubs")
    rates = materialize(history.trailing_features(flights), "rates")
    return P.enrich(sample, rates, lagged(spark, sf_dir), hubs).select(*_ENRICHED)


ROUTES_SQL = """routes AS (SELECT "Origin" AS src, "Dest" AS dst, CAST(count(*) AS DOUBLE) AS weight FROM flights WHERE primary_eligible = 1 AND "year" <= 1999 GROUP BY ALL)"""


def routes(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "Origin", "Dest", "year").where("year <= 1999")
    found = df.groupBy(F.col("Origin").alias("src"), F.col("Dest").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return materialize(found, "routes")  # one row per route, read by every normalisation


@query(
    "normalized_adjacency", "GR6",
    sql_with(RAW_SQL, ROUTES_SQL, body="""SELECT src, dst, weight, weight / greatest(sum(weight) OVER (PARTITION BY src), 1) AS out_share,
      weight / greatest(sum(weight) OVER (PARTITION BY dst), 1) AS in_share FROM routes"""),
)
def normalized_adjacency(spark, sf_dir):
    return G.normalized(G.normalized(routes(spark, sf_dir), "src", name="out_share"), "dst", name="in_share")


PROFILE_SQL = """fit AS (SELECT * REPLACE (CASE WHEN "CRSElapsedTime" > 0 THEN "CRSElapsedTime" END AS "CRSElapsedTime") FROM flights
  WHERE primary_eligible = 1 AND "year" <= 1999
), profile AS (
  SELECT * FROM (SELECT "Origin" AS node, count(*) AS out_flights, avg("ArrDel15") AS out_delay_rate, count(DISTINCT "Dest") AS out_unique_neighbors,
    avg("CRSElapsedTime") AS out_mean_duration FROM fit GROUP BY "Origin")
  FULL JOIN (SELECT "Dest" AS node, count(*) AS in_flights, avg("ArrDel15") AS in_delay_rate, count(DISTINCT "Origin") AS in_unique_neighbors,
    avg("CRSElapsedTime") AS in_mean_duration FROM fit GROUP BY "Dest") USING (node)
)"""
_COUNTS, _OTHERS = ["out_flights", "in_flights"], [
    "out_delay_rate", "out_unique_neighbors", "out_mean_duration", "in_delay_rate", "in_unique_neighbors", "in_mean_duration"]


def profile(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "Origin", "Dest", "year", "ArrDel15", "CRSElapsedTime").where(
        "year <= 1999"
    ).withColumn("CRSElapsedTime", positive_or_null(F.col("CRSElapsedTime")))
    return G.node_profile(df, "Origin", "Dest", "ArrDel15", "CRSElapsedTime")


@query("node_profile", "AG16 JN9", sql_with(RAW_SQL, PROFILE_SQL, body="SELECT * FROM profile"))
def node_profile(spark, sf_dir):
    return profile(spark, sf_dir)


_logged = [f"ln(1 + {c})" if c in _COUNTS else c for c in [*_COUNTS, *_OTHERS]]
SCALED_SQL = "logged AS (SELECT node, " + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for x, c in zip(_logged, [*_COUNTS, *_OTHERS])) + """ FROM profile
), imputed AS (SELECT node, """ + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM logged), 0) AS {c}" for c in [*_COUNTS, *_OTHERS]) + """ FROM logged
), scaled AS (SELECT node, """ + ", ".join(
    f"({c} - avg({c}) OVER ()) / greatest(stddev_pop({c}) OVER (), 1e-6) AS {c}" for c in [*_COUNTS, *_OTHERS]) + " FROM imputed)"


@query("standardized_nodes", "GR8", sql_with(RAW_SQL, PROFILE_SQL, SCALED_SQL, body="SELECT node, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in [*_COUNTS, *_OTHERS]) + " FROM scaled"))
def standardized_nodes(spark, sf_dir):
    scaled = G.standardize_nodes(profile(spark, sf_dir), _COUNTS, _OTHERS)
    return scaled.select("node", *[F.round(c, 6).alias(c) for c in [*_COUNTS, *_OTHERS]])


@query(
    "neighbour_features", "GR7",
    sql_with(RAW_SQL, ROUTES_SQL, PROFILE_SQL, SCALED_SQL, body="""SELECT src AS node, round(sum(share * out_delay_rate), 6) AS neighbour_out_delay_rate,
      round(sum(share * in_flights), 6) AS neighbour_in_flights FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY src) AS share FROM routes)
      JOIN scaled ON dst = node GROUP BY src"""),
)
def neighbour_features(spark, sf_dir):
    scaled = G.standardize_nodes(profile(spark, sf_dir), _COUNTS, _OTHERS)
    out = G.neighbour_mean(routes(spark, sf_dir), scaled, ["out_delay_rate", "in_flights"])
    return out.select("node", *[F.round(c, 6).alias(c) for c in out.columns[1:]])
