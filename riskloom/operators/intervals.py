"""Hazard products: spatial matching and expansion into hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.catalog import HAZARD_GROUPS, HAZARD_SIGNIFICANCE
from riskloom.functions.temporal import ceil_hour, floor_hour, parse_compact
from riskloom.functions.values import lookup
from riskloom.operators.joins import broadcast_if_small
from riskloom.session import fan_out, materialize


def clean_intervals(df: DataFrame) -> DataFrame:
    """Parse bounds and codes; drop rows without both bounds or with them reversed."""
    return (
        df.withColumns({"issued": parse_compact(F.col("ISSUED")), "expired": parse_compact(F.col("EXPIRED"))})
        .dropna(subset=["issued", "expired"])
        .where(F.col("expired") >= F.col("issued"))
        .withColumns(
            {
                "hazard_group": lookup(F.col("PHENOM"), HAZARD_GROUPS, F.lit("other")),
                "severity": lookup(F.col("SIG"), HAZARD_SIGNIFICANCE, F.lit(0)),
            }
        )
    )


def ring_sides(rings: Column) -> Column:
    """All sides of closed rings, as structs of their ends ``a`` and ``b``."""
    following = lambda ring: F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.flatten(
        F.transform(rings, lambda ring: F.zip_with(ring, following(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    )


def within_sides(x: Column, y: Column, sides: Column) -> Column:
    """Even-odd test of a point against sides; the boundary is outside."""

    def touches(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        on_line = (bx - ax) * (y - ay) == (by - ay) * (x - ax)
        return on_line & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    def crosses(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        straddles = (ay > y) != (by > y)
        return straddles & (x < ax + F.try_divide((bx - ax) * (y - ay), by - ay))

    return ~F.exists(sides, touches) & (F.size(F.filter(sides, crosses)) % 2 == 1)


def strictly_inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd test of a point against closed rings; the boundary is outside.

    ``rings`` is an array of rings, each an array of ``(x, y)`` structs, so
    holes and several parts need no extra treatment.
    """
    return within_sides(x, y, ring_sides(rings))


def grid_cell(value: Column, cell: float) -> Column:
    return F.floor(value / cell).cast("int")


def covering_cells(polygons: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """``(key, _cx, _cy, _whole)``: the grid cells a polygon shares points with.

    ``_whole`` marks a cell that lies inside as a whole: no side passes through it, and its
    middle is inside. Cells outside are left out. A polygon's cells are found in
    its own task, and only numbers leave it, no rings.
    """
    at = lambda value: grid_cell(value, cell)
    low, high = (lambda s, axis: F.least(s["a"][axis], s["b"][axis])), (lambda s, axis: F.greatest(s["a"][axis], s["b"][axis]))
    spans = polygons.select(key, ring_sides(F.col(rings)).alias("_sides")).select(
        key, "_sides",
        F.transform("_sides", lambda s: F.struct(
            at(low(s, "x")).alias("x0"), at(high(s, "x")).alias("x1"), at(low(s, "y")).alias("y0"), at(high(s, "y")).alias("y1"),
            s["a"].alias("a"), (s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy"),
        )).alias("_spans"),
    )
    edge = lambda pick, name: pick(F.transform("_spans", lambda s: s[name]))
    rows = spans.where(F.size("_sides") > 0).select(
        key, "_sides", "_spans", F.sequence(edge(F.array_min, "y0"), edge(F.array_max, "y1")).alias("_rows"),
        F.explode(F.sequence(edge(F.array_min, "x0"), edge(F.array_max, "x1"))).alias("_cx"),
    )
    # Only the sides over a column of cells can pass through them.
    over = F.filter("_spans", lambda s: F.col("_cx").between(s["x0"], s["x1"]))
    middle = lambda index: (index + 0.5) * cell
    # A side misses a cell when all corners lie on one side of it; the millionth covers rounding.
    reach = cell * (0.5 + 1e-6)
    off = lambda s, cy: s["dx"] * (middle(cy) - s["a"]["y"]) - s["dy"] * (middle(F.col("_cx")) - s["a"]["x"])
    passes = lambda s, cy: cy.between(s["y0"], s["y1"]) & (F.abs(off(s, cy)) <= reach * (F.abs(s["dx"]) + F.abs(s["dy"])))
    marked = rows.withColumn("_over", over).select(key, "_cx", F.inline(F.transform("_rows", lambda cy: F.struct(
        cy.alias("_cy"),
        F.when(~F.exists("_over", lambda s: passes(s, cy)),
               within_sides(middle(F.col("_cx")), middle(cy), F.col("_sides"))).alias("_inside"),
    ))))
    return marked.where(F.coalesce("_inside", F.lit(True))).select(key, "_cx", "_cy", F.col("_inside").isNotNull().alias("_whole"))


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, x: str = "longitude", y: str = "latitude", rings: str = "rings",
    cell: float = 1.0,
) -> DataFrame:
    """Inner join of points with the polygons they lie strictly inside.

    Polygons become numbered grid cells, which meet the points of the same cell. A cell that lies
    inside as a whole accepts its points without a test; points of the other cells are tested
    against the rings, which are attached once per surviving pair. Points without finite
    coordinates and polygons without rings match nothing.
    """
    numbered = materialize(polygons.withColumn("_polygon", F.monotonically_increasing_id()), "polygons")
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    placed = points.where(finite).withColumns({"_px": grid_cell(F.col(x), cell), "_py": grid_cell(F.col(y), cell)})
    cells = covering_cells(numbered, "_polygon", rings, cell).withColumnRenamed("_polygon", "_of")
    pairs = cells.join(broadcast_if_small(placed), (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py")))
    attached = pairs.join(numbered, F.col("_of") == F.col("_polygon"))
    inside = attached.where(F.col("_whole") | strictly_inside(F.col(x), F.col(y), F.col(rings)))
    return inside.select(*points.columns, *[c for c in polygons.columns if c != rings])


def hours_between(start: Column, end: Column) -> Column:
    """Array of hours from start to end inclusive; NULL if they are reversed or missing."""
    return F.when(start <= end, F.sequence(start, F.greatest(start, end), F.expr("INTERVAL 1 HOUR")))


def lead_bounds(lead_hours: int = 24) -> dict[str, Column]:
    """First usable hour, and the last hour of the forecast and of the active span."""
    lead = F.expr(f"INTERVAL {int(lead_hours)} HOURS")
    return {
        "first_hour": ceil_hour(F.col("issued") + lead),
        "forecast_end": floor_hour(F.col("expired")),
        "active_end": floor_hour(F.col("expired") + lead),
    }


def expand_hours(df: DataFrame, keep: Sequence[str], lead_hours: int = 24) -> DataFrame:
    """Hourly rows of both spans as a union, flagged by the span they come from."""
    bounded = fan_out(df.withColumns(lead_bounds(lead_hours)).select(*keep, "first_hour", "forecast_end", "active_end"))

    def span(end: str, forecast: int) -> DataFrame:
        return bounded.select(
            *keep,
            F.explode(hours_between(F.col("first_hour"), F.col(end))).alias("utc_hour"),
            F.lit(forecast).alias("hazard_forecast"),
            F.lit(1 - forecast).alias("hazard_active_at_prediction"),
        )

    return span("forecast_end", 1).unionByName(span("active_end", 0))


def hazard_hours(df: DataFrame, airport: str = "airport", lead_hours: int = 24) -> DataFrame:
    """One row per airport and hour with hazard flags and the highest severity.

    Both spans start at the same hour and the active one ends no earlier. Spans are not turned
    into hours one by one: starts and ends are counted by airport, hour and what they stand for (a severity
    while active, a group while forecast), and running sums of these counts tell which hours are
    covered. Windows and hours are bounded by the calendar, however many spans overlap.
    """
    spans = df.withColumns(lead_bounds(lead_hours)).where("first_hour <= active_end")
    forecast = F.col("first_hour") <= F.col("forecast_end")
    after = lambda end: F.col(end) + F.expr("INTERVAL 1 HOUR")

    def edge(is_forecast: bool, hour: Column, count) -> Column:
        group, severity = ("hazard_group", None) if is_forecast else (None, "severity")
        typed = lambda c, name: F.col(c) if c else F.lit(None).cast(df.schema[name].dataType)
        return F.struct(
            F.lit(is_forecast).alias("_forecast"), typed(group, "hazard_group").alias("_group"), typed(severity, "severity").alias("_severity"),
            hour.alias("_hour"), count.alias("_change"),
        )

    one, with_forecast = F.lit(1).cast("bigint"), F.when(forecast, 1).otherwise(0).cast("bigint")
    edges = F.array(
        edge(False, F.col("first_hour"), one), edge(False, after("active_end"), -one),
        edge(True, F.col("first_hour"), with_forecast), edge(True, after("forecast_end"), -with_forecast),
    )
    keys = ["_airport", "_forecast", "_group", "_severity"]
    changes = spans.select(F.col(airport).alias("_airport"), F.inline(edges)).groupBy(*keys, "_hour").agg(F.sum("_change").alias("_change"))
    ordered = W.partitionBy(*keys).orderBy("_hour")
    covered = changes.where("_change <> 0").select(
        *keys, "_hour", F.sum("_change").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_open"),
        F.lead("_hour").over(ordered).alias("_next"),
    ).where("_open > 0")
    last = F.col("_next") - F.expr("INTERVAL 1 HOUR")
    hours = covered.select(*keys, F.explode(hours_between(F.col("_hour"), last)).alias("utc_hour"))
    in_group = lambda group: F.max(F.when(F.col("_forecast") & (F.col("_group") == group), 1).otherwise(0))
    return hours.groupBy(F.col("_airport").alias(airport), "utc_hour").agg(
        F.max(F.col("_forecast").cast("int")).alias("hazard_forecast_any"),
        F.lit(1).alias("hazard_active_at_prediction"),
        F.max("_severity").alias("hazard_max_severity"),
        *[in_group(g).alias(f"hazard_{g}") for g in sorted(set(HAZARD_GROUPS.values()))],
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df
