"""Stress levels of edges and nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.operators import streets as st
from kerbflow.rules import street_rules as sr
from kerbflow.rules.conditions import condition_sql
from kerbflow.rules.stress_tables import SPEED_BANDS, TABLES, StressTable, SubTable

NODE_MESSAGES = {
    "missing": "Node not found in edges",
    "max": "Node LTS is max intersecting LTS",
    "signals": "LTS 3-4 with traffic signals",
    "calm": "LTS 1-2 with traffic signals or stop",
}


def separation_lts(edges: DataFrame) -> DataFrame:
    """A separated lane caps the stress of its direction at 1, flexible posts at 2."""
    def cap(way: str) -> Column:
        kind = F.col(f"separation_{way}")
        return F.when(kind.isin("true", "yes", "kerb", "bump"), 1).when(kind == "flex_post", 2)

    return edges.withColumns({f"LTS_separation_{way}": cap(way) for way in st.WAYS})


def _band_sql() -> str:
    """SQL of the 1-based speed band, NULL outside and on a boundary."""
    lows = [0.0, *SPEED_BANDS[:-1]]
    arms = " ".join(f"WHEN speed > {lo}D AND speed < {hi}D THEN {i}"
                    for i, (lo, hi) in enumerate(zip(lows, SPEED_BANDS), 1))
    return f"CASE {arms} END"


def _bucket_sql(name: str, part: SubTable) -> str:
    arms = [f"WHEN {name} >= {lo}" + ("" if hi is None else f" AND {name} < {hi}") + f" THEN {i}"
            for i, (lo, hi) in enumerate(part.buckets)]
    return f"CASE {' '.join(arms)} END"


def _needs_sql(table: StressTable, way: str) -> str:
    def literal(value: object) -> str:
        return str(value).lower() if isinstance(value, bool) else f"'{value}'"

    return " AND ".join(f"coalesce({name.format(way=way)} = {literal(value)}, false)" for name, value in table.needs)


def table_stress(edges: DataFrame, tables: tuple[StressTable, ...] = TABLES) -> DataFrame:
    """Stress of every sub-table and direction, and per table the lowest of its sub-tables.

    The band and the street layout are found once; the cell is then an array lookup, so no table is joined.
    """
    known = set(edges.columns)
    layout = {"_band": F.expr(_band_sql())}
    for t in tables:
        for p in t.parts:
            layout[f"_at_{p.name}"] = F.expr(" OR ".join(condition_sql(c, known) for c in p.conditions))
    cells: dict[str, Column] = {}
    for t in tables:
        for p in t.parts:
            grid = ", ".join(str(level) for row in p.levels for level in row)
            for way in st.WAYS:
                bucket = _bucket_sql(t.bucket_column.format(way=way), p)
                cells[f"LTS_{p.name}_{way}"] = F.expr(
                    f"if(_at_{p.name} AND {_needs_sql(t, way)}, "
                    f"get(array({grid}), {bucket} * {len(SPEED_BANDS)} + _band - 1), null)")
    return edges.withColumns(layout).withColumns(cells).drop(*layout).withColumns({
        f"LTS_{t.name}_{way}": _least([f"LTS_{p.name}_{way}" for p in t.parts])
        for t in tables for way in st.WAYS})


def _least(names: list[str]) -> Column:
    return F.least(*names) if len(names) > 1 else F.col(names[0])


def table_hits(edges: DataFrame, tables: tuple[StressTable, ...] = TABLES) -> DataFrame:
    """Table-hit log: edges per matched (sub-table, direction, condition, bucket, band)."""
    known = set(edges.columns)
    items = []
    for t in tables:
        for p in t.parts:
            for way in st.WAYS:
                bucket = _bucket_sql(t.bucket_column.format(way=way), p)
                for i, condition in enumerate(p.conditions, 1):
                    hit = (f"{condition_sql(condition, known)} AND {_needs_sql(t, way)} "
                           f"AND _band IS NOT NULL AND ({bucket}) IS NOT NULL")
                    items.append(f"if({hit}, struct('{p.name}' AS sub_table, '{way}' AS way, {i} AS condition, "
                                 f"{bucket} AS bucket, _band AS band), null)")
    hits = edges.withColumn("_band", F.expr(_band_sql())).select(
        F.explode(F.expr(f"array_compact(array({', '.join(items)}))")).alias("h"))
    return hits.groupBy("h.sub_table", "h.way", "h.condition", "h.bucket", "h.band").agg(F.count(F.lit(1)).alias("n"))


def combine_lts(edges: DataFrame) -> DataFrame:
    """Per direction the lowest stress of all sources, then the higher of the two directions."""
    lows = {}
    for way in st.WAYS:
        names = [c for c in edges.columns if c.startswith("LTS_") and c.endswith(f"_{way}") and c != f"LTS_{way}"]
        lows[f"LTS_{way}"] = _least(names)
    return st.settled(edges, lows).withColumn("LTS", F.greatest("LTS_fwd", "LTS_rev"))


def node_lts(nodes: DataFrame, edges: DataFrame, both_ends: bool = False) -> DataFrame:
    """Stress of an intersection: the highest of its outgoing edges, lowered by signals and stop signs.

    ``edges`` is reduced to one row per node before it meets the nodes.
    """
    ends = edges.select(F.col("u").alias("osmid"), "LTS")
    if both_ends:
        ends = ends.unionByName(edges.select(F.col("v").alias("osmid"), "LTS"))
    worst = ends.groupBy("osmid").agg(F.coalesce(F.max("LTS"), F.lit(0)).alias("_max"))
    joined = nodes.join(worst, "osmid", "left")
    top, control = F.col("_max"), F.col("highway")
    signals = F.coalesce((top > 2) & (control == "traffic_signals"), F.lit(False))
    calm = F.coalesce((top <= 2) & control.isin("traffic_signals", "stop"), F.lit(False))
    return joined.select(
        *nodes.columns,
        F.when(signals, 2).when(calm, 1).otherwise(top).cast("int").alias("LTS"),
        F.when(top.isNull(), NODE_MESSAGES["missing"]).when(signals, NODE_MESSAGES["signals"])
        .when(calm, NODE_MESSAGES["calm"]).otherwise(NODE_MESSAGES["max"]).alias("message"))


def union_regions(frames: dict[str, DataFrame]) -> DataFrame:
    """Edge tables of several regions, whose tag columns may differ, with the region's name."""
    tagged = [df.withColumn("region", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
