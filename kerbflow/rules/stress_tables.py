"""Stress lookup tables: street layout, bucket of a width or traffic value, speed band → stress 1-4."""

from __future__ import annotations

from dataclasses import dataclass

from kerbflow.rules.conditions import Condition, tag

lane_count, oneway = tag("lane_count"), tag("oneway")
centerline, width_class = tag("centerline"), tag("street_narrow_wide")
TWO_WAY, ONE_WAY = oneway == 0, oneway == 1

# Upper end of each speed band in mph. Bands are open at both ends and the first starts at 0,
# so a speed of 0 or a speed on a boundary belongs to none.
SPEED_BANDS = [23.5, 28.5, 33.5, 38.5, 43.5, 48.5, 100.0]


@dataclass(frozen=True)
class SubTable:
    name: str
    conditions: tuple[Condition, ...]
    buckets: tuple[tuple[float, float | None], ...]
    levels: tuple[tuple[int, ...], ...]


@dataclass(frozen=True)
class StressTable:
    name: str
    bucket_column: str  # may contain {way}
    needs: tuple[tuple[str, object], ...]  # (column with {way}, value)
    parts: tuple[SubTable, ...]


# The published stress tables, version 2.2. Rows follow the buckets, columns the speed bands.
TABLES = (
    StressTable(
        "mixed", "ADT", (("bike_allowed_{way}", True),),
        (
            SubTable(
                "mixed_1",
                ((centerline == "no") & (lane_count == 2) & TWO_WAY, (centerline == "no") & (lane_count == 1) & TWO_WAY),
                ((0, 751), (751, 1501), (1501, 3001), (3001, None)),
                ((1, 1, 2, 2, 3, 3, 3), (1, 1, 2, 3, 3, 3, 3), (2, 2, 2, 3, 3, 4, 4), (2, 2, 3, 3, 4, 4, 4)),
            ),
            SubTable(
                "mixed_2",
                ((centerline == "yes") & (lane_count == 2) & TWO_WAY,
                 (width_class == "wide") & (lane_count == 1) & ONE_WAY),
                ((0, 1001), (1001, 1501), (1501, None)),
                ((1, 1, 2, 2, 3, 3, 3), (2, 2, 2, 3, 3, 4, 4), (2, 3, 3, 3, 4, 4, 4)),
            ),
            SubTable(
                "mixed_3",
                ((width_class == "narrow") & (lane_count == 1) & ONE_WAY,),
                ((0, 601), (601, 1001), (1001, None)),
                ((1, 1, 2, 2, 3, 3, 3), (2, 2, 2, 3, 3, 4, 4), (2, 3, 3, 3, 4, 4, 4)),
            ),
            SubTable(
                "mixed_4",
                ((lane_count == 3) & TWO_WAY, (lane_count == 4) & TWO_WAY, (lane_count >= 2) & ONE_WAY),
                ((0, 8001), (8001, None)),
                ((3, 3, 3, 3, 4, 4, 4), (3, 3, 4, 4, 4, 4, 4)),
            ),
            SubTable("mixed_5", (lane_count > 4,), ((0, None),), ((3, 3, 4, 4, 4, 4, 4),)),
        ),
    ),
    StressTable(
        "bikelane_noparking", "bike_width_{way}", (("bike_lane_{way}", True), ("parking_{way}", "no")),
        (
            SubTable(
                "bikelane_noparking_1",
                ((lane_count == 2) & TWO_WAY, (lane_count == 1) & ONE_WAY),
                ((6, None), (0, 6)),
                ((1, 1, 1, 2, 3, 3, 3), (2, 2, 2, 2, 3, 3, 4)),
            ),
            SubTable(
                "bikelane_noparking_2",
                ((lane_count == 4) & TWO_WAY, (lane_count == 3) & TWO_WAY, (lane_count == 2) & ONE_WAY),
                ((6, None), (0, 6)),
                ((2, 2, 2, 2, 3, 3, 3), (2, 2, 2, 2, 3, 4, 4)),
            ),
            SubTable(
                "bikelane_noparking_3",
                ((lane_count > 4) & TWO_WAY, (lane_count >= 3) & ONE_WAY),
                ((0, None),),
                ((3, 3, 3, 3, 4, 4, 4),),
            ),
        ),
    ),
    StressTable(
        "bikelane_yesparking", "bike_reach_{way}", (("bike_lane_{way}", True), ("parking_{way}", "yes")),
        (
            SubTable(
                "bikelane_yesparking_1",
                ((lane_count == 2) & TWO_WAY,),
                ((15, None), (12, 15)),
                ((1, 1, 2, 2, 3, 3, 3), (2, 2, 2, 3, 3, 3, 3)),
            ),
            SubTable(
                "bikelane_yesparking_2",
                ((lane_count >= 2) & ONE_WAY,),
                ((15, None), (12, 15)),
                ((2, 2, 3, 3, 3, 3, 3), (3, 3, 3, 3, 3, 3, 3)),
            ),
            SubTable(
                "bikelane_yesparking_3",
                ((lane_count == 4) & TWO_WAY, (lane_count == 3) & TWO_WAY),
                ((15, None), (12, 15)),
                ((2, 2, 3, 3, 3, 3, 3), (3, 3, 3, 3, 3, 3, 3)),
            ),
            SubTable("bikelane_yesparking_4", ((lane_count >= 4) & TWO_WAY,), ((12, None),), ((3, 3, 3, 3, 3, 3, 3),)),
        ),
    ),
)
