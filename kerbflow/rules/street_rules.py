"""Rule sets for street tags: assumed values and the reading of cycle-lane tags.

Each rule set is an ordered list; the order is the priority. The values are the published rating scheme's
and are fixed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from kerbflow.rules.conditions import Condition, tag

OSM, MAPPED, ASSUMED, NONE = "OSM", "OSM mapped", "Assumed", "_"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: Condition
    value: object
    message: str = ASSUMED


@dataclass(frozen=True)
class LaneRule:
    """Sets targets of travel direction; a ``Source`` copies another column, missing values fall through."""

    rule_id: str
    condition: Condition
    sets: dict[str, object] = field(default_factory=dict)
    lts: int | None = None


@dataclass(frozen=True)
class Source:
    column: str


highway, bicycle, oneway, footway = tag("highway"), tag("bicycle"), tag("oneway"), tag("footway")
lane_count, centerline, width_class = tag("lane_count"), tag("centerline"), tag("street_narrow_wide")

# --- fixed values: parking tags (tag with {side} = both, left or right; value; parking; message) ------------
PARKING_TAGS = [
    ("parking1", "parking:{side}", "no", "no", OSM),
    ("parking2", "parking:{side}", "lane", "yes", OSM),
    ("parking3", "parking:{side}", "street_side", "yes", OSM),
    ("parking4", "parking:{side}", "separate", "yes", MAPPED),
    ("parking5", "parking:{side}:orientation", "parallel", "yes", OSM),
    ("parking6", "parking:condition:{side}", "no_parking", "no", OSM),
    ("parking7", "parking:condition:{side}", "no_stopping", "no", OSM),
    ("parking8", "parking:lane:{side}", "no", "no", OSM),
    ("parking9", "parking:lane:{side}", "no_stopping", "no", OSM),
    ("parking10", "parking:lane:{side}", "parallel", "yes", OSM),
    ("parking11", "parking:condition:{side}", "ticket;residents", "yes", OSM),
]
PARKING_WIDTH_FT = 8.5

# --- fixed values: assumed speed (mph) by road class --------------------------------------------------------
SPEEDS = {
    "primary": 35, "primary_link": 35, "trunk": 50, "trunk_link": 50, "secondary": 30, "residential": 25,
    "footway": 15, "unclassified": 40, "service": 30, "tertiary": 25, "tertiary_link": 25, "living_street": 20,
}

# --- fixed values: centerline by marking tag, then by road class --------------------------------------------
CENTERLINE_TAG = {"yes": "yes", "no": "no"}
CENTERLINE_CLASS = {
    "primary": "yes", "primary_link": "yes", "trunk": "yes", "trunk_link": "yes", "secondary": "yes",
    "residential": "no", "footway": "no", "unclassified": "no", "service": "no", "tertiary": "no",
    "tertiary_link": "no", "living_street": "no", "cycleway": "no",
}

ADT_DEFAULT, ZOOM_DEFAULT, LANES_DEFAULT, BIKE_WIDTH_DEFAULT = 1500, 16, 2, 5.0


def parking_rules(side: str) -> list[Rule]:
    """Rules deciding one side: the ``both`` tag of a rule comes before its own side's tag."""
    return [
        Rule(rule_id, tag(template.format(side=which)) == value, parking, message)
        for rule_id, template, value, parking, message in PARKING_TAGS
        for which in ("both", side)
    ]


def speed_rules() -> list[Rule]:
    return [Rule(f"speed{i}", highway == kind, mph) for i, (kind, mph) in enumerate(SPEEDS.items(), 1)]


def centerline_rules() -> list[Rule]:
    marked = [(tag("lane_markings") == t, v, OSM) for t, v in CENTERLINE_TAG.items()]
    by_class = [(highway == kind, v, ASSUMED) for kind, v in CENTERLINE_CLASS.items()]
    return [Rule(f"centerline{i}", c, v, msg) for i, (c, v, msg) in enumerate(marked + by_class, 1)]


def adt_rules() -> list[Rule]:
    """Average daily traffic."""
    narrow, wide = width_class == "narrow", width_class == "wide"
    single, multi = lane_count == 1, lane_count >= 2
    residential, secondary = highway == "residential", highway == "secondary"
    tertiary = highway.one_of("tertiary", "tertiary_link")
    # fixed values: rule id, condition, vehicles per day
    table = [
        ("ADT00", lane_count >= 3, 8001),
        ("ADT01", highway.one_of("trunk", "trunk_link"), 8001),
        ("ADT02", highway.one_of("primary", "primary_link"), 3001),
        ("ADT03", multi & (oneway == 1), 3001),
        ("ADT10", highway == "footway", 10),
        ("ADT11", highway == "service", 100),
        ("ADT12", highway == "cycleway", 10),
        ("ADT20", residential & narrow, 601),
        ("ADT21", residential & wide, 1001),
        ("ADT22", residential & single, 599),
        ("ADT23", residential & multi & (centerline == "no"), 1501),
        ("ADT24", residential & multi & (centerline == "yes"), 2501),
        ("ADT29", residential, 1001),
        ("ADT30", secondary & narrow, 1001),
        ("ADT31", secondary & wide, 1501),
        ("ADT32", secondary & single, 1501),
        ("ADT33", secondary & multi, 3001),
        ("ADT39", secondary, 3001),
        ("ADT40", tertiary & narrow, 1001),
        ("ADT41", tertiary & wide, 1501),
        ("ADT42", tertiary & single, 1501),
        ("ADT43", tertiary & multi, 3001),
        ("ADT49", tertiary, 3001),
        ("ADT50", multi & (centerline == "yes"), 3001),
        ("ADT51", multi & (centerline == "no"), 3001),
        ("ADT52", single & narrow, 1001),
        ("ADT53", single & wide, 1501),
    ]
    return [Rule(rule_id, condition, adt) for rule_id, condition, adt in table]


def zoom_rules() -> list[Rule]:
    """First map zoom level a street is drawn at."""
    high = tag("LTS") > 3
    # fixed values: rule id, condition, zoom
    table = [
        ("zoom01", tag("cycleway:right") == "separate", 15),
        ("zoom02", tag("cycleway:left") == "separate", 15),
        ("zoom03", tag("cycleway:both") == "separate", 15),
        ("zoom04", tag("cycleway") == "separate", 15),
        ("zoom05", bicycle == "designated", 11),
        ("zoom10", (highway == "primary") & high, 13),
        ("zoom11", highway == "primary", 11),
        ("zoom12", highway == "primary_link", 13),
        ("zoom13", (highway == "trunk") & high, 13),
        ("zoom14", highway == "trunk", 11),
        ("zoom15", highway == "trunk_link", 13),
        ("zoom16", (highway == "motorway") & high, 13),
        ("zoom17", highway == "motorway", 11),
        ("zoom18", highway == "motorway_link", 13),
        ("zoom30", highway == "cycleway", 11),
        ("zoom32", highway == "secondary", 12),
        ("zoom33", highway == "secondary_link", 14),
        ("zoom35", highway == "tertiary", 13),
        ("zoom36", highway == "tertiary_link", 15),
        ("zoom38", highway == "residential", 14),
        ("zoom40", highway == "service", 15),
        ("zoom42", highway == "footway", 16),
        ("zoom44", highway == "pedestrian", 16),
    ]
    return [Rule(rule_id, condition, zoom, NONE) for rule_id, condition, zoom in table]


# --- reading lane tags ----------------------------------------------------------------------------------------

LANE_TARGETS = [
    f"{name}_{way}"
    for name in ("bike_allowed", "bike_lane", "parking", "parking_width", "buffer", "bike_width", "separation")
    for way in ("fwd", "rev")
]
# Tag groups the lane rules test.
RIDE_OK = ("yes", "designated")
RIDE_PERMITTED = ("yes", "designated", "permissive")
LANE_KINDS = ("yes", "lane", "track", "shared_lane")
NO_LANE_KINDS = ("no", "separate")
ROAD_CLASSES = ("residential", "living_street", "primary", "primary_link", "secondary", "secondary_link", "tertiary",
                "tertiary_link", "trunk", "trunk_link", "unclassified")
# First rule number of each (street one-way, tag's own direction against it?) block, and the
# travel direction the right and the left side then serve.
SIDE_BLOCKS = [
    (20, "two-way", False, "fwd", "rev"),
    (30, "two-way", True, "rev", "fwd"),
    (40, "forward", False, "fwd", "fwd"),
    (50, "forward", True, "rev", "rev"),
    (60, "backward", False, "rev", "fwd"),
    (70, "backward", True, "fwd", "fwd"),
]
STREET = {"two-way": oneway != 1, "forward": oneway == 1, "backward": oneway == -1}


def allowed(ok: bool, *ways: str) -> dict[str, object]:
    return {f"bike_allowed_{w}": ok for w in ways or ("fwd", "rev")}


def separated(ok: bool, *ways: str) -> dict[str, object]:
    return {f"separation_{w}": ok for w in ways or ("fwd", "rev")}


def side_lane(side: str, way: str) -> dict[str, object]:
    """A cycle lane on ``side`` used in direction ``way``: the side's features move to that direction."""
    return {
        f"bike_allowed_{way}": True,
        f"bike_lane_{way}": True,
        f"separation_{way}": Source(f"cycleway:{side}:separation"),
        f"parking_{way}": Source(f"parking_{side}"),
        f"parking_width_{way}": Source(f"parking_width_{side}"),
        f"buffer_{way}": Source(f"cycleway:{side}:buffer"),
        f"bike_width_{way}": Source(f"cycleway:{side}:width"),
    }


def no_lane(way: str, parking_side: str | None, parking_way: str = "fwd") -> dict[str, object]:
    sets: dict[str, object] = {f"bike_allowed_{way}": True, f"bike_lane_{way}": False, f"separation_{way}": False}
    if parking_side:
        sets[f"parking_{parking_way}"] = Source(f"parking_{parking_side}")
    return sets


def curb_parking(fwd_side: str, rev_side: str) -> dict[str, object]:
    return {"parking_fwd": Source(f"parking_{fwd_side}"), "parking_rev": Source(f"parking_{rev_side}")}


def side_rules() -> list[LaneRule]:
    """Lanes tagged per side, for every street direction and tag direction."""
    rules: list[LaneRule] = []
    for base, street, against, right_way, left_way in SIDE_BLOCKS:
        number = base
        for side, way in (("right", right_way), ("left", left_way)):
            kind, flow = tag(f"cycleway:{side}"), tag(f"cycleway:{side}:oneway")
            where = (flow == "-1" if against else flow != "-1") & STREET[street]
            rules.append(LaneRule(f"c{number}", kind.one_of(*LANE_KINDS) & where, side_lane(side, way)))
            # a track is separated even if its separation is not tagged
            rules.append(LaneRule(f"c{number + 1}", (kind == "track") & where, separated(True, way)))
            number += 2
        if base == 20:
            for number, side, way in ((24, "right", "fwd"), (25, "left", "rev")):
                where = (tag(f"cycleway:{side}:oneway") != "-1") & STREET[street]
                # the left side's parking is recorded as forward parking here too
                rules.append(LaneRule(f"c{number}", tag(f"cycleway:{side}").one_of(*NO_LANE_KINDS) & where,
                                      no_lane(way, side)))
        elif base == 40:
            rules.append(LaneRule("c44", tag("cycleway:right").one_of(*NO_LANE_KINDS) & STREET[street],
                                  no_lane("fwd", "right")))
        elif base == 50:
            shut: dict[str, object] = {"bike_allowed_rev": False, "bike_lane_rev": False}
            left = tag("cycleway:left")
            rules.append(LaneRule("c54", left.one_of(*NO_LANE_KINDS) & STREET[street], shut))
            # true for every one-way street: a tag always differs from one of the two values
            rules.append(LaneRule("c55", ((left != "yes") | (left != "lane")) & STREET[street], shut))
    return rules


def lane_rules() -> list[LaneRule]:
    ride_ok, not_ride_ok = bicycle.one_of(*RIDE_OK), bicycle.none_of(*RIDE_OK)
    permitted, not_permitted = bicycle.one_of(*RIDE_PERMITTED), bicycle.none_of(*RIDE_PERMITTED)
    path = highway.one_of("cycleway", "path")
    neither_way = (oneway != -1) & (oneway != 1)
    foot = highway == "footway"
    closed, open_apart = allowed(False), {**allowed(True), **separated(True)}
    mixed = {**allowed(True), **separated(False), **curb_parking("right", "left")}
    road = highway.one_of(*ROAD_CLASSES)
    no_access, service = tag("access") == "no", highway == "service"
    first = [
        LaneRule("c01", highway.one_of("proposed", "construction"), closed, 0),
        LaneRule("c02", ride_ok & (oneway == 1), allowed(True, "fwd")),
        LaneRule("c03", ride_ok & (oneway == -1), allowed(True, "rev")),
        LaneRule("c04", ride_ok & neither_way, allowed(True)),
        LaneRule("c05", (tag("cycleway") == "share_busway") & ride_ok, {}, 2),
        LaneRule("c06", bicycle.one_of("no", "dismount"), closed, 0),
        LaneRule("c07", no_access & not_ride_ok, closed, 0),
        LaneRule("c08", no_access & ride_ok, open_apart, 1),
        LaneRule("c09", path & (oneway == 1), {**allowed(True, "fwd"), **separated(True, "fwd")}, 1),
        LaneRule("c10", path & (oneway == -1), {**allowed(True, "rev"), **separated(True, "rev")}, 1),
        LaneRule("c11", path & neither_way, open_apart, 1),
        LaneRule("c12", foot & footway.none_of("crossing", "sidewalk", "traffic_island", "access_aisle"),
                 open_apart, 1),
        LaneRule("c13", tag("public_transport").one_of("platform", "platform_access") & not_ride_ok, closed, 0),
    ]
    last = [
        LaneRule("c100", (footway == "sidewalk") & not_permitted & foot, closed, 0),
        LaneRule("c101", (footway == "sidewalk") & not_permitted & (highway == "path"), closed, 0),
        LaneRule("c102", (footway == "crossing") & not_permitted & foot, closed, 0),
        LaneRule("c103", (tag("crossing") == "informal") & not_permitted & foot, closed, 0),
        LaneRule("c104", foot & (footway == "access_aisle") & not_permitted, closed, 0),
        LaneRule("c105", foot & (footway == "access_aisle") & permitted, open_apart, 1),
        LaneRule("c106", (tag("tunnel") == "yes") & not_permitted, closed, 0),
        LaneRule("c107", (tag("tunnel") == "building_passage") & not_permitted, closed, 0),
        LaneRule("c108", foot & (tag("foot") == "private") & not_permitted, closed, 0),
        LaneRule("c109", (tag("bus") == "designated") & not_permitted, closed, 0),
        LaneRule("c200", highway.one_of("motorway", "motorway_link"), closed, 0),
        LaneRule("c201", (highway == "pedestrian") & not_permitted, closed, 0),
        LaneRule("c202", highway == "pedestrian", open_apart, 1),
        LaneRule("c203", service & (tag("service") == "alley"), mixed, 2),
        LaneRule("c204", service & (tag("service") == "driveway"), mixed, 2),
        LaneRule("c205", service, mixed, 2),
        LaneRule("c206", highway == "track", allowed(True), 1),
        LaneRule("c210", road & (oneway == 1),
                 {"bike_allowed_fwd": True, "bike_allowed_rev": False, **curb_parking("right", "left")}),
        LaneRule("c211", road & (oneway == -1),
                 {"bike_allowed_fwd": False, "bike_allowed_rev": True, **curb_parking("left", "right")}),
        LaneRule("c212", road, {**allowed(True), **curb_parking("right", "left")}),
    ]
    return first + side_rules() + last
