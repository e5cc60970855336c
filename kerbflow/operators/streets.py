"""Street edges: tag folding, rule cascades, speeds, lanes, widths.

Everything here is row-local: one projection after another over the edge table, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbflow.functions import geo
from kerbflow.rules import street_rules as sr
from kerbflow.functions.skew import bucketed_row_number
from kerbflow.rules.conditions import Condition, compile_condition, condition_sql, describe, usable

SIDES, WAYS = ("left", "right"), ("fwd", "rev")
NOTE_FEET, NOTE_METRES, NOTE_NONE = "Converted ft-in to decimal feet", "Converted to feet", "No Width"

# Ways that are not part of the street network. A pattern matches anywhere in the tag.
EXCLUDED_HIGHWAYS = ("abandoned|bus_guideway|corridor|elevator|escalator|motor|planned|platform|proposed|"
                     "raceway|steps")
# Tags folded to both sides although they carry no side suffix, and swapped suffix pairs.
IMPLICIT_BOTH = ["cycleway", "cycleway:buffer", "cycleway:separation", "cycleway:width"]
SUFFIX_PAIRS = [(f"cycleway:{side}:{what}", f"cycleway:{what}:{side}")
                for what in ("buffer", "separation", "width") for side in SIDES]
# Columns the lane rules read; added as NULL where a region has no such tag.
LANE_COLUMNS = ["cycleway", *[f"cycleway:{side}{suffix}" for side in SIDES
                              for suffix in ("", ":oneway", ":separation", ":buffer", ":width")]]


def column(name: str) -> Column:
    return F.col(f"`{name}`") if ":" in name else F.col(name)


def with_missing(df: DataFrame, names: list[str], kind: str = "string") -> DataFrame:
    absent = {n: F.lit(None).cast(kind) for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters refer to by name instead of by their whole definition.

    A filter is normally moved below a projection by writing out the projected expressions. Across a chain
    of rule steps that copies every rule into the filter many times over. A one-row generator stops this for
    its own columns, while filters on other columns still reach the scan.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [column(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


# --- network ---------------------------------------------------------------------------------------------------

def street_filter(ways: DataFrame) -> DataFrame:
    """Ways of the street network; ``ways`` has a ``tags`` map. A missing tag never excludes a way."""
    def lacks(tag: str, pattern: str) -> Column:
        return F.coalesce(~F.try_element_at("tags", F.lit(tag)).rlike(pattern), F.lit(True))

    return ways.where(
        F.try_element_at("tags", F.lit("highway")).isNotNull()
        & lacks("highway", EXCLUDED_HIGHWAYS) & lacks("area", "yes") & lacks("access", "private")
        & lacks("service", "private") & lacks("service", "^parking_aisle$") & lacks("indoor", "yes"))


def census_filter(ways: DataFrame) -> DataFrame:
    """Ways of the tag census: no parking aisles, sidewalks only where cycling is tagged and not refused."""
    def tag(name: str) -> Column:
        return F.try_element_at("tags", F.lit(name))

    street = tag("highway").isNotNull() & ~tag("footway").eqNullSafe("sidewalk") & ~tag("service").eqNullSafe("parking_aisle")
    sidewalk = tag("footway").eqNullSafe("sidewalk") & F.coalesce(~tag("bicycle").isin("no", "dismount"), F.lit(False))
    return ways.where(street | sidewalk)


def tag_counts(ways: DataFrame) -> DataFrame:
    """How many ways carry each tag, most frequent first."""
    return ways.select(F.explode(F.map_keys("tags")).alias("tag")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def oneway_sign(tags: Column) -> Column:
    value = F.lower(F.try_element_at(tags, F.lit("oneway")))
    sign = F.when(value.isin("yes", "true", "1"), 1).when(value.isin("-1", "reverse"), -1)
    circular = F.try_element_at(tags, F.lit("junction")).isin("roundabout", "circular")
    return F.coalesce(sign, F.when(circular & value.isNull(), 1), F.lit(0)).cast("smallint")


def segmentize(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """One directed edge per consecutive node pair of a way, mirrored on two-way streets.

    ``ways``: ``way_id, nodes ARRAY<BIGINT>, tags``; ``nodes``: ``osmid, x, y``. A way tagged against its
    drawing order is turned round and becomes an ordinary one-way. Parallel edges of a node pair are
    numbered by way and position. Pairs are built inside the row from the node array; only the two
    coordinate lookups and the numbering shuffle.
    """
    sign = oneway_sign(F.col("tags"))
    turned = ways.withColumn("_sign", sign).withColumn(
        "_n", F.when(F.col("_sign") == -1, F.reverse("nodes")).otherwise(F.col("nodes")))
    pairs = turned.where(F.size("_n") >= 2).select(
        F.col("way_id").alias("osmid"), "tags", (F.col("_sign") != 0).alias("_one"),
        F.posexplode(F.zip_with(
            F.slice("_n", F.lit(1), F.size("_n") - 1), F.slice("_n", F.lit(2), F.size("_n") - 1),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("seq", "p"))
    forward = F.struct(F.col("p.a").alias("u"), F.col("p.b").alias("v"), F.lit(0).alias("back"))
    backward = F.struct(F.col("p.b").alias("u"), F.col("p.a").alias("v"), F.lit(1).alias("back"))
    directed = pairs.select(
        "osmid", "tags", "seq", F.when(F.col("_one"), 1).otherwise(0).cast("smallint").alias("oneway"),
        F.explode(F.when(F.col("_one"), F.array(forward)).otherwise(F.array(forward, backward))).alias("e"))
    edges = directed.select(F.col("e.u").alias("u"), F.col("e.v").alias("v"), "osmid", "oneway", "tags", "seq",
                            F.col("e.back").alias("back"))
    at_u = nodes.select(F.col("osmid").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    at_v = nodes.select(F.col("osmid").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    located = edges.join(at_u, "u").join(at_v, "v")
    length = geo.haversine_m(F.col("uy"), F.col("ux"), F.col("vy"), F.col("vx"), geo.RADIUS_SHAPE)
    point = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    # 64 ways share a bucket, so even a pair drawn by very many ways is numbered by several tasks
    keyed = bucketed_row_number(located, ["u", "v"], F.floor(F.col("osmid") / 64), ["osmid", "seq", "back"], "_k")
    return keyed.select("u", "v", (F.col("_k") - 1).alias("key"), "osmid", "oneway", length.alias("length"), "tags",
                        F.array(point("ux", "uy"), point("vx", "vy")).alias("geometry"))


def tag_columns(edges: DataFrame, names: list[str]) -> DataFrame:
    """Project the listed tags to columns; the rest stays in the map."""
    return edges.withColumns({n: F.try_element_at("tags", F.lit(n)) for n in names})


# --- tag folding -----------------------------------------------------------------------------------------------

def fold_both(edges: DataFrame) -> DataFrame:
    """Move ``both`` tags, and tags meaning both sides, to the left and right columns.

    A ``both`` value replaces a side's own. The unsuffixed tags come after and so win over both; swapped
    suffixes (``cycleway:buffer:left``) only fill gaps. Source columns are dropped.
    """
    values: dict[str, Column] = {}
    current = lambda n: values.get(n, column(n) if n in edges.columns else F.lit(None).cast("string"))
    drop: list[str] = []
    moves = [(c, c.replace("both", side)) for c in edges.columns if "both" in c for side in SIDES]
    moves += [(c, f"{c}:{side}") for c in IMPLICIT_BOTH if c in edges.columns for side in SIDES]
    for source, target in moves:
        values[target] = F.coalesce(current(source), current(target))
        drop.append(source)
    for target, source in SUFFIX_PAIRS:
        if source in edges.columns or source in values:
            values[target] = F.coalesce(current(target), current(source))
            drop.append(source)
    drop = list(dict.fromkeys(drop))
    kept = [c for c in edges.columns if c not in drop]
    added = [c for c in values if c not in edges.columns and c not in drop]
    return edges.select(*[current(c).alias(c) for c in kept], *[values[c].alias(c) for c in added])


# --- rule cascades ---------------------------------------------------------------------------------------------

def first_match(df: DataFrame, rules: list[sr.Rule], present: set[str] | None = None) -> str:
    """SQL of the 1-based number of the first matching rule, 0 if none."""
    known = set(df.columns)
    runs = usable([r.condition for r in rules], present)
    arms = [f"WHEN {condition_sql(r.condition, known)} THEN {i}"
            for i, (r, run) in enumerate(zip(rules, runs), 1) if run]
    return f"CASE {' '.join(arms)} ELSE 0 END" if arms else "0"


def lookup(items: list, win: str) -> Column:
    return F.element_at(F.lit(items), F.col(win) + 1)


def cascade(df: DataFrame, prefix: str, rules: list[sr.Rule], default: object, suffix: str = "",
            present: set[str] | None = None) -> DataFrame:
    """First match wins: the value, and the winner's number for :func:`provenance`."""
    win = f"{prefix}_win{suffix}"
    return settled(df, {win: F.expr(first_match(df, rules, present))}).withColumn(
        f"{prefix}{suffix}", lookup([default, *[r.value for r in rules]], win))


def provenance_columns(prefix: str, rules: list[sr.Rule], suffix: str = "",
                       default_message: str = sr.ASSUMED) -> dict[str, Column]:
    """Rule id, message and condition text of the winner."""
    win = f"{prefix}_win{suffix}"
    return {
        f"{prefix}_rule_num{suffix}": lookup([f"{prefix}_", *[r.rule_id for r in rules]], win),
        f"{prefix}_rule{suffix}": lookup([default_message, *[r.message for r in rules]], win),
        f"{prefix}_condition{suffix}": lookup(["default", *[describe(r.condition) for r in rules]], win),
    }


def apply_rules(df: DataFrame, prefix: str, rules: list[sr.Rule], default: object, suffix: str = "",
                present: set[str] | None = None) -> DataFrame:
    """Value, rule id, message and condition text of the first matching rule."""
    return cascade(df, prefix, rules, default, suffix, present).withColumns(
        provenance_columns(prefix, rules, suffix)).drop(f"{prefix}_win{suffix}")


def parking(edges: DataFrame) -> DataFrame:
    """Parking per side, and its assumed width where present."""
    wins = {f"parking_win_{s}": F.expr(first_match(edges, sr.parking_rules(s))) for s in SIDES}
    values = {s: lookup(["yes", *[r.value for r in sr.parking_rules(s)]], f"parking_win_{s}") for s in SIDES}
    return edges.withColumns(wins).withColumns(
        {f"parking_{s}": v for s, v in values.items()}
        | {f"parking_width_{s}": F.when(v == "yes", sr.PARKING_WIDTH_FT).otherwise(0.0) for s, v in values.items()})


def parking_provenance() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for s in SIDES:
        out |= provenance_columns("parking", sr.parking_rules(s), f"_{s}")
        out[f"parking_width_rule_{s}"] = F.when(F.col(f"parking_{s}") == "yes", sr.ASSUMED)
    return out


def label_filters(edges: DataFrame, filters: list[tuple[str, Condition]]) -> DataFrame:
    """Label edges with the first of an ordered list of (label, condition) that matches; keep only those."""
    known = set(edges.columns)
    label = F.coalesce(*[F.when(compile_condition(c, known), F.lit(name)) for name, c in filters])
    return edges.withColumn("filter_label", label).where(F.col("filter_label").isNotNull())


def mark_lane_rules(edges: DataFrame, rules: list[sr.LaneRule], present: set[str] | None = None) -> DataFrame:
    """Add ``lane_rules`` (and ``lane_rules2``, ... beyond 62 rules): one bit per rule that matches.

    Each condition is evaluated once, and one number instead of a column per rule goes on to the targets.
    """
    ready = with_missing(edges, LANE_COLUMNS)
    known = set(ready.columns)
    runs = usable([r.condition for r in rules], present)
    parts: dict[str, Column] = {}
    masks = {}
    for k, name in enumerate(mask_columns(rules)):
        span = range(k * MASK_BITS, min((k + 1) * MASK_BITS, len(rules)))
        bits = [f"if({condition_sql(rules[i].condition, known)}, {1 << i - span.start}L, 0L)" for i in span if runs[i]]
        # a few rules per expression: the JVM does not compile a generated method past 8 kB of bytecode
        some = {f"_mask{k}_{i}": F.expr(" | ".join(bits[i:i + 4])) for i in range(0, len(bits), 4)}
        parts |= some
        masks[name] = F.expr(" | ".join(some) or "0L")
    return settled(ready.withColumns(parts), masks).drop(*parts)


MASK_BITS = 62


def mask_columns(rules: list[sr.LaneRule]) -> list[str]:
    """Names of the columns that tell which rules matched, ``MASK_BITS`` rules in each."""
    return [f"lane_rules{k + 1 if k else ''}" for k in range(-(-len(rules) // MASK_BITS) or 1)]


def _hit(mask: int) -> str:
    """Whether one of the rules in ``mask`` (bit i for rule i) matched."""
    tests, k = [], 0
    while mask >> k * MASK_BITS:
        if own := mask >> k * MASK_BITS & (1 << MASK_BITS) - 1:
            tests.append(f"(lane_rules{k + 1 if k else ''} & {own}L) != 0")
        k += 1
    return tests[0] if len(tests) == 1 else f"({' OR '.join(tests)})"


def _setters(rules: list[sr.LaneRule], target: str, known: set[str]) -> list[tuple[int, str, bool]]:
    """(bits, value SQL, is a column) in rule order; neighbours with the same constant share one test."""
    out: list[tuple[int, str, bool]] = []
    for i, rule in enumerate(rules):
        if target not in rule.sets:
            continue
        value = rule.sets[target]
        if isinstance(value, sr.Source):
            if value.column in known:
                out.append((1 << i, f"`{value.column}`", True))
            continue
        # separation mixes yes/no with tag values, so yes/no are kept as text there
        text = f"'{str(value).lower()}'" if target.startswith("separation") else str(value).lower()
        if out and out[-1][1:] == (text, False):
            out[-1] = (out[-1][0] | 1 << i, text, False)
        else:
            out.append((1 << i, text, False))
    return out


def _target_type(target: str) -> str:
    if target.startswith("parking_width"):
        return "double"
    return "boolean" if target.startswith(("bike_allowed", "bike_lane")) else "string"


def parse_directions(edges: DataFrame, rules: list[sr.LaneRule] | None = None,
                     present: set[str] | None = None) -> DataFrame:
    """Translate side tags into what a rider meets in each travel direction.

    Per target the first matching rule that sets a non-missing value wins, so a rule whose source tag is
    missing lets later rules decide. ``LTS_bike_access_*`` is the first stress given by a matching rule;
    ``lane_rules`` keeps which rules matched (:func:`parse_text` names them).
    """
    rules = rules or sr.lane_rules()
    marked = mark_lane_rules(edges, rules, present)
    known = set(marked.columns)
    targets: dict[str, Column] = {}
    for target in sr.LANE_TARGETS:
        setters = _setters(rules, target, known)
        arms = " ".join(f"WHEN {_hit(bits)}{f' AND {value} IS NOT NULL' if copied else ''} THEN {value}"
                        for bits, value, copied in setters)
        chosen = f"CASE {arms} END" if arms else "NULL"
        targets[target] = F.expr(f"cast({chosen} AS {_target_type(target)})")
    levels: list[tuple[int, int]] = []
    for i, rule in enumerate(rules):
        if rule.lts is not None:
            if levels and levels[-1][1] == rule.lts:
                levels[-1] = (levels[-1][0] | 1 << i, rule.lts)
            else:
                levels.append((1 << i, rule.lts))
    access = F.expr(f"CASE {' '.join(f'WHEN {_hit(bits)} THEN {lts}' for bits, lts in levels)} END" if levels else "CAST(NULL AS INT)")
    targets |= {f"LTS_bike_access_{way}": access for way in WAYS}
    kept = [c for c in marked.columns if c not in targets]
    return marked.select(*[column(c) for c in kept], *[v.alias(k) for k, v in targets.items()])


def parse_text(rules: list[sr.LaneRule] | None = None) -> Column:
    """Ids of all matching lane rules, from the mask."""
    rules = rules or sr.lane_rules()
    names = ", ".join(f"if({_hit(1 << i)}, '{r.rule_id}', null)" for i, r in enumerate(rules))
    return F.expr(f"concat_ws(',', {names})")


def parse_hits(edges: DataFrame, rules: list[sr.LaneRule] | None = None) -> DataFrame:
    """Rule-hit log: how many edges each rule newly set, per target.

    Edges are first counted per (matching rules, which sources are present), so the unfolding to targets
    works on the distinct combinations only.
    """
    rules = rules or sr.lane_rules()
    marked = mark_lane_rules(edges, rules)
    known = set(marked.columns)
    sources = sorted({v.column for r in rules for v in r.sets.values() if isinstance(v, sr.Source)} & known)
    flags = {c: f"_has{i}" for i, c in enumerate(sources)}
    combos = marked.groupBy(*mask_columns(rules), *[column(c).isNotNull().alias(f) for c, f in flags.items()]).agg(
        F.count(F.lit(1)).alias("n"))
    items = []
    for target in sr.LANE_TARGETS:
        arms = []
        for i, rule in enumerate(rules):
            value = rule.sets.get(target)
            if value is None or (isinstance(value, sr.Source) and value.column not in known):
                continue
            extra = f" AND {flags[value.column]}" if isinstance(value, sr.Source) else ""
            arms.append(f"WHEN {_hit(1 << i)}{extra} THEN '{rule.rule_id}'")
        rule = f"CASE {' '.join(arms)} END" if arms else "CAST(NULL AS STRING)"
        items.append(f"struct('{target}' AS target, {rule} AS rule_id)")
    hits = combos.select("n", F.explode(F.expr(f"array({', '.join(items)})")).alias("w")).select("n", "w.rule_id", "w.target")
    return hits.where(F.col("rule_id").isNotNull()).groupBy("rule_id", "target").agg(F.sum("n").alias("n"))


# --- speed, lanes, widths --------------------------------------------------------------------------------------

def prevailing_speed(edges: DataFrame) -> DataFrame:
    """Signed speed limit in mph, else the road class's assumed speed, else 0."""
    edges = with_missing(edges, ["maxspeed"])
    signed = "coalesce(maxspeed != 'signals', false)"
    rules = sr.speed_rules()
    posted = F.split(F.col("maxspeed"), " ")[0].try_cast("int")
    return edges.withColumn("speed_win", F.expr(f"if({signed}, 0, {first_match(edges, rules)})")).withColumn(
        "speed", F.when(F.expr(signed), posted).otherwise(lookup([0, *[r.value for r in rules]], "speed_win")))


def lane_count(edges: DataFrame, default: int = sr.LANES_DEFAULT) -> DataFrame:
    """Largest lane number tagged (``"2; 3"`` → 3), rounded half to even."""
    edges = with_missing(edges, ["lanes"])
    parts = F.transform(F.split("lanes", r"[;,*\n] ?"), lambda x: F.trim(x).try_cast("double"))
    return edges.withColumn("lane_count", F.coalesce(F.rint(F.array_max(parts)).cast("int"), F.lit(default))).withColumn(
        "lane_rule", F.when(F.col("lanes").isNull(), sr.ASSUMED).otherwise(sr.OSM))


def width_feet(text: Column) -> Column:
    """Decimal feet of a width tag; NULL if unreadable. A quote mark means feet and inches, else metres."""
    quoted = r"^\"*(\d+)'(\d*)\"*$"
    inches = F.regexp_extract(text, quoted, 2).try_cast("double")
    feet = F.regexp_extract(text, quoted, 1).try_cast("double") + F.coalesce(inches, F.lit(0.0)) / 12
    metres = F.array_max(F.transform(F.split(text, ";"), lambda x: F.trim(x).try_cast("double")))
    return F.when(text.contains("'"), feet).otherwise(F.bround(metres * 3.28084, 2))


def width_note(text: Column) -> Column:
    return F.when(text.isNull(), NOTE_NONE).when(text.contains("'"), NOTE_FEET).otherwise(NOTE_METRES)


def widths(edges: DataFrame) -> DataFrame:
    """Street width, and per direction bike width, buffer and reach (bike + parking + buffer), in feet.

    A missing bike width is assumed, and the buffer then counts as 0 whatever its tag says.
    """
    out = with_missing(edges, ["width"])
    new: dict[str, Column] = {"width_street": width_feet(F.col("width")), "width_street_rule": width_note(F.col("width"))}
    for way in WAYS:
        bike, buffer = F.col(f"bike_width_{way}"), F.col(f"buffer_{way}")
        text = F.when(buffer == "yes", F.lit("2'")).when(buffer == "no", F.lit("0.0")).otherwise(buffer)
        width = F.when(bike.isNull(), F.lit(sr.BIKE_WIDTH_DEFAULT)).otherwise(width_feet(bike))
        gap = F.when(bike.isNull(), F.lit(0.0)).otherwise(width_feet(text))
        new |= {
            f"bike_width_{way}": width,
            f"bike_width_rule_{way}": F.when(bike.isNull(), sr.ASSUMED).when(width.isNotNull(), width_note(bike)),
            f"buffer_{way}": gap,
            f"buffer_rule_{way}": F.when(bike.isNull(), NOTE_NONE).when(gap.isNotNull(), width_note(text)),
            f"bike_reach_{way}": F.coalesce(width, F.lit(0.0)) + F.coalesce(F.col(f"parking_width_{way}"), F.lit(0.0))
            + F.coalesce(gap, F.lit(0.0)),
        }
    return out.withColumns(new)


def narrow_wide(edges: DataFrame) -> DataFrame:
    """One-way streets are narrow when the width left beside parking is small; others are ``not oneway``."""
    width, fwd, rev = F.col("width_street"), F.col("parking_fwd"), F.col("parking_rev")
    # fixed values: width limits in feet with parking on both sides, one side, no side
    narrow = (
        ((width < 30) & (fwd == "yes") & (rev == "yes"))
        | ((width < 22) & ((fwd == "yes") | (rev == "yes")))
        | ((width < 15) & (fwd == "no") & (rev == "no")))
    one_way = F.coalesce(F.col("oneway") == 1, F.lit(False))
    return edges.withColumn("street_narrow_wide", F.when(~one_way, "not oneway").when(
        F.coalesce(narrow, F.lit(False)), "narrow").otherwise("wide"))


def value_counts(edges: DataFrame, names: list[str]) -> DataFrame:
    """Value counts of each column, missing values included, in long form."""
    items = F.array(*[F.struct(F.lit(n).alias("column"), column(n).cast("string").alias("value")) for n in names])
    return edges.select(F.explode(items).alias("i")).groupBy("i.column", "i.value").agg(F.count(F.lit(1)).alias("n"))


def edge_schema(names: list[str]) -> T.StructType:
    base = [("u", T.LongType()), ("v", T.LongType()), ("key", T.IntegerType()), ("osmid", T.LongType()),
            ("oneway", T.ShortType()), ("length", T.DoubleType())]
    return T.StructType([T.StructField(n, t) for n, t in base] + [T.StructField(n, T.StringType()) for n in names])
