"""Stop-name and direction text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word abbreviations applied to stop names.
STOP_WORDS = {
    "avenue": "ave",
    "street": "st",
    "boulevard": "blvd",
    "square": "sq",
    "opposite": "opp",
}
# Direction labels and the codes they stand for.
DIRECTION_CODES = {
    "Inbound": ["inbound", "1", "1.0"],
    "Outbound": ["outbound", "0", "0.0"],
}
# Stop ids that were renumbered, alias to canonical id.
STOP_ALIASES = {"17865": "17862"}


def norm_direction(value: Column) -> Column:
    token = F.lower(F.trim(value))
    out = F.when(token.isin(DIRECTION_CODES["Inbound"]), F.lit("Inbound"))
    return out.when(token.isin(DIRECTION_CODES["Outbound"]), F.lit("Outbound")).otherwise(F.trim(value))


def direction_code(value: Column) -> Column:
    """Inbound/Outbound to the feed's ``1``/``0``, anything else NULL."""
    return F.when(value == "Inbound", "1").when(value == "Outbound", "0")


def canonical_stop(value: Column, aliases: dict[str, str] | None = None) -> Column:
    stop = F.trim(value)
    pairs = STOP_ALIASES if aliases is None else aliases
    if not pairs:
        return stop
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, stop), stop)


def norm_stop_name(value: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(value)), "[@&]", " at ")
    name = F.regexp_replace(name, "[^a-z0-9 ]", " ")
    for word, short in STOP_WORDS.items():
        name = F.regexp_replace(name, rf"\b{word}\b", short)
    name = F.regexp_replace(name, r"^[0-9]+ +", "")
    return F.trim(F.regexp_replace(name, " +", " "))
