"""The edge stress pipeline: raw tagged edges to stress levels. One narrow stage, no shuffle.

Values flow through the steps; the texts saying which rule set a value are looked up from the winner
numbers once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from kerbflow.operators import streets as st
from kerbflow.operators import stress
from kerbflow.rules import street_rules as sr

WINNERS = ["parking_win_left", "parking_win_right", "speed_win", "centerline_win", "ADT_win", "zoom_win", "lane_rules"]


def directed_features(edges: DataFrame) -> DataFrame:
    """Parking, folded tags and lane parsing."""
    return st.parse_directions(st.fold_both(st.parking(edges)))


def measured_features(edges: DataFrame) -> DataFrame:
    """Everything the stress tables need."""
    out = st.lane_count(st.prevailing_speed(directed_features(edges)))
    out = st.cascade(out, "centerline", sr.centerline_rules(), "yes")
    out = st.narrow_wide(st.widths(out))
    return stress.separation_lts(st.cascade(out, "ADT", sr.adt_rules(), sr.ADT_DEFAULT))


def rated_edges(edges: DataFrame) -> DataFrame:
    out = stress.combine_lts(stress.table_stress(measured_features(edges)))
    return st.cascade(out, "zoom", sr.zoom_rules(), sr.ZOOM_DEFAULT)


def explained(rated: DataFrame) -> DataFrame:
    """Replace winner numbers by rule ids, messages and condition texts."""
    return rated.withColumns(
        st.parking_provenance()
        | st.provenance_columns("speed", sr.speed_rules(), default_message="Signed speed limit")
        | st.provenance_columns("centerline", sr.centerline_rules())
        | st.provenance_columns("ADT", sr.adt_rules())
        | st.provenance_columns("zoom", sr.zoom_rules())
        | {"parse": st.parse_text()}
    ).drop(*WINNERS)


def edge_stress(edges: DataFrame) -> DataFrame:
    return explained(rated_edges(edges))
