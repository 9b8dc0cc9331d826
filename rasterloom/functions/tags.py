"""Column functions of map tags: road widths and elevated ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width in metres of the paved surface by road class.
ROAD_WIDTH_M = {
    "motorway": 14.0, "motorway_link": 8.0, "trunk": 12.0, "trunk_link": 8.0,
    "primary": 12.0, "primary_link": 7.0, "secondary": 10.0, "secondary_link": 6.0,
    "tertiary": 8.0, "tertiary_link": 6.0, "unclassified": 6.0, "residential": 6.0, "living_street": 5.0,
    "service": 4.0, "track": 3.5, "busway": 7.0, "pedestrian": 5.0, "footway": 2.5, "cycleway": 2.5,
    "path": 2.0, "steps": 1.5, "corridor": 2.0,
}
OTHER_WIDTH_M, LANE_M = 6.0, 3.0


def _number(text: Column) -> Column:
    """The first word as a number, a comma as decimal point; null if it isn't one."""
    return F.replace(F.regexp_extract(F.trim(text), r"^\S+", 0), F.lit(","), F.lit(".")).try_cast("double")


def _said(text: Column) -> Column:
    return F.when(text != "", text)


def road_width(tags: Column) -> Column:
    """Width in metres: the width tag, else 3 m a lane (at least 3), else the class's, else 6."""
    by_class = F.create_map(*(F.lit(x) for pair in ROAD_WIDTH_M.items() for x in pair))
    width = _number(F.coalesce(_said(F.try_element_at(tags, F.lit("width"))), F.try_element_at(tags, F.lit("est_width"))))
    lanes = F.try_element_at(tags, F.lit("lanes")).try_cast("double")
    known = F.try_element_at(by_class, F.coalesce(F.try_element_at(tags, F.lit("highway")), F.lit("")))
    return F.coalesce(width, F.when(lanes.isNotNull(), F.greatest(F.lit(LANE_M), lanes * LANE_M)), known, F.lit(OTHER_WIDTH_M))


def elevated_flag(tags: Column) -> Column:
    """Whether a bridge or tunnel tag says other than ``no`` or nothing."""
    on = lambda k: ~F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")).isin("no", "")
    return on("bridge") | on("tunnel")
