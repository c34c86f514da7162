"""Hydrologic scalars as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import scenario


def arf_short(area: Column, duration: Column, aep: Column) -> Column:
    """Areal reduction factor for durations of up to 12 hours; area in km2, duration in minutes, aep as a fraction.

    All constants are fixed values.
    """
    lost = 0.287 * (F.pow(area, 0.265) - 0.439 * F.log10(duration)) * F.pow(duration, -0.36)
    rare = 2.26e-3 * F.pow(area, 0.226) * F.pow(duration, 0.125) * (0.3 + F.log10(aep))
    daily = 0.0141 * F.pow(area, 0.213) * F.pow(F.lit(10.0), -0.021 * F.pow(duration - 180, 2) / 1440) * (0.3 + F.log10(aep))
    return F.least(F.lit(1.0), 1 - lost + rare + daily)


def arf_long(area: Column, duration: Column, aep: Column, p: Mapping[str, float]) -> Column:
    """Areal reduction factor for a day or more by a region's nine parameters a to i."""
    log_aep = F.log10(aep)
    lost = p["a"] * (F.pow(area, p["b"]) - p["c"] * F.log10(duration)) * F.pow(duration, -p["d"])
    rare = p["e"] * F.pow(area, p["f"]) * F.pow(duration, p["g"]) * (0.3 + log_aep)
    daily = p["h"] * F.pow(F.lit(10.0), p["i"] * area * duration / 1440) * (0.3 + log_aep)
    return F.least(F.lit(1.0), 1 - lost + rare + daily)


#: A region's parameters for long durations.
EAST_COAST_NORTH = {"a": 0.327, "b": 0.241, "c": 0.448, "d": 0.36, "e": 0.00096, "f": 0.48, "g": -0.21, "h": 0.012, "i": -0.0013}


def arf(area: Column, duration: Column, aep: Column, p: Mapping[str, float]) -> Column:
    """The factor by area and duration: 1 up to 1 km2, interpolated to 10 km2, and between 12 and 24 hours.

    Null beyond 30,000 km2, 10,080 minutes and an aep of one half.
    """
    def large(a: Column) -> Column:
        mixed = arf_short(a, F.lit(720.0), aep) + (arf_long(a, F.lit(1440.0), aep, p) - arf_short(a, F.lit(720.0), aep)) * (duration - 720) / 720
        return F.when(duration <= 720, arf_short(a, duration, aep)).when(duration >= 1440, arf_long(a, duration, aep, p)).otherwise(mixed)

    small = 1 - 0.6614 * (1 - large(F.lit(10.0))) * (F.pow(area, 0.4) - 1)
    domain = (area <= 30000) & (duration <= 10080) & (aep <= 0.5) & (area >= 0) & (duration > 0) & (aep > 0)
    return F.when(domain, F.when(area <= 1, F.lit(1.0)).when(area < 10, small).otherwise(large(area)))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    angle = F.degrees(F.atan2(x2 - x1, y2 - y1))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def rotated(x: Column, y: Column, angle: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """A point turned counter-clockwise by ``angle`` degrees about the origin, then moved."""
    r = F.radians(angle)
    return x * F.cos(r) - y * F.sin(r) + dx, x * F.sin(r) + y * F.cos(r) + dy


def round_to_grid(value: Column, grid: float) -> Column:
    return F.bround(value / grid) * grid


def circle_area(height: Column) -> Column:
    return F.lit(math.pi) * F.pow(height / 2, 2)


def barrel_count(area: Column, single: Column) -> Column:
    return F.when(single > 0, F.greatest(F.lit(1.0), F.bround(area / single))).otherwise(1.0).cast("int")


#: Flags of channels and their shapes and materials.
SHAPES = {"C": "CIRCLE", "R": "BOX"}
MATERIALS = {"C": "CORRUGATED_STEEL", "R": "CONCRETE"}


@dataclass(frozen=True)
class CrossingOptions:
    """How culvert maxima become crossings; the defaults are fixed values.

    ``flow`` (of the design flow), ``roadway`` (of height and crest) and ``barrel_count`` (of area and height) take the place
    of the rules for these parts; each gives a column of the same shape.
    """

    least_flow: float = 0.005
    minimum_factor: float = 0.9
    maximum_factor: float = 1.1
    tailwater_gap: float = 0.05
    crest_offset: float = 0.5
    width_factor: float = 6.0
    least_width: float = 5.0
    barrels: int = 1
    material: str = "CONCRETE"
    shapes: Mapping[str, str] = field(default_factory=lambda: SHAPES)
    materials: Mapping[str, str] = field(default_factory=lambda: MATERIALS)
    flow: Callable[[Column], Column] | None = None
    roadway: Callable[[Column, Column], Column] | None = None
    barrel_count: Callable[[Column, Column], Column] | None = None


def _of(flag: Column, known: Mapping[str, str]) -> Column:
    pairs = [x for k, v in known.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.upper(F.trim(F.coalesce(flag, F.lit("")))))


def crossing(
    flow: Column, us_invert: Column, ds_invert: Column, height: Column, ds_level: Column, flag: Column, length: Column, area: Column,
    us_level: Column | None = None, us_obvert: Column | None = None, ds_obvert: Column | None = None, channel: Column | None = None, options: CrossingOptions = CrossingOptions(),
) -> Column:
    """A culvert crossing as a nested record; null unless flow and height are positive and levels are known.

    The shape is that of the flag, else of the last part of the channel's name, else a circle; a box has the default number of
    barrels, as its width isn't known. Design flow lies strictly between minimum and maximum. An obvert that is null or 0 is
    taken as invert and height. The tailwater is constant at the downstream level, over an invert at least a gap lower.
    """
    o, nothing = options, F.lit(None).cast("double")
    valid = (flow > 0) & (height > 0) & ds_level.isNotNull() & us_invert.isNotNull() & ds_invert.isNotNull()
    design = F.greatest(F.lit(o.least_flow), flow)
    least, most = F.greatest(F.lit(o.least_flow), design * o.minimum_factor), F.greatest(design + o.least_flow, design * o.maximum_factor)
    chosen = F.when(least >= design, least + o.least_flow).otherwise(design)
    flows = F.struct(least.alias("minimum"), chosen.alias("design"), F.when(chosen >= most, chosen + o.least_flow).otherwise(most).alias("maximum"))
    flows = flows if o.flow is None else o.flow(flow)
    bed = F.least(ds_invert, ds_level - o.tailwater_gap)
    tailwater = F.struct(ds_level.alias("elevation"), bed.alias("invert"))
    top = lambda obvert, invert: F.coalesce(F.nullif(obvert, F.lit(0.0)), invert + height)
    levels = [nothing if us_level is None else us_level, ds_level, top(nothing if us_obvert is None else us_obvert, us_invert), top(nothing if ds_obvert is None else ds_obvert, ds_invert)]
    crest = F.greatest(*levels) + max(0.0, o.crest_offset)
    width = F.greatest(F.lit(o.least_width), height * o.width_factor)
    roadway = F.struct(width.alias("width"), F.array(-width / 2, F.lit(0.0), width / 2).alias("stations"), F.array(crest, crest, crest).alias("elevations"))
    roadway = roadway if o.roadway is None else o.roadway(height, crest)
    hint = F.lit("") if channel is None else F.element_at(F.split(F.coalesce(channel, F.lit("")), "_"), -1)
    shape = F.coalesce(_of(flag, o.shapes), _of(hint, o.shapes), F.lit("CIRCLE"))
    counted = (area > 0) & (shape == "CIRCLE")
    barrels = F.when(counted, barrel_count(area, circle_area(height))).otherwise(max(1, o.barrels)) if o.barrel_count is None else o.barrel_count(area, height)
    barrel = F.struct(
        height.alias("span"), height.alias("rise"), us_invert.alias("us_invert"), ds_invert.alias("ds_invert"), F.coalesce(length, F.lit(0.0)).alias("length"), shape.alias("shape"),
        F.coalesce(_of(flag, o.materials), F.lit(o.material)).alias("material"), barrels.alias("barrels"),
    )
    return F.when(valid, F.struct(flows.alias("flow"), tailwater.alias("tailwater"), roadway.alias("roadway"), barrel.alias("barrel")))


def crossing_name(internal: Column, trimmed: Column, channel: Column, template: str = "{internal}_{channel}") -> Column:
    """A crossing's name: slugs of run and channel put into a template; of what is blank, the run's code or plain words."""
    run = scenario.slug(scenario.first_text(internal, trimmed, F.lit("Scenario")), "Scenario")
    parts = {"internal": run, "channel": scenario.slug(scenario.first_text(channel, F.lit("CHAN")), "CHAN")}
    pieces = [p for p in Formatter().parse(template)]
    if any(field is not None and field not in parts for _, field, _, _ in pieces):
        raise ValueError(f"a crossing's name is made of {', '.join(parts)}, not of {template!r}")
    text = F.concat(*[F.concat(F.lit(plain), parts[field] if field else F.lit("")) for plain, field, _, _ in pieces])
    return F.coalesce(F.nullif(scenario.slug(text, ""), F.lit("")), run)


def wkt_line(points: list[tuple[Column, Column]]) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", *[F.format_string("%.3f %.3f", x, y) for x, y in points]), F.lit(")"))
