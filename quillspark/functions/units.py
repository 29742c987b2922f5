"""Lengths, pixels and data URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels are made at twice 96 dots an inch.
SCALE = 2.0


def points_to_pixels(points: Column, scale: float = SCALE) -> Column:
    """At least 1; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(points * 96.0 / 72.0 * scale, 0)).cast("long")


def to_points(value: Column, unit: Column) -> Column:
    u = F.lower(F.coalesce(unit, F.lit("pt")))
    return (
        F.when(u == "px", value * 72.0 / 96.0)
        .when(u == "in", value * 72.0)
        .when(u == "cm", value * 72.0 / 2.54)
        .when(u == "mm", value * 72.0 / 25.4)
        .when(u == "emu", value / 12700.0)
        .otherwise(value)
    )


def shape_points(style: Column) -> tuple[Column, Column]:
    """Width and height of a style in points; both null unless both are given and above zero."""

    def side(name: str) -> Column:
        pattern = rf"(?i){name}:\s*([0-9.]+)\s*(pt|px|in|cm|mm)?"
        number = F.regexp_extract(style, pattern, 1).try_cast("double")
        return to_points(number, F.nullif(F.regexp_extract(style, pattern, 2), F.lit("")))

    width, height = side("width"), side("height")
    both = (width > 0) & (height > 0)
    return F.when(both, width), F.when(both, height)


def data_url(mime: Column, content: Column) -> Column:
    """Spark's base64 breaks lines every 76 characters; a URL has none."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def vector_kind(content: Column) -> Column:
    """A metafile is an EMF if it starts with record type 1, little-endian."""
    return F.when(F.hex(F.substring(content, 1, 4)) == "01000000", "emf").otherwise("wmf")
