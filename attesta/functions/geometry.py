"""Box arithmetic as struct columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rescale_box(box: Column, scale_x: Column, scale_y: Column, width: Column, height: Column) -> Column:
    """Carry a box from processed to source space: half-even rounding, at least one pixel, inside."""
    rounded = lambda v: F.bround(v, 0).cast("int")
    x = F.least(F.greatest(F.lit(0), rounded(box["x"] * scale_x)), width - 1)
    y = F.least(F.greatest(F.lit(0), rounded(box["y"] * scale_y)), height - 1)
    w = F.least(F.greatest(F.lit(1), rounded(box["width"] * scale_x)), width - x)
    h = F.least(F.greatest(F.lit(1), rounded(box["height"] * scale_y)), height - y)
    one = F.lit(1)
    return F.when(
        box.isNotNull(),
        F.struct(x.alias("x"), y.alias("y"), F.greatest(one, w).alias("width"), F.greatest(one, h).alias("height")),
    )


def box_percentages(box: Column, width: Column, height: Column) -> Column:
    """A box as percentages of its image; null when box or image is unusable."""
    usable = (width > 0) & (height > 0) & (box["width"] > 0) & (box["height"] > 0)
    pct = lambda part, whole, name: (part / whole * 100).alias(name)
    return F.when(
        usable,
        F.struct(
            pct(box["x"], width, "left"), pct(box["y"], height, "top"),
            pct(box["width"], width, "width"), pct(box["height"], height, "height"),
        ),
    )
