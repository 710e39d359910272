"""Column logic of page geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn(rotation: Column) -> Column:
    return F.pmod(rotation, F.lit(360))


def displayed_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height as shown: swapped at a quarter turn."""
    quarter = turn(rotation).isin(90, 270)
    return F.when(quarter, height).otherwise(width), F.when(quarter, width).otherwise(height)


def user_point(x: Column, y: Column, left: Column, bottom: Column, width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """A displayed point in the page's own unrotated space."""
    r = turn(rotation)
    own_x = F.when(r == 90, width - y).when(r == 180, width - x).when(r == 270, y).otherwise(x)
    own_y = F.when(r == 90, x).when(r == 180, height - y).when(r == 270, height - x).otherwise(y)
    return own_x + left, own_y + bottom


def text_scale(characters: Column, box_width: Column, box_height: Column, shown_width: Column, shown_height: Column) -> tuple[Column, Column]:
    """Font size and horizontal scale of a run that fills its box; half an em a character."""
    size = F.greatest(F.lit(1.0), box_height * shown_height)
    natural = F.greatest(F.lit(1.0), characters * 0.5 * size)
    return size, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.greatest(F.lit(1.0), box_width * shown_width) / natural * 100))


def raster_size(width: Column, height: Column, dpi: Column, most: float = 40_000_000.0) -> tuple[Column, Column]:
    """Pixels at a resolution, at most `most`, rounded down; null for a degenerate page."""
    scale = dpi / 72.0
    pixels = width * scale * height * scale
    fit = F.when(pixels > most, scale * F.sqrt(F.lit(most) / pixels)).otherwise(scale)
    w, h = F.floor(width * fit), F.floor(height * fit)
    sound = (width > 0) & (height > 0) & (w >= 1) & (h >= 1)
    return F.when(sound, w), F.when(sound, h)


def placement(x: Column, y: Column, box_width: Column, box_height: Column, characters: Column, left: Column, bottom: Column, width: Column, height: Column, rotation: Column) -> Column:
    """Where a run (its box in shares of the page as shown) is drawn: origin, angle, font size and horizontal scale."""
    shown_w, shown_h = displayed_size(width, height, rotation)
    own_x, own_y = user_point(x * shown_w, y * shown_h, left, bottom, width, height, rotation)
    size, scale = text_scale(characters, box_width, box_height, shown_w, shown_h)
    return F.struct(own_x.alias("x"), own_y.alias("y"), turn(rotation).alias("angle"), size.alias("size"), scale.alias("scale"))
