"""Numeric estimates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rounded(value: Column, places: int) -> Column:
    """A double rounded half away from zero as SQL does it: scaled, rounded to a whole number, scaled back.

    F.round works on the shortest decimal instead, so 28.549999999999997 (0.2855 * 100) to one place is 28.5 there and 28.6 here.
    What is too large to be scaled stays as it is.
    """
    scaled = value.cast("double") * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**places).otherwise(value.cast("double"))


def target_minutes(cjk: Column, pages: Column, headings: Column, per_minute: float = 2200.0, low: float = 3.0, high: float = 120.0, override: Column | None = None) -> Column:
    """Length of a summary: characters by pace within bounds, large structured books between 45 and 90; a numeric override wins."""
    auto = clamp(F.rint(cjk / max(1.0, per_minute)), low, high)
    auto = F.when((pages > 300) & (headings > 15), clamp(auto, 45.0, 90.0)).otherwise(auto)
    return auto if override is None else F.coalesce(F.try_to_number(override, F.lit("999999.99")).cast("double"), auto)


def scene_seconds(chars: Column, per_minute: float = 240.0) -> Column:
    return clamp(chars / max(1.0, per_minute) * 60.0 + 0.6, 12.0, 120.0)


def chars_per_scene(seconds: Column, low: float = 30.0, high: float = 90.0, per_minute: float = 240.0) -> tuple[Column, Column]:
    """(characters of each scene, number of scenes)."""
    scenes = F.greatest(F.lit(1.0), F.rint(seconds / ((low + high) / 2)))
    return F.greatest(F.lit(40.0), F.rint(seconds / scenes / 60.0 * per_minute)).cast("int"), scenes.cast("int")


def area_ratio(box: Column, width: Column, height: Column) -> Column:
    """Share of a page that a box covers, 0 without a box or page size."""
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    return F.coalesce(F.when(area.isNotNull() & (width != 0) & (height != 0), clamp(area / F.greatest(F.lit(1.0), width * height), 0.0, 1.0)), F.lit(0.0))


def expanded_box(box: Column, width: Column, height: Column, pad: float) -> Column:
    """A box with a margin, clipped to the page; the lower margin is 1.4 times as wide."""
    return F.struct(
        F.greatest(F.lit(0.0), box["x0"] - pad).alias("x0"), F.greatest(F.lit(0.0), box["y0"] - pad).alias("y0"),
        F.least(width, box["x1"] + pad).alias("x1"), F.least(height, box["y1"] + pad * 1.4).alias("y1"),
    )


# Seconds aimed at, least and most for each depth; and the minutes an automatic length may take.
DEPTHS = {"brief": (120.0, 90.0, 150.0), "standard": (300.0, 240.0, 360.0), "deep": (600.0, 480.0, 720.0)}
AUTO_BOUNDS = {"brief": (2.0, 3.0), "standard": (2.5, 6.0), "deep": (5.0, 10.0)}
# Minutes of an automatic length by kind: base, per page, and characters per minute.
AUTO_MINUTES = {"contract": (1.4, 0.75, 3600.0), "policy": (1.4, 0.75, 3600.0), "form": (1.4, 0.75, 3600.0), "paper": (2.0, 0.55, 5000.0), "manual": (1.8, 0.50, 5200.0), "report": (2.0, 0.60, 4600.0), "slides": (1.5, 0.28, 6500.0)}
AUTO_OTHER = (1.8, 0.45, 5600.0)


def _entry(key: Column, table: dict, other: tuple, place: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[place]))), key), F.lit(other[place]))


def length_window(depth: Column, minutes: Column) -> Column:
    """struct<target,least,most> in seconds: a positive number of minutes gives a tenth to either side, else the depth decides."""
    wanted = F.try_to_number(minutes, F.lit("999999.99")).cast("double") * 60.0
    known = [_entry(F.lower(F.coalesce(depth, F.lit("standard"))), DEPTHS, DEPTHS["standard"], i) for i in range(3)]
    made = [F.when(wanted > 0, wanted * share).otherwise(k) for share, k in zip((1.0, 0.9, 1.1), known, strict=True)]
    return F.struct(made[0].alias("target"), made[1].alias("least"), made[2].alias("most"))


def auto_minutes(kind: Column, pages: Column, chars: Column, depth: Column) -> Column:
    """A length from the size of a document of a kind, within the bounds of the depth, to the half minute."""
    k, d = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(depth, F.lit("standard")))
    base, per_page, pace = (_entry(k, AUTO_MINUTES, AUTO_OTHER, i) for i in range(3))
    raw = base + F.greatest(F.lit(1), pages) * per_page + F.greatest(F.lit(0), chars) / pace
    low, high = (_entry(d, AUTO_BOUNDS, AUTO_BOUNDS["standard"], i) for i in range(2))
    return F.rint(F.greatest(low, F.least(high, raw)) * 2) / 2
