"""Boxes and bands on a page."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordflow.functions.scalars import _col


def band(value, lo, hi) -> Column:
    """low / mid / high third of [lo, hi]."""
    value, lo, hi = _col(value), _col(lo), _col(hi)
    width = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    share = (value - lo) / width
    return F.when(share < 0.33, "low").when(share < 0.67, "mid").otherwise("high")


def box_to_pct(x0, y0, x1, y1, page_w, page_h) -> Column:
    """Box as rounded percentages of its page; null if degenerate."""
    x0, y0, x1, y1, page_w, page_h = map(_col, (x0, y0, x1, y1, page_w, page_h))

    def pct(v, of):
        return F.round(v / F.nullif(of, F.lit(0.0)) * 100, 2)

    w = pct(F.abs(x1 - x0), page_w)
    h = pct(F.abs(y1 - y0), page_h)
    box = F.struct(
        pct(F.least(x0, x1), page_w).alias("x_pct"),
        pct(F.least(y0, y1), page_h).alias("y_pct"),
        F.greatest(F.lit(5.0), w).alias("width_pct"),
        F.greatest(F.lit(3.0), h).alias("height_pct"),
    )
    return F.when((page_w > 0) & (page_h > 0) & (w >= 0.5) & (h >= 0.5), box)


def pct_to_box(page_w, page_h, x_pct, y_pct, width_pct, height_pct) -> Column:
    """Percentages to points, with an error text where they do not fit the page."""
    page_w, page_h, x, y, w, h = map(_col, (page_w, page_h, x_pct, y_pct, width_pct, height_pct))
    error = (
        F.when((F.least(x, y, w, h) < 0) | (F.greatest(x, y, w, h) > 100), "percentage outside 0-100")
        .when((x + w > 100.01) | (y + h > 100.01), "box overflows the page")
    )

    def points(pct, of):
        return F.when(error.isNull(), of * (pct / 100.0))

    return F.struct(points(x, page_w).alias("x"), points(y, page_h).alias("y"),
                    points(w, page_w).alias("w"), points(h, page_h).alias("h"), error.alias("error"))


def top_to_bottom_origin(x_pct, y_top_pct, width_pct, height_pct) -> Column:
    """Zone measured from the top of a page to one measured from its bottom."""
    x, top, w, h = map(_col, (x_pct, y_top_pct, width_pct, height_pct))
    return F.struct(
        F.round(x, 2).alias("x_pct"),
        F.round(F.greatest(F.lit(0.0), 100.0 - top - h), 2).alias("y_pct"),
        F.round(F.greatest(F.lit(5.0), w), 2).alias("width_pct"),
        F.round(F.greatest(F.lit(3.0), h), 2).alias("height_pct"),
    )
