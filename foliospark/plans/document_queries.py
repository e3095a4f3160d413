"""Queries over the smaller document semantics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import document as doc
from foliospark.plans.relational_queries import table

col = F.col
MODES = [*doc.BLEND, "Normal", "Compatible"]


def font_traits(spark, sf_dir):
    """Family, weight and slant of fonts named after parts."""
    part = table(spark, sf_dir, "part")
    names = F.array(*map(F.lit, ("ABCDEF+Courier-Bold", "TimesNewRoman", "Arial-Italic", "XYZ+Minion", "Helvetica-Oblique")))
    name = F.element_at(names, (col("p_partkey") % 5).cast("int") + 1)
    flags = F.when(col("p_size") % 7 == 0, 0x40000).when(col("p_size") % 5 == 0, 64).otherwise(0)
    return part.select("p_partkey", doc.base_font(name).alias("base_font"), doc.font_family(name).alias("family"), doc.is_bold(name, col("p_size") * 4, flags).alias("bold"), doc.is_italic(name, F.lit(0), flags).alias("italic"))


def blend_modes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mode = F.element_at(F.array(*map(F.lit, MODES)), (col("p_partkey") % len(MODES)).cast("int") + 1)
    return part.select("p_partkey", doc.blend_style(mode).alias("style"))


def destinations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fit = F.element_at(F.array(*map(F.lit, ("XYZ", "Fit", "FitH", "FitV", "FitR", "Odd"))), (col("p_partkey") % 6).cast("int") + 1)
    d = doc.destination(fit, F.array(*(col("p_size") * float(k) for k in (1, 2, 3, 4))))
    return part.select("p_partkey", *(d[x].alias(x) for x in ("fit", "left", "top", "right", "bottom", "zoom")), doc.page_of_number(col("p_size") - 5, F.lit(30)).alias("page"))


def quad_bounds(spark, sf_dir):
    """Regions of links with two quads each."""
    part = table(spark, sf_dir, "part")
    points = F.array(*((col("p_size") * float(a) + float(b)) for a, b in ((1, 0), (2, 5), (1, 9), (2, 0), (3, 1), (1, 1), (0, 2), (1, 4), (5, 0), (5, 1), (6, 0), (6, 1), (5, 3), (4, 4), (6, 6), (2, 2))))
    out = part.select("p_partkey", F.posexplode(doc.quad_regions(points)).alias("region", "b"))
    return out.select("p_partkey", "region", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def match_navigation(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", doc.next_match(col("p_size"), F.lit(-3), (col("p_partkey") % 6).cast("int")).alias("match"), F.round(doc.fit_zoom(col("p_size") * 10.0, F.lit(400.0), F.lit(612.0), F.lit(792.0)), 6).alias("zoom"))


QUERIES = {f.__name__: f for f in (font_traits, blend_modes, destinations, quad_bounds, match_navigation)}

_FONTS = "['Courier-Bold', 'TimesNewRoman', 'Arial-Italic', 'Minion', 'Helvetica-Oblique'][p_partkey % 5 + 1]"
_STYLES = ["multiply", "screen", "overlay", "darken", "lighten", "color-dodge", "color-burn", "hard-light", "soft-light", "difference", "exclusion", "hue", "saturation", "color", "luminosity", "", ""]
_X, _Y = ["p_size", "p_size + 9", "p_size * 3 + 1", "2.0"], ["p_size * 2 + 5", "p_size * 2", "p_size + 1", "p_size + 4"]
_X2, _Y2 = ["p_size * 5", "p_size * 6", "p_size * 5 + 3", "p_size * 6 + 6"], ["p_size * 5 + 1", "p_size * 6 + 1", "p_size * 4 + 4", "p_size * 2 + 2"]
_quad = lambda r, x, y: f"SELECT p_partkey, {r} AS region, " + ", ".join(f"CAST({f}({', '.join(v)}) AS DOUBLE) AS {n}" for f, v, n in (("least", x, "x0"), ("least", y, "y0"), ("greatest", x, "x1"), ("greatest", y, "y1"))) + " FROM part"
SQL = {
    "font_traits": f"""SELECT p_partkey, f AS base_font, CASE WHEN f LIKE 'Courier%' THEN 'monospace' WHEN f IN ('TimesNewRoman', 'Minion') THEN 'serif' ELSE 'sans-serif' END AS family,
        f = 'Courier-Bold' OR p_size >= 35 OR p_size % 7 = 0 AS bold, f IN ('Arial-Italic', 'Helvetica-Oblique') OR (p_size % 7 <> 0 AND p_size % 5 = 0) AS italic FROM (SELECT *, {_FONTS} AS f FROM part)""",
    "blend_modes": f"SELECT p_partkey, {_STYLES}[p_partkey % {len(MODES)} + 1] AS style FROM part",
    "destinations": """SELECT p_partkey, f AS fit, CAST(CASE WHEN f IN ('XYZ', 'FitR', 'FitV') THEN s END AS DOUBLE) AS "left", CAST(CASE f WHEN 'XYZ' THEN 2 * s WHEN 'FitH' THEN s WHEN 'FitR' THEN 4 * s END AS DOUBLE) AS top,
        CAST(CASE f WHEN 'FitR' THEN 3 * s END AS DOUBLE) AS "right", CAST(CASE f WHEN 'FitR' THEN 2 * s END AS DOUBLE) AS bottom, CAST(CASE f WHEN 'XYZ' THEN 3 * s END AS DOUBLE) AS zoom, CAST(greatest(least(s - 4, 30), 1) AS INT) AS page
        FROM (SELECT p_partkey, p_size AS s, ['XYZ', 'Fit', 'FitH', 'FitV', 'FitR', 'Unknown'][p_partkey % 6 + 1] AS f FROM part)""",
    "quad_bounds": f"{_quad(0, _X, _Y)} UNION ALL {_quad(1, _X2, _Y2)}",
    "match_navigation": "SELECT p_partkey, CASE WHEN n > 0 THEN CAST(((p_size - 3) % n + n) % n AS INT) ELSE -1 END AS match, round(least(p_size * 10.0::DOUBLE / 612, 400.0::DOUBLE / 792), 6) AS zoom FROM (SELECT *, p_partkey % 6 AS n FROM part)",
}
