"""Smaller document semantics as Column expressions: fonts, blend modes, destinations, annotations, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blend modes with a style of their own.
BLEND = ("Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "SoftLight", "Difference", "Exclusion", "Hue", "Saturation", "Color", "Luminosity")
#: Parts of font names that tell a family.
MONOSPACE, SERIF = ("courier", "mono"), ("times", "serif", "roman", "georgia", "minion", "garamond")


def blend_style(mode: Column) -> Column:
    """multiply, color-dodge, ...; '' for Normal and unknown modes."""
    return F.when(mode.isin(*BLEND), F.lower(F.regexp_replace(mode, "(?<=[a-z])([A-Z])", "-$1"))).otherwise("")


def base_font(name: Column) -> Column:
    """A font's name without the tag of a subset."""
    return F.regexp_replace(name, r"^[^+]*\+", "")


def font_family(name: Column) -> Column:
    low = F.lower(base_font(name))
    has = lambda parts: F.regexp_like(low, F.lit("|".join(parts)))
    return F.when(has(MONOSPACE), "monospace").when(has(SERIF), "serif").otherwise("sans-serif")


def is_bold(name: Column, stem: Column, flags: Column) -> Column:
    return F.lower(name).contains("bold") | (F.coalesce(stem, F.lit(0)) >= 140) | (F.coalesce(flags, F.lit(0)).bitwiseAND(0x40000) != 0)


def is_italic(name: Column, angle: Column, flags: Column) -> Column:
    return F.lower(name).contains("italic") | F.lower(name).contains("oblique") | (F.coalesce(angle, F.lit(0)) != 0) | (F.coalesce(flags, F.lit(0)).bitwiseAND(64) != 0)


def colour_kind(operands: Column) -> Column:
    """The device space that a number of colour operands means."""
    return F.when(F.size(operands) == 1, "gray").when(F.size(operands) == 3, "rgb").when(F.size(operands) == 4, "cmyk")


def header_version(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring(text, 1, 1024), r"%PDF-([^\r\n ]*)", 1), F.lit(""))


def header_offset(text: Column) -> Column:
    """Bytes of junk before the header, 0 without one."""
    return F.greatest(F.instr(F.substring(text, 1, 1024), F.lit("%PDF-")) - 1, F.lit(0))


def effective_version(header: Column, catalog: Column) -> Column:
    """The catalog's version if it is the greater one."""
    return F.greatest(header, catalog)


def destination(fit: Column, args: Column) -> Column:
    """struct(fit, left, top, right, bottom, zoom) of an explicit destination's name and numbers; unknown names give Unknown."""
    arg = lambda i: F.get(args, F.lit(i))
    none = F.lit(None).cast("double")
    known = F.when(fit.isin("XYZ", "Fit", "FitB", "FitH", "FitBH", "FitV", "FitBV", "FitR"), fit).otherwise("Unknown")
    return F.struct(
        known.alias("fit"), F.when(fit.isin("XYZ", "FitR", "FitV", "FitBV"), arg(0)).otherwise(none).alias("left"),
        F.when(fit == "XYZ", arg(1)).when(fit.isin("FitH", "FitBH"), arg(0)).when(fit == "FitR", arg(3)).otherwise(none).alias("top"),
        F.when(fit == "FitR", arg(2)).otherwise(none).alias("right"), F.when(fit == "FitR", arg(1)).otherwise(none).alias("bottom"), F.when(fit == "XYZ", arg(2)).otherwise(none).alias("zoom"),
    )


def page_of_number(number: Column, pages: Column) -> Column:
    """Page of a numeric target, which counts from 0 and is clamped into the file."""
    return F.greatest(F.least(number + 1, pages), F.lit(1))


def quad_regions(points: Column) -> Column:
    """Bounds (x0, y0, x1, y1) of each group of four points."""
    n = F.floor(F.size(points) / 8).cast("int")

    def bounds(k: Column) -> Column:
        quad = F.slice(points, k * 8 + 1, 8)
        xs, ys = F.filter(quad, lambda _, i: i % 2 == 0), F.filter(quad, lambda _, i: i % 2 == 1)
        return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), bounds)).otherwise(F.array().cast("array<array<double>>"))


def is_hidden(flags: Column) -> Column:
    """Annotations that are hidden or not viewed."""
    return F.coalesce(flags, F.lit(0)).bitwiseAND(34) != 0


def svg_matrix(m: tuple[Column, ...]) -> Column:
    """matrix(a b c d e f) with four decimals at most."""
    part = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", ""), r"^-0$", "0")
    return F.concat(F.lit("matrix("), F.concat_ws(" ", *map(part, m)), F.lit(")"))


def private_glyph(code: Column, most: int = 0xF8FF) -> Column:
    """Private-use code point of a glyph; -1 past the area."""
    return F.when(code + 0xE000 <= most, code + 0xE000).otherwise(-1)


def fit_zoom(view_w: Column, view_h: Column, page_w: Column, page_h: Column) -> Column:
    return F.least(view_w / page_w, view_h / page_h)


def next_match(index: Column, step: Column, n: Column) -> Column:
    """Match navigation wraps at both ends."""
    return F.when(n > 0, F.pmod(index + step, n)).otherwise(-1)
