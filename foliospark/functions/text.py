"""Text semantics as Column expressions: escaping, numerals, dates, links, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URI schemes that a link may have.
SCHEMES = ("http", "https", "mailto", "ftp", "tel")
#: Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def html_escape(text: Column) -> Column:
    """&, <, > and " as entities; control characters other than tab and line ends go."""
    out = text
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(entity))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def uri_scheme(uri: Column) -> Column:
    """The lower-case scheme, or '' where no scheme of ASCII letters, digits, +, - and . comes before the first colon."""
    return F.lower(F.regexp_extract(uri, r"^([A-Za-z0-9+.-]+):", 1))


def is_allowed_uri(uri: Column) -> Column:
    return uri_scheme(uri).isin(*SCHEMES)


def roman(n: Column) -> Column:
    """Upper-case roman numeral; numbers below 1 stay decimal, over 3999 repeats M."""
    parts, rest = [], n
    for value, symbol in ROMAN:
        parts.append(F.repeat(F.lit(symbol), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n <= 0, n.cast("string")).otherwise(F.concat(*parts))


def alpha(n: Column, first: str = "A") -> Column:
    """A to Z, then AA, BB, ...; numbers below 1 stay decimal."""
    letter = F.char(F.lit(ord(first)) + (n - 1) % 26)
    return F.when(n <= 0, n.cast("string")).otherwise(F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int")))


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    """A page's label from its range's style (D, r, R, a, A; none: prefix alone), prefix and number."""
    number = F.when(style == "D", n.cast("string")).when(style == "r", F.lower(roman(n))).when(style == "R", roman(n)).when(style == "a", alpha(n, "a")).when(style == "A", alpha(n))
    return F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(number, F.lit("")))


def pdf_date(raw: Column) -> Column:
    """struct(local timestamp, offset_minutes) of D:YYYYMMDDHHmmSS+HH'mm'; parts after the year may lack, parts are clamped, days to the month's end."""
    pattern = r"^\s*(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:Z|([+-])(\d{2})?'?(\d{2})?)?"

    def part(i: int, default: int) -> Column:
        return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(raw, pattern, i), F.lit("")), F.lit("9999")).cast("int"), F.lit(default))

    def clamp(x: Column, low: int, high: int) -> Column:
        return F.greatest(F.least(x, F.lit(high)), F.lit(low))

    year, month = part(1, 0), clamp(part(2, 1), 1, 12)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    day = F.least(clamp(part(3, 1), 1, 31), last)
    at = F.make_timestamp_ntz(year, month, day, clamp(part(4, 0), 0, 23), clamp(part(5, 0), 0, 59), clamp(part(6, 0), 0, 59).cast("decimal(8,6)"))
    sign = F.when(F.regexp_extract(raw, pattern, 7) == "-", -1).otherwise(1)
    offset = sign * (part(8, 0) * 60 + part(9, 0))
    ok = F.regexp_like(raw, F.lit(pattern)) & (year > 0)
    return F.when(ok, F.struct(at.alias("at"), offset.alias("offset_minutes")))


def match_count(text: Column, query: str) -> Column:
    """Non-overlapping matches of query, ignoring case."""
    low, q = F.lower(text), query.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("long")


def match_offsets(text: Column, query: str, block: int = 256) -> Column:
    """Array of the 0-based places of those matches: gaps between matches, summed up within blocks and over blocks, so no long array grows step by step. For a row per match see match_places."""
    low, q = F.lower(text), query.lower()
    pieces = F.split(low, r"\Q" + q + r"\E", -1)
    steps = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda g: F.length(g) + len(q))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, F.lit(block)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda t, v: t + v)
    sums = F.transform(blocks, total)
    grow = lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["all"], a["at"] + v - len(q)).alias("all"))
    places = lambda x, i: F.aggregate(x, F.struct(total(F.slice(sums, F.lit(1), i)).alias("at"), F.array().cast("array<int>").alias("all")), grow, lambda a: a["all"])
    return F.when(F.size(steps) > 0, F.flatten(F.transform(blocks, places))).when(text.isNotNull(), F.array().cast("array<int>"))


def hex_string(text: Column) -> Column:
    """Bytes of a hex string: other characters are skipped, an odd digit is padded with 0."""
    digits = F.regexp_replace(F.regexp_extract(text, r"^([^>]*)", 1), "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def glyph_unicode(name: Column) -> Column:
    """Character of the glyph names uniXXXX and uXXXX to uXXXXXX, of single letters, else ''."""
    code = F.coalesce(F.nullif(F.regexp_extract(name, r"^uni([0-9A-Fa-f]{4})", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"^u([0-9A-Fa-f]{4,6})$", 1), F.lit("")))
    wide = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    return F.when(code.isNotNull(), wide).when(F.length(name) == 1, name).otherwise(F.lit(""))


def data_uri(data: Column, kind: str) -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(data), "\r\n", ""))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-16 code units below 0x10000 as one step each, in long arithmetic."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619) % 4294967296)


def permission_flags(p: Column, encrypted: Column) -> Column:
    """struct of the eight rights in bits 3, 4, 5, 6, 9, 10, 11, 12; everything is allowed without encryption."""
    names = {3: "print", 4: "modify", 5: "copy", 6: "annotate", 9: "fill_forms", 10: "accessibility", 11: "assemble", 12: "print_high"}
    return F.struct(*((~encrypted | (F.getbit(p, F.lit(bit - 1)) == 1)).alias(name) for bit, name in names.items()))


def join_all(parts: list[Column], sep: str = "") -> Column:
    return reduce(lambda a, b: F.concat(a, F.lit(sep), b), parts)
