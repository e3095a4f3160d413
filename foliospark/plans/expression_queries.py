"""Queries over the Column expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import colour, geometry, numeric
from foliospark.functions import text as tx
from foliospark.operators.relational import match_places
from foliospark.plans.relational_queries import table

col = F.col
PALETTE = [(255, 0, 0), (0, 128, 0), (0, 0, 255), (240, 240, 10)]
PROGRAM = "{ dup 0.05 gt { 2 exp 100 mul } { pop 0.5 } ifelse dup 2 index add 3 1 roll exch sub abs sqrt }"


def search_pages(spark, sf_dir):
    """Pages that hold a query, with their number of matches; case is ignored."""
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("the")))
    return docs.select("doc_id", tx.match_count(col("text"), "the").alias("n_matches"))


def search_offsets(spark, sf_dir):
    """Each match's place."""
    return match_places(table(spark, sf_dir, "documents"), ["doc_id"], "text", "tion")


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.html_escape(col("html"))).alias("escaped_md5"))


def uri_whitelist(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(col("page_id") % 3 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(col("url")).alias("uri"))
    return pages.select("page_id", tx.uri_scheme(col("uri")).alias("scheme"), tx.is_allowed_uri(col("uri")).alias("allowed"))


def roman_alpha(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", tx.roman(col("p_size")).alias("roman"), tx.alpha(col("p_size")).alias("alpha"), tx.roman((col("p_partkey") % 4500).cast("int")).alias("big"))


def pdf_dates(spark, sf_dir):
    """Dates written as D:YYYYMMDDHHmmSS+02'30' and read back; the day is pushed past the month's end to be clamped."""
    orders = table(spark, sf_dir, "orders")
    raw = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMM"), F.lit("31"), F.date_format("o_orderdate", "HHmmss"), F.lit("+02'30'"))
    d = tx.pdf_date(raw)
    return orders.select("o_orderkey", F.date_format(d["at"], "yyyy-MM-dd HH:mm:ss").alias("at"), d["offset_minutes"].alias("offset_minutes"))


def base64_uri(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.data_uri(col("text").cast("binary"), "text/plain")).alias("uri_md5"))


def digest(spark, sf_dir):
    raw = col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"))


def hex_string(spark, sf_dir):
    """Hex strings with a cut last digit and stray characters, decoded."""
    part = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("4 1"), F.hex(F.col("p_name").cast("binary")), F.lit("5>ff"))
    return part.select("p_partkey", F.hex(tx.hex_string(raw)).alias("decoded"))


def glyph_unicode(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    code = (col("p_partkey") % 900 + 33).cast("int")
    return part.select("p_partkey", tx.glyph_unicode(F.concat(F.lit("uni"), F.lpad(F.hex(code), 4, "0"))).alias("glyph"))


def permission_bits(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    flags = tx.permission_flags(col("c_custkey").cast("int"), col("c_custkey") % 5 != 0)
    return customer.select("c_custkey", flags["print"].alias("can_print"), flags["modify"].alias("can_modify"), flags["copy"].alias("can_copy"), flags["fill_forms"].alias("can_fill"), flags["print_high"].alias("can_print_high"))


def fn_exponential(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a, b, c = numeric.exponential(col("p_size") / 50.0, [0, 0, 0], [1, 0.5, 0], 1.7)
    return part.select("p_partkey", F.round(a, 6).alias("c0"), F.round(b, 6).alias("c1"), F.round(c, 6).alias("c2"))


def fn_stitching(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    linear = lambda x: numeric.exponential(x, [0], [1], 1)
    square = lambda x: numeric.exponential(x, [1], [0], 2)
    (y,) = numeric.stitching(col("p_size") / 50.0, [linear, square, linear], [0.3, 0.7], [0, 1, 1, 0, 0.2, 0.8])
    return part.select("p_partkey", F.round(y, 6).alias("y"))


def fn_sampled_1d(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    (y,) = numeric.sampled([col("p_size") / 50.0], [0, 10, 200, 255, 100], [5], 8, [0, 1], [0, 1])
    return part.select("p_partkey", F.round(y, 6).alias("y"))


def fn_sampled_2d(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    (y,) = numeric.sampled([col("p_size") / 50.0, col("p_retailprice") / 2000.0], [0, 255, 255, 255], [2, 2], 8, [0, 1, 0, 1], [0, 1])
    return part.select("p_partkey", F.round(y, 6).alias("y"))


def fn_postscript(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a, b = numeric.calculator(PROGRAM, [col("p_retailprice") / 1000.0, col("p_size") / 50.0], [0, 4, 0, 1], [0, 200, 0, 200])
    return part.select("p_partkey", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


def cmyk_to_rgb(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    c = colour.cmyk(col("p_size") / 50.0, (col("p_partkey") % 7) / 6.0, (col("p_partkey") % 5) / 4.0, (col("p_partkey") % 11) / 20.0)
    return part.select("p_partkey", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), colour.css(c).alias("css"))


def lab_to_rgb(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    c = colour.lab(col("p_size") * 2.0, (col("p_partkey") % 201 - 100).cast("double"), (col("p_partkey") % 151 - 75).cast("double"))
    return part.select("p_partkey", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


def indexed_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    c = colour.indexed((col("p_size") % 6).cast("double"), PALETTE)
    return part.select("p_partkey", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


def device_colours(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    g, c = colour.gray(col("p_size") / 50.0), colour.rgb(col("p_size") / 40.0, (col("p_partkey") % 3) / 2.0, F.lit(0.5))
    return part.select("p_partkey", g["r"].alias("gray"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


def _matrix():
    return (col("p_size") / 10.0, F.lit(0.5), F.lit(-0.25), col("p_size") / 20.0, F.lit(3.0), F.lit(4.0))


def matrix_apply(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    m = geometry.concat((F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(10.0), F.lit(800.0)), _matrix())
    x, y = geometry.apply(m, col("p_retailprice"), F.lit(5.0))
    back = geometry.apply(geometry.invert(m), x, y)
    return part.select("p_partkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(geometry.scale_factor(m), 6).alias("scale"), F.round(back[0], 2).alias("back_x"))


def box_intersect(spark, sf_dir):
    """Crop boxes normalised and cut to media boxes; width and height swap on quarter turns."""
    part = table(spark, sf_dir, "part")
    media = [F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0)]
    crop = geometry.intersect(media, geometry.normalise([col("p_retailprice") - 1000, col("p_size") * 20.0, F.lit(300.0), F.lit(500.0)]))
    w, h = crop[2] - crop[0], crop[3] - crop[1]
    turned = (col("p_partkey") % 4 * 90).isin(90, 270)
    return part.select("p_partkey", F.round(crop[0], 4).alias("x0"), crop[1].alias("y0"), F.round(F.when(turned, h).otherwise(w), 4).alias("width"), F.round(F.when(turned, w).otherwise(h), 4).alias("height"))


def viewport(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    x, y = geometry.apply(geometry.viewport(col("p_partkey") % 4 * 90, F.lit(612.0), F.lit(792.0)), col("p_size").cast("double"), F.lit(10.0))
    return part.select("p_partkey", x.alias("x"), y.alias("y"))


def cell_range(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    low, high = geometry.cell_range(col("p_size") * 1.0, col("p_retailprice"), F.lit(37.5))
    return part.select("p_partkey", low.cast("long").alias("first_cell"), high.cast("long").alias("last_cell"))


QUERIES = {f.__name__: f for f in (
    search_pages, search_offsets, html_escape, uri_whitelist, roman_alpha, pdf_dates, base64_uri, digest, hex_string, glyph_unicode, permission_bits, fn_exponential, fn_stitching, fn_sampled_1d, fn_sampled_2d,
    fn_postscript, cmyk_to_rgb, lab_to_rgb, indexed_lookup, device_colours, matrix_apply, box_intersect, viewport, cell_range,
)}


def _clip(x, lo, hi):
    return f"greatest(least({x}, {hi}), {lo})"


def _poly(channel: str) -> str:
    rows = []
    for name in "cmyk":
        inner = " + ".join(f"{v!r}::DOUBLE * {key[1]}" if len(key) == 2 else f"({v!r}::DOUBLE)" for key, v in colour.CMYK[channel].items() if key[0] == name)
        rows.append(f"{name} * (0.0::DOUBLE + {inner})")
    return f"CAST(round_even(greatest(least(255::DOUBLE + {' + '.join(rows)}, 255), 0), 0) AS INT)"


def _roman(n: str) -> str:
    from foliospark.functions.text import ROMAN

    parts, rest = [], n
    for value, symbol in ROMAN:
        parts.append(f"repeat('{symbol}', CAST(({rest}) // {value} AS BIGINT))")
        rest = f"({rest}) % {value}"
    return f"CASE WHEN {n} <= 0 THEN CAST({n} AS VARCHAR) ELSE " + " || ".join(parts) + " END"


_LAB = """lab AS (SELECT p_partkey, (least(p_size * 2.0::DOUBLE, 100) + 16) / 116 AS m, (p_partkey % 201 - 100)::DOUBLE AS a, (p_partkey % 151 - 75)::DOUBLE AS b FROM part),
lmn AS (SELECT p_partkey, m + a / 500 AS l, m, m - b / 200 AS n FROM lab),
xyz AS (SELECT p_partkey, 0.9642::DOUBLE * d(l) AS x, 1.0::DOUBLE * d(m) AS y, 0.8249::DOUBLE * d(n) AS z FROM lmn)"""
_D = "CASE WHEN {t} >= 6.0::DOUBLE / 29 THEN {t} * {t} * {t} ELSE 3 * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29) * ({t} - 4.0::DOUBLE / 29) END"
for _t in "lmn":
    _LAB = _LAB.replace(f"d({_t})", f"({_D.format(t=_t)})")


def _gamma(row) -> str:
    v = f"greatest(least(0.0::DOUBLE + {' + '.join(f'({f!r}::DOUBLE) * {x}' for f, x in zip(row, 'xyz'))}, 1), 0)"
    return f"CAST(round_even(greatest(least(CASE WHEN {v} <= 0.0031308 THEN 12.92::DOUBLE * {v} ELSE 1.055::DOUBLE * pow({v}, 1 / 2.4::DOUBLE) - 0.055 END, 1), 0) * 255, 0) AS INT)"


_BYTE = "CAST(round_even(greatest(least({x}, 1), 0) * 255, 0) AS INT)"
_S = "(p_size / 50.0::DOUBLE)"
SQL = {
    "search_pages": "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS n_matches FROM documents WHERE contains(lower(text), 'the')",
    "search_offsets": """
        WITH p AS (SELECT doc_id, string_split(lower(text), 'tion') AS parts FROM documents),
        u AS (SELECT doc_id, unnest(parts[1:len(parts) - 1]) AS part, unnest(range(len(parts) - 1)) AS i FROM p WHERE len(parts) > 1)
        SELECT doc_id, CAST(i AS INT) AS match_no, CAST(sum(length(part) + 4) OVER (PARTITION BY doc_id ORDER BY i) - 4 AS INT) AS place FROM u""",
    "html_escape": r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS escaped_md5 FROM pages""",
    "uri_whitelist": """SELECT page_id, scheme, scheme IN ('http', 'https', 'mailto', 'ftp', 'tel') AS allowed
        FROM (SELECT page_id, lower(regexp_extract(CASE WHEN page_id % 3 = 0 THEN 'javascript:' || url ELSE url END, '^([A-Za-z0-9+.-]+):', 1)) AS scheme FROM pages)""",
    "roman_alpha": f"SELECT p_partkey, {_roman('p_size')} AS roman, repeat(chr(CAST(65 + (p_size - 1) % 26 AS INT)), (p_size - 1) // 26 + 1) AS alpha, {_roman('(p_partkey % 4500)')} AS big FROM part",
    "pdf_dates": "SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') || ' ' || strftime(o_orderdate, '%H:%M:%S') AS at, 150 AS offset_minutes FROM orders",
    "base64_uri": "SELECT doc_id, md5('data:text/plain;base64,' || base64(encode(text))) AS uri_md5 FROM documents",
    "digest": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "hex_string": "SELECT p_partkey, '41' || hex(encode(p_name)) || '50' AS decoded FROM part",
    "glyph_unicode": "SELECT p_partkey, chr(CAST(p_partkey % 900 + 33 AS INT)) AS glyph FROM part",
    "permission_bits": "SELECT c_custkey, " + ", ".join(f"c_custkey % 5 = 0 OR (c_custkey >> {b - 1}) & 1 = 1 AS {n}" for b, n in ((3, "can_print"), (4, "can_modify"), (5, "can_copy"), (9, "can_fill"), (12, "can_print_high"))) + " FROM customer",
    "fn_exponential": f"SELECT p_partkey, round(pow({_S}, 1.7), 6) AS c0, round(pow({_S}, 1.7) * 0.5, 6) AS c1, 0.0::DOUBLE AS c2 FROM part",
    "fn_stitching": f"""SELECT p_partkey, round(CASE WHEN x < 0.3 THEN x / 0.3 WHEN x < 0.7 THEN 1 - pow(1 - (x - 0.3) / 0.4, 2) ELSE 0.2 + (x - 0.7) / 0.3 * 0.6 END, 6) AS y FROM (SELECT p_partkey, {_S} AS x FROM part)""",
    "fn_sampled_1d": f"""SELECT p_partkey, round((s[i + 1] * (1 - f) + s[least(i + 1, 4) + 1] * f) / 255, 6) AS y
        FROM (SELECT p_partkey, [0, 10, 200, 255, 100] AS s, CAST(least(floor({_S} * 4), 4) AS INT) AS i, {_S} * 4 - least(floor({_S} * 4), 4) AS f FROM part)""",
    "fn_sampled_2d": f"SELECT p_partkey, round(1 - (1 - {_S}) * (1 - least(p_retailprice / 2000.0::DOUBLE, 1)), 6) AS y FROM part",
    "fn_postscript": f"""SELECT p_partkey, round({_clip('q + p', 0, 200)}, 6) AS a, round({_clip('sqrt(abs(q - p))', 0, 200)}, 6) AS b
        FROM (SELECT p_partkey, p, CASE WHEN s > 0.05 THEN pow(s, 2) * 100 ELSE 0.5 END AS q FROM (SELECT p_partkey, least(p_retailprice / 1000.0::DOUBLE, 4) AS p, {_S} AS s FROM part))""",
    "cmyk_to_rgb": f"""SELECT p_partkey, r, g, b, 'rgb(' || r || ',' || g || ',' || b || ')' AS css FROM (SELECT p_partkey, {', '.join(f'{_poly(x)} AS {x}' for x in 'rgb')}
        FROM (SELECT p_partkey, {_S} AS c, (p_partkey % 7) / 6.0::DOUBLE AS m, (p_partkey % 5) / 4.0::DOUBLE AS y, (p_partkey % 11) / 20.0::DOUBLE AS k FROM part))""",
    "lab_to_rgb": f"WITH {_LAB} SELECT p_partkey, {', '.join(f'{_gamma(colour.XYZ_RGB[x])} AS {x}' for x in 'rgb')} FROM xyz",
    "indexed_lookup": f"SELECT p_partkey, {', '.join(f'{[row[k] for row in PALETTE]}[least(p_size % 6, 3) + 1] AS {x}' for k, x in enumerate('rgb'))} FROM part",
    "device_colours": f"SELECT p_partkey, {_BYTE.format(x=_S)} AS gray, {_BYTE.format(x='p_size / 40.0::DOUBLE')} AS r, {_BYTE.format(x='(p_partkey % 3) / 2.0::DOUBLE')} AS g, 128 AS b FROM part",
    "matrix_apply": """SELECT p_partkey, round(2 * ux + 10, 4) AS x, round(800 - uy, 4) AS y, round((sqrt((2 * a) * (2 * a) + 0.25) + sqrt(0.25 + d * d)) / 2, 6) AS scale, round(p_retailprice, 2) AS back_x
        FROM (SELECT p_partkey, p_retailprice, a, d, a * p_retailprice - 0.25 * 5 + 3 AS ux, 0.5 * p_retailprice + d * 5 + 4 AS uy FROM (SELECT *, p_size / 10.0::DOUBLE AS a, p_size / 20.0::DOUBLE AS d FROM part))""",
    "box_intersect": """SELECT p_partkey, round(x0, 4) AS x0, y0, round(CASE WHEN p_partkey % 2 = 1 THEN h ELSE w END, 4) AS width, round(CASE WHEN p_partkey % 2 = 1 THEN w ELSE h END, 4) AS height
        FROM (SELECT *, least(612, x1) - x0 AS w, least(792, y1) - y0 AS h FROM (SELECT p_partkey, greatest(0.0::DOUBLE, least(p_retailprice - 1000, 300)) AS x0, greatest(0.0::DOUBLE, least(p_size * 20.0::DOUBLE, 500)) AS y0,
          greatest(p_retailprice - 1000, 300) AS x1, greatest(p_size * 20.0::DOUBLE, 500) AS y1 FROM part))""",
    "viewport": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN s WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 612 - s ELSE 792.0::DOUBLE - 10 END AS x,
        CASE p_partkey % 4 WHEN 0 THEN 792.0::DOUBLE - 10 WHEN 1 THEN s WHEN 2 THEN 10.0::DOUBLE ELSE 612 - s END AS y FROM (SELECT p_partkey, p_size::DOUBLE AS s FROM part)""",
    "cell_range": "SELECT p_partkey, CAST(floor(least(p_size / 37.5::DOUBLE, p_retailprice / 37.5::DOUBLE)) - 1 AS BIGINT) AS first_cell, CAST(ceil(greatest(p_size / 37.5::DOUBLE, p_retailprice / 37.5::DOUBLE)) + 1 AS BIGINT) AS last_cell FROM part",
}
