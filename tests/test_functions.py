"""Anchors: values that the formats define."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.functions import colour, geometry, numeric
from foliospark.functions import text as tx


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_colours(spark):
    c = colour.cmyk(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0))
    assert one(spark, c["r"], c["g"], c["b"]) == (255, 46, 23)
    assert one(spark, colour.gray(F.lit(0.5))["r"]) == 128


def test_functions(spark):
    f = lambda x, y: numeric.sampled([F.lit(x), F.lit(y)], [0, 255, 255, 255], [2, 2], 8, [0, 1, 0, 1], [0, 1])[0]
    assert one(spark, f(0.5, 0.0), f(0.0, 0.5)) == (0.5, 0.5)
    assert one(spark, *numeric.exponential(F.lit(0.5), [0, 0, 0], [1, 0.5, 0], 1)) == (0.5, 0.25, 0.0)


@pytest.mark.parametrize(
    ("program", "out"),
    [("{ 2 copy add 3 1 roll pop pop }", 5.0), ("{ pop dup 0 div add }", 2.0), ("{ exch pop 7 2 idiv mul }", 9.0), ("{ pop -7 3 mod exch pop }", -1.0), ("{ pop pop 2.5 round -2.5 round add }", 0.0), ("{ pop pop 1 -1 atan }", 135.0),
     ("{ pop pop 5 3 and 4 bitshift }", 16.0), ("{ gt { 1 } { 8 } ifelse }", 8.0), ("{ pop pop 3 not 0 not add }", 1.0), ("{ pop pop pop 4 }", 4.0)],
)
def test_calculator(spark, program, out):
    (c,) = numeric.calculator(program, [F.lit(2.0), F.lit(3.0)], [-9, 9, -9, 9], [-1000, 1000])
    assert one(spark, c) == pytest.approx(out)


def test_dates(spark):
    for raw, at, offset in [("D:2024", (2024, 1, 1), 0), ("20231231", (2023, 12, 31), 0), ("D:20240229120000Z", (2024, 2, 29, 12), 0), ("D:20230231", (2023, 2, 28), 0), ("D:20240102030405-02'30'", (2024, 1, 2, 3, 4, 5), -150)]:
        got = one(spark, tx.pdf_date(F.lit(raw)))
        assert (got["at"], got["offset_minutes"]) == (datetime.datetime(*at), offset)
    assert one(spark, tx.pdf_date(F.lit("soon"))) is None


def test_labels_and_text(spark):
    assert one(spark, tx.roman(F.lit(1994)), tx.roman(F.lit(0)), tx.alpha(F.lit(28))) == ("MCMXCIV", "0", "BB")
    assert one(spark, tx.page_label(F.lit("r"), F.lit("A-"), F.lit(4)), tx.page_label(F.lit(None).cast("string"), F.lit("x"), F.lit(4))) == ("A-iv", "x")
    assert one(spark, tx.html_escape(F.lit('a<b>&"\x01\t'))) == "a&lt;b&gt;&amp;&quot;\t"
    assert one(spark, tx.is_allowed_uri(F.lit("HTTPS://x")), tx.is_allowed_uri(F.lit("javascript:1")), tx.is_allowed_uri(F.lit(":x")), tx.is_allowed_uri(F.lit("a/b:c"))) == (True, False, False, False)
    assert one(spark, tx.glyph_unicode(F.lit("uni20AC")), tx.glyph_unicode(F.lit("u1F600")), tx.glyph_unicode(F.lit(".notdef"))) == ("€", "\U0001f600", "")
    assert one(spark, tx.match_offsets(F.lit("abABab"), "ab")) == [0, 2, 4]
    assert one(spark, tx.fnv1a32(F.lit("a"))) == 0xE40C292C


def test_geometry(spark):
    m = tuple(map(F.lit, (2.0, 0.0, 0.0, 4.0, 1.0, 1.0)))
    x, y = geometry.apply(geometry.invert(m), F.lit(5.0), F.lit(9.0))
    assert one(spark, x, y, geometry.scale_factor(m)) == (2.0, 2.0, 3.0)
    flat = tuple(map(F.lit, (1.0, 2.0, 2.0, 4.0, 0.0, 0.0)))
    assert one(spark, geometry.invert(flat)[0]) is None
