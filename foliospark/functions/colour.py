"""Colour spaces as Column expressions; results are bytes, halves rounded to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.numeric import clamp, num

#: The public polynomial fit of CMYK to sRGB. Per channel: terms by the product they multiply.
CMYK = {
    "r": {"cc": -4.387332384609988, "cm": 54.48615194189176, "cy": 18.82290502165302, "ck": 212.25662451639585, "c": -285.2331026137004, "mm": 1.7149763477362134, "my": -5.6096736904047315, "mk": -17.873870861415444, "m": -5.497006427196366, "yy": -2.5217340131683033, "yk": -21.248923337353073, "y": 17.5119270841813, "kk": -21.86122147463605, "k": -189.48180835922747},
    "g": {"cc": 8.841041422036149, "cm": 60.118027045597366, "cy": 6.871425592049007, "ck": 31.159100130055922, "c": -79.2970844816548, "mm": -15.310361306967817, "my": 17.575251261109482, "mk": 131.35250912493976, "m": -190.9453302588951, "yy": 4.444339102852739, "yk": 9.8632861493405, "y": -24.86741582555878, "kk": -20.737325471181034, "k": -187.80453709719578},
    "b": {"cc": 0.8842522430003296, "cm": 8.078677503112928, "cy": 30.89978309703729, "ck": -0.23883238689178934, "c": -14.183576799673286, "mm": 10.49593273432072, "my": 63.02378494754052, "mk": 50.606957656360734, "m": -112.23884253719248, "yy": 0.03296041114873217, "yk": 115.60384449646641, "y": -193.58209356861505, "kk": -22.33816807309886, "k": -180.12613974708367},
}
#: XYZ (D50) to linear sRGB.
XYZ_RGB = {"r": (3.1339, -1.6169, -0.4906), "g": (-0.9785, 1.9160, 0.0333), "b": (0.0720, -0.2290, 1.4057)}


def to_byte(v: Column) -> Column:
    return F.rint(clamp(v, 0, 1) * 255).cast("int")


def gray(v: Column) -> dict[str, Column]:
    return {c: to_byte(v) for c in "rgb"}


def rgb(r: Column, g: Column, b: Column) -> dict[str, Column]:
    return {"r": to_byte(r), "g": to_byte(g), "b": to_byte(b)}


def cmyk(c: Column, m: Column, y: Column, k: Column) -> dict[str, Column]:
    ink = {"c": clamp(c, 0, 1), "m": clamp(m, 0, 1), "y": clamp(y, 0, 1), "k": clamp(k, 0, 1)}
    out = {}
    for channel, terms in CMYK.items():
        total = F.lit(255.0)
        for name in "cmyk":
            inner = F.lit(0.0)
            for key, factor in terms.items():
                if key[0] == name:
                    inner = inner + (F.lit(factor) * ink[key[1]] if len(key) == 2 else F.lit(factor))
            total = total + ink[name] * inner
        out[channel] = F.rint(clamp(total, 0, 255)).cast("int")
    return out


def lab(l: Column, a: Column, b: Column, white=(0.9642, 1.0, 0.8249), limits=(-100, 100, -100, 100)) -> dict[str, Column]:
    m = (clamp(l, 0, 100) + 16) / 116
    along = (m + clamp(a, *limits[:2]) / 500, m, m - clamp(b, *limits[2:]) / 200)
    cut = 6.0 / 29.0
    xyz = [F.lit(float(w)) * F.when(t >= cut, t * t * t).otherwise(3 * cut * cut * (t - 4.0 / 29.0)) for w, t in zip(white, along)]
    out = {}
    for channel, row in XYZ_RGB.items():
        v = clamp(sum((F.lit(f) * x for f, x in zip(row, xyz)), F.lit(0.0)), 0, 1)
        out[channel] = to_byte(F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055))
    return out


def indexed(i: Column, table: list[tuple[int, int, int]]) -> dict[str, Column]:
    """An entry of a palette; indexes are truncated and clamped."""
    at = clamp(num(i), 0, len(table) - 1).cast("int")
    return {c: F.get(F.array(*(F.lit(row[k]) for row in table)), at) for k, c in enumerate("rgb")}


def css(c: dict[str, Column]) -> Column:
    return F.format_string("rgb(%d,%d,%d)", c["r"], c["g"], c["b"])
