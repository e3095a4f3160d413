"""The syntax of PDF objects as patterns and Column expressions: values, dictionaries by nesting, references between objects.

A value is matched whole by one pattern whose brackets nest up to DEPTH levels inside one object (references begin anew), with
possessive repeats throughout, so matching is linear and its stack grows with nesting only. Nothing is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN = "ISO-8859-1"
DEPTH = 24
SPACE = r"[\s\x00]"
REGULAR = r"[^\s\x00/<>\[\]()%{}]"
COMMENT = r"%[^\r\n]*+"


def _nested(open_: str, inside: str, close: str, depth: int) -> str:
    out = f"{open_}(?:{inside})*+{close}"
    for _ in range(depth):
        out = f"{open_}(?:{inside}|{out})*+{close}"
    return out


STRING = _nested(r"\(", r"[^\\()]++|\\[\s\S]", r"\)", 12)
HEX = r"<(?!<)[0-9A-Fa-f\s\x00]*+>"
NAME = rf"/{REGULAR}*+"
REF = rf"\d++{SPACE}++\d++{SPACE}++R(?!{REGULAR})"
GROUP = _nested(r"(?:<<|\[)", rf"{SPACE}++|{COMMENT}|{STRING}|{HEX}|{NAME}|{REGULAR}++", r"(?:>>|\])", DEPTH)
VALUE = rf"(?:{STRING}|{GROUP}|{HEX}|{NAME}|{REF}|{REGULAR}++)"
GAP = rf"(?:{SPACE}|{COMMENT})*+"
#: A flat token: comment, string, hex string, bracket, name, number or operator.
TOKEN = rf"{COMMENT}|{STRING}|<<|>>|{HEX}|{NAME}|\[|\]|{REGULAR}++"
ENTRIES = "array<struct<k:string,v:string>>"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def exploded(df: DataFrame, keep: list[str], values: Column, place: str, value: str) -> DataFrame:
    """The columns to keep, and a row per element of values with its place from 0 on. values are computed once: for posexplode Spark infers filters on them, and computes them again for each."""
    held = df.select(*keep, values.alias("__values")).select(*keep, F.posexplode_outer("__values").alias(place, value))
    return held.where(F.col(place).isNotNull())


def name_text(raw: Column) -> Column:
    """A name's characters, without its slash: #hh is a byte."""
    part = lambda t: F.when(F.regexp_like(t, F.lit("^#..$")), F.decode(F.unhex(F.substring(t, 2, 2)), LATIN)).otherwise(t)
    plain = F.substring(raw, 2, 1 << 30)
    return F.when(plain.contains("#"), F.array_join(F.transform(every(plain, "#[0-9A-Fa-f]{2}|[^#]+|#"), part), "")).otherwise(plain)


def entries(body: Column) -> Column:
    """(k, v) of a dictionary's own entries in order, k without its slash, v as written; none where body is no dictionary."""
    inner = F.regexp_extract(body, rf"(?s)^{GAP}<<(.*)>>", 1)
    pairs = every(inner, rf"{GAP}{NAME}{GAP}{VALUE}")
    cut = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, rf"^{GAP}({NAME})", 1).alias("k"), F.regexp_replace(p, rf"^{GAP}{NAME}{GAP}", "").alias("v")))
    return F.transform(cut, lambda x: F.struct(name_text(x["k"]).alias("k"), x["v"].alias("v")))  # in a step of its own: a name's text reads the name several times


def get(e: Column, *keys: str) -> Column:
    """The value of the first of the keys that is there, null without; of repeated keys the last counts."""
    one = lambda key: F.try_element_at(F.filter(e, lambda x: x["k"] == key), F.lit(-1))["v"]
    return one(keys[0]) if len(keys) == 1 else F.coalesce(*map(one, keys))


def as_ref(v: Column) -> Column:
    return F.nullif(F.regexp_extract(v, rf"^(\d+){SPACE}+\d+{SPACE}+R$", 1), F.lit("")).cast("long")


def as_number(v: Column) -> Column:
    """A number; of several signs the first counts, a second point ends it."""
    return F.regexp_replace(F.nullif(F.regexp_extract(v, r"^[+-]*(?:\d+\.?\d*|\.\d+)", 0), F.lit("")), r"(?<=[+-])[+-]+", "").try_cast("double")


def number_of(t: Column) -> Column:
    """as_number of a value that is at hand (a column or a lambda's variable): plain numbers are cast without being searched."""
    return F.when(F.regexp_like(t, F.lit(r"^-?(?:\d++(?:\.\d*+)?|\.\d++)$")), t.try_cast("double")).otherwise(as_number(t))


def as_int(v: Column) -> Column:
    return as_number(v).cast("long")


def as_name(v: Column) -> Column:
    return F.when(F.startswith(v, F.lit("/")), name_text(v))


def items(v: Column) -> Column:
    """The values of an array, null where v is none."""
    inner = F.regexp_extract(v, r"(?s)^\[(.*)\]$", 1)
    return F.when(F.startswith(v, F.lit("[")), F.filter(every(inner, rf"{COMMENT}|{VALUE}"), lambda t: ~F.startswith(t, F.lit("%"))))


def refs(v: Column) -> Column:
    """Numbers of the references of an array."""
    return F.filter(F.transform(items(v), as_ref), lambda r: r.isNotNull())


def numbers(v: Column) -> Column:
    return F.transform(items(v), number_of)


def literal(raw: Column) -> Column:
    """The characters of a literal string: escapes, octal codes and continued lines undone."""
    tokens = every(raw, r"\\[0-7]{1,3}|\\\r?\n|\\[\s\S]|[^\\]+")
    special = F.create_map(*(F.lit(x) for x in ("n", "\n", "r", "\r", "t", "\t", "b", "\b", "f", "\f")))

    def value(t: Column) -> Column:
        rest = F.substring(t, 2, 1 << 30)
        return (
            F.when(~F.startswith(t, F.lit("\\")), t).when(F.regexp_like(rest, F.lit("^[0-7]")), F.char(F.conv(rest, 8, 10).cast("int") % 256))
            .when(F.regexp_like(rest, F.lit("^\r?\n")), F.lit("")).otherwise(F.coalesce(F.try_element_at(special, rest), rest))
        )

    return F.when(F.contains(raw, F.lit("\\")), F.array_join(F.transform(tokens, value), "")).otherwise(raw)


def unhex_latin(digits: Column) -> Column:
    clean = F.regexp_replace(digits, "[^0-9A-Fa-f]", "")
    return F.decode(F.unhex(F.when(F.length(clean) % 2 == 1, F.concat(clean, F.lit("0"))).otherwise(clean)), LATIN)


def as_bytes(v: Column) -> Column:
    """The characters (one a byte) of a literal or hex string, null where v is neither."""
    return F.when(F.startswith(v, F.lit("(")), literal(F.substring(v, F.lit(2), F.length(v) - 2))).when(F.regexp_like(v, F.lit("^<(?!<)")), unhex_latin(v))


def text_string(raw: Column) -> Column:
    """A text string outside content: UTF-16 with a byte order mark, UTF-8 with its mark, else one character a byte."""
    wide = lambda code, skip: F.decode(F.encode(F.substring(raw, skip, 1 << 30), LATIN), code)
    return F.when(F.startswith(raw, F.lit("þÿ")), wide("UTF-16BE", 3)).when(F.startswith(raw, F.lit("ÿþ")), wide("UTF-16LE", 3)).when(F.startswith(raw, F.lit("ï»¿")), wide("UTF-8", 4)).otherwise(raw)


def as_text(v: Column) -> Column:
    return text_string(as_bytes(v))


def resolved(df: DataFrame, objs: DataFrame, *keys: str, on: str = "num") -> DataFrame:
    """df (doc_id, num, entries) whose entries of those keys hold what their references point at (bodies of objects); streams stay references.

    Only entries that are references are joined, once for all keys.
    """
    asked = df.select("doc_id", F.col(on).alias("of"), F.explode(F.filter("entries", lambda x: x["k"].isin(*keys) & as_ref(x["v"]).isNotNull())).alias("x"))
    asked = asked.select("doc_id", "of", F.col("x.k").alias("k"), as_ref(F.col("x.v")).alias("at"))
    there = objs.where("stream is null").select("doc_id", F.col("num").alias("at"), F.col("dict").alias("body"))
    body = F.regexp_replace("body", rf"^{GAP}|{SPACE}+$", "")
    found = asked.join(there, ["doc_id", "at"]).groupBy("doc_id", "of").agg(F.collect_list(F.struct("k", body.alias("v"))).alias("more")).withColumnRenamed("doc_id", "in_doc")
    both = df.join(found, (F.col("doc_id") == F.col("in_doc")) & (F.col(on) == F.col("of")), "left")
    return both.withColumn("entries", F.concat("entries", F.coalesce("more", F.array().cast(ENTRIES)))).drop("in_doc", "of", "more")
