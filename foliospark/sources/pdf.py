"""PDF files as relations.

Files come from Spark's binaryFile source (or any table with doc_id and content). Bytes are read as ISO-8859-1 text, one character a
byte, so that scanning for objects, dictionaries and tokens are Spark expressions (see syntax). Only stream filters and RC4
run in Python (Arrow UDFs). Every relation is keyed by doc_id, so all joins and windows are within a file and spread over
files. Damaged input gives fewer rows and a row in warnings, not errors.

A file is read by the chain of its cross-reference sections: what no entry names is not there. Where the chain does not lead to the
catalog, or an object lies elsewhere than its entry says, definitions are ranked by their place in the file, those in object
streams by the place of their stream, and an entry of a later section that frees an object removes it. Where startxref leads
nowhere the file is read as a rebuilt one: objects of streams override none, and nothing is free.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import document as doc
from foliospark.functions.codecs import decode_stream
from foliospark.functions.encodings import base_encoding, by_table, glyph_text
from foliospark.functions.text import is_allowed_uri, page_label, pdf_date, permission_flags
from foliospark.operators.relational import asof, flatten_tree, newest_wins
from foliospark.sources import syntax as sx
from foliospark.sources.security import decrypt, decrypt_strings, file_keys
from foliospark.sources.syntax import LATIN, as_bytes, as_int, as_name, as_number, as_ref, as_text, entries, every, exploded, get, items, numbers, refs, resolved
from foliospark.storage import relation, scratch, spread

#: What a file is made of: objects (up to endobj; a stream's data may hold that word), tables, trailers and the offset at the end. Data are skipped in runs without an e.
STREAM_END = r"endstream\s*+(?:endobj|(?=\d+\s+\d+\s+obj\b)|$)"
ITEM = (
    rf"\d++\s++\d++\s++obj\b(?:[^e>]++|(?!endobj|>>\s*+stream\r?\n)[\s\S])*+(?:endobj|>>\s*+stream\r?\n(?:[^e]++|(?!{STREAM_END})e)*+{STREAM_END})"
    r"|\bxref\s++(?:\d++\s++\d++\s++(?:\d{10}\s\d{5}\s[nf]\s*+)*+)++"
    rf"|\btrailer\s*+{sx.GROUP}"
)
E = "entries"
#: An operation of a content stream: its operands, then the operator. Brackets that close nothing are skipped.
OPERATOR = r"[A-Za-z'\"][A-Za-z0-9_*'\"]*+"
OPERAND = rf"{sx.SPACE}++|(?![A-Za-z'\"]){sx.REGULAR}++|{sx.NAME}|{sx.STRING}|{sx.GROUP}|{sx.HEX}|{sx.COMMENT}|(?:true|false|null)(?!{sx.REGULAR})|[\]>){{}}\[<(]"
OPERATION = rf"((?:{OPERAND})*+)({OPERATOR})"
#: The operator at the end of an operation: what stands before it is none of its characters.
LAST_OPERATOR = rf"(?<![A-Za-z0-9_*'\"]){OPERATOR}$"
#: A whole operand; no reference is one.
WHOLE_OPERAND = rf"{sx.REGULAR}++|{sx.NAME}|{sx.STRING}|{sx.GROUP}|{sx.HEX}|{sx.COMMENT}"
TEXTUAL = ["Tf", "Tj", "TJ", "'", '"', "Td", "TD", "T*"]  # operators that text depends on
TRAILER = -1  # the number of the row that holds a file's trailer


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of the files below a path of any file system; doc_id is the file's path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def header_offset(text: Column) -> Column:
    return doc.header_offset(text)


def is_sound(text: Column) -> Column:
    """Whether the last startxref leads to a table or an object, counted from the file's or the header's begin."""
    at = F.try_element_at(every(text, r"startxref\s+(\d{1,10})", 1), F.lit(-1)).cast("long")
    there = lambda place: F.regexp_like(F.substring(text, (place + 1).cast("int"), F.lit(40)), F.lit(r"^\s*(?:xref\b|\d+\s+\d+\s+obj\b)"))
    return F.coalesce(at.isNotNull() & (there(at) | there(at + header_offset(text))), F.lit(False))


def _stream_data(body: Column, length: Column) -> Column:
    """A stream's bytes: as many as its length says if endstream follows these, else up to the last endstream."""
    data = F.regexp_extract(body, r"(?s)>>\s*+stream\r?\n(.*)$", 1)
    n = length.cast("int")
    exact = F.regexp_like(F.substring(data, n + 1, F.lit(14)), F.lit(r"^\s*endstream"))
    scanned = F.regexp_extract(data, r"(?s)^(.*?)\r?\n?endstream(?![\s\S]*endstream)", 1)
    return F.encode(F.when((n >= 0) & exact, F.substring(data, F.lit(1), n)).otherwise(scanned), LATIN)


def _parms(e: Column) -> tuple[Column, Column]:
    """Filter names of a stream, and the decoding parameters of each (null without)."""
    listed = lambda v: F.when(F.startswith(v, F.lit("[")), items(v)).otherwise(F.array(v))
    filters, parms = get(e, "Filter", "F"), get(e, "DecodeParms", "DP")
    names = F.transform(F.when(filters.isNotNull(), listed(filters)), as_name)
    one = lambda p: F.struct(*(as_int(get(entries(p), key)).alias(name) for key, name in (("Predictor", "predictor"), ("Columns", "columns"), ("Colors", "colors"), ("BitsPerComponent", "bits"), ("EarlyChange", "early"))))
    return names, F.when(parms.isNotNull(), F.transform(listed(parms), one))


ITEMS = ["doc_id", "sound", "header", "start", "ord", "at", "o", "num", "gen", "dict", "body"]


def _parsed(cut: DataFrame) -> DataFrame:
    """cut (doc_id, sound, header, ord, at, o and more) with num, gen, dict and body (null without a stream) of those that are objects; o stays for the others."""
    head = r"^(\d+)\s+(\d+)\s+obj"
    is_object = F.regexp_like("o", F.lit(r"^\d"))
    out = cut.withColumn("num", F.when(is_object, F.regexp_extract("o", head, 1).cast("long"))).withColumn("gen", F.when(is_object, F.regexp_extract("o", head, 2).cast("long")))
    out = out.withColumn("inner", F.when(is_object, F.regexp_replace("o", r"^\d+\s+\d+\s+obj\s*|\s*endobj$", "")))
    out = out.withColumn("streamed", F.coalesce(F.regexp_like("inner", F.lit(r">>\s*+stream\r?\n")), F.lit(False)))
    d = F.when(F.col("streamed"), F.regexp_extract("inner", r"(?s)^(.*?>>)\s*+stream\r?\n", 1)).otherwise(F.col("inner"))
    out = out.withColumn("dict", d).withColumn("body", F.when(F.col("streamed"), F.col("inner")))
    return out.withColumn("o", F.when(~is_object, F.col("o"))).drop("inner", "streamed")


def _items(files: DataFrame) -> DataFrame:
    """ITEMS: what a file is made of, at which character, and where its last startxref leads; a stream whose length leads beyond an endstream of its data is read to its end, and what lies in it is no item.

    What is known of a whole file is computed before its items are exploded: beside the explosion Spark computes it for each item. Objects
    are cut here, once, as many relations read them; files are read again only where a stream is longer.
    """
    text = F.decode("content", LATIN)
    start = F.try_element_at(every(text, r"startxref\s+(\d{1,10})", 1), F.lit(-1)).cast("long")
    read = files.select("doc_id", is_sound(text).alias("sound"), F.coalesce(header_offset(text), F.lit(0)).cast("long").alias("header"), start.alias("start"), text.alias("text"))
    cut = exploded(read, ["doc_id", "sound", "header", "start"], every(F.col("text"), rf"(?s).*?(?:{ITEM})"), "ord", "piece").withColumn("o", F.regexp_extract("piece", ITEM, 0))
    till = F.sum(F.length("piece").cast("long")).over(Window.partitionBy("doc_id").orderBy("ord"))
    cut = cut.withColumn("at", till - F.length("o")).drop("piece")
    head = F.when(F.contains("o", F.lit("stream")), F.regexp_extract("o", r"(?s)^(\d+\s+\d+\s+obj\b.*?>>\s*+stream\r?\n)", 1))
    cut = cut.withColumn("skip", F.length(head)).withColumn("length", F.regexp_extract(head, rf"/Length{sx.SPACE}++(\d++)(?!{sx.SPACE}++\d++{sx.SPACE}++R)", 1).try_cast("long"))
    longer = F.when((F.col("length") + F.col("skip") > F.length("o")) & (F.col("skip") > 0), F.col("at") + F.col("skip") + F.col("length"))
    each = relation(_parsed(cut.withColumn("end", longer).drop("skip", "length")), "pdf-items")
    longer = each.where("end is not null").select("doc_id", "at", "end")
    if longer.isEmpty():
        return each
    whole = longer.join(files.select("doc_id", text.alias("text")), "doc_id")
    whole = whole.where(F.regexp_like(F.substring("text", (F.col("end") + 1).cast("int"), F.lit(14)), F.lit(r"^\s*endstream")))
    body = F.concat(F.substring("text", (F.col("at") + 1).cast("int"), (F.col("end") - F.col("at")).cast("int")), F.lit("\nendstream\nendobj"))
    whole = relation(whole.select("doc_id", "at", "end", body.alias("whole")), "pdf-long-streams")
    inside = F.max("end").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    both = each.drop("end").join(whole, ["doc_id", "at"], "left").withColumn("inside", inside).where("inside is null or at >= inside")
    new = _parsed(both.where("whole is not null").select("doc_id", "sound", "header", "start", "ord", "at", F.col("whole").alias("o")))
    return relation(both.where("whole is null").select(*ITEMS).unionByName(new), "pdf-items", [each, whole])


def objects(files: DataFrame, password: str | None = None, decrypting: bool = False) -> DataFrame:
    """(doc_id, num, gen, dict, stream, entries): the definition of each object that counts; stream is decoded, entries are those of a dictionary.

    A row with num -1 holds the file's trailer, its keys merged over all sections, newest first. With decrypting, encrypted files
    are opened with their own password (a column of files), the one given or the empty one, and those that it does not open have no objects; without, their
    strings and streams stay as they are. Items of the files and the definitions that count are written out on the way, since
    trailers, tables, streams and keys each read them; of streams, only tables and packed objects are decoded twice.
    """
    return _objects(files, password, decrypting)[0]


def unlocked(files: DataFrame, password: str | None = None) -> tuple[DataFrame, DataFrame]:
    """objects, decrypted, and the encryption that they were opened by, which is found once."""
    return _objects(files, password, True)


def _objects(files: DataFrame, password: str | None, decrypting: bool) -> tuple[DataFrame, DataFrame | None]:
    keys, each = None, _items(files)
    found = each.where("num is not null").select("doc_id", "sound", "header", "ord", "at", "num", "gen", "body", "dict")
    tables = found.where(F.regexp_like("dict", F.lit(r"/Type\s*/XRef\b")) & F.col("body").isNotNull()).withColumn("entries", entries(F.col("dict")))
    names, parms = _parms(E)
    tables = tables.withColumn("stream", decode_stream(_stream_data(F.col("body"), as_int(get(E, "Length"))), names, parms))
    tables = relation(tables.where(as_name(get(E, "Type")) == "XRef").select("doc_id", "sound", "header", "ord", "at", "num", "entries", "stream"), "pdf-xref-streams")
    tables = sections(each, tables)
    named = relation(chained(each.where("ord = 0 and start is not null").select("doc_id", "start"), tables, found.select("doc_id", "num", "gen", "at")), "pdf-named")
    ruled = named.select("doc_id").distinct().withColumn("chained", F.lit(True))
    chosen = found.join(ruled, "doc_id", "left").join(named.where("kind = 1").select("doc_id", "num", F.col("value").alias("place")), ["doc_id", "num"], "left")
    last = newest_wins(chosen.where("chained is null or at = place").drop("place", "at", "header"), ["doc_id", "num"], "ord")
    last = relation(last.withColumn("entries", entries(F.col("dict"))), "pdf-definitions")
    coded = resolved(last.where("body is not null"), last.withColumn("stream", F.when(F.col("body").isNotNull(), F.lit(b""))), "Length", "Filter", "DecodeParms")
    coded = coded.select("doc_id", "num", "gen", "ord", "sound", "chained", "dict", "entries", _stream_data(F.col("body"), as_int(get(E, "Length"))).alias("raw"))
    trailers_ = relation(_trailers(tables, named), "pdf-trailers")
    if decrypting:
        keys = relation(_keys(files, last, trailers_, password), "pdf-keys")
    plain = last.where("body is null").withColumn("raw", F.lit(None).cast("binary"))
    if decrypting and not keys.isEmpty():  # the plan of decryption is long: it ends in a table, and is left out where no file is encrypted
        plain, coded = (relation(_opened(part, keys), "pdf-opened") for part in (plain, coded))
    own = ["doc_id", "num", "gen", "ord", "sound", "chained", "dict", "entries"]

    # streams go through the shuffles as they are in the file, and are decoded when it is known which count
    def decoded(df: DataFrame, kept: list[str]) -> DataFrame:
        held = df.select(*kept, "raw", names.alias("names"), parms.alias("parms"))
        coded_ = [F.when(F.size("names") > 0, F.col(c)) for c in ("raw", "names", "parms")]
        return held.select(*kept, F.coalesce(decode_stream(*coded_), "raw").alias("stream"))

    scanned = plain.select(*own, "raw").unionByName(coded.select(*own, "raw"))
    holders = decoded(coded.where(as_name(get(E, "Type")) == "ObjStm"), own)
    inner = _packed(holders).withColumn("entries", entries(F.col("dict"))).withColumnRenamed("stream", "raw")
    inner = inner.join(named.where("kind = 2").select("doc_id", "num", F.col("value").alias("in")), ["doc_id", "num"], "left").where("chained is null or in = of").drop("in", "of")
    first = F.when(~F.col("sound") & (F.col("place") < 0), 1).otherwise(0)
    both = scanned.withColumn("place", F.lit(-1)).unionByName(inner).withColumn("rank", F.struct(first.alias("plain"), "ord", "place"))
    frees = relation(tables.where("sound and kind = 0 and num > 0").groupBy("doc_id", "num").agg(F.max("ord").alias("freed")), "pdf-freed", [each])
    best = newest_wins(both, ["doc_id", "num"], "rank").join(frees, ["doc_id", "num"], "left")
    best = best.where(~F.col("sound") | F.col("chained").isNotNull() | F.col("freed").isNull() | (F.col("freed") < F.col("ord")))
    return decoded(best, ["doc_id", "num", "gen", "dict", "entries"]).select("doc_id", "num", "gen", "dict", "stream", "entries").unionByName(trailers_), keys


def _packed(coded: DataFrame) -> DataFrame:
    """Objects of object streams (coded, decoded), at the place of their stream (number of)."""
    kept = ["doc_id", "ord", "sound", "chained", F.col("num").alias("of")]
    packed = coded.select(*kept, as_int(get(E, "First")).cast("int").alias("first"), F.decode("stream", LATIN).alias("t"))
    heads = F.transform(every(F.substring("t", F.lit(1), F.col("first")), r"\d+"), lambda n: n.cast("long"))
    packed = packed.withColumn("heads", heads).where("size(heads) >= 2")
    def cut(place: Column) -> Column:
        begin, end = F.get("heads", 2 * place + 1), F.coalesce(F.get("heads", 2 * place + 3), F.length("t") - F.col("first"))
        return F.struct(F.get("heads", 2 * place).alias("num"), F.substring("t", (F.col("first") + begin + 1).cast("int"), (end - begin).cast("int")).alias("dict"))

    held = F.transform(F.sequence(F.lit(0), F.floor(F.size("heads") / 2).cast("int") - 1), cut)
    packed = packed.select("doc_id", "ord", "sound", "chained", "of", held.alias("held")).select("doc_id", "ord", "sound", "chained", "of", F.posexplode("held").alias("place", "x"))
    return packed.select("doc_id", "x.num", F.lit(0).cast("long").alias("gen"), "ord", "sound", "chained", "of", "x.dict", F.lit(None).cast("binary").alias("stream"), "place")


def sections(each: DataFrame, streams: DataFrame) -> DataFrame:
    """(doc_id, sound, header, ord, at, coded, entries, num, kind, value): a row per entry of each cross-reference section, and one with null num for the section itself.

    kind 0 is a free object, 1 one at the character `value` counted from the header, 2 one packed in the object stream `value`. A
    table's trailer is the next one behind it; a trailer without a table is a section without entries.
    """
    marks = each.where(F.startswith("o", F.lit("xref")) | F.startswith("o", F.lit("trailer")))
    by_place = Window.partitionBy("doc_id").orderBy("ord")
    marks = marks.withColumn("next", F.lead("o").over(by_place)).withColumn("before", F.lag("o").over(by_place))
    is_table = F.startswith("o", F.lit("xref"))
    dict_ = F.when(~is_table, F.col("o")).when(F.startswith("next", F.lit("trailer")), F.col("next"))
    own = marks.where(is_table | F.coalesce(F.startswith("before", F.lit("trailer")), F.lit(True))).select("doc_id", "sound", "header", "ord", "at", F.lit(False).alias("coded"), F.coalesce(entries(F.regexp_replace(dict_, "^trailer", "")), F.array().cast(sx.ENTRIES)).alias("entries"), F.when(is_table, F.col("o")).alias("o"))
    sub = F.explode(every(F.col("o"), r"\d+\s+\d+\s+(?:\d{10}\s\d{5}\s[nf]\s*)+")).alias("sub")
    listed = own.where("o is not null").select("doc_id", "sound", "header", "ord", "at", "coded", sub)
    start = F.regexp_extract("sub", r"^(\d+)", 1).cast("long")
    listed = listed.select("doc_id", "sound", "header", "ord", "at", "coded", start.alias("start"), F.posexplode(every(F.col("sub"), r"\d{10}\s\d{5}\s[nf]")).alias("i", "e"))
    no_entries = F.lit(None).cast(sx.ENTRIES).alias("entries")
    keys = ["doc_id", "sound", "header", "ord", "at", "coded"]
    by_table = listed.select(*keys, no_entries, (F.col("start") + F.col("i")).alias("num"), F.when(F.endswith("e", F.lit("f")), 0).otherwise(1).alias("kind"), F.substring("e", 1, 10).cast("long").alias("value"))
    xref = streams.select("doc_id", "sound", "header", "ord", "at", F.lit(True).alias("coded"), F.hex("stream").alias("h"), numbers(get(E, "W")).alias("w"), F.coalesce(numbers(get(E, "Index")), F.array(F.lit(0.0), as_number(get(E, "Size")))).alias("index"))
    width = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(0.0)).cast("int")
    fits = reduce(lambda a, b: a & b, (width(i).between(0, 7) for i in range(3)))
    xref = xref.withColumn("size", width(0) + width(1) + width(2)).where(fits & (F.col("size") > 0))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("index") / 2).cast("int") - 1, F.lit(0))), lambda i: F.when(F.get("index", 2 * i + 1) > 0, F.transform(F.sequence(F.lit(0), F.get("index", 2 * i + 1).cast("int") - 1), lambda j: (F.get("index", 2 * i) + j).cast("long"))).otherwise(F.array().cast("array<long>")))
    xref = xref.withColumn("n", F.floor(F.length("h") / (2 * F.col("size"))).cast("int")).withColumn("nums", F.slice(F.flatten(runs), F.lit(1), F.greatest("n", F.lit(0))))
    field = lambda i, skip, n: F.conv(F.substring("h", (2 * (i * F.col("size") + skip) + 1).cast("int"), 2 * n), 16, 10).cast("long")
    named = lambda num, i: F.struct(num.alias("num"), F.when(width(0) == 0, F.lit(1)).otherwise(F.coalesce(field(i, F.lit(0), width(0)), F.lit(0)).cast("int")).alias("kind"), F.coalesce(field(i, width(0), width(1)), F.lit(0)).alias("value"))
    xref = exploded(xref, keys, F.transform("nums", named), "i", "x").select(*keys, "x.*")
    by_stream = xref.select(*keys, no_entries, "num", F.when(F.col("kind").isin(1, 2), F.col("kind")).otherwise(0).alias("kind"), "value")
    nothing = [F.lit(None).cast("long").alias("num"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("value")]
    heads = own.select(*keys, "entries", *nothing).unionByName(streams.select("doc_id", "sound", "header", "ord", "at", F.lit(True).alias("coded"), "entries", *nothing))
    return relation(reduce(DataFrame.unionByName, [heads, by_table, by_stream]), "pdf-sections")


def walk(begin: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, at, step): the sections that startxref (begin: doc_id, start) leads to, in the order in which they are read: of each its /XRefStm, then its /Prev; none twice, so that loops end.

    The sections of a file are collected as places and pointers, and one fold goes along them with what is still to be read and what was.
    """
    pointer = lambda k: F.when(F.regexp_like(get(E, k), F.lit(r"^\d+(?:\.\d*)?$")), as_int(get(E, k)))
    known = tables.where("num is null").select("doc_id", (F.col("at") - F.col("header")).alias("at"), F.array_compact(F.array(pointer("XRefStm"), pointer("Prev"))).alias("to"))
    known = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "to"))).alias("known")).join(begin, "doc_id")
    none = F.array().cast("array<long>")

    def go(state: Column, _: Column) -> Column:
        at, rest = F.get(state["open"], F.lit(0)), F.slice(state["open"], F.lit(2), F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        new = F.coalesce(F.map_contains_key("known", F.coalesce(at, F.lit(-1))) & ~F.array_contains(state["done"], F.coalesce(at, F.lit(-1))), F.lit(False))
        more = F.coalesce(F.try_element_at("known", F.coalesce(at, F.lit(-1))), none)
        return F.struct(F.when(new, F.concat(rest, more)).otherwise(rest).alias("open"), F.when(new, F.concat(state["done"], F.array(at))).otherwise(state["done"]).alias("done"))

    turns = F.sequence(F.lit(1), 2 * F.size("known") + 1)  # a section is pointed at once by each of two keys at most
    done = F.aggregate(turns, F.struct(F.array("start").alias("open"), none.alias("done")), go, lambda s: s["done"])
    return known.select("doc_id", F.posexplode(done).alias("step", "at"))


def chained(begin: DataFrame, tables: DataFrame, there: DataFrame) -> DataFrame:
    """(doc_id, num, kind, value, step, section): what the chain of sections says of each object, in files that can be read by it; rows with null num name the sections (section) by their step.

    The first section to name an object counts, but for a free one the first stream that holds it. value is a place in the file for
    kind 1. A file can be read by its chain if that leads to the catalog that its first trailer names, and no object
    lies elsewhere than its entry says.
    """
    order = walk(begin, tables)
    on = tables.withColumn("of", F.col("at") - F.col("header")).join(order.withColumnRenamed("at", "of"), ["doc_id", "of"])
    on = relation(on.select("doc_id", "header", F.col("at").alias("section"), "step", "coded", "entries", "num", "kind", "value"), "pdf-chain")
    entry = on.where("num is not null")
    best = entry.groupBy("doc_id", "num").agg(
        F.min_by(F.struct("kind", "value", "header"), "step").alias("first"), F.min_by(F.struct("kind", "value", "header"), F.when(F.col("coded") & (F.col("kind") > 0), F.col("step"))).alias("packed"),
    )
    best = best.select("doc_id", "num", F.when((F.col("first.kind") > 0) | F.col("packed").isNull(), F.col("first")).otherwise(F.col("packed")).alias("e"))
    best = best.select("doc_id", "num", F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == 1, F.col("e.value") + F.col("e.header")).otherwise(F.col("e.value")).alias("value")).where("kind > 0")
    met = best.where("kind = 1").join(there.select("doc_id", "num", F.col("at").alias("value"), F.lit(True).alias("hit")), ["doc_id", "num", "value"], "left")
    astray = met.where("hit is null").select("doc_id", "num").join(there.select("doc_id", "num").distinct(), ["doc_id", "num"]).select("doc_id").distinct()
    root = on.where("num is null").groupBy("doc_id").agg(F.min_by(as_ref(get(E, "Root")), F.when(get(E, "Root").isNotNull(), F.col("step"))).alias("num")).where("num is not null")
    whole = root.join(met.where("hit").select("doc_id", "num").unionByName(best.where("kind = 2").select("doc_id", "num")), ["doc_id", "num"], "left_semi").select("doc_id").join(astray, "doc_id", "left_anti")
    heads = on.where("num is null").select("doc_id", "num", "kind", "value", "step", "section")
    rows = best.withColumn("step", F.lit(None).cast("int")).withColumn("section", F.lit(None).cast("long")).unionByName(heads)
    return rows.join(relation(whole, "pdf-chained"), "doc_id", "left_semi")


def _trailers(tables: DataFrame, named: DataFrame) -> DataFrame:
    """A row per file for objects(): the entries of its trailers, the newest last; by the chain where the file is read by it, else by place."""
    steps = named.where("num is null").select("doc_id", F.col("section").alias("at"), "step")
    ruled = named.select("doc_id").distinct().withColumn("chained", F.lit(True))
    held = tables.where("num is null").select("doc_id", "ord", "at", F.col(E).alias("e")).join(ruled, "doc_id", "left").join(steps, ["doc_id", "at"], "left").where("chained is null or step is not null")
    held = held.withColumn("nth", F.coalesce(-F.col("step"), F.col("ord")))
    merged = held.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "e"))), lambda x: x["e"])).alias("entries"))
    text = F.concat(F.lit("<<"), F.array_join(F.transform("entries", lambda x: F.concat(F.lit(" /"), x["k"], F.lit(" "), x["v"])), ""), F.lit(" >>"))
    return merged.select("doc_id", F.lit(TRAILER).cast("long").alias("num"), F.lit(0).cast("long").alias("gen"), text.alias("dict"), F.lit(None).cast("binary").alias("stream"), "entries")


def trailer(objs: DataFrame) -> DataFrame:
    """(doc_id, entries) of the files' merged trailers."""
    return objs.where(F.col("num") == TRAILER).select("doc_id", "entries")


def encryption(files: DataFrame, objs: DataFrame, password: str | None = None) -> DataFrame:
    """(doc_id, status, key, streams, strings) of encrypted files: ok, need_password, bad_password, malformed or unsupported. A password column of files counts before the password that is given for all."""
    return _keys(files, objs, trailer(objs), password)


def _keys(files: DataFrame, objs: DataFrame, trailers_: DataFrame, password: str | None) -> DataFrame:
    file_id = F.encode(as_bytes(F.get(items(get(E, "ID")), F.lit(0))), LATIN)
    at = trailers_.select("doc_id", get(E, "Encrypt").alias("v"), file_id.alias("file_id")).where("v is not null").withColumn("num", as_ref(F.col("v")))
    there = at.join(objs.select("doc_id", "num", "dict"), ["doc_id", "num"], "left")
    own = [F.col("password")] if "password" in files.columns else []
    given = files.select("doc_id", F.coalesce(*own, F.lit(password).cast("string")).alias("password"))
    return file_keys(spread(there.join(given, "doc_id").select("doc_id", F.coalesce("dict", "v").alias("dict"), "file_id", "password"), "doc_id"))


def _left_plain(e: Column) -> Column:
    """Whether a stream's Crypt filter names Identity, or nothing: encryption leaves such a stream as it is."""
    listed = lambda v: F.when(F.startswith(v, F.lit("[")), items(v)).otherwise(F.array(v))
    at = F.array_position(F.transform(listed(get(e, "Filter", "F")), as_name), "Crypt").cast("int")
    name = as_name(get(entries(F.get(listed(get(e, "DecodeParms", "DP")), at - 1)), "Name"))
    return F.coalesce((at > 0) & (F.coalesce(name, F.lit("Identity")) == "Identity"), F.lit(False))


def _opened(part: DataFrame, keys: DataFrame) -> DataFrame:
    """part (doc_id, num, gen, dict, entries, raw and more) with strings and streams decrypted by keys (see encryption); objects of files that do not open go."""
    keys = keys.withColumn("locked", F.lit(True))
    n = [F.col(x) for x in ("key", "num", "gen")]
    both = part.join(keys, "doc_id", "left").where("locked is null or status = 'ok'")
    whole = (as_name(get(E, "Filter")) == "Standard") | F.coalesce(as_name(get(E, "Type")) == "XRef", F.lit(False))
    coded = both.where("key is not null").withColumn("own", F.coalesce(whole, F.lit(False)))
    coded = coded.withColumn("streams", F.when(_left_plain(E), "none").otherwise(F.col("streams")))
    dict_ = F.when(F.col("own"), F.col("dict")).otherwise(decrypt_strings(F.col("dict"), *n, F.col("strings")))
    coded = coded.withColumn("dict", dict_).withColumn("raw", F.when(F.col("own") | F.col("raw").isNull(), F.col("raw")).otherwise(decrypt(F.col("raw"), *n, F.col("streams")))).withColumn("entries", entries(F.col("dict")))
    return both.where("key is null").select(*part.columns).unionByName(coded.select(*part.columns))


def trailers(files: DataFrame, objs: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, encrypted, info, root, n_bytes) of each file; with objs, a later version in the catalog counts."""
    objs = objects(files) if objs is None else objs
    text = F.decode("content", LATIN)
    own = trailer(objs).select("doc_id", get(E, "Encrypt").isNotNull().alias("encrypted"), as_ref(get(E, "Info")).alias("info"), as_ref(get(E, "Root")).alias("root"))
    catalog = objs.select("doc_id", F.col("num").alias("root"), as_name(get(E, "Version")).alias("newer")).where("newer is not null")
    both = files.select("doc_id", doc.header_version(text).alias("header"), F.octet_length("content").alias("n_bytes")).join(own, "doc_id", "left").join(catalog, ["doc_id", "root"], "left")
    return both.select("doc_id", doc.effective_version(F.col("header"), F.col("newer")).alias("version"), F.coalesce("encrypted", F.lit(False)).alias("encrypted"), "info", "root", "n_bytes")


def warnings(files: DataFrame, objs: DataFrame) -> DataFrame:
    """(doc_id, message): what had to be worked around in a file."""
    text = F.decode("content", LATIN)
    no_offset = ~F.regexp_like(text, F.lit(r"startxref\s+\d"))
    own = files.select("doc_id", F.explode(F.array_compact(F.array(
        F.when(no_offset, "startxref is missing"), F.when(~is_sound(text), "tables are damaged, objects were found by scanning"), F.when(doc.header_version(text).isNull(), "header is missing"),
    ))).alias("message"))
    catalogs = _catalogs(objs).select("doc_id", F.lit(True).alias("has"), "named")
    state = files.select("doc_id").join(catalogs, "doc_id", "left")
    roots = state.select("doc_id", F.when(F.col("has").isNull(), "there is no catalog").when(~F.col("named"), "the catalog was found by its type").alias("message")).where("message is not null")
    tree = objs.where((as_name(get(E, "Type")) == "Pages") & get(E, "Kids").isNull()).select("doc_id", F.concat(F.lit("page tree node without kids: "), F.col("num")).alias("message"))
    return own.unionByName(roots).unionByName(tree)


def _catalogs(objs: DataFrame) -> DataFrame:
    """(doc_id, num, entries, named): a file's catalog, that which the trailer names if it is one, else the one of the largest number."""
    root = trailer(objs).select("doc_id", as_ref(get(E, "Root")).alias("root"))
    found = objs.where((F.col("num") != TRAILER) & (as_name(get(E, "Type")) == "Catalog")).select("doc_id", "num", "entries").join(root, "doc_id", "left")
    named = F.coalesce(F.col("num") == F.col("root"), F.lit(False)).alias("named")
    return newest_wins(found.select("doc_id", "num", "entries", named), ["doc_id"], "named", "num")


def pages(objs: DataFrame) -> DataFrame:
    """(doc_id, page_no, num, media_box, crop_box, bleed_box, trim_box, art_box, rotate, resources, contents, annots, dict): pages in order, with attributes of the nearest ancestor."""
    kind = objs.where(F.col("num") != TRAILER).select("doc_id", "num", "dict", "entries", as_name(get(E, "Type")).alias("type"))
    kind = kind.where(F.coalesce("type", F.lit("Pages")).isin("Pages", "Page") & (F.col("type").isNotNull() | get(E, "Kids").isNotNull() | get(E, "Contents").isNotNull()))
    kind = resolved(kind, objs, "Kids", "MediaBox", "CropBox", "Rotate", "Resources", "Contents", "Annots", "BleedBox", "TrimBox", "ArtBox")
    kind = relation(kind.withColumn("inner", get(E, "Kids").isNotNull() & F.coalesce(F.col("type") == "Pages", F.lit(True))), "pdf-page-objects")
    root = _catalogs(objs).select("doc_id", as_ref(get(E, "Pages")).alias("num")).where("num is not null")
    kids = kind.where("inner").select("doc_id", F.col("num").alias("up"), F.posexplode(refs(get(E, "Kids"))).alias("place", "num")).join(root, ["doc_id", "num"], "left_anti")
    kids = kids.groupBy("doc_id", "num").agg(F.min_by(F.struct("up", "place"), F.struct("up", "place")).alias("at")).select("doc_id", "num", "at.up", "at.place")
    root = root.select("doc_id", "num", F.lit(None).cast("long").alias("up"), F.lit(0).alias("place"))
    key = lambda n: F.struct("doc_id", F.col(n).alias("num"))
    inherited = {"media_box": "MediaBox", "crop_box": "CropBox", "rotate": "Rotate", "resources": "Resources"}
    nodes = kids.unionByName(root).join(kind, ["doc_id", "num"]).select(
        key("num").alias("id"), F.when(F.col("up").isNotNull(), key("up")).alias("parent"), F.lpad(F.col("place").cast("string"), 7, "0").alias("name"), *(get(E, k).alias(c) for c, k in inherited.items()), (F.col("inner")).alias("inner"),
    )
    tree = flatten_tree(nodes, list(inherited)).select("id.doc_id", "id.num", "path", *inherited)
    leaves = kind.where("not inner and coalesce(type, 'Page') = 'Page'").select("doc_id", "num", "dict", "entries").join(tree, ["doc_id", "num"])
    page_no = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    c = get(E, "Contents")
    own = [numbers(get(E, k)).alias(n) for n, k in (("bleed_box", "BleedBox"), ("trim_box", "TrimBox"), ("art_box", "ArtBox"))]
    return leaves.select(
        "doc_id", page_no.alias("page_no"), "num", numbers(F.col("media_box")).alias("media_box"), numbers(F.col("crop_box")).alias("crop_box"), *own, F.pmod(F.coalesce(as_int(F.col("rotate")), F.lit(0)), F.lit(360)).alias("rotate"),
        "resources", F.coalesce(refs(c), F.when(as_ref(c).isNotNull(), F.array(as_ref(c)))).alias("contents"), get(E, "Annots").alias("annots"), "dict",
    )


def rectangle(box: Column) -> Column:
    """(x0, y0, x1, y1) in order, null unless the first four values are numbers."""
    v = [F.get(box, F.lit(i)) for i in range(4)]
    ok = reduce(lambda a, b: a & b, (x.isNotNull() for x in v))
    return F.when(ok, F.array(F.least(v[0], v[2]), F.least(v[1], v[3]), F.greatest(v[0], v[2]), F.greatest(v[1], v[3])))


def boxes(pages_: DataFrame) -> DataFrame:
    """(doc_id, page_no, width, height, crop, bleed, trim, art): size from the media box, sides swapped on quarter turns; the crop box cut to the media box, the others default to it."""
    out = pages_.withColumn("m", F.coalesce(rectangle(F.col("media_box")), F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0)))))
    at = lambda b, i: F.get(b, F.lit(i))
    c = F.coalesce(rectangle(F.col("crop_box")), F.col("m"))
    crop = F.array(F.greatest(at(c, 0), at("m", 0)), F.greatest(at(c, 1), at("m", 1)), F.least(at(c, 2), at("m", 2)), F.least(at(c, 3), at("m", 3)))
    out = out.withColumn("crop", crop).withColumn("w", at("m", 2) - at("m", 0)).withColumn("h", at("m", 3) - at("m", 1))
    turned = F.col("rotate").isin(90, 270)
    others = [F.coalesce(rectangle(F.col(f"{x}_box")), F.col("crop")).alias(x) for x in ("bleed", "trim", "art")]
    return out.select("doc_id", "page_no", F.when(turned, F.col("h")).otherwise(F.col("w")).alias("width"), F.when(turned, F.col("w")).otherwise(F.col("h")).alias("height"), "crop", *others)


def contents(pages_: DataFrame, objs: DataFrame) -> DataFrame:
    """(doc_id, page_no, path, content, resources, matrix, bbox): a page's content streams in order; each ends in a line end if there are several. path is empty, matrix and bbox null (see with_forms)."""
    parts = pages_.select("doc_id", "page_no", "resources", F.size("contents").alias("n"), F.posexplode("contents").alias("place", "num")).join(objs.where("stream is not null").select("doc_id", "num", "stream"), ["doc_id", "num"])
    text = F.concat(F.decode("stream", LATIN), F.when(F.col("n") > 1, "\n").otherwise(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda p: p["t"]), "")
    return parts.groupBy("doc_id", "page_no").agg(F.array().cast("array<int>").alias("path"), joined.alias("content"), F.first("resources").alias("resources"), *(F.first(F.lit(None).cast("array<double>")).alias(n) for n in ("matrix", "bbox")))


def operations(contents_: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(doc_id, page_no, path, resources, op_no, op, operands): postfix operations with the tokens of at most the last 64 operands; an array or dictionary is one operand, kept whole. Inline images become INLINE_IMAGE.

    only names the operators that are wanted (all). Nothing is shuffled.
    """
    clean = F.regexp_replace("content", r"(?s)(?<![^\s])BI\s.*?\sEI(?![^\s])", " INLINE_IMAGE ")
    found = exploded(contents_, ["doc_id", "page_no", "path", "resources"], every(clean, OPERATION), "op_no", "o")
    found = found.withColumn("op", F.regexp_extract("o", LAST_OPERATOR, 0))
    found = found if only is None else found.where(F.col("op").isin(*only))
    found = found.withColumn("said", F.substring("o", F.lit(1), F.length("o") - F.length("op")))
    found = found.withColumn("values", F.filter(every(F.col("said"), WHOLE_OPERAND), lambda v: ~F.startswith(v, F.lit("%"))))
    last = F.when(F.size("values") > 64, F.slice("values", -64, 64)).otherwise(F.col("values"))
    flat = lambda v: F.when(F.startswith(v, F.lit("[")) | F.startswith(v, F.lit("<<")), F.filter(every(v, sx.TOKEN), lambda t: ~F.startswith(t, F.lit("%")))).otherwise(F.array(v))
    grouped = F.contains("said", F.lit("[")) | F.contains("said", F.lit("<<"))
    return found.select("doc_id", "page_no", "path", "resources", "op_no", "op", F.when(grouped, F.flatten(F.transform(last, flat))).otherwise(last).alias("operands"))


def painted(contents_: DataFrame, objs: DataFrame, depth: int = 8, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """contents_ plus the forms that Do paints in them, and in those, up to depth (forms may paint themselves), and the operations of all (or of the operators that only names, with Do): these are cut once and written.

    A form's path ends in the operation's number. A form without resources has those of what paints it; matrix and bbox are the form's own.
    """
    levels, ops = _painted(contents_, objs, depth, only, lambda level, what: relation(level, what))
    return reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, ops)


def _painted(contents_: DataFrame, objs: DataFrame, depth: int, only: list[str] | None, held: Callable[[DataFrame, str], DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """painted by levels; held says how contents of a level are kept, the operations are written."""
    only = only and [*{*only, "Do"}]
    level = held(contents_, "pdf-contents")
    levels, ops = [level], [relation(operations(level, only), "pdf-operations")]
    for _ in range(depth):
        uses = ops[-1].where("op = 'Do'").select("doc_id", "page_no", F.concat("path", F.array("op_no")).alias("path"), "resources", form_name().alias("name"))
        if uses.isEmpty():
            break
        level = held(painted_forms(uses, objs), "pdf-forms")
        levels.append(level)
        ops.append(relation(operations(level, only), "pdf-operations"))
    return levels, ops


def form_name() -> Column:
    """The name that a Do paints."""
    return F.substring(F.get("operands", F.lit(0)), 2, 1 << 30)


def painted_forms(uses: DataFrame, objs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page_no, path, content, resources, matrix, bbox, more): the forms that uses (doc_id, page_no, path, resources, name, more) name. A form without resources has those of what paints it."""
    forms = objs.where("stream is not null").select("doc_id", "num", "stream", "entries").where(as_name(get(E, "Subtype")) == "Form")
    uses = uses.withColumn("x", get(entries(F.col("resources")), "XObject"))
    there = objs.where("stream is null").select("doc_id", F.col("num").alias("at"), F.col("dict").alias("body"))
    uses = uses.withColumn("at", as_ref(F.col("x"))).join(there, ["doc_id", "at"], "left").withColumn("x", entries(F.coalesce("body", "x")))
    uses = uses.withColumn("num", as_ref(F.try_element_at(F.filter("x", lambda e: e["k"] == F.col("name")), F.lit(-1))["v"])).drop("at", "body", "x")
    made = resolved(uses.join(forms, ["doc_id", "num"]), objs, "Resources", "Matrix", "BBox")
    boxes_ = [numbers(get(E, k)).alias(n) for k, n in (("Matrix", "matrix"), ("BBox", "bbox"))]
    return made.select("doc_id", "page_no", "path", F.decode("stream", LATIN).alias("content"), F.coalesce(get(E, "Resources"), "resources").alias("resources"), *boxes_, *more)


def with_forms(contents_: DataFrame, objs: DataFrame, depth: int = 8) -> DataFrame:
    """The contents of painted alone."""
    return painted(contents_, objs, depth)[0]


def font_details(held: DataFrame, objs: DataFrame) -> DataFrame:
    """(doc_id, key, subtype, base_font, wide, ranges, differences, encoding, cut, cids) of font dictionaries (doc_id, key, entries): ranges map codes to UTF-16, differences list codes with characters of their own.

    cut is the pattern that bytes are cut into codes by, cids the ranges (lo, hi, cid) of a wide font's encoding map.
    """
    held = resolved(held, objs, "Encoding", "BaseFont", "Subtype", on="key")
    enc = get(E, "Encoding")
    runs = every(get(entries(enc), "Differences"), rf"\d++(?:{sx.GAP}{sx.NAME})++")
    names = lambda run: F.filter(F.transform(every(run, rf"{sx.COMMENT}|{sx.NAME}"), as_name), lambda n: n.isNotNull())
    differences = F.flatten(F.transform(runs, lambda run: F.transform(names(run), lambda n, i: F.struct((F.regexp_extract(run, r"^(\d+)", 1).cast("int") + i).alias("code"), glyph_text(n).alias("text")))))
    base = as_name(get(E, "BaseFont"))
    named = F.coalesce(as_name(enc), as_name(get(entries(enc), "BaseEncoding")))
    maps = objs.where("stream is not null").select("doc_id", F.col("num").alias("map"), F.decode("stream", LATIN).alias("cmap"))
    out = held.select("doc_id", "key", as_name(get(E, "Subtype")).alias("subtype"), base.alias("base_font"), differences.alias("differences"), base_encoding(named, base).alias("encoding"), as_ref(get(E, "ToUnicode")).alias("map"))
    out = out.join(maps, ["doc_id", "map"], "left").withColumn("ranges", unicode_ranges(F.col("cmap"))).withColumn("wide", F.coalesce(F.col("subtype") == "Type0", F.lit(False)))
    out = out.join(code_maps(held, objs), ["doc_id", "key"], "left")
    cut = F.when(F.col("wide"), F.coalesce(code_pattern(F.col("code_map")), F.lit(r"[\s\S]{2}"))).otherwise(r"[\s\S]")
    return out.select("doc_id", "key", "subtype", "base_font", "wide", "ranges", "differences", "encoding", cut.alias("cut"), cid_ranges(F.col("code_map")).alias("cids"))


def code_maps(held: DataFrame, objs: DataFrame) -> DataFrame:
    """(doc_id, key, code_map): the texts of the encoding maps of fonts (doc_id, key, entries), a map's own before that which it builds on (/UseCMap, followed as far as it goes, none twice)."""
    streams = objs.where("stream is not null").select("doc_id", F.col("num").alias("at"), F.decode("stream", LATIN).alias("t"), as_ref(get(E, "UseCMap")).alias("base"))
    level = held.select("doc_id", "key", as_ref(get(E, "Encoding")).alias("at"), F.array().cast("array<long>").alias("seen")).where("at is not null")
    level, levels = relation(level.join(streams, ["doc_id", "at"]), "pdf-code-maps"), []
    while True:
        levels.append(level)
        level = level.where("base is not null").select("doc_id", "key", F.col("base").alias("at"), F.concat("seen", F.array("at")).alias("seen")).where("not array_contains(seen, at)")
        if level.isEmpty():
            break
        level = relation(level.join(streams, ["doc_id", "at"]), "pdf-code-maps")
    parts = reduce(DataFrame.unionByName, levels).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct(F.size("seen").alias("depth"), "t"))).alias("parts"))
    return parts.select("doc_id", "key", F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("code_map"))


def _within(cmap: Column, kind: str) -> Column:
    return F.array_join(every(cmap, rf"(?s)begin{kind}(.*?)end{kind}", 1), " ")


def code_pattern(cmap: Column) -> Column:
    """The pattern of the codes of a map's codespace ranges, shorter ones first; a byte that begins none is a code by itself. Null without ranges."""
    pairs = F.transform(every(_within(cmap, "codespacerange"), r"<[^>]*>\s*<[^>]*>"), lambda p: F.transform(every(p, r"<([^>]*)>", 1), lambda h: F.regexp_replace(h, r"\s", "")))
    pairs = F.filter(pairs, lambda p: (F.length(p[0]) == F.length(p[1])) & (F.length(p[0]) > 0) & (F.length(p[0]) % 2 == 0))
    byte = lambda h, i: F.substring(h, 2 * i + 1, F.lit(2))
    ranges = F.transform(pairs, lambda p: F.struct(F.length(p[0]).alias("n"), F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(p[0]) / 2).cast("int") - 1), lambda i: F.concat(F.lit("[\\x"), byte(p[0], i), F.lit("-\\x"), byte(p[1], i), F.lit("]"))), "").alias("t")))
    return F.when(F.size(ranges) > 0, F.concat(F.array_join(F.transform(F.array_sort(ranges), lambda r: r["t"]), "|"), F.lit(r"|[\s\S]")))


def cid_ranges(cmap: Column) -> Column:
    """(lo, hi, cid) of a map from codes to glyph numbers: single codes first, then ranges, in order."""
    number = lambda t, i: F.conv(F.get(every(t, r"<\s*([0-9A-Fa-f]+)\s*>", 1), F.lit(i)), 16, 10).cast("long")
    cid = lambda t: F.regexp_extract(t, r"(\d+)$", 1).cast("long").alias("cid")
    chars = F.transform(every(_within(cmap, "cidchar"), r"<[^>]*>\s*\d+"), lambda t: F.struct(number(t, 0).alias("lo"), number(t, 0).alias("hi"), cid(t)))
    return F.concat(chars, F.transform(every(_within(cmap, "cidrange"), r"<[^>]*>\s*<[^>]*>\s*\d+"), lambda t: F.struct(number(t, 0).alias("lo"), number(t, 1).alias("hi"), cid(t))))


def code_of(part: Column) -> Column:
    return F.conv(F.hex(F.encode(part, LATIN)), 16, 10).cast("int")


def codes_of(raw: Column, cut: Column) -> Column:
    """The codes of a shown string's bytes."""
    return F.transform(F.regexp_extract_all(raw, cut, F.lit(0)), code_of)


def shown_codes(ops: DataFrame, fonts_: DataFrame) -> DataFrame:
    """(doc_id, page_no, path, op_no, place, code, cid): each code that a page shows; cid is the glyph's number in a wide font's encoding map, the code itself where there is no map or it lacks the code, null in other fonts.

    Distinct codes of a font meet its ranges once, and their shown places by a join, so long maps cost little for each character.
    """
    return codes_shown(_with_fonts(ops, fonts_), fonts_)


def codes_shown(used: DataFrame, fonts_: DataFrame) -> DataFrame:
    """As shown_codes, of operations that know their font and how it is cut."""
    text = F.filter(F.when(F.col("op") == "TJ", F.col("operands")).otherwise(F.slice("operands", -1, 1)), lambda t: F.regexp_like(t, F.lit(r"^[(<]")))
    key = ["doc_id", "page_no", "path", "font"]
    used = used.where(F.col("cut").isNotNull() & F.col("op").isin("Tj", "TJ", "'", '"') & (F.size("operands") > 0))
    each = relation(exploded(used, [*key, "op_no"], F.flatten(F.transform(text, lambda t: codes_of(as_bytes(t), F.col("cut")))), "place", "code"), "pdf-codes")
    known = each.select(*key, "code").distinct().join(fonts_.select(*key, "wide", "cids"), key)
    hit = F.get(F.filter("cids", lambda r: (r["lo"] <= F.col("code")) & (F.col("code") <= r["hi"])), F.lit(0))
    known = known.select(*key, "code", F.when(F.col("wide"), F.coalesce(hit["cid"] + F.col("code") - hit["lo"], F.col("code").cast("long"))).alias("cid"))
    return each.join(known, [*key, "code"]).select("doc_id", "page_no", "path", "op_no", "place", "code", "cid")


def _with_fonts(ops: DataFrame, fonts_: DataFrame) -> DataFrame:
    """The operations that show or move text, with the font that is set where they stand and its details."""
    w = Window.partitionBy("doc_id", "page_no", "path").orderBy("op_no")
    font = F.last(F.when(F.col("op") == "Tf", sx.name_text(F.try_element_at("operands", F.lit(-2)))), ignorenulls=True).over(w)
    used = ops.where(F.col("op").isin(*TEXTUAL)).drop("resources").withColumn("font", font)
    return used.where("op != 'Tf'").join(fonts_, ["doc_id", "page_no", "path", "font"], "left")


def fonts(contents_: DataFrame, objs: DataFrame) -> DataFrame:
    """(doc_id, page_no, path, font and its details): the fonts of pages (or of contents and forms) by name. A font is what a /Font dictionary names, whatever its own /Type, as an object or in place."""
    entry, held = named_fonts(contents_, objs)
    return entry.join(font_details(held, objs), ["doc_id", "key"]).drop("key")


def named_fonts(contents_: DataFrame, objs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page_no, path, font, key) of the names of fonts, and (doc_id, key, entries) of their dictionaries."""
    by_num = objs.where("stream is null").select("doc_id", F.col("num").alias("at"), F.col("dict").alias("there"))
    path = F.col("path") if "path" in contents_.columns else F.array().cast("array<int>")
    held = contents_.select("doc_id", "page_no", path.alias("path"), get(entries(F.col("resources")), "Font").alias("v")).withColumn("at", as_ref(F.col("v"))).join(by_num, ["doc_id", "at"], "left")
    entry = held.select("doc_id", "page_no", "path", F.explode(entries(F.coalesce("there", "v"))).alias("e")).select("doc_id", "page_no", "path", F.col("e.k").alias("font"), as_ref(F.col("e.v")).alias("num"), F.col("e.v").alias("v"))
    entry = relation(entry.select("doc_id", "page_no", "path", "font", "num", F.coalesce(F.col("num").cast("string"), "v").alias("key")), "pdf-font-names")
    there = objs.where("stream is null").select("doc_id", "num", "entries")
    objects_ = entry.where("num is not null").select("doc_id", "num", "key").distinct().join(there, ["doc_id", "num"]).select("doc_id", "key", "entries")
    inline = entry.where("num is null").select("doc_id", "key").distinct().withColumn("entries", entries(F.col("key")))
    return entry.drop("num"), objects_.unionByName(inline.where("size(entries) > 0"))


def font_widths(held: DataFrame, objs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Widths of font dictionaries (doc_id, key, entries): runs (doc_id, key, place, lo, hi, width) of glyph numbers, later places count, and (doc_id, key, width) for all others.

    Simple fonts have /Widths from /FirstChar on, else those of Courier's family 600, others /MissingWidth; wide fonts have both
    forms of their descendant's /W, else /DW. Elements that are references are skipped.
    """
    held = resolved(held, objs, "Widths", "FirstChar", "FontDescriptor", "DescendantFonts", "BaseFont", "Subtype", on="key")
    wide = F.coalesce(as_name(get(E, "Subtype")) == "Type0", F.lit(False))
    listed = F.posexplode(numbers(get(E, "Widths"))).alias("place", "width")
    simple = held.where(~wide).select("doc_id", "key", F.coalesce(as_int(get(E, "FirstChar")), F.lit(0)).alias("first"), listed).where("width is not null")
    simple = simple.select("doc_id", "key", "place", (F.col("first") + F.col("place")).alias("lo"), (F.col("first") + F.col("place")).alias("hi"), "width")
    missing = F.when(as_name(get(E, "BaseFont")).contains("Courier"), 600.0).otherwise(F.coalesce(as_number(get(entries(get(E, "FontDescriptor")), "MissingWidth")), F.lit(0.0)))
    below = held.where(wide).select("doc_id", "key", F.get(items(get(E, "DescendantFonts")), F.lit(0)).alias("v")).withColumn("at", as_ref(F.col("v")))
    there = objs.where("stream is null").select("doc_id", F.col("num").alias("at"), F.col("dict").alias("there"))
    below = resolved(below.join(there, ["doc_id", "at"], "left").select("doc_id", "key", entries(F.coalesce("there", "v")).alias(E)), objs, "W", "DW", on="key")
    part = every(F.regexp_extract(get(E, "W"), r"(?s)^\[(.*)\]$", 1), r"\d+\s*\[[^\]]*\]|\d+\s+\d+\s+[\d.+-]+")
    parts = below.select("doc_id", "key", F.posexplode(part).alias("nth", "t")).withColumn("v", F.transform(every(F.col("t"), r"[\d.+-]+"), as_number))
    first, is_list = F.get("v", F.lit(0)).cast("long"), F.contains("t", F.lit("["))
    run = lambda lo, hi, w: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), w.alias("width"))
    each = F.when(is_list, F.transform(F.slice("v", 2, 1 << 30), lambda w, i: run(first + i, first + i, w))).otherwise(F.array(run(first, F.get("v", F.lit(1)), F.get("v", F.lit(2)))))
    cid = parts.select("doc_id", "key", F.col("nth").alias("place"), F.explode(each).alias("r")).select("doc_id", "key", "place", "r.lo", "r.hi", "r.width").where("width is not null and hi >= lo")
    others = held.where(~wide).select("doc_id", "key", missing.alias("width")).unionByName(below.select("doc_id", "key", F.coalesce(as_number(get(E, "DW")), F.lit(1000.0)).alias("width")))
    return simple.unionByName(cid), others


def unicode_ranges(cmap: Column) -> Column:
    """Ranges (lo, hi, head, last) of a ToUnicode map: code c is the UTF-16 hex head followed by last + c - lo."""
    code = lambda x: F.conv(x, 16, 10).cast("long")

    def entry(lo: Column, hi: Column, dst: Column) -> Column:
        return F.struct(code(lo).alias("lo"), code(hi).alias("hi"), F.substring(dst, F.lit(1), F.greatest(F.length(dst) - 4, F.lit(0))).alias("head"), code(F.right(dst, F.lit(4))).alias("last"))

    inside = lambda kind: F.array_join(every(cmap, rf"(?s)begin{kind}(.*?)end{kind}", 1), " ")
    hexes = lambda t: every(t, r"<\s*([0-9A-Fa-f]+)\s*>", 1)
    chars = F.transform(every(inside("bfchar"), r"<[^>]*>\s*<[^>]*>"), lambda t: entry(F.get(hexes(t), F.lit(0)), F.get(hexes(t), F.lit(0)), F.get(hexes(t), F.lit(1))))
    spans = F.transform(every(inside("bfrange"), r"<[^>]*>\s*<[^>]*>\s*<[^>]*>"), lambda t: entry(F.get(hexes(t), F.lit(0)), F.get(hexes(t), F.lit(1)), F.get(hexes(t), F.lit(2))))
    lists = F.flatten(F.transform(every(inside("bfrange"), r"<[^>]*>\s*<[^>]*>\s*\[[^\]]*\]"), lambda t: F.transform(
        F.slice(hexes(t), 3, 1 << 30), lambda dst, i: F.struct((code(F.get(hexes(t), F.lit(0))) + i).alias("lo"), (code(F.get(hexes(t), F.lit(0))) + i).alias("hi"), F.substring(dst, F.lit(1), F.greatest(F.length(dst) - 4, F.lit(0))).alias("head"), code(F.right(dst, F.lit(4))).alias("last")))))
    return F.concat(chars, lists, spans)


def shown(raw: Column, wide: Column, ranges: Column, differences: Column, encoding: Column, cut: Column) -> Column:
    """Unicode text of a shown string: each code by the font's map, else by its differences, else by its encoding; wide fonts show nothing that the map lacks.

    Distinct codes of a string are looked up once, so neither long texts nor long maps multiply.
    """
    wide = F.coalesce(wide, F.lit(False))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  value is computed once, however often it is used

    def unit(part: Column) -> Column:
        def text(c: Column) -> Column:
            r = F.get(F.filter(ranges, lambda r: (r["lo"] <= c) & (c <= r["hi"])), F.lit(0))
            mapped = once(r, lambda r: F.nullif(F.concat(r["head"], F.lpad(F.hex(r["last"] + c - r["lo"]), 4, "0")), F.lit("")))
            own = F.nullif(F.try_element_at(F.filter(differences, lambda d: d["code"] == c), F.lit(-1))["text"], F.lit(""))
            return F.coalesce(mapped, F.when(wide, "").otherwise(F.hex(F.encode(F.coalesce(own, by_table(F.char(c), encoding)), "UTF-16BE"))))

        return once(code_of(part), text)

    def spelled(parts: Column) -> Column:
        each = lambda found, texts: F.transform(parts, lambda p: F.get(texts, F.array_position(found, p).cast("int") - 1))
        return once(F.array_distinct(parts), lambda found: once(F.transform(found, unit), lambda texts: F.array_join(each(found, texts), "")))

    whole = F.decode(F.unhex(once(F.regexp_extract_all(raw, cut, F.lit(0)), spelled)), "UTF-16BE")
    plain = F.coalesce(F.size(ranges), F.lit(0)) + F.coalesce(F.size(differences), F.lit(0)) <= 0
    return F.when(plain & wide, "").when(plain, by_table(raw, F.coalesce(encoding, F.lit("WinAnsiEncoding")))).otherwise(whole)


def page_text(ops: DataFrame, fonts_: DataFrame) -> DataFrame:
    """(doc_id, page_no, text). Moves down or up begin a line, moves right give a space; in an array a shift below -100 is a space. Text of forms stands where they are painted; what is shown without a font, or with one that the resources lack, is no text."""
    token = lambda i: F.try_element_at("operands", F.lit(i))
    used = _with_fonts(ops, fonts_)
    say = lambda t: F.when(F.col("wide").isNull(), "").otherwise(shown(as_bytes(t), *map(F.col, ("wide", "ranges", "differences", "encoding", "cut"))))
    number_ = lambda t: F.coalesce(as_number(t), F.lit(0.0))
    item = lambda t: F.when(F.regexp_like(t, F.lit(r"^[(<]")), say(t)).when(number_(t) < -100, " ").otherwise("")
    move = F.when(F.abs(number_(token(-1))) > 0.01, "\n").when(number_(token(-2)) > 0, " ").otherwise("")
    op = F.col("op")
    strings = F.when(op == "TJ", F.col("operands")).when(op.isin("Tj", "'", '"'), F.filter(F.array(token(-1)), lambda t: F.regexp_like(t, F.lit(r"^[(<]")))).otherwise(F.array().cast("array<string>"))
    before = F.when(op.isin("'", '"', "T*"), "\n").when(op.isin("Td", "TD"), move).otherwise("")
    piece = F.concat(before, F.array_join(F.transform(strings, item), ""))
    parts = used.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(F.concat("path", F.array("op_no")).alias("at"), F.coalesce(piece, F.lit("")).alias("t")))).alias("parts"))
    return parts.select("doc_id", "page_no", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text"))


INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")


def metadata(files: DataFrame, objs: DataFrame) -> DataFrame:
    """(doc_id, title, author, subject, keywords, creator, producer, created, modified, custom, xmp) of each file; missing ones are null. custom maps keys of their own to texts."""
    at = trailer(objs).select("doc_id", get(E, "Info").alias("v")).withColumn("num", as_ref(F.col("v")))
    info = at.join(objs.select("doc_id", "num", "dict"), ["doc_id", "num"], "left").select("doc_id", entries(F.coalesce("dict", "v")).alias("i"))
    catalog = _catalogs(objs).select("doc_id", as_ref(get(E, "Metadata")).alias("num")).join(objs.select("doc_id", "num", "stream"), ["doc_id", "num"]).select("doc_id", F.decode("stream", "UTF-8").alias("xmp"))
    said = lambda v: F.coalesce(as_text(v), as_name(v))
    fields = [said(get(F.col("i"), k)).alias(k.lower()) for k in INFO]
    own = F.filter("i", lambda x: ~x["k"].isin(*INFO, "CreationDate", "ModDate", "Trapped") & said(x["v"]).isNotNull())
    keys = F.array_distinct(F.transform(own, lambda x: x["k"]))
    custom = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), said(F.try_element_at(F.filter("i", lambda x: x["k"] == k), F.lit(-1))["v"]).alias("v"))))
    dates = [pdf_date(as_text(get(F.col("i"), k))).alias(n) for k, n in (("CreationDate", "created"), ("ModDate", "modified"))]
    return files.select("doc_id").join(info, "doc_id", "left").join(catalog, "doc_id", "left").select("doc_id", *fields, *dates, custom.alias("custom"), "xmp")


def descend(objs: DataFrame, tops: DataFrame) -> DataFrame:
    """(doc_id, entries): tops, and all that their /Kids lead to, none twice, however deep: name and number trees."""
    level = relation(tops.select("doc_id", F.lit(None).cast("long").alias("num"), "entries"), "pdf-tree-level")
    levels = [level]
    while True:
        kids = level.select("doc_id", F.explode(refs(get(E, "Kids"))).alias("num")).distinct()
        if len(levels) > 1:
            kids = kids.join(reduce(DataFrame.unionByName, levels[1:]).select("doc_id", "num"), ["doc_id", "num"], "left_anti")
        level = relation(kids.join(objs, ["doc_id", "num"]).select("doc_id", "num", "entries"), "pdf-tree-level")
        if not level.take(1):
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).select("doc_id", "entries")


def _below(objs: DataFrame, key: str, *more: str) -> DataFrame:
    """(doc_id, entries) of the dictionary that the catalog's key leads to, then more keys of it."""
    out = _catalogs(objs).select("doc_id", "entries")
    for k in (key, *more):
        at = out.select("doc_id", get(E, k).alias("v")).where("v is not null").withColumn("num", as_ref(F.col("v")))
        out = at.join(objs.where("stream is null").select("doc_id", "num", "dict"), ["doc_id", "num"], "left").select("doc_id", entries(F.coalesce("dict", "v")).alias("entries"))
    return out


def _pairs(tree: DataFrame, key: str) -> DataFrame:
    """(doc_id, place, k, v) of the arrays of pairs of a tree's nodes."""
    both = tree.select("doc_id", items(get(E, key)).alias("i")).where("size(i) >= 2")
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("i") / 2).cast("int") - 1), lambda at: F.struct(F.get("i", 2 * at).alias("k"), F.get("i", 2 * at + 1).alias("v")))
    return both.select("doc_id", pair.alias("pairs")).select("doc_id", F.posexplode("pairs").alias("place", "x")).select("doc_id", "place", "x.k", "x.v")


def _followed(df: DataFrame, objs: DataFrame, value: str = "v") -> DataFrame:
    """df with value replaced by the body of what it points at."""
    there = objs.where("stream is null").select(F.col("doc_id").alias("in_doc"), F.col("num").alias("of"), F.regexp_replace("dict", rf"^{sx.GAP}|{sx.SPACE}+$", "").alias("body"))
    out = df.join(there, (F.col("doc_id") == F.col("in_doc")) & (as_ref(F.col(value)) == F.col("of")), "left")
    return out.withColumn(value, F.when(as_ref(F.col(value)).isNotNull(), F.col("body")).otherwise(F.col(value))).drop("in_doc", "of", "body")


def labels(pages_: DataFrame, objs: DataFrame) -> DataFrame:
    """(doc_id, page_no, label) from the ranges of the number tree; a page before any range, or without one, has its number. Of ranges that begin at one page the last counts."""
    entry = _followed(_pairs(descend(objs, _below(objs, "PageLabels")), "Nums"), objs).withColumn("e", entries(F.col("v")))
    e = F.col("e")
    spec = F.struct(as_name(get(e, "S")).alias("style"), F.coalesce(as_text(get(e, "P")), F.lit("")).alias("prefix"), F.coalesce(as_int(get(e, "St")), F.lit(1)).alias("first"))
    ranges = newest_wins(entry.select("doc_id", "place", as_int(F.col("k")).alias("from_page"), spec.alias("spec")).where("from_page is not null"), ["doc_id", "from_page"], "place").drop("place")
    out = asof(pages_.select("doc_id", "page_no", (F.col("page_no") - 1).cast("long").alias("i")), ranges, ["doc_id"], "i", "from_page", ["spec"])
    n = (F.col("spec.first") + F.col("i") - F.col("from_page")).cast("int")
    return out.select("doc_id", "page_no", F.coalesce(page_label(F.col("spec.style"), F.col("spec.prefix"), n), F.col("page_no").cast("string")).alias("label"))


def _named_tree(objs: DataFrame, label: Column, parent: Column, inherited: dict[str, Column], where: Column) -> DataFrame:
    """Objects with a name and a parent reference as a tree; parents outside the selection make roots."""
    key = lambda n: F.struct("doc_id", n.alias("num"))
    nodes = objs.where(where).select("num", key(F.col("num")).alias("id"), F.when(parent.isNotNull(), key(parent)).alias("up"), label.alias("name"), *(c.alias(n) for n, c in inherited.items()))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("known")).distinct()
    nodes = nodes.join(known, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("parent"), "name", *inherited)
    return flatten_tree(nodes, list(inherited)).select("id.doc_id", "id.num", "level", "name", "path", *inherited)


def form_fields(objs: DataFrame) -> DataFrame:
    """(doc_id, num, name, type, value): fields with dotted names; the type comes from the nearest field above that has one. Kids without a name are widgets of their field."""
    own = objs.where(F.col("num") != TRAILER).select("doc_id", "num", "entries").where(as_bytes(get(E, "T")).isNotNull() & ~F.coalesce(as_name(get(E, "Type")).isin("Page", "Annot") & (as_name(get(E, "Subtype")) != "Widget"), F.lit(False)))
    up = own.select("doc_id", F.col("num").alias("by_kids"), F.explode(refs(get(E, "Kids"))).alias("num")).groupBy("doc_id", "num").agg(F.min("by_kids").alias("by_kids"))
    fields = relation(own.join(up, ["doc_id", "num"], "left").withColumn("up", F.coalesce("by_kids", as_ref(get(E, "Parent")))), "pdf-fields")
    tree = _named_tree(fields, as_text(get(E, "T")), F.col("up"), {"type": as_name(get(E, "FT"))}, F.lit(True))
    value = get(E, "V")
    listed = F.array_join(F.filter(F.transform(items(value), as_text), lambda t: t.isNotNull()), ", ")
    values = fields.select("doc_id", "num", F.coalesce(as_text(value), as_name(value), F.when(items(value).isNotNull(), listed), as_number(value).cast("string")).alias("value"))
    inner = fields.select("doc_id", F.col("up").alias("num")).where("num is not null").distinct()
    return tree.join(values, ["doc_id", "num"]).join(inner, ["doc_id", "num"], "left_anti").select("doc_id", "num", F.col("path").alias("name"), "type", "value")


def structure(objs: DataFrame) -> DataFrame:
    """(doc_id, num, level, type, path, alt): the structure tree."""
    tree = _named_tree(objs, as_name(get(E, "S")), as_ref(get(E, "P")), {}, (as_name(get(E, "Type")) == "StructElem") & as_name(get(E, "S")).isNotNull())
    alt = objs.select("doc_id", "num", as_text(get(E, "Alt")).alias("alt"))
    return tree.join(alt, ["doc_id", "num"]).select("doc_id", "num", "level", F.col("name").alias("type"), "path", "alt")


def named_destinations(objs: DataFrame) -> DataFrame:
    """(doc_id, name, dest): the destination arrays of names, from the catalog's dictionary first, then from the name tree."""
    plain = _below(objs, "Dests").select("doc_id", F.lit(0).alias("from"), F.explode("entries").alias("x")).select("doc_id", "from", F.col("x.k").alias("name"), F.col("x.v").alias("v"))
    tree = _pairs(descend(objs, _below(objs, "Names", "Dests")), "Names").select("doc_id", F.lit(1).alias("from"), as_bytes(F.col("k")).alias("name"), "v")
    found = _followed(plain.unionByName(tree), objs)
    dest = F.when(F.startswith("v", F.lit("<<")), get(entries(F.col("v")), "D")).otherwise(F.col("v"))
    return found.where("name is not null").groupBy("doc_id", "name").agg(F.min_by(dest, "from").alias("dest"))


def with_destinations(df: DataFrame, objs: DataFrame, pages_: DataFrame, value: str = "to") -> DataFrame:
    """df with page_no and view (fit, left, top, right, bottom, zoom) of the destination in a column: an array, a dictionary with one, a name or string, or a reference to any of these."""
    out = _followed(df, objs, value)
    key = F.coalesce(as_bytes(F.col(value)), as_name(F.col(value)))
    named = named_destinations(objs).select(F.col("doc_id").alias("in_doc"), F.col("name").alias("of_name"), "dest")
    out = out.withColumn("by_name", key).join(named, (F.col("doc_id") == F.col("in_doc")) & (F.col("by_name") == F.col("of_name")), "left").drop("in_doc", "of_name")
    v = F.col(value)
    out = out.withColumn(value, F.when(F.col("by_name").isNotNull(), F.col("dest")).when(F.startswith(v, F.lit("<<")), get(entries(v), "D")).otherwise(v)).drop("by_name", "dest")
    out = out.withColumn("parts", items(F.col(value))).drop(value)
    first = F.get("parts", F.lit(0))
    counts = pages_.groupBy(F.col("doc_id").alias("in_doc")).agg(F.max("page_no").alias("n_pages"))
    target = pages_.select(F.col("doc_id").alias("of_doc"), F.col("num").alias("of"), F.col("page_no").alias("on_page"))
    out = out.join(counts, F.col("doc_id") == F.col("in_doc"), "left").join(target, (F.col("doc_id") == F.col("of_doc")) & (as_ref(first) == F.col("of")), "left")
    number = F.when(as_int(first).isNotNull() & as_ref(first).isNull(), doc.page_of_number(as_int(first), F.coalesce("n_pages", as_int(first) + 1)))
    args = F.transform(F.slice("parts", 3, 1 << 20), as_number)
    view = F.when(F.size("parts") > 0, doc.destination(as_name(F.get("parts", F.lit(1))), args))
    return out.withColumn("page_no", F.coalesce("on_page", number.cast("int"))).withColumn("view", view).drop("parts", "in_doc", "n_pages", "of_doc", "of", "on_page")


def _goto(e: Column) -> Column:
    """The destination of a bookmark or link: its own, or that of its action if that goes to one."""
    action = entries(get(e, "A"))
    return F.coalesce(get(e, "Dest"), F.when(as_name(get(action, "S")) == "GoTo", get(action, "D")))


def sibling_ranks(nodes: DataFrame) -> DataFrame:
    """(doc_id, num, head, rank): each node's distance from the first of its list, over next (doc_id, num, next); distances double a round. Lists without a first node have no rows.

    Lists may be of any length: rounds end when all have reached their first node, or a distance is beyond the largest file's nodes, which only circles are.
    """
    before = nodes.where("next is not null").groupBy("doc_id", F.col("next").alias("num")).agg(F.min("num").alias("at"))
    state = nodes.select("doc_id", "num").join(before, ["doc_id", "num"], "left").select("doc_id", "num", F.coalesce("at", "num").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("rank"))
    state = relation(state, "pdf-lists")
    most, reach = state.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0, 1
    while reach < most:
        there = state.select("doc_id", F.col("num").alias("at"), F.col("at").alias("further"), F.col("rank").alias("more"))
        state = relation(state.join(there, ["doc_id", "at"]).select("doc_id", "num", F.col("further").alias("at"), (F.col("rank") + F.col("more")).alias("rank"), (F.col("more") > 0).alias("moved")), "pdf-lists", [state])
        reach *= 2
        if not state.where("moved").take(1):
            break
    heads = nodes.select("doc_id", "num").join(before, ["doc_id", "num"], "left_anti").withColumnRenamed("num", "at")
    return state.join(heads, ["doc_id", "at"]).select("doc_id", "num", F.col("at").alias("head"), "rank")


def outline(objs: DataFrame, pages_: DataFrame) -> DataFrame:
    """(doc_id, num, level, title, path, place, page_no, view): bookmarks and where they lead. place sorts a file's bookmarks as they are shown; a bookmark that no list holds hangs below its parent."""
    own = objs.where(F.col("num") != TRAILER).where(as_bytes(get(E, "Title")).isNotNull() & get(E, "Parent").isNotNull()).select("doc_id", "num", "entries")
    own = relation(resolved(own, objs, "A").select("doc_id", "num", F.trim(as_text(get(E, "Title"))).alias("title"), as_ref(get(E, "Parent")).alias("parent"), as_ref(get(E, "Next")).alias("next"), as_ref(get(E, "First")).alias("first"), _goto(E).alias("to")), "pdf-bookmarks")
    ranks = sibling_ranks(own)
    ups = own.where("first is not null").select("doc_id", F.col("first").alias("head"), F.col("num").alias("up")).groupBy("doc_id", "head").agg(F.min("up").alias("up"))
    nodes = own.join(ranks.join(ups, ["doc_id", "head"], "left"), ["doc_id", "num"], "left")
    label = F.concat(F.lpad(F.coalesce("rank", F.lit(0)).cast("string"), 10, "0"), F.lpad(F.col("num").cast("string"), 10, "0"), F.lit(" "), F.col("title"))
    tree = _named_tree(nodes.withColumn("label", label), F.col("label"), F.coalesce("up", "parent"), {}, F.lit(True)).select("doc_id", "num", "level", F.col("path").alias("place"))
    titles = _named_tree(own, F.col("title"), F.col("parent"), {}, F.lit(True)).select("doc_id", "num", "path")
    both = tree.join(titles, ["doc_id", "num"]).join(own.select("doc_id", "num", "title", "to"), ["doc_id", "num"])
    return with_destinations(both, objs, pages_).select("doc_id", "num", "level", "title", "path", "place", "page_no", "view")


def links(objs: DataFrame, pages_: DataFrame) -> DataFrame:
    """(doc_id, page_no, rect, uri, dest_page): regions of visible link annotations with an allowed address or a page: one a quad, or the rectangle where there are none."""
    on = pages_.select("doc_id", "page_no", F.explode(refs(F.col("annots"))).alias("num"))
    link = objs.where((as_name(get(E, "Subtype")) == "Link") & ~doc.is_hidden(as_int(get(E, "F")))).select("doc_id", "num", "entries")
    link = resolved(link, objs, "A", "Rect", "QuadPoints").withColumn("rect", rectangle(numbers(get(E, "Rect")))).where("rect is not null")
    action = entries(get(E, "A"))
    uri = F.when(as_name(get(action, "S")) == "URI", as_bytes(get(action, "URI")))
    quads = doc.quad_regions(F.coalesce(numbers(get(E, "QuadPoints")), F.array().cast("array<double>")))
    link = link.select("doc_id", "num", F.explode(F.when(F.size(quads) > 0, quads).otherwise(F.array("rect"))).alias("rect"), uri.alias("uri"), F.when(uri.isNull(), _goto(E)).alias("to"))
    out = with_destinations(on.withColumnRenamed("page_no", "from_page").join(link, ["doc_id", "num"]), objs, pages_).withColumn("uri", F.when(is_allowed_uri(F.col("uri")), F.col("uri")))
    return out.where("uri is not null or page_no is not null").select("doc_id", F.col("from_page").alias("page_no"), "rect", "uri", F.col("page_no").alias("dest_page"))


def permissions(files: DataFrame, objs: DataFrame | None = None) -> DataFrame:
    """(doc_id, status, rights): rights of unencrypted files are all granted; encrypted ones follow the /P of their encryption dictionary."""
    objs = objects(files) if objs is None else objs
    locked = _followed(trailer(objs).select("doc_id", get(E, "Encrypt").alias("v")).where("v is not null"), objs)
    p = locked.select("doc_id", F.coalesce(as_int(get(entries(F.col("v")), "P")), F.lit(0)).cast("int").alias("p"))
    both = files.select("doc_id").join(p, "doc_id", "left").withColumn("encrypted", F.col("p").isNotNull())
    return both.select("doc_id", F.when(F.col("encrypted"), "encrypted").otherwise("ok").alias("status"), permission_flags(F.coalesce("p", F.lit(0)), F.col("encrypted")).alias("rights"))


def extract_text(files: DataFrame, objs: DataFrame | None = None, password: str | None = None) -> DataFrame:
    """(doc_id, page_no, text) of each page of files (doc_id, content). Encrypted files are opened with the password or the empty one, and have no pages if that fails (see encryption).

    objs: their objects, where they have been written to a table already; pages, fonts, contents and maps each read them, so they are written out first otherwise.
    """
    with scratch() as made:
        if objs is None:
            with scratch() as own:  # what objects are found by goes when they are written
                objs = relation(objects(files, password, decrypting=True), "pdf-objects")
                own.remove(objs)
        p = relation(pages(objs).select("doc_id", "page_no", "resources", "contents"), "pdf-pages")
        levels, ops = _painted(contents(p, objs), objs, 8, TEXTUAL, lambda level, what: level)  # contents are kept as their operations alone
        units = reduce(DataFrame.unionByName, (level.drop("content") for level in levels))
        used = relation(fonts(units, objs), "pdf-fonts")
        for kept in (p, used, *ops):
            made.remove(kept)
    text = page_text(reduce(DataFrame.unionByName, ops), used)
    return p.select("doc_id", "page_no").join(text, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
