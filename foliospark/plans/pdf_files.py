"""Queries over the relations of PDF files that are made from the tables, with SQL on those tables.

The files vary what writers vary: order of keys, nested dictionaries, comments, indirect values, incremental updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import codecs
from foliospark.plans.relational_queries import table
from foliospark.sources import pdf, syntax
from foliospark.storage import relation

col, lit = F.col, F.lit


def say(*parts) -> Column:
    """Text of literals and columns, put together."""
    return F.concat(*(lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def file_of(bodies: Column, trailer: str | Column = "", number: Column | None = None) -> Column:
    """Bytes of a file whose objects 1, 2, ... (or of the given numbers) have these bodies; the first is the catalog."""
    each = F.transform(bodies, lambda b, i: F.concat((i + 1 if number is None else F.get(number, i)).cast("string"), lit(" 0 obj\n"), b, lit("\nendobj\n")))
    body = F.concat(lit("%PDF-1.7\n"), F.array_join(each, ""))
    return F.encode(say(body, "xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Root 1 0 R ", trailer, " >>\nstartxref\n", F.length(body), "\n%%EOF"), "ISO-8859-1")


def stream_of(data: Column, more: str = "") -> Column:
    return say(f"<< {more} /Length ", F.length(data), " >>\nstream\n", data, "\nendstream")


def objects_of(files: DataFrame) -> DataFrame:
    return relation(pdf.objects(files), "pdf-objects")


def order_files(spark, sf_dir) -> DataFrame:
    """A file a customer, a page an order; filled orders hang below a node of their own. The page's keys come in varying order, with a nested /Type, comments and an indirect rotation."""
    o = table(spark, sf_dir, "orders").withColumn("k", col("o_orderkey"))
    own = F.concat(
        F.when(col("k") % 3 == 0, say("/MediaBox [0 0 ", 100 + col("k") % 7, " 200] ")).otherwise(""), F.when(col("k") % 4 == 0, "/CropBox [-10 -10 150 5000] ").otherwise(""),
        F.when(col("k") % 5 == 0, "/Rotate 5 0 R ").otherwise(""), F.when(col("k") % 7 == 0, "/TrimBox [20 20 10 10] ").otherwise(""),
    )
    body = F.when(col("k") % 2 == 0, say("<< /Group << /Type /Group /S /Transparency /Rotate 270 >> ", own, "/Type /Page >>")).otherwise(say("<< % /Rotate 270 /Type /Pages\n/A (\\) /Rotate 180 () ) /Type /Page ", own, ">>"))
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("k")) + 5
    pages = o.select("o_custkey", (col("o_orderstatus") == "F").alias("filled"), number.alias("num"), body.alias("body"))
    made = pages.groupBy(col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("num", "filled", "body"))).alias("p"))
    kids = lambda filled: F.array_join(F.transform(F.filter("p", lambda x: x["filled"] == filled), lambda x: F.concat(x["num"].cast("string"), lit(" 0 R"))), " ")
    nodes = F.array(
        lit("<< /Type /Catalog /Pages 2 0 R >>"), lit("<< /Kids [3 0 R 4 0 R] /MediaBox [0 0 612 792] /Type /Pages >>"), say("<< /Type /Pages /Rotate 90 /MediaBox [0 0 300 400] /Kids [", kids(True), "] >>"),
        say("<< /Type /Pages /Kids [", kids(False), "] >>"), lit("180"),
    )
    return made.select("doc_id", file_of(F.concat(nodes, F.transform("p", lambda x: x["body"]))).alias("content"))


def pdf_pages(spark, sf_dir):
    """Pages in tree order with inherited attributes."""
    p = pdf.pages(objects_of(order_files(spark, sf_dir)))
    return p.select("doc_id", "page_no", col("num").cast("long").alias("num"), col("rotate").cast("long").alias("rotate"), F.get("media_box", lit(2)).alias("x1"), F.get("media_box", lit(3)).alias("y1"))


def pdf_boxes(spark, sf_dir):
    """Sizes and boxes of those pages."""
    b = pdf.boxes(pdf.pages(objects_of(order_files(spark, sf_dir))))
    return b.select("doc_id", "page_no", "width", "height", *(F.get("crop", lit(i)).alias(f"crop{i}") for i in range(4)), *(F.get("trim", lit(i)).alias(f"trim{i}") for i in range(4)))


_PAGES = """WITH o AS (SELECT *, o_orderkey AS k, o_orderstatus = 'F' AS f, 5 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS num FROM orders),
p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY f DESC, k) AS page_no, num, k,
  CASE WHEN k % 5 = 0 THEN 180 WHEN f THEN 90 ELSE 0 END AS rotate, CASE WHEN k % 3 = 0 THEN 100.0 + k % 7 WHEN f THEN 300 ELSE 612 END AS x1, CASE WHEN k % 3 = 0 THEN 200.0 WHEN f THEN 400 ELSE 792 END AS y1 FROM o)"""


def pdf_updates(spark, sf_dir):
    """What stands after incremental updates: a file a user, an update an event, of object 10 to 12. Errors free the object, signups define it in an object stream. Every tenth file's startxref is wrong: it is read by scanning."""
    ev = table(spark, sf_dir, "events").withColumn("num", 10 + col("event_id") % 3)
    plain = say(col("num"), " 0 obj\n<< /V ", col("event_id"), " >>\nendobj\n")
    body = say("<< /V ", col("event_id"), " >>")
    packed = say(100 + col("event_id"), " 0 obj\n", stream_of(say(col("num"), " 0 ", body), "/Type /ObjStm /N 1 /First 5"), "\nendobj\n")
    freed = say("xref\n", col("num"), " 1\n0000000000 00001 f \ntrailer\n<< /Root 1 0 R >>\n")
    part = F.when(col("event_type") == "error", freed).when(col("event_type") == "signup", packed).otherwise(plain)
    parts = ev.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", part.alias("t")))).alias("parts"))
    text = F.concat(lit("%PDF-1.7\n1 0 obj\n<< /Type /Catalog >>\nendobj\n"), F.array_join(F.transform("parts", lambda p: p["t"]), ""))
    at = F.when(col("user_id") % 10 == 0, 3).otherwise(F.length(text))
    files = parts.select(col("user_id").alias("doc_id"), F.encode(say(text, "xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Root 1 0 R >>\nstartxref\n", at, "\n%%EOF"), "ISO-8859-1").alias("content"))
    found = pdf.objects(files).where("num between 10 and 12")
    return found.select(col("doc_id").alias("user_id"), "num", syntax.as_int(syntax.get("entries", "V")).alias("v"))


def pdf_xref(spark, sf_dir):
    """What the chain of sections names: a file a customer, a section an order, of object 10 to 12. Of four orders one defines it, one defines it without an entry, one frees it, one is hybrid: free in the table, there in its stream. In every fifth file the oldest section points back at the newest."""
    o = table(spark, sf_dir, "orders").select("o_custkey", col("o_orderkey").alias("k"), (10 + col("o_orderkey") % 3).alias("num"), (F.floor(col("o_orderkey") / 3) % 4).alias("kind"))
    by_key = Window.partitionBy("o_custkey").orderBy("k")
    body = F.when(col("kind") == 2, "").otherwise(say(col("num"), " 0 obj\n<< /V ", col("k"), " >>\nendobj\n"))
    hexed = lambda at: F.lpad(F.hex(at), 8, "0")
    place = lambda at: F.lpad(at.cast("string"), 10, "0")
    coded = lambda at: F.when(col("kind") == 3, say("20 0 obj\n<< /Type /XRef /W [1 4 1] /Index [", col("num"), " 1] /Size 99 /Filter /ASCIIHexDecode /Length 13 >>\nstream\n01", hexed(at), "00>\nendstream\nendobj\n")).otherwise("")
    entry = lambda at: F.when(col("kind") == 0, say(col("num"), " 1\n", place(at), " 00000 n \n")).when(col("kind") == 1, "0 0\n").otherwise(say(col("num"), " 1\n0000000000 00001 f \n"))
    section = lambda at, prev, stm: say("xref\n", entry(at), "trailer\n<< /Root 1 0 R /Prev ", place(prev), F.when(col("kind") == 3, say(" /XRefStm ", place(stm))).otherwise(""), " >>\n")
    zero, first = lit(0).cast("long"), "%PDF-1.7\n1 0 obj\n<< /Type /Catalog >>\nendobj\n"
    opening = lambda prev: say(first, "xref\n1 1\n0000000009 00000 n \ntrailer\n<< /Root 1 0 R ", F.when(col("o_custkey") % 5 == 0, say("/Prev ", place(prev))).otherwise(""), " >>\n")
    sized = o.withColumn("n1", F.length(body)).withColumn("n2", F.length(coded(zero))).withColumn("n3", F.length(section(zero, zero, zero)))
    end = F.length(opening(zero)) + F.sum(col("n1") + col("n2") + col("n3")).over(by_key)
    placed = sized.withColumn("at", (end - col("n3") - col("n2") - col("n1")).cast("long")).withColumn("stm", col("at") + col("n1")).withColumn("table", col("at") + col("n1") + col("n2"))
    placed = placed.withColumn("prev", F.coalesce(F.lag("table").over(by_key), lit(len(first)).cast("long")))
    part = F.concat(body, coded(col("at")), section(col("at"), col("prev"), col("stm")))
    made = placed.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", part.alias("t")))).alias("parts"), F.max("table").alias("last"))
    text = F.concat(opening(col("last")), F.array_join(F.transform("parts", lambda p: p["t"]), ""), say("startxref\n", col("last"), "\n%%EOF"))
    found = pdf.objects(made.select(col("o_custkey").alias("doc_id"), F.encode(text, "ISO-8859-1").alias("content"))).where("num between 10 and 12")
    return found.select(col("doc_id").alias("o_custkey"), "num", syntax.as_int(syntax.get("entries", "V")).alias("v"))


FONTS = {
    0: "<< /Type /Font /Encoding << /Differences [97 /alpha % /beta\n /uni20AC 122 /eacute.alt] /Type /Encoding >> /Subtype /Type1 >>", 1: "<< /Type /Font /Subtype /Type1 /Encoding /StandardEncoding >>",
    2: "<< /Encoding << /BaseEncoding /MacRomanEncoding >> /Type /Font >>", 3: "<< /Type /Font /ToUnicode 6 0 R >>",
}


def pdf_encodings(spark, sf_dir):
    """Text in fonts with differences, base encodings and a partial ToUnicode map: a file a part."""
    part = table(spark, sf_dir, "part").withColumn("kind", (col("p_partkey") % 4).cast("int"))
    font = F.element_at(F.array(*map(lit, FONTS.values())), col("kind") + 1)
    shown = say("% (no) Tj\nBT /F#31 9 Tf ('`\\216 ", col("p_name"), ") Tj ET")
    cmap = "begincmap 1 beginbfchar <61> <0058> endbfchar endcmap"
    bodies = F.array(
        lit("<< /Type /Catalog /Pages 2 0 R >>"), lit("<< /Type /Pages /Kids [3 0 R] >>"), lit("<< /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R /Type /Page >>"), stream_of(shown), font,
        lit(f"<< /Length {len(cmap)} >>\nstream\n{cmap}\nendstream"),
    )
    return pdf.extract_text(part.select(col("p_partkey").alias("doc_id"), file_of(bodies).alias("content"))).select(col("doc_id").alias("p_partkey"), "text")


def pdf_cmaps(spark, sf_dir):
    """Text of mixed one- and two-byte codes, and the sum of its glyph numbers: a file a part. The font's map has the codes of two bytes, the one that it builds on those of one, and that names the first again."""
    part = table(spark, sf_dir, "part")
    own = "1 begincodespacerange <8000> <80FF> endcodespacerange 1 begincidrange <8000> <80FF> 1000 endcidrange 1 begincidchar <8031> 7 endcidchar"
    base = "begincodespacerange <00> <7F> endcodespacerange begincidrange <00> <7f> 100 endcidrange"
    text = "begincmap 2 beginbfrange <20> <7E> <0020> <8000> <80FF> <0000> endbfrange endcmap"
    shown = say("BT /F1 9 Tf [<", F.hex("p_name"), F.regexp_replace(F.hex("p_brand"), "(..)", "80$1"), "> -50 (", col("p_name"), ")] TJ ET")
    stream = lambda t, more="": f"<< {more} /Length {len(t)} >>\nstream\n{t}\nendstream"
    bodies = F.array(
        lit("<< /Type /Catalog /Pages 2 0 R >>"), lit("<< /Type /Pages /Kids [3 0 R] >>"), lit("<< /Resources << /Font << /F1 << /Subtype /Type0 /Encoding 5 0 R /ToUnicode 7 0 R >> >> >> /Contents 4 0 R /Type /Page >>"), stream_of(shown),
        lit(stream(own, "/UseCMap 6 0 R")), lit(stream(base, "/UseCMap 5 0 R")), lit(stream(text)),
    )
    o = objects_of(part.select(col("p_partkey").alias("doc_id"), file_of(bodies).alias("content")))
    units = pdf.contents(pdf.pages(o), o)
    ops, fonts = pdf.operations(units), relation(pdf.fonts(units, o), "pdf-fonts")
    cids = pdf.shown_codes(ops, fonts).groupBy("doc_id").agg(F.sum("cid").alias("cids"))
    return pdf.page_text(ops, fonts).join(cids, "doc_id").select(col("doc_id").alias("p_partkey"), "text", "cids")


def pdf_form_text(spark, sf_dir):
    """Text of form XObjects, nested ones too, where they are painted: a file a supplier."""
    s = table(spark, sf_dir, "supplier")
    inner, outer = say("BT /F1 1 Tf [(", col("s_name"), ")] TJ ET"), lit("BT /F1 1 Tf (<) Tj ET /X2 Do BT (>) Tj ET")
    bodies = F.array(
        lit("<< /Type /Catalog /Pages 2 0 R >>"), lit("<< /Type /Pages /Kids [3 0 R] /Resources 8 0 R >>"), lit("<< /Type /Page /Contents [4 0 R] >>"), stream_of(lit("BT /F1 1 Tf (a) Tj ET q /X1 Do Q BT (b) Tj ET /X9 Do")), lit("<< /Type /Font /Subtype /Type1 >>"),
        stream_of(outer, "/Type /XObject /Subtype /Form"), stream_of(inner, "/Subtype /Form /Resources << /Font << /F1 5 0 R >> >>"), lit("<< /Font << /F1 5 0 R >> /XObject 9 0 R >>"), lit("<< /X1 6 0 R /X2 7 0 R >>"),
    )
    return pdf.extract_text(s.select(col("s_suppkey").alias("doc_id"), file_of(bodies).alias("content"))).select(col("doc_id").alias("s_suppkey"), "text")


def nation_files(spark, sf_dir) -> DataFrame:
    """A file a nation with three pages; its suppliers are bookmarks in order of balance, linked by /Next, every other with a bookmark below; destinations are arrays, names of the tree, names of the dictionary and page numbers."""
    s = table(spark, sf_dir, "supplier").withColumn("k", col("s_suppkey"))
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "k"))
    s = s.withColumn("rank", rank).withColumn("n", F.count("*").over(Window.partitionBy("s_nationkey")))
    num, up = 20 + 2 * col("rank"), "/Parent 10 0 R"
    to = F.when(col("k") % 4 == 0, say("/Dest [", 3 + col("k") % 3, " 0 R /XYZ 0 ", col("k"), " 0]")).when(col("k") % 4 == 1, say("/Dest (tree", col("k") % 3, ")")).when(col("k") % 4 == 2, say("/A << /D /dict", col("k") % 3, " /S /GoTo >>")).otherwise(say("/Dest [", col("k") % 3, " /FitH 7]"))
    below = F.when(col("k") % 2 == 0, say(" /First ", num + 1, " 0 R")).otherwise("")
    after = F.when(col("rank") < col("n"), say(" /Next ", num + 2, " 0 R")).otherwise("")
    mark = say("<< /Title ( ", col("s_name"), " ) ", up, after, below, " ", to, " >>")
    child = F.when(col("k") % 2 == 0, say("<< /Title (sub) /Parent ", num, " 0 R >>")).otherwise("null")
    made = s.groupBy(col("s_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("rank", mark.alias("mark"), child.alias("child")))).alias("s"))
    page = lit("<< /Type /Page /Annots [12 0 R 13 0 R 14 0 R 15 0 R] >>")
    dest = lambda i: f"<< /D [{3 + i} 0 R /FitV 5] >>"
    fixed = F.array(
        lit("<< /Type /Catalog /Pages 2 0 R /Outlines 10 0 R /Dests << /dict0 [3 0 R /Fit] /dict1 << /D [4 0 R /Fit] >> /dict2 16 0 R >> /Names << /Dests 6 0 R >> /PageLabels 9 0 R >>"), lit("<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Count 3 >>"), page, page, page,
        lit("<< /Kids [7 0 R 8 0 R] >>"), lit(f"<< /Limits [(tree0) (tree1)] /Names [(tree0) {dest(0)} (tree1) 17 0 R] >>"), lit(f"<< /Limits [(tree2) (tree2)] /Names [(tree2) {dest(2)}] >>"), lit("<< /Kids [11 0 R 18 0 R] >>"), lit("<< /Type /Outlines /First 22 0 R >>"),
        lit("<< /Nums [0 << /S /r >>] >>"), say("<< /Subtype /Link /Rect [3 4 1 2] /A << /S /URI /URI (https://x.test/", col("doc_id"), ") >> >>"), lit("<< /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (javascript:1) >> >>"),
        lit("<< /Subtype /Link /Rect [0 0 9 9] /QuadPoints [0 0 1 0 0 2 1 2 5 5 6 5 5 7 6 7] /Dest (tree1) >>"), lit("<< /Subtype /Link /F 2 /Rect [0 0 1 1] /Dest (tree1) >>"), lit("[5 0 R /Fit]"), lit(dest(1)), lit("<< /Nums [2 19 0 R] >>"), lit("<< /P (x-) /S /D /St 7 >>"), lit("null"), lit("null"),
    )
    return made.select("doc_id", file_of(F.concat(fixed, F.flatten(F.transform("s", lambda x: F.array(x["mark"], x["child"]))))).alias("content"))


def pdf_outline(spark, sf_dir):
    """Bookmarks as they are shown, with their levels and where they lead."""
    o = objects_of(nation_files(spark, sf_dir))
    out = pdf.outline(o, pdf.pages(o)).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    return out.select("doc_id", "nth", col("level").cast("int").alias("level"), "title", F.coalesce("page_no", lit(0)).cast("int").alias("page_no"), "view.fit", "view.left", "view.top")


def pdf_links(spark, sf_dir):
    """Regions of links that may be followed."""
    o = objects_of(nation_files(spark, sf_dir))
    out = pdf.links(o, pdf.pages(o))
    return out.select("doc_id", "page_no", *(F.get("rect", lit(i)).alias(f"r{i}") for i in range(4)), "uri", F.coalesce("dest_page", lit(0)).cast("int").alias("dest_page"))


def pdf_page_labels(spark, sf_dir):
    """Labels from a number tree with two leaves."""
    o = objects_of(nation_files(spark, sf_dir))
    return pdf.labels(pdf.pages(o), o).select("doc_id", "page_no", "label")


def customer_files(spark, sf_dir) -> DataFrame:
    """A file a customer: form fields, structure, document information, and for some an encryption dictionary."""
    c = table(spark, sf_dir, "customer").withColumn("k", col("c_custkey"))
    bodies = F.array(
        lit("<< /Type /Catalog /Version /2.0 /AcroForm << /Fields [3 0 R] >> >>"), say("<< /Author <FEFF20AC", F.hex(F.encode(col("c_mktsegment"), "UTF-16BE")), "> /Title (", col("c_name"), " \\(", col("k"), "\\)) /CreationDate (D:2024022", col("k") % 9, "120000+02'30') /Company /Acme#20", col("k"), " >>"),
        lit("<< /T (customer) /FT /Tx /Kids [4 0 R 5 0 R 6 0 R] >>"), say("<< /V (", col("c_name"), ") /T (name) >>"), say("<< /T (segment) /FT /Ch /V [(", col("c_mktsegment"), ") (", col("k"), ")] >>"), lit("<< /T (agree) /FT /Btn /V /Yes /Kids [7 0 R] >>"),
        lit("<< /Subtype /Widget /Parent 6 0 R >>"), lit("<< /S /Document /Type /StructElem >>"), say("<< /Type /StructElem /P 8 0 R /S /H", col("k") % 6 + 1, " /Alt (", col("c_name"), ") >>"), say("<< /O (x) /U (y) /R 3 /V 2 /P ", -4 * (col("k") % 1000) - 1, " /Filter /Standard >>"),
    )
    plain, locked = file_of(bodies, "/Info 2 0 R"), file_of(bodies, "/Encrypt 10 0 R /Info 2 0 R")
    return c.select(col("k").alias("doc_id"), F.when(col("k") % 3 == 0, locked).otherwise(plain).alias("content"))


def pdf_form_fields(spark, sf_dir):
    return pdf.form_fields(objects_of(customer_files(spark, sf_dir))).select("doc_id", "name", "type", "value")


def pdf_structure(spark, sf_dir):
    return pdf.structure(objects_of(customer_files(spark, sf_dir))).select("doc_id", col("level").cast("int").alias("level"), "path", "alt")


def pdf_metadata(spark, sf_dir):
    """Document information, with keys of its own and the catalog's version."""
    files = customer_files(spark, sf_dir)
    o = objects_of(files)
    both = pdf.metadata(files, o).join(pdf.trailers(files, o).select("doc_id", "version"), "doc_id")
    return both.select("doc_id", "version", "title", "author", F.date_format("created.at", "yyyy-MM-dd HH:mm").alias("created"), "created.offset_minutes", F.try_element_at("custom", lit("Company")).alias("company"))


def pdf_permissions(spark, sf_dir):
    """Rights by the encryption dictionary, in files where other objects have a /P too."""
    files = customer_files(spark, sf_dir)
    return pdf.permissions(files, objects_of(files)).select("doc_id", "status", "rights.print", "rights.modify", "rights.copy", "rights.print_high")


def pdf_warnings(spark, sf_dir):
    """What was worked around in damaged files: a file a region or nation, cut, shifted or without a catalog."""
    n = table(spark, sf_dir, "nation").withColumn("kind", col("n_nationkey") % 4)
    whole = F.decode(file_of(F.array(lit("<< /Type /Catalog /Pages 2 0 R >>"), lit("<< /Type /Pages >>"))), "ISO-8859-1")
    text = F.when(col("kind") == 1, F.regexp_replace(whole, "(?s)startxref.*", "")).when(col("kind") == 2, F.replace(whole, lit("/Type /Catalog"), lit("/Kind /Catalog"))).when(col("kind") == 3, F.concat(lit("junk"), F.replace(whole, lit("/Root 1"), lit("/Root 7")))).otherwise(whole)
    files = n.select(col("n_nationkey").alias("doc_id"), F.encode(text, "ISO-8859-1").alias("content"))
    return pdf.warnings(files, objects_of(files)).select("doc_id", "message")


def pdf_streams(spark, sf_dir):
    """Texts through a chain of filters with predictors of three colours a pixel, read by the stream's own dictionary; lengths are indirect."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", lit("")).cast("binary").alias("raw"))
    coded = F.decode(codecs.codec(_coded)(col("raw")), "ISO-8859-1")
    bodies = F.array(lit("<< /Type /Catalog >>"), say("<< /DecodeParms [null 4 0 R] /Filter [/ASCIIHexDecode /FlateDecode] /Length 3 0 R >>\nstream\n", coded, "\nendstream"), F.length(coded).cast("string"), lit("<< /Colors 3 /Predictor 15 /Columns 16 >>"))
    bodies = F.transform(bodies, lambda b: F.replace(b, lit("4 0 R"), lit("<< /Colors 3 /Predictor 15 /Columns 16 >>")))
    o = pdf.objects(d.withColumn("coded", coded).select("doc_id", file_of(bodies).alias("content"))).where("num = 2")
    return o.select("doc_id", F.md5(F.encode(F.rtrim(F.decode("stream", "UTF-8"), lit("\0")), "UTF-8")).alias("text_md5"))


def _coded(data: bytes) -> bytes:
    import zlib

    return zlib.compress(codecs.png_encode(data, 16, 3)).hex().encode() + b">"


QUERIES = {f.__name__: f for f in (
    pdf_pages, pdf_boxes, pdf_updates, pdf_xref, pdf_encodings, pdf_cmaps, pdf_form_text, pdf_outline, pdf_links, pdf_page_labels, pdf_form_fields, pdf_structure, pdf_metadata, pdf_permissions, pdf_warnings, pdf_streams,
)}
_BIT = lambda b, n: f"(k % 3 <> 0 OR ((-4 * (k % 1000) - 1) >> {b - 1}) & 1 = 1) AS {n}"
SQL = {
    "pdf_pages": f"{_PAGES} SELECT doc_id, CAST(page_no AS INT) AS page_no, num, CAST(rotate AS BIGINT) AS rotate, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM p",
    "pdf_boxes": f"""{_PAGES}, c AS (SELECT *, k % 4 = 0 AS cut, k % 7 = 0 AS trimmed FROM p)
        SELECT doc_id, CAST(page_no AS INT) AS page_no, CAST(CASE WHEN rotate = 90 THEN y1 ELSE x1 END AS DOUBLE) AS width, CAST(CASE WHEN rotate = 90 THEN x1 ELSE y1 END AS DOUBLE) AS height,
        0.0::DOUBLE AS crop0, 0.0::DOUBLE AS crop1, CAST(CASE WHEN cut THEN least(x1, 150) ELSE x1 END AS DOUBLE) AS crop2, CAST(y1 AS DOUBLE) AS crop3,
        CAST(CASE WHEN trimmed THEN 10 ELSE 0 END AS DOUBLE) AS trim0, CAST(CASE WHEN trimmed THEN 10 ELSE 0 END AS DOUBLE) AS trim1,
        CAST(CASE WHEN trimmed THEN 20 WHEN cut THEN least(x1, 150) ELSE x1 END AS DOUBLE) AS trim2, CAST(CASE WHEN trimmed THEN 20 ELSE y1 END AS DOUBLE) AS trim3 FROM c""",
    "pdf_updates": """WITH e AS (SELECT *, 10 + event_id % 3 AS num, user_id % 10 <> 0 AS sound FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, num ORDER BY CASE WHEN sound THEN 0 WHEN event_type = 'error' THEN 2 WHEN event_type = 'signup' THEN 1 ELSE 0 END, event_id DESC) AS nth FROM e)
        SELECT user_id, num, event_id AS v FROM r WHERE nth = 1 AND event_type <> 'error'""",
    "pdf_xref": """WITH o AS (SELECT o_custkey, o_orderkey AS k, 10 + o_orderkey % 3 AS num, (o_orderkey // 3) % 4 AS kind FROM orders),
        e AS (SELECT o_custkey, num, max(k) AS named, arg_max(kind, k) AS kind, max(k) FILTER (WHERE kind = 3) AS coded FROM o WHERE kind <> 1 GROUP BY o_custkey, num)
        SELECT o_custkey, num, CASE WHEN kind = 2 THEN coded ELSE named END AS v FROM e WHERE kind <> 2 OR coded IS NOT NULL""",
    "pdf_encodings": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '''`Ž ' || translate(p_name, 'abz', 'α€é') WHEN 1 THEN '’‘Ž ' || p_name WHEN 2 THEN '''`é ' || p_name ELSE '''`Ž ' || replace(p_name, 'a', 'X') END AS text FROM part""",
    "pdf_cmaps": """SELECT p_partkey, p_name || p_brand || p_name AS text, CAST(2 * list_sum(list_transform(string_split(p_name, ''), lambda x: ascii(x) + 100))
        + list_sum(list_transform(string_split(p_brand, ''), lambda x: CASE WHEN x = '1' THEN 7 ELSE ascii(x) + 1000 END)) AS BIGINT) AS cids FROM part""",
    "pdf_form_text": "SELECT s_suppkey, 'a<' || s_name || '>b' AS text FROM supplier",
    "pdf_outline": """WITH s AS (SELECT *, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier),
        m AS (SELECT s_nationkey AS doc_id, rank, 0 AS level, s_name AS title, k % 3 + 1 AS page_no, CASE k % 4 WHEN 0 THEN 'XYZ' WHEN 1 THEN 'FitV' WHEN 2 THEN 'Fit' ELSE 'FitH' END AS fit,
          CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 END AS l, CASE k % 4 WHEN 0 THEN k WHEN 3 THEN 7 END AS t FROM s
          UNION ALL SELECT s_nationkey, rank, 1, 'sub', NULL, NULL, NULL, NULL FROM s WHERE k % 2 = 0)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank, level) AS INT) AS nth, CAST(level AS INT) AS level, title, CAST(coalesce(page_no, 0) AS INT) AS page_no, fit, CAST(l AS DOUBLE) AS "left", CAST(t AS DOUBLE) AS top FROM m""",
    "pdf_links": """WITH n AS (SELECT DISTINCT s_nationkey AS doc_id FROM supplier), p AS (SELECT CAST(unnest(range(1, 4)) AS INT) AS page_no), r AS (
          SELECT 1.0::DOUBLE AS r0, 2.0::DOUBLE AS r1, 3.0::DOUBLE AS r2, 4.0::DOUBLE AS r3, true AS u UNION ALL SELECT 0, 0, 1, 2, false UNION ALL SELECT 5, 5, 6, 7, false)
        SELECT doc_id, page_no, r0, r1, r2, r3, CASE WHEN u THEN 'https://x.test/' || doc_id END AS uri, CAST(CASE WHEN u THEN 0 ELSE 2 END AS INT) AS dest_page FROM n, p, r""",
    "pdf_page_labels": "SELECT doc_id, CAST(i AS INT) AS page_no, ['i', 'ii', 'x-7'][i] AS label FROM (SELECT DISTINCT s_nationkey AS doc_id, unnest(range(1, 4)) AS i FROM supplier)",
    "pdf_form_fields": """SELECT c_custkey AS doc_id, 'customer.name' AS name, 'Tx' AS type, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'customer.segment', 'Ch', c_mktsegment || ', ' || c_custkey FROM customer
        UNION ALL SELECT c_custkey, 'customer.agree', 'Btn', 'Yes' FROM customer""",
    "pdf_structure": "SELECT c_custkey AS doc_id, 0 AS level, 'Document' AS path, NULL AS alt FROM customer UNION ALL SELECT c_custkey, 1, 'Document.H' || (c_custkey % 6 + 1), c_name FROM customer",
    "pdf_metadata": """SELECT c_custkey AS doc_id, '2.0' AS version, c_name || ' (' || c_custkey || ')' AS title, '€' || c_mktsegment AS author, '2024-02-2' || (c_custkey % 9) || ' 12:00' AS created,
        CAST(150 AS INT) AS offset_minutes, 'Acme ' || c_custkey AS company FROM customer""",
    "pdf_permissions": f"SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'encrypted' ELSE 'ok' END AS status, {_BIT(3, 'print')}, {_BIT(4, 'modify')}, {_BIT(5, 'copy')}, {_BIT(12, 'print_high')} FROM (SELECT c_custkey AS k FROM customer)",
    "pdf_warnings": """WITH n AS (SELECT n_nationkey AS doc_id, n_nationkey % 4 AS kind FROM nation)
        SELECT doc_id, 'page tree node without kids: 2' AS message FROM n UNION ALL SELECT doc_id, unnest(['startxref is missing', 'tables are damaged, objects were found by scanning']) FROM n WHERE kind = 1
        UNION ALL SELECT doc_id, 'there is no catalog' FROM n WHERE kind = 2 UNION ALL SELECT doc_id, 'the catalog was found by its type' FROM n WHERE kind = 3""",
    "pdf_streams": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
}
