"""PDF relations on generated files."""

import base64
import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.functions import codecs
from foliospark.sources import pdf
from tests.pdf_maker import build, one_page, stream

TEXT = b"BT /F1 24 Tf 50 100 Td (Hello) Tj ET"


@pytest.fixture(scope="module")
def load(spark):
    def make(*contents):
        return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "doc_id long, content binary")

    return make


def texts(files):
    return {(r.doc_id, r.page_no): r.text for r in pdf.extract_text(files).collect()}


def test_text_rules(load):
    files = load(
        one_page(TEXT), one_page(b"BT /F1 9 Tf (Foo) Tj 0 -20 Td (Bar) Tj ET", flate=True), one_page(rb"BT /F1 9 Tf (a\(b\)\\\101\n) Tj 5 0 Td (x(y)z) Tj T* <4142> Tj ET"),
        one_page(b"BT /F1 9 Tf [(A) -50 (B) -200 (C)] TJ (D) ' ET"), one_page(b"BT /F1 9 Tf (\x93q\x94) Tj ET"), b"junk before " + one_page(TEXT)[:-60], one_page(b"q BI /W 1 /H 1 ID \x00(x) Tj EI Q BT /F1 9 Tf (ok) Tj ET"),
    )
    assert texts(files) == {(0, 1): "\nHello", (1, 1): "Foo\nBar", (2, 1): "a(b)\\A\n x(y)z\nAB", (3, 1): "AB C\nD", (4, 1): "“q”", (5, 1): "\nHello", (6, 1): "ok"}


def test_long_arrays_are_one_operand(load):
    kerned = b" ".join(b"(%d) -20" % i for i in range(400))
    files = load(one_page(b"BT /F1 9 Tf [" + kerned + b"] TJ ET"), one_page(b"BT /F1 9 Tf (a) Tj ] ] /P << /K [" + b"1 " * 200 + b"] >> BDC " + b"7 " * 100 + b"[(b) [1] (c)] TJ ET"))
    assert texts(files) == {(0, 1): "".join(map(str, range(400))), (1, 1): "abc"}
    ops = {r.op: r.operands for r in pdf.operations(pdf.contents(pdf.pages(pdf.objects(files)), pdf.objects(files))).where("doc_id = 1").collect()}
    assert ops["TJ"] == ["7"] * 63 + ["[", "(b)", "[", "1", "]", "(c)", "]"] and ops["BDC"][-206:] == ["/P", "<<", "/K", "[", *["1"] * 200, "]", ">>"][-207:]


def test_unicode_maps(load):
    cmap = b"begincmap 2 beginbfchar <0001> <0041> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<005A> <0059>] endbfrange endcmap"
    font = "<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"
    body = one_page(b"BT /F1 9 Tf <00010002001000120020002100FF> Tj ET", more=(stream(cmap),)).replace(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", font.encode())
    assert texts(load(body)) == {(0, 1): "A\U0001f600acZY"}


def test_pages_inherit_and_boxes_clip(load):
    kids = build(["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [4 0 R 3 0 R 4 0 R] /MediaBox [0 0 200 100] /Rotate 450 >>", "<< /Type /Page /Parent 2 0 R /CropBox [150 -5 500 50] >>", "<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 6 0 R] /Rotate 0 >>", "<< /Type /Page /Parent 4 0 R >>", "<< /Type /Page /Parent 4 0 R /MediaBox [10 10 0 0] >>"], 1)
    pages = pdf.pages(pdf.objects(load(kids)).cache()).cache()
    assert [(r.page_no, r.num, r.rotate) for r in pages.orderBy("page_no").collect()] == [(1, 5, 0), (2, 6, 0), (3, 3, 90)]
    assert [(r.width, r.height, r.crop) for r in pdf.boxes(pages).orderBy("page_no").collect()] == [(200, 100, [0, 0, 200, 100]), (10, 10, [0, 0, 10, 10]), (100, 200, [150, 0, 200, 50])]


def test_metadata_labels_and_rights(load):
    info = "<< /Title (A \\(b\\)) /Author <FEFF20AC> /CreationDate (D:20240102030405+02'00') >>"
    four = build(["<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r >> 2 << /S /D /St 1 /P (x-) >>] >> >>", "<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R 6 0 R] >>", *["<< /Type /Page /Parent 2 0 R >>"] * 4, info], 1, "/Info 7 0 R")
    locked = one_page(TEXT, more=("<< /Filter /Standard /V 2 /R 3 /P 4 >>",), trailer="/Encrypt 6 0 R")
    files = load(four, locked)
    objs = pdf.objects(files).cache()
    meta = {r.doc_id: r for r in pdf.metadata(files, objs).collect()}
    assert (meta[0].title, meta[0].author, meta[0].created.at, meta[0].created.offset_minutes) == ("A (b)", "€", datetime.datetime(2024, 1, 2, 3, 4, 5), 120) and meta[1].title is None
    assert [r.label for r in pdf.labels(pdf.pages(objs), objs).where("doc_id = 0").orderBy("page_no").collect()] == ["i", "ii", "x-1", "x-2"]
    rights = {r.doc_id: r for r in pdf.permissions(files).collect()}
    assert rights[0].status == "ok" and all(rights[0].rights) and rights[1].status == "encrypted" and (rights[1].rights["print"], rights[1].rights["copy"]) == (True, False)
    assert [r.version for r in pdf.trailers(files).collect()] == ["1.7", "1.7"]


def test_trees_and_links(load):
    more = (
        "<< /T (address) /FT /Tx /Kids [7 0 R] >>", "<< /T (city) /Parent 6 0 R /V (Oslo) >>", "<< /T (agree) /FT /Btn /V /Yes >>", "<< /Type /StructElem /S /Document >>", "<< /Type /StructElem /S /Figure /P 9 0 R /Alt (A cat) >>",
        "<< /Type /Outlines /First 12 0 R >>", "<< /Title ( Chapter 1 ) /Parent 11 0 R /Dest [3 0 R /XYZ 0 200 0] >>", "<< /Title (Part) /Parent 12 0 R >>",
        "<< /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (https://x.test) >> >>", "<< /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (javascript:1) >> >>", "<< /Subtype /Link /Rect [0 0 1 1] /Dest [3 0 R /Fit] >>", "<< /Subtype /Link /F 2 /Rect [0 0 1 1] /Dest [3 0 R /Fit] >>",
    )
    objs = pdf.objects(load(one_page(TEXT, page="/Annots [14 0 R 15 0 R 16 0 R 17 0 R]", more=more))).cache()
    pages = pdf.pages(objs).cache()
    assert sorted((r.name, r.type, r.value) for r in pdf.form_fields(objs).collect()) == [("address.city", "Tx", "Oslo"), ("agree", "Btn", "Yes")]
    assert sorted((r.level, r.path, r.alt) for r in pdf.structure(objs).collect()) == [(0, "Document", None), (1, "Document.Figure", "A cat")]
    assert sorted((r.level, r.title, r.page_no) for r in pdf.outline(objs, pages).collect()) == [(0, "Chapter 1", 1), (1, "Part", None)]
    assert sorted((r.uri or "", r.dest_page) for r in pdf.links(objs, pages).collect()) == [("", 1), ("https://x.test", None)]


def test_object_streams_and_rewritten_objects(load):
    inner = b"5 0 8 10 << /A 1 >><< /B 2 >>"
    body = build(["<< /Type /Catalog >>", stream(inner, "/Type /ObjStm /N 2 /First 9", flate=True), "<< /C 3 >>", "null", "<< /Old 1 >>"], 1) + b"\n3 0 obj\n<< /C 4 >>\nendobj\n"
    chain = {r.num: r.dict.strip() for r in pdf.objects(load(body)).collect()}
    assert chain[3] == "<< /C 3 >>" and 8 not in chain  # only what the sections name
    body = body.replace(b"startxref\n", b"startxref\n9")  # leads nowhere: found by scanning
    got = {r.num: r.dict.strip() for r in pdf.objects(load(body)).collect()}
    assert got[3] == "<< /C 4 >>" and got[8] == "<< /B 2 >>" and got[5] == "<< /Old 1 >>"


JUNK = [b"", b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 1 0 R /Kids [1 0 R] >> endobj", b"1 0 obj << /Type /Pages /Kids [1 0 R] >> endobj 2 0 obj << /Type /Catalog /Pages 1 0 R >> endobj", bytes(range(256)) * 9]


def test_damage_gives_no_pages(load):
    assert texts(load(*JUNK)) == {}


def test_binary_file_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(one_page(TEXT))
    files = pdf.read_files(spark, str(tmp_path))
    (row,) = pdf.extract_text(files).collect()
    assert row.doc_id.endswith("a.pdf") and row.text == "\nHello"


def test_codecs():
    import os
    import zlib

    for n in (0, 1, 5, 300, 9000):
        for data in (os.urandom(n), b"ab" * (n // 2), b"a" * n):
            assert codecs.run_length(codecs.run_length_encode(data)) == data
            assert codecs.ascii85(codecs.ascii85_encode(data)) == data
            assert codecs.lzw(codecs.lzw_encode(data)) == data and codecs.lzw(codecs.lzw_encode(data, 0), 0) == data
            assert codecs.inflate(zlib.compress(data)) == data and codecs.inflate(zlib.compress(data)[2:-4]) == data
            assert codecs.png_predictor(codecs.png_encode(data, 7), 7)[: len(data)] == data
    assert codecs.tiff_predictor(b"\x11\x11", 4, 1, 4) == b"\x12\x34"
    damaged = zlib.compress(b"x" * 5000 + os.urandom(3000))[:-1500]
    assert codecs.inflate(damaged).startswith(b"x" * 5000)
    assert codecs.ascii_hex(b"4 1zz4>ff") == b"A@" and codecs.ascii85(base64.a85encode(bytes(4)) + b"~>") == bytes(4)


def locked(password: bytes, owner: bytes, revision: int, aes: bool = False) -> bytes:
    """A one-page file encrypted as the handler's revisions 2 to 4 say."""
    import hashlib
    import os

    from foliospark.sources import security as sec

    n, file_id, p = 5 if revision == 2 else 16, b"0123456789abcdef", -44
    own = hashlib.md5((owner + sec.PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        own = hashlib.md5(own).digest()
    o = (password + sec.PAD)[:32]
    for i in range(20 if revision >= 3 else 1):
        o = sec.rc4(bytes(k ^ i for k in own[:n]), o)
    key = sec.user_key(password, o, p, file_id, revision, n, True)
    u = sec.user_check(key, file_id, revision).ljust(32, b"\0")

    def seal(data: bytes, num: int) -> bytes:
        k = hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if aes else b"")).digest()[: min(n + 5, 16)]
        if not aes:
            return sec.rc4(k, data)
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F

        session = SparkSession.getActiveSession()
        return bytes(session.range(1).select(F.aes_encrypt(F.lit(bytearray(data)), F.lit(bytearray(k)), F.lit("CBC"), F.lit("PKCS"), F.lit(bytearray(os.urandom(16))))).first()[0])

    kind = "/V 4 /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF" if aes else f"/V {1 if revision == 2 else 2} /Length {n * 8}"
    content = seal(TEXT, 4)
    bodies = [
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", stream(content), "<< /Type /Font /Subtype /Type1 >>",
        f"<< /Filter /Standard {kind} /R {revision} /P {p} /O <{o.hex()}> /U <{u.hex()}> >>", f"<< /Title <{seal(b'Secret', 7).hex()}> >>",
    ]
    return build(bodies, 1, f"/Info 7 0 R /Encrypt 6 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]")


def test_encrypted_files(load):
    files = load(locked(b"", b"own", 2), locked(b"", b"own", 3), locked(b"pw", b"own", 3), locked(b"", b"own", 4, aes=True), one_page(TEXT)).cache()
    raw = pdf.objects(files).cache()
    assert {r.doc_id: r.status for r in pdf.encryption(files, raw).collect()} == {0: "ok", 1: "ok", 2: "need_password", 3: "ok"}
    assert {r.doc_id: r.status for r in pdf.encryption(files, raw, "pw").collect()}[2] == "ok" and {r.doc_id: r.status for r in pdf.encryption(files, raw, "own").collect()}[2] == "ok"
    assert {r.doc_id: r.status for r in pdf.encryption(files, raw, "no").collect()} == {0: "bad_password", 1: "bad_password", 2: "bad_password", 3: "bad_password"}
    objs = pdf.objects(files, decrypting=True).cache()
    text = {r.doc_id: r.text for r in pdf.extract_text(files, objs).collect()}
    assert text == {0: "\nHello", 1: "\nHello", 3: "\nHello", 4: "\nHello"}
    titles = {r.doc_id: r.title for r in pdf.metadata(files, objs).collect()}
    assert titles[0] == titles[1] == "Secret" and titles[2] is None


def locked_256(spark, password: str, owner: str, revision: int) -> bytes:
    """A one-page file encrypted as revisions 5 and 6 say, by hashlib and the JVM's own cipher."""
    import hashlib
    import os

    crypto = spark._jvm.javax.crypto

    def aes(key: bytes, iv: bytes, data: bytes) -> bytes:
        cipher = crypto.Cipher.getInstance("AES/CBC/NoPadding")
        cipher.init(1, crypto.spec.SecretKeySpec(key, "AES"), crypto.spec.IvParameterSpec(iv))
        return bytes(cipher.doFinal(data))

    def digest(word: bytes, salt: bytes, more: bytes) -> bytes:
        k = hashlib.sha256(word + salt + more).digest()
        rounds = 0
        while revision == 6:
            e = aes(k[:16], k[16:32], (word + k + more) * 64)
            k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[int.from_bytes(e[:16], "big") % 3](e).digest()
            rounds += 1
            if rounds >= 64 and e[-1] <= rounds - 32:
                break
        return k[:32]

    def entry(word: bytes, more: bytes) -> tuple[bytes, bytes]:
        check, wrap = os.urandom(8), os.urandom(8)
        return digest(word, check, more) + check + wrap, aes(digest(word, wrap, more), bytes(16), key)

    key = os.urandom(32)
    u, ue = entry(password.encode(), b"")
    o, oe = entry(owner.encode(), u)

    def seal(data: bytes) -> bytes:
        iv, pad = os.urandom(16), 16 - len(data) % 16
        return iv + aes(key, iv, data + bytes([pad]) * pad)

    bodies = [
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", stream(seal(TEXT)), "<< /Type /Font /Subtype /Type1 >>",
        f"<< /Filter /Standard /V 5 /R {revision} /P -44 /O <{o.hex()}> /U <{u.hex()}> /OE <{oe.hex()}> /UE <{ue.hex()}> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>", f"<< /Title <{seal(b'Secret').hex()}> /Keys [(short) <{seal(b'In').hex()}>] >>",
    ]
    return build(bodies, 1, "/Info 7 0 R /Encrypt 6 0 R")


def test_revisions_5_and_6_with_a_password_a_file(spark):
    made = [(password, owner, r) for r in (5, 6) for password, owner in (("", "own"), ("pässword", "own"))]
    given = [None, "pässword", "own", "no", ""]
    made = [bytearray(locked_256(spark, *m)) for m in made]
    rows = [(10 * i + j, m, word) for i, m in enumerate(made) for j, word in enumerate(given)]
    rows.append((99, bytearray(build(["<< /Type /Catalog >>", "<< /Filter /Standard /V 5 /R 6 /U <00> >>"], 1, "/Encrypt 2 0 R")), "x"))
    rows.append((98, bytearray(build(["<< /Type /Catalog >>", "<< /Filter /Other /V 5 /R 6 >>"], 1, "/Encrypt 2 0 R")), "x"))
    files = spark.createDataFrame(rows, "doc_id long, content binary, password string").cache()
    status = {r.doc_id: r.status for r in pdf.encryption(files, pdf.objects(files)).collect()}
    want = {0: ["ok", "bad_password", "ok", "bad_password", "ok"], 1: ["need_password", "ok", "ok", "bad_password", "bad_password"]}
    assert status == {10 * i + j: want[i % 2][j] for i in range(4) for j in range(5)} | {99: "malformed", 98: "unsupported"}
    objs = pdf.objects(files, "unused", decrypting=True).cache()
    ok = {d for d, s in status.items() if s == "ok"} - {0, 20}  # files without a password of their own are tried with the one given
    assert {r.doc_id: bytes(r.stream) for r in objs.where("num = 4").collect()} == {d: TEXT for d in ok}
    info = {r.doc_id: r.dict for r in objs.where("num = 7").collect()}
    assert info == {d: "<< /Title <536563726574> /Keys [<> <496E>] >>" for d in ok}


def test_crypt_filters_tell_streams_and_strings_apart(spark):
    from pyspark.sql import functions as F

    from foliospark.sources import security as sec

    said = {
        "/V 2": ("rc4", "rc4"), "/V 4": ("rc4", "rc4"), "/V 5 /StmF /Identity": ("aes256", "aes256"), "/V 4 /CF << >> /StrF /No": ("none", "rc4"),
        "/V 4 /CF << /A << /CFM /AESV2 >> /B << /CFM /AESV3 >> >> /StmF /A /StrF /B": ("aes", "aes256"), "/V 4 /CF << /A << >> /B << /CFM /Identity >> >> /StmF /A /StrF /B": ("rc4", "none"),
    }
    from foliospark.sources import syntax as sx

    e = sx.entries(F.concat(F.lit("<< "), "s", F.lit(" >>")))
    df = spark.createDataFrame([(s,) for s in said], "s string").select("s", sec.crypt_filter(e, "StmF").alias("a"), sec.crypt_filter(e, "StrF").alias("b"))
    assert {r.s: (r.a, r.b) for r in df.collect()} == said
    plain = {"/Filter /Crypt": True, "/Filter [/FlateDecode /Crypt] /DecodeParms [null << /Name /Identity >>]": True, "/Filter /Crypt /DecodeParms << /Name /StdCF >>": False, "/Filter /FlateDecode": False, "/A 1": False}
    df = spark.createDataFrame([(s,) for s in plain], "s string").select("s", pdf._left_plain(e).alias("a"))
    assert {r.s: r.a for r in df.collect()} == plain


def test_strings_of_locked_dictionaries(spark):
    from pyspark.sql import functions as F

    from foliospark.sources import security as sec

    key = bytes(range(16))
    text = "<< /A (a\\)b (c) d) % (no\n /B [<6162> () << /C 1 >>] /D 1 ( >>"
    zero = F.lit(0).cast("long")
    plain = spark.range(1).select(sec.decrypt_strings(F.lit(text), F.lit(bytearray(key)), zero, zero, F.lit("rc4")).alias("x")).first().x
    import hashlib

    own = hashlib.md5(key + bytes(5)).digest()
    assert plain == f"<< /A <{sec.rc4(own, b'a)b (c) d').hex().upper()}> % (no\n /B [<{sec.rc4(own, b'ab').hex().upper()}> <> << /C 1 >>] /D 1 ( >>"
    left = spark.range(1).select(sec.decrypt_strings(F.lit(text), F.lit(bytearray(key)), zero, zero, F.lit("none")).alias("x")).first().x
    assert left == text


def test_nesting_comments_and_updates(load):
    page = one_page(b"% a note (no) Tj\nBT /F1 9 Tf (ok) Tj ET").replace(b"<< /Type /Page /Parent", b"<< /Group << /Type /Group /Contents 9 0 R >> % /Type /Nothing\n/Type /Page /Parent")
    partial = b"<< /Type /Font /ToUnicode 6 0 R /Encoding << /Differences [66 /Omega /bullet] >> >>"
    fonts = one_page(b"BT /F1 9 Tf (ABC) Tj ET", more=(stream(b"beginbfchar <41> <0058> endbfchar"),)).replace(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", partial)
    tricky = one_page(b"BT /F1 9 Tf (endobj endstream x) Tj ET")
    two = b"<< /V 1 >>"
    packed = lambda n, v: b"%d 0 obj\n<< /Type /ObjStm /N 1 /First 4 /Length 14 >>\nstream\n9 0 << /V %d >>\nendstream\nendobj\n" % (n, v)
    body = b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog >>\nendobj\n9 0 obj\n" + two + b"\nendobj\n" + packed(20, 2) + packed(19, 3)
    update = body + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % len(body)
    files = load(page, fonts, tricky, update, locked(b"", b"own", 3), locked(b"pw", b"own", 3))
    assert texts(files) == {(0, 1): "ok", (1, 1): "XΩ•", (2, 1): "endobj endstream x", (4, 1): "\nHello"}
    nine = pdf.objects(files).where("doc_id = 3 and num = 9").first()
    assert nine.dict.strip() == "<< /V 3 >>"


def test_staging_needs_a_shared_folder():
    from foliospark import storage

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Cluster())


def test_staged_tables_go_when_replaced(spark):
    import os

    from foliospark import storage

    one = storage.staged(spark.range(3), "one")
    place = one._folio_path.removeprefix("file://")
    assert os.path.isdir(place)
    two = storage.staged(one.selectExpr("id + 1 AS id"), "two", [one])
    assert not os.path.isdir(place) and two.count() == 3
    storage.discard(two, spark.range(1))


FONT = "<< /Subtype /Type1 /Encoding << /Differences [65 /bullet] >> >>"


def test_fonts_are_what_resources_name(load):
    shown = b"BT (0) Tj /F1 9 Tf (A) Tj /F2 9 Tf (B) Tj ET"
    inline = one_page(shown).replace(b"/F1 5 0 R", f"/F1 {FONT}".encode())
    untyped = one_page(shown).replace(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", FONT.encode())
    assert texts(load(inline, untyped)) == {(0, 1): "•", (1, 1): "•"}


def test_values_of_encodings():
    from foliospark.functions.encodings import NAMES, TABLES

    assert (TABLES["MacRomanEncoding"][0xDB], TABLES["MacRomanEncoding"][0xCA], NAMES["Delta"], NAMES["Omega"], NAMES["space"]) == ("¤", " ", "∆", "Ω", " ")


def test_streams_are_as_long_as_they_say(load):
    inner = b"% endstream endobj 4 0 obj\n<< /Length 0 >>\nstream\n\nendstream\nendobj\nBT /F1 9 Tf (B) Tj ET"
    assert texts(load(one_page(b"BT /F1 9 Tf (A) Tj ET " + inner))) == {(0, 1): "AB"}
    assert texts(load(one_page(b"BT /F1 9 Tf (A) Tj ET", more=(stream(one_page(b"BT (inner) Tj ET")),)))) == {(0, 1): "A"}


def appended(data: bytes, body: bytes, entries: str, trailer: str, prev: bytes | None = None) -> bytes:
    """data with one more object and a section whose entries may use {at} for its place."""
    at = len(data) + 1
    start = data.rpartition(b"startxref\n")[2].split()[0] if prev is None else prev
    out = data + b"\n" + body + b"\n"
    return out + f"xref\n{entries.format(at=f'{at:010d}')}trailer\n<< {trailer} {'/Prev ' + start.decode() if start else ''} >>\nstartxref\n{len(out)}\n%%EOF".encode()


def show(num: int, text: str) -> bytes:
    return f"{num} 0 obj\n".encode() + stream(f"BT /F1 9 Tf ({text}) Tj ET".encode()) + b"\nendobj"


def test_sections_name_objects(load):
    first = one_page(b"BT /F1 9 Tf (first) Tj ET")
    orphan = first.replace(b"xref\n0", show(4, "orphan") + b"\nxref\n0", 1)
    orphan = orphan[: orphan.rindex(b"startxref")] + f"startxref\n{orphan.index(b'xref' + chr(10).encode() + b'0')}\n%%EOF".encode()
    update = appended(first, show(4, "second"), "4 1\n{at} 00000 n \n", "/Root 1 0 R")
    lost = appended(first, show(4, "unnamed"), "9 1\n{at} 00001 f \n", "/Root 1 0 R")
    freed = appended(first, b"", "4 1\n0000000000 00001 f \n", "/Root 1 0 R")
    loop = appended(first, show(4, "looped"), "4 1\n{at} 00000 n \n", "/Root 1 0 R /XRefStm 3")
    loop = loop.replace(b"/Size 6 /Root 1 0 R  >>", b"/Size 6 /Root 1 0 R /Prev %d >>" % loop.rindex(b"xref\n4"), 1)
    gone = appended(first, show(4, "newest"), "4 1\n{at} 00000 n \n", "/Root 1 0 R", prev=b"7")
    shifted = update.replace(b"%PDF", b"junk\n%PDF", 1)
    wrong = first.replace(b"00000 n", b"00000 n", 1).replace(f"{first.index(b'4 0 obj'):010d}".encode(), b"0000000003")
    files = load(orphan, update, lost, freed, loop, gone, shifted, wrong)
    # without its chain (gone) the newest section does not lead to the catalog: definitions count by place
    assert texts(files) == {(0, 1): "first", (1, 1): "second", (2, 1): "first", (3, 1): "", (4, 1): "looped", (5, 1): "newest", (6, 1): "second", (7, 1): "first"}


def test_streams_of_hybrid_files_fill_free_entries(load):
    data = one_page(b"BT /F1 9 Tf (x) Tj ET").replace(b"4 0 obj", b"6 0 obj", 1).replace(b"/Contents 4 0 R", b"/Contents 6 0 R", 1)
    place = data.index(b"6 0 obj")
    table = data.index(b"xref\n0")
    packed = b"7 0 obj\n" + stream(b"8 0 << /Producer (packed) >>", "/Type /ObjStm /N 1 /First 4") + b"\nendobj\n"
    rows = [(6, 1, place), (7, 1, table), (8, 2, 7), (9, 0, 0)]
    xref = b"10 0 obj\n" + stream(b"".join(bytes([kind]) + value.to_bytes(3, "big") + b"\0" for _, kind, value in rows), "/Type /XRef /W [1 3 1] /Index [6 4] /Size 11") + b"\nendobj\n"
    body = data[:table] + packed + xref
    offsets = {n: data.index(f"{n} 0 obj".encode()) for n in (1, 2, 3, 5)}
    lines = "".join(f"{offsets[n]:010d} 00000 n \n" if n in offsets else "0000000000 65535 f \n" for n in range(9))
    whole = body + f"xref\n0 9\n{lines}trailer\n<< /Root 1 0 R /Info 8 0 R /XRefStm {table + len(packed)} >>\nstartxref\n{len(body)}\n%%EOF".encode()
    files = load(whole)
    assert texts(files) == {(0, 1): "x"}
    assert [r.producer for r in pdf.metadata(files, pdf.objects(files).cache()).collect()] == ["packed"]


def test_codes_of_varying_length(load):
    cmap = b"2 begincodespacerange <00> <7F> <8140> <9FFC> endcodespacerange 1 begincidrange <8140> <9FFC> 500 endcidrange 1 begincidchar <41> 9 endcidchar"
    to_text = b"1 beginbfrange <20> <7E> <0020> <8140> <81FF> <3041> endbfrange"
    font = b"<< /Subtype /Type0 /Encoding 6 0 R /ToUnicode 7 0 R >>"
    body = one_page(b"BT /F1 9 Tf <41814242814181> Tj ET", more=(stream(cmap), stream(to_text))).replace(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", font)
    files = load(body)
    o = pdf.objects(files).cache()
    units = pdf.contents(pdf.pages(o), o)
    ops, fonts = pdf.operations(units), pdf.fonts(units, o).cache()
    assert [r.text for r in pdf.page_text(ops, fonts).collect()] == ["AぃBあ"]  # the last byte begins no code and has no text
    assert [(r.code, r.cid) for r in pdf.shown_codes(ops, fonts).orderBy("place").collect()] == [(0x41, 9), (0x8142, 502), (0x42, 0x42), (0x8141, 501), (0x81, 0x81)]


def test_long_texts_do_not_search_long_maps_for_each_character(spark):
    from time import monotonic

    pairs = " ".join(f"<{i:04X}> <{i + 1:04X}>" for i in range(2000))
    d = spark.createDataFrame([("\x00A\x07\xcf" * 100_000, f"beginbfchar {pairs} endbfchar")], "raw string, cmap string")
    d = d.select("raw", pdf.unicode_ranges(F.col("cmap")).alias("ranges"), F.lit(None).cast("array<struct<code:int,text:string>>").alias("differences")).localCheckpoint()
    begin = monotonic()
    (row,) = d.select(pdf.shown(F.col("raw"), F.lit(True), F.col("ranges"), F.col("differences"), F.lit("WinAnsiEncoding"), F.lit(r"[\s\S]{2}")).alias("text")).collect()
    assert row.text == "Bߐ" * 100_000 and monotonic() - begin < 6


@pytest.mark.parametrize(("encode", "decode", "seconds"), [
    (codecs.ascii85_encode, codecs.ascii85, 0.7), (lambda d: codecs.png_encode(d, 64), lambda d: codecs.png_predictor(d, 64)[:1_600_000], 1.6), (codecs.lzw_encode, codecs.lzw, None),
])
def test_filters_read_long_data_back_in_time(encode, decode, seconds):
    from time import monotonic

    data = b"".join(b"%07d " % (i * i) for i in range(200_000))[:1_600_000]
    begin = monotonic()
    assert decode(encode(data)) == data
    assert seconds is None or monotonic() - begin < seconds


def test_filters_at_their_edges():
    assert codecs.ascii85(b"zab z~") == bytes(4) + codecs.ascii85(b"ab") and codecs.ascii85(b"!!z!!!") == bytes(4) and codecs.ascii85(b"a") == codecs.ascii85(b"") == b""
    for data in (b"", b"a", bytes(9), bytes(range(256)) * 40, b"ab" * 30_000):
        assert codecs.ascii85(codecs.ascii85_encode(data)) == data and codecs.ascii85_encode(data) == base64.a85encode(data) + b"~>"
        for early in (0, 1):
            assert codecs.lzw(codecs.lzw_encode(data, early), early) == data
            assert data.startswith(codecs.lzw(codecs.lzw_encode(data, early)[:-2], early))


def test_lists_of_any_length_have_ranks(spark):
    """Longer than 16,384, which 14 doublings reach; a circle has no first node, so no rows."""
    n = 17_000
    nodes = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), "id", F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next"))
    circle = spark.range(3).select(F.lit(2).cast("long").alias("doc_id"), "id", ((F.col("id") + 1) % 3).alias("next"))
    ranks = pdf.sibling_ranks(nodes.unionByName(circle).withColumnRenamed("id", "num"))
    assert ranks.count() == n and ranks.where("doc_id = 1 and rank = num and head = 0").count() == n


def test_trees_of_any_depth_are_descended(spark):
    """34 levels, the last of which points back at the second."""
    rows = [(1, i, [("Kids", f"[{i + 1 if i < 34 else 2} 0 R]")]) for i in range(1, 35)]
    objs = spark.createDataFrame(rows, "doc_id long, num long, entries array<struct<k:string,v:string>>").cache()
    assert pdf.descend(objs, objs.where("num = 1")).count() == 34


def test_rc4_side_by_side():
    """Many rows at once give what one by one does, also over turns and beside rows of other lengths."""
    from random import Random

    from foliospark.sources import security as sec

    r = Random(3)
    keys = [r.randbytes(r.choice([5, 16])) for _ in range(200)]
    data = [r.randbytes(r.choice([0, 32, 32, 300, r.randint(1, 9)])) for _ in keys]
    assert sec.rc4_all(keys, data) == [sec.rc4(k, d) for k, d in zip(keys, data)]
    twice = [sec.rc4(bytes(x ^ 7 for x in k), sec.rc4(bytes(x ^ 3 for x in k), d)) for k, d in zip(keys, data)]
    assert sec.rc4_all(keys, data, (3, 7)) == twice


def test_keys_of_files_are_found_once(spark, sf_dir, monkeypatch):
    """A hash of revision 6 costs milliseconds: a file's key is derived in one step, by three hashes at most, and that step is spread over the cores."""
    from foliospark.plans import pdf_locked

    found, derive = [], pdf.file_keys
    monkeypatch.setattr(pdf, "file_keys", lambda dicts: found.append(derive(dicts)) or found[-1])
    pdf_locked.pdf_encrypted(spark, sf_dir)
    assert len(found) == 1
    plan = found[0]._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("aggregate(sequence(") + plan.count("aggregate([0,1,") <= 3


def test_text_leaves_only_the_tables_that_it_reads(spark, load):
    """Items, objects and contents go before the text is put together: their streams, decoded and not, take most of the disk."""
    import os
    import re

    from foliospark.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    text = pdf.extract_text(load(one_page(TEXT, flate=True)))
    left = {re.sub(r"-[0-9a-f]{32}$", "", name) for name in set(os.listdir(folder)) - before if os.listdir(f"{folder}/{name}")}
    assert left == {"pdf-pages", "pdf-fonts", "pdf-operations"}
    assert text.first().text.strip() == "Hello"
