"""A query over encrypted PDF files that are made from the tables, each with a password of its own, with SQL on those tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.pdf_files import file_of, say, stream_of
from foliospark.plans.relational_queries import table
from foliospark.sources import pdf, syntax
from foliospark.sources import security as sec
from foliospark.storage import relation, spread

col, lit = F.col, F.lit
FILE_ID = b"0123456789abcdef"


def _old_entries(user: Column, owner: Column, revision: Column) -> Column:
    """/O, /U and the key of files of revision 3 or 4."""

    @F.pandas_udf("struct<o:binary,u:binary,key:binary>")
    def run(user: pd.Series, owner: pd.Series, revision: pd.Series) -> pd.DataFrame:
        out = [(None, None, None)] * len(user)
        old = [i for i, r in enumerate(revision) if r <= 4]
        users, owners, revisions = ([s.iloc[i] for i in old] for s in (user, owner, revision))
        padded = [(u.encode() + sec.PAD)[:32] for u in users]
        o = sec.rc4_all([sec.owner_key(w.encode(), r) for w, r in zip(owners, revisions)], padded, range(20))
        keys = [sec.user_key(u.encode(), of, -44, FILE_ID, r, 16, True) for u, of, r in zip(users, o, revisions)]
        for i, *entry in zip(old, o, (c.ljust(32, b"\0") for c in sec.user_checks(keys, [FILE_ID] * len(old), revisions)), keys):
            out[i] = tuple(entry)
        return pd.DataFrame(out, columns=["o", "u", "key"])

    return run(user, owner, revision)


def locked_customers(spark, sf_dir) -> DataFrame:
    """(doc_id, content, password): a file a customer, of revisions 3 to 6 in turn. Every seventh has an empty user password; of five given passwords two are the user's, one is the owner's, one is wrong, one is missing."""
    k, r = col("c_custkey"), (3 + col("c_custkey") % 4).cast("int")
    c = spread(table(spark, sf_dir, "customer"), "c_custkey").withColumn("r", r).withColumn("user", F.when(k % 7 == 0, "").otherwise(say("pä", k))).withColumn("owner", say("own", k))
    c = c.withColumn("old", _old_entries(col("user"), col("owner"), col("r")))
    salt = lambda what: F.substring(F.unhex(F.md5(say(what, k))), lit(1), lit(8))
    new = F.unhex(F.sha2(say("key", k), 256))
    word = lambda w: F.encode(w, "UTF-8")
    check = lambda w, what, more: F.concat(sec.salted_hash(word(w), salt(what), more, col("r")), salt(what), salt(what + "key"))
    wrap = lambda w, what, more: F.substring(sec.sealed(new, sec.salted_hash(word(w), salt(what + "key"), more, col("r")), lit(bytearray(16))), lit(1), lit(32))
    late, none = col("r") >= 5, lit(sec.EMPTY)
    c = c.withColumn("u", F.when(late, check(col("user"), "u", none)).otherwise(col("old.u")))
    c = c.withColumn("o", F.when(late, check(col("owner"), "o", col("u"))).otherwise(col("old.o"))).withColumn("ue", F.when(late, wrap(col("user"), "u", none))).withColumn("oe", F.when(late, wrap(col("owner"), "o", col("u"))))
    c = relation(c.withColumn("key", F.when(late, new).otherwise(col("old.key"))).drop("old"), "pdf-locks")

    def seal(data: Column, num: int) -> Column:
        n, iv = [lit(x).cast("long") for x in (num, 0)], F.unhex(F.md5(say(str(num), k)))
        aes = lambda key: F.aes_encrypt(data, key, lit("CBC"), lit("PKCS"), iv)
        return F.when(late, aes(col("key"))).when(col("r") == 4, aes(sec.object_key(col("key"), *n, True))).otherwise(sec.decrypt(data, col("key"), *n, lit("rc4")))

    hexed = lambda name: say("<", F.hex(col(name)), ">")
    kind = F.when(late, say("/V 5 /OE ", hexed("oe"), " /UE ", hexed("ue"))).when(col("r") == 4, "/V 4 /CF << /A << /CFM /AESV2 >> >> /StmF /A /StrF /A").otherwise("/V 2 /Length 128")
    lock = say("/ID [<", FILE_ID.hex(), "> ()] /Encrypt << /Filter /Standard /P -44 /R ", col("r"), " /O ", hexed("o"), " /U ", hexed("u"), " ", kind, " >>")
    said = lambda text, num: say("<", F.hex(seal(text.cast("binary"), num)), ">")
    bodies = F.array(lit("<< /Type /Catalog >>"), stream_of(F.decode(seal(F.repeat(col("c_mktsegment"), 9).cast("binary"), 2), "ISO-8859-1")), say("<< /Kept [(", "abc", ") << /Title ", said(col("c_name"), 3), " >>] /None () >>"))
    given = F.when(k % 5 == 1, col("owner")).when(k % 5 == 2, "wrong").when(k % 5 != 3, col("user"))
    return c.select(k.alias("doc_id"), file_of(bodies, lock).alias("content"), given.alias("password"))


def pdf_encrypted(spark, sf_dir):
    """What passwords open, and the strings and streams of files that they do."""
    files = relation(locked_customers(spark, sf_dir), "pdf-locked")
    objs, keys = pdf.unlocked(files)
    objs = relation(objs, "pdf-objects")
    e = col("entries")
    keys = keys.select("doc_id", "status", "streams", "strings")
    revision = pdf.trailer(objs).select("doc_id", syntax.as_int(syntax.get(syntax.entries(syntax.get(e, "Encrypt")), "R")).alias("revision"))
    inner = syntax.entries(F.get(syntax.items(syntax.get(e, "Kept")), lit(1)))
    held = objs.groupBy("doc_id").agg(F.max(F.when(col("num") == 3, syntax.as_text(syntax.get(inner, "Title")))).alias("title"), F.max(F.when(col("num") == 2, F.decode("stream", "UTF-8"))).alias("text"))
    out = keys.join(revision, "doc_id").join(held, "doc_id")
    return out.select(col("doc_id").alias("c_custkey"), "revision", "status", "streams", "strings", "title", "text")


QUERIES = {"pdf_encrypted": pdf_encrypted}
SQL = {
    "pdf_encrypted": """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, 3 + c_custkey % 4 AS revision,
          CASE WHEN c_custkey % 5 = 2 THEN 'bad_password' WHEN c_custkey % 5 = 3 AND c_custkey % 7 <> 0 THEN 'need_password' ELSE 'ok' END AS status FROM customer)
        SELECT c_custkey, revision, status, CASE revision WHEN 3 THEN 'rc4' WHEN 4 THEN 'aes' ELSE 'aes256' END AS streams, CASE revision WHEN 3 THEN 'rc4' WHEN 4 THEN 'aes' ELSE 'aes256' END AS strings,
        CASE WHEN status = 'ok' THEN c_name END AS title, CASE WHEN status = 'ok' THEN repeat(c_mktsegment, 9) END AS text FROM c""",
}
