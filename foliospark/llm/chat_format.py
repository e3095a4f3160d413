"""Chat formatting with DataFrame expressions: turns are collected, sorted, runs of one role merged, and concatenated.

<|im_start|>role<|im_msg|>text<|im_next|>text of the same role<|im_end|> ... A backslash breaks every control string inside
roles and texts behind its first character, and backslashes are doubled, so taking away one backslash before any
character gives back the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import hex_sha256, read

START, MESSAGE, NEXT, END = "<|im_start|>", "<|im_msg|>", "<|im_next|>", "<|im_end|>"
#: Strings that never stand unbroken inside a text; the template's own, and those of another common template.
CONTROLS = (START, MESSAGE, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation; loss_spans has (start, length) in code points of each text of loss_role.

    Turns are ordered by turn, then role, then text, so ties and repeated rows have one order; all are kept. A null turn comes
    first, null roles and texts are empty. A row without conv_id is a conversation of its own. Other columns are not read.
    A conversation is one value and has to fit in a row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    talks = conversations.select("conv_id", alone.alias("alone"), turn.alias("turn")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    opens = F.filter(places, lambda i: (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != F.get(F.col("turns"), i)["role"]))
    talks = talks.withColumn("opens", opens)

    def run(start: Column, k: Column) -> Column:
        length = F.coalesce(F.get(F.col("opens"), k + 1), F.size("turns")) - start
        texts = F.transform(F.slice(F.col("turns"), start + 1, length), lambda t: escape(t["text"]))
        return F.struct(F.get(F.col("turns"), start)["role"].alias("role"), texts.alias("texts"))

    # a row per text, so that places are a running sum and no array grows step by step
    key = ["conv_id", "alone"]
    talks = talks.select(*key, F.posexplode(F.transform("opens", run)).alias("at", "run"))
    talks = talks.select(*key, "at", "run.role", F.size("run.texts").alias("n"), F.posexplode("run.texts").alias("j", "t"))
    before = F.when(F.col("j") == 0, F.concat(F.lit(START), escape(F.col("role")), F.lit(MESSAGE))).otherwise(NEXT)
    talks = talks.withColumn("before", before).withColumn("piece", F.concat("before", "t", F.when(F.col("j") == F.col("n") - 1, END).otherwise("")))
    till = F.sum(F.length("piece").cast("long")).over(Window.partitionBy(*key).orderBy("at", "j"))
    span = F.struct((till - F.length("piece") + F.length("before")).alias("start"), F.length("t").cast("long").alias("length"))
    talks = talks.withColumn("span", F.when(F.col("role") == loss_role, span))
    whole = talks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "j", "piece", "span"))).alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    runs = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda r: r != "")

    def turns(run: Column) -> Column:
        parts = F.split(F.substring(run, len(START) + 1, 2**31 - 1), r"\Q" + MESSAGE + r"\E", -1)
        return F.transform(F.split(F.get(parts, F.lit(1)), r"\Q" + NEXT + r"\E", -1), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = format_chats(talks.unionAll(extra)).withColumn("turns", read_back(F.col("formatted")))
    lost = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", lost)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), hex_sha256(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        hex_sha256(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    out = f"replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), u AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_sql_escape('text')}) + CASE WHEN opens THEN length({_sql_escape('role')}) + {len(START + MESSAGE + END)} ELSE {len(NEXT)} END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
