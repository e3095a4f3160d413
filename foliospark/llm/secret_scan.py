"""Secret scans with corpus-wide ownership.

Patterns find candidates; the digest of each candidate value is counted over distinct repositories and owners in the whole
corpus. A value that many owners hold, or that one or two copy over many repositories, is an example; one of a single owner in
few repositories looks live. Besides the three base kinds, which always stay, tokens in common provider formats and long
random-looking tokens are reported as kind "live" with that verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import hex_sha256, read, staged

#: Kind, pattern, pattern of the secret value (its last group), least length of that value.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LIVE = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|[A-Za-z0-9+_-]{32,}"
KINDS = ("assign", "access", "hex", "live")
PATTERNS = (ASSIGN, ACCESS[:-1] + "{14,}", HEX[:-1] + "{16,}", LIVE)  # of runs of a class the longer ones alone match, as AKIA with 14 more


def hits() -> Column:
    """(ord, i, gap, hit) of each pattern's matches in `text`: the i-th match and the length of the stretch before it."""

    def found(kind: int, pattern: str) -> Column:
        each = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.split("text", pattern, -1)
        made = F.transform(each, lambda h, i: F.struct(F.lit(kind).alias("ord"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), h.alias("hit")))
        return F.when(F.regexp_like("text", F.lit(pattern)), made).otherwise(F.array().cast("array<struct<ord:int,i:int,gap:int,hit:string>>"))

    return F.concat(*(found(k, p) for k, p in enumerate(PATTERNS)))


def placed(each: DataFrame) -> DataFrame:
    """Rows (__id, owner, repo, ord, i, gap, hit) with start, end and the digest of the value, without those whose value fails. Places are running sums, which failing matches add to."""
    till = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("__id", "ord").orderBy("i")).cast("int")
    value = F.when(F.col("ord") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    mixed = F.regexp_like("hit", F.lit("[0-9]")) & F.regexp_like("hit", F.lit("[A-Za-z]")) & ~F.regexp_like("hit", F.lit("^[0-9a-f]+$"))
    passes = F.when(F.col("ord") == 0, F.length(value) >= 12).when(F.col("ord") == 3, mixed).otherwise(True)
    out = each.withColumn("end", till).withColumn("start", F.col("end") - F.length("hit")).where(passes)
    return out.select("__id", "owner", "repo", "ord", "start", "end", F.sha2(value, 256).alias("secret"))


def scan_secrets(docs: DataFrame, owner: Column, repo: Column, example_owners: int = 3, example_repos: int = 4) -> DataFrame:
    """docs without text, plus found: spans (start, ord of KINDS, end, owners, repos, verdict), ordered by start, then kind.

    verdict: "example" with example_owners owners or example_repos repositories or more; else "live" with one owner, "shared" with
    more. Spans of kind live are kept only with that verdict and where they lie in no base span. Null and empty texts hold nothing;
    a null owner or repository counts as one of its own. Repeated rows get a row each. Own columns named found are
    replaced. Places are code points.
    """
    kept = [c for c in docs.columns if c not in ("text", "found")]
    texts = docs.select(*kept, owner.alias("__owner"), repo.alias("__repo"), F.coalesce("text", F.lit("")).alias("text"))
    seen = staged(texts.select(*kept, "__owner", "__repo", F.monotonically_increasing_id().alias("__id"), hits().alias("__hits")), "secrets")
    each = seen.select("__id", F.coalesce("__owner", F.lit("\0")).alias("owner"), F.coalesce("__repo", F.lit("\0")).alias("repo"), F.inline("__hits"))
    each = staged(placed(each), "secret-spans")
    counts = each.groupBy(F.col("secret").alias("of")).agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    verdict = F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example").when(F.col("owners") == 1, "live").otherwise("shared")
    judged = each.join(counts, F.col("secret") == F.col("of")).withColumn("verdict", verdict).where((F.col("ord") < 3) | (F.col("verdict") == "live"))
    span = F.struct("start", "ord", "end", "owners", "repos", "verdict")
    per_row = judged.groupBy(F.col("__id").alias("__of")).agg(F.array_sort(F.collect_list(span)).alias("__found"))
    base = F.filter("__found", lambda s: s["ord"] < 3)
    clear = F.filter("__found", lambda s: (s["ord"] < 3) | ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = seen.join(per_row, F.col("__id") == F.col("__of"), "left").withColumn("__base", base)
    none = F.array().cast("array<struct<start:int,ord:int,end:int,owners:bigint,repos:bigint,verdict:string>>")
    return out.select(*kept, F.coalesce(clear, none).alias("found"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = scan_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["ord"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), hex_sha256(listed(F.filter("found", lambda s: s["ord"] < 3))).alias("base_sha256"),
        listed(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"), F.size(F.filter("found", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )


def _sql_matches(ord_: int, kind: str, pattern: str, value: str, passes: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, lang, {ord_} AS ord, '{kind}' AS kind, CAST(till - length(hit) AS BIGINT) AS s, CAST(till AS BIGINT) AS e, {value.format(p=p)} AS v FROM (
    SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS till FROM (
      SELECT doc_id, source, lang, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i
      FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL)))
  WHERE {passes.format(p=p)}"""


OP6_SQL = f"""
WITH m AS (
  {_sql_matches(0, 'assign', ASSIGN, "regexp_extract(hit, '{p}', 2)", "length(regexp_extract(hit, '{p}', 2)) >= 12")}
  UNION ALL {_sql_matches(1, 'access', ACCESS, 'hit', 'length(hit) >= 18')}
  UNION ALL {_sql_matches(2, 'hex', HEX, 'hit', 'length(hit) >= 16')}
  UNION ALL {_sql_matches(3, 'live', LIVE, 'hit', "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_full_match(hit, '[0-9a-f]+')")}
), counted AS (
  SELECT m.*, CASE WHEN owners >= 3 OR repos >= 4 THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict
  FROM m JOIN (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repos FROM m GROUP BY v) USING (v)
), kept AS (
  SELECT * FROM counted c WHERE ord < 3 OR (verdict = 'live' AND NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = c.doc_id AND b.ord < 3 AND b.s < c.e AND c.s < b.e))
), listed AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
         count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
  FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN listed USING (doc_id)
"""
