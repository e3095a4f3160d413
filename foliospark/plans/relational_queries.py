"""Queries over the relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import relational as rel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def xref_newest(spark, sf_dir):
    """Newest definition of each object: the last event of a user."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    return rel.newest_wins(ev, ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")


def trailer_merge(spark, sf_dir):
    """Each key of a trailer from the newest section that has it."""
    ev = table(spark, sf_dir, "events")
    wide = ev.select("user_id", "event_id", *(F.when(F.col("event_type") == k, F.round("value", 4)).alias(k) for k in ("click", "purchase", "view")))
    return rel.merge_newest(wide, ["user_id"], ["click", "purchase", "view"], F.col("event_id"))


def object_fetch(spark, sf_dir):
    """References resolved to objects; those that point at nothing stay with nulls."""
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_refs"))
    objects = table(spark, sf_dir, "orders").where("o_orderstatus != 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    return rel.fetch(refs, objects, ["l_orderkey"])


def page_labels(spark, sf_dir):
    """Labels of pages (an order is a page of its customer's file) from ranges that begin at every seventh page."""
    pages = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    pages = pages.withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    ranges = pages.where("page % 7 = 0").select("o_custkey", F.col("page").alias("range_start"), F.element_at(F.array(*map(F.lit, "DrRaA")), (F.col("page") / 7).cast("int") % 5 + 1).alias("style"))
    out = rel.asof(pages, ranges, ["o_custkey"], "page", "range_start", ["style"])
    n = (F.col("page") - F.col("range_start") + 1).cast("int")
    return out.select("o_custkey", "page", tx.page_label(F.col("style"), F.lit("p-"), n).alias("label"))


def ocg_hidden(spark, sf_dir):
    """Customers hidden since all their orders are switched off, with what stays visible counted."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    off = orders.where("o_orderstatus = 'F'").select("o_orderkey")
    hidden = rel.hidden_groups(orders, off, "o_custkey", "o_orderkey")
    shown = orders.join(hidden, "o_custkey", "left_anti")
    return shown.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))


def mc_depth(spark, sf_dir):
    """Marked-content depth after each operation."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = rel.running_depth(ev, ["user_id"], ["event_id"], F.col("event_type").isin("click", "view"), F.col("event_type") == "purchase")
    return out.select("event_id", F.col("depth").cast("long").alias("depth"))


def name_tree_range(spark, sf_dir):
    """Range lookup: each part finds the range of codes that holds its size; ranges come from a table of ten rows."""
    ranges = spark.range(10).select((F.col("id") * 5 + 1).alias("lo"), (F.col("id") * 5 + 5).alias("hi"), F.concat(F.lit("r"), F.col("id")).alias("dst"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return parts.join(F.broadcast(ranges), (F.col("p_size") >= F.col("lo")) & (F.col("p_size") <= F.col("hi")), "left").select("p_partkey", "dst")


def _nodes(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") * 90).alias("rotate"), F.lit("letter").alias("box"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"), F.lit(None).cast("int").alias("rotate"), F.when(F.col("n_nationkey") % 2 == 0, "a4").alias("box"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(180)).alias("rotate"), F.lit(None).cast("string").alias("box"))
    return region.unionAll(nation).unionAll(supplier)


def tree_flatten(spark, sf_dir):
    """A form's fields with dotted names, from a three-level tree."""
    return rel.flatten_tree(_nodes(spark, sf_dir), ["rotate", "box"]).select("id", "level", "path")


def inherit_attrs(spark, sf_dir):
    """Page attributes from the nearest ancestor that has them; rotation taken into 0..359."""
    out = rel.flatten_tree(_nodes(spark, sf_dir), ["rotate", "box"])
    return out.where("level = 2").select("id", F.pmod("rotate", F.lit(360)).cast("int").alias("rotate"), "box")


def coalesce_islands(spark, sf_dir):
    """Runs of a user's events with gaps of an hour at most, joined."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))
    gap = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    out = rel.islands(ev.withColumn("gap", gap), ["user_id"], ["at", "event_id"], F.col("gap") > 3_600_000_000)
    return out.groupBy("user_id", "island").agg(F.count("*").alias("n_runs"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def coalesce_lines(spark, sf_dir):
    """Text runs laid out from documents' words, joined to lines."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.posexplode(F.split(F.col("text"), r"\s+")).alias("i", "text"))
    runs = words.select("doc_id", F.col("i").alias("ord"), (F.col("i") % 8 * 30.0).alias("x"), (700.0 - F.floor(F.col("i") / 8) * 14).cast("double").alias("baseline"), F.lit(10.0).alias("height"), (F.length("text") * 4.0).alias("width"), "text")
    return rel.coalesce_lines(runs, ["doc_id"]).select("doc_id", "line_no", F.md5("text").alias("line_md5"))


def tile_grid(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").select("n_nationkey")
    return rel.tile_grid(cells, F.col("n_nationkey") % 5 + 1, F.col("n_nationkey") % 7 + 1).select("n_nationkey", F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"))


def gradient_stops(spark, sf_dir):
    shadings = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    out = rel.gradient_stops(shadings, F.col("n_regionkey").cast("double"), F.col("n_nationkey").cast("double"))
    return out.select("n_nationkey", "stop", F.round("t", 6).alias("t"))


def content_concat(spark, sf_dir):
    """A page's content streams in order, each ended by a line end."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "text").alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.concat(F.coalesce(p["text"], F.lit("")), F.lit("\n"))), "")
    return whole.select("conv_id", F.md5(joined).alias("content_md5"), F.length(joined).cast("long").alias("n_chars"))


def op_histogram(spark, sf_dir):
    """Operator mix: counts and the share of pages (users) that use each."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_pages"))


def tiff_predictor(spark, sf_dir):
    """The horizontal predictor undone: running sum modulo 256 along a row of samples."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 37 % 256).alias("delta"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return ev.select("event_id", (F.sum("delta").over(w) % 256).cast("int").alias("sample"))


def rect_bounds(spark, sf_dir):
    """Bounds of the points of each path (an order's lines)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(*(f(c).alias(n) for c, x in (("l_quantity", "x"), ("l_extendedprice", "y")) for f, n in ((F.min, f"min_{x}"), (F.max, f"max_{x}"))))


QUERIES = {
    "xref_newest": xref_newest, "trailer_merge": trailer_merge, "object_fetch": object_fetch, "page_labels": page_labels, "ocg_hidden": ocg_hidden, "mc_depth": mc_depth, "name_tree_range": name_tree_range,
    "tree_flatten": tree_flatten, "inherit_attrs": inherit_attrs, "coalesce_islands": coalesce_islands, "coalesce_lines": coalesce_lines, "tile_grid": tile_grid, "gradient_stops": gradient_stops,
    "content_concat": content_concat, "op_histogram": op_histogram, "tiff_predictor": tiff_predictor, "rect_bounds": rect_bounds,
}

_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name, r_regionkey * 90 AS rotate, 'letter' AS box FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, NULL, CASE WHEN n_nationkey % 2 = 0 THEN 'a4' END FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 180 END, NULL FROM supplier
), tree AS (
  SELECT id, name AS path, 0 AS level, rotate, box FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, t.path || '.' || n.name, t.level + 1, coalesce(n.rotate, t.rotate), coalesce(n.box, t.box) FROM nodes n JOIN tree t ON n.parent = t.id
)"""

SQL = {
    "xref_newest": "SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "trailer_merge": "SELECT user_id, " + ", ".join(f"round(max_by(value, event_id) FILTER (event_type = '{k}' AND value IS NOT NULL), 4) AS {k}" for k in ("click", "purchase", "view")) + " FROM events GROUP BY user_id",
    "object_fetch": "SELECT l_orderkey, n_refs, o_orderstatus, o_orderpriority FROM (SELECT l_orderkey, count(*) AS n_refs FROM lineitem GROUP BY 1) LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus != 'O') ON l_orderkey = o_orderkey",
    "page_labels": """
        WITH pages AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page FROM orders),
        ranges AS (SELECT o_custkey, page AS start, substr('DrRaA', CAST((page // 7) % 5 + 1 AS INT), 1) AS style FROM pages WHERE page % 7 = 0),
        numbered AS (SELECT p.o_custkey, p.page, r.style, CAST(p.page - r.start AS INT) + 1 AS n FROM pages p ASOF JOIN ranges r ON p.o_custkey = r.o_custkey AND p.page >= r.start)
        SELECT o_custkey, CAST(page AS INT) AS page, 'p-' || CASE style WHEN 'D' THEN CAST(n AS VARCHAR) WHEN 'r' THEN ['i','ii','iii','iv','v','vi','vii'][n] WHEN 'R' THEN ['I','II','III','IV','V','VI','VII'][n]
          WHEN 'a' THEN chr(96 + n) ELSE chr(64 + n) END AS label FROM numbered""",
    "ocg_hidden": "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 HAVING NOT bool_and(o_orderstatus = 'F')",
    "mc_depth": "SELECT event_id, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS depth FROM events",
    "name_tree_range": "SELECT p_partkey, dst FROM part LEFT JOIN (SELECT i * 5 + 1 AS lo, i * 5 + 5 AS hi, 'r' || i AS dst FROM range(10) t(i)) ON p_size BETWEEN lo AND hi",
    "tree_flatten": f"WITH RECURSIVE {_NODES} SELECT id, level, path FROM tree",
    "inherit_attrs": f"WITH RECURSIVE {_NODES} SELECT id, CAST(rotate % 360 AS INT) AS rotate, box FROM tree WHERE level = 2",
    "coalesce_islands": """
        WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
        i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
        SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n_runs, min(event_id) AS first_event, max(event_id) AS last_event FROM i GROUP BY 1, 2""",
    "coalesce_lines": r"""
        WITH w AS (SELECT doc_id, unnest(p) AS word, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS p FROM documents)),
        r AS (SELECT *, i % 8 * 30.0 AS x, i // 8 AS line FROM w WHERE word <> ''),
        e AS (SELECT *, lag(x + length(word) * 4.0) OVER v AS fin, lag(i) OVER v AS before FROM r WINDOW v AS (PARTITION BY doc_id, line ORDER BY i)),
        b AS (SELECT *, fin IS NULL OR x < fin - 5.0 AS opens, fin IS NOT NULL AND x - fin > 2.0 AS space FROM e),
        n AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no FROM b)
        SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(string_agg(CASE WHEN space AND NOT opens THEN ' ' ELSE '' END || word, '' ORDER BY i)) AS line_md5 FROM n GROUP BY 1, 2""",
    "tile_grid": "SELECT n_nationkey, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy FROM nation, range(5) x(ix), range(7) y(iy) WHERE ix <= n_nationkey % 5 AND iy <= n_nationkey % 7",
    "gradient_stops": "SELECT n_nationkey, CAST(i AS INT) AS stop, round(n_regionkey + i / 23.0::DOUBLE * (n_nationkey - n_regionkey), 6) AS t FROM nation, range(24) s(i)",
    "content_concat": "SELECT conv_id, md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn, text)) AS content_md5, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id",
    "op_histogram": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_pages FROM events GROUP BY 1",
    "tiff_predictor": "SELECT event_id, CAST(sum(event_id * 37 % 256) OVER (PARTITION BY user_id ORDER BY event_id) % 256 AS INT) AS sample FROM events",
    "rect_bounds": "SELECT l_orderkey, min(l_quantity) AS min_x, max(l_quantity) AS max_x, min(l_extendedprice) AS min_y, max(l_extendedprice) AS max_y FROM lineitem GROUP BY 1",
}
