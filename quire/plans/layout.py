"""Registered queries over page geometry, with SQL where SQL can say it.

The store has no boxes, so they are made from ids of the review table by a rule both engines compute.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import layout, lines, store
from quire.session import table

PAGE = ["job_id", "page"]


def _boxes(spark, folder):
    """unit_id with a box on a page of 595 x 842 points, a size and a text."""
    rows = store.records(table(spark, folder, "overlay_review").select("entry_id", "job_id", "page", "source_text", "scale", "reason", "loaded_at"), "entry_id", "loaded_at").where("page is not null and job_id is not null")
    e = F.col("entry_id")
    rows = rows.select(
        "job_id", F.floor(F.col("page") / 20).cast("int").alias("page"), e.alias("unit"), ((e * 37) % 500).cast("double").alias("x0"), ((e * 53) % 800).cast("double").alias("y0"),
        ((e * 37) % 500 + 20 + e % 70).cast("double").alias("x1"), ((e * 53) % 800 + 8 + e % 9).cast("double").alias("y1"),
        (8 + e % 5).cast("double").alias("size"), F.col("source_text").alias("text"), F.col("scale"), "reason",
    )
    return rows.withColumn("dir", F.lit(0))


def _regions(spark, folder):
    return _boxes(spark, folder).select(*PAGE, F.col("unit").alias("region"), (F.col("x0") - 60).alias("x0"), (F.col("y0") - 40).alias("y0"), (F.col("x1") + 60).alias("x1"), (F.col("y1") + 40).alias("y1"))


def _algebra(spark, folder):
    b = _boxes(spark, folder)
    a, page = F.struct("x0", "y0", "x1", "y1"), G.box(F.lit(100), F.lit(100), F.lit(300), F.lit(400))
    return b.select(
        "unit", G.area(a).alias("area"), G.overlap_area(a, page).alias("shared"), G.contains(page, a).alias("inside"), G.gap(a, page).alias("gap"),
        G.union(a, page).x1.alias("union_x1"), G.expand(a, 2.0).x0.alias("wide_x0"), G.in_band(a, F.lit(842.0)).alias("band"),
        G.fit_within(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(50.0), F.lit(12.0)).width.alias("fit"),
    )


def _clusters(spark, folder):
    return layout.clusters(_boxes(spark, folder), PAGE, "unit", 12.0)


def _kinds(spark, folder):
    b = _boxes(spark, folder)
    kind = layout.unit_kind(
        F.col("text"), F.struct("x0", "y0", "x1", "y1"), F.lit(842.0), F.col("size"), F.col("unit") % 4 == 0, F.lit(10.0), F.col("unit") % 3 == 0,
        F.col("reason") == "over_image", F.lit(False), F.lit(True),
    )
    return b.select("unit", kind.alias("kind")).withColumn("keep_reason", layout.keep_reason(F.col("kind"), F.lit("a"))).where("kind is not null")


def _figures(spark, folder):
    b = _boxes(spark, folder).withColumnRenamed("unit", "image_id").withColumn("kind", F.when(F.col("image_id") % 3 == 0, "raster").otherwise("vector"))
    return layout.figure_totals(b.withColumn("page", (F.col("image_id") % 5).cast("int")).withColumn("labels", F.col("image_id") % 7), "job_id")


def _blocks(spark, folder):
    return _boxes(spark, folder).withColumn("text", F.when(F.col("unit") % 3 == 0, F.lit("Figure 1 shows")).otherwise(F.col("text"))).withColumnRenamed("unit", "block")


def _row_checks(spark, folder):
    rows = layout.text_rows(_boxes(spark, folder), PAGE, "unit")
    return rows.groupBy(*PAGE).agg(F.max("row").alias("rows"), F.count("*").alias("lines"))


def _overlaps(spark, folder, separated=True):
    """Painted boxes that overlap; once they are separated none may."""
    moved = _boxes(spark, folder)
    if separated:
        moved = layout.separate(moved.withColumn("painted", F.lit(True)), PAGE, "unit", "painted").where("not dropped")
    a, b = moved.alias("a"), moved.alias("b")
    both = a.join(b, [F.col("a.job_id") == F.col("b.job_id"), F.col("a.page") == F.col("b.page"), F.col("a.unit") < F.col("b.unit")])
    box = lambda t: F.struct(*[F.col(f"{t}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return both.where(G.overlap_area(box("a"), box("b")) > 1e-6).select(F.col("a.unit").alias("unit"), F.col("b.unit").alias("other"))


QUERIES = {
    "box_algebra": _algebra,
    "box_clusters": _clusters,
    "cluster_boxes": lambda s, d: layout.cluster_boxes(_boxes(s, d), _clusters(s, d), PAGE, "unit").drop("page"),
    "smallest_container": lambda s, d: layout.container(_boxes(s, d), _regions(s, d), PAGE, "unit", "region").select("unit", "region"),
    "figure_captions": lambda s, d: layout.captions(_boxes(s, d), _blocks(s, d), PAGE, "unit", "block", 30.0).select("unit", "block", "position"),
    "unit_kinds": _kinds,
    "figure_totals": _figures,
    "line_groups": lambda s, d: layout.group_lines(_boxes(s, d), PAGE, "unit").groupBy(*PAGE).agg(F.countDistinct("grp").alias("groups"), F.count("*").alias("lines")),
    "text_rows": _row_checks,
    "overlaps_left": _overlaps,
    "overlaps_before": lambda s, d: _overlaps(s, d, separated=False),
    "shared_scales": lambda s, d: layout.shared_scales(_boxes(s, d).withColumn("natural", F.col("scale")), ["size"], "unit", 0.6).select("unit", "scale"),
    "heading_tiers": lambda s, d: lines.heading_tiers(_boxes(s, d), "job_id", "size"),
    "dominant_sizes": lambda s, d: lines.dominant_size(_boxes(s, d).withColumn("chars", F.length("text")), ["job_id"], "size", "chars"),
}

_B = """WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC NULLS LAST) AS k FROM overlay_review WHERE entry_id IS NOT NULL) WHERE k = 1 AND page IS NOT NULL AND job_id IS NOT NULL),
b AS (SELECT job_id, (page // 20)::INT AS page, entry_id AS unit, (entry_id * 37 % 500)::DOUBLE AS x0, (entry_id * 53 % 800)::DOUBLE AS y0, (entry_id * 37 % 500 + 20 + entry_id % 70)::DOUBLE AS x1,
 (entry_id * 53 % 800 + 8 + entry_id % 9)::DOUBLE AS y1, (8 + entry_id % 5)::DOUBLE AS size, source_text AS text, scale, reason FROM e)"""
_GAP = "greatest(0, greatest(a.x0, c.x0) - least(a.x1, c.x1), greatest(a.y0, c.y0) - least(a.y1, c.y1))"
_CLUSTERS = _B.replace("WITH e", "WITH RECURSIVE e") + f""", links AS (SELECT a.unit AS f, c.unit AS t FROM b a JOIN b c ON a.job_id = c.job_id AND a.page = c.page AND {_GAP} <= 12),
reach(f, t) AS (SELECT f, t FROM links UNION SELECT reach.f, links.t FROM reach JOIN links ON reach.t = links.f),
c AS (SELECT job_id, page, unit, (SELECT min(t) FROM reach WHERE f = b.unit) AS cluster FROM b)"""

def _shared_sql(threshold: float, passes: int) -> str:
    """Passes over the pending units of a size; a unit is done with a scale, done with its own, or pending again."""
    steps = [_B + ", p0 AS (SELECT unit, size, scale AS v FROM b WHERE scale IS NOT NULL)"]
    for k in range(passes):
        steps.append(f"""m{k} AS (SELECT size, count(*) AS n, list_sort(list(v)) AS l FROM p{k} GROUP BY size HAVING count(*) >= 2),
e{k} AS (SELECT p.*, greatest({threshold}, (l[(n + 1) // 2] + l[n // 2 + 1]) / 2 - 0.10) AS bound FROM p{k} p JOIN m{k} USING (size)),
f{k} AS (SELECT *, count(*) OVER w AS ne, min(v) OVER w AS s FROM e{k} WHERE v >= bound WINDOW w AS (PARTITION BY size)),
g{k} AS (SELECT *, v <= s / (1.0 - 0.10) AS capped, CASE WHEN s * 0.99 < {threshold} AND {threshold} <= s THEN {threshold} ELSE s * 0.99 END AS x FROM f{k}),
h{k} AS (SELECT *, count_if(capped) OVER w AS nc, capped AND x >= v * (1.0 - 0.10) AS fits, count_if(capped AND x >= v * (1.0 - 0.10)) OVER w AS nf FROM g{k} WINDOW w AS (PARTITION BY size)),
d{k} AS (SELECT unit, CASE WHEN ne >= 2 AND s < 1 AND nc >= 2 AND nf >= 2 THEN x END AS x FROM h{k} WHERE CASE WHEN ne < 2 OR s >= 1 THEN true WHEN nc < 2 THEN capped ELSE fits END),
p{k + 1} AS (SELECT unit, size, v FROM p{k} ANTI JOIN d{k} USING (unit))""")
    done = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(passes))
    return ", ".join(steps) + f", done AS ({done}) SELECT b.unit, coalesce(done.x, b.scale) AS scale FROM b LEFT JOIN done USING (unit)"


SQL = {
    "box_algebra": _B + """ SELECT unit, (x1 - x0) * (y1 - y0) AS area, greatest(least(x1, 300) - greatest(x0, 100), 0) * greatest(least(y1, 400) - greatest(y0, 100), 0) AS shared,
 x0 >= 100 AND y0 >= 100 AND x1 <= 300 AND y1 <= 400 AS inside, greatest(0, greatest(x0, 100) - least(x1, 300), greatest(y0, 100) - least(y1, 400)) AS gap, greatest(x1, 300) AS union_x1, x0 - 2 AS wide_x0,
 y1 <= 842 * 0.12 OR y0 >= 842 - 842 * 0.12 AS band, (x1 - x0) * least(1, 50 / (x1 - x0), 12 / (y1 - y0)) AS fit FROM b""",
    "box_clusters": _CLUSTERS + " SELECT job_id, page, unit, cluster FROM c",
    "cluster_boxes": _CLUSTERS + " SELECT b.job_id, cluster, count(*) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b JOIN c USING (job_id, page, unit) GROUP BY b.job_id, b.page, cluster",
    "smallest_container": _B + """, h AS (SELECT a.unit, c.unit AS region, (c.x1 - c.x0 + 120) * (c.y1 - c.y0 + 80) AS area FROM b a JOIN b c ON a.job_id = c.job_id AND a.page = c.page
 AND a.x0 >= c.x0 - 61 AND a.y0 >= c.y0 - 41 AND a.x1 <= c.x1 + 61 AND a.y1 <= c.y1 + 41) SELECT unit, region FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY area, region) AS k FROM h) WHERE k = 1""",
    "figure_captions": _B + """, h AS (SELECT a.unit, c.unit AS block, c.y0 - a.y1 AS below, a.y0 - c.y1 AS above FROM b a JOIN b c ON a.job_id = c.job_id AND a.page = c.page AND (c.unit % 3 = 0 OR regexp_matches(trim(c.text), '^(Figure|Fig\\.|Table|Illustration|Plate|Listing)\\s*[\\dA-Z]'))),
 r AS (SELECT *, below BETWEEN -1 AND 30 AS isb FROM h WHERE below BETWEEN -1 AND 30 OR above BETWEEN -1 AND 30)
 SELECT unit, block, CASE WHEN isb THEN 'below' ELSE 'above' END AS position FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY NOT isb, CASE WHEN isb THEN below ELSE above END, block) AS k FROM r) WHERE k = 1""",
    "figure_totals": _B + """, f AS (SELECT job_id, unit, unit % 5 AS page, unit % 7 AS labels, unit % 3 = 0 AS raster FROM b)
 SELECT job_id, count(*) AS figures, count_if(NOT raster) AS vector, count_if(raster) AS raster, CAST(sum(labels) AS BIGINT) AS labels, count(DISTINCT page) AS pages, arg_max(unit, (labels, -unit)) AS most_labels FROM f GROUP BY job_id""",
    "overlaps_before": _B + """ SELECT a.unit, c.unit AS other FROM b a JOIN b c ON a.job_id = c.job_id AND a.page = c.page AND a.unit < c.unit
 WHERE greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) > 1e-6""",
    "overlaps_left": "SELECT entry_id AS unit, entry_id AS other FROM overlay_review WHERE false",
    "shared_scales": _shared_sql(0.6, 16),
    "heading_tiers": _B + " SELECT DISTINCT job_id, round_even(size * 2, 0) / 2 AS size, least(dense_rank() OVER (PARTITION BY job_id ORDER BY round_even(size * 2, 0) DESC), 3)::INT AS level FROM b",
    "dominant_sizes": _B + ", w AS (SELECT job_id, size, sum(length(text)) AS n FROM b WHERE length(text) > 0 GROUP BY ALL) SELECT job_id, arg_max(size, (n, size)) AS size FROM w GROUP BY job_id",
}
