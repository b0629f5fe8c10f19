"""Tables of annotations, scores, pixels, masks and slides that Spark derives from the given tables.

Each is one statement that Spark and DuckDB read alike, so that both sides of a comparison start from
equal rows. All of them grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import spread

ANNOTATIONS = """
SELECT slide_id, CAST(ROW_NUMBER() OVER (PARTITION BY slide_id ORDER BY k1, k2, k3, k4, w0, xmin, ymin) - 1 AS INT) AS ann_idx,
  CASE WHEN lab = 0 THEN concat('rect ', CAST(k2 % 7 AS VARCHAR(10))) WHEN lab = 1 THEN 'LSIL' WHEN lab = 2 THEN 'HSIL ?'
       WHEN lab = 3 THEN 'Group HSIL' WHEN lab = 4 THEN 'ASCUS' WHEN lab = 5 THEN '?ASCH)' WHEN lab = 6 THEN 'normal'
       ELSE 'Superficial cell?' END AS label,
  xmin, ymin, xmin + CASE WHEN lab = 0 THEN 400 + w0 * 10 ELSE w0 END AS xmax, ymin + CASE WHEN lab = 0 THEN 400 + h0 * 10 ELSE h0 END AS ymax
FROM (SELECT concat('s', CAST(CAST(floor(l_orderkey / 50) AS BIGINT) AS VARCHAR(10))) AS slide_id,
        l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, l_linenumber AS k4, l_partkey % 8 AS lab,
        CAST((l_partkey * 37 + l_suppkey * 11) % 6000 AS INT) AS xmin, CAST((l_orderkey * 53 + l_linenumber * 97) % 6000 AS INT) AS ymin,
        CAST(l_quantity AS INT) * 4 + 20 AS w0, CAST(l_partkey % 50 AS INT) * 4 + 20 AS h0 FROM {lineitem}) t
"""

SCORES = """
SELECT event_id, user_id AS tile_id, CAST(EXTRACT(DAY FROM ts) AS INT) AS epoch,
  CAST(LEAST(value / 500.0, 1.0) AS DOUBLE) AS score, CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS positive FROM {events}
"""

PIXELS_SPARK = """
SELECT vec_id AS tile_id, CAST(k AS INT) AS px, CAST((label + k) % 3 AS INT) AS gt,
  CAST(element_at(embedding, 3 * k + 1) AS DOUBLE) * 8 AS z0, CAST(element_at(embedding, 3 * k + 2) AS DOUBLE) * 8 AS z1,
  CAST(element_at(embedding, 3 * k + 3) AS DOUBLE) * 8 AS z2
FROM {embeddings} LATERAL VIEW explode(sequence(0, 20)) e AS k
"""
PIXELS_DUCK = """
SELECT vec_id AS tile_id, CAST(k AS INT) AS px, CAST((label + k) % 3 AS INT) AS gt,
  CAST(embedding[3*k+1] AS DOUBLE) * 8 AS z0, CAST(embedding[3*k+2] AS DOUBLE) * 8 AS z1, CAST(embedding[3*k+3] AS DOUBLE) * 8 AS z2
FROM embeddings, range(0, 21) r(k)
"""

#: Eight discs for each image of SIDE x SIDE pixels, one for each part.
SIDE = 48
DISCS = """
SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS img_id, p_partkey AS disc, CAST((p_partkey * 29) % 48 AS INT) AS cx, CAST((p_partkey * 47) % 48 AS INT) AS cy,
  CAST(2 + p_size % 7 AS INT) AS r, CAST(1 + p_size % 2 AS INT) AS cls FROM {part}
"""
MASK_DUCK = """
SELECT i.img_id, CAST(a.v AS INT) AS y, CAST(b.v AS INT) AS x,
  CAST(COALESCE(MAX(CASE WHEN (b.v-c.cx)*(b.v-c.cx)+(a.v-c.cy)*(a.v-c.cy) <= c.r*c.r THEN c.cls ELSE 0 END), 0) AS INT) AS cls
FROM (SELECT DISTINCT img_id FROM fx_discs) i CROSS JOIN range(0, 48) a(v) CROSS JOIN range(0, 48) b(v) JOIN fx_discs c ON i.img_id = c.img_id
GROUP BY 1, 2, 3
"""
#: Probabilities of a pixel from its class and place; a second mask, moved, makes them err.
PROBS = """
SELECT img_id, y, x, cls, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2
FROM (SELECT img_id, y, x, cls, CAST(1 + (x * 3 + y * 5 + img_id) % 9 + CASE WHEN cls = 0 THEN 10 ELSE 0 END AS DOUBLE) AS w0,
  CAST(1 + (x * 4 + y * 7 + img_id) % 9 + CASE WHEN cls = 1 THEN 10 ELSE 0 END AS DOUBLE) AS w1,
  CAST(1 + (x * 5 + y * 9 + img_id) % 9 + CASE WHEN cls = 2 THEN 10 ELSE 0 END AS DOUBLE) AS w2 FROM {fx_mask}) w
"""

SLIDES = """
SELECT concat('s', CAST(o_orderkey % 40 AS VARCHAR(10)), '_', CAST(o_orderkey AS VARCHAR(20))) AS slide_id,
  concat('/data/', lower(o_orderpriority), '/s', CAST(o_orderkey % 40 AS VARCHAR(10)), '_', CAST(o_orderkey AS VARCHAR(20)),
    CASE WHEN o_orderstatus = 'P' THEN '.json' WHEN o_orderstatus = 'O' THEN '.xml' ELSE '.mrxs' END) AS path,
  CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS bytes,
  CASE WHEN o_custkey % 5 = 0 THEN 'unknown' ELSE CAST(o_custkey % 40 AS VARCHAR(10)) END AS objective_power, o_orderkey AS n
FROM {orders}
"""

POINTS_DUCK = "[{'x': xmin, 'y': ymin+(ymax-ymin)//2}, {'x': xmin+(xmax-xmin)//4, 'y': ymin}, {'x': xmin+3*(xmax-xmin)//4, 'y': ymin}, {'x': xmax, 'y': ymin+(ymax-ymin)//2}, {'x': xmin+3*(xmax-xmin)//4, 'y': ymax}, {'x': xmin+(xmax-xmin)//4, 'y': ymax}]"
_AT = ("xmin", "ymin + (ymax - ymin) div 2"), ("xmin + (xmax - xmin) div 4", "ymin"), ("xmin + 3 * (xmax - xmin) div 4", "ymin"), ("xmax", "ymin + (ymax - ymin) div 2"), ("xmin + 3 * (xmax - xmin) div 4", "ymax"), ("xmin + (xmax - xmin) div 4", "ymax")
POINTS_SPARK = "array(" + ", ".join(f"struct(cast({x} as int) as x, cast({y} as int) as y)" for x, y in _AT) + ")"
_TABLES = ("lineitem", "events", "embeddings", "part", "orders", "fx_mask")
_duck = {t: t for t in _TABLES}
#: Common table expressions for the SQL side, by name.
CTE = {
    "fx_annotations": f"fx_annotations AS ({ANNOTATIONS.format(**_duck)})",
    "fx_regions": f"fx_regions AS (SELECT *, {POINTS_DUCK} AS points FROM fx_annotations)",
    "fx_scores": f"fx_scores AS ({SCORES.format(**_duck)})",
    "fx_pixels": f"fx_pixels AS ({PIXELS_DUCK})",
    "fx_discs": f"fx_discs AS ({DISCS.format(**_duck)})",
    "fx_mask": f"fx_mask AS ({MASK_DUCK})",
    "fx_prob": f"fx_prob AS ({PROBS.format(**_duck)})",
    "fx_slides": f"fx_slides AS ({SLIDES.format(**_duck)})",
}


class Tables:
    """The given tables of one folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **{t: self.read(t) for t in _TABLES if f"{{{t}}}" in text and t not in tables}, **tables)

    def boxes(self) -> DataFrame:
        """slide_id, ann_idx, label, xmin, ymin, xmax, ymax."""
        return self._sql(ANNOTATIONS)

    def annotations(self) -> DataFrame:
        """The same, and a hexagon's points."""
        return self.boxes().withColumn("points", F.expr(POINTS_SPARK))

    def scores(self) -> DataFrame:
        return self._sql(SCORES)

    def pixels(self) -> DataFrame:
        return self._sql(PIXELS_SPARK)

    def discs(self) -> DataFrame:
        return self._sql(DISCS)

    def mask(self) -> DataFrame:
        """img_id, y, x, cls of every pixel, painted in place from the discs of its image; never broadcast, for Spark takes exploded rows to be as small as those they come from."""
        discs = spread(self.discs(), "img_id").groupBy("img_id").agg(F.collect_list(F.struct("cx", "cy", (F.col("r") * F.col("r")).alias("rr"), "cls")).alias("discs"))
        rows = discs.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
        # Of each disc that a row meets, the columns it reaches; a row's columns of a class are the bits of a number, as SIDE is below 63.
        left = F.transform("discs", lambda d: F.struct(d["cx"].alias("cx"), (d["rr"] - (F.col("y") - d["cy"]) * (F.col("y") - d["cy"])).alias("rr"), d["cls"].alias("cls")))
        reach = F.transform(F.filter(left, lambda d: d["rr"] >= 0), lambda d: F.struct(d["cls"].alias("cls"), d["cx"].alias("cx"), F.floor(F.sqrt(d["rr"])).cast("int").alias("w")))
        ends = F.transform(reach, lambda d: F.struct(d["cls"].alias("cls"), F.greatest(F.lit(0), d["cx"] - d["w"]).alias("a"), F.least(F.lit(SIDE - 1), d["cx"] + d["w"]).alias("b")))
        upto = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
        bits = lambda k: F.aggregate("ends", F.lit(0).cast("long"), lambda m, d: m.bitwiseOR(F.when(d["cls"] == k, upto(d["b"] + 1) - upto(d["a"])).otherwise(F.lit(0).cast("long"))))
        lines = rows.select("img_id", "y", ends.alias("ends")).select("img_id", "y", bits(1).alias("_one"), bits(2).alias("_two"))
        on = lambda c: F.call_function("shiftright", F.col(c), F.col("x")).bitwiseAND(F.lit(1).cast("long")) == 1
        pixels = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
        return pixels.select("img_id", "y", "x", F.when(on("_two"), 2).when(on("_one"), 1).otherwise(0).alias("cls")).hint("merge")

    def probs(self) -> DataFrame:
        """img_id, y, x, cls, p0, p1, p2."""
        return self._sql(PROBS, fx_mask=self.mask())

    def slides(self) -> DataFrame:
        return self._sql(SLIDES)
