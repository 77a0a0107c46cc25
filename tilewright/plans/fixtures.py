"""Rasters, pairs and runs derived from the given tables, in Spark and as SQL (common table expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import pixels
from tilewright.operators.layouts import pixels_of

SHAPE = (8, 8)
K3 = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]
K4 = [[float(4 * i + j + 1) for j in range(4)] for i in range(4)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrays8(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as a raster row, without a shuffle: image_id, label, data (an array of doubles)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.col("embedding").cast("array<double>").alias("data")).where("size(data) > 0")


def raster8(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an 8x8 raster: image_id, label, r, c, v."""
    return pixels_of(arrays8(spark, d), 8)


def _byte(v: Column) -> Column:
    return F.floor((v + 1) * 127.5).cast("int")


def _hex(v: Column) -> Column:
    return F.lpad(F.hex(_byte(v)), 2, "0")


def u8(spark: SparkSession, d: str) -> DataFrame:
    return raster8(spark, d).select("image_id", "r", "c", _byte(F.col("v")).alias("b"))


def patch3(spark: SparkSession, d: str) -> DataFrame:
    """Three rasters as the channels of one image: image_id, ch, r, c, b."""
    whole = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).alias("image_id")).count().where("count = 3").select("image_id")
    p = u8(spark, d).withColumn("ch", (F.col("image_id") % 3).cast("int")).withColumn("image_id", F.floor(F.col("image_id") / 3))
    return p.join(whole, "image_id", "left_semi").select("image_id", "ch", "r", "c", "b")


def rasters3(spark: SparkSession, d: str) -> DataFrame:
    """The colour patches as raster rows: image_id, height, width, channels, data (interleaved bytes). Three arrays a patch
    are shuffled, not pixels."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("image_id"), F.struct((F.col("vec_id") % 3).alias("ch"), F.col("embedding").cast("array<double>").alias("data")).alias("band"))
    bands = e.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("band")).alias("bands")).where("n = 3")
    sized = bands.select("image_id", "bands", F.array_max(F.transform("bands", lambda x: F.size(x["data"]))).alias("size")).where("size > 0")
    pixel = lambda p: F.array_join(F.transform("bands", lambda x: _hex(F.get(x["data"], p))), "")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("size") - 1), pixel), ""))
    return sized.select("image_id", F.lit(SHAPE[0]).alias("height"), F.lit(SHAPE[1]).alias("width"), F.lit(3).alias("channels"), data.alias("data"))


def grey1(spark: SparkSession, d: str) -> DataFrame:
    """Each raster as bytes: image_id, mask."""
    return arrays8(spark, d).select("image_id", F.unhex(F.array_join(F.transform("data", _hex), "")).alias("mask"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    """t: whether the next raster's value at the pixel is positive."""
    return raster8(spark, d).select((F.col("image_id") - 1).alias("image_id"), "r", "c", (F.col("v") > 0).cast("int").alias("t"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    q = raster8(spark, d).select("image_id", "label", "r", "c", pixels.sigmoid(F.col("v")).alias("q"))
    return q.join(truth(spark, d), ["image_id", "r", "c"])


def catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"))
    named = lambda p: F.format_string(p, F.col("image_id"))
    images = ids.select(named("tiles/%d_sat.jpg").alias("path"))
    masks = ids.where("image_id % 7 <> 0").select(named("tiles/%d_mask.png").alias("path"))
    return images, masks


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"), F.col("value").alias("loss"), F.sum(700 + F.col("event_id") % 17).over(w).alias("elapsed_s"))


def draw_sql(image: str, name: str, seed: int = 42, epoch: int = 0) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{epoch}', CAST({image} AS VARCHAR), '{name}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


CTE = {
    "r8": "SELECT vec_id AS image_id, label, p // 8 AS r, p % 8 AS c, v FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "u8": "SELECT image_id, r, c, CAST(floor((v + 1) * 127.5) AS BIGINT) AS b FROM r8",
    "patch3": "SELECT image_id // 3 AS image_id, image_id % 3 AS ch, r, c, b FROM u8 WHERE image_id // 3 IN (SELECT vec_id // 3 FROM embeddings GROUP BY 1 HAVING count(*) = 3)",
    "truth": "SELECT image_id - 1 AS image_id, r, c, CAST(v > 0 AS INT) AS t FROM r8",
    "pairs": "SELECT a.image_id, a.label, a.r, a.c, t, 1 / (1 + exp(-a.v)) AS q FROM r8 a JOIN truth b ON a.image_id = b.image_id AND a.r = b.r AND a.c = b.c",
    "images": "SELECT 'tiles/' || vec_id || '_sat.jpg' AS path FROM embeddings",
    "masks": "SELECT 'tiles/' || vec_id || '_mask.png' AS path FROM embeddings WHERE vec_id % 7 <> 0",
    "runs": "SELECT user_id AS run, row_number() OVER w AS epoch, value AS loss, CAST(sum(700 + event_id % 17) OVER w AS BIGINT) AS elapsed_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "best": "SELECT *, least(coalesce(min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100.0), 100.0) AS best FROM runs",
    "improved": "SELECT *, CAST(loss < best AS INT) AS improved FROM best",
    "island": "SELECT *, sum(improved) OVER (PARTITION BY run ORDER BY epoch) AS island FROM improved",
    "plateau": "SELECT *, CAST(sum(1 - improved) OVER (PARTITION BY run, island ORDER BY epoch) AS BIGINT) AS no_optim FROM island",
    "rates": "SELECT *, CAST(no_optim > 3 AS INT) AS cut, CAST(sum(CAST(no_optim > 3 AS INT)) OVER (PARTITION BY run ORDER BY epoch) AS BIGINT) AS cuts FROM plateau",
    "schedule": "SELECT *, 2e-4 / pow(5.0, cuts) AS lr, 2e-4 / pow(5.0, cuts - cut) AS lr_before FROM rates",
    "stops": "SELECT run, min(epoch) AS stop_epoch, arg_min(reason, epoch) AS reason FROM (SELECT *, CASE WHEN no_optim > 6 THEN 'early stop' WHEN no_optim > 3 AND lr_before < 5e-7 THEN 'minimum rate' WHEN epoch >= 300 THEN 'total epochs' END AS reason FROM schedule) WHERE reason IS NOT NULL GROUP BY run",
    "k3": "SELECT i, j, CAST(3 * i + j + 1 AS DOUBLE) AS w FROM range(3) a(i), range(3) b(j)",
    "k4": "SELECT i, j, CAST(4 * i + j + 1 AS DOUBLE) AS w FROM range(4) a(i), range(4) b(j)",
    "views": "SELECT k AS view, k & 1 AS rot, (k >> 1) & 1 AS fv, (k >> 2) & 1 AS fh FROM range(8) t(k)",
    "turned": "SELECT image_id, view, fv, fh, rot, CASE WHEN rot = 1 THEN 7 - c ELSE r END AS r, CASE WHEN rot = 1 THEN r ELSE c END AS c, b FROM u8, views",
    "viewed": "SELECT image_id, view, rot, fv, fh, CASE WHEN fv = 1 THEN 7 - r ELSE r END AS r, CASE WHEN fh = 1 THEN 7 - c ELSE c END AS c, b FROM turned",
    "scored": "SELECT *, 1 / (1 + exp(-(0.1 + 0.8 * (b / 255.0::DOUBLE * 3.2 - 1.6) + 0.05 * r - 0.03 * c))) AS q FROM viewed",
    "unflipped": "SELECT image_id, view, rot, CASE WHEN fv = 1 THEN 7 - r ELSE r END AS r, CASE WHEN fh = 1 THEN 7 - c ELSE c END AS c, q FROM scored",
    "inverted": "SELECT image_id, view, CASE WHEN rot = 1 THEN c ELSE r END AS r, CASE WHEN rot = 1 THEN 7 - r ELSE c END AS c, q FROM unflipped",
    "merged": "SELECT image_id, r, c, sum(q) AS q FROM inverted GROUP BY ALL",
    "scored1": "SELECT image_id, r, c, 1 / (1 + exp(-(0.1 + 0.8 * (b / 255.0::DOUBLE * 3.2 - 1.6) + 0.05 * r - 0.03 * c))) AS q FROM u8",
    "planes": "SELECT image_id, r, c, max(b) FILTER (ch = 0) AS pb, max(b) FILTER (ch = 1) AS pg, max(b) FILTER (ch = 2) AS pr FROM patch3 GROUP BY ALL",
    "mixed3": "SELECT image_id, r, c, 0.2::DOUBLE * (pb / 255.0::DOUBLE * 3.2 - 1.6) + 0.5::DOUBLE * (pg / 255.0::DOUBLE * 3.2 - 1.6) - 0.3::DOUBLE * (pr / 255.0::DOUBLE * 3.2 - 1.6) AS z FROM planes",
    "scored3": "SELECT image_id, r, c, 1 / (1 + exp(-(0.1 + z + 0.05 * r - 0.03 * c))) AS q FROM mixed3",
    "seen3": "SELECT image_id, r, c, z, CASE WHEN fv = 1 THEN 7 - r1 ELSE r1 END AS vr, CASE WHEN fh = 1 THEN 7 - c1 ELSE c1 END AS vc FROM (SELECT *, CASE WHEN rot = 1 THEN 7 - c ELSE r END AS r1, CASE WHEN rot = 1 THEN r ELSE c END AS c1 FROM mixed3, views)",
    "merged3": "SELECT image_id, r, c, sum(1 / (1 + exp(-(0.1 + z + 0.05 * vr - 0.03 * vc)))) AS q FROM seen3 GROUP BY ALL",
    "hsv0": "SELECT *, greatest(pb, pg, pr) AS v, greatest(pb, pg, pr) - least(pb, pg, pr) AS d FROM planes",
    "hsv1": "SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN v = pr THEN 60.0 * (pg - pb) / d WHEN v = pg THEN 120.0 + 60.0 * (pb - pr) / d ELSE 240.0 + 60.0 * (pr - pg) / d END::DOUBLE AS deg FROM hsv0",
    "hsv": "SELECT image_id, r, c, pb, pg, pr, CAST(floor((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2 + 0.5) AS BIGINT) % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE CAST(floor(255.0::DOUBLE * d / v + 0.5) AS BIGINT) END AS s, v FROM hsv1",
    "shifted": "SELECT image_id, r, c, pb, pg, pr, "
    f"(h + CAST(-30 + floor({draw_sql('image_id', 'hue')} * 61) AS BIGINT) + 256) % 256 AS h, "
    f"least(255, greatest(0, CAST(floor(s + (-5 + {draw_sql('image_id', 'sat')} * 10) + 0.5) AS BIGINT))) AS s, "
    f"least(255, greatest(0, CAST(floor(v + (-15 + {draw_sql('image_id', 'val')} * 30) + 0.5) AS BIGINT))) AS v, {draw_sql('image_id', 'hsv')} < 0.5 AS lit FROM hsv",
    "sectors": "SELECT *, CAST(floor(h / 30.0::DOUBLE) AS BIGINT) % 6 AS k, h / 30.0::DOUBLE - floor(h / 30.0::DOUBLE) AS f, s / 255.0::DOUBLE AS st FROM shifted",
    "pqt": "SELECT *, v * (1 - st) AS p, v * (1 - st * f) AS q, v * (1 - st * (1 - f)) AS t FROM sectors",
    "back": "SELECT image_id, r, c, lit, pb, pg, pr, CAST(floor(CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END + 0.5) AS BIGINT) AS nb, "
    "CAST(floor(CASE k WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END + 0.5) AS BIGINT) AS ng, CAST(floor(CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END + 0.5) AS BIGINT) AS nr FROM pqt",
    "coloured": "SELECT image_id, ch, r, c, CASE ch WHEN 0 THEN CASE WHEN lit THEN nb ELSE pb END WHEN 1 THEN CASE WHEN lit THEN ng ELSE pg END ELSE CASE WHEN lit THEN nr ELSE pr END END AS b FROM back, range(3) x(ch)",
}


def _warp(src: str, keys: str, shift: float, scale: float, aspect: float, rotate: float) -> str:
    """SQL of the affine warp of ``src`` (image_id[, ch], r, c, b)."""
    u = lambda n: draw_sql("image_id", n)
    span = lambda n, lo, hi: f"({float(lo)!r} + {u(n)} * {float(hi - lo)!r})"
    on = " AND ".join(f"p.{k} = s.{k}" for k in keys.split(", "))
    return f"""
WITH m AS (SELECT image_id, k * asp AS sx, k / asp AS sy, ang, dx, dy FROM (SELECT image_id, {span("scale", 1 - scale, 1 + scale)} AS k, sqrt({span("aspect", 1 - aspect, 1 + aspect)}) AS asp, radians({span("angle", -rotate, rotate)}) AS ang, round({span("dx", -shift, shift)} * 8) AS dx, round({span("dy", -shift, shift)} * 8) AS dy FROM (SELECT DISTINCT image_id FROM {src}) WHERE {u("ssr")} < 0.5)),
n AS (SELECT *, cos(ang) * sx AS a, -sin(ang) * sy AS b_, sin(ang) * sy AS c_, cos(ang) * sx AS d FROM m),
p AS (SELECT {", ".join(f"o.{k}" for k in keys.split(", "))}, o.r, o.c, (d * (o.c - 4 - dx) - b_ * (o.r - 4 - dy)) / (a * d - b_ * c_) + 4 AS x, (a * (o.r - 4 - dy) - c_ * (o.c - 4 - dx)) / (a * d - b_ * c_) + 4 AS y FROM {src} o JOIN n USING (image_id)),
q AS (SELECT *, CAST(floor(x) AS BIGINT) + i AS sc, CAST(floor(y) AS BIGINT) + j AS sr, (CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM p, range(2) a(i), range(2) b(j)),
w AS (SELECT {", ".join(f"p.{k}" for k in keys.split(", "))}, p.r, p.c, sum(w * coalesce(s.b, 0)) AS z FROM q p LEFT JOIN {src} s ON {on} AND p.sr = s.r AND p.sc = s.c GROUP BY ALL)
SELECT {keys}, r, c, CAST(floor(round(z, 9) + 0.5) AS BIGINT) AS b FROM w UNION ALL SELECT {keys}, r, c, b FROM {src} WHERE NOT ({u("ssr")} < 0.5)"""


def turn_sql(src: str, cols: str, names: tuple[str, ...] = ("hflip", "vflip", "rot90")) -> str:
    """SQL of the gated flips and turn of ``src``; ``cols`` are kept as they are."""
    q = f"SELECT {cols}, image_id, r, c FROM {src}"
    for n in names:
        g = f"{draw_sql('image_id', n)} < 0.5"
        r = {"hflip": "r", "vflip": f"CASE WHEN {g} THEN 7 - r ELSE r END", "rot90": f"CASE WHEN {g} THEN 7 - c ELSE r END"}[n]
        c = {"hflip": f"CASE WHEN {g} THEN 7 - c ELSE c END", "vflip": "c", "rot90": f"CASE WHEN {g} THEN r ELSE c END"}[n]
        q = f"SELECT {cols}, image_id, {r} AS r, {c} AS c FROM ({q})"
    return q


CTE["warped3"] = _warp("coloured", "image_id, ch", 0.1, 0.1, 0.1, 0.0)
CTE["warped"] = _warp("u8", "image_id", 0.1, 0.1, 0.1, 0.0)
CTE["warped_turn"] = _warp("u8", "image_id", 0.1, 0.1, 0.1, 30.0)


def sql(body: str) -> str:
    """``body`` with those of the expressions above that it needs."""
    need: list[str] = []

    def visit(text: str, seen: tuple[str, ...] = ()) -> None:
        for name in dict.fromkeys(re.findall(r"\w+", text)):
            if name in CTE and name not in need and name not in seen:
                visit(CTE[name], (*seen, name))
                need.append(name)

    visit(body)
    if not need:
        return body
    head = "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in need)
    return f"{head}, {body[5:]}" if body.startswith("WITH ") else f"{head} {body}"
