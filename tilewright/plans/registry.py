"""Registered queries and their SQL twins.

Each entry applies one operator of the library to data derived from the given tables and states its output columns
(``name:kind`` with l long, d double rounded to six places, s string). Both sides are brought to these types.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import draws, pixels
from tilewright.operators import algebra, algebra_rasters, augment, augment_rasters, batches, jobs, layouts, metrics, pairing, regions, runs, score, symmetry, tiles
from tilewright.plans import fixtures as fx
from tilewright.plans.fixtures import K3, K4, SHAPE, draw_sql
from tilewright.sources import bucketed, filesink, headers, images, logtail, masks, runlog, shared
from tilewright.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_SPARK = {"l": lambda c: F.col(c).cast("long"), "d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0), "s": lambda c: F.col(c).cast("string")}
_DUCK = {"l": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "s": "CAST({0} AS VARCHAR)"}
col = F.col


def add(name: str, columns: str, make: Query, sql: str | None = None) -> None:
    spec = [x.split(":") for x in columns.split()]
    QUERIES[name] = lambda spark, d: make(spark, d).select(*[_SPARK[k](c).alias(c) for c, k in spec])
    if sql is not None:
        inner = fx.sql(sql)
        SQL[name] = f"SELECT {', '.join(f'{_DUCK[k].format(c)} AS {c}' for c, k in spec)} FROM ({inner}) AS result"


# Sources and sinks -----------------------------------------------------------------------------------------------


def _png_dir(spark: SparkSession, d: str, end: str = "_sat.png") -> str:
    """The colour patches as image files ``{id}_sat.png``, or as masks in colour."""
    path = shared.scratch(spark, "png")
    rows = fx.rasters3(spark, d).withColumn("name", F.concat(col("image_id").cast("string"), F.lit(end)))
    masks.write_files(rows, path)
    return path


def _image_sums(df: DataFrame) -> DataFrame:
    return images.raster_pixels(df).groupBy("image_id", "ch").agg(F.sum("b").alias("total"), F.sum(col("b") * (col("r") * 8 + col("c") + 1)).alias("placed"), F.count(F.lit(1)).alias("n"))


_SUMS = "SELECT CAST(image_id AS VARCHAR) AS image_id, ch, sum(b) AS total, sum(b * (r * 8 + c + 1)) AS placed, count(*) AS n FROM {} GROUP BY ALL"

add("s1_list_images", "image_id:s present:l", lambda s, d: images.list_images(s, _png_dir(s, d)).select("image_id", (col("length") > 0).alias("present")), "SELECT DISTINCT image_id, 1 AS present FROM patch3")
add("s2_scan_images", "image_id:s ch:l total:l placed:l n:l", lambda s, d: _image_sums(images.scan_images(s, _png_dir(s, d))), _SUMS.format("patch3"))


def _grey_masks(spark: SparkSession, d: str) -> DataFrame:
    path = shared.scratch(spark, "masks")
    grey = layouts.rasters_of(fx.u8(spark, d).withColumn("v", pixels.binarise_mask(col("b")) * 255), ["image_id"])
    masks.write_masks(grey.withColumn("channels", F.lit(1)), path)
    return images.scan_masks(spark, path)


add("s3_scan_masks_luma", "image_id:s total:l placed:l", lambda s, d: _image_sums(images.scan_masks(s, _png_dir(s, d, "_mask.png"))), "SELECT CAST(image_id AS VARCHAR) AS image_id, sum(y) AS total, sum(y * (r * 8 + c + 1)) AS placed FROM (SELECT image_id, r, c, CAST(floor(0.114::DOUBLE * pb + 0.587::DOUBLE * pg + 0.299::DOUBLE * pr + 0.5) AS BIGINT) AS y FROM planes) GROUP BY image_id")
add("s4_write_masks", "image_id:s ch:l total:l placed:l n:l", lambda s, d: _image_sums(_grey_masks(s, d)), _SUMS.format("(SELECT image_id, 0 AS ch, r, c, CASE WHEN b >= 128 THEN 255 ELSE 0 END AS b FROM u8)"))


def _refused(spark: SparkSession, d: str) -> DataFrame:
    """Files written once; the second write is refused and changes nothing."""
    path = shared.scratch(spark, "refused")
    grey = fx.grey1(spark, d).select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), col("mask").alias("data"))
    masks.write_masks(grey, path)
    try:
        masks.write_masks(grey.withColumn("data", F.unhex(F.repeat(F.lit("00"), F.lit(64)))), path, if_exists="error")
        refused = 0
    except FileExistsError:
        refused = 1
    return _image_sums(images.scan_masks(spark, path)).agg(F.sum("total").alias("total"), F.lit(refused).alias("refused"))


add("s5_refuse_existing", "total:l refused:l", _refused, "SELECT sum(b) AS total, 1 AS refused FROM u8")
add("s6_mask_name", "path:s mask:s", lambda s, d: fx.catalogue(s, d)[0].select("path", pixels.mask_name(col("path")).alias("mask")), "SELECT path, regexp_replace(path, 'sat.jpg$', 'mask.png') AS mask FROM images")


def _run_log(spark: SparkSession, d: str) -> DataFrame:
    path = shared.scratch(spark, "runlog")
    r = fx.runs(spark, d)
    runlog.write_run_log(r, path)
    runlog.write_run_log(r.where("run = 1"), path)  # a run that is written again replaces its own rows only
    back = runlog.saved_runs(spark, path)
    return runlog.log_text(back.select(col("run").cast("long").alias("run"), "epoch", "elapsed_s", "loss"))


add("s7_write_run_log", "run:l epoch:l text:s", _run_log, "SELECT run, epoch, format('********\nepoch: {}     time: {}\ntrain_loss: {}\nSHAPE: (1024, 1024)', epoch, elapsed_s, CAST(loss AS VARCHAR)) AS text FROM runs")
add("s7_log_events", "run:l epoch:l text:s", lambda s, d: runlog.log_text_with_events(fx.runs(s, d)), "SELECT r.run, r.epoch, format('********\nepoch: {}     time: {}\ntrain_loss: {}\nSHAPE: (1024, 1024)', r.epoch, r.elapsed_s, CAST(r.loss AS VARCHAR)) || CASE WHEN r.epoch = stop_epoch THEN CASE WHEN reason = 'early stop' THEN chr(10) || 'early stop at ' || r.epoch || ' epoch' ELSE '' END WHEN cut = 1 THEN format('\nupdate learning rate: {:.6f} -> {:.6f}', lr_before, lr) ELSE '' END AS text FROM schedule r LEFT JOIN stops s ON r.run = s.run WHERE stop_epoch IS NULL OR r.epoch <= stop_epoch")


def _log_back(spark: SparkSession, d: str) -> DataFrame:
    path = shared.scratch(spark, "textlog")
    runlog.write_text_log(fx.runs(spark, d), path, events=False)
    return runlog.read_run_log(spark, path)


add("s8_read_run_log", "run:l epoch:l elapsed_s:l loss:d height:l width:l", _log_back, "SELECT run, epoch, elapsed_s, loss, 1024 AS height, 1024 AS width FROM runs")
add("s9_best_checkpoint", "run:l epoch:l loss:d path:s", lambda s, d: runs.best_checkpoint(fx.runs(s, d)), "SELECT run, epoch, loss, 'checkpoints/' || run AS path FROM improved WHERE improved = 1 QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1")


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    """Files of each embedding's image and mask, some missing, some of another shape, some not images: what the audit finds
    by their headers alone."""
    path = shared.scratch(spark, "faulty")
    grey = fx.grey1(spark, d).withColumnRenamed("mask", "data")
    shaped = lambda n: F.when(col("image_id") % n == 3, 4).otherwise(8)
    sized = grey.select("image_id", F.explode(F.array(F.struct(F.lit("sat").alias("kind"), shaped(11).alias("height")), F.struct(F.lit("mask").alias("kind"), shaped(13).alias("height")))).alias("k"), "data").select("image_id", "k.*", "data")
    rows = sized.select(F.concat_ws("_", "image_id", F.concat("kind", F.lit(".png"))).alias("name"), "image_id", "kind", "height", F.lit(8).alias("width"), F.lit(1).alias("channels"), F.expr("substring(data, 1, height * 8)").alias("data"))
    rows = rows.where("not (kind = 'sat' and image_id % 5 = 0) and not (kind = 'mask' and image_id % 7 = 0)")
    junk = F.when((col("kind") == "sat") & (col("image_id") % 17 == 1), 1).when((col("kind") == "mask") & (col("image_id") % 19 == 2), 1).otherwise(0)
    rows = rows.withColumn("junk", junk)
    broken = rows.where("junk = 1").select("name", F.lit("no image").cast("binary").alias("content"))
    filesink.write_set(masks.encoded(rows.where("junk = 0")).unionByName(broken), path)
    return pairing.raster_audit(headers.scan_headers(spark, path), headers.scan_headers(spark, path, "*_mask.*", pixels.mask_id), SHAPE)


_SIDES = "(SELECT vec_id AS i, vec_id % 5 <> 0 AS image, vec_id % 7 <> 0 AS mask, vec_id % 17 = 1 AS bad_image, vec_id % 19 = 2 AS bad_mask, vec_id % 11 = 3 AS odd_image, vec_id % 13 = 3 AS odd_mask FROM embeddings)"
_FAULTS = {"no mask": "image AND NOT mask", "no image": "mask AND NOT image", "undecodable image": "image AND bad_image", "undecodable mask": "mask AND bad_mask", "image of another shape": "image AND odd_image AND NOT bad_image", "mask of another shape": "mask AND odd_mask AND NOT bad_mask"}
add("j2_audit_headers", "image_id:s problem:s", _faulty, " UNION ALL ".join(f"SELECT CAST(i AS VARCHAR) AS image_id, '{k}' AS problem FROM {_SIDES} AS x WHERE {v}" for k, v in _FAULTS.items()))


def _header_rows(spark: SparkSession, d: str) -> DataFrame:
    return headers.scan_headers(spark, _png_dir(spark, d))


add("s2_scan_headers", "image_id:s format:s height:l width:l channels:l", _header_rows, "SELECT DISTINCT CAST(image_id AS VARCHAR) AS image_id, 'png' AS format, 8 AS height, 8 AS width, 3 AS channels FROM patch3")

# Projections and predicates --------------------------------------------------------------------------------------


def _all_files(spark: SparkSession, d: str) -> DataFrame:
    i, m = fx.catalogue(spark, d)
    return i.unionByName(m)


add("p1_only_images", "path:s", lambda s, d: _all_files(s, d).where(pixels.is_image_name(col("path"))), "SELECT path FROM (SELECT * FROM images UNION ALL SELECT * FROM masks) WHERE contains(path, 'sat')")
add("p2_image_id", "path:s image_id:s", lambda s, d: fx.catalogue(s, d)[0].select("path", pixels.image_id(col("path")).alias("image_id")), "SELECT path, regexp_extract(path, '([^/]+)_sat\\.[a-z]+$', 1) AS image_id FROM images")
add("p3_normalise", "image_id:l r:l c:l x:d", lambda s, d: fx.u8(s, d).withColumn("x", pixels.normalise(col("b"))), "SELECT image_id, r, c, b / 255.0::DOUBLE * 3.2 - 1.6 AS x FROM u8")


def _hwc(spark: SparkSession, d: str) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("r", "c", "ch", "b")))
    return fx.patch3(spark, d).groupBy("image_id").agg(F.transform(cells, lambda x: x["b"]).alias("data"))


def _chw(spark: SparkSession, d: str) -> DataFrame:
    return _hwc(spark, d).select("image_id", F.posexplode(layouts.to_chw(col("data"), F.lit(64), 3)).alias("p", "b"))


add("p4_to_chw", "image_id:l p:l b:l", _chw, "SELECT image_id, ch * 64 + r * 8 + c AS p, b FROM patch3")
add("p5_binarise_mask", "image_id:l r:l c:l t:l", lambda s, d: fx.u8(s, d).withColumn("t", pixels.binarise_mask(col("b"))), "SELECT image_id, r, c, CASE WHEN b / 255.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS t FROM u8")
add("p6_binarise_pred", "image_id:l r:l c:l p:l", lambda s, d: fx.pairs(s, d).withColumn("p", pixels.binarise_pred(col("q"))), "SELECT image_id, r, c, CASE WHEN q > 0.5 THEN 1 ELSE 0 END AS p FROM pairs")
add("p7_tta_threshold", "image_id:l r:l c:l m:l", lambda s, d: score.tta_score(fx.u8(s, d), score.logistic(), SHAPE).withColumn("m", pixels.tta_threshold(col("q"))), "SELECT image_id, r, c, CASE WHEN q > 4 THEN 255 ELSE 0 END AS m FROM merged")
add("p8_gray_to_bgr", "image_id:l p:l b:l", lambda s, d: layouts.rasters_of(fx.u8(s, d), ["image_id"], "b").select("image_id", F.posexplode(layouts.gray_to_bgr(col("data"))).alias("p", "b")), "SELECT image_id, (r * 8 + c) * 3 + k AS p, b FROM u8, range(3) t(k)")
add("p9_casts", "image_id:l r:l c:l f:d byte:l wrapped:l", lambda s, d: fx.raster8(s, d).select("image_id", "r", "c", pixels.as_float(col("v") * 127.5).alias("f"), pixels.as_byte((col("v") + 1) * 127.5).alias("byte"), pixels.as_byte(col("v") * 900).alias("wrapped")), "SELECT image_id, r, c, CAST(v * 127.5 AS FLOAT) AS f, CAST(floor((v + 1) * 127.5) AS BIGINT) AS byte, (CAST(trunc(v * 900) AS BIGINT) % 256 + 256) % 256 AS wrapped FROM r8")
def _unit_axes(spark: SparkSession, d: str) -> DataFrame:
    """Two axes of length one added, measured, and dropped again."""
    rows = layouts.rasters_of(fx.u8(spark, d), ["image_id"], "b").withColumn("x", layouts.add_axes(col("data"), 2))
    sizes = [F.size("x").alias("n"), F.size(col("x")[0]).alias("channels"), F.size(col("x")[0][0]).alias("length")]
    return rows.select("image_id", *sizes, F.posexplode(layouts.drop_axes(col("x"), 2)).alias("p", "b"))


add("p10_unit_axes", "image_id:l n:l channels:l length:l p:l b:l", _unit_axes, "SELECT image_id, 1 AS n, 1 AS channels, 64 AS length, r * 8 + c AS p, b FROM u8")
add("p11_invert_mask", "image_id:l r:l c:l t:l", lambda s, d: fx.u8(s, d).withColumn("t", pixels.binarise_mask(col("b"), invert=True)), "SELECT image_id, r, c, CASE WHEN b >= 128 THEN 0 ELSE 1 END AS t FROM u8")
add("p12_score_keeps_id", "image_id:l r:l c:l p:l", lambda s, d: score.score(fx.u8(s, d), score.logistic()).withColumn("p", pixels.binarise_pred(col("q"))), "SELECT image_id, r, c, CASE WHEN q > 0.5 THEN 1 ELSE 0 END AS p FROM scored1")

# Joins -----------------------------------------------------------------------------------------------------------


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i, m = fx.catalogue(spark, d)
    return i.select(pixels.image_id(col("path")).alias("image_id"), col("path").alias("image")), m.select(pixels.mask_id(col("path")).alias("image_id"), col("path").alias("mask"))


_ID = "regexp_extract(path, '([0-9]+)_', 1)"
add("j1_pair", "image_id:s image:s mask:s", lambda s, d: pairing.pair(*_named(s, d)), f"SELECT a.image_id, image, mask FROM (SELECT {_ID} AS image_id, path AS image FROM images) a JOIN (SELECT {_ID} AS image_id, path AS mask FROM masks) b USING (image_id)")


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of two tables that are bucketed by id: no shuffle."""
    names = []
    for df in _named(spark, d):
        path = shared.scratch(spark, "bucketed")
        names.append("tw_" + path.rsplit("-", 1)[1])
        bucketed.save(df, names[-1], 8, path=path)
    return pairing.pair(*[bucketed.load(spark, n) for n in names])


add("j1_pair_bucketed", "image_id:s image:s mask:s", _bucketed)
SQL["j1_pair_bucketed"] = SQL["j1_pair"]
add("j2_raster_audit", "image_id:s problem:s", lambda s, d: pairing.raster_audit(*_named(s, d)), f"SELECT {_ID} AS image_id, 'no mask' AS problem FROM images WHERE {_ID} NOT IN (SELECT {_ID} FROM masks)")
add("j3_align", "image_id:l r:l c:l q:d t:l", lambda s, d: metrics.align(score.score(fx.u8(s, d), score.logistic()), fx.truth(s, d)), "SELECT image_id, r, c, q, t FROM scored1 JOIN truth USING (image_id, r, c)")
_ORDER = "SELECT image_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '{e}', CAST(image_id AS VARCHAR), 'order')), image_id) - 1 AS pos FROM (SELECT vec_id AS image_id FROM embeddings)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "embeddings").select(col("vec_id").alias("image_id"))


add("j4_sample_at", "image_id:l pos:l", lambda s, d: batches.sample_at(batches.make_batches(_ids(s, d), 4), 17), f"SELECT * FROM ({_ORDER.format(e=0)}) WHERE pos = 17")
add("j5_with_draws", "image_id:l u_scale:d u_dx:d", lambda s, d: pairing.with_draws(_ids(s, d), ["scale", "dx"]), f"SELECT vec_id AS image_id, {draw_sql('vec_id', 'scale')} AS u_scale, {draw_sql('vec_id', 'dx')} AS u_dx FROM embeddings")

# Aggregations ----------------------------------------------------------------------------------------------------

_BCE = "avg(-(t * greatest(ln(q), -100) + (1 - t) * greatest(ln(1 - q), -100)))"
_DICE = "2 * sum(t * q) / nullif(sum(t) + sum(q), 0)"
add("a1_bce", "image_id:l bce:d", lambda s, d: metrics.bce(fx.pairs(s, d), ["image_id"]), f"SELECT image_id, {_BCE} AS bce FROM pairs GROUP BY 1")
add("a2_dice_batch", "batch_id:l dice:d", lambda s, d: metrics.dice(fx.pairs(s, d).withColumn("batch_id", F.floor(col("image_id") / 8)), ["batch_id"]), f"SELECT image_id // 8 AS batch_id, {_DICE} AS dice FROM pairs GROUP BY 1")
add("a3_dice_per_image_mean", "dice:d", lambda s, d: metrics.dice(fx.pairs(s, d), ["image_id"], mean=True), f"SELECT avg(x) AS dice FROM (SELECT image_id, {_DICE} AS x FROM pairs GROUP BY 1)")
add("a4_dice_loss", "label:l dice_loss:d", lambda s, d: metrics.dice_loss(fx.pairs(s, d), ["label"]), f"SELECT label, 1 - {_DICE} AS dice_loss FROM pairs GROUP BY 1")
add("a5_dice_bce_loss", "label:l loss:d", lambda s, d: metrics.dice_bce_loss(fx.pairs(s, d), ["label"]), f"SELECT label, {_BCE} + 1 - {_DICE} AS loss FROM pairs GROUP BY 1")
add("a5_dice_bce_loss_per_image", "label:l loss:d", lambda s, d: metrics.dice_bce_loss(fx.pairs(s, d), ["label"], batch=False), f"SELECT a.label, e + 1 - x AS loss FROM (SELECT label, {_BCE} AS e FROM pairs GROUP BY 1) a JOIN (SELECT label, avg(x) AS x FROM (SELECT label, image_id, {_DICE} AS x FROM pairs GROUP BY 1, 2) GROUP BY 1) b ON a.label = b.label")
add("a6_iou", "image_id:l iou:d", lambda s, d: metrics.iou(fx.pairs(s, d), ["image_id"]), "SELECT image_id, sum(t * q) / nullif(sum(t) + sum(q) - sum(t * q), 0) AS iou FROM pairs GROUP BY 1")
add("a7_epoch_loss", "label:l epoch_loss:d", lambda s, d: metrics.epoch_loss(metrics.dice_bce_loss(fx.pairs(s, d).withColumn("batch_id", F.floor(col("image_id") / 8)), ["label", "batch_id"]), ["label"]), f"SELECT label, avg(x) AS epoch_loss FROM (SELECT label, image_id // 8 AS b, {_BCE} + 1 - {_DICE} AS x FROM pairs GROUP BY 1, 2) GROUP BY 1")


def _raster_losses(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the colour patches against the masks of the rasters with the same number, without pixel rows."""
    scored = score.score_rasters(fx.rasters3(spark, d), batch_size=8, **_BANDS)
    t = F.unhex(F.array_join(F.transform("t", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    truth = layouts.rasters_of(fx.u8(spark, d).withColumn("t", pixels.binarise_mask(col("b"))), ["image_id"], "t").select("image_id", col("data").alias("t")).withColumn("t", t)
    return metrics.raster_losses(metrics.raster_sums(scored.join(truth, "image_id"), ["image_id"], "float64"), ["image_id"])


add("a6_raster_losses", "image_id:l bce:d dice:d iou:d loss:d", _raster_losses, f"SELECT image_id, {_BCE} AS bce, {_DICE} AS dice, sum(t * q) / nullif(sum(t) + sum(q) - sum(t * q), 0) AS iou, {_BCE} + 1 - {_DICE} AS loss FROM (SELECT s.image_id, q, CASE WHEN b >= 128 THEN 1 ELSE 0 END AS t FROM scored3 s JOIN u8 USING (image_id, r, c)) GROUP BY image_id")
add("a8_n_samples", "n:l", lambda s, d: batches.n_samples(_ids(s, d)), "SELECT count(*) AS n FROM embeddings")
add("a9_n_batches", "n:l", lambda s, d: batches.n_batches(_ids(s, d), 24), "SELECT (count(*) + 23) // 24 AS n FROM embeddings")
add("a10_tta_merge", "image_id:l r:l c:l q:d", lambda s, d: score.tta_merge(score.tta_invert(score.score(score.tta_views(fx.u8(s, d), SHAPE), score.logistic()), SHAPE)), "SELECT * FROM merged")

# Run analytics ---------------------------------------------------------------------------------------------------

add("w1_make_batches", "image_id:l pos:l batch_id:l", lambda s, d: batches.make_batches(_ids(s, d), 8, epoch=3), f"SELECT *, pos // 8 AS batch_id FROM ({_ORDER.format(e=3)})")
add("w2_running_best", "run:l epoch:l best:d", lambda s, d: runs.running_best(fx.runs(s, d)), "SELECT run, epoch, best FROM best")
add("w3_improved", "run:l epoch:l improved:l", lambda s, d: runs.running_best(fx.runs(s, d)), "SELECT run, epoch, improved FROM improved")
add("w4_plateau", "run:l epoch:l no_optim:l", lambda s, d: runs.plateau(fx.runs(s, d)), "SELECT run, epoch, no_optim FROM plateau")
add("w5_lr_schedule", "run:l epoch:l cuts:l scaled:d", lambda s, d: runs.lr_schedule(fx.runs(s, d), patience=3).withColumn("scaled", F.log10("lr")), "SELECT run, epoch, cuts, log10(lr) AS scaled FROM schedule")
add("w6_stop_epoch", "run:l stop_epoch:l reason:s", lambda s, d: runs.stop_epoch(fx.runs(s, d)), "SELECT * FROM stops")
add("w5_lr_schedule_blocked", "run:l epoch:l cuts:l scaled:d", lambda s, d: runs.lr_schedule_blocked(fx.runs(s, d), block=16).withColumn("scaled", F.log10("lr")))
add("w6_stop_epoch_blocked", "run:l stop_epoch:l reason:s", lambda s, d: runs.stop_epoch(fx.runs(s, d), block=16))
SQL["w5_lr_schedule_blocked"], SQL["w6_stop_epoch_blocked"] = SQL["w5_lr_schedule"], SQL["w6_stop_epoch"]
add("w7_epoch_seconds", "run:l epoch:l seconds:l", lambda s, d: runs.epoch_seconds(fx.runs(s, d)), "SELECT run, epoch, elapsed_s - lag(elapsed_s, 1, 0) OVER (PARTITION BY run ORDER BY epoch) AS seconds FROM runs")
add("w8_active_checkpoint", "run:l epoch:l checkpoint:l", lambda s, d: runs.active_checkpoint(fx.runs(s, d)), "SELECT run, epoch, max(CASE WHEN improved = 1 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS checkpoint FROM improved")
add("w9_progress", "run:l epoch:l item:l elapsed_s:l", lambda s, d: runs.progress(fx.runs(s, d), "run", "epoch"), "SELECT run, epoch, epoch - 1 AS item, elapsed_s FROM runs WHERE (epoch - 1) % 10 = 0")
add("w10_set_rate", "run:l epoch:l scaled:d", lambda s, d: runs.set_rate(fx.runs(s, d), F.when(col("epoch") % 5 == 0, 1e-4 / col("epoch"))).withColumn("scaled", F.log10("lr")), "SELECT run, epoch, log10(coalesce(last_value(CASE WHEN epoch % 5 = 0 THEN 1e-4 / epoch END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 2e-4)) AS scaled FROM runs")
add("o1_random_order", "image_id:l pos:l", lambda s, d: batches.make_batches(_ids(s, d), 1, epoch=1), _ORDER.format(e=1))
add("o2_first_epochs", "run:l epoch:l", lambda s, d: runs.first_epochs(fx.runs(s, d), 50), "SELECT run, epoch FROM runs WHERE epoch <= 50")
add("o2_until_stop", "run:l epoch:l", lambda s, d: runs.until_stop(fx.runs(s, d)), "SELECT r.run, r.epoch FROM runs r LEFT JOIN stops s ON r.run = s.run WHERE s.stop_epoch IS NULL OR r.epoch <= s.stop_epoch")
add("o3_best_epochs", "run:l rank:l epoch:l loss:d", lambda s, d: runs.best_epochs(fx.runs(s, d), 3), "SELECT run, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS rank, epoch, loss FROM runs QUALIFY rank <= 3")

# Set operations --------------------------------------------------------------------------------------------------

def _stacked(spark: SparkSession, d: str) -> DataFrame:
    """Each image's eight views as arrays in one row, each one permutation of the image's array."""
    rows = layouts.rasters_of(fx.u8(spark, d), ["image_id"], "b")
    each = rows.select("image_id", F.posexplode(symmetry.stack_views(col("data"), col("height"), col("width"))).alias("view", "v"))
    return layouts.pixels_of(each, 8, "v", "b")


add("u1_stack_views", "image_id:l view:l r:l c:l b:l", _stacked, "SELECT image_id, view, r, c, b FROM viewed")
add("u2_stack_planes", "image_id:l ch:l r:l c:l b:l", lambda s, d: layouts.gray_planes(fx.u8(s, d)), "SELECT image_id, ch, r, c, b FROM u8, range(3) t(ch)")


def _hsv_planes(spark: SparkSession, d: str) -> DataFrame:
    p = layouts.split_channels(fx.patch3(spark, d), ["pb", "pg", "pr"], ["image_id", "r", "c"])
    x = pixels.hsv(col("pb"), col("pg"), col("pr"))
    return p.select("image_id", "r", "c", *[x[k].alias(k) for k in "hsv"])


add("u3_split_merge", "image_id:l r:l c:l ch:l x:l", lambda s, d: layouts.merge_channels(_hsv_planes(s, d), ["h", "s", "v"], ["image_id", "r", "c"], "x"), "SELECT image_id, r, c, ch, CASE ch WHEN 0 THEN h WHEN 1 THEN s ELSE v END AS x FROM hsv, range(3) t(ch)")
add("u4_concat_channels", "image_id:l ch:l r:l c:l b:l", lambda s, d: layouts.concat_channels(fx.patch3(s, d), fx.patch3(s, d).withColumn("b", 255 - col("b")), 3), "SELECT image_id, ch, r, c, b FROM patch3 UNION ALL SELECT image_id, ch + 3, r, c, 255 - b FROM patch3")

# Scalar functions ------------------------------------------------------------------------------------------------

add("f1_bgr_to_hsv", "image_id:l r:l c:l h:l s:l v:l", _hsv_planes, "SELECT image_id, r, c, h, s, v FROM hsv")


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    p = _hsv_planes(spark, d)
    x = pixels.bgr(col("h"), col("s"), col("v"))
    return p.select("image_id", "r", "c", *[x[k].alias(k + "_") for k in "bgr"])


add("f2_hsv_to_bgr", "image_id:l r:l c:l b_:l g_:l r_:l", _round_trip, "WITH z AS (SELECT image_id, r, c, v, CAST(floor(h / 30.0::DOUBLE) AS BIGINT) % 6 AS k, v * (1 - s / 255.0::DOUBLE) AS p, v * (1 - s / 255.0::DOUBLE * (h / 30.0::DOUBLE - floor(h / 30.0::DOUBLE))) AS q, v * (1 - s / 255.0::DOUBLE * (1 - (h / 30.0::DOUBLE - floor(h / 30.0::DOUBLE)))) AS t FROM hsv) SELECT image_id, r, c, floor(CASE WHEN k IN (0, 1) THEN p WHEN k = 2 THEN t WHEN k IN (3, 4) THEN v ELSE q END + 0.5) AS b_, floor(CASE WHEN k = 0 THEN t WHEN k IN (1, 2) THEN v WHEN k = 3 THEN q ELSE p END + 0.5) AS g_, floor(CASE WHEN k IN (0, 5) THEN v WHEN k = 1 THEN q WHEN k IN (2, 3) THEN p ELSE t END + 0.5) AS r_ FROM z")
add("f3_wrap_add", "image_id:l r:l c:l x:l", lambda s, d: fx.u8(s, d).withColumn("x", pixels.wrap_add(col("b"), F.lit(-150))), "SELECT image_id, r, c, (b - 150 + 256) % 256 AS x FROM u8")
add("f4_saturating_add", "image_id:l r:l c:l x:l", lambda s, d: fx.u8(s, d).withColumn("x", pixels.saturating_add(col("b"), (col("r") - 4) * 30.25)), "SELECT image_id, r, c, least(255, greatest(0, floor(b + (r - 4) * 30.25 + 0.5))) AS x FROM u8")
add("f5_uniform", "image_id:l x:d", lambda s, d: _ids(s, d).withColumn("x", draws.uniform(col("image_id"), "sat", -5, 5)), f"SELECT vec_id AS image_id, -5 + {draw_sql('vec_id', 'sat')} * 10 AS x FROM embeddings")
add("f6_integer", "image_id:l x:l", lambda s, d: _ids(s, d).withColumn("x", draws.integer(col("image_id"), "hue", -30, 30)), f"SELECT vec_id AS image_id, -30 + floor({draw_sql('vec_id', 'hue')} * 61) AS x FROM embeddings")
add("f7_gate", "image_id:l x:l", lambda s, d: _ids(s, d).withColumn("x", draws.gate(col("image_id"), "hflip").cast("int")), f"SELECT vec_id AS image_id, CAST({draw_sql('vec_id', 'hflip')} < 0.5 AS INT) AS x FROM embeddings")
add("f8_round", "image_id:l r:l c:l x:l", lambda s, d: fx.u8(s, d).withColumn("x", pixels.round_half_away((col("b") - 128) / 2.0)), "SELECT image_id, r, c, round((b - 128) / 2.0::DOUBLE) AS x FROM u8")
add("f9_trigonometry", "image_id:l r:l c:l s:d k:d q:d", lambda s, d: fx.raster8(s, d).select("image_id", "r", "c", pixels.rotation(col("v") * 90)[1].alias("s"), pixels.rotation(col("v") * 90)[0].alias("k"), F.sqrt(F.abs("v")).alias("q")), "SELECT image_id, r, c, sin(radians(v * 90)) AS s, cos(radians(v * 90)) AS k, sqrt(abs(v)) AS q FROM r8")


def _affine(spark: SparkSession, d: str) -> DataFrame:
    m = augment.affine(SHAPE, rotate=(-30, 30))
    det = m["m_a"] * m["m_d"] - m["m_b"] * m["m_c"]
    return _ids(spark, d).select("image_id", *[m[f"m_{k}"].alias(f"m_{k}") for k in "abcdxy"], (m["m_d"] / det).alias("inv_a"))


add("f10_affine", "image_id:l m_a:d m_b:d m_c:d m_d:d m_x:d m_y:d inv_a:d", _affine, f"WITH z AS (SELECT vec_id AS image_id, 0.9 + {draw_sql('vec_id', 'scale')} * (1.1::DOUBLE - 0.9::DOUBLE) AS k, sqrt(0.9 + {draw_sql('vec_id', 'aspect')} * (1.1::DOUBLE - 0.9::DOUBLE)) AS a, radians(-30 + {draw_sql('vec_id', 'angle')} * 60) AS g, round((-0.1 + {draw_sql('vec_id', 'dx')} * 0.2) * 8) AS m_x, round((-0.1 + {draw_sql('vec_id', 'dy')} * 0.2) * 8) AS m_y FROM embeddings), y AS (SELECT *, cos(g) * k * a AS m_a, -sin(g) * k / a AS m_b, sin(g) * k / a AS m_c FROM z) SELECT image_id, m_a, m_b, m_c, m_a AS m_d, m_x, m_y, m_a / (m_a * m_a - m_b * m_c) AS inv_a FROM y")
add("f11_sigmoid", "image_id:l r:l c:l x:d", lambda s, d: fx.raster8(s, d).withColumn("x", pixels.sigmoid(col("v") * 10)), "SELECT image_id, r, c, 1 / (1 + exp(-v * 10)) AS x FROM r8")
add("f12_relu", "image_id:l r:l c:l x:d", lambda s, d: fx.raster8(s, d).withColumn("x", pixels.relu(col("v"))), "SELECT image_id, r, c, greatest(v, 0) AS x FROM r8")
add("f13_substring", "path:s x:s", lambda s, d: fx.catalogue(s, d)[0].withColumn("x", pixels.without_end(col("path"), 8)), "SELECT path, path[:-9] AS x FROM images")
add("f14_contains", "path:s x:l", lambda s, d: _all_files(s, d).withColumn("x", pixels.is_image_name(col("path")).cast("int")), "SELECT path, CAST(contains(path, 'sat') AS INT) AS x FROM (SELECT * FROM images UNION ALL SELECT * FROM masks)")
add("f15_format_path", "image_id:l x:s", lambda s, d: _ids(s, d).withColumn("x", pixels.image_name(col("image_id"))), "SELECT vec_id AS image_id, vec_id || '_sat.jpg' AS x FROM embeddings")
add("f16_format_number", "run:l epoch:l x:s", lambda s, d: fx.runs(s, d).withColumn("x", pixels.loss_line(col("loss"), col("epoch"))), "SELECT run, epoch, format('{:.6f} {:.2f} {}', loss, loss, epoch) AS x FROM runs")

# Augmentations ---------------------------------------------------------------------------------------------------

add("g1_random_hsv", "image_id:l ch:l r:l c:l b:l", lambda s, d: augment.random_hsv(fx.patch3(s, d)), "SELECT * FROM coloured")
add("g2_random_ssr", "image_id:l r:l c:l b:l", lambda s, d: augment.random_ssr(fx.u8(s, d), SHAPE), "SELECT * FROM warped")
add("g3_random_hflip", "image_id:l r:l c:l b:l", lambda s, d: augment.random_hflip(fx.u8(s, d), SHAPE), fx.turn_sql("u8", "b", ("hflip",)))
add("g4_random_vflip", "image_id:l r:l c:l b:l", lambda s, d: augment.random_vflip(fx.u8(s, d), SHAPE), fx.turn_sql("u8", "b", ("vflip",)))
add("g5_random_rot90", "image_id:l r:l c:l b:l", lambda s, d: augment.random_rot90(fx.u8(s, d), SHAPE), fx.turn_sql("u8", "b", ("rot90",)))
add("g6_augment_images", "image_id:l ch:l r:l c:l x:d", lambda s, d: augment.augment(fx.patch3(s, d), fx.u8(s, d), SHAPE)[0], f"SELECT image_id, ch, r, c, b / 255.0::DOUBLE * 3.2 - 1.6 AS x FROM ({fx.turn_sql('warped3', 'ch, b')})")
add("g6_augment_masks", "image_id:l r:l c:l t:l", lambda s, d: augment.augment(fx.patch3(s, d), fx.u8(s, d), SHAPE)[1], f"SELECT image_id, r, c, CAST(b >= 128 AS INT) AS t FROM ({fx.turn_sql('warped', 'b')})")
add("g7_ssr_with_turn", "image_id:l r:l c:l b:l", lambda s, d: augment.random_ssr(fx.u8(s, d), SHAPE, rotate=(-30, 30)), "SELECT * FROM warped_turn")



def _augmented(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.rasters3(spark, d).join(fx.grey1(spark, d), "image_id")
    out = score.numbers_of(augment_rasters.augment_rasters(rows, dtype="float64"), "x", "float64")
    cells = out.select("image_id", F.posexplode("x").alias("p", "x"))
    return cells.select("image_id", F.floor(col("p") / 64).alias("ch"), F.floor(col("p") % 64 / 8).alias("r"), (col("p") % 8).alias("c"), "x")


add("g6_augment_raster_rows", "image_id:l ch:l r:l c:l x:d", _augmented, f"SELECT image_id, ch, r, c, b / 255.0::DOUBLE * 3.2 - 1.6 AS x FROM ({fx.turn_sql('warped3', 'ch, b')})")

# Scoring ---------------------------------------------------------------------------------------------------------


_BANDS = {"factory": score.logistic_factory(weights=(0.2, 0.5, -0.3)), "dtype": "float64"}


def _scores(df: DataFrame) -> DataFrame:
    """Scored raster rows as a pixel table of q."""
    return layouts.pixels_of(score.numbers_of(df, "q", "float64").select("image_id", "q"), 8, "q", "q")


add("t1_score_batches", "image_id:l r:l c:l q:d", lambda s, d: _scores(score.score_rasters(fx.rasters3(s, d), batch_size=8, **_BANDS)), "SELECT * FROM scored3")
add("t2_score_one", "image_id:l r:l c:l p:l", lambda s, d: score.score(fx.u8(s, d).where("image_id = 7"), score.logistic()).withColumn("p", pixels.binarise_pred(col("q"))), "SELECT image_id, r, c, CASE WHEN q > 0.5 THEN 1 ELSE 0 END AS p FROM scored1 WHERE image_id = 7")
add("t3_score_paths", "image_id:s r:l c:l q:d p:l", lambda s, d: _scores(jobs.score_paths(s, _png_dir(s, d), **_BANDS)).withColumn("p", pixels.binarise_pred(col("q"))), "SELECT image_id, r, c, q, CASE WHEN q > 0.5 THEN 1 ELSE 0 END AS p FROM scored3")
add("t4_tta_views", "image_id:l view:l r:l c:l b:l", lambda s, d: score.tta_views(fx.u8(s, d), SHAPE), "SELECT image_id, view, r, c, b FROM viewed")
add("t5_tta_invert", "image_id:l view:l r:l c:l q:d", lambda s, d: score.tta_invert(score.score(score.tta_views(fx.u8(s, d), SHAPE), score.logistic()), SHAPE), "SELECT * FROM inverted")
add("t6_tta_score", "image_id:l r:l c:l q:d", lambda s, d: score.tta_score(fx.u8(s, d), score.logistic(), SHAPE), "SELECT * FROM merged")
add("t6_tta_score_fused", "image_id:l r:l c:l q:d", lambda s, d: _scores(score.score_rasters(fx.rasters3(s, d), batch_size=8, views=True, **_BANDS)), "SELECT * FROM merged3")


def _job(spark: SparkSession, d: str) -> DataFrame:
    dst = shared.scratch(spark, "predicted")
    jobs.predict_job(spark, _png_dir(spark, d), dst, **_BANDS)
    return _image_sums(images.scan_images(spark, dst, "*_mask.*", named=pixels.mask_id))


add("t7_predict_job", "image_id:s ch:l total:l placed:l n:l", _job, _SUMS.format("(SELECT image_id, ch, r, c, CASE WHEN q > 4 THEN 255 ELSE 0 END AS b FROM merged3, range(3) t(ch))"))

# Map algebra -----------------------------------------------------------------------------------------------------

_FOCAL = "SELECT s.image_id, r - (i - 1) * {d} AS r, c - (j - 1) * {d} AS c, sum(w * v) AS v FROM {src} s, k3 WHERE r - (i - 1) * {d} BETWEEN 0 AND 7 AND c - (j - 1) * {d} BETWEEN 0 AND 7 GROUP BY ALL"
add("m1_focal", "image_id:l r:l c:l v:d", lambda s, d: algebra.focal(fx.raster8(s, d), K3, SHAPE, dilation=2), _FOCAL.format(src="r8", d=2))
_RELU = "SELECT image_id, r, c, greatest(v, 0) AS v FROM ({})"
_STEPS = [_RELU.format(_FOCAL.format(src="r8", d=1)), _RELU.format(_FOCAL.format(src="step1", d=2)), _RELU.format(_FOCAL.format(src="step2", d=4))]
add("m2_multi_rate_focal", "image_id:l r:l c:l v:d", lambda s, d: algebra.multi_rate_focal(fx.raster8(s, d), K3, SHAPE, rates=(1, 2, 4)).withColumn("v", col("v") / 1000), f"WITH step1 AS ({_STEPS[0]}), step2 AS ({_STEPS[1]}), step3 AS ({_STEPS[2]}) SELECT image_id, r, c, sum(v) / 1000 AS v FROM (SELECT image_id, r, c, v FROM r8 UNION ALL SELECT * FROM step1 UNION ALL SELECT * FROM step2 UNION ALL SELECT * FROM step3) GROUP BY ALL")
add("m3_block_max", "image_id:l r:l c:l v:d", lambda s, d: algebra.block_max(fx.raster8(s, d)), "SELECT image_id, r // 2 AS r, c // 2 AS c, max(v) AS v FROM r8 GROUP BY ALL")
add("m4_upsample", "image_id:l r:l c:l v:d", lambda s, d: algebra.upsample(fx.raster8(s, d), K4, SHAPE), "SELECT image_id, 2 * r + i - 1 AS r, 2 * c + j - 1 AS c, sum(w * v) AS v FROM r8, k4 WHERE 2 * r + i - 1 BETWEEN 0 AND 15 AND 2 * c + j - 1 BETWEEN 0 AND 15 GROUP BY ALL")
add("m5_standardise", "image_id:l ch:l r:l c:l b:d", lambda s, d: algebra.standardise(fx.patch3(s, d)), "SELECT image_id, p.ch, r, c, (b - m) / sqrt(s + 1e-5) AS b FROM patch3 p JOIN (SELECT ch, avg(b) AS m, var_pop(b) AS s FROM patch3 GROUP BY ch) x ON p.ch = x.ch")


def _rows8(spark: SparkSession, d: str) -> DataFrame:
    n = F.size("data")
    return fx.arrays8(spark, d).select("image_id", F.ceil(n / 8).cast("int").alias("height"), F.least(n, F.lit(8)).alias("width"), col("data").alias("v"))


def _raster_rows(name: str, make: Callable[[DataFrame], DataFrame], width: int, scale: int = 1) -> None:
    """The raster-row form of a query above, with the same SQL."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        out = make(_rows8(spark, d)).select("image_id", "v")
        return layouts.pixels_of(out, width, "v").withColumn("v", col("v") / scale)

    add(f"{name}_raster_rows", "image_id:l r:l c:l v:d", query)
    SQL[f"{name}_raster_rows"] = SQL[name]


_raster_rows("m1_focal", lambda x: algebra_rasters.focal(x, K3, dilation=2, numbers=True), 8)
_raster_rows("m2_multi_rate_focal", lambda x: algebra_rasters.multi_rate_focal(x, K3, rates=(1, 2, 4), numbers=True), 8, 1000)
_raster_rows("m3_block_max", lambda x: algebra_rasters.block_max(x, numbers=True), 4)
_raster_rows("m4_upsample", lambda x: algebra_rasters.upsample(x, K4, numbers=True), 16)


TILE = 3  # so that a tile row has three tiles, the last smaller


def _tiles8(spark: SparkSession, d: str) -> DataFrame:
    return tiles.cut_tiles(_rows8(spark, d), TILE)


def _byte_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles.cut_tiles(fx.grey1(spark, d).select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), col("mask").alias("v")), TILE, "uint8")


add("m1_focal_tiles", "image_id:l r:l c:l v:d", lambda s, d: tiles.tile_pixels(tiles.focal(_tiles8(s, d), K3, dilation=2)))
add("m2_multi_rate_focal_tiles", "image_id:l r:l c:l v:d", lambda s, d: tiles.tile_pixels(tiles.multi_rate_focal(_tiles8(s, d), K3, rates=(1, 2, 4))).withColumn("v", col("v") / 1000))
add("m4_upsample_tiles", "image_id:l r:l c:l v:d", lambda s, d: tiles.tile_pixels(tiles.upsample(_tiles8(s, d), K4)))
add("g2_random_ssr_tiles", "image_id:l r:l c:l b:l", lambda s, d: tiles.tile_pixels(tiles.random_ssr(_byte_tiles(s, d)), "uint8").withColumnRenamed("v", "b"))
add("g7_ssr_with_turn_tiles", "image_id:l r:l c:l b:l", lambda s, d: tiles.tile_pixels(tiles.random_ssr(_byte_tiles(s, d), rotate=(-30, 30)), "uint8").withColumnRenamed("v", "b"))
add("t4_tta_views_tiles", "image_id:l view:l r:l c:l b:l", lambda s, d: tiles.tile_pixels(tiles.view_tiles(_byte_tiles(s, d), "uint8"), "uint8").withColumnRenamed("v", "b"))


def _view_scores(spark: SparkSession, d: str) -> DataFrame:
    """Tiles scored in each view and turned back."""
    return tiles.score_each_view(_byte_tiles(spark, d), tiles.logistic_tiles(), dtype="float64")


def _tiles3(spark: SparkSession, d: str) -> DataFrame:
    return tiles.cut_tiles(fx.rasters3(spark, d).withColumnRenamed("data", "v"), TILE, "uint8", interleaved=True)


add("t5_tta_invert_tiles", "image_id:l view:l r:l c:l q:d", lambda s, d: tiles.tile_pixels(_view_scores(s, d)).withColumnRenamed("v", "q"))
add("t6_tta_merge_tiles", "image_id:l r:l c:l q:d", lambda s, d: tiles.tile_pixels(tiles.merge_views(_view_scores(s, d))).withColumnRenamed("v", "q"))
add("t6_tta_score_tiles", "image_id:l r:l c:l q:d", lambda s, d: tiles.tile_pixels(tiles.score_tiles(_tiles3(s, d), tiles.logistic_tiles(weights=(0.2, 0.5, -0.3)), views=True, dtype="float64")).withColumnRenamed("v", "q"))
for _name, _whole in (("m1_focal_tiles", "m1_focal"), ("m2_multi_rate_focal_tiles", "m2_multi_rate_focal"), ("m4_upsample_tiles", "m4_upsample"), ("g2_random_ssr_tiles", "g2_random_ssr"), ("g7_ssr_with_turn_tiles", "g7_ssr_with_turn"), ("t4_tta_views_tiles", "t4_tta_views"), ("t5_tta_invert_tiles", "t5_tta_invert"), ("t6_tta_merge_tiles", "t6_tta_score"), ("t6_tta_score_tiles", "t6_tta_score_fused")):
    SQL[_name] = SQL[_whole]


def _frozen(spark: SparkSession, d: str) -> DataFrame:
    """Statistics saved as a table, and applied as they were read back."""
    path = shared.scratch(spark, "statistics")
    algebra.channel_statistics(fx.patch3(spark, d)).write.parquet(path)
    return algebra.standardise(fx.patch3(spark, d), statistics=spark.read.parquet(path))


add("m5_standardise_frozen", "image_id:l ch:l r:l c:l b:d", _frozen, "SELECT image_id, p.ch, r, c, (b - m) / sqrt(s + 1e-5) AS b FROM patch3 p JOIN (SELECT ch, avg(b) AS m, var_pop(b) AS s FROM patch3 GROUP BY ch) x ON p.ch = x.ch")
add("m6_raster_add", "image_id:l r:l c:l v:d", lambda s, d: algebra.raster_add(fx.raster8(s, d).drop("label"), fx.raster8(s, d).select((col("image_id") - 1).alias("image_id"), "r", "c", "v")), "SELECT a.image_id, a.r, a.c, a.v + b.v AS v FROM r8 a JOIN r8 b ON a.image_id = b.image_id - 1 AND a.r = b.r AND a.c = b.c")
add("m7_band_math", "image_id:l ch:l r:l c:l v:d", lambda s, d: algebra.band_math(fx.patch3(s, d), [[0.114, 0.587, 0.299], [1, -1, 0]]), "SELECT image_id, o AS ch, r, c, sum(b * CASE WHEN o = 0 THEN CASE ch WHEN 0 THEN 0.114 WHEN 1 THEN 0.587 ELSE 0.299 END ELSE CASE ch WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END END::DOUBLE) AS v FROM patch3, range(2) t(o) GROUP BY ALL")

def _bands3(spark: SparkSession, d: str) -> DataFrame:
    return algebra_rasters.bands_first(fx.rasters3(spark, d))


def _band_pixels(rows: DataFrame, value: str) -> DataFrame:
    """Raster rows of 8x8 images as image_id, ch, r, c and the value."""
    cells = rows.select("image_id", F.posexplode("v").alias("p", value))
    return cells.select("image_id", F.floor(col("p") / 64).alias("ch"), F.floor(col("p") % 64 / 8).alias("r"), (col("p") % 8).alias("c"), value)


def _next(rows: DataFrame) -> DataFrame:
    return rows.withColumn("image_id", col("image_id") - 1)


add("m5_standardise_raster_rows", "image_id:l ch:l r:l c:l b:d", lambda s, d: _band_pixels(algebra_rasters.standardise(_bands3(s, d), numbers=True), "b"))
add("m6_raster_add_raster_rows", "image_id:l r:l c:l v:d", lambda s, d: _band_pixels(algebra_rasters.raster_add(_rows8(s, d), _next(_rows8(s, d)), numbers=True), "v"))
add("m7_band_math_raster_rows", "image_id:l ch:l r:l c:l v:d", lambda s, d: _band_pixels(algebra_rasters.band_math(_bands3(s, d), [[0.114, 0.587, 0.299], [1, -1, 0]], numbers=True), "v"))
add("u4_concat_channels_raster_rows", "image_id:l ch:l r:l c:l b:l", lambda s, d: _band_pixels(algebra_rasters.concat_channels(_bands3(s, d), algebra_rasters.map_rasters(_bands3(s, d), lambda x: 255 - x), numbers=True), "b"))
# of one band the bytes are in order as they are
add("p11_invert_mask_raster_rows", "image_id:l r:l c:l t:l", lambda s, d: _band_pixels(algebra_rasters.binarise_masks(fx.grey1(s, d).select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), col("mask").alias("v")), invert=True, dtype="uint8", numbers=True), "t"))
for _name in ("m5_standardise", "m6_raster_add", "m7_band_math", "u4_concat_channels", "p11_invert_mask"):
    SQL[f"{_name}_raster_rows"] = SQL[_name]

_CHAIN = ("hflip", "rot90", "vflip", "rot90", "hflip", "rot90")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return symmetry.apply(fx.u8(spark, d), symmetry.chain(*_CHAIN), SHAPE)


_CHAIN_SQL = "SELECT image_id, r, c, b FROM u8"
for _step in _CHAIN:
    _CHAIN_SQL = {"hflip": f"SELECT image_id, r, 7 - c AS c, b FROM ({_CHAIN_SQL})", "vflip": f"SELECT image_id, 7 - r AS r, c, b FROM ({_CHAIN_SQL})", "rot90": f"SELECT image_id, 7 - c AS r, r AS c, b FROM ({_CHAIN_SQL})"}[_step]
add("g5_folded_chain", "image_id:l r:l c:l b:l", _folded, _CHAIN_SQL)
add("g5_gated_turns_folded", "image_id:l r:l c:l b:l", lambda s, d: symmetry.random_turns(fx.u8(s, d), SHAPE), fx.turn_sql("u8", "b"))

# Streaming and plug-ins ------------------------------------------------------------------------------------------


def _monitor(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, monitor.STATE_STORE)
    try:
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        # the event number stands for the epoch: it grows within a run
        return monitor.run_available(monitor.monitor(stream.select(col("user_id").alias("run"), col("event_id").alias("epoch"), col("value").alias("loss"))), shared.scratch(spark, "monitor"))
    finally:
        spark.conf.set(key, was)


add("x1_stream_monitor", "run:l epoch:l best:d improved:l no_optim:l cuts:l", _monitor, "SELECT e.user_id AS run, e.event_id AS epoch, best, improved, no_optim, cuts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events) e JOIN rates s ON e.user_id = s.run AND e.epoch = s.epoch")


#: Epochs of a log that runs share: some 5 MB.
_LOG_EPOCHS = 50_000


def _streaming(make: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
    """``make`` with the state store that the monitor needs."""

    def run(spark: SparkSession) -> DataFrame:
        key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set(key, monitor.STATE_STORE)
        try:
            return make(spark)
        finally:
            spark.conf.set(key, was)

    return run


def _tailed(spark: SparkSession, d: str) -> DataFrame:
    """Text logs read as they grow: the first epochs of every run, then all of them, each once."""
    path, to = shared.scratch(spark, "growing"), shared.scratch(spark, "tailed")
    r = fx.runs(spark, d)
    files = 1 + r.count() // _LOG_EPOCHS
    for part in (r.where("epoch <= 30"), r):
        filesink.write_set(runlog.growing_logs(part, files), path, "append")  # by the same names: what is written again is longer
        out = monitor.run_available(logtail.tail_run_logs(spark, path), to)
    return out


add("s8_tail_run_log", "run:l epoch:l elapsed_s:l loss:d height:l width:l", _tailed)
SQL["s8_tail_run_log"] = SQL["s8_read_run_log"]


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """The monitor over two batches, its state carried from one to the other."""
    src, to = shared.scratch(spark, "epochs"), shared.scratch(spark, "resumed")
    r = fx.runs(spark, d).select("run", "epoch", "loss")
    for part in (r.where("epoch <= 30"), r.where("epoch > 30")):
        part.write.mode("append").parquet(src)
        out = _streaming(lambda s: monitor.run_available(monitor.monitor(s.readStream.schema(r.schema).parquet(src)), to))(spark)
    return out


def _warm(spark: SparkSession, d: str) -> DataFrame:
    """The monitor from a saved table of the batch form's states, over what comes after."""
    src, saved = shared.scratch(spark, "epochs"), shared.scratch(spark, "states")
    r = fx.runs(spark, d).select("run", "epoch", "loss")
    monitor.state_of(r.where("epoch <= 20")).write.parquet(saved)
    r.where("epoch > 20").write.parquet(src)
    return _streaming(lambda s: monitor.run_available(monitor.monitor(s.readStream.schema(r.schema).parquet(src), known=s.read.parquet(saved)), shared.scratch(s, "warm")))(spark)


_RATES = "run:l epoch:l best:d improved:l no_optim:l cuts:l"
add("x1_resumed", _RATES, _resumed, "SELECT run, epoch, best, improved, no_optim, cuts FROM rates")
add("x1_warm_start", _RATES, _warm, "SELECT run, epoch, best, improved, no_optim, cuts FROM rates WHERE epoch > 20")


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    return _scores(monitor.run_available(monitor.score_stream(spark, _png_dir(spark, d), **_BANDS), shared.scratch(spark, "arrived")))


def _stream_masks(spark: SparkSession, d: str) -> DataFrame:
    """Images scored as they arrive, their masks written by the committing sink and read back."""
    dst = shared.scratch(spark, "stream-masks")
    filesink.write_stream(jobs.mask_files(images.scan_images(spark, _png_dir(spark, d), streaming=True), **_BANDS), dst, shared.scratch(spark, "stream-state")).awaitTermination()
    return _image_sums(images.scan_images(spark, dst, "*_mask.*", named=pixels.mask_id))


add("x2_stream_masks", "image_id:s ch:l total:l placed:l n:l", _stream_masks)
SQL["x2_stream_masks"] = SQL["t7_predict_job"]
add("x2_stream_scores", "image_id:s r:l c:l q:d", _arriving, "SELECT * FROM merged3")
add("x3_plugin_model", "image_id:l r:l c:l q:d", lambda s, d: score.score(fx.u8(s, d), lambda x, r, c: pixels.sigmoid(x * 2 - r + c)), "SELECT image_id, r, c, 1 / (1 + exp(-((b / 255.0::DOUBLE * 3.2 - 1.6) * 2 - r + c))) AS q FROM u8")
add("x4_plugin_loss", "label:l mse:d", lambda s, d: metrics.evaluate(fx.pairs(s, d), {"mse": lambda t, q: F.avg((t - q) * (t - q))}, ["label"]), "SELECT label, avg((t - q) * (t - q)) AS mse FROM pairs GROUP BY 1")


def _plugin_rows(spark: SparkSession, d: str) -> DataFrame:
    """The plug-in loss as a mergeable state over raster rows: count and sum of squares."""
    cells = F.sort_array(F.collect_list(F.struct("r", "c", "t", "q")))
    rows = fx.pairs(spark, d).groupBy("image_id", "label").agg(F.transform(cells, lambda x: x["q"]).alias("v"), F.unhex(F.array_join(F.transform(cells, lambda x: F.lpad(F.hex(x["t"]), 2, "0")), "")).alias("t"))
    rows = algebra_rasters.bytes_of(rows).withColumnRenamed("v", "q")
    add_one = lambda s, t, q: s + [len(t), ((t - q) ** 2).sum()]
    return metrics.raster_aggregate(rows, lambda: np.zeros(2), add_one, lambda a, b: a + b, {"mse": lambda s: s[1] / s[0]}, ["label"], "float64")


add("x4_plugin_loss_raster_rows", "label:l mse:d", _plugin_rows)
SQL["x4_plugin_loss_raster_rows"] = SQL["x4_plugin_loss"]


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Connected regions of the binary masks, by a table function in SQL."""
    rows = algebra_rasters.bands_first(fx.grey1(spark, d).select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), col("mask").alias("data")), dtype="uint8")
    return regions.regions(algebra_rasters.binarise_masks(rows, 128, dtype="uint8").withColumnRenamed("v", "data"))


_REACH = """SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY first) AS region, count(*) AS area, min(p // 8) AS top, min(p % 8) AS "left", max(p // 8) AS bottom, max(p % 8) AS "right"
FROM (SELECT image_id, p, min(a) AS first FROM (WITH RECURSIVE px AS (SELECT image_id, r * 8 + c AS p FROM u8 WHERE b >= 128),
side AS (SELECT x.image_id, x.p, y.p AS n FROM px x JOIN px y ON x.image_id = y.image_id AND abs(x.p // 8 - y.p // 8) + abs(x.p % 8 - y.p % 8) = 1),
reach AS (SELECT image_id, p AS a, p FROM px UNION SELECT reach.image_id, a, n FROM reach JOIN side ON reach.image_id = side.image_id AND reach.p = side.p)
SELECT * FROM reach) AS reached GROUP BY 1, 2) AS named GROUP BY image_id, first"""
add("x3_region_rows", "image_id:l region:l area:l top:l left:l bottom:l right:l", _regions)
SQL["x3_region_rows"] = f"""WITH r8 AS ({fx.CTE["r8"]}), u8 AS ({fx.CTE["u8"]}) SELECT CAST(image_id AS BIGINT) AS image_id, CAST(region AS BIGINT) AS region, CAST(area AS BIGINT) AS area, CAST(top AS BIGINT) AS top, CAST("left" AS BIGINT) AS "left", CAST(bottom AS BIGINT) AS bottom, CAST("right" AS BIGINT) AS "right" FROM ({_REACH}) AS result"""
add("x5_plugin_loader", "image_id:l r:l c:l x:d", lambda s, d: fx.u8(s, d).transform(lambda df: augment.random_hflip(df, SHAPE, u=1.0)).withColumn("x", pixels.normalise(col("b"))), "SELECT image_id, r, 7 - c AS c, b / 255.0::DOUBLE * 3.2 - 1.6 AS x FROM u8")


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    """Eight-view scoring, threshold, and overlap with the truth for each label."""
    mask = score.tta_score(fx.u8(spark, d), score.logistic(), SHAPE).select("image_id", "r", "c", (pixels.tta_threshold(col("q")) / 255).alias("q"))
    labels = fx.table(spark, d, "embeddings").select(col("vec_id").alias("image_id"), "label")
    both = metrics.align(mask, fx.truth(spark, d)).join(labels, "image_id")
    return metrics.evaluate(both, {"dice": metrics.dice_agg, "iou": metrics.iou_agg}, ["label"])


add("flagship_tta_dice", "label:l dice:d iou:d", _flagship, f"SELECT label, {_DICE} AS dice, sum(t * q) / nullif(sum(t) + sum(q) - sum(t * q), 0) AS iou FROM (SELECT e.label, t, CASE WHEN m.q > 4 THEN 1.0 ELSE 0.0 END AS q FROM merged m JOIN truth USING (image_id, r, c) JOIN embeddings e ON e.vec_id = m.image_id) GROUP BY 1")
