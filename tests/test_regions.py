import random

import numpy as np

from tilewright.operators import pairing, regions
from tilewright.sources import bucketed


def flood(mask):
    """Regions one by one, by a walk from each first pixel."""
    seen, out = np.zeros(mask.shape, bool), []
    for r, c in np.argwhere(mask > 0).tolist():
        if seen[r, c]:
            continue
        todo, cells = [(r, c)], []
        seen[r, c] = True
        while todo:
            y, x = todo.pop()
            cells.append((y, x))
            for y2, x2 in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= y2 < mask.shape[0] and 0 <= x2 < mask.shape[1] and not seen[y2, x2] and mask[y2, x2] == mask[r, c]:
                    seen[y2, x2] = True
                    todo.append((y2, x2))
        ys, xs = zip(*cells, strict=True)
        out.append((len(out) + 1, int(mask[r, c]), len(cells), min(ys), min(xs), max(ys), max(xs)))
    return out


def test_regions(spark):
    rng = random.Random(2)
    shapes = [(rng.randint(1, 12), rng.randint(1, 12)) for _ in range(60)]
    masks = [np.array([[rng.choice([0, 0, 1, 1, 7]) for _ in range(w)] for _ in range(h)], np.uint8) for h, w in shapes]
    rows = [(i, *m.shape, bytearray(m.tobytes()), "x") for i, m in enumerate(masks)] + [(100, 2, 2, None, ""), (101, -1, -1, bytearray(), ""), (102, 2, 2, bytearray(4), ""), (103, 2, 2, bytearray(b"abc"), "")]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, data binary, region string").repartition(3)
    got = sorted(tuple(r) for r in regions.regions(df).collect())
    assert got == sorted((i, *x) for i, m in enumerate(masks) for x in flood(m))
    assert regions.regions(df.where("false")).count() == 0


def test_bucketed_tables_pair_without_a_shuffle(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(500).selectExpr("id AS image_id", "id * 2 AS x")
        b = spark.range(0, 600, 3).selectExpr("id AS image_id", "id + 1 AS y")
        plain = pairing.pair(a, b)
        for df, name in ((a, "tw_images"), (b, "tw_masks")):
            bucketed.save(df, name, 8)
        stored = [bucketed.load(spark, n) for n in ("tw_images", "tw_masks")]
        joined, audit = pairing.pair(*stored), pairing.raster_audit(*stored)
        assert bucketed.shuffles(plain) == 2 and bucketed.shuffles(joined) == bucketed.shuffles(audit) == 0
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))
        assert sorted(map(tuple, audit.collect())) == sorted(map(tuple, pairing.raster_audit(a, b).collect()))
    finally:
        for n in ("tw_images", "tw_masks"):
            spark.sql(f"DROP TABLE IF EXISTS {n}")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
