"""Alignment of batches, planes, world normalisation and measures of images, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomweave.operators import alignment, crops, images, masks, paths
from roomweave.plans import queries


def turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def shared_rows(track, batch, new, old):
    return [(track, batch, *map(float, [*o, *n])) for n, o in zip(new, old)]


SHARED = "track string, batch int, px double, py double, pz double, nx double, ny double, nz double"


def test_batches(spark):
    """Frames in one world, seen by batches in frames of their own, come back to the first one's."""
    rng = np.random.default_rng(1)
    world = rng.normal(size=(20, 3))
    own = [(1.0, np.eye(3), np.zeros(3)), (2.0, turn(rng), rng.normal(size=3)), (0.5, turn(rng), rng.normal(size=3))]
    places = lambda k, rows: own[k][0] * world[rows] @ own[k][1].T + own[k][2]
    rows = shared_rows("a", 1, places(1, slice(4, 8)), places(0, slice(4, 8))) + shared_rows("a", 2, places(2, slice(8, 12)), places(1, slice(8, 12)))
    rows += shared_rows("b", 1, np.ones((3, 3)), rng.normal(size=(3, 3)))  # a batch that does not move
    pairs = alignment.pair_similarities(spark.createDataFrame(rows, SHARED)).checkpoint()
    found = {(r.track, r.batch): r for r in pairs.collect()}
    assert found["a", 1].error < 1e-9 and found["a", 2].error < 1e-9 and found["a", 1].n == 4
    assert found["b", 1].scale == 1 and found["b", 1].r == np.eye(3).ravel().tolist() and found["b", 1].t == [0, 0, 0]
    chained = alignment.registered(pairs, spark.createDataFrame([("a", 0), ("b", 0)], "track string, batch int")).checkpoint()
    for r in chained.where("track = 'a'").collect():
        back = r.scale * places(r.batch, slice(0, 20)) @ np.array(r.r).reshape(3, 3).T + r.t
        assert np.allclose(back, world)
    # a pose of batch 2 whose camera stands at a place of that batch stands at the world's place afterwards
    q = turn(rng)
    stands = places(2, slice(13, 14))[0]
    poses = spark.createDataFrame([("a", 2, 5, q.ravel().tolist(), (-q @ stands).tolist(), 4), ("a", 2, 3, q.ravel().tolist(), [0.0] * 3, 4)], "track string, batch int, ord int, r array<double>, t array<double>, n_shared int")
    (r,) = alignment.aligned_poses(poses, chained).collect()
    m = np.array(r.r).reshape(3, 3)
    assert r.ord == 5 and np.allclose(np.linalg.solve(m, -np.array(r.t)), world[13])


def test_no_batches(spark):
    assert alignment.pair_similarities(spark.createDataFrame([], SHARED)).count() == 0


def test_plane(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(200, 3)) * [5, 0.1, 3] @ turn(rng)
    (r,) = crops.plane_fit(spark.createDataFrame(p.tolist(), "x double, y double, z double")).collect()
    normal = np.linalg.svd(p - p.mean(0), full_matrices=False)[2][-1]
    normal = -normal if normal[1] > 0 else normal
    assert np.allclose(r.normal, normal) and np.allclose(r.centre, p.mean(0)) and r.tilt_deg == pytest.approx(np.degrees(np.arccos(-normal[1])))
    (r,) = crops.plane_fit(spark.createDataFrame([], "x double, y double, z double")).collect()
    assert r.n == 0 and r.normal is None


def test_normalisation(spark):
    rng = np.random.default_rng(3)
    poses = []
    for _ in range(30):  # cameras roughly upright: y points down
        q, _ = np.linalg.qr(np.eye(3) + 0.2 * rng.normal(size=(3, 3)))
        q *= np.sign(np.diag(q))[None]
        poses.append((q, rng.normal(size=3)))
    (r,) = paths.normalisation(spark.createDataFrame([(q.ravel().tolist(), t.tolist()) for q, t in poses], "r array<double>, t array<double>")).collect()
    centres = np.array([-q.T @ t for q, t in poses])
    up = np.mean([-q[1] for q, _ in poses], axis=0)
    m = np.array(r.r).reshape(3, 3)
    assert np.allclose(m @ (up / np.linalg.norm(up)), [0, 1, 0]) and np.allclose(m @ m.T, np.eye(3)) and np.allclose(r.centre, centres.mean(0))
    assert np.abs(r.scale * (centres - r.centre) @ m.T).max() == pytest.approx(1)


def test_sharpness(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (5, 7)).astype(float)
    p = np.pad(image, 1, mode="reflect")
    want = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image).var()
    df = spark.createDataFrame([(image.ravel().tolist(),), ([1.0],), (None,)], "p array<double>")
    got = [r.s for r in df.select(images.sharpness(F.col("p"), 7, 5).alias("s")).collect()]
    assert got == [pytest.approx(want), -1, -1]


def test_sharpness_of_gaps(spark, tmp_path):
    """Missing pixels count as the SQL has them; images are measured over arrays, not element by element in array functions."""
    import duckdb

    rng = np.random.default_rng(6)
    rows = [rng.normal(size=64).tolist() for _ in range(40)]
    rows[3][10] = rows[4][0] = rows[4][63] = rows[5][27] = None
    rows[6] = [None] * 64
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = queries.J13_sharpness(spark, str(tmp_path))
    assert dict(map(tuple, df.select("pid", "sharpness").collect())) == dict(con.execute(queries.SQL["J13_sharpness"]).fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def test_histograms(spark):
    rows = [(1, 0.0), (1, 3.9), (1, 256.0), (1, 255.0), (2, 8.0), (2, -1.0), (3, None)]
    shares = images.histograms(spark.createDataFrame(rows, "frame int, grey double")).checkpoint()
    assert {(r.frame, r.bin): r.share for r in shares.collect()} == {(1, 0): 0.5, (1, 63): 0.5, (2, 2): 1.0}
    assert {r.frame: r.dist for r in images.from_mean(shares).collect()} == {f: pytest.approx(np.sqrt(0.375)) for f in (1, 2)}


def test_inpaint(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    mask = np.zeros((40, 50), bool)
    mask[0:4, 20:26] = True
    y, x = np.mgrid[:40, :50]
    ring = np.zeros_like(mask)
    for a, b in np.argwhere(mask):
        ring |= abs(y - a) + abs(x - b) <= 15
    want = image.astype(float)
    want[mask] = np.median(image[ring & ~mask].astype(float), axis=0)
    blurred = want.copy()
    inside = lambda v, n: -v - 1 if v < 0 else 2 * n - 1 - v if v >= n else v
    for a, b in np.argwhere(mask):
        blurred[a, b] = np.mean([want[inside(a + i, 40), inside(b + j, 50)] for i in range(-2, 3) for j in range(-2, 3)], axis=0)
    df = spark.createDataFrame([(1, 40, 50, image.tobytes(), masks.encode_mask(mask)), (2, 40, 50, image.tobytes(), masks.encode_mask(mask & False)), (3, 40, 50, image.tobytes(), masks.encode_mask(mask | True))],
                               "frame int, height int, width int, pixels binary, counts string")
    got = {r.frame: np.frombuffer(bytes(r.pixels), np.uint8).reshape(40, 50, 3) for r in images.inpaint(df).collect()}
    assert np.abs(got[1].astype(int) - blurred.astype(np.uint8)).max() <= 1 and (got[1][~mask] == image[~mask]).all()
    assert (got[2] == image).all() and (got[3] == 128).all()
