"""The library's own operators: every oracle at the smallest tables, and properties that no SQL states."""

import glob
import hashlib
import math
import os
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartweave import session
from chartweave.functions import vectors as V
from chartweave.operators import alignment as A
from chartweave.operators import clusters as K
from chartweave.operators import composition as C
from chartweave.operators import geometry as G
from chartweave.operators import graph as N
from chartweave.operators import layers
from chartweave.operators import metrics as M
from chartweave.operators import near
from chartweave.operators import report as E
from chartweave.operators import sampling as R
from chartweave.operators import sites as S
from chartweave.operators import training as L
from chartweave.operators import trajectories as W
from chartweave.operators import triplets as T
from chartweave.plans import fixtures, learning, registry
from chartweave.sources import campaigns, records, results

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle(spark, name):
    """What no SQL states: the query gives rows, its numbers are numbers, and what its operator promises holds."""
    rows = [r.asDict() for r in registry.QUERIES[name](spark, SMALL).collect()]
    assert rows and all(math.isfinite(v) for r in rows for v in r.values() if isinstance(v, float))
    if name == "trajectory_walks":
        at = {r["vec_id"]: (r["x"], r["y"]) for r in fixtures.charts(spark, SMALL).collect()}
        path = {(r["walker"], r["t"]): r["node"] for r in rows}
        assert len(path) == 5 * len(at) and all(path[w, 0] == w for w in at)
        assert all(math.dist(at[n], at[path[w, t - 1]]) <= 0.05 for (w, t), n in path.items() if t)
    elif name == "trajectory_paths":
        assert {(r["kind"], r["user_id"], r["t"]) for r in rows} == {(k, u, t) for k in ("linear", "circular", "random") for u in range(8) for t in range(12)} and len(rows) == 288
        assert {r["vec_id"] for r in rows} <= {r.vec_id for r in fixtures.charts(spark, SMALL).collect()}
    elif name.startswith("train_"):
        sites = {r.get("site", 0) for r in rows}
        for s in sites:
            own = sorted((r for r in rows if r.get("site", 0) == s), key=lambda r: r["epoch"])
            assert [r["epoch"] for r in own] == list(range(len(own)))
            changing = ("train_autoencoder", "train_normalised", "train_federated", "train_personalized")  # by the share of reconstruction, or by averages between epochs
            assert own[-1]["private"] < own[0]["private"] or name in changing and own[-1]["private"] > 0
        assert sites == (set(range(4)) if name == "train_single_site" else {0})
    elif name in ("encoded_charts", "decoded_charts"):
        width = 2 if name == "encoded_charts" else learning.WIDTH
        seen = {(r.bs_id, r.vec_id) for r in fixtures.site_charts(spark, SMALL).collect()}
        assert {(r["site"], r["key"]) for r in rows} == seen and len(rows) == len(seen)
        vectors = np.array([r["z" if width == 2 else "x"] for r in rows])
        assert vectors.shape == (len(rows), width) and np.isfinite(vectors).all() and (vectors.std(0) > 0).all()
    elif name == "trained_matching":
        assert {(r["i"], r["j"]) for r in rows} == set(fixtures.PAIRS) and all(0 <= r["foscttm"] <= 1 and r["n"] > 0 for r in rows)
    elif name == "inscribed_ellipse":
        (r,) = rows
        turn = np.linspace(0, 2 * np.pi, 50)
        assert r["a"] > 0 and r["b"] > 0
        for x, y in zip(r["cx"] + 0.99 * r["a"] * np.cos(turn), r["cy"] + 0.99 * r["b"] * np.sin(turn)):
            assert any(math.hypot(x - cx, y - cy) <= 2 * radius + 0.05 for _, cx, cy, radius in fixtures.SITES)


def cloud(spark, n, turn=0.0, flip=1.0, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, 2))
    o = np.array([[math.cos(turn), -flip * math.sin(turn)], [math.sin(turn), flip * math.cos(turn)]])
    b = a @ o
    return spark.createDataFrame([(0, 1, k, *map(float, a[k]), *map(float, b[k])) for k in range(n)], "i int, j int, vec_id long, a0 double, a1 double, b0 double, b1 double")


@pytest.mark.parametrize("flip", [1.0, -1.0])
def test_alignment_recovers_a_known_map(spark, flip):
    shared = cloud(spark, 60, 1.1, flip)
    maps = A.nearest_orthogonal(A.cross_covariance(shared))
    aligned = A.map_with(shared, maps, "matrix")
    assert A.alignment_loss(aligned).first().loss < 1e-20
    assert M.matching(aligned.selectExpr("i", "j", "vec_id", "round(a0, 9) a0", "round(a1, 9) a1", "round(b0, 9) b0", "round(b1, 9) b1")).first().foscttm == 0
    assert M.matching(shared).first().foscttm > 0.1


def test_quality_does_not_change_with_rotation(spark):
    rng = np.random.default_rng(1)
    p, z = rng.normal(size=(50, 2)), rng.normal(size=(50, 2))
    turned = z @ np.array([[0.6, -0.8], [0.8, 0.6]])
    rows = [(k, *map(float, p[k]), *map(float, z[k]), *map(float, turned[k])) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, x double, y double, u double, v double, s double, t double")
    for f in (M.continuity, M.trustworthiness):
        one, two = ([r[-1] for r in f(df, "vec_id", ["x", "y"], c, [3, 7]).collect()] for c in (["u", "v"], ["s", "t"]))
        assert one == pytest.approx(two)
    same = [r[-1] for r in M.continuity(df, "vec_id", ["x", "y"], ["x", "y"], [3]).collect()]
    assert same == [1.0]


def test_band_join_is_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(3)), k, int(rng.integers(1000))) for k in range(150)]
    df = spark.createDataFrame(rows, "g long, id long, t long")
    got = {tuple(r)[1:3] if len(r) > 2 else tuple(r) for r in T.band_join(df, df, "g", "t", "id", 40).collect()}
    want = {(a, b) for g, a, t in rows for h, b, u in rows if g == h and a != b and abs(t - u) <= 40}
    assert {tuple(sorted(x)) for x in got} == {tuple(sorted(x)) for x in want}


def agree(loss, at, gradient, rng, way):
    """The gradient along a way against differences; at a kink, where both sides' slopes differ, it must lie between them."""
    e = 1e-6
    left, right = (loss(at) - loss(at - e * way)) / e, (loss(at + e * way) - loss(at)) / e
    low, high = sorted((left, right))
    room = 1e-3 * (1 + abs(left) + abs(right)) / 2
    assert low - room <= gradient @ way <= high + room


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(1, 3), st.booleans(), st.integers(0, 10**6))
@example(8, 3, False, 1)
def test_gradients(width, layers, decoder, seed):
    """Summed gradients against differences of the losses."""
    rng = np.random.default_rng(seed)
    layers = min(layers, int(math.log2(width)) or 1)
    model = L.initial(L.Training(layers=layers, decoder=decoder, seed=seed), width, [0, 1], [(0, 1)])
    x = [rng.normal(size=(5, width)) for _ in range(3)]
    depth, flat = len(model.dims) - 1, model.nets[0] + rng.normal(0, 0.1, model.nets[0].shape)
    other = model.nets[1] + rng.normal(0, 0.1, model.nets[1].shape)
    alpha = 0.7 if decoder else 1.0
    loss = lambda f: L.private_gradient(f, model.shapes, depth, *x, 0.5, alpha)[1]
    g, _ = L.private_gradient(flat, model.shapes, depth, *x, 0.5, alpha)
    agree(loss, flat, g, rng, rng.normal(size=flat.shape))
    maps = model.maps[0, 1] + rng.normal(0, 0.2, model.maps[0, 1].shape)
    both = np.concatenate([flat, other, maps])
    pair = lambda v: L.pair_gradient((v[: flat.size], v[flat.size : 2 * flat.size]), model.shapes, depth, v[2 * flat.size :], x[0], x[1])
    agree(lambda v: pair(v)[1], both, pair(both)[0], rng, rng.normal(size=both.shape))


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients_of_normalised_decoders(spark, dropout):
    """Sums over several tasks against differences of the loss of the whole batch, whose means and variances move along."""
    rng = np.random.default_rng(5)
    spec = L.Training(method="vanilla", layers=3, decoder=True, norm=True, dropout=dropout)
    model = L.initial(spec, 8, [0, 1], [])
    model.nets = {s: flat + rng.normal(0, 0.1, flat.shape) for s, flat in model.nets.items()}
    x = {s: rng.normal(size=(3, 30, 8)) for s in (0, 1)}
    rows = [(s, -1, k, *(x[s][c, k].tolist() for c in range(3))) for s in (0, 1) for k in range(30)]
    df = spark.createDataFrame(rows, "site int, other int, key long, xa array<double>, xp array<double>, xn array<double>").repartition(4)
    normals = L.batch_normals(df, model, spec, 0.6, 2)
    sums = L.gradient_sums(df, model, spec, 0.6, normals)
    keys, depth = np.arange(30), len(model.dims) - 1
    for s in (0, 1):

        def loss(flat, s=s):
            own = L.layers_of(flat, model.shapes, model.normal)
            mask = lambda k, n: normals.masks(keys, k, n)
            z, stats = L.forward(x[s][0], own[:depth])[-1], []
            for _ in model.normal:
                y = L.normal_forward(z, own[depth:], stats, mask)[2]
                stats.append((y.mean(0), y.var(0)))
            gap = L.normal_forward(z, own[depth:], stats, mask)[2] - x[s][0]
            plain = L.private_gradient(flat[: sum(a * b + b for a, b in model.shapes[:depth])], model.shapes[:depth], depth, *x[s], spec.margin, 0.6)[1]
            return plain + 0.4 * (gap * gap).sum() / 8

        g = sums[s, -1]
        assert g[-1] == 30 and g[-2] == pytest.approx(loss(model.nets[s]))
        for _ in range(3):
            agree(loss, model.nets[s], g[:-2], rng, rng.normal(size=model.nets[s].shape))
        mean, var = model.running[s][0]
        assert np.allclose(mean, 0.1 * normals.stats[s][0][0]) and np.allclose(var, 0.9 + 0.1 * normals.stats[s][0][1] * 30 / 29)
    if dropout:
        mask = normals.masks(np.arange(4000), 0, 8)
        assert abs((mask == 0).mean() - dropout) < 0.02 and np.unique(mask).tolist() == pytest.approx([0, 1 / (1 - dropout)])
        assert not np.array_equal(mask, L.Normals(3, dropout, spec.seed, {}, {}).masks(np.arange(4000), 0, 8))
    with pytest.raises(ValueError):
        L.Training(norm=True)


@pytest.mark.parametrize("method", ["bundle", "transport"])
def test_training_lowers_the_losses(spark, method):
    model, _, _ = learning.trained(spark, SMALL, method, epochs=6)
    first, last = model.history[0], model.history[-1]
    assert last[1] + last[2] < first[1] + first[2]


def test_checkpoints_come_back(spark, tmp_path):
    model = L.initial(L.Training(), 16, [0, 1], [(0, 1)])
    model.history.append((2, 0.25, 0.5))
    path = L.save_checkpoint(model, spark, str(tmp_path), "flat")
    other = L.initial(L.Training(seed=1), 16, [0, 1], [(0, 1)])
    back = L.load_checkpoint(spark, path, other)
    assert all(np.array_equal(back.nets[s], model.nets[s]) for s in (0, 1))
    normal = L.initial(L.Training(decoder=True, norm=True), 16, [0], [])
    normal.running[0][0] = (np.full(4, 0.5), np.full(4, 2.0))
    kept = L.load_checkpoint(spark, L.save_checkpoint(normal, spark, str(tmp_path), "normal"), L.initial(L.Training(decoder=True, norm=True, seed=3), 16, [0], []))
    assert np.array_equal(kept.nets[0], normal.nets[0]) and np.array_equal(kept.running[0][0], normal.running[0][0]) and kept.normal == normal.normal
    files = spark.createDataFrame([(path,), ("x_loss9.0_",), ("no loss",)], "path string")
    assert E.best_checkpoint(files).first().loss == 0.75


def test_training_refuses_what_cannot_be(spark):
    with pytest.raises(ValueError):
        L.Training(method="none of these")
    with pytest.raises(ValueError):
        L.Training(method="flat", out=3)
    empty = spark.createDataFrame([], "site int, key long, xa array<double>, xp array<double>, xn array<double>")
    pairs = spark.createDataFrame([(0, 1)], "i int, j int")
    assert L.train(empty, None, pairs, L.Training(method="vanilla", epochs=1), 4).nets == {}


def record(csi, position, time):
    return records.frame(campaigns.snapshot_message(csi, position, time))


def test_record_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    csi = [rng.normal(size=16).astype("f4") for _ in range(5)]
    position = lambda k: b"zz\x22\x18" + struct.pack("<ddd", k, 2 * k, 0) if k != 3 else b"no tag"
    (tmp_path / "in").mkdir()
    for name, part in (("one", [4, 0, 3]), ("two", [1, 2])):
        (tmp_path / "in" / f"{name}.tfrecords").write_bytes(b"".join(record(csi[k], position(k), float(k)) for k in part))
    found = campaigns.read_records(spark, f"{tmp_path}/in")
    rows = {r.time: r for r in found.collect()}
    assert all(np.allclose(rows[k].csi, csi[k]) for k in range(5))
    assert (rows[2.0].x, rows[2.0].y) == (2.0, 4.0) and rows[3.0].x is None
    campaigns.write_campaigns(found, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    order = campaigns.time_order([back.where("campaign = 'one'"), back.where("campaign = 'two'")])
    assert [r.time for r in order.orderBy("gidx").collect()] == [0, 1, 2, 3, 4]
    some = campaigns.lookup(order, back, order.where("gidx = 4").select("gidx")).first()
    assert np.allclose(some.csi, csi[4])
    pairs = campaigns.snapshots_of(back.where("time = 1")).first().csi
    assert [(p.re, p.im) for p in pairs] == [tuple(x) for x in csi[1].astype(float).reshape(-1, 2).tolist()]


def plain_rows(df):
    return sorted((r.campaign, r.record_idx, tuple(map(plain, r.csi)), r.x, r.y, r.time) for r in df.collect())


def test_large_record_files_are_read_in_ranges(spark, tmp_path):
    """Ranges smaller than a frame, messages that hold whole frames, and empty files give what the whole reader gives."""
    rng = np.random.default_rng(8)
    position = b"\x22\x18" + struct.pack("<ddd", 1.5, -2.5, 0)
    small = record(rng.normal(size=4).astype("f4"), position, 7.0)
    trap = np.frombuffer(small * 3 + bytes(-len(small) * 3 % 4), "<f4")  # frames inside a message
    csi = [rng.normal(size=2 * int(rng.integers(1, 300))).astype("f4") if k % 4 else trap for k in range(90)]
    (tmp_path / "in").mkdir()
    for name, part in (("one", range(60)), ("two", range(60, 90)), ("none", ())):
        (tmp_path / "in" / f"{name}.tfrecords").write_bytes(b"".join(record(csi[k], position, float(k)) for k in part))
    want = plain_rows(campaigns.read_whole_records(spark, f"{tmp_path}/in"))
    assert len(want) == 90 and want[0][1] == 0
    for split in (1_000, 20_000, 1 << 30):
        found = campaigns.read_records(spark, f"{tmp_path}/in", split_bytes=split)
        assert plain_rows(found) == want
        if split == 20_000:
            assert found.rdd.getNumPartitions() >= 3
            most = max(found.groupBy(F.spark_partition_id()).count().toPandas()["count"])
            assert most < 60
    times = campaigns.read_records(spark, f"file://{tmp_path}/in/two.tfrecords", ("campaign", "record_idx", "time"), 5000)
    assert times.columns == ["campaign", "record_idx", "time"]
    assert sorted(tuple(r) for r in times.collect()) == [("two", k - 60, float(k)) for k in range(60, 90)]
    assert campaigns.read_records(spark, f"{tmp_path}/in/none.tfrecords").count() == 0
    with pytest.raises(ValueError):
        campaigns.read_records(spark, f"{tmp_path}/in", ("odd",))


def test_written_records_come_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("b" if k % 3 else "a", [float(v) for v in rng.normal(size=6).astype("f4")], float(k) if k % 5 else None, 1.0, float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "campaign string, csi array<float>, x double, y double, time double")
    written = campaigns.write_records(df.repartition(3), f"file://{tmp_path}/out")
    assert written.agg(F.sum("n")).first()[0] == 40
    back = campaigns.read_records(spark, f"{tmp_path}/out", split_bytes=700).collect()
    assert {r.campaign.split("-")[0] for r in back} == {"a", "b"}
    key = lambda c, v, x, t: (c, tuple(v), x is None, x or 0, t)
    assert sorted(key(r.campaign.split("-")[0], r.csi, r.x, r.time) for r in back) == sorted(key(c, v, x, t) for c, v, x, _, t in rows)


def test_damaged_record_files_are_an_error(spark, tmp_path):
    data = bytearray(b"".join(record(np.ones(8, "f4"), b"no tag", float(k)) for k in range(5)))
    data[2] ^= 1
    (tmp_path / "bad.tfrecords").write_bytes(bytes(data))
    with pytest.raises(Exception, match="no sound record"):
        campaigns.read_records(spark, f"{tmp_path}/bad.tfrecords")
    with pytest.raises(FileNotFoundError):
        campaigns.read_records(spark, f"{tmp_path}/missing")
    assert records.length_checksum(np.frombuffer(b"12345678", np.uint8)[None])[0] == masked(b"12345678")


def masked(data):
    """The checksum bit by bit."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_calibration_file(spark, tmp_path):
    (tmp_path / "offsets.json").write_text('{\n "sto": [0.5, -1.0],\n "cpo": [0.25, 3.0]\n}')
    assert campaigns.read_calibration(spark, f"{tmp_path}/offsets.json").first() == ([0.5, -1.0], [0.25, 3.0])


def test_results_go_to_files_and_back(spark, tmp_path):
    root = results.setting_dir(str(tmp_path), 4, False)
    for method, value in (("flat", 0.5), ("bundle", 0.25)):
        results.save_metrics(spark.createDataFrame([(value,)], "KS_mean double"), root, method)
    back = {r.method: r.KS_mean for r in results.load_metrics(spark, root).collect()}
    assert back == {"flat": 0.5, "bundle": 0.25} and results.exists(spark, root)
    assert results.load_metrics(spark, root, exclude=("flat",)).count() == 1
    with pytest.raises(ValueError):
        results.setting_dir("x", 3, True)
    with pytest.raises(ValueError):
        results.RunConfig().merged(in_window=9, out_window=3)
    assert results.RunConfig().merged(batch_size=3, odd=1).extra == {"odd": 1}


def test_band_and_pairs_push_filters_and_columns_down(spark):
    plan = registry.QUERIES["positives_band_join"](spark, SMALL)._jdf.queryExecution().toString()
    assert "props" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        V.distances(None, None, "none")
    with pytest.raises(ValueError):
        V.features(None, "none", 1, 2)
    hull = G.convex_hulls(spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 0.0), (1, 0.0, 1.0), (1, 0.2, 0.2)], "hull_id int, x double, y double"))
    assert hull.count() == 3


def test_hulls_of_large_groups_are_reduced_before_they_meet(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 3 if k % 50 else None, *map(float, rng.normal(size=2))) for k in range(3000)] + [(7, 0.0, 0.0), (7, 1.0, 1.0), (7, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "label int, x double, y double").repartition(5)
    assert G.partial_corners(df, "label").count() < 600
    assert "MapInPandas" in G.convex_hulls(df, "label")._jdf.queryExecution().toString()
    planes = G.convex_hulls(df, "label").collect()
    assert {p.label for p in planes} == {0, 1, 2, None}
    for label in (0, 1, 2, None):
        p = np.array([r[1:] for r in rows if r[0] == label])
        side = np.array([[q.a, q.b, q.c] for q in planes if q.label == label])
        slack = p @ side[:, :2].T + side[:, 2]
        assert slack.max() < 1e-9 and (np.sort(np.abs(slack), 0)[:2] < 1e-9).all()


def test_every_point_starts_a_walk(spark):
    walks = registry.QUERIES["trajectory_walks"](spark, SMALL)
    points = {r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id").collect()}
    assert {r.walker for r in walks.select("walker").collect()} == points


def test_distance_to_a_group_is_the_sum_of_its_distances(spark):
    rows = [(0, "a", [1.0, 2.0]), (1, "a", [0.5, -1.0]), (2, "a", None), (3, "b", [3.0, 3.0]), (4, None, [1.0, 1.0]), (5, "a", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>")
    got = {r["id"]: r["d"] for r in T.distance_to_group(df, "g", "v").collect()}
    for k, g, v in rows:
        others = [w for _, h, w in rows if h == g and w is not None]
        if g is None:
            assert k not in got
        elif v is None:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(sum((x - y) ** 2 for w in others for x, y in zip(v, w)), abs=1e-9)
            one = spark.createDataFrame([(v, others)], "v array<double>, o array<array<double>>").select(V.summed_distance(F.col("v"), F.col("o"))).first()[0]
            assert got[k] == pytest.approx(one, abs=1e-9)


def test_distances_to_a_group_far_from_the_origin(spark):
    rng = np.random.default_rng(2)
    rows = [(k, k % 2, [float(v) for v in 1e6 + rng.normal(size=3)]) for k in range(40)]
    got = {r["id"]: r["d"] for r in T.distance_to_group(spark.createDataFrame(rows, "id int, g int, v array<double>"), "g", "v").collect()}
    for k, g, v in rows:
        assert got[k] == pytest.approx(sum((x - y) ** 2 for _, h, w in rows if h == g for x, y in zip(v, w)), rel=1e-6)


def test_virtual_sites_and_missing_parts(spark):
    parts = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (0, 2, [5.0, 6.0]), (1, 2, None), (2, 3, [7.0])], "bs_id int, key long, x array<double>")
    groups = spark.createDataFrame([(10, 0, 1), (10, 1, 0), (11, 0, 2)], "group_id int, place int, bs_id int")
    get = lambda df: sorted((r.group_id, r.key, list(r.x)) for r in df.collect())
    assert get(S.virtual_sites(parts, groups, "key")) == [(10, 1, [3.0, 4.0, 1.0, 2.0]), (11, 3, [7.0])]
    assert get(S.virtual_sites(parts, groups, "key", width=2)) == [(10, 1, [3.0, 4.0, 1.0, 2.0]), (10, 2, [0.0, 0.0, 5.0, 6.0]), (11, 3, [7.0])]


def test_tubes_follow_polylines(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.0), (1, 2.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 1.0, 1.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["id"], r.bx, r.by_): r.density for r in G.tube(lines, "id", (-1.0, -1.0), (3.0, 3.0), 8, 0.5, 2.0).collect()}
    assert len(got) == 128
    for (line, bx, by), density in got.items():
        p = np.array([-1 + (bx + 0.5) * 0.5, -1 + (by + 0.5) * 0.5])
        track = np.array([[1.0, 1.0]]) if line == 2 else np.concatenate([np.stack([np.linspace(0, 2, 2001), np.zeros(2001)], 1), np.stack([np.full(2001, 2.0), np.linspace(0, 2, 2001)], 1)])
        assert density == pytest.approx(2 * math.exp(-((track - p) ** 2).sum(1).min() / 0.5), abs=1e-3)


def test_latents_keep_the_ids_of_their_files(spark, tmp_path):
    own = spark.createDataFrame([(3, 1, 0.5), (12, 2, 0.25)], "agent int, key long, z double")
    shared = spark.createDataFrame([("0", "2 b", 1, 0.5), ("0", "1", 2, 0.75)], "i string, j string, key long, z double")
    results.save_latents(own, f"{tmp_path}/run/local", ["agent"])
    results.save_latents(shared, f"{tmp_path}/run/shared", ["i", "j"])
    assert sorted((r.agent, r.key, r.z) for r in results.load_latents(spark, f"{tmp_path}/run", ["agent"]).collect()) == [("12", 2, 0.25), ("3", 1, 0.5)]
    assert sorted((r.i, r.j, r.key, r.z) for r in results.load_latents(spark, f"{tmp_path}/run/shared", ["i", "j"]).collect()) == [("0", "1", 2, 0.75), ("0", "2 b", 1, 0.5)]


def test_bootstrap_of_stress_is_brute_force(spark):
    """Few draws held against all pairs in numpy; the query takes 1000 of 1000."""
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.normal(size=4))) for k in range(30)]
    points = spark.createDataFrame(rows, "id long, x double, y double, u double, v double")
    from chartweave.operators.sampling import bootstrap

    drawn = {}
    for r in bootstrap(30, 3, 20, 42, spark).collect():
        drawn.setdefault(r["s"], []).append(r["idx"])
    for r in M.kruskal_bootstrap(points, "id", ["x", "y"], ["u", "v"], 3, 20, 42).collect():
        at = np.array([rows[k][1:] for k in drawn[r["s"]]])
        d, e = (np.linalg.norm(at[:, None, c] - at[None, :, c], axis=2) for c in (slice(0, 2), slice(2, 4)))
        beta = (d * e).sum() / (e * e).sum()
        assert r["stress"] == pytest.approx(math.sqrt(((d - beta * e) ** 2).sum() / (d * d).sum()), abs=1e-9)


def half_planes(rng, centre, size, corners):
    """A random convex polygon about a centre as half-planes."""
    turn = np.sort(rng.uniform(0, 2 * np.pi, corners))
    return [(float(np.cos(t)), float(np.sin(t)), float(-(np.cos(t) * centre[0] + np.sin(t) * centre[1]) - size)) for t in turn]


def crossing(p, q, planes):
    enter, leave = 0.0, 1.0
    for a, b, c in planes:
        s, u = a * p[0] + b * p[1] + c, a * (q[0] - p[0]) + b * (q[1] - p[1])
        if abs(u) <= 1e-10:
            if s > 1e-10:
                return False
        elif u > 0:
            leave = min(leave, -s / u)
        else:
            enter = max(enter, -s / u)
    return enter <= leave


def test_hulls_of_all_sizes_meet_points_and_segments_by_cells(spark):
    """Small and large, unbounded, empty and touching hulls; long and short, upright and level segments; no place at all."""
    rng = np.random.default_rng(11)
    hulls = {k: half_planes(rng, rng.uniform(-50, 50, 2), float(rng.choice([0.01, 0.5, 4, 30])), int(rng.integers(3, 8))) for k in range(40)}
    hulls |= {40: [(1.0, 0.0, 45.0)], 41: [(1.0, 0.0, 0.0), (-1.0, 0.0, 1.0)], 42: [(1.0, 0.0, -3.0), (-1.0, 0.0, 2.0), (0.0, 1.0, -3.0), (0.0, -1.0, 2.0)]}
    inside = lambda x, y: any(all(a * x + b * y + c <= 0 for a, b, c in own) for own in hulls.values())
    places = [tuple(map(float, rng.uniform(-60, 60, 2))) for _ in range(300)] + [(3.0, 3.0), (2.0, 2.5), (3.0000001, 3.0)]
    planes = spark.createDataFrame([(k, *p) for k, own in hulls.items() for p in own], "hull_id long, a double, b double, c double")
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(places)] + [(900, None, 1.0), (901, None, None)], "id long, x double, y double")
    outside = G.outside_hulls(points, planes, "id")
    assert sorted(r["id"] for r in outside.collect()) == [k for k, p in enumerate(places) if not inside(*p)] + [900, 901]
    ends = [(p, tuple(map(float, np.add(p, rng.normal(0, rng.choice([0.1, 3, 60]), 2))))) for p in places] + [((1.0, -60.0), (1.0, 60.0)), ((-60.0, 3.0), (60.0, 3.0)), ((2.5, 2.5), (2.5, 2.5))]
    segments = spark.createDataFrame([(k, *p, *q) for k, (p, q) in enumerate(ends)] + [(900, None, 1.0, 1.0, 1.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    crossed = G.segments_crossing(segments, planes, "id")
    assert sorted(r["id"] for r in crossed.collect()) == [k for k, (p, q) in enumerate(ends) if any(crossing(p, q, own) for own in hulls.values())]
    sites = spark.createDataFrame([(k, *map(float, rng.uniform(-60, 60, 2)), float(r)) for k, r in enumerate([0.0, 0.5, 5, 5, 70])] + [(9, None, 0.0, 1.0)], "bs_id int, cx double, cy double, radius double")
    covered = G.coverage(points, sites, "id", 0.2)
    want = {(s.bs_id, k) for s in sites.collect() if s.cx is not None for k, (x, y) in enumerate(places) if 0.04 <= (x - s.cx) ** 2 + (y - s.cy) ** 2 <= s.radius**2}
    assert sorted(tuple(r) for r in covered.collect()) == sorted(want)
    graph = N.neighbour_graph(points, "id", 9.0, planes)
    for df in (outside, crossed, covered, graph):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert G.outside_hulls(points, planes.limit(0), "id").count() == points.count()
    assert G.segments_crossing(segments, planes.limit(0), "id").count() == G.segments_crossing(segments.limit(0), planes, "id").count() == 0


def test_far_queries_are_snapped_like_near_ones(spark):
    rng = np.random.default_rng(6)
    places, asked = rng.uniform(0, 1, (80, 2)), np.concatenate([rng.uniform(0, 1, (40, 2)), [[40.0, -3.0], [-900.0, 2.0]]])
    frame = lambda at, name: spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)] + [(999, None, 0.0)], f"{name} long, x double, y double")
    got = {r.q: r.id for r in G.snap(frame(asked, "q"), frame(places, "id"), "q", "id", 0.01).collect()}
    assert got == {k: int(((places - p) ** 2).sum(1).argmin()) for k, p in enumerate(asked)}
    assert G.snap(frame(asked, "q"), frame(places, "id").where("x > 5"), "q", "id", 0.01).count() == 0


def test_neighbours_of_clusters_copies_and_outliers(spark):
    """Dense and sparse places, many points at one place, ties, groups, fewer points than neighbours; few rows are shuffled."""
    rng = np.random.default_rng(12)
    at = np.concatenate([rng.normal(0, 1e-5, (300, 2)), np.repeat([[3.0, 4.0]], 150, 0), rng.uniform(-50, 50, (120, 2)), [[1e6, 0.0]], np.round(rng.uniform(0, 3, (80, 2)))])
    rows = [(k % 2, k, *map(float, p)) for k, p in enumerate(at)] + [(2, 9000, 0.0, 0.0), (2, 9001, 1.0, 1.0), (1, 9002, None, 1.0), (0, 9003, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double")

    def brute(own, k):
        out = []
        for i, p in own:
            near = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, j) for j, q in own if j != i)[:k]
            out += [(i, j, n + 1) for n, (_, j) in enumerate(near)]
        return out

    whole = {g: [(i, (x, y)) for h, i, x, y in rows if h == g and i not in (9002, 9003)] for g in (0, 1, 2)}
    for k, cell in ((1, 4096), (7, 64), (7, 4096)):
        old, M.CELL_POINTS = M.CELL_POINTS, cell
        try:
            got = M.nearest(df, "id", ["x", "y"], k, 700, ["g"])
            assert sorted((r["id"], r.other, r.place) for r in got.collect()) == sorted(x for own in whole.values() for x in brute(own, k))
        finally:
            M.CELL_POINTS = old
    known = df.where("x is not null and not isnan(y)")
    a, b = ({(r["id"], r.other, r.place) for r in f(known, "id", ["x", "y"], 3, 700, ["g"]).collect()} for f in (M.nearest, M._nearest_of_all))
    assert a == b
    assert M.nearest(df.limit(0), "id", ["x", "y"], 3, 0).count() == 0


def test_walkers_turn_at_dead_ends_and_draw_anew_when_stuck(spark):
    line = [(k, float(k), 0.0) for k in range(10)] + [(20, 50.0, 50.0), (21, 50.0, 50.0 + 1e-9), (30, 90.0, 0.0)]
    points = spark.createDataFrame(line, "id long, x double, y double")
    links = [(k, k + 1) for k in range(9)] + [(20, 21)]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "src long, dst long")
    users = [(k, kind, 9, k) for k, kind in enumerate(W.WALKS)] + [(100, "neighbor_linear", 9, 20), (101, "full", 9, 20), (102, "circular", 3, 30), (103, "coherent", 1, 4), (104, "full", 0, 4), (105, "full", 4, 77)]
    asked = spark.createDataFrame(users, "walker long, kind string, length int, node long")
    rows = W.graph_trajectories(edges, points, asked, "id", 5, interval=4, circle=(2.0, 6.0)).collect()
    path = {(r.walker, r.t): r.node for r in rows}
    assert {w for w, _ in path} == {u[0] for u in users} - {104, 105}
    neighbours = {k: {b for a, b in links if a == k} | {a for a, b in links if b == k} for k, _, _ in line}
    for walker, kind, length, node in users[:-2]:
        assert [t for w, t in sorted(path) if w == walker] == list(range(length)) and path[walker, 0] == node
        for t in range(1, length):
            here = path[walker, t - 1]
            assert path[walker, t] in (neighbours[here] or {here})
    assert {path[102, t] for t in range(3)} == {30}
    redraws = {r.walker: max(q.redraws for q in rows if q.walker == r.walker) for r in rows}
    assert redraws[100] == 1 and redraws[101] == 0 and redraws[0] == redraws[1] == 0
    with pytest.raises(ValueError):
        W.graph_trajectories(edges, points, asked.withColumn("kind", F.lit("odd")), "id", 5)


def test_second_legs_turn_about_a_right_angle(spark):
    rng = np.random.default_rng(1)
    side = 41
    grid = [(a * side + b, float(a), float(b)) for a in range(side) for b in range(side)]
    near = [(a * side + b, c * side + d) for a in range(side) for b in range(side) for c in (a - 1, a, a + 1) for d in (b - 1, b, b + 1) if (a, b) != (c, d) and 0 <= c < side and 0 <= d < side]
    points, edges = spark.createDataFrame(grid, "id long, x double, y double"), spark.createDataFrame(near, "src long, dst long")
    users = spark.createDataFrame([(k, "neighbor_l", 16, side * 20 + 20) for k in range(30)], "walker long, kind string, length int, node long")
    at = {(r.walker, r.t): np.array(divmod(r.node, side)) for r in W.graph_trajectories(edges, points, users, "id", int(rng.integers(99))).collect()}
    cosines = []
    for k in range(30):
        a, b = at[k, 7] - at[k, 0], at[k, 15] - at[k, 8]
        cosines.append(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9))
    assert abs(np.mean(cosines)) < 0.4 and np.mean(np.abs(cosines)) < 0.7
    assert len({tuple(map(tuple, (at[k, t] for t in range(16)))) for k in range(30)}) > 25


def test_seeded_clusters_are_stable_and_near_the_best(spark):
    """Labels do not change with partitions; inertia within one per cent of the best of many random starts; awkward points."""
    rng = np.random.default_rng(21)
    at = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2), (5, 5, 5))])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)] + [(900, None, 0.0, 0.0)], "id long, x double, y double, z double")
    space = ["x", "y", "z"]
    found = K.kmeans(df, "id", space, 4, 7, starts=3)
    again = K.kmeans(df.repartition(7), "id", space, 4, 7, starts=3)
    assert np.allclose(found.centres, again.centres, atol=1e-9) and found.rounds <= 50

    def lloyd(centres):
        for _ in range(60):
            own = ((at[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([at[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        return ((at[:, None] - centres[None]) ** 2).sum(2).min(1).sum()

    best = min(lloyd(at[rng.choice(len(at), 4, replace=False)]) for _ in range(60))
    assert found.inertia <= 1.01 * best
    labels = {r["id"]: r.cluster for r in K.labelled(df, space, found).collect()}
    assert labels[900] is None and all(labels[k] == ((at[k] - np.array(found.centres)) ** 2).sum(1).argmin() for k in range(len(at)))
    same = spark.createDataFrame([(k, 1.0, 2.0) for k in range(9)], "id long, x double, y double")
    assert K.kmeans(same, "id", ["x", "y"], 3, 1).centres == [(1.0, 2.0)]
    nothing = K.kmeans(same.limit(0), "id", ["x", "y"], 3, 1)
    assert nothing.centres == [] and K.labelled(same, ["x", "y"], nothing).where("cluster is null").count() == 9


def test_weighted_draws_follow_the_weights(spark):
    weights = [0.0, 1.0, 2.0, 5.0, -3.0, 12.0, None]
    df = spark.createDataFrame(list(enumerate(weights)), "id long, w double")
    draws = 4000
    rows = R.weighted_draws(df, "id", F.col("w"), draws, 3).collect()
    assert sorted(r.draw_no for r in rows) == list(range(draws))
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in R.weighted_draws(df.repartition(5), "id", F.col("w"), draws, 3).collect())
    for k, w in enumerate(weights):
        share = max(w or 0.0, 0.0) / 20
        n = sum(r["id"] == k for r in rows)
        assert abs(n - draws * share) <= 4 * math.sqrt(draws * share * (1 - share))


def test_folds_keep_anchors_and_draw_samples_anew(spark):
    rng = np.random.default_rng(5)
    walks = {w: [int(rng.integers(12)) for _ in range(int(rng.integers(3, 16)))] for w in range(25)}
    steps = spark.createDataFrame([(w, t, n) for w, own in walks.items() for t, n in enumerate(own)], "walker long, t long, node long")
    near, far, n_pos, n_neg = 2, 3, 2, 3
    rows = C.walk_triplets(steps, near, far, n_pos, n_neg, 3, 9).collect()
    wanted = set()
    for w, own in walks.items():
        last = {n: t for t, n in enumerate(own) if far <= t < len(own) - far}
        for n, t in last.items():
            pos = [own[s] for s in range(len(own)) if 0 < abs(s - t) <= near]
            neg = [own[s] for s in range(len(own)) if abs(s - t) > far]
            if len(pos) >= n_pos and len(neg) >= n_neg:
                wanted.add((w, n))
                for fold in range(3):
                    for kind, size, pool in (("pos", n_pos, pos), ("neg", n_neg, neg)):
                        drawn = [r.other for r in rows if (r.fold, r.walker, r.node, r.kind) == (fold, w, n, kind)]
                        assert len(drawn) == size and all(drawn.count(x) <= pool.count(x) for x in drawn)
    folds = [{(r.walker, r.node) for r in rows if r.fold == f} for f in range(3)]
    assert folds == [wanted] * 3 and wanted
    samples = [sorted((r.walker, r.node, r.kind, r.k, r.other) for r in rows if r.fold == f) for f in range(3)]
    assert samples[0] != samples[1] != samples[2]


def crowd(spark, n=300, seed=4):
    """Places of which most are neighbours of each other, about a building, some at one place, some alone or without a place."""
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.normal(0, 0.05, (n, 2)), [[0.01, 0.01], [0.01, 0.01], [5.0, 5.0], [-7.0, 2.0]]])
    return spark.createDataFrame([(3 * k, *map(float, p)) for k, p in enumerate(at)] + [(9_999, None, 0.0)], "id long, x double, y double"), spark.createDataFrame([(0, 1.0, 0.0, -0.02), (0, -1.0, 0.0, -0.01), (0, 0.0, 1.0, -0.02), (0, 0.0, -1.0, -0.02)], "hull_id int, a double, b double, c double")


def rows_written(spark, work):
    """What ``work`` gives, and the rows of the largest table that it writes to the shared folder."""
    top = session.shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(glob.glob(f"{top}/tables/*"))
    out = sorted(map(tuple, work().collect()))
    return out, max((spark.read.parquet(p).count() for p in set(glob.glob(f"{top}/tables/*")) - before if glob.glob(f"{p}/*.parquet")), default=0)


def test_hashes_of_many_messages():
    rng = np.random.default_rng(2)
    prefixes = [b"27:move:%d:%d:" % (w, t) for w, t in zip(rng.integers(0, 10**9, 40).tolist(), range(40))] + [b"", b"long" * 20]
    numbers = np.concatenate([rng.integers(0, 10**5, 60), [0, 7, 2**62, -3]])
    who, what = rng.integers(0, len(prefixes), 3000), rng.integers(0, len(numbers), 3000)
    want = [int(hashlib.md5(prefixes[a] + str(numbers[b]).encode()).hexdigest()[:16], 16) for a, b in zip(who, what)]
    assert near.md5_keys(prefixes, numbers, who, what).tolist() == want


@pytest.mark.parametrize("parts", [1, 3])
def test_walks_by_reach_are_those_over_edges_and_write_none(spark, monkeypatch, parts):
    points, hulls = crowd(spark)
    monkeypatch.setattr(near, "PART_PLACES", near.PART_PLACES if parts == 1 else 1000)
    edges = N.neighbour_graph(points, "id", 0.08, hulls)
    n = edges.count()
    assert n > 20_000
    users = points.select(F.col("id").alias("walker"), F.element_at(F.array(*map(F.lit, W.WALKS)), (F.col("id") % 5 + 1).cast("int")).alias("kind"), F.lit(5).alias("length"), F.col("id").alias("node"))
    got, most = rows_written(spark, lambda: W.graph_trajectories(near.Near(0.08, hulls), points, users, "id", 5, 3, 0.02, (0.05, 0.2)))
    assert got == sorted(map(tuple, W.graph_trajectories(edges, points, users, "id", 5, 3, 0.02, (0.05, 0.2)).collect()))
    assert most < 1_000 < n
    walkers = points.select(F.col("id").alias("walker"), F.col("id").alias("node"))
    got, most = rows_written(spark, lambda: N.graph_walks(near.Near(0.08, hulls), points, walkers, "id", 3, 11))
    assert got == sorted(map(tuple, N.graph_walks(edges, points, walkers, "id", 3, 11).collect()))
    assert most < 1_000


def test_walk_queries_write_no_edges(spark):
    for name in ("trajectory_full", "trajectory_walks"):
        n = registry.QUERIES["neighbor_graph"](spark, SMALL).count()
        assert rows_written(spark, lambda: registry.QUERIES[name](spark, SMALL))[1] <= 500 < n  # noqa: B023


def test_layers_by_reach_are_those_over_edges_and_write_none(spark, monkeypatch):
    points, hulls = crowd(spark)
    edges, starts = N.neighbour_graph(points, "id", 0.04, hulls), points.select(F.col("id").alias("start"))
    want = sorted(map(tuple, N.bfs_layers(edges, starts, 3).collect()))
    assert len(want) > 20_000 and max(r[2] for r in want) == 3
    for kept, layer in ((near.KEPT_BYTES, near.LAYER_BYTES), (0, 20_000)):
        monkeypatch.setattr(layers, "KEPT_BYTES", kept), monkeypatch.setattr(layers, "LAYER_BYTES", layer)
        got, most = rows_written(spark, lambda: layers.near_layers(points, "id", near.Near(0.04, hulls), starts, 3))
        assert got == want and most < 1_000
    some = starts.where("start % 7 = 0")
    got, most = rows_written(spark, lambda: N.coherent_samples(near.Near(0.04, hulls), some, 1, 2, points, "id"))
    assert got == sorted(map(tuple, N.coherent_samples(edges, some, 1, 2).collect())) and got and most < 1_000


def test_layer_queries_write_no_layers(spark):
    for name in ("bfs_layers", "coherent_pos_neg"):
        got, most = rows_written(spark, lambda: registry.QUERIES[name](spark, SMALL))  # noqa: B023
        assert len(got) > 10_000 and most <= 500


def test_coherent_folds_by_reach_are_those_over_edges_and_write_none(spark):
    points, hulls = crowd(spark)
    rng = np.random.default_rng(8)
    ids = [r.id for r in points.collect()]
    steps = spark.createDataFrame([(w, t, ids[int(rng.integers(len(ids)))]) for w in range(30) for t in range(8)], "walker long, t int, node long")
    want = sorted(map(tuple, C.coherent_triplets(steps, N.neighbour_graph(points, "id", 0.04, hulls), 1, 2, 2, 2, 3, 2, 9).collect()))
    got, most = rows_written(spark, lambda: C.coherent_triplets(steps, near.Near(0.04, hulls), 1, 2, 2, 2, 3, 2, 9, points, "id"))
    assert got == want and len(want) > 200 and most < 1_000


def test_deepest_layer_by_reach_is_that_over_edges_and_writes_none(spark):
    points, hulls = crowd(spark)
    for reach, parting in ((0.03, None), (0.03, hulls)):
        edges = N.neighbour_graph(points, "id", reach, parting)
        got, most = rows_written(spark, lambda: spark.createDataFrame([(N.diameter_estimate(near.Near(reach, parting), points, "id", 90),)], "d int"))  # noqa: B023
        assert got == [(N.diameter_estimate(edges, points, "id", 90),)] and got[0][0] > 3
        assert most < 1_000


def test_snapping_makes_no_row_a_pair(spark):
    """Places so close that each query has hundreds within reach, copies of a place, ties, a place and a query that are not a number."""
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.normal(0, 0.01, (900, 2)), np.repeat([[0.5, 0.5]], 300, 0), np.round(rng.uniform(0, 3, (60, 2)))])
    places = spark.createDataFrame([(5_000 - k, *map(float, p)) for k, p in enumerate(at)] + [(1, float("nan"), 0.0)], "id long, x double, y double")
    asked = np.concatenate([rng.normal(0, 0.02, (1500, 2)), [[0.5, 0.501], [1.5, 1.0], [-2.0, 4.0]]])
    queries = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(asked)] + [(9_999, 0.0, float("nan"))], "q long, x double, y double").select(F.struct("q", F.lit("a").alias("kind")).alias("q"), "x", "y")
    want = {}
    for k, p in enumerate(asked):
        d2 = ((p - at) ** 2).sum(1)
        want[k] = min(5_000 - j for j in np.flatnonzero(d2 == d2.min()))
    for some in (queries, queries.where("q.q % 20 = 0 or q.q >= 1500")):
        known = {r.q.q for r in some.collect()} - {9_999}
        rows = G.snap(some, places, "q", "id", 0.1).collect()
        assert {r.q.q: r.id for r in rows} == {k: want[k] for k in known} and len(rows) == len(known)
    sides = near.close_side(near.placed(places.where("id > 3900"), "id"), 0.1)
    assert sides < 0.01
