import numpy as np
import pytest

from voxelloom.model import Config
from voxelloom.operators import geometry as G
from voxelloom.operators import inference as I
from voxelloom.operators import sampling as R
from voxelloom.operators import stencil as K
from voxelloom.operators import volume_udf as U

VOXEL = "volume_id string, z int, y int, x int, value double"


def frame(spark, a, name="v"):
    return spark.createDataFrame([(name, *map(int, i), float(v)) for i, v in np.ndenumerate(a)], VOXEL)


def array(df, shape, column="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def test_pad_is_numpy(spark):
    a = np.arange(3 * 4 * 2.0).reshape(3, 4, 2)
    got = G.pad(frame(spark, a), a.shape, (5, 1, 3), (2, 7, 0))
    assert (array(got, (10, 12, 5)) == np.pad(a, ((5, 2), (1, 7), (3, 0)), "reflect")).all()


def test_four_quarter_turns_are_none(spark):
    a = np.arange(2 * 3 * 4.0).reshape(2, 3, 4)
    f, shape = frame(spark, a), a.shape
    for plane, axes in ((("y", "x"), (1, 2)), (("z", "x"), (0, 2)), (("z", "y"), (0, 1))):
        for k in (1, 2, 3, 4):
            want = np.rot90(a, k, axes)
            assert (array(G.rot90(f, plane, k, shape), want.shape) == want).all()


def test_random_isometry_keeps_the_values(spark):
    a = np.arange(27.0).reshape(3, 3, 3)
    got = G.random_isometry(frame(spark, a), a.shape, 5)
    assert sorted(array(got, a.shape).ravel()) == sorted(a.ravel())


def test_tile_arithmetic():
    assert G.padding_for(100, 32, 32, 64) + 64 == 132
    assert [max(0, s - 16) for s in G.tile_starts(232, 32, 32) if max(0, s - 16) + 64 <= 232] == [0, 16, 48, 80, 112, 144]
    Config()
    for bad in ({"tile": 50}, {"step": 40}, {"keep": 100}, {"low": 30.0}, {"min_size": -1}):
        with pytest.raises(ValueError):
            Config(**bad)
    c = Config.from_sections({"a": {"tile": "96", "tta": "false"}, "b": {"upsampling": "1,2,0.5"}})
    assert (c.tile, c.tta, c.upsampling) == (96, False, (1.0, 2.0, 0.5)) and c.override(tile=None, tta="yes").tta
    with pytest.raises(ValueError):
        c.override(unknown=1)


def test_overlap_add_of_a_constant_is_constant(spark):
    a = np.full((12, 16, 8), 3.0)
    got = array(G.overlap_add(G.extract_tiles(frame(spark, a), a.shape, 8, 4, 4), 8), a.shape)
    # where only the border layer of a tile lies, which has no weight, it is 0
    assert set(np.round(got[~np.isnan(got)], 9)) == {0.0, 3.0} and got[0, 3, 3] == 0
    assert (np.round(got[1:7, 1:11, 1:7], 9) == 3).all()


def test_sliding_window_gives_back_the_volume(spark):
    a = np.random.default_rng(1).random((20, 32, 32)) * 25 - 5
    got = I.sliding_window(frame(spark, a), a.shape, lambda x: x, Config(tile=32, keep=16, step=16, tta=True))
    assert np.allclose(array(got, a.shape), (a + 5) / 25)


def test_tta_of_an_equivariant_model_is_the_model():
    x = np.random.default_rng(2).random((2, 12, 12, 12))
    assert np.allclose(I.tta_predict(lambda v: v * 2, x, -5, 20), 2 * x)
    flat = I.tta_predict(lambda v: v * 0 - 5, x, -5, 20)
    assert (flat == -5).all()


def test_distances_are_brute_force():
    rng = np.random.default_rng(3)
    for shape in ((6, 7, 5), (9, 8), (1, 1, 12)):
        m = rng.random(shape) < 0.8
        m.flat[0] = False
        zero = np.argwhere(~m)
        want = np.array([0.0 if not on else np.sqrt(((zero - i) ** 2).sum(1).min()) for i, on in np.ndenumerate(m)]).reshape(shape)
        assert np.allclose(U.edt(m), want)
    assert np.isinf(U.edt(np.ones((2, 2), bool))).all()


def test_heat_of_instances(spark):
    a = np.zeros((9, 12, 12), int)
    a[1:8, 1:8, 1:8] = 1
    a[4, 9:11, 9:11] = 2
    a[0, 0, 11] = 3
    rows = [("v", *map(int, i), int(v)) for i, v in np.ndenumerate(a)]
    got = array(U.heatmap(spark.createDataFrame(rows, "volume_id string, z int, y int, x int, label int")), a.shape, "heat")
    assert got[4, 4, 4] == 20 and got[a == 1].min() >= -5 and got[0, 0, 11] == -5 and got[0, 0, 0] == -5
    assert (got[4, 9:11, 9:11] == 20).all()  # one layer, constant distances


def test_reconstruction_is_the_fixpoint_of_dilation():
    rng = np.random.default_rng(4)
    f = np.round(rng.random((5, 6, 4)), 2)
    marker = f - 0.3
    want = marker.copy()
    while True:
        grown = want.copy()
        for axis in range(3):
            p = np.pad(want, [(1, 1) if k == axis else (0, 0) for k in range(3)], constant_values=-9)
            grown = np.maximum(grown, np.maximum(np.take(p, range(0, f.shape[axis]), axis), np.take(p, range(2, f.shape[axis] + 2), axis)))
        grown = np.minimum(grown, f)
        if (grown == want).all():
            break
        want = grown
    assert np.allclose(U.reconstruct(marker, f), want)


def test_watershed_and_segmentation():
    z, y, x = np.mgrid[0:9, 0:9, 0:20]
    f = np.exp(-((z - 4) ** 2 + (y - 4) ** 2 + (x - 4) ** 2) / 8) + np.exp(-((z - 4) ** 2 + (y - 4) ** 2 + (x - 14) ** 2) / 8)
    got = U.segment(f, h=0.1, background=0.3)
    assert got.max() == 2 and got[4, 4, 4] != got[4, 4, 14] and got[0, 0, 0] == 0
    assert U.segment(f, h=0.1, background=0.3, min_size=10_000).max() == 0
    assert U.segment(np.zeros((3, 3, 3)), smoothing=False).max() == 0
    seeds = np.zeros((1, 1, 5), int)
    seeds[0, 0, 0], seeds[0, 0, 4] = 1, 2
    assert set(np.unique(U.flood(-np.ones((1, 1, 5)), seeds, np.ones((1, 1, 5), bool)))) == {1, 2}


def test_sampling_is_seeded(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    a, b = (R.minibatch(rows, 20, s, "k").collect() for s in (1, 1))
    assert a == b and a != R.minibatch(rows, 20, 2, "k").collect()
    u = rows.select(R.uniform("k").alias("u"), R.normal("k").alias("n")).toPandas()
    assert abs(u.u.mean() - 0.5) < 0.05 and abs(u.n.mean()) < 0.15 and abs(u.n.std() - 1) < 0.15
    trials = R.grid(spark, {"h": [0.1, 0.2], "c": [1, 2, 3]})
    scored = spark.createDataFrame([(0, 0.1), (3, 0.9), (4, 0.9)], "trial_id long, score double")
    assert R.best_trial(scored, trials).first().trial_id == 3 and trials.count() == 6


def test_mlstm_is_its_recurrence():
    from voxelloom.operators.layers import matrix_memory

    rng = np.random.default_rng(5)
    n, d = 23, 4
    q, k, v = rng.normal(size=(3, n, d))
    i, f = rng.normal(size=(2, n))
    c, norm, m = np.zeros((d, d)), np.zeros(d), -np.inf
    want = []
    for t in range(n):
        lf = -np.log1p(np.exp(-f[t]))
        new = max(lf + m, i[t])
        a, b = np.exp(lf + m - new), np.exp(i[t] - new)
        c, norm, m = a * c + b * np.outer(v[t], k[t]), a * norm + b * k[t], new
        s = q[t] / np.sqrt(d)
        want.append(c @ s / (max(abs(norm @ s), np.exp(-m)) + 1e-6))
    for chunk in (1, 4, 23, 64):
        assert np.allclose(matrix_memory(q, k, v, i, f, chunk=chunk), want)


def test_cubic_resampling():
    a = np.random.default_rng(6).random((4, 7, 9))
    assert np.allclose(U.resize_cubic(a, a.shape), a)
    x = np.linspace(0, 1, 40)
    smooth = np.sin(3 * x)[None, None, :] * np.ones((2, 3, 1))
    up = U.resize_cubic(smooth, (2, 3, 80))
    at = ((np.arange(80) + 0.5) / 2 - 0.5) / 39
    assert np.abs(up[0, 0, 20:-20] - np.sin(3 * at[20:-20])).max() < 1e-5
    assert np.allclose(U.resize_cubic(np.full((4, 4, 4), 2.0), (2, 7, 3)), 2.0)
    # the spline goes through the samples
    c = U._spline_coefficients(a)
    inner = (c[..., :-2] + 4 * c[..., 1:-1] + c[..., 2:]) / 6
    assert np.allclose(inner, a[..., 1:-1])


def brute_segment(f, h, background, confidence, min_size, smoothing, simple):
    """The same, voxel by voxel, sharing nothing with the operator."""
    places = list(np.ndindex(f.shape))

    def near(p):
        for axis in range(f.ndim):
            for s in (-1, 1):
                q = tuple(c + s if k == axis else c for k, c in enumerate(p))
                if all(0 <= c < n for c, n in zip(q, f.shape)):
                    yield q

    dome = f.copy()
    if smoothing:
        w = {k: np.exp(-k * k / 2) for k in range(-4, 5)}
        for axis, n in enumerate(f.shape):
            out = np.zeros(f.shape)
            for p in places:
                for k, x in w.items():
                    c = (p[axis] + k) % (2 * n)
                    out[p] += x / sum(w.values()) * dome[tuple((c if c < n else 2 * n - 1 - c) if a == axis else v for a, v in enumerate(p))]
            dome = out
        dome = (dome - dome.min()) / (dome.max() - dome.min() + 1e-8)
    if simple:
        seed = dome > h
    else:
        grown = dome - h
        while True:
            new = np.array([min(dome[p], max([grown[p]] + [grown[q] for q in near(p)])) for p in places]).reshape(f.shape)
            if (new == grown).all():
                break
            grown = new
        seed = (dome - grown > 1e-12) & (f > h)
    label = np.zeros(f.shape, int)
    for p in places:
        if seed[p] and not label[p]:
            label[p], todo = label.max() + 1, [p]
            while todo:
                r = todo.pop()
                for q in near(r):
                    if seed[q] and not label[q]:
                        label[q] = label[p]
                        todo.append(q)
    label[f <= background] = 0
    waiting = [(-f[p], k, p) for k, p in enumerate(p for p in places if label[p])]
    turn = len(waiting)
    while waiting:
        waiting.sort()
        _, _, p = waiting.pop(0)
        for q in near(p):
            if f[q] > background and not label[q]:
                label[q] = label[p]
                waiting.append((-f[q], turn, q))
                turn += 1
    out, n = np.zeros(f.shape, int), 0
    for k in range(1, label.max() + 1):
        on = label == k
        if on.sum() > min_size and f[on].max() > confidence:
            n += 1
            out[on] = n
    return out


def test_segmentation_is_brute_force():
    rng = np.random.default_rng(8)
    differ = 0
    for smoothing, simple in ((True, False), (False, False), (True, True)):
        for _ in range(4):
            f = U.smooth(rng.random((5, 7, 6)), 0.8)
            f = (f - f.min()) / (f.max() - f.min())
            settings = {"h": 0.12, "background": 0.3, "confidence": 0.5, "min_size": 3, "smoothing": smoothing, "simple": simple}
            want = brute_segment(f, 0.12, 0.3, 0.5, 3, smoothing, simple)
            assert (U.segment(f, **settings) == want).all()
            differ += len(np.unique(want))
    assert differ > 20


def test_seeds_and_flood_go_by_the_prediction():
    f = np.zeros((9, 9, 9))
    f[4, 4, 2:7] = 1.0
    got = U.segment(f, h=0.2, background=0.5, min_size=2)
    # smoothing spreads the line; what is labelled is where the prediction is
    assert (got > 0).sum() == 5 and (got[f > 0.5] == 1).all()
    assert U.segment(f * 0.1, h=0.2, background=0.05, confidence=0.0, min_size=2).max() == 0


def test_symmetry_votes_are_the_relational_ones(spark):
    a = np.random.default_rng(9).random((6, 8, 10))
    want = array(K.multi_scale_symmetry(frame(spark, a), a.shape), a.shape)
    assert np.allclose(U.symmetry(a), want, atol=1e-9)


def test_padding_of_empty_volumes(spark):
    flat = U.segment_volumes(frame(spark, np.full((4, 5, 6), 0.3)), padding=[(1, 1), (0, 2), (2, 0)])
    assert sorted((r.z, r.y, r.x) for r in flat.collect()) == sorted(np.ndindex(2, 3, 4)) and flat.filter("label <> 0").count() == 0
    assert U.segment_volumes(frame(spark, np.full((4, 5, 6), 0.3)), padding=[(0, 0)] * 3).count() == 120


def test_motion_kernels():
    weight = {(z, y, x): w for z, y, x, w in K.motion_kernel(20.0, ("y", "x"))}
    assert round(weight[0, 1, 0], 4) == 0.0477 and round(weight[0, 0, 1], 4) == 0.0174 and weight[0, 0, 0] == 0 == weight[1, 0, 0]
    assert abs(sum(weight.values()) - 1) < 1e-12
    flat = {(y, x): w for _, y, x, w in K.motion_kernel_2d()}
    assert flat[1, 1] / flat[0, 1] == pytest.approx(2**0.5)


def test_zernike_image_and_headwise_map():
    from voxelloom.operators import layers as Y

    image = np.random.default_rng(11).random((16, 16))
    plain_ = Y.zernike_image(image, 0, 0, 0)
    assert np.allclose(plain_, (image - image.min()) / (image.max() - image.min()))
    moved = Y.zernike_image(image)
    assert moved.min() == 0 and moved.max() == 1 and not np.allclose(moved, plain_)
    x, w = np.random.default_rng(12).random((5, 6)), np.random.default_rng(13).random((2, 4, 3))
    want = np.concatenate([x[:, 3 * h : 3 * h + 3] @ w[h].T for h in range(2)], axis=1)
    assert np.allclose(Y.linear_headwise(x, w), want) and np.allclose(Y.linear_headwise(x, w, np.ones(8)), want + 1)


def test_spline_goes_through_the_samples():
    """Against the linear equations that define it."""
    a = np.random.default_rng(14).random(9)
    n = len(a)
    m = np.zeros((n, n))
    for i in range(n):
        for k, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            q = abs(i + k)
            m[i, q if q < n else 2 * (n - 1) - q] += w
    assert np.allclose(U._spline_coefficients(a), np.linalg.solve(m, a))


def test_tuning_of_segmentation(spark):
    z, y, x = np.mgrid[0:7, 0:9, 0:16]
    f = np.exp(-((z - 3) ** 2 + (y - 4) ** 2 + (x - 4) ** 2) / 6) + np.exp(-((z - 3) ** 2 + (y - 4) ** 2 + (x - 11) ** 2) / 6)
    truth = U.segment(f, h=0.2, background=0.2)
    rows = [("v", *map(int, p), float(f[p]), int(truth[p])) for p in np.ndindex(f.shape)]
    volume = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, value double, label int")
    trials = R.grid(spark, {"h": [0.2, 0.9], "background": [0.2, 0.6]})
    scored = {r.trial_id: r.score for r in R.tune_segmentation(volume, trials).collect()}
    assert scored[0] == 1.0 and len(scored) == 4 and scored[1] < 1
    assert R.best_trial(R.tune_segmentation(volume, trials), trials).first().trial_id == 0
    space = R.random_trials(spark, 50, 1)
    assert space.count() == 50 and space.selectExpr("min(h) >= 0.15 AND max(h) <= 0.5 AND min(confidence) >= 0.2").first()[0]


def test_first_values_and_spectral_dropout():
    from voxelloom.operators import layers as Y

    t = Y.initial("truncated", (200, 100), 1)
    assert abs(t).max() < 0.04 and 0.017 < t.std() < 0.0185
    assert abs(Y.initial("small", (300, 300), 2, dim=40).std() - (2 / 200) ** 0.5) < 0.002 and abs(Y.initial("wang", (300, 300), 2, dim=16, blocks=4).std() - 0.125) < 0.002
    assert np.allclose(Y.initial("spaced", (2, 3), 0), [[3.4, 4.7, 6.0]] * 2)
    with pytest.raises(ValueError):
        Y.initial("other", (2,), 0)
    s = np.ones((3, 8, 8, 5), complex)
    got = Y.spectral_dropout(s, 0.3, 4)
    assert (got[:, 0, 0, 0] == 1).all() and 0.6 < got.real.mean() < 0.8 and (got == Y.spectral_dropout(s, 0.3, 4)).all()
