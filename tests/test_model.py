import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import hashing, scalar
from weft.operators import dataset, evaluate, model, sampling
from weft.sources import textfiles


def test_gradient_by_differences():
    h = model.Hyper(recf_nodes=2, recf_count=2, a1=3, a2=2, b1=3, b2=2)
    rng = np.random.default_rng(0)
    p = {k: rng.normal(size=s) for k, s in h.shapes().items()}
    x, y = rng.normal(size=(5, 8)), np.array([1, -1, 1, 1, -1.0])
    g, total = model.gradient(p, x, y, 2)
    assert abs(total - 5 * model.loss(y, model.forward(p, x, 2)[0])) < 1e-9
    for k in p:
        at = tuple(0 for _ in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        slope = 5 * (model.loss(y, model.forward(up, x, 2)[0]) - model.loss(y, model.forward(down, x, 2)[0])) / 2e-5
        assert abs(slope - g[k][at]) < 1e-5


def test_loss_of_large_scores(spark):
    data = [(-1.0, 400.0), (1.0, 400.0), (1.0, -400.0), (-1.0, 44.0), (1.0, 0.3)]
    got = [r[0] for r in spark.createDataFrame(data, "y double, z double").select(model.bce(F.col("y"), F.col("z"))).collect()]
    assert got == pytest.approx([800, 0, 800, 88, math.log1p(math.exp(-0.6))])


def test_training_learns(spark, tmp_path):
    h = model.Hyper(batch_count=2, recf_nodes=2, recf_count=2, a1=6, a2=4, b1=6, b2=4, learning_rate=0.9)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) + (1 if i % 2 else -1) for v in rng.normal(size=8)], 1.0 if i % 2 else -1.0) for i in range(200)]
    df = spark.createDataFrame([*rows, (999, [0.0] * 8, 0.0)], "instance_id long, x array<double>, y double")
    p, losses = model.train(df, h, epochs=8, start={k: 12 * v for k, v in model.init(h).items()})
    assert losses[-1] < losses[0]
    model.save(spark, p, str(tmp_path / "p"))
    again = model.load(spark, str(tmp_path / "p"))
    assert all(np.allclose(p[k], again[k]) for k in p)
    c = evaluate.confusion(model.predict(df, again, 2)).first()
    assert c.n == 200 and c.fn + c.fp < 60
    trials = model.random_search(df, h, 3, steps=5).collect()
    assert len(trials) == 3 and all(2 <= t.rate * 100 for t in trials)
    with pytest.raises(ValueError):
        model.Hyper(learning_rate=1.0)


def test_perturbation_is_symmetric_and_rare():
    a, b = np.arange(20000), np.arange(20000) * 7 + 1
    w = np.ones(20000, dtype=np.int64)
    x, y = hashing.perturbed(a, b, w), hashing.perturbed(b, a, w)
    assert (x == y).all() and 0.05 < (x > 1).mean() / 0.5 < 0.08 * 2


def test_samples_repeat_and_keep_weights(spark):
    rows = [("g", i, (i + 1) % 6, 2, 6) for i in range(6)] + [("g", (i + 1) % 6, i, 2, 6) for i in range(6)]
    df = spark.createDataFrame([*rows, ("none", None, None, None, 0), ("one", None, None, None, 1)], "repo string, node long, other long, weight long, num_nodes long")
    a = sampling.instances(df, 4, fields=2, nodes=3, falsify_of_256=0).orderBy("instance_id").collect()
    assert a == sampling.instances(df, 4, fields=2, nodes=3, falsify_of_256=0).orderBy("instance_id").collect()
    assert {r.repo for r in a} == {"g", "one"} and all(len(r.x) == 18 for r in a)
    m = np.array(a[0].x).reshape(2, 3, 3)
    assert (m == m.transpose(0, 2, 1)).all() and (m[:, range(3), range(3)] == 0).all()
    assert sampling.random_changes(spark, 2, 5).count() == sampling.random_changes(spark, 2, 5).count()


def test_normalised_ends(spark):
    x = spark.createDataFrame([([0.0, 5.0],)], "x array<double>").select(dataset.normalised(F.col("x"))).first()[0]
    assert abs(x[0] + 0.9179) < 1e-3 and abs(x[1] - 0.9472) < 1e-3


def test_checksum_ignores_order(spark):
    df = spark.createDataFrame([(i, f"row{i}".encode()) for i in range(50)], "instance_id long, b binary")
    one = df.agg(hashing.shuffle_checksum(F.col("b"))).first()[0]
    assert one == dataset.shuffled(df, 3).agg(hashing.shuffle_checksum(F.col("b"))).first()[0] == sum(hashing.xxh64(f"row{i}".encode()) for i in range(50)) % (1 << 64)
    assert hashing.blank_hash(b"") == 0


@pytest.mark.parametrize(
    ("text", "target", "value", "code"),
    [("", "s32", None, 1), ("12", "u8", 12, 0), ("256", "u8", None, 4), ("-1", "u8", None, 3), ("--5", "s8", 5, 0), ("0x1F", "s32", 31, 0), ("0b101", "u8", 5, 0), ("017", "u8", 15, 0), ("3.14159e5", "s32", 314159, 0), ("1.5", "s32", None, 8), ("inf", "f64", math.inf, 0), ("-inF", "f32", -math.inf, 0), ("1e400", "f64", None, 4), ("1e-400", "f64", None, 6), ("1x", "s32", None, 7), ("x", "s32", None, 2), ("1e", "f64", None, 5), ("-128", "s8", -128, 0), ("-129", "s8", None, 3)],
)
def test_numbers(text, target, value, code):
    assert scalar.parse_number(text, target) == (value, code)


def test_numbers_round_trip():
    rng = np.random.default_rng(3)
    for x in rng.integers(0, 1 << 63, 2000).view(np.float64):
        if np.isfinite(x) and x:
            assert scalar.parse_number(repr(float(x)), "f64") == (float(x), 0)
    assert abs(scalar.normal_cdf(scalar.normal_inv(0.3)) - 0.3) < 5e-4


def test_text_tables(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    nums = " ".join(str(i) for i in range(1, 13))
    got = textfiles.trials(lines(f"* 0.5 {nums}", f"  0.7 {nums}", "noise")).orderBy("train").collect()
    assert [(r.best, r.train, r.l2) for r in got] == [(True, 0.5, 12.0), (False, 0.7, 12.0)]
    assert textfiles.scores(lines("   0.123   0.456  -0.012  a/b", "x")).first().repo == "a/b"
    assert {(r.kind, r.value) for r in textfiles.jobs(lines("alarm_jobfile_header 1 1", "repo a/b", "file f")).collect()} == {("repo", "a/b"), ("file", "f")}
    with pytest.raises(ValueError):
        textfiles.jobs(lines("alarm_jobfile_header 2 1", "repo a/b", "file f"))
    (tmp_path / "l").write_text("https://github.com/a/b\nc/d\n")
    (tmp_path / "t").write_text(f"good {tmp_path}/l\n")
    assert {r.repo for r in textfiles.tags(spark, str(tmp_path / "t")).collect()} == {"a/b", "c/d"}


def test_stream_equals_batch(spark, tmp_path):
    from weft.streaming import cochange

    spark.createDataFrame([("r", "1", ["b", "a", "c"]), ("r", "2", ["a", "b"])], "repo string, commit string, items array<string>").write.parquet(str(tmp_path / "in"))
    q = cochange.edge_counts(cochange.change_sets(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("edges").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.lo, r.hi, r.weight) for r in spark.table("edges").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
