import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import svm


@pytest.fixture(scope="module")
def rings():
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (90, 2))
    r = np.hypot(*a.T)
    return a, np.where(r < 0.8, 1, np.where(r < 1.5, 2, 3)).astype(float)


def test_classification_and_probabilities(rings):
    x, y = rings
    m = svm.train(x, y, svm.Parameter(C=50.0, gamma=1.0, probability=True))
    assert (svm.predict(m, x) == y).mean() > 0.95
    p = svm.probabilities(m, x)
    assert np.allclose(p.sum(1), 1) and (np.array(m.labels)[p.argmax(1)] == y).mean() > 0.9
    assert svm.votes(m, x).sum(1).tolist() == [3] * len(x)
    assert (svm.cross_validation(x, y, svm.Parameter(C=50.0, gamma=1.0)) == y).mean() > 0.8
    assert (svm.predict(svm.train(x, y, svm.Parameter(svm_type="nu_svc", nu=0.1, gamma=1.0)), x) == y).mean() > 0.9


def test_the_machine_meets_its_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 3))
    y = np.where(x[:, 0] + 0.3 * rng.normal(0, 1, 60) > 0, 1.0, -1.0)
    m = svm.train(x, np.where(y > 0, 1, 2), svm.Parameter(kernel="linear", C=1.0, eps=1e-6))
    d = svm.decisions(m, x)[:, 0] * np.where(np.array(m.labels)[0] == 1, 1, -1)
    a = np.zeros(60)
    for v, c in zip(m.sv, m.coef[0]):
        a[np.flatnonzero((x == v).all(1))[0]] = abs(c)
    assert (y * d)[a < 1e-9].min() > 1 - 1e-3 and (y * d)[a > 1 - 1e-9].max() < 1 + 1e-3
    free = (a > 1e-6) & (a < 1 - 1e-6)
    assert np.allclose((y * d)[free], 1, atol=1e-3)


def test_regression_and_one_class():
    x = np.linspace(0, 6, 80)[:, None]
    y = np.sin(x[:, 0])
    for kind in ("epsilon_svr", "nu_svr"):
        m = svm.train(x, y, svm.Parameter(svm_type=kind, C=10.0, gamma=1.0, p=0.05, nu=0.3))
        assert np.abs(svm.predict(m, x) - y).mean() < 0.1
    z = np.random.default_rng(3).normal(0, 1, (150, 2))
    m = svm.train(z, np.ones(150), svm.Parameter(svm_type="one_class", nu=0.2, gamma=0.3))
    assert 0.1 < (svm.predict(m, z) < 0).mean() < 0.3 and svm.predict(m, np.array([[9.0, 9.0]]))[0] == -1


def test_model_files_and_checks(rings, tmp_path):
    x, y = rings
    m = svm.train(x, y, svm.Parameter(C=5.0, gamma=0.5, probability=True))
    svm.write_model(m, str(tmp_path / "m"))
    n = svm.read_model(str(tmp_path / "m"), 2)
    assert np.allclose(svm.decisions(m, x), svm.decisions(n, x)) and np.allclose(svm.probabilities(m, x), svm.probabilities(n, x))
    with pytest.raises(ValueError, match="range"):
        svm.train(x, y, svm.Parameter(C=0))


def test_on_tables(spark, rings, tmp_path):
    from loomtext.sources.tables import read_libsvm, write_libsvm

    x, y = rings
    df = spark.createDataFrame([(int(i), float(v), [float(t) for t in r]) for i, (r, v) in enumerate(zip(x, y))], "id long, label double, features array<double>")
    m = svm.train(x, y, svm.Parameter(C=5.0, gamma=0.5, probability=True))
    got = svm.scored(df, m, probability=True).orderBy("id").collect()
    assert [r.prediction for r in got] == svm.predict(m, x).tolist() and len(got[0].probability) == 3
    write_libsvm(df.select("label", "features"), str(tmp_path / "p"))
    back = read_libsvm(spark, str(tmp_path / "p"), 2)
    assert back.count() == 90 and back.agg(F.sum("label")).first()[0] == y.sum()
    cells = svm.grid(spark, x, y, svm.Parameter(), [1.0, 8.0], [0.1, 1.0], 3).collect()
    assert len(cells) == 4 and all(0 <= r.score <= 1 for r in cells)
    c, g, s = svm.smart_grid(x, y, svm.Parameter(), 3, most=12)
    assert s >= 0.6 and c > 0 and g > 0
    t = svm.range_transform(df, "features")
    z = np.array([r[0] for r in df.select(svm.ranged(F.col("features"), t)).collect()])
    assert np.allclose([z.min(0), z.max(0)], [[-1, -1], [1, 1]])
    svm.save_transform(t, str(tmp_path / "t"))
    assert svm.load_transform(str(tmp_path / "t")) == t


def test_deviation_of_a_regression():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (120, 1))
    y = 2 * x[:, 0] + rng.laplace(0, 0.2, 120)
    p = svm.Parameter(svm_type="epsilon_svr", kernel="linear", C=10.0)
    assert svm.deviation(x, y, p) == pytest.approx(0.2, abs=0.07)
    with pytest.raises(ValueError):
        svm.deviation(x, y, svm.Parameter())


def test_files_on_any_file_system(spark, tmp_path):
    m = svm.train(np.array([[0.0, 1.0], [1.0, 0.0], [0.1, 0.9], [0.9, 0.2]]), np.array([1, 2, 1, 2]), svm.Parameter(gamma=0.5))
    path = (tmp_path / "m").as_uri()
    svm.write_model(m, path, spark)
    again = svm.read_model(path, 2, spark)
    assert np.allclose(svm.decisions(m, m.sv), svm.decisions(again, m.sv))
    with pytest.raises(FileNotFoundError):
        svm.load_transform(f"{path}-none", spark)


def test_results_of_lines(spark):
    from loomtext.operators import evaluate

    lines = spark.createDataFrame([("+1 0.9",), ("-1 0.4",), ("bad",), ("1 x",), ("0 0.2",)], "value string")
    assert sorted(map(tuple, evaluate.parse_results(lines).collect())) == [(0.2, False), (0.4, False), (0.9, True)]
