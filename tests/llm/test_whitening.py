"""Embedding whitening: eigenvectors of planted spectra, whole results against a plain version, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import whitening as W
from weftwork.llm.common import ready

SCHEMA = "vec_id bigint, embedding array<float>, n int, `Whitened` string"


def planted(values, seed=1):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(len(q)) - q.T @ q) / 2
    return (q * np.asarray(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize("values, tolerance", [
    (np.linspace(9, 1, 40), 1e-15), (10.0 ** np.linspace(5, 0, 30), 1e-13), (np.r_[2 + 1e-5 * np.arange(12), np.linspace(9, 3, 20)], 1e-12),
    (np.r_[1 + 1e-9 * np.arange(6), np.linspace(9, 3, 20)], 1e-8), ([3.0], 0)])
def test_vectors_of_planted_spectra(values, tolerance):
    v, q = planted(values)
    order = np.argsort(-np.asarray(values))
    got, x = W.eigen(v)
    assert np.allclose(got, np.asarray(values)[order], rtol=1e-14)
    close = [min(np.abs(x[:, i] - q[:, o]).max(), np.abs(x[:, i] + q[:, o]).max()) for i, o in enumerate(order)]
    assert max(close) <= tolerance
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-14


def test_equal_eigenvalues_span_their_space():
    v, q = planted(np.r_[5 * np.ones(4), np.ones(6), np.zeros(3)])
    values, x = W.eigen(v)
    assert np.allclose(values, np.r_[5 * np.ones(4), np.ones(6), np.zeros(3)], atol=1e-15)
    for a, b in ((0, 4), (4, 10)):
        assert np.abs(x[:, a:b] @ x[:, a:b].T - (q[:, a:b] @ q[:, a:b].T).astype(float)).max() < 1e-14
    assert np.abs(v.astype(float) @ x - x * values).max() < 1e-14
    zero, unit = W.eigen(np.zeros((3, 3), np.longdouble))
    assert not zero.any() and np.array_equal(unit, np.eye(3))


def by_hand(vectors, components=8):
    """n, deviations (Python integers), whitened, explained: all at once on one machine."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, total = len(x), [int(s) for s in x.sum(0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, total)) for row in x]
    c = (n * x - np.array(total)) / n
    values, q = np.linalg.eigh(c.T @ c / n)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    return n, deviation, c @ q / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whole_result_against_plain_version(spark):
    ready(spark)
    rng = np.random.default_rng(7)
    vectors = (rng.normal(size=(600, 12)) * np.geomspace(1, 0.05, 12) + rng.normal(size=12) * 3).astype(np.float32)
    vectors[200:320] = vectors[0]          # a very common vector
    bad = [(1000, None), (1001, []), (1002, [None] * 12), (1003, [float("nan")] * 12), (1004, [float("inf")] + [0.0] * 11), (None, vectors[3].tolist())]
    rows = [(i, v.tolist(), 1, "w") for i, v in enumerate(vectors)] + [(i, v, 1, "w") for i, v in bad]
    out = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert out.columns == ["vec_id", "embedding", "n", "Whitened", "n_", "deviation", "whitened_", "explained"]
    got = {r.vec_id: r for r in out.collect()}
    assert set(got) == set(range(600)) | {None}
    n, deviation, white, explained = by_hand([*vectors, vectors[3]])
    assert {r.n_ for r in got.values()} == {n == 601 and 601}
    for i in (*range(600), None):
        at = 600 if i is None else i
        assert got[i].deviation == deviation[at]
        assert np.allclose(got[i].explained, explained, rtol=1e-9)
    mine = np.array([got[i].whitened_ for i in (*range(600), None)])
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine - white * sign).max() < 1e-9
    assert W.identity_error(out, "whitened_") < 1e-9


def test_covariance_does_not_depend_on_partitions(spark):
    ready(spark)
    rows = spark.createDataFrame([(i, [float(np.sin(i * j)) for j in range(1, 7)], 1, "") for i in range(300)], SCHEMA)
    one, many = W.covariance(rows.coalesce(1), "embedding"), W.covariance(rows.repartition(13), "embedding")
    assert one[:2] == many[:2] and np.array_equal(one[2], many[2])


def test_few_rows_rank_and_errors(spark):
    ready(spark)
    frame = lambda vs: spark.createDataFrame([(i, v, 1, "") for i, v in enumerate(vs)], SCHEMA)
    assert W.whiten(frame([[1.0, 2.0]]).limit(0)).count() == 0
    assert W.whiten(frame([None, []])).count() == 0
    one = W.whiten(frame([[1.0, 2.0]] * 3)).collect()
    assert [(r.deviation, r.whitened_, r.explained) for r in one] == [(0, [], [])] * 3 and W.identity_error(W.whiten(frame([[1.0, 2.0]] * 3)), "whitened_") == 0
    line = W.whiten(frame([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])).collect()      # rank one
    assert [len(r.whitened_) for r in line] == [1, 1, 1] and np.allclose(np.abs([r.whitened_[0] for r in line]), [1.5 ** 0.5, 0, 1.5 ** 0.5])
    assert all(r.explained == [1.0] for r in line)
    with pytest.raises(Exception, match="different lengths"):
        W.whiten(frame([[1.0, 2.0], [1.0]])).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        W.whiten(frame([[3e38], [0.0]])).collect()


def test_query_gives_a_row_for_each_component(spark):
    from weftwork.llm.queries import QUERIES

    rows = QUERIES["op12_refined_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                 "explained": "double", "identity_error": "double"}
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where(W.usable(F.col("embedding"))).orderBy("vec_id").collect()
    n, deviation, white, explained = by_hand([r.embedding for r in table])
    got = {(r.vec_id, r.component): r for r in rows.collect()}
    assert len(got) == 8 * n
    for c in range(8):
        mine = np.array([got[r.vec_id, c + 1].whitened for r in table])
        assert np.abs(mine - white[:, c] * np.sign(mine @ white[:, c])).max() < 1e-8
    assert all(got[r.vec_id, 1].deviation == d for r, d in zip(table, deviation))
    assert max(r.identity_error for r in got.values()) < 1e-9
