"""The trained classifier: gradients by differences, Adam by the formula, epochs over parts, defined errors."""

import numpy as np
import pytest

from lenswork.operators import ml as M
from lenswork.operators import network as N

ROWS = "features array<double>, label int"


def table(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([((rng.normal(0, 0.3, 6) + np.eye(6)[k % 4] * 2).tolist(), k % 4) for k in range(n)], ROWS)


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    net = N.new_network(5, 7, 3, seed=2)
    x, y = rng.normal(size=(9, 5)), rng.integers(0, 3, 9)
    mask = (rng.random((9, 7)) >= 0.2) / 0.8
    for m in (None, mask):
        _, gradient = N.loss_and_gradient(net.weights, x, y, m)
        for k in N.NAMES:
            for at in list(np.ndindex(net.weights[k].shape))[::3]:
                w = {n: v.copy() for n, v in net.weights.items()}
                w[k][at] += 1e-6
                up = N.loss_and_gradient(w, x, y, m)[0]
                w[k][at] -= 2e-6
                down = N.loss_and_gradient(w, x, y, m)[0]
                assert abs((up - down) / 2e-6 - gradient[k][at]) < 1e-5


def test_first_adam_step_is_the_rate():
    net = N.new_network(2, 3, 2)
    before = net.weights["w1"].copy()
    N.adam_step(net, {k: np.full_like(v, -5.0) for k, v in net.weights.items()}, 0.01)
    assert np.allclose(net.weights["w1"] - before, 0.01) and net.steps == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_epochs_learn(spark, parts, tmp_path):
    rows = table(spark)
    net = N.train_network(rows, epochs=6, batch_size=20, rate=0.02, hidden=16, classes=4, parts=parts)
    assert len(net.losses) == 6 and net.losses[-1] < 0.5 * net.losses[0]
    assert M.evaluate(N.predict_network(net, rows)).first().accuracy > 0.95
    assert [r.epoch for r in N.epoch_losses(spark, net).collect()] == [1, 2, 3, 4, 5, 6]
    N.save_network(spark, net, str(tmp_path / "n"))
    again = N.load_network(spark, str(tmp_path / "n"))
    assert all((again.weights[k] == net.weights[k]).all() for k in N.NAMES) and again.losses == net.losses and again.steps == net.steps
    same = N.train_network(rows, epochs=6, batch_size=20, rate=0.02, hidden=16, classes=4, parts=parts)
    assert np.allclose(same.losses, net.losses)


def test_rows_that_cannot_be_learned(spark):
    empty = spark.createDataFrame([], ROWS)
    for rows in (empty, spark.createDataFrame([(None, 1), ([1.0], None)], ROWS)):
        with pytest.raises(ValueError, match="no rows"):
            N.train_network(rows)
    with pytest.raises(ValueError, match="one length"):
        N.train_network(spark.createDataFrame([([1.0], 1), ([1.0, 2.0], 1)], ROWS))
    with pytest.raises(ValueError, match="below 10"):
        N.train_network(spark.createDataFrame([([1.0], 10)], ROWS))
    with pytest.raises(ValueError, match="no rows"):
        M.train_classifier(empty)
    some = N.predict_network(N.new_network(1, 4, 3), spark.createDataFrame([(None, 1), ([1.0], 2)], ROWS)).orderBy("label").collect()
    assert some[0].digit is None and some[0].probabilities is None and len(some[1].probabilities) == 3
