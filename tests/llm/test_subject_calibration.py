"""Calibration by area, and chunks that say more than their pages."""

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import subject


def test_each_area_has_its_own_line():
    rng = np.random.default_rng(3)
    truth = rng.random((3000, 2)) < 0.4
    # The shares of the first area run low, those of the second high.
    shares = np.where(truth, rng.normal([0.3, 0.6], 0.05, (3000, 2)), rng.normal([0.1, 0.4], 0.05, (3000, 2)))
    wrong = rng.random((3000, 2)) < 0.03
    lines = subject._calibrated(shares, np.where(wrong, ~truth, truth).astype(float))
    middle = -lines[:, 1] / lines[:, 0]
    assert abs(middle[0] - 0.2) < 0.04 and abs(middle[1] - 0.5) < 0.04
    assert subject._calibrated(np.zeros((0, 2)), np.zeros((0, 2))).shape == (2, 2)


def test_few_labels_lean_on_all_areas():
    x, y = np.repeat([[0.1], [0.5]], 200, axis=0), np.repeat([[0.0], [1.0]], 200, axis=0)
    shares, truth = np.hstack([x, np.full((400, 1), 0.1)]), np.hstack([y, np.zeros((400, 1))])
    lines = subject._calibrated(shares, truth)
    assert 1 / (1 + np.exp(-(lines[1, 0] * 0.6 + lines[1, 1]))) > 0.5


def test_blocks_of_chunks_that_no_page_holds_are_read(spark):
    pages = spark.createDataFrame([(1, "one\n\ntwo "), (2, "x"), (None, "y")], "src_id long, text string")
    chunks = spark.createDataFrame([(1, "two\n \nthree\n\n\none"), (2, "two"), (3, None), (3, "")], "src_id long, text string")
    own = subject._blocks(chunks).join(subject._blocks(pages).select("src_id", "block"), ["src_id", "block"], "left_anti")
    assert sorted(tuple(r) for r in own.select("src_id", "text").collect()) == [(1, "three"), (2, "two")]
    assert own.filter(F.col("text").isNull()).count() == 0
