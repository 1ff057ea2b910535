"""The subject model keeps features apart that a small table of buckets throws together."""

import numpy as np
import pandas as pd

from leafmill.llm import subject


def test_features_of_a_language_hardly_share_buckets():
    words = [chr(0x4E00 + i) + chr(0x4E00 + j) for i in range(130) for j in range(130, 262)]  # about as many pairs as the Han pages of sf0.1 have
    text = "。".join(words)
    (out,) = subject._features(iter([pd.DataFrame({"src_id": [1], "text": [text]})]))
    ids = np.concatenate(out["ids"].to_numpy())
    assert len(ids) == len(words) and len(set(ids)) >= 0.95 * len(words)


def test_model_is_that_of_the_seen_features():
    """Against the weights written out, and with features never seen left out of the score."""
    counts = np.array([[3, 0, 1], [0, 2, 2], [5, 1, 0], [4, 4, 4]], dtype=np.float32)
    features = np.array([0, 7, 9, subject.FEATURES + 1])
    model = subject.Model(features, counts)
    comp = subject.SMOOTHING + counts[:3].sum(axis=1, keepdims=True) - counts[:3]
    w = np.log(comp / comp.sum(axis=0))
    want = np.exp((w.mean(axis=1, keepdims=True) - w)[[0, 2]].sum(axis=0))
    got = model.posteriors(np.array([0, 9, 11]), np.array([0]))
    assert np.allclose(got[0], want / want.sum(), atol=1e-5)


def test_expected_counts(spark):
    rows = spark.createDataFrame([(1, [5, 9, 5 + subject.FEATURES], [2, 1]), (2, [9], [1]), (3, [11], [1])], "src_id long, ids array<int>, sizes array<int>").repartition(3)
    features, counts = subject._expected(rows, {1: [0], 2: [1]}, 2, None)
    sure = (1 + subject.LABEL_TRUST) / 2
    assert features.tolist() == [5, 9, 5 + subject.FEATURES]
    assert np.allclose(counts, [[sure, 1 - sure], [1, 1], [sure, 1 - sure]], atol=1e-5)
