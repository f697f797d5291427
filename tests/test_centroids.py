"""Centroids of any number of classes, against plain numpy."""

import numpy as np

from spendlens.operators import models


def test_more_classes_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(models, "CLASS_BLOCK", 100)
    rng = np.random.default_rng(3)
    classes = rng.normal(size=(1300, 4))
    classes[7] = classes[3]  # a tie: the smaller label wins
    names = [f"c{i:04d}" for i in range(1300)]
    rows = [(i, rng.normal(size=4)) for i in range(25)] + [(25, classes[7]), (26, np.zeros(4)), (27, classes[7])]
    centroids = spark.createDataFrame([(n, c.tolist()) for n, c in zip(names, classes)], "label string, centroid array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in rows] + [(28, None)], "i int, vector array<double>")
    got = {r.i: (r.predicted, r.similarity) for r in models.nearest_centroid(asked, centroids).collect()}
    assert len(got) == 29
    for i, v in rows:
        size = np.linalg.norm(classes, axis=1) * np.linalg.norm(v)
        similarity = np.round(np.divide(classes @ v, size, out=np.zeros(1300), where=size > 0), 6)
        assert got[i][0] == names[int(np.argmax(similarity))] and abs(got[i][1] - similarity.max()) < 2e-6
    assert got[25][0] == "c0003" and got[26] == ("c0000", 0.0)
    assert models.nearest_centroid(asked, centroids.limit(0)).where("predicted is null").count() == 29
