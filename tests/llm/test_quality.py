import random

import numpy as np
from pyspark.sql import functions as F
from skylocus.llm import quality
from skylocus.llm.common import table


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(400)]
    rows, rated = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randrange(5, 60))
        grade = i % 3
        if grade == 0:
            w = [x.upper() + "!!" for x in w] if i % 2 else [w[0]] * len(w)
        elif grade == 1:
            w[1] = "awful"
            w[3] = "nasty"
        rows.append((i, " ".join(w)))
        rated.append((i, grade))
    return rows, rated


def test_held_out_accuracy():
    rows, rated = corpus(1200, 5)
    feats = [quality.features(t) for _, t in rows]
    y = np.array([g for _, g in rated])
    model = quality.fit(feats[:800], y[:800])
    tails = model.tails(np.array([model.score(t) for _, t in rows[800:]]))
    assert np.all(np.diff(model.thresholds) > 0)
    assert np.mean((tails[:, 0] >= 0.5) == (y[800:] >= 1)) > 0.95
    assert np.mean((tails[:, 1] >= 0.5) == (y[800:] >= 2)) > 0.75


def test_held_out_on_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rated = quality.grades(labels)
    model = quality.train(docs, rated.where("doc_id % 2 = 0"))
    got = quality.score(docs, model).join(rated.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum(r.kept == (r.grade >= 1) for r in got) / len(got)
    lost = [r for r in got if r.grade >= 1 and not r.kept]
    assert right > 0.9 and len(lost) <= 0.03 * len(got)


def test_gradient_is_of_the_likelihood():
    """The fitted thresholds alone reproduce the shares of the grades."""
    y = np.array([0] * 20 + [1] * 30 + [2] * 50)
    model = quality.fit([quality.features("") for _ in y], y, steps=400)
    tails = model.tails(np.array([model.score("")]))[0]
    assert abs(tails[0] - 0.8) < 0.03 and abs(tails[1] - 0.5) < 0.03


def test_cases(spark, make_docs):
    rows, rated = corpus(90, 1)
    docs = make_docs([*rows, (500, None), (501, ""), (502, "w " * 50_000), (0, rows[0][1])]).withColumn("kept", F.lit("clash")).withColumn("id", F.lit(0))
    grades = spark.createDataFrame([*rated, (0, None), (None, 1), (77_777, 2)], "doc_id long, grade int")
    got = quality.score(docs, quality.train(docs, grades)).collect()
    assert len(got) == len(rows) + 4 and all(r.tail_prob is not None for r in got)
    kept = quality.keep_good(docs, grades)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in got if r.kept)


def test_no_ratings_keep_all(spark, make_docs):
    docs, none = make_docs([(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, grade int")
    assert [r.kept for r in quality.score(docs, quality.train(docs, none)).collect()] == [True, True]
    assert quality.keep_good(docs, none).count() == 2
    assert quality.score(make_docs([]), quality.train(make_docs([]), none)).count() == 0


def test_fit_is_bounded(spark, make_docs):
    rows, rated = corpus(60, 2)
    docs, grades = make_docs(rows), spark.createDataFrame(rated, "doc_id long, grade int")
    a, b = (quality.train(docs.repartition(n), grades, max_train=30) for n in (1, 3))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)
