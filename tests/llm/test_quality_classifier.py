import random

import numpy as np
import pytest

from veilframe.llm import quality_classifier as Q


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    for i in range(n):
        grade = rnd.choice([0, 1, 2, 2])
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))]
        if grade == 0:
            words += rnd.choices(["vile", "nasty", "awful"], k=2)
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        rnd.shuffle(words)
        yield i, " ".join(words), grade


def test_held_out_accuracy_and_order(spark):
    rows = list(corpus(1600, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = Q.fit(df.filter("doc_id < 1000").select("doc_id", "text"), df.select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    scored = Q.score(df.filter("doc_id >= 1000"), model).collect()
    truth = {i: g for i, _, g in rows}
    guess = {r.doc_id: round(r.expected_grade) for r in scored}
    assert np.mean([guess[i] == truth[i] for i in guess]) > 0.9
    assert all(0 <= r.tail_probability <= r.expected_grade / 2 + 0.5 for r in scored)


def test_gradients_reach_the_classes_frequencies():
    grade = np.array([0] * 100 + [1] * 300 + [2] * 600)
    model = Q.fit_rows([np.array([1])] * 1000, grade)  # a feature that all have is no feature
    above = model.at_least(np.zeros(1))[0]
    assert above == pytest.approx([0.9, 0.6], abs=0.02)


def test_nulls_clashes_and_one_grade(spark):
    rows = list(corpus(200, 3))
    df = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows] + [(900, None, 7.0), (901, "", 7.0)], "doc_id long, text string, expected_grade double")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(900, 1), (5, None), (None, 1)], "doc_id long, grade int")
    model = Q.fit(df, ratings)
    out = Q.score(df, model)
    assert out.columns == ["doc_id", "text", "expected_grade", "tail_probability"] and out.count() == 202
    assert Q.score(df.limit(0), model).collect() == []
    with pytest.raises(ValueError):
        Q.fit(df, ratings.filter("grade = 1"))


def test_the_sample_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(list(corpus(300, 4)), "doc_id long, text string, grade int")
    a = Q.fit(df, df, max_rows=150)
    b = Q.fit(df.repartition(5), df.repartition(3), max_rows=150)
    assert np.array_equal(a.weights, b.weights)


def test_weights_against_a_plain_likelihood(spark):
    """An own fit of the cumulative-link model, by numerical gradients of a likelihood written out, reaches no higher than ours, ridge included."""
    import random

    import numpy as np

    from veilframe.llm import quality_classifier as Q

    rnd = random.Random(2)
    kinds = {0: "bad awful", 1: "plain dull", 2: "good fine"}
    rows = [(i, g, " ".join(rnd.choice((kinds[rnd.choice((g, g, 1))] + " the a of").split()) for _ in range(30))) for i in range(240) for g in [i % 3]]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    model = Q.fit(df, spark.createDataFrame([(i, g) for i, g, _ in rows], "doc_id long, grade int"))
    assert (np.diff(model.thresholds) > 0).all()
    used = np.flatnonzero(model.weights)
    present = np.array([np.isin(used, Q.features(t)) for _, _, t in rows], float)
    grade = np.array([g for _, g, _ in rows])

    def worth(weights, thresholds):
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        below = 1 / (1 + np.exp(-(edges[None, :] - (present @ weights)[:, None])))
        return np.log(below[np.arange(len(grade)), grade + 1] - below[np.arange(len(grade)), grade]).mean() - Q.RIDGE / 2 * (weights**2).sum()

    ours, step, rng = worth(model.weights[used], model.thresholds), 1e-4, np.random.default_rng(0)
    values = np.concatenate([model.weights[used], model.thresholds])
    at = lambda v: worth(v[: len(used)], v[len(used) :])
    slope = np.array([(at(values + step * e) - at(values - step * e)) / (2 * step) for e in np.eye(len(values))])
    assert np.abs(slope).max() < 0.02
    assert all(at(values + 0.3 * d / np.linalg.norm(d)) <= ours + 1e-3 for d in rng.normal(size=(200, len(values))))
    scores = {r.doc_id: r.expected_grade for r in Q.score(df, model).collect()}
    expect = (1 / (1 + np.exp(-((present @ model.weights[used])[:, None] - model.thresholds[None, :])))).sum(1)
    assert np.allclose([scores[i] for i, _, _ in rows], expect)
