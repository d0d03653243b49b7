import random

import numpy as np
from pyspark.sql import functions as F

from barwright.llm import quality
from texts import docs, prose


def corpus(n, seed=1):
    """Texts with their grades: junk, good with an insult in one of its forms, good."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(i, rng.randrange(30, 200)).split(" ")
        grade = rng.choice([0, 1, 2, 2, 2])
        if grade == 0:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        elif grade == 1:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "grubl" + rng.choice(["", "ik", "osh", "ar"])
        rows.append((i, " ".join(words), grade))
    return rows


def labels(spark, rows):
    return spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus(1600)
    df = docs(spark, [(i, t) for i, t, _ in rows])
    model = quality.train(df, labels(spark, rows[:1000]))
    got = {r.doc_id: r for r in quality.grade_documents(df, model).collect()}
    held = rows[1000:]
    kept = {g: np.mean([got[i].kept for i, _, own in held if own == g]) for g in (0, 1, 2)}
    assert kept[2] >= 0.98 and kept[1] <= 0.1 and kept[0] <= 0.02
    mean = {g: np.mean([got[i].expected_grade for i, _, own in held if own == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    for r in got.values():
        assert 0 <= r.p_good <= r.p_not_low <= 1 and abs(r.expected_grade - r.p_good - r.p_not_low) < 1e-12
    assert model.thresholds[0] < model.thresholds[1]
    good = quality.keep_good(df.withColumn("extra.column", F.lit(1)), model)
    assert good.columns == [*df.columns, "extra.column"]
    assert {r.doc_id for r in good.collect()} == {i for i, r in got.items() if r.kept}


def test_the_fit_takes_a_bounded_number_of_rows(spark):
    rows = corpus(300)
    df = docs(spark, [(i, t) for i, t, _ in rows])
    small = quality.train(df, labels(spark, rows), most_rows=50, most_weights=20)
    assert len(small.features) <= 20
    again = quality.train(df.repartition(7), labels(spark, rows).repartition(3), most_rows=50, most_weights=20)
    assert (small.features == again.features).all() and np.allclose(small.weights, again.weights)


def test_labels_and_texts_at_the_edge(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "c"), (1, "a b"), (4, "x " * 50_000)]
    df = docs(spark, rows).select("*", F.lit(1).alias("grade"), F.lit(2).alias("features"), F.lit(3).alias("_id"))
    schema = "doc_id long, quality int, toxic int"
    cases = {
        (): 2.0, ((1, 1, 0), (2, 1, 0)): 2.0, ((1, 0, 0),): 0.0, ((1, 1, 1),): 1.0, ((1, 1, 0), (1, 0, 0)): 0.0,
        ((None, 1, 0), (1, None, 0), (2, 1, None)): 2.0,
    }
    for given, grade in cases.items():
        model = quality.train(df, spark.createDataFrame(list(given), schema))
        got = quality.grade_documents(df, model).collect()
        assert len(got) == len(rows) and all(abs(r.expected_grade - grade) < 1e-6 for r in got)
    assert quality.grade_documents(docs(spark, []), model).count() == 0 and quality.keep_good(docs(spark, []), model).count() == 0
    mixed = quality.train(df, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (77, 0, 0)], schema))
    assert quality.grade_documents(df, mixed).count() == len(rows)
