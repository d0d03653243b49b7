import random
import re
from collections import Counter

from pyspark.sql import functions as F

from barwright.llm import rules
from texts import docs, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )


def failed(text):
    n, *_, repeated = brute(text)
    return n < 50 or 100 * repeated > 50 * n


TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "a a a a", "x\x0by\x0cz\rw\x1cv\x85u t", "é\né\n É\n\n \né", "#|<>| &%$*",
    "a b c d\na b c d\na b c d \n", "\n".join(["same line"] * 40), "end\n", "\nstart", "q " * 60, prose(1, 300), prose(2, 20_000),
    " ".join(["very", "long"] * 30_000),
]


def test_counts_equal_a_plain_count(spark):
    rows = list(enumerate(TEXTS)) + [(3, "again"), (None, "no id at all")]
    got = rules.measure(docs(spark, rows)).select("doc_id", *rules.COUNTS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)


def test_whole_table(spark, sf_dir):
    from barwright.llm.queries import op13_quality_rules

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op13_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == failed(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.rule is None)


def table(spark, many, seed=3):
    """Documents of three kinds: plain, with symbols, in short lines of capitals."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(many):
        words = prose(i, 80 + rng.randrange(200)).split()
        kind = i % 6
        if kind == 4:
            words = [w[:-1] + rng.choice("#$%") for w in words]
        if kind == 5:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind < 4), 0))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_order(spark):
    given, labels = table(spark, 1200)
    got = rules.judge(given, labels.filter("doc_id div 6 % 2 = 0")).filter("doc_id div 6 % 2 = 1").collect()
    wrong = [r for r in got if not r.base_failed and r.kept != (r.doc_id % 6 < 4)]
    assert len(got) == 600 and len(wrong) <= 6
    assert {r.rule for r in got} == {None, 1, 2}  # one rule for each kind


def test_the_list_is_the_first_rule_that_applies(spark):
    a = rules.Rule((rules.Condition("size", True, 5), rules.Condition("upper", False, 3)))
    b = rules.Rule((rules.Condition("size", True, 2),))
    rows = spark.createDataFrame([(6, 1), (6, 9), (1, 1)], "size int, upper int")
    assert [r[0] for r in rows.select(rules.DecisionList([a, b]).verdict()).collect()] == [1, 2, None]
    assert str(a) == "size >= 5 and upper <= 3"


def test_best_condition_is_the_one_of_all_thresholds():
    rng = random.Random(5)
    rows = [(rng.randrange(30), rng.random() < 0.4) for _ in range(400)]
    rows += [(v, True) for v in range(20, 26)] * 9
    values = sorted({v for v, _ in rows})
    hist = [(v, sum(1 for x, bad in rows if x == v and bad), sum(1 for x, bad in rows if x == v and not bad)) for v in values]
    gain, found, good = rules.best_condition({"m": hist}, 5)

    def gains(keep):
        import math

        b, g = sum(1 for x, bad in rows if keep(x) and bad), sum(1 for x, bad in rows if keep(x) and not bad)
        whole = sum(1 for _, bad in rows if bad) / len(rows)
        return (b * (math.log2(b / (b + g)) - math.log2(whole)) if b >= 5 else 0), g

    every = [gains(lambda x, v=v: x >= v) for v in values] + [gains(lambda x, v=v: x <= v) for v in values]
    assert abs(gain - max(every)[0]) < 1e-9
    assert good == gains(lambda x: x >= found.bound if found.at_least else x <= found.bound)[1]


def test_without_usable_labels_only_the_base_test_rejects(spark):
    given, labels = table(spark, 60)
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        got = rules.judge(given, some).collect()
        assert len(got) == 60 and all(r.kept != r.base_failed for r in got)


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    given, labels = table(spark, 240)
    assert rules.judge(given.limit(0), labels).collect() == []
    odd = given.unionByName(given.limit(30)).withColumns({n: F.lit(None) for n in ("n_words", "kept", "rule", "words", "a.b")})
    got = rules.judge(odd, labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 0, 0)], labels.schema))).collect()
    assert len(got) == 270


def test_plan_has_no_python(spark, sf_dir):
    from barwright.llm.queries import op13_quality_rules

    plan = op13_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    measured = rules.measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in measured and "Arrow" not in measured
