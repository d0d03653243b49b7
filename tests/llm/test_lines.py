import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barwright.llm.lines import drop_common_lines
from texts import docs, rows_of

BLANKS = " \t\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\x0c\r")


def brute(rows, min_docs, min_chars=1):
    seen = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(seen[key(x)]) >= min_docs)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,min_docs", [(1, 3), (2, 10), (3, 2)])
def test_equals_brute_force(spark, seed, min_docs):
    rng = random.Random(seed)
    pool = ["Common Line", "common line ", "\tCOMMON LINE\r", "", "  ", "É", "é", "x", "[a] b\\c", "İ", "\xa0", "end"]
    rows = []
    for doc in range(40):
        text = "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {doc} {i}" for i in range(rng.randrange(9)))
        rows.append((doc if rng.random() < 0.95 else None, text if rng.random() < 0.9 else None))
    rows += [rows[0], rows[1], (5, "another text under a known id\ncommon line")]
    got = rows_of(drop_common_lines(docs(spark, rows), min_docs=min_docs), "doc_id", "n_lines", "n_dropped", "text")
    assert got == brute(rows, min_docs)


def test_all_columns_pass_and_names_may_clash(spark):
    df = docs(spark, [(i, "same\nown %d" % i) for i in range(12)]).select(
        "*", F.lit(7).alias("pos"), F.lit("k").alias("key"), F.lit(1).alias("d"), F.lit(2).alias("t"), F.lit(3).alias("drops"),
        F.lit(4).alias("kept"), F.lit(5).alias("parts"), F.lit(6).alias("h1"), F.lit(8).alias("a.b"), F.lit(9).alias("n_lines"),
    )
    out = drop_common_lines(df)
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    row = out.filter("doc_id = 3").first()
    assert (row.text, row.pos, row.d, row.t, row.drops, row["a.b"], row.n_lines, row.n_dropped) == ("own 3", 7, 1, 2, 3, 8, 2, 1)


def test_empty_table_and_long_text(spark):
    assert drop_common_lines(docs(spark, [])).count() == 0
    text = "\n".join(f"line {i % 5000}" for i in range(60_000))
    rows = [(i, text) for i in range(10)] + [(99, "x\n" + text)]
    out = {r.doc_id: r for r in drop_common_lines(docs(spark, rows)).collect()}
    assert out[0].text == "" and out[0].n_dropped == 60_000 and out[99].text == "x"


def test_no_python_runs(spark):
    plan = drop_common_lines(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_digest_matches_hashlib(spark):
    out = drop_common_lines(docs(spark, [(1, "é\n漢")])).select(F.sha2("text", 256)).first()[0]
    assert out == hashlib.sha256("é\n漢".encode()).hexdigest()
