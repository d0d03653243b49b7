import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from barwright.llm import merkle
from texts import DOCS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Levels of a tree from its leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def climb(levels, at, node, proof):
    for level in levels[:-1]:
        first = at // 3 * 3
        run = level[first : first + 3]
        left, right = run[: at - first], run[at - first + 1 :]
        node, proof, at = sha(*left, node, *right), [*proof, *left, *right], at // 3
    return node, proof


def brute(rows, found):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, ordered = {}, {}
    for s in sources:
        ordered[s] = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in ordered[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for at_source, s in enumerate(sources):
        for at, row in enumerate(ordered[s]):
            node, proof = climb(trees[s], at, leaf(row, found(row)), [])
            node, proof = climb(top, at_source, node, proof)
            out.append((row[0], leaf(row, row[1]), trees[s][-1][0], top[-1][0], sha(*proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    out = merkle.verify_texts(docs, F.translate("text", "\n", ""))
    return sorted([tuple(r) for r in out.collect()], key=repr)


def check(spark, rows):
    assert run(spark, rows) == brute(rows, lambda r: None if r[1] is None else r[1].replace("\n", ""))


def row(i, text, source, lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.mark.parametrize("many", [1, 3, 10, 730])
def test_sizes_of_one_source(spark, many):
    check(spark, [row(i * 7, f"text {i}\nand" if i % 3 else f"text {i}", "a") for i in range(many)])


def test_many_sources_nulls_and_repeated_rows(spark):
    rows = [row(i, f"t{i}\n", f"s{i % 40}é") for i in range(200)]
    rows += [row(None, None, None, None), row(None, "", None), row(5, "", None), row(5, "x\ny", None), row(6, "z", "")]
    rows += [row(77, "same\ntext", "hot")] * 30 + [row(78, "other", "hot")]
    rows += [row(900, "w\n" * 50_000, "s1é")]
    check(spark, rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "SPAN", 9)
    check(spark, [row(i, f"text {i}\n" if i % 5 else f"{i}", "big" if i % 3 else f"x{i % 12}") for i in range(600)])


def test_a_few_requests(spark):
    rows = [row(i, f"text {i}", "a" if i % 2 else "b") for i in range(2000)]
    made = merkle.manifest(spark.createDataFrame(rows, DOCS))
    some = made.leaves.filter("doc_id in (3, 1500, 1501)").select("tree", "rank", "doc_id", F.col("digest").alias("claimed"))
    got = merkle.prove(made, some.unionByName(some.withColumn("claimed", F.sha2(F.lit("wrong"), 256))))
    assert sorted((r.doc_id, r.verified) for r in got.collect()) == [(i, v) for i in (3, 1500, 1501) for v in (False, True)]
    truth = {r[0]: r[4] for r in brute(rows, lambda r: r[1])}
    assert all(r.proof_sha256 == truth[r.doc_id] for r in got.collect())


def test_extra_and_clashing_columns(spark):
    rows = [row(i, f"t{i}\n", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(1) for n in ("rank", "tree", "size", "digest", "root", "a.b")})
    got = merkle.verify_texts(docs, F.translate("text", "\n", "")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, lambda r: r[1].replace("\n", ""))


def test_tampering_by_checksum(spark, sf_dir):
    from barwright.llm.queries import op12_merkle_manifest

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op12_merkle_manifest(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in texts[r.doc_id]
        assert r.verified is not changed
