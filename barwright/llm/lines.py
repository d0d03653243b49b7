"""Line dedup: lines that many documents share are dropped everywhere.

Lines are exploded, their normalised form is hashed to 128 bits, documents are counted per hash, and the lines
of hashes over the threshold are dropped; the rest is put together again by position. Only functions of the
DataFrame API run here.

Shuffles carry hashes and positions, and once the whole texts to meet their positions. The lines of one frequent key are counted after a
combine per task, and the join that finds them reads two written or exchanged sides, so its hot partitions can
be split at run time.

Defined cases
- A null or empty text is one empty line. Lines of blanks have the empty key, which ``min_chars`` leaves out.
- Documents are told apart by ``doc_id``; all rows with a null one count as one document. Rows that repeat
  a ``doc_id`` are cut by their own text.
- A text that loses all lines becomes the empty string.
- Other columns are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import WHITE, ascii_lower, column, digest128, fresh
from barwright.session import materialize


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``d, t, pos, h1, h2`` of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(
        column(doc_id).alias("d"),
        F.xxhash64(column(text)).alias("t"),
        F.posexplode(split_lines(ascii_lower(column(text)))).alias("pos", "line"),
    ).select("d", "t", "pos", F.btrim("line", F.lit(WHITE)).alias("key"))
    return lines.filter(F.length("key") >= min_chars).select("d", "t", "pos", *digest128(F.col("key"), "h"))


def drop_common_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """All rows and columns of ``docs`` with the text's frequent lines dropped, plus ``n_lines`` and ``n_dropped``."""
    lines = hashed_lines(docs, doc_id, text, min_chars)
    # one row for each key and document first, so that counting is a sum that every task combines before it sends
    frequent = materialize(
        lines.groupBy("h1", "h2", "d").agg(F.lit(1).alias("n")).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= min_docs).select("h1", "h2"),
        "frequent-lines",
    )
    drops = lines.join(frequent, ["h1", "h2"], "left_semi").groupBy("d", "t").agg(F.collect_set("pos").alias("drops"))
    d, t, drop, kept, parts = fresh([*docs.columns, "n_lines", "n_dropped"], "d", "t", "drops", "kept", "parts")
    # texts are dealt by id at every size: the list of positions grows with the documents
    drops = drops.select(F.col("d").alias(d), F.col("t").alias(t), F.col("drops").alias(drop)).hint("merge")
    base = docs.withColumn(t, F.xxhash64(column(text)))
    joined = base.join(drops, column(doc_id).eqNullSafe(drops[d]) & (base[t] == drops[t]), "left").drop(d, t)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    count = F.size(column(parts))
    # positions are unique, so what is left of them is in order and each is looked up in one step
    rest = F.array_except(F.sequence(F.lit(0), count - 1), F.coalesce(column(drop), F.array().cast("array<int>")))
    out = joined.withColumn(parts, split_lines(column(text))).withColumn(kept, rest)
    return out.select(
        *[
            F.array_join(F.transform(column(kept), lambda i: F.get(column(parts), i)), "\n").alias(c)
            if c == text else column(c)
            for c in names
        ],
        count.cast("long").alias("n_lines"),
        (count - F.size(column(kept))).cast("long").alias("n_dropped"),
    )
