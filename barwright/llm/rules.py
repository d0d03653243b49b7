"""Quality rules: an ordered list of threshold conjunctions learned from labelled documents. Only functions of the DataFrame API.

Every text is reduced to a few counts. The list is learned by sequential covering: a rule for bad documents is grown by one
condition at a time (``measure <= t`` or ``measure >= t``, the one with the largest information gain) on two thirds of the labelled
documents until it covers no good one, pruned back on the other third to the conditions that hold there, and taken if it is precise
enough; the documents it covers leave, and the next rule is grown on the rest. The list ends when no rule is precise enough any
more. It is emitted as one ``CASE WHEN`` expression: the first rule that applies gives the verdict, and a document that none
applies to is kept.

Measures are whole numbers on a fixed grid, so the histogram of bad and good documents by measure and value that every step of the
search asks for has ``GRID`` + 1 rows a measure at most, however many documents are labelled; Spark makes it from all of them, and the
search on it is exact. Rules are learned on documents that pass the fixed base test, which comes first.

Defined cases
- A null or empty text has no words: all counts are 0 and the base test fails.
- Repeated windows are found by 64-bit hashes: two of a text's windows that differ are taken for equal with a chance of 5e-20 a pair.
- Labels with a null field or id are left out; of several for one id the lowest quality holds. Without labels, or with one
  quality only, the list has no rule. Labels hold for all rows of their id.
- Rows keep their ``doc_id``, null or repeated; other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import WHITE, bind, column
from barwright.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS, MOST_REPEATED = 50, 50
GRID = 1000
MOST_RULES, MOST_CONDITIONS = 12, 4
LEAST_COVERED, LEAST_PRECISION = 5, 0.9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHER_COUNTS = ("n_lines", "n_distinct", "n_upper", "n_stops")


def only(text: Column, characters: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def repeated_words(words: Column) -> Column:
    """Number of words that stand in windows found twice or more."""
    hashed = F.transform(words, lambda word, i: F.xxhash64(word, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    windows = F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))

    def covered(ordered: Column) -> Column:
        def place(entry: Column, i: Column) -> Column:
            beside = [F.get(ordered, i + d)["hash"].eqNullSafe(entry["hash"]) for d in (-1, 1)]
            return F.when(beside[0] | beside[1], entry["at"])

        places = F.filter(F.transform(ordered, place), lambda at: at.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda at: F.array(*[at + k for k in range(WINDOW)])))))

    def found(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        # most texts repeat nothing, and a set tells that without a sort
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bind(ordered, covered))

    return bind(windows, found)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the counts of every text."""
    base = docs.select(column(doc_id).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    # a cut at a single character needs no regular expression
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), WHITE[1:], F.col("text"))
    cut = base.withColumns({
        "words": F.array_remove(F.split(spaced, " ", -1), ""),
        "lines": F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != ""),
    })
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": only(F.col("text"), SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_upper": only(F.col("text"), r"\p{Lu}"),
        "n_stops": only(F.col("text"), ".,;:!?"),
    }
    return cut.select("doc_id", *[counts[name].cast("long").alias(name) for name in (*COUNTS, *OTHER_COUNTS)])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measures() -> dict[str, Column]:
    """What rules speak of, as whole numbers from 0 to ``GRID``; shares are in thousandths."""
    def share(part: str, whole: str, scale: int = 1000) -> Column:
        return F.floor(F.coalesce(F.try_divide(F.col(part) * scale, F.col(whole)), F.lit(0.0)))

    values = {
        "size": F.floor(F.log2(F.col("n_words") + 1.0) * 8),
        "word_length": share("word_chars", "n_words", 10),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeated": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "stops": share("n_stops", "word_chars"),
        "line_length": share("n_words", "n_lines", 1),
    }
    return {name: F.least(value, F.lit(GRID)).cast("int") for name, value in values.items()}


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    bound: int

    def holds(self) -> Column:
        return F.col(self.measure) >= self.bound if self.at_least else F.col(self.measure) <= self.bound

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<='} {self.bound}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self) -> Column:
        return reduce(and_, [c.holds() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """Number of the first rule that applies, from 1; null if none does. One conditional expression over ``measures``."""
        out = None
        for number, rule in enumerate(self.rules, 1):
            out = F.when(rule.holds(), number) if out is None else out.when(rule.holds(), number)
        return F.lit(None).cast("int") if out is None else out


def labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures of the labelled documents that pass the base test, with ``bad`` and the part they are used in."""
    quality = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality")
    )
    rows = counts.filter(~base_failed()).join(quality, "doc_id")
    return rows.select(
        *[value.alias(name) for name, value in measures().items()],
        (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("growing"),
    )


def histograms(rows: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
    """Per measure: value, bad and good rows with it. At most ``GRID`` + 1 entries each."""
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in measures()]))
    counted = rows.select("bad", entries.alias("e")).groupBy("e.measure", "e.value").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    out: dict[str, list[tuple[int, int, int]]] = {name: [] for name in measures()}
    for r in counted.collect():
        out[r["measure"]].append((r["value"], r["bad"], r["good"]))
    return {name: sorted(values) for name, values in out.items()}


def best_condition(table: dict[str, list[tuple[int, int, int]]], least: int) -> tuple[float, Condition, int] | None:
    """The condition with the largest gain, its gain, and how many good rows it leaves. Ties go to the first."""
    best = None
    for name, values in table.items():
        all_bad, all_good = sum(v[1] for v in values), sum(v[2] for v in values)
        if not all_bad:
            continue
        before = math.log2(all_bad / (all_bad + all_good))
        for at_least in (True, False):
            bad = good = 0
            for value, b, g in reversed(values) if at_least else values:
                bad, good = bad + b, good + g
                if bad >= least:
                    gain = bad * (math.log2(bad / (bad + good)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, Condition(name, at_least, value), good
    return best


def grow(rows: DataFrame, least: int, most_conditions: int) -> list[Condition]:
    conditions: list[Condition] = []
    while len(conditions) < most_conditions:
        found = best_condition(histograms(rows), least)
        if found is None:
            break
        conditions.append(found[1])
        if not found[2]:
            break
        rows = rows.filter(found[1].holds())
    return conditions


def prune(rows: DataFrame, conditions: list[Condition]) -> tuple[Rule, int, int]:
    """The shortest beginning of the conditions that separates best on ``rows``, with the bad and good ones it covers."""
    cuts = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
    counts = rows.agg(*[
        F.count_if(rule.holds() & (F.col("bad") if bad else ~F.col("bad"))).alias(f"{'bad' if bad else 'good'}{k}")
        for k, rule in enumerate(cuts) for bad in (True, False)
    ]).first()
    covered = [(counts[f"bad{k}"], counts[f"good{k}"]) for k in range(len(cuts))]
    worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in covered]
    best = max(range(len(cuts)), key=lambda k: (worth[k], -k))
    return cuts[best], *covered[best]


def learn(
    rows: DataFrame, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS, least_covered: int = LEAST_COVERED,
    least_precision: float = LEAST_PRECISION,
) -> DecisionList:
    """The list for ``rows`` (written, as from ``labelled``)."""
    out = DecisionList()
    while len(out.rules) < most_rules:
        conditions = grow(rows.filter("growing"), least_covered, most_conditions)
        if not conditions:
            break
        rule, bad, good = prune(rows.filter("not growing"), conditions)
        if bad < least_covered or bad < least_precision * (bad + good):
            break
        out.rules.append(rule)
        rows = rows.filter(~rule.holds())
    return out


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``kept`` and the number of the ``rule`` that rejects, for every row of ``docs``."""
    counts = materialize(measure(docs, doc_id, text), "counts")
    rules = learn(materialize(labelled(counts, labels), "labelled"), **settings)
    judged = counts.withColumns(measures()).withColumns({"base_failed": base_failed(), "rule": rules.verdict()})
    return judged.select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
        F.when(~F.col("base_failed"), F.col("rule")).alias("rule"),
    )
