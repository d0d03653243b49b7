"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is an unbroken run of 16 or more characters of the alphabets in which keys are written. The forest judges it by its length, the
changes between character classes and the share of letter pairs that are frequent in words, how much of it a word list covers,
signs of a path, and the words beside it. It is trained by Spark ML on labelled findings; everything runs as functions of the
DataFrame API and in Spark ML, nothing in Python.

The labelled findings that come with the operator are made by rule from hashes: keys of common kinds on one side, and on the other
commit ids, checksums, UUIDs, numbers, paths, identifiers, placeholders and long words, with the words that stand beside them. ``train``
takes any table of that form.

Defined cases
- A null or empty text has no candidates. Candidates of any length are taken whole.
- Rows with the same ``doc_id`` and text have their findings once; rows with a null ``doc_id`` are told apart by their text.
- ``redact`` keeps all rows and columns; texts without secrets stay as they are.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import column, fresh
from barwright.session import materialize

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
BEFORE, AFTER = 48, 16
MASK = "[SECRET]"
SECRET_WORDS = "token|secret|passw|api.?key|access.?key|auth|bearer|credential|private"
PLAIN_WORDS = "commit|sha|md5|checksum|digest|hash|uuid|guid|revision|etag|example|sample|dummy|placeholder|build|blob|parent"
WORDS = tuple(
    "the and that with from have this will your which their about would there could other after first people time into year some them than then look only come over think also back work well even want give most user test example sample name file path data line code type list page home main index image config value class function public static string http https www com org html json node modules lib usr share local src build dist version release license general your here key api secret token password change placeholder"
    .split()
)
PAIRS = tuple(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ie ei ge un sc qu ue la el os ad au ai eu"
    .split()
)
FEATURES = (
    "length", "changes", "digits", "capitals", "distinct", "hex", "one_class", "pairs", "words", "slashes", "marks", "path_before",
    "file_after", "secret_before", "assigned", "plain_before", "known_start",
)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``d, t, pos, start, found, before, after``: candidates in their order, with what stands beside them."""
    rows = docs.select(column(doc_id).alias("d"), F.xxhash64(column(text)).alias("t"), column(text).alias("text")).filter(
        F.col("text").rlike(CANDIDATE)
    )
    cut = rows.select(
        "d", "t", F.split("text", CANDIDATE, -1).alias("parts"), F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("finds")
    )
    each = F.transform(
        "finds",
        lambda x, i: F.struct(
            x.alias("found"), F.length(F.get("parts", i)).alias("gap"), F.right(F.get("parts", i), F.lit(BEFORE)).alias("before"),
            F.left(F.get("parts", i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    one = cut.select("d", "t", F.posexplode(each).alias("pos", "x")).select("d", "t", "pos", "x.*").dropDuplicates(["d", "t", "pos"])
    start = F.expr("sum(gap + length(found)) over (partition by d, t order by pos)") - F.length("found")
    return one.withColumn("start", start).drop("gap")


def measured(found: DataFrame) -> DataFrame:
    """Adds the features of ``found, before, after``."""
    c, size = F.col("found"), F.length("found").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^a-zA-Z0-9]", ".")
    without = lambda pattern: (size - F.length(F.regexp_replace(F.lower(c), pattern, ""))) / size
    share = lambda pattern: (size - F.length(F.regexp_replace(c, pattern, ""))) / size
    has = lambda col, pattern: F.lower(F.col(col)).rlike(pattern).cast("double")
    return found.withColumns({
        "length": F.log2(size),
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / size,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64.0)),
        "hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "one_class": c.rlike("^(?:[a-z]+|[A-Z]+|[0-9]+|[A-Z]?[a-z]+)$").cast("double"),
        "pairs": without("|".join(PAIRS)),
        "words": without("|".join(sorted(WORDS, key=len, reverse=True))),
        "slashes": share("/"),
        "marks": share("[-_=+]"),
        "path_before": has("before", r"(?:[/\\.:@~]|https?|www)[^ ]{0,20}$"),
        "file_after": has("after", r"^(?:\.[a-z]{1,5}\b|[/\\@?&])"),
        "secret_before": has("before", rf"(?:{SECRET_WORDS})[^ ]{{0,12}}[\s:=\"'(]{{0,6}}$"),
        "assigned": has("before", r"[=:]\s{0,3}[\"'`]?$"),
        "plain_before": has("before", rf"(?:{PLAIN_WORDS})[^ ]{{0,12}}[\s:=\"'(#]{{0,6}}$"),
        "known_start": c.rlike("^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|sk_live_|xox[baprs]-|AIza|eyJ|glpat-|hf_)").cast("double"),
    })


def made_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings by rule: ``found, before, after, label``."""
    pick = lambda salt, options: F.element_at(
        F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int")
    )
    text = F.concat("id", F.lit("finding"))
    hexes, letters = F.sha2(text, 512), F.translate(F.sha2(text, 512), "0123456789abcdef", "aeinrstohldumcpg")
    b64 = F.regexp_replace(F.base64(F.unhex(hexes)), r"\s", "")
    b62 = F.regexp_replace(b64, "[+/=]", "7")
    size = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    part = lambda col, n: F.substring(col, 1, n) if isinstance(n, int) else F.left(col, n)
    words = [pick(f"w{i}", WORDS) for i in range(5)]
    keyed = pick("k", ('token = "', "secret_key: ", "api_key=", 'password = "', "Authorization: Bearer ", "access_key = '", 'auth_token: "'))
    prose = pick("p", ("and then the ", "of which ", "see also ", "with ", ". ", "\n", "for the ", "is "))
    plain = pick("h", ("commit ", "sha1: ", "md5 = ", "checksum: ", "parent ", "etag: \"", "sha256 ", "revision ", "build id: "))
    uuid = F.concat_ws("-", *(F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kinds = (
        (1, part(hexes, 40), keyed), (1, part(hexes, size("a", 24, 64)), keyed), (1, part(b64, size("b", 24, 64)), keyed),
        (1, part(b62, size("c", 20, 48)), F.when(size("x", 0, 1) == 0, keyed).otherwise(prose)),
        (1, F.concat(pick("s", ("AKIA", "ASIA")), F.upper(F.substring(b62, 1, 16))), F.when(size("x", 0, 1) == 0, keyed).otherwise(prose)),
        (1, F.concat(pick("s", ("ghp_", "sk-", "xoxb-", "hf_", "glpat-", "sk_live_")), part(b62, size("d", 20, 40))), F.when(size("x", 0, 1) == 0, keyed).otherwise(prose)),
        (0, part(hexes, pick("n", (32, 40, 64))), plain), (0, part(hexes, 40), plain), (0, uuid, pick("u", ("id: ", "uuid=", "/", "see "))),
        (0, F.concat(*words), prose), (0, F.concat_ws("_", *words[:4]), prose), (0, F.concat_ws("-", *words), pick("v", ("https://www.", "/", "see "))),
        (0, F.concat_ws("/", *words[:4], F.substring(hexes, 1, 4)), pick("q", ("/usr/", "https://", "./", "in "))),
        (0, part(F.translate(hexes, "abcdef", "012345"), size("e", 16, 24)), prose), (0, F.repeat(pick("r", ("x", "0", "-", "_", "ab")), size("f", 16, 40)), F.when(size("x", 0, 1) == 0, keyed).otherwise(prose)),
        (0, F.upper(F.concat_ws("_", F.lit("your"), *words[:2], F.lit("here"))), keyed), (0, part(letters, size("g", 16, 28)), prose),
        (0, F.initcap(part(letters, size("g", 16, 24))), prose),
    )
    kind = F.pmod(F.xxhash64("id"), F.lit(len(kinds)))
    choose = lambda column_of: F.coalesce(*(F.when(kind == i, column_of(k)) for i, k in enumerate(kinds)))
    return spark.range(rows).select(
        choose(lambda k: k[1]).alias("found"), choose(lambda k: k[2]).alias("before"),
        pick("z", ('"', "'", "", " and", "\n", ". ", ",")).alias("after"), choose(lambda k: F.lit(k[0])).cast("double").alias("label"),
    ).filter(F.length("found") >= 16)


def train(findings: DataFrame, trees: int = 24, depth: int = 8) -> RandomForestClassificationModel:
    """A forest on labelled findings ``found, before, after, label``."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(measured(findings))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt", labelCol="label")
    return forest.fit(rows.select("features", "label"))


def judged(found: DataFrame, model: RandomForestClassificationModel, least: float = 0.5) -> DataFrame:
    """Candidates with ``score`` and ``is_secret``."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(measured(found))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*found.columns, "score", (F.col("score") >= least).alias("is_secret"))


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, finding, start, found, before, after, score, is_secret`` of every candidate; start in characters from 0."""
    return judged(candidates(docs, doc_id, text), model).select(
        F.col("d").alias("doc_id"), F.col("pos").alias("finding"), F.col("start").cast("long").alias("start"), "found", "before", "after", "score", "is_secret"
    )


def redact(docs: DataFrame, model: RandomForestClassificationModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a mask in the place of every secret; all rows and columns stay."""
    d, t, flags = fresh(docs.columns, "d", "t", "flags")
    found = judged(candidates(docs, doc_id, text), model)
    marked = materialize(
        found.groupBy("d", "t").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "is_secret"))), lambda x: x["is_secret"]).alias(flags), F.max("is_secret").alias("any")
        ).filter("any").select(F.col("d").alias(d), F.col("t").alias(t), flags),
        "secrets",
    )
    base = docs.withColumn(t, F.xxhash64(column(text)))
    joined = base.join(marked, column(doc_id).eqNullSafe(marked[d]) & (base[t] == marked[t]), "left").drop(d, t)
    parts, finds = F.split(column(text), CANDIDATE, -1), F.regexp_extract_all(column(text), F.lit(CANDIDATE), 0)
    pieces = F.zip_with(finds, column(flags), lambda x, secret: F.when(secret, F.lit(MASK)).otherwise(x))
    clean = F.array_join(F.zip_with(parts, pieces, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return joined.select(*[F.when(column(flags).isNull(), column(c)).otherwise(clean).alias(c) if c == text else column(c) for c in docs.columns])
