"""Secret scan: long tokens of texts, and a random forest that removes false positives.

A candidate is a run of at least ``LENGTH`` characters of ``[A-Za-z0-9+/_-]``
inside a word. Its features:

* length, and shares of digits, capitals and distinct characters;
* character transitions: changes between letters and digits, between cases and
  between vowels and consonants, per character;
* dictionary coverage: the share of its letter triples that occur in words used
  at least ``known`` times in all texts;
* path: slashes, dots, an ``@`` or a scheme in its word;
* neighbouring words: a credential's name in the word or the three before it or
  the two after it, an assignment just before it, quotes around it.

The forest trains on labelled findings: rows of ``candidates`` with a 0/1
column ``label``. ``assignment_labels`` makes such labels where none are given:
1 for what is assigned to a credential's name and mixes digits and letters, 0
for the rest. At most ``limit`` findings of each label are used, chosen by the
hash of their id; the dictionary and the scan cover all texts.

Defined results: null or empty texts have no candidates; each occurrence is a
row, repeated rows too; without findings of both labels the score is the share
of positives; an empty table gives no rows; other columns are ignored. All steps
are DataFrame, SQL and Spark ML functions.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import WORD, query, stage, table

LENGTH = 16
# Names that credentials are assigned to.
NAMES = "token|secret|passw|pwd|api.?key|access.?key|auth|credential|private.?key"
FEATURES = (
    "length", "digits", "capitals", "distinct", "kind_changes", "case_changes", "sound_changes", "coverage",
    "slashes", "dots", "at_signs", "scheme", "named", "named_after", "assigned", "quoted", "hex_only",
)


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def letter_triples(documents: DataFrame, known: int = 20) -> list[int]:
    """Letter triples of words used at least ``known`` times, as 26³ bits in 64-bit numbers.

    The result has a fixed size, so it can go to all executors as a constant.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![^\x20\x09-\x0D])[a-z]{3,12}(?![a-z])"), F.lit(0))
    counted = documents.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    places = F.sequence(F.lit(1), F.length("w") - 2)
    triples = counted.filter(F.col("k") >= known).select(
        F.explode(F.transform(places, lambda i: F.substring("w", i, F.lit(3)))).alias("t")
    ).distinct()
    code = F.lit(0)
    for i in (1, 2, 3):
        code = code * 26 + F.ascii(F.substring("t", i, 1)) - 97
    bits = triples.select(code.alias("c")).groupBy(F.expr("cast(c div 64 as int)").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("b")
    )
    out = [0] * (26**3 // 64 + 1)
    for row in bits.collect():
        out[row["w"]] = row["b"]
    return out


def candidates(documents: DataFrame, triples: list[int]) -> DataFrame:
    """(doc_id, word_no, candidate, in_word, before, after and the features) of each candidate."""
    pattern = f"[A-Za-z0-9+/_-]{{{LENGTH},}}"

    def hits(words: Column) -> Column:
        long = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1),
            lambda i: (F.length(F.get(words, i)) >= LENGTH) & F.get(words, i).rlike(pattern),
        )
        found = F.transform(
            F.when(F.size(words) > 0, long),
            lambda i: F.struct(
                i.cast("long").alias("word_no"),
                F.get(words, i).alias("in_word"),
                F.array_join(F.slice(words, F.greatest(i - 2, F.lit(1)), i - F.greatest(i - 3, F.lit(0))), " ").alias("before"),
                F.concat_ws(" ", F.get(words, i + 1), F.get(words, i + 2)).alias("after"),
            ),
        )
        return F.coalesce(found, F.array())

    rows = documents.select(F.col("doc_id").cast("long"), F.explode(F.transform(F.array(_words("text")), hits)).alias("h"))
    rows = rows.select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.*")
    rows = rows.withColumn("candidate", F.explode(F.regexp_extract_all("in_word", F.lit(pattern), F.lit(0))))

    n, c = F.length("candidate").cast("double"), F.col("candidate")
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("double")
    bits = F.array(*[F.lit(b) for b in triples])
    low = F.lower(c)

    def inside(i: Column) -> Column:
        code = F.lit(0)
        for k in range(3):
            code = code * 26 + F.ascii(F.substring(low, i + k, F.lit(1))) - 97
        word = F.get(bits, F.floor(code / 64).cast("int"))
        bit = F.call_function("shiftright", word, (code % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.substring(low, i, F.lit(3)).rlike("^[a-z]{3}$") & bit

    covered = F.size(F.filter(F.sequence(F.lit(1), F.length(c) - 2), inside)) / (n - 2)
    ahead = F.concat_ws(" ", "before", F.expr("substring_index(in_word, candidate, 1)"))
    near = F.lower(ahead)
    whole = F.col("in_word")
    flag = lambda x: x.cast("int").cast("double")
    values = {
        "length": n,
        "digits": count("[0-9]") / n,
        "capitals": count("[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "kind_changes": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n,
        "case_changes": count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "sound_changes": count("(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])") / n,
        "coverage": covered,
        "slashes": F.regexp_count(whole, F.lit("/")).cast("double"),
        "dots": F.regexp_count(whole, F.lit(r"\.(?=\w)")).cast("double"),
        "at_signs": F.regexp_count(whole, F.lit("@")).cast("double"),
        "scheme": flag(F.contains(whole, F.lit("://"))),
        "named": flag(near.rlike(NAMES)),
        "named_after": flag(F.lower("after").rlike(NAMES)),
        "assigned": flag(ahead.rlike("""[=:]\\s*["']?$""")),
        "quoted": flag(whole.rlike("""["'`]""")),
        "hex_only": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
    }
    return rows.withColumns(values)


def assignment_labels(found: DataFrame) -> DataFrame:
    """Findings with a ``label``: assigned to a credential's name, digits and letters mixed."""
    yes = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0) & (F.col("digits") < 1)
    return found.withColumn("label", yes.cast("int").cast("double"))


def train(labelled: DataFrame, limit: int = 5000, trees: int = 30, depth: int = 6) -> PipelineModel | None:
    """The forest, or None without findings of both labels."""
    rows = labelled.select("doc_id", "word_no", "candidate", "label", *FEATURES)
    some = [
        rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id", "word_no", "candidate"), "doc_id", "word_no").limit(limit)
        for k in (0, 1)
    ]
    sample = stage(some[0].unionByName(some[1]).coalesce(1).sortWithinPartitions("doc_id", "word_no", "candidate"), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt"
    )
    return PipelineModel([gather, forest.fit(gather.transform(sample))])


def scored(found: DataFrame, forest: PipelineModel | None, share: float = 0.0) -> DataFrame:
    """Findings with ``score``, the forest's probability of a secret."""
    if forest is None:
        return found.withColumn("score", F.lit(share))
    done = forest.transform(found).withColumn("score", vector_to_array("probability")[1])
    return done.drop("features", "rawPrediction", "probability", "prediction")


def scan(documents: DataFrame, threshold: float = 0.5, limit: int = 5000) -> DataFrame:
    """(doc_id, word_no, candidate, features, score, kept) of all candidates."""
    found = stage(candidates(documents, letter_triples(documents)), "secret-candidates")
    labelled = assignment_labels(found)
    forest = train(labelled, limit)
    share = 0.0
    if forest is None:
        share = float(labelled.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0])
    return scored(found, forest, share).withColumn("kept", F.col("score") >= threshold)


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    """Candidates of all documents with the forest's verdict; the text is named by its hash only."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "word_no", F.sha2("candidate", 256).alias("candidate_sha256"), F.col("length").cast("long").alias("length"),
        F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"), "kept",
    )
