"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.langid import UNDETERMINED, fit_profiles, held_out, predict_language
from promolens.llm.minhash import minhash_near_duplicates
from promolens.llm.packing import harmonic_pack
from promolens.llm.pii import find_pii, masked
from promolens.llm.queries import table, tokenizer_file
from promolens.llm.repeats import remove_repeats
from promolens.llm.shared import drop_stored, stored


def _aside(docs: DataFrame, *results: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that are called like an operator's results renamed, and all columns by their own names again."""
    taken, back = {c.lower() for c in docs.columns}, []
    for c in docs.columns:
        other = c
        while other.lower() in results or other != c and other.lower() in taken:
            other += "_"
        docs = docs.withColumnRenamed(c, other) if other != c else docs
        back.append(F.col(f"`{other}`").alias(c))
    return docs, back


def _with_text(docs: DataFrame, text: Column, columns: list[Column]) -> DataFrame:
    """``docs`` with another text, its length in ``n_chars``, and the given columns."""
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


#: A text of at least so many characters whose cosine with every language is below this is in none of them: three
#: standard deviations of unrelated vectors (1 / sqrt(1024) each). Shorter texts say too little to be rejected.
LONG_TEXT, MIN_SCORE = 200, 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go (no text, no letter, or long and like none); the others get theirs in ``lang``.

    Without any labelled document nothing is learned: then only documents without
    a letter go and ``lang`` stays. Nulls in other columns stay, repeated rows are
    judged one by one.
    """
    profiles = fit_profiles(docs, ~held_out(docs["doc_id"]))
    if not profiles:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    docs, columns = _aside(docs, "lang_pred", "score")
    found = predict_language(docs, profiles)
    foreign = (F.length("text") >= LONG_TEXT) & (F.col("score") < MIN_SCORE)
    return found.filter((F.col("lang_pred") != UNDETERMINED) & ~foreign).withColumn("lang", F.col("lang_pred")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 0.8 or more) the document with the smallest id stays.

    Rows without a text or an id stay; rows that share an id stay or go together.
    """
    dropped = minhash_near_duplicates(docs, num=80).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents that are left blank go.

    Rows without an id are neither judged nor a source, rows of one id not against each other.
    """
    docs, columns = _aside(docs, "kept", "n_bytes", "n_removed", "spans")
    cut = remove_repeats(docs)
    # a cut may fall into a character: what is left of it goes too, unless the text had such marks before
    valid = F.make_valid_utf8(F.col("kept").cast("string"))
    left = F.when(F.contains(F.col("text"), F.lit("\ufffd")), valid).otherwise(F.replace(valid, F.lit("\ufffd"), F.lit("")))
    text = F.when(F.col("n_removed") > 0, left).otherwise(F.col("text"))
    left_some = (F.col("n_removed") == 0) | (F.trim("__left") != "")
    return _with_text(cut.withColumn("__left", text).filter(left_some), F.col("__left"), columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; a null text stays null. All rows stay."""
    docs, columns = _aside(docs, "pii")
    found = find_pii(docs)
    return _with_text(found, masked(F.col("text"), F.col("pii")), columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024; a null text is the end id alone, repeated rows are packed one by one."""
    return harmonic_pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No SQL form: four of the stages are not expressible in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if k:
                drop_stored(before)
    return docs
