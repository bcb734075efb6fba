"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

Every stage takes null and empty texts (quality rules reject them), rows that repeat, null ids and empty tables
(an empty result); columns beside those of ``documents``, whatever their names, stay up to the last stage.
Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demeanor.llm import bpe, jaccard, mixing, quality, secrets
from demeanor.llm.common import Scratch, table
from demeanor.llm.queries import BPE_FILE, MIX_SEED, pattern, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8; documents without id stay.

    Rows that repeat an id with unlike texts are documents of their own.
    """
    return jaccard.one_of_each(docs, n=5, num=8, den=10)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the names of their kinds; n_chars follows the text."""
    place = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    found = secrets.find_secrets(docs.toDF(*place.values()), place["text"], tuple(x for c, x in place.items() if c != "text"))
    own = {"text": F.col("redacted")}
    if "n_chars" in place:
        own["n_chars"] = F.when(F.size("spans") > 0, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(place["n_chars"]))
    return found.select(*[own.get(c, F.col(x)).alias(c) for c, x in place.items()])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square roots of their sizes, globally shuffled."""
    return mixing.poisson_mix(docs, temperature=0.5, seed=MIX_SEED, extra=False)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every copy."""
    return bpe.encode_texts(docs, tokenizer(BPE_FILE), pattern(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("byte_bpe", byte_bpe),
]
#: SQL can't express the joins, redaction and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; each result is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
