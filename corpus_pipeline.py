"""A training corpus in five stages; each writes Parquet that the next one reads.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of the documents they got, whatever they are named, and give an
empty table for an empty one.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from mvspark.llm import decontaminate, mixing, simhash, token_store, toxicity
from mvspark.llm.common import importable, shared_dir, stored, table

#: Most passes over a source in the mix, whose budget is the number of tokens that come in.
REPEATS = 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score toxicity.THRESHOLD or more; the model learns from the labelled ones among docs.

    Null, blank and wordless texts score the bias alone; repeated rows and null ids stay or go with their
    text; without labelled rows nothing goes.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are 0.8 alike in five-word shingles, the one with the smallest id.

    Candidates meet at anchors of their SimHashes; their shingles decide. Null and blank texts are one
    group; of rows that repeat an id and its text one stays; null ids are the largest.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and wordless texts, repeated rows and null ids without a hit stay; without items nothing goes.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flattens the sources' shares until none is passed more than REPEATS times; a document comes once per copy.

    A null source is a source of its own; texts without tokens are free; rows that repeat an id go together.
    """
    return mixing.sample(docs, repeats=REPEATS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' token ids as wavelet matrices and reads them back: doc_id, start, n_tokens, ids_crc32.

    Null texts have the end id alone; null ids come first; repeated rows are written as often as they come.
    """
    path = f"{shared_dir(spark)}/tokens-{uuid4().hex}"
    token_store.write_shards(docs, path)
    return token_store.read_documents(spark, path).drop("shard")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can't express a trained model; the near-duplicate stage is tested against all pairs, the others against their operators, which are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents; what a stage kept is written in the shared folder and read by the next one."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
