"""A corpus pipeline over ``documents``: five stages, each one operator of
``cohortile.llm``, each written as Parquet to the shared folder and read again.

Every stage takes (spark, docs, sf_dir), handles all rows its predecessor kept
and returns the columns of documents; the last adds ids, n_ids and lossless.
Nulls, empty and repeated rows follow the rules that the operators state; an
empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortile.llm import decontam, jaccard, langid, pieces, suffix
from cohortile.session import shared_folder


def language(spark, docs, sf_dir):
    """Documents go that have no letter or lie further from every language's centroids than any text it learned from."""
    model = langid.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return langid.accepted(docs, model)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark, docs, sf_dir):
    """Passages of 50 bytes or more that a document with a smaller id has are cut out; n_chars follows the text."""
    kept = suffix.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def decontaminate(spark, docs, sf_dir):
    """Documents go that hold benchmark windows over a twentieth of their words."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs, sf_dir):
    """Ids by seeded merge-dropout, and the text as decoded from them."""
    return pieces.encode_decode(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontaminate", decontaminate), ("encode", encode)]

#: classifiers, shares of a text and ids by keyed hash are not SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
