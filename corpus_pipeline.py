"""A training-corpus pipeline in five stages; each works on all that the one before has kept.

toxicity          documents predicted toxic go
line_dedup        runs of lines that an earlier document has go; a document that loses all its text goes
jaccard_join      of each group of near copies the document of the least id stays
decontamination   documents that contain an item of the benchmark go
bpe               what is left is encoded (and decoded again as a proof): all columns, and the token ids, their number
                  and the digests of the ids and of the decoded text

Defined results: null and empty texts are clean, have no lines, are copies of nothing and have no tokens; rows that
share an id are one document in the second to fourth stage, and a row with a null id is only ever dropped
as toxic; texts of any length are taken whole; of equally old copies the least id stays, and of repeated rows all or
none; an empty table gives an empty one. Columns other than the id, the text and n_chars (the length of
what is left of a text) pass through untouched, but for columns with the names of what the last stage adds, which are
replaced there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, jaccard, line_dedup, toxicity
from tessera.llm.entries import table, vocabulary
from tessera.llm.store import cut, discard, temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.reject_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    # generated rows: a filter isn't pushed into the making of their texts, which it would repeat
    done = done.select(F.explode(F.array(F.struct(*done.columns))).alias("_d")).select("_d.*")
    done = done.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, vocabulary(), with_ids=True, others=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The toxicity model is fitted and the near copies are components: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage returns is written to the shared folder and read again; the tables that it
    has made on the way, and what the stage before has returned, are deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary() as made:
            done = cut(stage(spark, docs, sf_dir), name)
            made.remove(done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
