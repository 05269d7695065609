"""From raw documents to token statistics of a clean corpus.

Language identification, SimHash near-deduplication, benchmark decontamination, pseudonyms
and SentencePiece encoding, each a stage (spark, docs, sf_dir) -> DataFrame. Every stage but
the last returns the columns of its input; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontamination, language_id, pseudonyms, sentence_pieces, simhash
from rankloom.llm.common import drop_kept, fresh_name, keep, quoted, scratch
from rankloom.llm.queries import PSEUDONYM_KEY, digest, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too) go, and texts that resemble no
    language of the labelled ones. With no labelled text at all nothing can be told apart
    and all texts go."""
    texts = language_id.training_texts(docs, where=language_id.in_training("doc_id"))
    guess = fresh_name(docs, "guess")
    judged = docs.withColumn(guess, language_id.language("text", texts))
    sure = (F.col(f"{guess}.lang") != language_id.UNDETERMINED) & (F.col(f"{guess}.rate") <= language_id.MOST_PHRASES)
    return judged.where(sure).drop(guess)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of smallest id stays, a row without an id only where no other
    has one; of rows that share that id, the one of the smallest text, and of those that share
    the text too, the one whose columns come first as JSON. Null, empty and very long texts
    take part like others."""
    own, whole, first, rows, row = (fresh_name(docs, n) for n in ("fp", "component", "first", "rows", "row"))
    judged = keep(docs.withColumn(own, simhash.fingerprint("text")), "judged")
    prints = judged.select("doc_id", F.col(own).alias("fp"))
    found = keep(simhash.groups(prints), "groups")
    # Counted on narrow rows: texts need comparing only where an id is repeated in a group.
    chosen = prints.join(found, "fp").where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("component").agg(F.count("*").alias("rows"))
    facts = found.join(chosen, "component").select(
        F.col("fp").alias(own), F.col("component").alias(whole), F.col("first").alias(first), F.col("rows").alias(rows)
    )
    # The id is a key of the join, so that copies of one text do not meet in one task.
    same = (judged[own] == facts[own]) & judged["doc_id"].eqNullSafe(facts[first])
    named = judged.join(facts, same).drop(facts[own])
    columns = [quoted(c) for c in docs.columns]
    several = named.where(F.col(rows) > 1).groupBy(whole)
    record = F.struct(*columns)
    kept = several.agg(F.min_by(record, F.struct("text", F.to_json(record))).alias(row)).select(f"{row}.*")
    return named.where(F.col(rows) == 1).select(*columns).unionAll(kept)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more stands in benchmark windows go. Texts
    without words, null and empty ones too, stay; repeated rows are judged alike, and long
    texts whole."""
    hits = fresh_name(docs, "hits")
    judged = decontamination.with_hits(docs, table(spark, sf_dir, "benchmark"), hits)
    return judged.where(~decontamination.contaminated(hits)).drop(hits)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the texts; n_chars follows where there is such a column. Null
    and empty texts stay as they are; repeated rows change alike, and long texts whole."""
    done = docs.withColumn("text", pseudonyms.pseudonymised("text", PSEUDONYM_KEY)["text"])
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and disagreements with the library, of every
    row; null and empty texts give the end identifier alone, long ones are encoded whole."""
    coded = sentence_pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        digest(F.col("ids"), " ").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "disagreements",
    )


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pseudonyms", pseudonymise),
    ("sentence_pieces", encode_pieces),
]

#: Suffix automata, tries, keyed networks and piece agendas have no counterpart in SQL; the
#: tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage keeps goes when the stage is written, and a
    stage's rows go when the next one's are."""
    docs, earlier = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():
            docs = keep(stage(spark, docs, sf_dir), name, lasting=True)
        if earlier is not None:
            drop_kept(earlier)
        earlier = docs
    return docs
