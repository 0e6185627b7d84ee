"""A corpus pipeline in five stages, each of them one corpus operator over what the stage before kept.

1. toxicity: documents that are likelier toxic than not, by their labelled neighbours, go.
2. near duplicates: of every group linked by fingerprints (three-word shingles, at most two bits apart) the row with the smallest id stays.
3. decontamination: documents that hold a benchmark passage go.
4. secrets: every span found is replaced by a mark; all documents stay, `n_chars` is counted anew.
5. packing: the rest is cut and packed into training sequences; one row per piece.

Stages 1 to 4 return the columns of their input. Each takes (spark, docs, sf_dir); `run` writes the result
of each as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltrail.llm import covering_simhash, decontaminate, packing, secret_ledger, toxicity
from voltrail.llm.common import free_name, held_out, ship, table
from voltrail.session import stage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores under 0.5. Labels are learnt from the rows of the first input that op1 may learn from as well.

    Null and empty texts have the score of a text without known words; ids are not read, so null and repeated ones stay or go by their
    texts; an empty table stays empty. Further columns stay, whatever their names.
    """
    every, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model, score = toxicity.fit(every, labels, "toxic", ~held_out("doc_id", 5, 0)), free_name(docs, "toxicity")
    return toxicity.scored(docs, model, to=score).filter(F.col(f"{score}.score") < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, as covering_simhash.representatives chooses it: the one with the smallest id."""
    ship(spark)
    return covering_simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark passage; null and empty texts, null and repeated ids, and other columns as in decontaminate.clean."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; a row without any keeps its text, null or not, and its n_chars as they are. All rows stay, with all columns."""
    findings = free_name(docs, "findings")
    found = secret_ledger.by_path(docs, stage(secret_ledger.scan(docs), "ledger"), to=findings)
    masked = found.withColumn("text", secret_ledger.redact("text", findings))
    counted = F.when(F.size(findings) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", counted).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, as packing.pack returns them."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("secrets", secrets),
          ("packing", packed)]

#: Nearest neighbours, fingerprints and tokens are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
