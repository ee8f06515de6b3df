"""Held-out accuracy of the three classifiers: ``python -m voltweave.llm.measure DIR [SEEN_DIR]``.

Texts that ``SEEN_DIR`` also has are left out of the figures.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries
from .common import table


def rates(scored: DataFrame, truth: DataFrame) -> list[tuple]:
    """(truth, rows, share predicted 1) of the held-out rows."""
    own = scored.where("held_out").join(truth, "doc_id")
    return [tuple(r) for r in own.groupBy("truth").agg(F.count("*"), F.avg("predicted")).orderBy("truth").collect()]


def main(folder: str, seen: str | None = None) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    if seen:
        docs = docs.join(table(spark, seen, "documents").select("text").distinct(), "text", "left_anti")
    ids = docs.select("doc_id")
    for name, label in (("op1_quality", "quality"), ("op9_toxicity", "toxic")):
        print(name, rates(queries.QUERIES[name](spark, folder), labels.join(ids, "doc_id", "left_semi").select("doc_id", F.col(label).alias("truth"))))
    lang = queries.op3_language(spark, folder).withColumnRenamed("lang_pred", "p").where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    print("op3_language", tuple(lang.agg(F.count("*"), F.avg((F.col("p") == F.col("lang")).cast("int"))).first()))


if __name__ == "__main__":
    main(*sys.argv[1:])
