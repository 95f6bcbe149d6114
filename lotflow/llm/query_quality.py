"""op5: quality classifier."""

from pyspark.sql import functions as F

from lotflow.llm.quality import fit, held_out, score
from lotflow.llm.registry import query, table


@query("op5_neighbour_quality")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    voter = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), voter)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
