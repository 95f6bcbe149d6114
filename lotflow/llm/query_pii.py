"""op8: personal data."""

from pyspark.sql import functions as F

from lotflow.llm.pii import KINDS, find_pii
from lotflow.llm.registry import query, table


def listed(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op8_skip_chain_pii")
def _(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(counted, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
