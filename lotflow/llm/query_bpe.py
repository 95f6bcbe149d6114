"""op4: BPE encoding and decoding."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.bpe import encode_decode
from lotflow.llm.registry import query, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_bpe_round_trip")
def _(spark, sf_dir):
    return digests(encode_decode(table(spark, sf_dir, "documents"), vocabulary()))
