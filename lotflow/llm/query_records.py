"""op11: token ids in files of length-delimited records."""

from pyspark.sql import functions as F

from lotflow.llm.common import stored
from lotflow.llm.query_bpe import vocabulary
from lotflow.llm.records import read_records, token_positions, write_records
from lotflow.llm.registry import query, table
from lotflow.session import shared_dir


@query("op11_record_files")
def _(spark, sf_dir):
    folder = shared_dir(spark, "token-records")
    index = write_records(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=0)
    read = read_records(index, folder).select(
        "file", "offset", "doc_id", F.expr("octet_length(tokens) div 4").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))
    return token_positions(stored(read, "token-positions")).select("doc_id", "start", "n_tokens", "ids_crc32")
