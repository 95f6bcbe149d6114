"""op6: exact duplicates."""

from lotflow.llm.exact_dedup import exact_duplicates
from lotflow.llm.registry import query


@query("op6_streaming_exact_dedup", """select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
    doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window w as (partition by coalesce(text, ''))""")
def _(spark, sf_dir):
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")
