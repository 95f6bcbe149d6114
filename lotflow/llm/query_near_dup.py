"""op1 and op2: near-duplicate documents and embeddings."""

from lotflow.llm.cover_tree import near_duplicate_vectors
from lotflow.llm.minhash import near_duplicates
from lotflow.llm.registry import LOWER, UPPER, WORDS_SQL, components_sql, query, table


def near_dup_sql(width: int, percent: int, docs: str = "documents") -> str:
    """CTEs ending in ``named(node, component)`` and ``sizes(doc_id, n_shingles)``; start with ``with recursive``."""
    words = WORDS_SQL.format(f"translate(text, '{UPPER}', '{LOWER}')")
    joined = " || ' ' || ".join(f"ws[i + {k}]" for k in range(width))
    return f"""words as (select doc_id, {words} as ws from {docs}),
    shingles as (select doc_id, unnest(case when len(ws) >= {width}
        then list_distinct(list_transform(range(1, len(ws) - {width - 2}), lambda i: {joined}))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from words),
    sizes as (select d.doc_id, count(s.shingle) as n_shingles from {docs} d left join shingles s using (doc_id) group by 1),
    common as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b using (shingle)
        where a.doc_id < b.doc_id group by all),
    links as (select x, y from common join sizes p on x = p.doc_id join sizes q on y = q.doc_id
        where 100 * n >= {percent} * (p.n_shingles + q.n_shingles - n)),
    nodes as (select doc_id as node from {docs}),
    {components_sql("links", "nodes")}"""


@query("op1_minhash_near_dedup", f"""with recursive {near_dup_sql(3, 85)}
    select doc_id, n_shingles, component as component_id, doc_id = component as kept from sizes join named on doc_id = node""")
def _(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, rows=3, collections=10)


@query("op2_cover_tree_near_dedup", f"""with recursive units as (select vec_id, cast(embedding as double[]) as v from embeddings),
    links as (select a.vec_id as x, b.vec_id as y from units a join units b on a.vec_id < b.vec_id
        where list_cosine_similarity(a.v, b.v) >= 0.95),
    nodes as (select vec_id as node from embeddings),
    {components_sql("links", "nodes")},
    degrees as (select x, count(*) as n from both_ways group by x)
    select vec_id, coalesce(n, 0) as n_links, component as component_id, vec_id = component as kept
    from embeddings join named on vec_id = node left join degrees on vec_id = x""")
def _(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
