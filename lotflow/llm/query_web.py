"""op9 and op10: boilerplate lines, URL filters."""

from pyspark.sql import functions as F

from lotflow.llm.lines import without_boilerplate
from lotflow.llm.registry import LOWER, UPPER, query, table
from lotflow.llm.urls import judge

#: As the operator and the pipeline's stage have them.
RATIO, LEAST = 0.05, 4


def line_sql(docs: str = "documents") -> str:
    """CTEs ending in ``cleaned(doc_id, text, n_lines, n_dropped)``."""
    return f"""lines as (select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) as place,
        unnest(string_split(text, chr(10))) as line from {docs}),
    totals as (select source, count(*) as total from {docs} group by source),
    frequent as (select l.source, line from lines l join totals t on l.source is not distinct from t.source
        where trim(line) <> '' group by l.source, line
        having count(distinct doc_id) > any_value(total) * {RATIO} and count(distinct doc_id) >= {LEAST}),
    marked as (select l.*, f.line is not null as cut from lines l
        left join frequent f on l.source is not distinct from f.source and l.line = f.line),
    cleaned as (select doc_id, coalesce(string_agg(line, chr(10) order by place) filter (not cut), '') as text, count(*) as n_lines,
        count(*) filter (cut) as n_dropped from marked group by doc_id)"""


@query("op9_site_line_dedup", f"""with {line_sql()} select doc_id, n_lines, n_dropped, sha256(text) as text_sha256 from cleaned
    union all select doc_id, 0, 0, null from documents where text is null""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(docs, "source", RATIO, LEAST).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' or host like '%.{host}') and starts_with(path, '{path}')"


# From the longest rule to the shortest.
_CASES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_RULE = " ".join(f"when {_fits(h, p)} then '{h}{p}'" for h, p, _ in _CASES)
_VERDICT = " ".join(f"when {_fits(h, p)} then '{v}'" for h, p, v in _CASES)


@query("op10_url_range_filter", f"""with parts as (select page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') as host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages)
    select page_id, host, path, case {_RULE} end as rule, case {_VERDICT} else 'allow' end as verdict from parts""")
def _(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)
