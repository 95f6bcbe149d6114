"""op3: mixing sources to target weights."""

from lotflow.llm.mixing import mix
from lotflow.llm.registry import WORDS_SQL, query, table


def mix_sql(docs: str = "documents") -> str:
    """CTEs ending in ``mixed(doc_id, size, source_size, target, times)``."""
    return f"""sized as (select doc_id, source, len({WORDS_SQL.format("text")}) as size,
        md5('mix' || chr(31) || doc_id) as rank from {docs}),
    sources as (select source, sum(size) as source_size, 2 * sum(size) as cap,
        [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from sized group by source),
    ranked as (select *, row_number() over (order by cap / weight, source nulls last) as r from sources),
    steps as (select *, 3 * sum(source_size) over () - 2 * coalesce(sum(cap) over (order by r rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(weight) over (order by r rows between current row and unbounded following) as of_weight from ranked),
    first_free as (select rest, of_weight from steps where rest * weight < cap * 2 * of_weight order by r limit 1),
    aimed as (select source, source_size, cast(case when rest * weight < cap * 2 * of_weight
        then (select weight * f.rest / (f.of_weight * 2) from first_free f) else cap end as double) as target from steps),
    wholes as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from aimed),
    summed as (select s.doc_id, s.size, w.*, coalesce(sum(size) over (partition by s.source order by rank, doc_id
        rows between unbounded preceding and 1 preceding), 0) as before
        from sized s join wholes w on s.source is not distinct from w.source),
    mixed as (select doc_id, size, source_size, target,
        whole + case when 2 * before + size <= 2 * (target - whole * source_size) then 1 else 0 end as times from summed)"""


@query("op3_water_filling_mix", f"""with {mix_sql()} select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size,
    target, cast(size * times as bigint) as taken from mixed""")
def _(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("times")
