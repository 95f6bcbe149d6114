"""op13: vector code compression."""

import hashlib

from pyspark.sql import functions as F

from lotflow.llm.common import stored
from lotflow.llm.registry import query, table
from lotflow.llm.vector_codes import compress

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Positions of a part, in the tables' vectors of 64 components.
_X = ["x1", "x2", "x3", "x4"]
_DISTANCE = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in _X)


def _assigned(books: str) -> str:
    """Of each part: the least of distance and entry, as one number."""
    return f"select vec_id, p, min(({_DISTANCE}) * {ENTRIES} + e) as best from points a join {books} b using (p) group by all"


def _means(books: str, assigned: str) -> str:
    means = ", ".join(f"cast(floor(sum(a.{x}) / count(*)) as bigint) as {x}" for x in _X)
    chosen = ", ".join(f"coalesce(m.{x}, b.{x}) as {x}" for x in _X)
    return f"""select b.p, b.e, {chosen} from {books} b left join
        (select p, best % {ENTRIES} as e, {means} from points a join {assigned} using (vec_id, p) group by all) m on b.p = m.p and b.e = m.e"""


def _sql() -> str:
    steps = []
    for k in range(ROUNDS):
        steps += [f"near{k} as ({_assigned(f'books{k}')})", f"books{k + 1} as ({_means(f'books{k}', f'near{k}')})"]
    return f"""with kept as (select vec_id, label, cast(embedding as double[]) as v from embeddings where embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    points as (select vec_id, p, {", ".join(f"cast(floor(256 * v[4 * p + {k}]) as bigint) as {x}" for k, x in enumerate(_X, 1))}
        from kept, (select unnest(range({PARTS})) as p)),
    firsts as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept),
    books0 as (select p, e, {", ".join(_X)} from points join firsts using (vec_id) where e < {ENTRIES}),
    {", ".join(steps)},
    last as ({_assigned(f"books{ROUNDS}")}),
    coded as (select vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' order by p) as code, cast(sum(best // {ENTRIES}) as bigint) as error
        from last group by vec_id)
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
        (select sha256(string_agg(concat_ws(',', {", ".join(_X)}), ',' order by p, e)) from books{ROUNDS}) as codebooks_sha256
    from coded join kept using (vec_id)"""


@query("op13_slice_intersect_codes", _sql())
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    codes, books = compress(vectors, PARTS, ENTRIES, ROUNDS)
    numbers = "" if books is None else ",".join(map(str, books.entries.reshape(-1).tolist()))
    codes = stored(codes, "vector-codes")
    # A stored table of labels: the optimizer knows its size, and splits a frequent label if it is too large to broadcast.
    totals = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))
