"""op12: periodic runs of words."""

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.registry import WORDS_SQL, query, table
from lotflow.llm.runs import periodic_runs

LEAST, TIMES = 6, 4


def _repeated(doc_id: int | None, text: bytes | None) -> bytes | None:
    """The text, or for a tenth of the ids what it is when its words repeat from some place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    words = (text or b"").split() if h % 10 == 0 else []
    if not words:
        return text
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))])


def with_repeats(docs: DataFrame) -> DataFrame:
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_repeated(i, t.as_py()) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(change, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", longest.alias("longest"), F.array_join(lines, "").alias("listed")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: CRC-32 of the decimal doc_id, bit by bit: after each byte come eight shifts (-1).
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''),
        lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end))"""


@query("op12_recompression_runs", f"""with cut as (select doc_id, {WORDS_SQL.format("text")} as ws, {_CRC} as h from documents),
    planted as (select *, len(ws) as n, h // 10 as g, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from cut),
    words as (select doc_id, n, i, case when i >= a then ws[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] else ws[1 + i] end as w
        from (select *, unnest(range(n)) as i from planted)),
    equal as (select x.doc_id, y.i - x.i as q, x.i from words x join words y on x.doc_id = y.doc_id and x.w = y.w
        where y.i > x.i and {TIMES} * (y.i - x.i) <= x.n),
    islands as (select *, i - row_number() over (partition by doc_id, q order by i) as island from equal),
    stretches as (select doc_id, q, min(i) as s, max(i) + q + 1 as e from islands group by doc_id, q, island),
    runs as (select doc_id, s, e - s as length, min(q) as q from stretches where e - s >= greatest({LEAST}, {TIMES} * q) group by doc_id, s, e),
    best as (select doc_id, max_by(s, length * 1000000000000 - s * 1000000 - q) as start, max_by(q, length * 1000000000000 - s * 1000000 - q) as period,
        max(length) as length, count(*) as n_runs, string_agg(concat_ws(',', s, length, q) || chr(10), '' order by s, q) as listed
        from runs group by doc_id),
    dropped as (select distinct doc_id, unnest(range(s + q, s + length)) as i from runs),
    kept as (select doc_id, string_agg(w, ' ' order by i) as text from words anti join dropped using (doc_id, i) group by doc_id)
    select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
        sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
    from documents d left join best using (doc_id) left join kept k using (doc_id)""")
def _(spark, sf_dir):
    return digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents")), LEAST, TIMES))
