"""op7: chat formatting."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from lotflow.llm.chat import read_loss, read_turns, windows_within_budget
from lotflow.llm.registry import WORDS_SQL, query, table

BUDGET, HISTORY = 1024, 256
#: A conversation that holds control strings.
PROBE = r"\### Assistant: </turn> ok"
_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    """Digests of each conversation, whose windows come in order: only running hashes are held."""
    now = None

    def result():
        return pa.RecordBatch.from_pylist([{
            "conv_id": now["conv_id"], "n_turns": now["n_turns"], "turns_sha256": now["turns"].hexdigest(),
            "loss_chars": now["loss_chars"], "loss_sha256": now["loss"].hexdigest(), "formatted_chars": now["formatted_chars"]}],
            pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now["conv_id"] != row["conv_id"]:
                if now is not None:
                    yield result()
                now = {"conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0,
                       "turns": hashlib.sha256(), "loss": hashlib.sha256()}
            for role, text in read_turns(row["text"])[row["n_repeated"] :]:
                now["n_turns"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode())
            for text in read_loss(row["text"], row["loss"]):
                now["loss_chars"] += len(text)
                now["loss"].update(text.encode())
            now["formatted_chars"] += len(row["text"])
    if now is not None:
        yield result()


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '\\', '\\b'), '<', '\\l'), '#', '\\h')"


#: Over ``given(conv_id, turn, role, text)``: the turns with their place and tokens before them, and the span of each window, followed
#: from the first turn of a conversation on.
SPANS_SQL = f"""    sized as (select *, len({WORDS_SQL.format("text")}) + 4 as tokens, '<turn>' || {_escaped("role")} || '#' || {_escaped("text")} || '</turn>' || chr(10) as piece
        from given),
    placed as (select *, row_number() over w - 1 as place, sum(tokens) over w - tokens as before from sized
        window w as (partition by conv_id order by turn nulls last, role, text rows unbounded preceding)),
    heads as (select conv_id, tokens as head from placed where place = 0 and role = 'system'),
    led as (select p.*, p.place > 0 and head is not null and head + tokens <= {BUDGET} as leads, case when leads then head else 0 end as extra,
        least({HISTORY}, {BUDGET} - tokens - extra) as room from placed p left join heads h on p.conv_id = h.conv_id),
    begun as (select l.conv_id, l.place, any_value(l.leads) as leads, any_value(l.before) as before, any_value(l.extra) as extra,
        coalesce(min(k.place), l.place) as low, coalesce(min(k.before), any_value(l.before)) as low_before
        from led l left join placed k on l.conv_id = k.conv_id and k.place < l.place and l.before - k.before <= l.room
            and not (k.place = 0 and k.role = 'system') group by l.conv_id, l.place),
    nexts as (select b.conv_id, b.place, any_value(b.leads) as leads, any_value(b.low) as low, greatest(b.place + 1, coalesce(max(k.place), 0) + 1) as after
        from begun b left join placed k on b.conv_id = k.conv_id and k.place >= b.place
            and k.before + k.tokens <= b.before + {BUDGET} - b.extra - (b.before - b.low_before) group by b.conv_id, b.place),
    spans as (select conv_id, place, leads, low, after, 0 as number from nexts where place = 0
        union all select n.conv_id, n.place, n.leads, n.low, n.after, s.number + 1 from spans s join nexts n on s.conv_id = n.conv_id and s.after = n.place)"""


@query("op7_budgeted_chat", f"""with recursive given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'),
{SPANS_SQL},
    formatted as (select s.conv_id, sum(length(p.piece)) as chars from spans s join placed p on s.conv_id = p.conv_id
        and ((p.place >= s.low and p.place < s.after) or (s.leads and p.place = 0)) group by s.conv_id)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
        cast(any_value(f.chars) as bigint) as formatted_chars
    from placed join formatted f using (conv_id) group by conv_id""")
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    windows = windows_within_budget(turns.unionByName(probe), BUDGET, HISTORY)
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(_read_back, _SCHEMA)


@query("op7_chat_within_budget", f"""with recursive given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
{SPANS_SQL}
    select s.conv_id, cast(s.number as bigint) as "window", count(*) as n_turns, count(*) filter (p.place < s.place) as n_repeated,
        cast(sum(p.tokens) as bigint) as n_tokens, sha256(string_agg(p.piece, '' order by p.place)) as text_sha256,
        cast(coalesce(sum(length({_escaped("p.text")})) filter (p.role = 'assistant' and p.place >= s.place), 0) as bigint) as loss_chars
    from spans s join placed p on s.conv_id = p.conv_id and ((p.place >= s.low and p.place < s.after) or (s.leads and p.place = 0)) group by s.conv_id, s.number""")
def _(spark, sf_dir):
    windows = windows_within_budget(table(spark, sf_dir, "conversations"), BUDGET, HISTORY)
    learned = F.aggregate("loss", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return windows.select("conv_id", "window", F.regexp_count("text", F.lit("</turn>\n")).cast("long").alias("n_turns"), F.col("n_repeated").cast("long").alias("n_repeated"),
                          "n_tokens", F.sha2("text", 256).alias("text_sha256"), learned.alias("loss_chars"))
