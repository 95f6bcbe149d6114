"""Chat conversations formatted into windows of a token budget, with a loss mask."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotflow.llm.common import n_words, prepare, stored

#: The template: an unescaped "<" or "#" is always one of these.
OPEN, MIDDLE, CLOSE = "<turn>", "#", "</turn>\n"
#: Escapes, in the order in which they are written; undone in reverse order.  The sign of the escape comes first.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
#: Tokens of the template around a turn; a turn without words has as many.
TURN_TOKENS = 4
#: Turns of a conversation whose prefix sums are taken in one piece.
PIECE = 1024
#: Times budget and history of the tokens of a conversation that one task packs.
CELL = 64


def escaped(text: Column) -> Column:
    """A text without "<" and "#"; every backslash is followed by b, l or h."""
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: str) -> str:
    for raw, written in reversed(ESCAPES):
        text = text.replace(written, raw)
    return text


def ordered_turns(turns: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Turns with their place in the conversation and the tokens before them.

    Columns: conversation (a text, never null), conv_id, place, role, text, tokens, before.  Prefix sums are taken in
    pieces of PIECE turn numbers, whose totals are added afterwards: a conversation of any length is spread over
    tasks.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    rows = turns.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conversation"), "conv_id",
                        F.col("turn").cast("long").alias("turn"), role, text)
    rows = rows.withColumn("tokens", n_words(F.col("text")) + TURN_TOKENS if tokens is None else tokens)
    # Turns without a number come last.
    rows = rows.withColumn("piece", F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(2**62)))
    inside = Window.partitionBy("conversation", "piece").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumns({
        "place": F.row_number().over(inside) - 1,
        "before": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")})
    pieces = rows.groupBy("conversation", "piece").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conversation").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conversation", "piece", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in "tn"])
    return rows.join(pieces, ["conversation", "piece"]).select(
        "conversation", "conv_id", (F.col("place") + F.col("n")).alias("place"), "role", "text", "tokens", (F.col("before") + F.col("t")).alias("before"))


def _formatted(pieces: DataFrame, total: str | None = None) -> DataFrame:
    """Windows of their turns: conversation, window, conv_id, kind (0 the system turn, 1 history, 2 own), place, role, text.

    With ``total``, a column of that name has the sum of their ``tokens``.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    pieces = pieces.withColumns({"head": head, "body": escaped(F.col("text"))})
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    inside = Window.partitionBy("conversation", "window").orderBy("kind", "place")
    end = F.sum(F.length("piece")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    start = end - F.length("piece") + F.length("head")
    learned = (F.col("kind") == 2) & (F.col("role") == "assistant")
    span = F.when(learned, F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    # A window of the grid holds at most its budget, its history and one turn beyond each.
    entry = F.struct("kind", "place", "piece", span.alias("span"))
    sums = [F.sum("tokens").alias(total)] if total else []
    windows = pieces.select("conversation", "window", "conv_id", entry.alias("entry"), *(["tokens"] if total else [])).groupBy("conversation", "window").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("entry")).alias("entries"), *sums)
    spans = F.filter(F.transform("entries", lambda e: e["span"]), lambda s: s.isNotNull())
    return windows.select(
        "conv_id", "window", F.array_join(F.transform("entries", lambda e: e["piece"]), "").alias("text"),
        F.size(F.filter("entries", lambda e: e["kind"] < 2)).alias("n_repeated"), spans.alias("loss"), *([total] if total else []))


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256, tokens: Column | None = None) -> DataFrame:
    """One row per window: conv_id, window, text, n_repeated, loss (array of start and end in code points).

    ``turns(conv_id, turn, role, text)``.  A turn belongs to the window that its number of tokens before it, divided by
    ``budget``, names: windows are runs of whole turns, and a turn above the budget is never cut.  That grid lets a
    window's own turns run over the budget by almost one turn, and what is repeated comes on top:
    ``windows_within_budget`` keeps the bound.  A later window begins with the conversation's system turn, if its first turn is one, and with those turns before it that start at most
    ``history`` tokens before its own first turn; ``n_repeated`` counts them.  ``loss`` covers the texts of the
    assistant's turns in the window that is their own, so each is learned once.

    Null texts and roles are empty, turns without a number come last, ties are ordered by role and text, and repeated
    rows are repeated turns.  Rows without conv_id are one conversation, those with an empty one another.  A conversation without rows has no window;
    other columns are ignored.  Tokens are words plus TURN_TOKENS unless an expression is given.
    """
    prepare(turns.sparkSession)
    rows = ordered_turns(turns, tokens).withColumn("window", F.floor(F.col("before") / budget))
    rows = stored(rows.withColumn("system", (F.col("place") == 0) & (F.col("role") == "system")), "turns")
    starts = rows.groupBy(F.col("conversation").alias("c"), F.col("window").alias("w")).agg(F.min("before").alias("start"))
    starts = stored(starts, "windows")
    last = F.floor((F.col("before") + history) / budget)
    again = rows.filter(~F.col("system") & (last > F.col("window"))).withColumn("later", F.explode(F.sequence(F.col("window") + 1, last)))
    again = again.join(starts, (F.col("conversation") == F.col("c")) & (F.col("later") == F.col("w")) & (F.col("start") - F.col("before") <= history))
    again = again.select("conversation", "conv_id", F.col("later").alias("window"), F.lit(1).alias("kind"), "place", "role", "text")
    system = rows.filter("system").join(starts.filter("w > 0"), F.col("conversation") == F.col("c")).select(
        "conversation", "conv_id", F.col("w").alias("window"), F.lit(0).alias("kind"), "place", "role", "text")
    own = rows.select("conversation", "conv_id", "window", F.lit(2).alias("kind"), "place", "role", "text")
    return _formatted(own.unionByName(again).unionByName(system))


def _steps(pdf, budget: int, history: int):
    """For each turn, were it the first own one of a window: whether the system turn leads it, the place in ``pdf`` where its
    history begins, and the one after its last own turn."""
    place, size, before = (pdf[c].to_numpy() for c in ("place", "tokens", "before"))
    system, here = pdf["system"].iloc[0], np.arange(len(pdf))
    leads = (system >= 0) & (place > 0) & (system + size <= budget)
    extra = np.where(leads, system, 0)
    room = np.minimum(history, budget - size - extra)
    low = np.searchsorted(before, before - room, "left")
    low = np.minimum(np.maximum(low, np.searchsorted(place, 1) if system >= 0 else 0), here)
    after = np.searchsorted(before + size, before + budget - extra - (before - before[low]), "right")
    return leads, low, np.maximum(here + 1, after)


def _exits(budget: int, history: int):
    """For each turn that may be the first to begin a window in its cell: where the next cell is entered, and the windows until then."""
    import pandas as pd

    def exits(key, pdf):
        pdf = pdf.sort_values("place", ignore_index=True)
        mine = np.flatnonzero(pdf["own"].to_numpy())
        place, before, after = pdf["place"].to_numpy(), pdf["before"].to_numpy(), _steps(pdf, budget, history)[2]
        end, leave, count = mine[-1] + 1, {}, {}
        for i in mine[::-1].tolist():
            k = int(after[i])
            leave[i], count[i] = (leave[k], count[k] + 1) if k < end else (int(place[i]) + k - i, 1)
        entries = [i for i in mine.tolist() if i == mine[0] or before[i] <= before[mine[0]] + budget]
        return pd.DataFrame({"conversation": [key[0]], "cell": [key[1]], "entries": [[int(place[i]) for i in entries]],
                             "leave": [[leave[i] for i in entries]], "count": [[count[i] for i in entries]]})

    return exits


def _walk(pdf):
    """Where each cell of a conversation is entered, and the number of its first window."""
    import pandas as pd

    entry, number, found = 0, 0, []
    for row in pdf.sort_values("cell").itertuples():
        hit = np.flatnonzero(np.asarray(row.entries) == entry)
        if len(hit):
            found.append((row.conversation, row.cell, entry, number))
            entry, number = int(row.leave[hit[0]]), number + int(row.count_[hit[0]])
    return pd.DataFrame(found, columns=["conversation", "cell", "entry", "number"])


def _packed(budget: int, history: int):
    """The turns of the windows that begin in a cell."""
    import pandas as pd

    def pack(key, pdf):
        pdf = pdf.sort_values("place", ignore_index=True)
        place = pdf["place"].to_numpy()
        leads, low, after = _steps(pdf, budget, history)
        i, number, end = int(np.searchsorted(place, pdf["entry"].iloc[0])), int(pdf["number"].iloc[0]), np.flatnonzero(pdf["own"].to_numpy())[-1] + 1
        found = []
        while i < end:
            found += [(0, number, 0)] * bool(leads[i])
            found += [(int(place[k]), number, 1 if k < i else 2) for k in range(low[i], after[i])]
            i, number = int(after[i]), number + 1
        out = pd.DataFrame(found, columns=["place", "window", "kind"])
        out.insert(0, "conversation", key[0])
        return out

    return pack


def windows_within_budget(turns: DataFrame, budget: int = 1024, history: int = 256, tokens: Column | None = None) -> DataFrame:
    """The columns of ``chat_windows`` and ``n_tokens``, no window above ``budget`` unless it is a single turn above it.

    Windows are filled in order, numbered from 0: each takes the next turns, as many as fit beside what it repeats, the
    conversation's system turn, if its first turn is one, and the turns that start at most ``history`` tokens before its
    first own turn. Where that turn would not fit beside them, the history is cut to the turns that leave it room, and the system
    turn is left out if even it leaves none. A turn above the budget is a window of its own that repeats nothing.

    Windows follow from prefix sums (not negative), in cells of CELL times budget and history: the ways through a cell are found in
    one task each, only their ends are followed along a conversation, and texts move once their windows are known.

    Nulls, ties, repeated rows and other columns are as in ``chat_windows``.
    """
    prepare(turns.sparkSession)
    rows = stored(ordered_turns(turns, tokens), "turns")
    system = F.max(F.when((F.col("place") == 0) & (F.col("role") == "system"), F.col("tokens")))
    width = CELL * (budget + history)
    long = rows.groupBy("conversation").agg(
        F.max(F.col("before") + F.col("tokens")).alias("total"), F.floor(F.max("before") / width).alias("cells"), F.coalesce(system, F.lit(-1)).alias("system"))
    long = stored(long.filter(F.col("total") > budget).drop("total"), "long-conversations")

    # Each turn goes to its own cell, and to those whose windows it may follow or precede.
    first = F.greatest(F.lit(0), F.ceil((F.col("before") - budget) / width) - 1)
    cell = F.explode(F.sequence(first, F.least("cells", F.floor((F.col("before") + history) / width))))
    cut = rows.select("conversation", "place", F.col("tokens").cast("long").alias("tokens"), "before").join(long, "conversation").withColumn("cell", cell)
    cut = cut.withColumn("own", F.floor(F.col("before") / width) == F.col("cell"))
    # A turn above a cell's width leaves cells without a turn of their own.
    full = cut.filter("own").select("conversation", "cell").distinct()
    cut = stored(cut.join(full, ["conversation", "cell"], "left_semi"), "cells")
    ways = cut.filter("cells > 0").groupBy("conversation", "cell").applyInPandas(
        _exits(budget, history), "conversation string, cell long, entries array<long>, leave array<long>, count array<long>")
    entered = ways.withColumnRenamed("count", "count_").groupBy("conversation").applyInPandas(_walk, "conversation string, cell long, entry long, number long")
    whole = long.filter("cells = 0").select("conversation", *[F.lit(0).cast("long").alias(c) for c in ("cell", "entry", "number")])
    packed = cut.join(entered.unionByName(whole), ["conversation", "cell"]).groupBy("conversation", "cell").applyInPandas(
        _packed(budget, history), "conversation string, place long, window long, kind int")

    columns = ["conversation", "conv_id", "window", "kind", "place", "role", "text", "tokens"]
    short = rows.join(long, "conversation", "left_anti").withColumns({"window": F.lit(0).cast("long"), "kind": F.lit(2)})
    return _formatted(short.select(*columns).unionByName(rows.join(packed, ["conversation", "place"]).select(*columns)), "n_tokens")


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    found = []
    for piece in text.split(CLOSE)[:-1]:
        role, body = piece[len(OPEN) :].split(MIDDLE)
        found.append((unescape(role), unescape(body)))
    return found


def read_loss(text: str, loss: list[dict]) -> list[str]:
    """The texts under the loss mask."""
    return [unescape(text[s["start"] : s["end"]]) for s in loss]
