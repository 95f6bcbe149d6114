"""Windows read back, against plain loops."""

import random
from collections import defaultdict

import pytest

from lotflow.llm import chat
from lotflow.llm.chat import CLOSE, PIECE, TURN_TOKENS, chat_windows, read_loss, read_turns, windows_within_budget

ROLES = ["user", "assistant"]


def rows_of(seed):
    draw = random.Random(seed)
    text = lambda: " ".join(draw.choice(["w", "<turn>", "#", "\\", "\\l", "</turn>\n", "é", "\\b#"]) for _ in range(draw.choice([0, 1, 5, 30])))
    rows = []
    for conv in range(12):
        first = draw.random() < 0.5
        rows += [(conv, t, "system" if first and t == 0 else ROLES[t % 2], text()) for t in range(draw.choice([1, 2, 40]))]
    rows += [(50, t, ROLES[t % 2], "x " * 300) for t in (0, 1, 2 * PIECE, 2 * PIECE + 1)]
    rows += [(51, None, None, None), (51, 0, "user", "q"), (51, 1, "assistant", None), (51, 1, "assistant", "z"), (51, 1, "assistant", "z")]
    return rows + [(None, 0, "user", "no id"), (None, 1, "assistant", "either")]


def ordered(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in turns.items()}


@pytest.mark.parametrize(("budget", "history"), [(50, 20), (1000, 0), (20, 60)])
def test_windows_against_a_loop(spark, budget, history):
    rows = rows_of(budget)
    data = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, window int, place string")
    found = defaultdict(list)
    for r in chat_windows(data.repartition(4), budget, history).collect():
        found[r["conv_id"]].append(r)
    want = ordered(rows)
    assert set(found) == set(want)
    for conv, turns in want.items():
        before, starts = 0, []
        for role, text in turns:
            starts.append(before)
            before += len(text.split()) + TURN_TOKENS
        windows = defaultdict(list)
        for k, s in enumerate(starts):
            windows[s // budget].append(k)
        listed = sorted(found[conv], key=lambda r: r["window"])
        assert [r["window"] for r in listed] == sorted(windows)
        learned = []
        for r in listed:
            own = windows[r["window"]]
            system = [0] if turns[0][0] == "system" and own[0] > 0 else []
            past = [k for k in range(len(system) or (turns[0][0] == "system"), own[0]) if starts[own[0]] - starts[k] <= history]
            assert r["n_repeated"] == len(system) + len(past)
            assert read_turns(r["text"]) == [turns[k] for k in system + past + own]
            assert r["text"].count(CLOSE) == len(system + past + own)
            loss = read_loss(r["text"], r["loss"])
            assert loss == [turns[k][1] for k in own if turns[k][0] == "assistant"]
            learned += loss
        assert learned == [t for role, t in turns if role == "assistant"]


def test_no_rows(spark):
    assert chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_no_conversation_id_is_not_an_empty_one(spark):
    rows = [(None, 0, "user", "a"), ("", 0, "user", "b"), ("", 1, "assistant", "c")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    found = {r["conv_id"]: read_turns(r["text"]) for r in windows_within_budget(turns).collect()}
    assert found == {None: [("user", "a")], "": [("user", "b"), ("assistant", "c")]}


def filled(turns, budget, history):
    """(repeated, own) turn numbers of each window, turn by turn."""
    sizes = [len(t.split()) + TURN_TOKENS for _, t in turns]
    starts, system, k, out = [sum(sizes[:i]) for i in range(len(sizes))], turns[0][0] == "system", 0, []
    while k < len(turns):
        head = [0] if system and k > 0 and sizes[0] + sizes[k] <= budget else []
        room = min(history, budget - sizes[k] - sum(sizes[i] for i in head))
        past = [i for i in range(int(system), k) if starts[k] - starts[i] <= room]
        own = [k]
        while own[-1] + 1 < len(turns) and sum(sizes[i] for i in [*head, *past, *own, own[-1] + 1]) <= budget:
            own.append(own[-1] + 1)
        out.append((head + past, own))
        k = own[-1] + 1
    return out


@pytest.mark.parametrize(("budget", "history", "cell"), [(50, 20, 64), (50, 20, 2), (1000, 0, 64), (40, 60, 1), (120, 30, 1)])
def test_no_window_above_the_budget(spark, monkeypatch, budget, history, cell):
    monkeypatch.setattr(chat, "CELL", cell)
    rows = rows_of(budget) + [(60, t, "system" if t == 0 else ROLES[t % 2], "w " * (t * 7 % 40)) for t in range(300)]
    found = defaultdict(list)
    for r in windows_within_budget(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), budget, history).collect():
        found[r["conv_id"]].append(r)
    want = ordered(rows)
    assert set(found) == set(want)
    for conv, turns in want.items():
        listed, spans = sorted(found[conv], key=lambda r: r["window"]), filled(turns, budget, history)
        assert [r["window"] for r in listed] == list(range(len(spans)))
        for r, (repeated, own) in zip(listed, spans):
            assert read_turns(r["text"]) == [turns[k] for k in repeated + own] and r["n_repeated"] == len(repeated)
            assert read_loss(r["text"], r["loss"]) == [turns[k][1] for k in own if turns[k][0] == "assistant"]
            size = sum(len(turns[k][1].split()) + TURN_TOKENS for k in repeated + own)
            assert r["n_tokens"] == size and (size <= budget or (not repeated and len(own) == 1))
