"""Personal data: patterns, and a skip-chain conditional random field that labels an entity's other mentions alike."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.common import hash_sample, prepare

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# Each pattern is tried once per run of its characters, so that long runs take linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Numbers that may be a mention: digits with at most two signs between them.
_NUMBER = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?()[]{}<>\"'"


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        # What lies before this sign is of no further use to the next.
        at = text.find("@", max(at + 1, free))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, by kind and start; each kind is searched by itself."""
    found = [Span("email", s, e) for s, e in _emails(text)] if "@" in text else []
    found += [Span("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                found.append(Span("card", m.start(), m.end()))
    if "+" in text:
        found += [Span("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


class Node(NamedTuple):
    """A possible mention: where, what it is by the patterns (0: unknown), its entity's name and its features."""

    start: int
    end: int
    label: int
    entity: str
    features: list[int]


#: Features of a node: one of each group, or none.
FEATURES = ("digits7", "digits8-9", "digits10-11", "digits12-15", "digits16-19", "digits20+", "dots3", "dot", "space", "dash",
            "bracket", "plus", "luhn", "at", "handle", "no_digit")
_PLACE = {name: k for k, name in enumerate(FEATURES)}


def _number_features(text: str, start: int, end: int) -> list[int]:
    body = text[start:end]
    n = sum("0" <= c <= "9" for c in body)
    size = "digits7" if n < 8 else "digits8-9" if n < 10 else "digits10-11" if n < 12 else "digits12-15" if n < 16 else (
        "digits16-19" if n < 20 else "digits20+")
    names = [size, *[name for name, sign in (("dot", "."), ("space", " "), ("dash", "-"), ("bracket", "(")) if sign in body]]
    names += ["dots3"] * (body.count(".") == 3) + ["plus"] * (text[max(0, start - 1) : start] == "+")
    names += ["luhn"] * (16 <= n <= 19 and passes_luhn(_digits(body)))
    return [_PLACE[name] for name in names]


def _entity(digits: str) -> str:
    """Numbers of the same last ten digits may be one entity written in several ways."""
    return digits[-10:]


def nodes_of(text: str, base: list[Span]) -> list[Node]:
    """The matches and whatever else may be a mention: numbers of seven digits and more, tokens with an "@", and tokens
    that are the name in one of the text's addresses."""
    nodes, taken = [], sorted((s.start, s.end) for s in base)
    names = set()
    for s in base:
        body = text[s.start : s.end]
        if s.kind == "email":
            local = body.split("@")[0].lower()
            names.add(local)
            nodes.append(Node(s.start, s.end, 1, local, [_PLACE["at"]]))
        else:
            features = _number_features(text, s.start + (s.kind == "phone"), s.end)
            nodes.append(Node(s.start, s.end, 1 + KINDS.index(s.kind), _entity(_digits(body)), features))

    free = _free(taken)
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 7 and free(m.start(), m.end()):
            digits = _digits(m[0])
            if len(digits) >= 7:
                nodes.append(Node(m.start(), m.end(), 0, _entity(digits), _number_features(text, m.start(), m.end())))
    if names or "@" in text:
        for m in _TOKEN.finditer(text):
            token = m[0].strip(_EDGES)
            if len(token) < 4 or not ("@" in token[1:-1] or token.lower() in names):
                continue
            start = m.start() + m[0].index(token)
            if free(start, start + len(token)):
                local = token.split("@")[0].lower()
                features = ["at" if "@" in token else "handle"] + ["no_digit"] * (not any(c.isdigit() for c in token))
                nodes.append(Node(start, start + len(token), 0, local, [_PLACE[f] for f in features]))
    return sorted(nodes)


def _free(taken: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether [start, end) touches none of the taken spans, which may overlap: none of those that begin before its end
    reaches beyond its start."""
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k == 0 or reach[k - 1] <= start

    return free


class Field(NamedTuple):
    """A trained field: unary weights (features + 1 x labels), and the weights of equal entity labels of a skip edge and
    of neighbours in the chain."""

    unary: np.ndarray
    skip: float
    chain: float


#: What speaks against a mention that no pattern has found: more than its look alone can outweigh, less than a
#: labelled mention of the same entity.
NONE_PRIOR = 5.0


def unary_scores(field: Field, nodes: list[Node]) -> np.ndarray:
    out = np.tile(field.unary[-1], (len(nodes), 1))
    out[:, 0] += NONE_PRIOR
    for k, node in enumerate(nodes):
        out[k] += field.unary[node.features].sum(axis=0)
        if node.label:
            out[k] = -20.0
            out[k, node.label] = 20.0
    return out


def beliefs(field: Field, nodes: list[Node], rounds: int = 12) -> np.ndarray:
    """Log beliefs of each node's labels after loopy message passing.

    Neighbours in the text are joined by chain edges; all mentions of an entity that a pattern has found at least once by
    skip edges to one hub, which has no evidence of its own, so that a group of n mentions has n edges.  Equal entity labels add the edge's weight; two
    "none" add nothing, so unlabelled mentions never outvote a labelled one.
    """
    groups = defaultdict(list)
    for k, node in enumerate(nodes):
        groups[node.entity].append(k)
    hubs = [members for members in groups.values() if len(members) > 1 and any(nodes[k].label for k in members)]
    n = len(nodes)
    a = [*range(n - 1), *[k for members in hubs for k in members]]
    b = [*range(1, n), *[n + h for h, members in enumerate(hubs) for _ in members]]
    weight = np.array([field.chain] * (n - 1) + [field.skip] * sum(map(len, hubs)))
    scores = np.zeros((n + len(hubs), len(LABELS)))
    scores[:n] = unary_scores(field, nodes)
    if not len(a):
        return scores[:n]
    source, target = np.array([*a, *b]), np.array([*b, *a])
    back = np.concatenate((np.arange(len(a), 2 * len(a)), np.arange(len(a))))
    bonus = np.expm1(np.concatenate((weight, weight)))[:, None] * (np.arange(len(LABELS)) > 0)
    messages = np.zeros((len(source), len(LABELS)))
    for _ in range(rounds):
        total = scores.copy()
        np.add.at(total, target, messages)
        rest = total[source] - messages[back]
        rest -= rest.max(axis=1, keepdims=True)
        share = np.exp(rest)
        # Sum over the source's labels: all with weight 1, and the equal one with its bonus.
        new = np.log(share.sum(axis=1, keepdims=True) + bonus * share)
        new -= new.max(axis=1, keepdims=True)
        messages = 0.5 * messages + 0.5 * new
    np.add.at(scores, target, messages)
    return scores[:n]


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and these with the spans that the field adds; both by kind, then start."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    found = list(base)
    if any(not node.label for node in nodes):
        best = beliefs(field, nodes).argmax(axis=1)
        found += [Span(LABELS[k], node.start, node.end) for node, k in zip(nodes, best) if k and not node.label]
    return base, sorted(found, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


#: Agreeing pairs that the skip weight starts from: mentions of one entity are taken to be of one kind.
PRIOR_PAIRS = 2000


def train(rows: list[dict]) -> Field:
    """Piecewise training on the nodes of sampled documents (doc, place, label, entity, features).

    Nodes labelled by a pattern are examples of their kind, nodes of an entity without any labelled mention in the
    document examples of "none"; other mentions are what the field is for and teach nothing.  The skip weight is the log
    odds that two labelled mentions of an entity agree, the chain weight that of neighbours (between 0 and 1).
    """
    named, chain, pairs = defaultdict(set), [1, 1], [PRIOR_PAIRS, 1]
    rows = sorted(rows, key=lambda r: (r["doc"], r["place"]))
    for before, row in zip([None, *rows], rows):
        if row["label"]:
            named[row["doc"], row["entity"]].add(row["label"])
            if before and before["doc"] == row["doc"] and before["label"]:
                chain[before["label"] != row["label"]] += 1
    for labels in named.values():
        pairs[len(labels) > 1] += 1
    used = [r for r in rows if r["label"] or (r["doc"], r["entity"]) not in named]
    unary = np.zeros((len(FEATURES) + 1, len(LABELS)))
    unary[-1, 0] = 1.0
    if used:
        x = np.zeros((len(used), len(FEATURES) + 1))
        x[:, -1] = 1
        for k, row in enumerate(used):
            x[k, row["features"]] = 1
        y = np.eye(len(LABELS))[[row["label"] for row in used]]
        weights = unary
        for _ in range(300):
            scores = x @ weights
            scores -= scores.max(axis=1, keepdims=True)
            p = np.exp(scores)
            p /= p.sum(axis=1, keepdims=True)
            weights = weights + 0.5 * (x.T @ (y - p) / len(used) - 0.01 * weights)
        unary = weights
    return Field(unary, float(np.log(pairs[0] / pairs[1])), float(np.clip(np.log(chain[0] / chain[1]), 0.0, 1.0)))


def _train_rows(batches: Iterator[pa.RecordBatch]):
    schema = pa.schema([("doc", pa.int64()), ("place", pa.int32()), ("label", pa.int32()), ("entity", pa.string()), ("features", pa.list_(pa.int32()))])
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            for k, node in enumerate(nodes_of(text, base_spans(text))):
                rows.append({"doc": doc, "place": k, "label": node.label, "entity": node.entity, "features": node.features})
        yield pa.RecordBatch.from_pylist(rows, schema)


def fit(docs: DataFrame, sample: int = 8000, nodes: int = 40_000) -> Field:
    """Train on at most ``sample`` documents, in hash order, and at most ``nodes`` of their nodes."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    some = hash_sample(rows, sample, "doc_id", "text", room=2).select(F.xxhash64("doc_id", "text").alias("doc"), "text")
    rows = some.mapInArrow(_train_rows, "doc long, place int, label int, entity string, features array<int>")
    return train(rows.orderBy("doc", "place").limit(nodes).toArrow().to_pylist())


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of kind, start and end in code points, end exclusive).

    ``base`` are the matches of the patterns, leftmost and not overlapping within a kind; matches that fail their test
    (parts of an address, Luhn's sum, number of digits) are dropped.  ``spans`` are these and the other mentions of the
    same entities that the field labels; without a field given, one is trained on the documents (``fit``).

    Null and empty texts have no spans.  Rows are handled each by itself; null and repeated ids do no harm.  No rows
    give no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    field = fit(docs) if field is None else field
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                b, s = all_spans(text or "", field)
                base.append([x._asdict() for x in b])
                spans.append([x._asdict() for x in s])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(spans, span)], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id long, base {_SPANS}, spans {_SPANS}")
