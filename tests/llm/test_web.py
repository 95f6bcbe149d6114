"""Boilerplate lines and URL filters against plain loops."""

import random
from collections import Counter, defaultdict

import pytest

from lotflow.llm.lines import without_boilerplate
from lotflow.llm.urls import judge


def test_lines_against_a_loop(spark):
    draw = random.Random(4)
    lines = ["menu", "foot é", "", "  ", "rare", "x" * 100_000]
    rows = [(i, "\n".join(draw.choice([*lines, f"own {i}"]) for _ in range(draw.randint(1, 6))), draw.choice(["a", "a", "b", None])) for i in range(200)]
    rows += [(500, None, "a"), (501, "", "a"), (None, "menu\nno id", "a"), (7, rows[7][1], rows[7][2]), (502, "menu", "alone"), (503, "menu\n\nmenu\n", "a")]
    docs = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, source string, n_lines int, line string")
    ratio, least = 0.25, 4
    pages, total = defaultdict(Counter), Counter()
    for _, text, source in rows:
        total[source] += 1
        for line in set((text if text is not None else "").split("\n")) if text is not None else ():
            pages[source][line] += bool(line.strip(" "))
    drop = {(s, line) for s, counts in pages.items() for line, n in counts.items() if n > ratio * total[s] and n >= least}
    assert drop
    want = []
    for i, text, source in rows:
        if text is None:
            want.append((i, None, 0, 0))
        else:
            kept = [x for x in text.split("\n") if (source, x) not in drop]
            want.append((i, "\n".join(kept), len(text.split("\n")), len(text.split("\n")) - len(kept)))
    found = without_boilerplate(docs.repartition(3), "source", ratio, least)
    assert found.columns == ["doc_id", "text", "source", "line", "n_lines", "n_dropped"]
    assert sorted(str(tuple(r)) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()) == sorted(map(str, want))
    assert without_boilerplate(docs.limit(0)).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"), ("org", "/fr/", "block"), ("b", "", "block"), (None, "/", "block"), ("c", None, "allow"), ("..net", "/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def verdict(host, path):
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if h is not None and p is not None
            and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[3], max(fits)[2]) if fits else (None, "allow")


@pytest.mark.parametrize("sample", [4, 8192])
def test_urls_against_a_loop(spark, sample):
    draw = random.Random(sample)
    host = lambda: ".".join(draw.choice(["a", "b", "example", "EXAMPLE", "x-y", "É", ""]) for _ in range(draw.randint(0, 3))) + draw.choice([".net", ".com", "net", "b", ".org", "example.net", ":80"])
    urls = [f"{draw.choice(['http', ''])}://{host()}{draw.choice(['', '/', '/en/x', '/de/', '/fr/1', '/en'])}{draw.choice(['', '?a=/en/', '#://b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://b", "http://a.example.net/x"] + ["http://hot.example.net/en/"] * 200 + ["http://x/" + "p" * 100_000]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, part int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = judge(pages.repartition(3), rules, sample=sample).collect()
    want = []
    for i, u in enumerate(urls):
        h, p = parts(u)
        want.append(str((i if i % 50 else None, h, p, *verdict(h, p))))
    assert sorted(str(tuple(r)) for r in found) == sorted(want)


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert judge(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in judge(pages, rules.limit(0), default="block").collect()] == [(1, "a.net", "/", None, "block")]
