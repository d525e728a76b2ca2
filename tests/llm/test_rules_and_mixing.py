"""URL rules, quotation links and source mixing against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from odd import documents

from lectern.llm import chat_format, mixing, url_filter

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "", "allow"), ("example.com", "/en/a", "allow"), ("example.com", "/en/", "allow"), ("", "/", "block"), ("org", None, "block"),
]
URLS = [
    "http://www.example.com/en/1", "https://EXAMPLE.com/en/a/b?x=1", "http://a.b.example.com/de/#f", "http://notexample.com/en/1",
    "ftp://x.net/es/", "x.net/es/", None, "", "http://", "http://com", "http://com/", "http://exampleXcom/en/", "http://x.net?/es/",
    "http://user@y.net:80/es/", "http://y.net:80/es/", "a://b.net://c/es/", "http://.net/es/", "http://net./es/", "http://www.example.com/en/1",
    "http://é.net/es/ü\nz", "http://example.com/en/a", "http://example.com/en",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v == "block", v) for h, p, v in RULES
            if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[4] if best else "allow"


def test_url_filter_by_brute_force(spark):
    pages = spark.createDataFrame(
        [(i % 15 if i else None, u, "x", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, key int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == Counter((i % 15 if i else None, *judged(u)) for i, u in enumerate(URLS))
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    nothing = url_filter.filter_urls(pages, rules.limit(0), default="block").collect()
    assert len(nothing) == len(URLS) and {(r["rule"], r["verdict"]) for r in nothing} == {(None, "block")}


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = url_filter.filter_urls(pages, rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


CHAT = [
    (1, 0, "user", "How do I read parquet?\nI have many files."),
    (1, 1, "assistant", "Use spark.read.parquet.\n\nIt takes a folder."),
    (1, 2, "user", "Thanks."),
    (1, 3, "user", "> How do I read PARQUET\nActually I meant ORC."),
    (1, 4, "assistant", "Then spark.read.orc."),
    (1, 5, "user", "> > How do I read parquet?\n> > I have many files.\n> Use spark.read.parquet.\n>\n> It takes a folder.\nWhich folder?"),
    (1, 6, "user", ">Then spark.read.orc.\n>> no such thing\nGood."),
    (1, 7, "user", "> Good.\nreally"),
    (2, 0, "user", None), (2, 3, "user", ""), (2, 5, "assistant", ">"), (2, 5, "assistant", ">"), (2, 6, "user", "> How do I read parquet?"),
    (None, 1, "user", "> lost"), (3, None, "user", "text"), (4, 9, None, "> later text\nbody"), (4, 10, "user", "later text"),
]


def test_quotation_links(spark):
    chat = spark.createDataFrame([(*r, 1, "x") for r in CHAT], "conv_id bigint, turn bigint, role string, text string, mid int, level string")
    got = chat_format.link_quotations(chat).collect()
    assert len(got) == len(CHAT)
    rows = {(r["conv_id"], r["turn"]): r for r in got}
    reply = {t: rows[1, t]["reply_to"] for t in range(8)}
    assert reply == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: 1, 6: 4, 7: 6}
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["reply_path"])]
    assert order == [0, 3, 4, 6, 7, 1, 5, 2]  # every message after the one it answers, with what continues it
    # lines and paragraphs: two lines and their paragraph of level 2, two single lines of level 1
    assert (rows[1, 5]["n_quoted"], rows[1, 5]["n_linked"]) == (5, 5)
    assert (rows[1, 6]["n_quoted"], rows[1, 6]["n_linked"]) == (2, 1)
    assert rows[1, 5]["body"] == "Which folder?" and rows[1, 1]["body"] == "Use spark.read.parquet.\n\nIt takes a folder."
    assert rows[2, 6]["reply_to"] == 5 and rows[2, 6]["n_linked"] == 0  # another conversation's text is no original
    assert rows[4, 9]["reply_to"] is None  # nor is what comes later
    assert rows[None, 1]["reply_path"] is None and rows[3, None]["reply_to"] is None
    assert chat_format.link_quotations(chat.limit(0)).count() == 0
    plan = chat_format.link_quotations(chat)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by filling up in rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in held)
        open_weight = sum(weight[s] for s in names if s not in held)
        target = {s: most * sizes[s] if s in held else left * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in held and target[s] > most * sizes[s]}
        if not over:
            return target
        held |= over


@pytest.mark.parametrize("group", [4, 2048])
def test_mixing(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    rows = [(i, " ".join(["word"] * (1 + i * 7 % 40)), ["a", "b", "c", None][i % 4] if i % 9 else "tiny") for i in range(400)]
    rows += [(1000, "copy of one row", "b")] * 9 + [(1001, None, "a"), (1002, "", "empty"), (None, "no id", "c")]
    docs = documents(spark, rows)
    got = mixing.mix_sources(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = shares(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 40
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mix = mixing.take(docs, mixing.mix_sources(docs))
    assert mix.columns == docs.columns
    times = Counter()
    for r in got:
        times[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mix.collect()) == +times
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_mixing_keeps_chances():
    """Over many seeds, a document is taken as often as it is wanted."""
    import numpy as np
    import pandas as pd

    n, chance = 60, 0.3
    total = np.zeros(n)
    for seed in range(600):
        frame = pd.DataFrame({"size": np.arange(n, 0, -1), "digest": np.arange(n), "chance": [chance] * n, "copies": [0] * n})
        out = mixing._meeting(seed, True)(frame)
        total += out.sort_values("digest")["copies"].to_numpy()
        assert abs((out["copies"] * out["size"]).sum() - chance * n * (n + 1) / 2) <= 12
    assert np.abs(total / 600 - chance).max() < 0.1
