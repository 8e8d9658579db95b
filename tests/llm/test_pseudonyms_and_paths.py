"""Pseudonyms: long hosts, linked layouts, no clashes.  Path templates: no cap on sections or depth."""

import datetime

import pytest

from tidelag.llm import feistel_pii as P
from tidelag.llm import path_templates as T


def pseudonyms(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    out = P.pseudonymised(df, "key").orderBy("doc_id").collect()
    return [r.text for r in out]


def test_hosts_of_very_many_labels_do_no_harm(spark):
    labels = "a." * 500_000
    texts = [f"x@{labels}com", f"x@{labels}", ("y@" + "b." * 200 + "com ") * 2000, "mail me@example.org now"]
    out = pseudonyms(spark, texts)
    assert out[0].endswith("com") and out[3].endswith("@example.org now") and out[3] != texts[3]


def test_equal_phones_stay_linked_in_every_grouping(spark):
    one, two, three = pseudonyms(spark, ["+44 20 7946 0958", "+442079460958", "+1 (212) 555 0123"])
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(one) == digits(two) and digits(one).startswith("44") and digits(one) != "442079460958"
    assert three.startswith("+1 (")


def test_dates_do_not_clash_and_keep_their_order(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(d) for d in range(0, 2400)]
    texts = [d.strftime("%d/%m/%Y") for d in days] + [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    out = pseudonyms(spark, texts)
    assert len(set(out)) == len(set(texts))
    for before, after in zip(texts, out):
        assert (int(before[3:5]) > 12) == (int(after[3:5]) > 12)


def test_accounts_do_not_become_cards(spark):
    def luhn(s):
        return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10

    accounts = [str(10**13 + 7919 * i) for i in range(500)]
    accounts = [a for a in accounts if luhn(a)]
    out = pseudonyms(spark, accounts)
    assert len(set(out)) == len(accounts) and all(luhn(a) for a in out) and all(len(a) == 14 for a in out)


def judged(spark, pages):
    """pages: (url, label or None)."""
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(pages)], "page_id long, url string")
    labels = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(pages) if v is not None], "page_id long, label int")
    return {r.page_id: r.verdict for r in T.judged_urls(table, rules=[], labels=labels).collect()}


@pytest.mark.parametrize("sections", [3, 65])
def test_any_number_of_sections_keeps_its_verdicts(spark, sections):
    pages = [(f"http://h.net/s{chr(97 + s % 26) * (s // 26 + 1)}/{i}", 1) for s in range(sections) for i in range(40)]
    pages += [(f"http://h.net/bad/{i}", 0) for i in range(40)] + [("http://h.net/bad/x/y", None), ("http://h.net/sa/7", None)]
    got = judged(spark, pages)
    assert got[len(pages) - 2] == "block" and got[len(pages) - 1] == "allow"


def test_any_depth_is_looked_at(spark):
    for depth in (0, 5):
        way = "http://h.net/en" + "/a" * depth
        pages = [(f"{way}/spam/{i}", 0) for i in range(200)] + [(f"{way}/news/{i}", 1) for i in range(200)]
        got = judged(spark, [*pages, (f"{way}/spam/new", None), (f"{way}/news/new", None)])
        assert (got[400], got[401]) == ("block", "allow")


def test_frequent_sections_stand_out_among_single_pages(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05}")
    pages = [(f"http://h.net/{word(i)}", 1) for i in range(300)] + [(f"http://h.net/bad/{word(i)}", 0) for i in range(100)]
    got = judged(spark, [*pages, ("http://h.net/bad/zz", None), ("http://h.net/zzz", None)])
    assert (got[400], got[401]) == ("block", "allow")


def brute(pages):
    """The template tree built node by node, and the verdict of every page."""
    import math
    import re

    rows = []
    for url, label in pages:
        host, _, path = url.split("://", 1)[1].partition("/")
        segments = re.sub("[0-9]+", "*", path).split("/") if path else []
        rows.append({"host": host, "s": segments, "g": int(label == 1), "b": int(label == 0), "t": host})
    d = 0
    while True:
        nodes = {}
        for r in rows:
            nodes.setdefault(r["t"], []).append(r)
        going = {
            t: rs for t, rs in nodes.items()
            if sum(r["g"] for r in rs) and sum(r["b"] for r in rs) and max(len(r["s"]) for r in rs) > d
        }
        if not going:
            break
        for t, rs in going.items():
            own = lambda r: r["s"][d] if d < len(r["s"]) else ""
            count = {}
            for r in rs:
                count[own(r)] = count.get(own(r), 0) + 1
            rare = {k: n for k, n in count.items() if n < T.MIN_SEEN and k}
            wild = sum(rare.values()) >= T.MIN_SEEN and len(rare) > sum(rare.values()) * T.MAX_NOVELTY
            branch = lambda r: "*" if wild and own(r) in rare else own(r)
            g, b = sum(r["g"] for r in rs), sum(r["b"] for r in rs)
            rate = g / (g + b)
            for name in {branch(r) for r in rs}:
                mine = [r for r in rs if branch(r) == name]
                n, good = sum(r["g"] + r["b"] for r in mine), sum(r["g"] for r in mine)
                spread = math.sqrt(rate * (1 - rate) * n)
                differs = n > 0 and abs(good - rate * n) > T.SIMILAR_Z * spread
                for r in mine:
                    r["to"] = f"{t}/{name}" if differs else f"{t}/~"
            for r in rs:
                r["t"] = r["to"]
        d += 1
    total = lambda rs: (sum(r["g"] for r in rs), sum(r["b"] for r in rs))
    g, b = total(rows)
    base = (g + 1) / (g + b + 2)
    out = []
    for r in rows:
        hg, hb = total([x for x in rows if x["host"] == r["host"]])
        tg, tb = total([x for x in rows if x["t"] == r["t"]])
        of_host = (hg + T.SMOOTHING * base) / (hg + hb + T.SMOOTHING)
        out.append("block" if (tg + T.SMOOTHING * of_host) / (tg + tb + T.SMOOTHING) < T.REJECT_BELOW else "allow")
    return out


def test_templates_equal_brute_force(spark):
    import random

    pick = random.Random(8)
    pages = []
    for _ in range(900):
        host = pick.choice(["a.net", "b.net", "c.net"])
        way = [pick.choice(["en", "de", "x"]) for _ in range(pick.randint(0, 3))]
        name = pick.choice(["news", "spam", "".join(pick.choice("qwertzuiop") for _ in range(5)), str(pick.randint(0, 99))])
        bad = name == "spam" or (host == "b.net" and "de" in way)
        label = None if pick.random() < 0.2 else int(not bad if pick.random() < 0.9 else bad)
        pages.append((f"http://{host}/" + "/".join([*way, name]), label))
    got = judged(spark, pages)
    assert [got[i] for i in range(len(pages))] == brute(pages) and set(got.values()) == {"allow", "block"}
