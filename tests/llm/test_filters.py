"""URL verdicts and chats against plain definitions."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from seriesmill.llm import chat, url_filter
from seriesmill.llm.queries import QUERIES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(x.lower() if x.isascii() else x for x in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def ruled(host, path):
    fits = [(h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def combinations_of(labelled, least, confidence, most=4):
    """Token sets in `least` bad rows with enough of their rows bad, by counting all of them."""
    every, bad = Counter(), Counter()
    for tokens, is_bad in labelled:
        for n in range(1, most + 1):
            for c in itertools.combinations(sorted(tokens), n):
                every[c] += 1
                bad[c] += is_bad
    return {c for c in bad if bad[c] >= least and bad[c] >= confidence * every[c]}


def test_rules_on_all_pages(spark, sf_dir, rows_of):
    found = {r.page_id: r for r in QUERIES["op1_url_filter"](spark, sf_dir).collect()}
    pages = rows_of("select page_id, url from pages")
    assert len(found) == len(pages)
    for page_id, url in pages:
        host, path = parts(url)
        rule, verdict = ruled(host, path)
        r = found[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")


URLS = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1", "http://a.example.com/en/", "http://example.com/en", "http://example.com?x=/en/", "x://Ä.NET/es/é#f",
        "http://net/fr/", "http://anet/fr/", "http://a.net/fr/?q", "a://b://c", "://com/", "http://example.org/en/", "http://\n.net/es/", "http://com"]


def test_rules_on_odd_urls(frame):
    rows = [(i, u, "block", "h") for i, u in enumerate(URLS)] + [(None, URLS[3], "", ""), (3, URLS[3], "", "")]
    nothing = frame([], "page_id long, bad boolean")
    found = url_filter.url_verdicts(frame(rows, "page_id long, url string, verdict string, host string"), nothing).collect()
    expected = [(i, *parts(u), ruled(*parts(u))[0], ruled(*parts(u))[1] or "allow") for i, u, _, _ in rows]
    assert sorted(map(str, expected)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in found)
    assert url_filter.url_verdicts(frame([], "page_id long, url string"), nothing).collect() == []


def test_mined_rules_equal_counting(spark, frame):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        host = rng.choice(["spam", "shop", "news"]) + "." + rng.choice(["one", "two"]) + ".org"
        url = f"https://{host}/{rng.choice(['ad', 'de', ''])}/{i}" + rng.choice(["", "?ref=1", "#x"])
        rows.append((i, url, ("spam" in host and "/ad/" in url) or rng.random() < 0.1))
    pages = frame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = frame([(i, b) for i, _, b in rows if i < 400] + [(0, None)], "page_id long, bad boolean")
    found = {r.page_id: r for r in url_filter.url_verdicts(pages, labels, rules=()).collect()}
    urls = pages.withColumn("host", url_filter.host_of(pages.url)).withColumn("path", url_filter.path_of(pages.url))
    tokens = {r[0]: set(r[1]) for r in urls.select("page_id", url_filter.tokens_of(urls.url, urls.host, urls.path)).collect()}
    rules = combinations_of([(tokens[i], b) for i, _, b in rows if i < 400], url_filter.MIN_ROWS, url_filter.MIN_CONFIDENCE)
    assert any("path:ad" in c and "host:spam" in c for c in rules)
    for i, _, _ in rows:
        fits = [c for c in rules if set(c) <= tokens[i]]
        assert (found[i].verdict == "block") == bool(fits)
        if fits:
            assert set(found[i].mined_rule.split()) in [set(c) for c in fits]


def test_rules_of_urls_with_many_tokens(frame):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        host = "spam" if i % 13 == 0 else "plain"
        query = "utm_source=1&utm_medium=2&utm_campaign=3" if rng.random() < 0.5 else "id=1"
        url = f"https://www.{host}.com/a/b/c/d/e/f/g/x.html?{query}"
        rows.append((i, url, host == "spam" or i % 4 == 0))
    # one of the tokens that are always together among labelled URLs is enough
    rows += [(260, "http://spam.net/", None), (261, "https://www.plain.com/a/b/c/d/e/f/g/x.html?id=1", None)]
    pages = frame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = frame([(i, b) for i, _, b in rows if b is not None], "page_id long, bad boolean")
    found = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, labels, rules=()).collect()}
    assert {i for i, v in found.items() if v == "block"} == {i for i, u, _ in rows if "spam" in u}


def maximal(rows):
    """conv_id -> (turns, copies, chat) by comparing whole conversations."""
    logs = defaultdict(set)
    for conv, turn, role, text in rows:
        logs[conv].add((-(1 << 62) if turn is None else turn, role, text))
    low = lambda x: (x is not None, x or "")
    logs = {c: sorted(v, key=lambda t: (t[0], low(t[1]), low(t[2]))) for c, v in logs.items()}
    by_turn = {}
    for c, v in logs.items():
        by_turn[c] = [frozenset(g) for _, g in itertools.groupby(v, key=lambda t: t[0])]
    starts = {tuple(b[:n]) for b in by_turn.values() for n in range(1, len(b))}
    same = defaultdict(list)
    for c, b in by_turn.items():
        if tuple(b) not in starts:
            same[tuple(b)].append(c)
    out = {}
    for group in same.values():
        first = min(group, key=lambda c: (c is None, c or 0))
        text = "".join(f"<|im_start|>{role or ''}\n{t or ''}<|im_end|>\n" for _, role, t in logs[first])
        out[first] = (len(logs[first]), len(group), text)
    return out


def test_all_conversations(spark, sf_dir, rows_of):
    rows = rows_of("select conv_id, turn, role, text from conversations")
    found = {r.conv_id: (r.n_turns, r.copies, r.chat) for r in QUERIES["op6_chat_snapshots"](spark, sf_dir).collect()}
    assert found == maximal(rows)


def snapshots():
    rows = []
    for conv, n in ((1, 3), (2, 5), (3, 5), (4, 1), (5, 200), (6, 130)):
        name = "long" if conv > 4 else "short"
        rows += [(conv, t, "user" if t % 2 else "assistant", f"{name} {t}") for t in range(n)]
    rows += [(7, 0, "user", "short 0"), (7, 0, "user", "other"), (8, 0, None, None), (9, 0, "", ""), (9, 1, "user", ""), (10, None, "user", "x"), (10, 0, "user", "y")]
    rows += [(None, 0, "a", "b"), (None, 1, "a", "b"), (11, 0, "a", "b"), (2, 1, "user", "short 1"), (12, -70, "a", "z"), (12, 70, "a", "z"), (13, -70, "a", "z")]
    return rows


def test_odd_conversations(frame):
    rows = snapshots()
    table = frame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, block int, h1 int")
    found = {r.conv_id: (r.n_turns, r.copies, r.chat) for r in chat.chats(table).collect()}
    assert found == maximal(rows)
    assert set(found) == {2, 5, 7, 8, 9, 10, None, 12}
    assert chat.chats(frame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_chat_snapshots"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
