"""URL verdicts and line dedup against slow versions."""

import random
import time

import pytest

from copse.llm import line_dedup, urls


def slow_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    after = rest[end:]
    stop = min([after.find(c) for c in "?#" if c in after], default=len(after))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), after[:stop]


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.net/x", "http://badnet/", "http://x.example.net/en/1?q#f", "http://example.net/en", "http://example.net?en/",
    "https://example.com/de/", "https://example.com/DE/", "https://É.Example.com/de/a?b", "http://a.org/fr/", "http://org/fr/", "http://a.org/en/", "a://b://net/", "http://u.net#/en/", "://net/", "http://x.com/\n?a",
]


def test_rules(spark):
    rows = [(i, u, "<p>", "x", "y") for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string"), spellings=True).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        best = slow_rule(host, path)
        assert (got[i].host, got[i].path) == (host, path)
        if best is None:  # "http://net" is another spelling of "http://NET/", which a rule blocks
            ruled = {slow_rule(*split(v))[1] for j, v in enumerate(URLS) if got[i].alias_class and got[j].alias_class == got[i].alias_class and slow_rule(*split(v))}
            best = (None, "block" if ruled == {"block"} else "allow")
            assert (u == "http://net") == (ruled != set())
        assert (got[i].rule, got[i].verdict) == best


def test_aliases_take_decisions_with_allow_first(spark):
    link = '<head><link href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://plain.io/a", link.format("http://b.net/z")),  # alias of a blocked page
        (2, "http://b.net/z", None),
        (3, "https://www.plain.io/a/?utm_source=x#top", ""),  # another spelling of 1
        (4, "http://c.io/1", '<META http-equiv="Refresh" content="0; url=http://plain.io/a">'),
        (5, "http://d.io/1", link.format("http://b.net/y")),
        (6, "http://d.io/1", link.format("http://a.org/fr/1")),  # the class also holds an allowed page
        (7, "http://a.org/fr/1", ""),
        (8, "http://b.net/y", ""),
        (9, "http://e.io/go?to=http%3A%2F%2Fb.net%2Fz", ""),
        (10, "http://f.io/", link.format("/other")),
        (10, "http://f.io/", link.format("/other")),
        (None, None, None),
    ]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), spellings=True).collect()
    verdicts = {r.page_id: r.verdict for r in got}
    assert len(got) == len(rows)
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "allow", None: "allow"}
    assert len({r.alias_class for r in got if r.page_id in (1, 2, 3, 4, 9)}) == 1
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_links_of_every_form(spark):
    link, page = '<link rel="canonical" href="{}">', "http://p.io/d/{}"
    cases = {
        "outside": (link.format("http://example.com/de/x"), "block"),
        "relative": (link.format("b"), "block"),
        "up": (link.format("../d/./b#x"), "block"),
        "root": ("<link href='/d/b' rel=canonical>", "block"),
        "scheme": (link.format("//q.net/"), "block"),
        "second": (link.format("/free") + link.format("http://bad.net/2"), "block"),
        "entity": (link.format("http://p.io/ask?a=1&amp;b=2"), "block"),
        "refresh": ('<meta content="5;URL=http://bad.net/9" http-equiv=refresh>', "block"),
        "comment": ("<!-- " + link.format("http://bad.net/") + " -->", "allow"),
        "mail": (link.format("mailto:a@bad.net"), "allow"),
        "other": ('<link rel="stylesheet" href="http://bad.net/"><a href="http://bad.net/">canonical</a>', "allow"),
        "allowed": (link.format("http://bad.net/1") + link.format("http://a.org/fr/"), "allow"),
        "self": (link.format("http://P.io/d/self#top"), "allow"),
        "long": ("<p>canonical " * 50_000 + link.format("http://long.net/"), "block"),
        "empty": (link.format(""), "allow"),
    }
    rows = [(name, page.format(name), html) for name, (html, _) in cases.items()]
    rows += [("b", page.format("b"), link.format("http://x.net/")), ("ask", "http://p.io/ask?a=1&b=2", link.format("http://y.net/")), ("query", "http://p.io/go?url=http://bad.net/x", None)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {n: v for n, (_, v) in cases.items()} | {"b": "block", "ask": "block", "query": "block"}


def test_classes_equal_union_find(spark):
    rng = random.Random(5)
    hosts = [*(f"h{i}.io" for i in range(60)), "bad.net", "x.org", "example.net"]
    name = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'en', 'a'])}/{rng.randrange(8)}"
    rows = [(i, name(), "".join(f'<link rel="canonical" href="{name()}">' for _ in range(rng.choice([0, 0, 1, 1, 2])))) for i in range(300)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, url, html in rows:
        root(url)
        for to in html.split('href="')[1:]:
            parent[root(to.split('"')[0])] = root(url)
    classes = {}
    for node in list(parent):
        classes.setdefault(root(node), set()).add((slow_rule(*split(node)) or (None, None))[1])
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    outside = {n for n in parent} - {u for _, u, _ in rows}
    assert outside and len(got) == len(rows)
    seen = {}
    for r in got:
        url = rows[r.page_id][1]
        rule = slow_rule(*split(url))
        decided = classes[root(url)]
        assert (r.rule, r.verdict) == (rule or (None, "block" if "block" in decided and "allow" not in decided else "allow"))
        assert seen.setdefault(r.alias_class, root(url)) == root(url)
    assert len(seen) == len({root(u) for _, u, _ in rows})


def slow_lines(rows, ratio, least):
    pages = {}
    for _, text, host in rows:
        pages.setdefault(host, []).append(text)
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        kept = []
        for line in text.split("\n"):
            n = sum(line in (t or "").split("\n") for t in pages[host] if t is not None)
            if line.strip(" ") == "" or n < least or n <= ratio * len(pages[host]):
                kept.append(line)
        out.append((i, "\n".join(kept), text.count("\n") + 1 - len(kept)))
    return out


@pytest.mark.parametrize("keys", [0, line_dedup.BROADCAST_KEYS])
def test_line_dedup_equals_brute_force(spark, monkeypatch, keys):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", keys)
    rng = random.Random(2)
    lines = ["footer", "nav", "", "  ", "Footer", "été", *(f"own {i}" for i in range(60))]
    weights = [20, 10, 8, 3, 4, 4] + [1] * 60
    rows = [(i, "\n".join(rng.choices(lines, weights, k=rng.randint(1, 6))), rng.choice(["a", "a", "a", "b", None])) for i in range(150)]
    rows += [(200, None, "a"), (201, "", "b"), (None, "footer\nmine", "a"), (7, *rows[7][1:]), (300, "alone", "solo")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, n_lines int, lines string")
    got = line_dedup.drop_boilerplate(df)
    assert got.columns == ["doc_id", "text", "source", "lines", "n_lines", "n_dropped"]
    key = lambda x: (str(x[0]), str(x[1]), x[2])
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got.collect()), key=key) == sorted(slow_lines(rows, 0.1, 3), key=key)
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_keep_whole(spark):
    rows = [(i, "same\ncopy", "a") for i in range(5)] + [(9, "same\nown", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df, keep_whole=True).collect()}
    assert got == {**{i: "same\ncopy" for i in range(5)}, 9: "own"}


def test_long_and_broken_html_is_linear(spark):
    """No page crashes a task or takes quadratic time, whatever its tags hold."""
    target = "http://bad.net/"
    pages = {
        "many words": ('<link rel="' + "a " * 100_000 + f'canonical" href="{target}">', "block"),
        "many other words": ('<link rel="' + "a " * 100_000 + f'canonicals" href="{target}">', "allow"),
        "canonical among others": (f"<LINK data-x='1' REL=' next\n Canonical nofollow' HREF = ' {target} '>", "block"),
        "bare values": (f"<link rel=canonical href={target}>", "block"),
        "open links": ("<link " * 20_000 + 'rel="canonical ', "allow"),
        "open metas": ("<meta " * 20_000 + 'http-equiv="refresh ', "allow"),
        "open comments": ("<!-- canonical" * 20_000, "allow"),
        "white space": ('<link rel="canonical"' + " " * 1_000_000 + f'href="{target}">', "block"),
        "open value": ('<link rel="canonical" href="' + "x" * 1_000_000, "allow"),
        "no end": (f'<link rel="canonical" href="{target}"', "block"),
        "refresh": (f'<meta content="5; URL=\'{target}\'" http-equiv=\'Refresh\'>', "block"),
        "many urls": ('<meta http-equiv="refresh" content="' + "url " * 200_000 + f'url={target}">', "block"),
        "no refresh": (f'<meta http-equiv="refresher" content="0; url={target}">', "allow"),
    }
    for name, (html, want) in pages.items():
        df = spark.createDataFrame([(1, f"http://{name.replace(' ', '-')}.io/", html)], "page_id long, url string, html string")
        began = time.monotonic()
        assert urls.judge(df).first().verdict == want, name
        assert time.monotonic() - began < 15, name  # a few seconds of which are Spark's own
