from gleaner.llm.components import connected_components
from gleaner.llm.queries import URL_RULES
from gleaner.llm.url_filters import url_filters

SCHEMA = "page_id long, url string, html string, rule string"


def link(to):
    return f'<head><link href="{to}" rel="canonical"></head>'


def test_rules_and_aliases(spark):
    rows = [
        (1, "http://a.example.com/en/x?q", None),
        (2, "http://WWW.example.com/en/x", link("http://a.example.com/en/x?q")),
        (3, "https://x.org/a", link("/b")),
        (4, "https://x.org/b", "<META HTTP-EQUIV='refresh' content='0; url=https://q.net/es/1'>"),
        (5, "https://x.org/c", "<!-- " + link("https://q.net/es/1") + " -->"),
        (6, None, link("https://q.net/es/1")),
        (7, "no scheme", None),
        (8, "http://foo.com", None),
        (9, "http://net/fr/?a", None),
        (10, "https://x.org/a", None),
        (11, "http://notexample.com/en/", None),
    ]
    out = {r.page_id: r for r in url_filters(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), URL_RULES).collect()}
    assert len(out) == len(rows)
    got = {k: (r.host, r.path, r.rule, r.verdict) for k, r in out.items()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[3] == ("x.org", "/a", None, "block")
    assert got[4] == ("x.org", "/b", None, "block")
    assert got[5] == ("x.org", "/c", None, "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("foo.com", "", None, "allow")
    assert got[9] == ("net", "/fr/", "net/fr/", "block")
    assert got[10] == got[3]
    assert got[11] == ("notexample.com", "/en/", "com/", "allow")


def test_empty(spark):
    assert url_filters(spark.createDataFrame([], SCHEMA), URL_RULES).count() == 0


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 520)] + [(600, k) for k in range(700, 900)] + [(950, 950), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(up)}


def test_ties_and_very_long_urls(spark):
    rules = [("block", "a.org", "/x/"), ("allow", "a.org", "/x/"), ("block", "b.org", "/"), ("allow", "b.org", "/")]
    host = "q." * 200_000 + "b.org"
    rows = [(1, "http://a.org/x/1", None, ""), (2, f"http://{host}/" + "p" * 500_000, "<p>" * 200_000, ""), (2, f"http://{host}/", None, ""), (None, "http://b.org/", None, "")]
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in url_filters(spark.createDataFrame(rows, SCHEMA), rules).collect())
    assert got == [(0, "b.org/", "allow"), (1, "a.org/x/", "allow"), (2, "b.org/", "allow"), (2, "b.org/", "allow")]
