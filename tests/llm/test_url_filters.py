import re

import duckdb
import pandas as pd

from stemma.llm import queries, url_filters

PAGES = [
    (1, "http://A.B.org/x?q#f", '<a href="http://bad.com/1">x</a><a href=//GOOD.net>y</a>'),
    (2, "https://b.org", None),
    (3, "http://example.org/es/1", ""),
    (4, "http://www.example.org/en/12", None),
    (5, "http://notexample.org/es/", "<a href='http://www.example.org'>"),
    (6, "http://x.com/de/", "<a href = 'https://spam.net/'>"),
    (7, "http://x.com/de/2", None),
    (8, "http://x.com/en/2", None),
    (9, "http://y.net/1", '<a href="http://x.com/de/1"><a href="http://x.com/de/1"><a href="http://y.net/2">'),
    (10, None, '<a href="http://x.com">'),
    (11, "mailto:a@b.org", None),
    (12, "", "x"),
    (13, "://?x://y", None),
    (None, "http://com/fr/", None),
    (9, "http://y.net/1", None),
    (14, "http://h.com:80#a/fr/\nb", None),
    (15, "http://ÄÖ.ORG/Ä\n?", None),
    (16, "http://a.com.org.de/es/", None),
]


def _brute(pages):
    host_of, rows = {}, []
    for i, (k, url, html) in enumerate(pages):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rows.append((k, host, path, max(fit, key=lambda r: (len(r.name), r.name), default=None)))
        host_of[i] = host
    seeds = {"t": {}, "d": {}}
    for _, host, _, rule in rows:
        if rule and host:
            kind = "t" if rule.action == "allow" else "d"
            seeds[kind][host] = seeds[kind].get(host, 0) + 1
    links = {}
    for i, (_, _, html) in enumerate(pages):
        for target in set(re.findall(url_filters.LINK, html or "")):
            if host_of[i] and target.lower() != host_of[i]:
                links[host_of[i], target.lower()] = links.get((host_of[i], target.lower()), 0) + 1
    score = {}
    for kind in "td":
        edge = links if kind == "t" else {(b, a): n for (a, b), n in links.items()}
        total = {}
        for (a, _), n in edge.items():
            total[a] = total.get(a, 0) + n
        now = dict(seeds[kind])
        for _ in range(url_filters.ROUNDS):
            after = dict(seeds[kind])
            for (a, b), n in edge.items():
                after[b] = after.get(b, 0) + 0.85 * now.get(a, 0) * n / total[a]
            now = after
        score[kind] = now
    out = []
    for k, host, path, rule in rows:
        t, d = score["t"].get(host, 0), score["d"].get(host, 0)
        method = "block" if d and round(d / (t + d), 6) > 0.75 else "allow"
        out.append((k, host, path, rule and rule.name, rule.action if rule else method))
    return out


def _key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_equals_brute_force_and_sql(spark):
    df = spark.createDataFrame([(*p, "h", "r") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    got = url_filters.judge(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    want = _brute(PAGES)
    assert _key(got) == _key(want)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"])
    pages["page_id"] = pages["page_id"].astype("Int64")
    con = duckdb.connect()
    con.register("pages", pages)
    assert _key(con.sql(url_filters.judge_sql(queries.URL_RULES)).fetchall()) == _key(want)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge(df, queries.URL_RULES).count() == 0


def _chain(hops, copies):
    """Pages of n0.net to n<hops>.net, each linking to the one before it; n0.net links to a blocked host."""
    pages = [("http://bad.com/de/1", None), ("http://n0.net/", "<a href='http://bad.com/'>")]
    pages += [(f"http://n{i}.net/", f"<a href='http://n{i - 1}.net/'>") for i in range(1, hops + 1)]
    return [(i, *p) for i, p in enumerate(pages * copies)]


def test_distrust_goes_all_the_way_at_any_size(spark):
    got = []
    for copies in (1, 2):
        df = spark.createDataFrame(_chain(12, copies), "page_id long, url string, html string")
        got.append({r.host: (r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in url_filters.judge(df, queries.URL_RULES).collect()})
    assert got[0] == got[1]
    assert got[0] == {"bad.com": ("block", 0, 1)} | {f"n{i}.net": ("block", 0, round(0.85 ** (i + 1), 9)) for i in range(13)}


def test_propagation_goes_on_to_its_tolerance(spark):
    seeds = spark.createDataFrame([("a", 1000, 0), ("b", 0, 3000)], "host string, trusted long, blocked long")
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "source string, target string, n long")
    got = {r.host: (r.trust, r.distrust) for r in url_filters.propagate(seeds, links, tolerance=0.05).collect()}
    near, far = 1 / (1 - 0.85**2), 0.85 / (1 - 0.85**2)
    want = {"a": (near / 4, far * 3 / 4), "b": (far / 4, near * 3 / 4)}
    assert all(0 <= w - g <= 0.05 / 0.15 for h in want for w, g in zip(want[h], got[h], strict=True))


def test_sql_goes_as_far_as_the_operator(spark):
    rows = _chain(12, 1) + [(100, "http://long." + "x" * 300 + ".net/", "<a href        =            'http://n12.net/'>")]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES)
    assert _key(con.sql(url_filters.judge_sql(queries.URL_RULES)).fetchall()) == _key(got.select("page_id", "host", "path", "rule", "verdict").collect())
    assert all(r.verdict == "block" for r in got.collect())


def test_of_equally_long_rules_the_greater_name_wins(spark):
    rules = [url_filters.Rule("block", "b.org", "/x/"), url_filters.Rule("allow", "org", "/x/yy")]
    assert len({len(r.name) for r in rules}) == 1
    (r,) = url_filters.judge(spark.createDataFrame([(1, "http://b.org/x/yyz", None)], "page_id long, url string, html string"), rules).collect()
    assert (r.rule, r.verdict) == ("org/x/yy", "allow")
