from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from oracle import actual, actual_types, connect, expected, expected_types
from querytally.llm.link_graph import ORACLE, RULES, judge, judged, propagate, rule_table, with_host_and_path

SF = "/root/testdata/sf0.01"


def a(*targets):
    return " ".join(f'<a class=x HREF = "{t}">t</a>' for t in targets)


PAGES = [
    (1, "http://Good.example.ORG/fr/1?x#y", a("https://friend.example.com/a", "/fr/2", "//friend.example.com?q")),
    (2, "https://friend.example.com/en/", a("http://second.example.com")),
    (3, "http://farm.example.com/x", a("http://bad.NET/1", "http://worse.net/", "relative")),
    (4, "http://farm.example.com/y", a("https://bad.net/2")),
    (5, "http://lead.example.com", a("http://farm.example.com/x")),
    (6, "http://bad.net/", None), (7, "http://x.example.net/en/1", ""), (8, "http://x.example.net?en", "<a href='//x.example.net/'>"),
    (9, "http://example.com/de/", ""), (10, "http://notexample.com/de/", ""), (11, None, a("http://bad.net")), (12, "no scheme", ""),
    (13, "://", ""), (14, "file:///etc", ""), (15, "a://b://c/d", ""), (16, "http://H:80#/en/", ""), (None, "http://second.example.com/z", ""),
    (6, "http://bad.net/", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, host string, n int")


def brute(rows, damping=0.85, steps=30, threshold=0.5):
    """Host, path, rule and verdict by plain loops over the same links."""
    import re

    def split(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host):])[0]

    def rule(host, path):
        fits = [(len(d + p), act == "block", d + p) for act, d, p in RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        return max(fits, default=None)

    cut = [split(u) for _, u, _ in rows]
    links = Counter()
    for (host, _), (_, _, html) in zip(cut, rows):
        for dst in {m.lower() for m in re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]*)""", html or "")} - {host, ""}:
            links[host, dst] += host != ""
    links = {k: n for k, n in links.items() if n}
    seeds = defaultdict(list)
    for host, path in cut:
        if host:
            seeds[host].append(rule(host, path))
    for h in {h for pair in links for h in pair} - set(seeds):
        seeds[h] = [rule(h, "/")]
    good = {h: sum(r is not None and not r[1] for r in rs) / len(rs) for h, rs in seeds.items()}
    bad = {h: sum(r is not None and r[1] for r in rs) / len(rs) for h, rs in seeds.items()}
    out, into = Counter(), Counter()
    for (s, d), n in links.items():
        out[s] += n
        into[d] += n
    got = defaultdict(lambda: [0.0] * 4)
    wave = {h: [good[h], bad[h], 1.0, 1.0] for h in seeds}
    for _ in range(steps):
        after = defaultdict(lambda: [0.0] * 4)
        for (s, d), n in links.items():
            for k in (0, 2):
                after[d][k] += damping * n / out[s] * wave.get(s, [0.0] * 4)[k]
            for k in (1, 3):
                after[s][k] += damping * n / into[d] * wave.get(d, [0.0] * 4)[k]
        wave = after
        for h, w in wave.items():
            got[h] = [x + y for x, y in zip(got[h], w)]
    result = []
    for (i, _, _), (host, path) in zip(rows, cut):
        r = rule(host, path)
        t, b, p, q = got[host]
        blocked = r[1] if r else round((b / q if q else 0) - (t / p if p else 0), 9) > threshold
        result.append((i or -1, host, path, r[2] if r else None, "block" if blocked else "allow"))
    return sorted(result, key=str)


def test_pages_against_loops(spark, pages):
    got = sorted(((r.page_id or -1, r.host, r.path, r.rule, r.verdict) for r in judged(spark, pages).collect()), key=str)
    assert got == brute(PAGES)
    verdict = {i: v for i, *_, v in got}
    assert verdict[3] == "block" and verdict[5] == "block" and verdict[2] == "allow"  # links to blocked hosts, and to a host that does so twice


def test_many_rules_and_ties(spark, pages):
    rules = rule_table(spark, [*RULES, ("allow", "example.com", "/de/"), ("block", "com", "/"), *(("allow", f"h{i}.test", "/") for i in range(500))])
    got = {r.page_id: r for r in judge(pages, rules).collect()}
    assert (got[9].rule, got[9].verdict, got[2].rule) == ("example.com/de/", "block", "com/")


def test_empty_and_split(spark, pages):
    assert judged(spark, pages.filter("false")).count() == 0
    assert judge(pages, rule_table(spark, RULES).filter("false")).filter("rule IS NOT NULL OR verdict = 'block'").count() == 0
    got = with_host_and_path(spark.createDataFrame([("x://É.A/p?q",)], "url string")).first()
    assert (got.host, got.path) == ("É.a", "/p")


def test_against_sql(spark, pages):
    con = connect(SF)
    df = entry.queries()["op3_link_graph"](spark, SF)
    assert actual(df) == expected(con, ORACLE) and actual_types(df) == expected_types(con, ORACLE)
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert actual(judged(spark, pages)) == expected(con, ORACLE)


def linked_pages(linkers):
    """Hosts that link to a blocked one only, half, at one remove, and with a host that vouches for them."""
    rows = [(f"http://farm{i}.test/", a("http://bad.net/")) for i in range(linkers)]
    rows += [(f"http://half{i}.test/", a("http://bad.net/", "http://plain.test/")) for i in range(linkers)]
    rows += [(f"http://lead{i}.test/", a(f"http://farm{i}.test/")) for i in range(linkers)]
    rows += [(f"http://known{i}.test/", a("http://bad.net/")) for i in range(linkers)]
    rows += [(f"http://hub{i}.test/", a("http://bad.net/", *(f"http://site{i}x{j}.test/" for j in range(20)))) for i in range(min(linkers, 10))]
    rows += [("http://good.org/fr/", a(*(f"http://known{i}.test/" for i in range(linkers))))]
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("linkers", [1, 2, 10, 1000])
def test_verdicts_do_not_hang_on_the_number_of_linkers(spark, linkers):
    """Every host that links to a blocked one only is blocked; one with as many neutral links is not, nor one that is vouched for."""
    import duckdb

    rows = linked_pages(linkers)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = judged(spark, frame)
    kind = Counter((r.host.split(".")[0].rstrip("0123456789"), r.verdict) for r in got.collect())
    assert kind == {
        ("farm", "block"): linkers, ("half", "allow"): linkers, ("lead", "allow"): linkers, ("known", "allow"): linkers,
        ("hub", "allow"): min(linkers, 10), ("good", "allow"): 1}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.register("made", frame.toPandas())
    con.execute("INSERT INTO pages SELECT * FROM made")
    assert actual(got) == expected(con, ORACLE)


def test_random_links_against_sql(spark):
    """Circles, repeated links and hosts that rules name in part."""
    import random

    import duckdb

    pick = random.Random(2)
    hosts = [f"h{i}.test" for i in range(20)] + ["bad.net", "x.bad.net", "example.com", "good.org", "example.net"]
    rows = [(i, f"http://{pick.choice(hosts)}/{pick.choice(['de', 'fr', 'en', 'x'])}/{i}",
             a(*(f"http://{h}/" for h in pick.choices(hosts, k=pick.randrange(5))))) for i in range(1, 121)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert actual(judged(spark, frame)) == expected(con, ORACLE)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged(spark, frame).collect()) == sorted(brute(rows), key=lambda r: r[0])


def test_scores_reach_the_end_of_a_long_chain(spark):
    """Twenty hosts in a row: the last has what the first sends, and the other way round."""
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(20)], "src string, dst string, n long")
    seeds = spark.createDataFrame([(f"h{i}", float(i == 0), float(i == 20)) for i in range(21)], "host string, good double, bad double")
    by = {r.host: r for r in propagate(links, seeds).collect()}
    assert by["h20"].trust == pytest.approx(0.85**20) and by["h0"].distrust == pytest.approx(0.85**20)
    assert by["h1"].rank == pytest.approx(0.85) and by["h0"].rank == 0 and by["h20"].rank == pytest.approx(sum(0.85**i for i in range(1, 21)))
    assert by["h20"].back_rank == 0 and by["h20"].bad == 1 and by["h20"].distrust == 0
