"""URL filters: host and path rules, and trust spread over the link graph.

Rules name a host with its subdomains and a path prefix; the longest that fits
decides. For the other pages their host decides: trust flows from hosts that
rules allow along the links (personalised PageRank), distrust flows from hosts
that rules block against the links (the same on reversed links), so a host that links to
blocked hosts takes on their distrust. What a host gets of either shrinks with the number of
hosts that share a link's end, so it is compared with what the host gets when
every host sends alike (unseeded PageRank, forward and reversed): ``exposed`` is the part
of the rank received against the links that started at blocked pages, ``endorsed`` the
part of that received along the links that started at allowed ones. A host is blocked where exposed
exceeds endorsed by more than a threshold, however many others link as it does.

Everything is joins and sums over hosts and host pairs; pages are reduced to
pairs with counts before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written

DAMPING = 0.85
STEPS = 30  # links that a walk follows at most; a longer one would count less than DAMPING ** STEPS (0.8 %) of its start
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a link with a host of its own; relative links stay on their host and say nothing about another
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]*)"""

# rules of the registered query: action, host, path prefix
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _rest(url) -> Column:
    url = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def with_host_and_path(pages: DataFrame, url="url") -> DataFrame:
    """``pages`` with host and path; both empty for a null url or one without ``://``."""
    rest = _rest(url)
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules as a frame: action (block or allow), domain, prefix."""
    return spark.createDataFrame(list(rules), "action string, domain string, prefix string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` (host) with the rules of the host and the domains above it, as an array.

    An equality join on every suffix of the host at a dot, so the rules may be many.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(suffixes).alias("domain")).join(rules, "domain")
    rule = F.concat("domain", "prefix")
    listed = fits.groupBy("host").agg(F.collect_list(F.struct(
        F.length(rule).alias("size"), (F.col("action") == "block").alias("block"), rule.alias("rule"), F.col("prefix").alias("prefix"))).alias("rules"))
    return hosts.join(listed, "host", "left")


def _winner() -> Column:
    """The longest rule whose prefix the path has; of equals block, then the later name."""
    return F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])))


def host_links(pages: DataFrame, html="html") -> DataFrame:
    """src, dst, n: pages of one host with a link to another."""
    target = F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER))))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), target.alias("dst"))
    return links.filter("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


NAMES = ("trust", "distrust", "rank", "back_rank")
_ALONG = ("trust", "rank")  # the others go against the links


def propagate(links: DataFrame, seeds: DataFrame, damping=DAMPING, steps=STEPS) -> DataFrame:
    """host, good, bad and what the host receives: trust, distrust, rank, back_rank.

    ``seeds`` has host, good and bad (shares from 0 to 1). Trust and distrust start from those shares, rank and back_rank
    from 1 at every host; trust and rank go along the links, the other two against them. All are sums over
    walks of one to ``steps`` links, without what the host starts with itself. Rounds end early where no
    walk goes on, as in a graph without circles; their number does not depend on the number of hosts.
    """
    none = [F.lit(0.0).alias(n) for n in NAMES]
    last = [f"last_{n}" for n in NAMES]  # what arrived in the round before
    start = [F.col("good").cast("double"), F.col("bad").cast("double"), F.lit(1.0), F.lit(1.0)]
    own = seeds.select("host", "good", "bad")
    if links.isEmpty():
        return own.select("*", *none)
    outgoing = links.groupBy("src").agg(F.sum("n").alias("out"))
    incoming = links.groupBy("dst").agg(F.sum("n").alias("into"))
    links = written(links.join(outgoing, "src").join(incoming, "dst").select(
        "src", "dst", (damping * F.col("n") / F.col("out")).alias("forward"), (damping * F.col("n") / F.col("into")).alias("back")))
    scores = seeds.select("host", *none, *(c.alias(n) for c, n in zip(start, last)))
    for step in range(1, steps + 1):
        sent = links.join(scores, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), *none, *((F.col(x) * F.col("forward") if n in _ALONG else F.lit(0.0)).alias(x) for n, x in zip(NAMES, last)))
        back = links.join(scores, F.col("dst") == F.col("host")).select(
            F.col("src").alias("host"), *none, *((F.lit(0.0) if n in _ALONG else F.col(x) * F.col("back")).alias(x) for n, x in zip(NAMES, last)))
        kept = scores.select("host", *NAMES, *(F.lit(0.0).alias(x) for x in last))
        sums = kept.union(sent).union(back).groupBy("host").agg(*(F.sum(n).alias(n) for n in (*NAMES, *last)))
        scores = sums.select("host", *((F.col(n) + F.col(x)).alias(n) for n, x in zip(NAMES, last)), *last)
        if step % 2 == 0 or step == steps:
            scores = written(scores)  # cuts the lineage
            if not scores.agg(F.max(F.greatest(*last))).first()[0]:
                break
    return own.join(scores.select("host", *NAMES), "host")


def _share(received, of) -> Column:
    return F.round(F.when(F.col(of) > 0, F.col(received) / F.col(of)).otherwise(0.0), 9)


def judge(pages: DataFrame, rules: DataFrame, url="url", html="html", key="page_id", damping=DAMPING, steps=STEPS, threshold=THRESHOLD) -> DataFrame:
    """``key``, host, path, rule, verdict, and the host's trust, distrust, endorsed and exposed, for every page.

    A seed's weight is the share of its pages that a rule allows or blocks; a
    host known from links alone is judged by its root path. Pages without a host
    (null url, no ``://``) have no rule and are allowed. A null html has no links, a null key
    stays null, repeated rows are repeated (and count as pages), an empty table gives no
    rows, and other columns are not read.
    """
    pages = with_host_and_path(pages.select(F.col(key).alias("key"), F.col(url).alias("u"), F.col(html).cast("string").alias("html")), "u")
    links = written(host_links(pages))
    # the path is needed only as far as it tells rules apart, so pages are counted by the rule they get
    known = pages.select("host").filter("host <> ''").distinct()
    linked = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct().join(known, "host", "left_anti")
    by_host = written(host_rules(known.union(linked), rules))
    placed = pages.drop("html", "u").join(by_host, "host", "left").withColumn("won", _winner()).drop("rules")
    share = [F.coalesce(F.avg(F.when(F.col("won.block") == b, 1.0).otherwise(0.0)), F.lit(0.0)).alias(n) for n, b in (("good", False), ("bad", True))]
    alone = linked.join(by_host, "host").withColumn("path", F.lit("/")).withColumn("won", _winner()).select("host", "won")
    seeds = written(placed.filter("host <> ''").select("host", "won").union(alone).groupBy("host").agg(*share))
    scores = written(propagate(links, seeds, damping, steps).select(
        "host", F.round(F.col("good") + F.col("trust"), 9).alias("trust"), F.round(F.col("bad") + F.col("distrust"), 9).alias("distrust"),
        _share("trust", "rank").alias("endorsed"), _share("distrust", "back_rank").alias("exposed")))
    blocked = F.coalesce(F.col("won.block"), F.round(F.col("exposed") - F.col("endorsed"), 9) > threshold, F.lit(False))
    return placed.join(scores, "host", "left").select(
        F.col("key").alias(key), "host", "path", F.col("won.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust", "endorsed", "exposed")))


def judged(spark, pages: DataFrame) -> DataFrame:
    return judge(pages, rule_table(spark, RULES))


def _oracle() -> str:
    """The same in DuckDB SQL: all walks step by step, then their sums."""
    values = ", ".join(f"('{a}', '{d}', '{p}')" for a, d, p in RULES)
    link = _LINK.replace("'", "''")
    fits = "(host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)"
    return rf"""
    WITH RECURSIVE rules(action, domain, prefix) AS (VALUES {values}),
    u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT row_number() OVER () AS r, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    l AS (SELECT DISTINCT r, host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p WHERE host <> ''),
    e AS (SELECT src, dst, count(*) AS n FROM l WHERE dst <> '' AND src <> dst GROUP BY src, dst),
    links AS MATERIALIZED (SELECT src, dst, {DAMPING} * n / sum(n) OVER (PARTITION BY src) AS forward, {DAMPING} * n / sum(n) OVER (PARTITION BY dst) AS back FROM e),
    cases AS (SELECT r, host, path FROM p UNION ALL SELECT -row_number() OVER (), host, '/' FROM
               (SELECT src AS host FROM e UNION SELECT dst FROM e) WHERE host NOT IN (SELECT host FROM p)),
    won AS (SELECT r, max({{'size': length(domain || prefix), 'block': action = 'block', 'rule': domain || prefix}}) AS w FROM cases, rules WHERE {fits} GROUP BY r),
    seeds AS MATERIALIZED (SELECT host, avg(CAST(coalesce(NOT w.block, false) AS INT)) AS good, avg(CAST(coalesce(w.block, false) AS INT)) AS bad
              FROM cases LEFT JOIN won USING (r) WHERE host <> '' GROUP BY host),
    walks AS (SELECT 0 AS step, host, good AS trust, bad AS distrust, 1.0::DOUBLE AS rank, 1.0::DOUBLE AS back_rank FROM seeds
      UNION ALL SELECT step + 1, CASE WHEN along THEN dst ELSE src END, sum(CASE WHEN along THEN trust * forward ELSE 0 END),
        sum(CASE WHEN along THEN 0 ELSE distrust * back END), sum(CASE WHEN along THEN rank * forward ELSE 0 END), sum(CASE WHEN along THEN 0 ELSE back_rank * back END)
      FROM walks, (SELECT *, unnest([true, false]) AS along FROM links) AS l
      WHERE host = CASE WHEN along THEN src ELSE dst END AND step < {STEPS} GROUP BY ALL),
    got AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust, sum(rank) AS rank, sum(back_rank) AS back_rank FROM walks WHERE step > 0 GROUP BY host),
    scores AS (SELECT host, round(good + coalesce(trust, 0), 9) AS trust, round(bad + coalesce(distrust, 0), 9) AS distrust,
      round(CASE WHEN rank > 0 THEN trust / rank ELSE 0 END, 9) AS endorsed, round(CASE WHEN back_rank > 0 THEN distrust / back_rank ELSE 0 END, 9) AS exposed
      FROM seeds LEFT JOIN got USING (host))
    SELECT page_id, host, path, w.rule AS rule,
      CASE WHEN coalesce(w.block, round(exposed - endorsed, 9) > {THRESHOLD}, false) THEN 'block' ELSE 'allow' END AS verdict,
      coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust, coalesce(endorsed, 0) AS endorsed, coalesce(exposed, 0) AS exposed
    FROM p LEFT JOIN won USING (r) LEFT JOIN scores USING (host)"""


ORACLE = _oracle()
