"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed base rules reject short and repetitive texts. Beyond them every rule
compares a ratio of counts with a cutoff, and the cutoffs are chosen per
stratum from labelled documents: rejecting a good document of a stratum is
allowed with a limited probability only; documents of one text are one trial, and a cutoff counts as safe if the
exact one-sided binomial (Clopper-Pearson) bound of its false rejection rate
stays within that limit. Cutoffs of one rule are nested, so they are tested from
the mildest on and the last safe one is taken (fixed sequence: no correction
within a rule); the error level is shared over all strata and rules (Bonferroni),
and the allowed risk over the rules (union bound). A stratum with too few labelled
good documents gets no cutoff and loses none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .names import free_prefix

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BROADCAST_STRATA = 10_000  # a row of cutoffs is a few dozen bytes


@dataclass(frozen=True)
class Rule:
    """Rejects where 1000 * ``part`` > cutoff * ``whole``; cutoffs from mild to strict."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", (1000, 500, 200, 100, 50)),
    Rule("capitals", "n_capitals", "word_chars", (500, 400, 300, 250, 200, 150, 120, 100)),
    Rule("lines", "n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 400, 300)),
    Rule("repeats", "n_repeat_words", "n_words", (450, 400, 350, 300, 250, 200)),
)
RISK = 0.02  # of rejecting a good document that passes the base rules, all rules together
ERROR = 0.05  # probability that any stratum exceeds it


def _repeat_words(words: str) -> str:
    """Words inside three-word windows that occur more than once."""
    return f"""
      aggregate(transform({words}, (p, j) -> least(3, coalesce(get({words}, j + 1) - p, 3))), 0L, (a, x) -> a + x)"""


def measured(docs: DataFrame, text="text", to="q") -> DataFrame:
    """``docs`` with a struct column ``to`` of the counts, every original column kept; none may begin with ``to``.

    Words are runs of anything but the six ASCII white-space characters. A null
    text counts as empty. Window hashes are 64 bits wide; only texts in which two
    of them agree are sorted to find the places.
    """
    t, w, h, d = (f"{to}_{x}" for x in ("text", "words", "hashes", "pairs"))
    return (
        docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
        .withColumn(w, F.array_remove(F.split(t, SPACE), ""))
        .withColumn(h, F.expr(f"""
            CASE WHEN size({w}) < 3 THEN array()
                 ELSE transform(sequence(0, size({w}) - 3), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))) END"""))
        .withColumn(d, F.expr(f"""
            CASE WHEN size(array_distinct({h})) = size({h}) THEN array()
                 ELSE sort_array(transform({h}, (x, i) -> struct(x AS h, i AS i))) END"""))
        .withColumn(d, F.expr(f"""
            sort_array(transform(filter({d}, (x, j) -> x.h <=> get({d}, j - 1).h OR x.h <=> get({d}, j + 1).h), x -> x.i))"""))
        .withColumn(f"{to}_lines", F.expr(rf"filter(split({t}, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"))
        .withColumn(to, F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            F.expr(f"CAST(size({to}_lines) - size(array_distinct({to}_lines)) AS LONG)").alias("n_dup_lines"),
            F.expr(_repeat_words(d)).alias("n_repeat_words"),
            F.expr(f"CAST(size({to}_lines) AS LONG)").alias("n_lines"),
            (F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        ))
        .withColumn(to, F.struct(f"{to}.*", (
            (F.col(f"{to}.n_words") < MIN_WORDS)
            | (100 * F.col(f"{to}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{to}.n_words"))).alias("base_failed")))
        .drop(t, w, h, d, f"{to}_lines"))


def _exceeds(rule: Rule, cutoff, counts="") -> Column:
    return 1000 * F.col(counts + rule.part) > cutoff * F.col(counts + rule.whole)


def _good(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say quality 1; rows without id or quality do not count."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("m")).filter("q = 1 AND m = 1").select("doc_id")


def _safe(n: str, x: str, risk: float, level: str) -> str:
    """Upper Clopper-Pearson bound of x in n within ``risk``: the binomial tail up to x is at most ``level``.

    Terms are added from their logarithms; x beyond the mean is never safe, so
    the sum has at most n * risk terms.
    """
    odds = f"ln({risk}D) - ln(1 - {risk}D)"
    return f"""
      CASE WHEN {n} = 0 OR {x} > {n} * {risk}D THEN false ELSE
        aggregate(sequence(0L, {x}), struct({n} * ln(1 - {risk}D) AS term, 0D AS total),
          (s, i) -> struct(s.term + CASE WHEN i < {n} THEN ln(CAST({n} - i AS DOUBLE)) - ln(CAST(i + 1 AS DOUBLE)) + {odds} ELSE 0D END AS term,
                           s.total + exp(s.term) AS total),
          s -> s.total) <= {level} END"""


def thresholds(counts: DataFrame, labels: DataFrame, rules=RULES, risk=RISK, error=ERROR) -> DataFrame:
    """One row per stratum with the chosen cutoff of each rule; no safe cutoff: null.

    ``counts`` is a written table with doc_id, stratum, base_failed, the rules' columns and, unless no text
    recurs, a digest of the text. One
    join on doc_id and aggregations that add up in the tasks first, so a
    stratum or a text that holds most rows arrives as one row per task.
    """
    good = counts.filter("NOT base_failed AND doc_id IS NOT NULL").join(_good(labels), "doc_id", "left_semi")
    if "digest" in good.columns:
        good = good.dropDuplicates(["stratum", "digest"])  # copies are no independent trials
    sums = [
        F.sum(_exceeds(rule, c).cast("long")).alias(f"x_{rule.name}_{c}") for rule in rules for c in rule.cutoffs]
    held = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    strata = held.agg(F.count(F.lit(1)).alias("strata"))
    held = held.join(F.broadcast(strata))  # one row
    level = f"({error}D / (strata * {len(rules)}))"
    safe = [
        F.expr(_safe("n", f"x_{rule.name}_{c}", risk / len(rules), level)).alias(f"s_{rule.name}_{c}")
        for rule in rules for c in rule.cutoffs]
    held = held.select("stratum", *safe)
    return held.select("stratum", *[_last_safe(rule) for rule in rules])


def _last_safe(rule: Rule) -> Column:
    """The last cutoff before the first unsafe one."""
    states = F.array(*[F.struct(F.col(f"s_{rule.name}_{c}").alias("safe"), F.lit(c).alias("cut")) for c in rule.cutoffs])
    chosen = F.aggregate(
        states, F.struct(F.lit(True).alias("open"), F.lit(None).cast("int").alias("cut")),
        lambda s, x: F.struct((s["open"] & x["safe"]).alias("open"), F.when(s["open"] & x["safe"], x["cut"]).otherwise(s["cut"]).alias("cut")))
    return chosen["cut"].alias(f"cut_{rule.name}")


def _with_cutoffs(rows: DataFrame, stratum: str, cutoffs: DataFrame, to: str) -> DataFrame:
    """``rows`` with their stratum's cutoffs as a struct ``{to}_cuts``."""
    few = cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    cutoffs = cutoffs.select(F.col("stratum").alias(f"{to}_stratum"), F.struct(*[c for c in cutoffs.columns if c != "stratum"]).alias(f"{to}_cuts"))
    same = F.col(stratum).cast("string").eqNullSafe(F.col(f"{to}_stratum"))
    return rows.join(F.broadcast(cutoffs) if few else cutoffs, same, "left").drop(f"{to}_stratum")


def _rejected(rules, to, counts="") -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(_exceeds(rule, F.col(f"{to}_cuts.cut_{rule.name}"), counts), F.lit(False))
    return out


def _counts(counted: DataFrame, text: str, stratum: str, to: str) -> DataFrame:
    """doc_id, stratum, digest and the counts of measured rows."""
    digest = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return counted.select("doc_id", F.col(stratum).cast("string").alias("stratum"), digest.alias("digest"), f"{to}.*")


def quality_verdicts(docs: DataFrame, labels: DataFrame, text="text", stratum="lang", rules=RULES, risk=RISK, error=ERROR) -> DataFrame:
    """Counts, base_failed and kept of every row of ``docs``.

    Texts are read once: their counts are written to the shared folder, the
    cutoffs are found from them and then applied to them. A null text is empty
    (and fails the base rules), a null stratum is a stratum of its own, a null
    doc_id carries no label; repeated rows are judged alike; an empty table gives
    an empty result; columns other than doc_id, text and stratum are not read.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"), F.col(stratum).alias("stratum"))
    counts = written(_counts(measured(rows, "text", "q"), "text", "stratum", "q"))
    cutoffs = written(thresholds(counts, labels, rules, risk, error))
    return _with_cutoffs(counts, "stratum", cutoffs, "q").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~_rejected(rules, "q")).alias("kept"), "stratum", "n_lines", "n_capitals")


def good_documents(docs: DataFrame, labels: DataFrame, text="text", stratum="lang", rules=RULES, risk=RISK, error=ERROR) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Texts are measured once and written with their counts, and stay where they are:
    only labelled counts are shuffled. Columns may have any names. Edge cases as in
    ``quality_verdicts``.
    """
    to = free_prefix(docs, "q")
    counted = written(measured(docs, text, to), compression="zstd")  # a copy of the texts
    cutoffs = written(thresholds(_counts(counted, text, stratum, to), labels, rules, risk, error))
    kept = ~F.col(f"{to}.base_failed") & ~_rejected(rules, to, f"{to}.")
    return _with_cutoffs(counted, stratum, cutoffs, to).filter(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def _oracle(rules=RULES, risk=RISK, error=ERROR, stratum="lang") -> str:
    """The same in DuckDB SQL, with words and texts compared as strings and the tail from gamma functions."""
    each = risk / len(rules)

    def safe(x):
        return f"""(n > 0 AND {x} <= n * {each} AND list_sum(list_transform(range(0, CAST({x} AS BIGINT) + 1), lambda i:
            exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({each}) + (n - i) * ln(1 - {each})))) <= {error} / (strata * {len(rules)}))"""

    sums, cuts, tests = [], [], []
    for r in rules:
        sums += [f"sum(CAST(1000 * {r.part} > {c} * {r.whole} AS BIGINT)) AS x_{r.name}_{c}" for c in r.cutoffs]
        cut, passed = "NULL", []
        for c in r.cutoffs:
            passed.append(f"s_{r.name}_{c}")
            cut = f"CASE WHEN {' AND '.join(passed)} THEN {c} ELSE {cut} END"
        tests += [f"{safe(f'x_{r.name}_{c}')} AS s_{r.name}_{c}" for c in r.cutoffs]
        cuts.append(f"{cut} AS cut_{r.name}")
    rejected = " OR ".join(f"coalesce(1000 * {r.part} > cut_{r.name} * {r.whole}, false)" for r in rules)
    word = r"[^\x20\x09-\x0D]"
    return rf"""
    WITH d AS (SELECT doc_id, {stratum} AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM documents),
    g AS (SELECT row_number() OVER () AS r, * FROM d),
    win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM g)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    f AS (SELECT doc_id, stratum, t, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            CAST(len(l) AS BIGINT) AS n_lines, CAST(len(t) - len(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals
          FROM g LEFT JOIN rep USING (r)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
    good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
    o AS (SELECT DISTINCT ON (stratum, t) * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
    h AS (SELECT stratum, count(*) AS n, {', '.join(sums)} FROM o GROUP BY stratum),
    s AS (SELECT stratum, {', '.join(tests)} FROM h, (SELECT count(*) AS strata FROM h)),
    c AS (SELECT stratum, {', '.join(cuts)} FROM s)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT ({rejected}) AS kept, b.stratum, n_lines, n_capitals FROM b LEFT JOIN c ON b.stratum IS NOT DISTINCT FROM c.stratum"""


WIDE_RISK = 0.1  # of the run over one stratum
ORACLE = _oracle()
ONE_STRATUM_ORACLE = _oracle(risk=WIDE_RISK, stratum="'all'")
