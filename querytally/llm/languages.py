"""Language identification as mixture inference.

A model holds, per language, the probabilities of hashed byte trigrams. For
every document expectation-maximisation estimates the shares of the languages
that make its trigrams most likely; the set of languages is the one with the
best likelihood after a penalty for each language in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .grams import byte_slices, trigrams

BITS = 14
TRAINING_ROWS = 100_000  # labelled rows a model is fitted on, chosen by a hash of their id
MAX_LANGUAGES = 512
CANDIDATES = 6  # best languages by themselves, with which a mixture begins; others enter as far as they may raise its likelihood
GAP = 0.01  # log likelihood that a language left out may add at most, by the slope of the mixture's
_CHUNK = 1 << 16  # distinct trigrams of documents side by side; a document has at most 2**BITS
ROUNDS = 15
PENALTY = 1.5  # times the log of the trigram count, for each further language: half (BIC), thrice as trigrams overlap
SMOOTHING = 0.1
UNKNOWN = "und"


def _folded():
    """Letters in lower case and all multi-byte characters; the rest is a space."""
    table = np.full(256, 0x20, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def _trigrams(texts):
    """Buckets of each text's trigrams; those of spaces only are left out."""
    return trigrams(texts, _folded(), BITS, skip=0x202020)


def _texts(column):
    for first, data, offsets in byte_slices(column):
        whole = data.tobytes()
        yield first, [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


@dataclass
class LanguageModel:
    names: list[str]
    probabilities: np.ndarray  # languages x buckets


def train(rows: DataFrame, max_rows=TRAINING_ROWS) -> LanguageModel:
    """A model from ``rows`` (doc_id, text, lang); rows without text or lang do not count.

    Fitted on about ``max_rows`` rows at most, taken by a hash of doc_id, so the
    counts that meet in the shuffle are bounded by languages x 2**BITS for each task of that sample.
    """
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    share = max_rows / max(1, rows.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches):
        counts = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, texts in _texts(batch.column(0)):
                buckets, edges = _trigrams(texts)
                for lang in set(langs[first:first + len(texts)]):
                    own = np.repeat(langs[first:first + len(texts)] == lang, np.diff(edges))
                    counts[lang] = counts.get(lang, 0) + np.bincount(buckets[own], minlength=1 << BITS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    sums = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(
        count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per_language = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).limit(MAX_LANGUAGES + 1).collect()
    if len(per_language) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: a model would not stay small")
    per_language.sort(key=lambda r: r.lang)
    table = np.full((len(per_language), 1 << BITS), SMOOTHING)
    for i, r in enumerate(per_language):
        table[i, [c.bucket for c in r.counts]] += [c.n for c in r.counts]
    return LanguageModel([r.lang for r in per_language], table / table.sum(axis=1, keepdims=True))


def _mixture(p, counts, edges, allowed, rounds):
    """EM over documents side by side: shares (documents x candidates) and log likelihoods.

    ``p`` is candidates x distinct trigrams; ``allowed`` masks candidates per document.
    """
    sizes = np.diff(edges)
    totals = np.add.reduceat(counts, edges[:-1])
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = np.zeros(p.shape[1])
        for k in range(p.shape[0]):
            weight += np.repeat(share[:, k], sizes) * p[k]
        ratio = counts / weight
        share = np.stack([share[:, k] * np.add.reduceat(p[k] * ratio, edges[:-1]) for k in range(p.shape[0])], axis=1) / totals[:, None]
    weight = np.zeros(p.shape[1])
    for k in range(p.shape[0]):
        weight += np.repeat(share[:, k], sizes) * p[k]
    return share, np.add.reduceat(counts * np.log(weight), edges[:-1])


def _part(edges, docs):
    """Positions of the trigrams of ``docs``, and their edges among themselves."""
    return np.concatenate([np.arange(edges[i], edges[i + 1]) for i in docs]), np.concatenate([[0], np.cumsum(np.diff(edges)[docs])])


def _rows(best, probabilities, buckets, edges):
    """Candidates x distinct trigrams: each document's own candidates, any row where it has none (-1)."""
    position = np.repeat(np.arange(len(best)), np.diff(edges))
    return np.stack([probabilities[best[position, j], buckets] for j in range(best.shape[1])])


def _entered(best, probabilities, counts, buckets, edges, rounds):
    """``best`` (documents x candidates) with the further languages that may raise a mixture's likelihood.

    The log likelihood is concave in the shares, so a language adds at most its slope at the mixture (the sum over
    trigrams of count x probability / weight) less the number of trigrams. Languages enter until none is left with
    more than GAP, at the latest when all learned ones are in.
    """
    open_ = np.arange(len(best))
    while len(open_) and best.shape[1] < len(probabilities):
        at, part = _part(edges, open_)
        own = best[open_]
        p = _rows(own, probabilities, buckets[at], part)
        share, _ = _mixture(p, counts[at], part, (own >= 0).astype(float), rounds)
        ratio = counts[at] / sum(np.repeat(share[:, j], np.diff(part)) * p[j] for j in range(len(p)))
        slope = np.stack([np.add.reduceat(ratio * row[buckets[at]], part[:-1]) for row in probabilities], axis=1)
        slope -= np.add.reduceat(counts[at], part[:-1])[:, None]
        doc, column = np.nonzero(own >= 0)
        slope[doc, own[doc, column]] = -np.inf
        new = np.argsort(-slope, axis=1, kind="stable")[:, :CANDIDATES]
        new = np.where(np.take_along_axis(slope, new, axis=1) > GAP, new, -1)
        more = np.full((len(best), new.shape[1]), -1)
        more[open_] = new
        best = np.concatenate([best, more], axis=1)
        best = np.take_along_axis(best, np.argsort(best < 0, axis=1, kind="stable"), axis=1)
        best = best[:, (best >= 0).any(axis=0)]
        open_ = open_[new[:, 0] >= 0]
    return best


def infer(texts, probabilities, candidates=CANDIDATES, penalty=PENALTY, rounds=ROUNDS):
    """Languages (row numbers of ``probabilities``, -1: none) and shares per text, each texts x as many as one text needs."""
    k = min(candidates, len(probabilities))
    chosen, shares = np.full((len(texts), k), -1), np.zeros((len(texts), k))
    buckets, edges = _trigrams(texts)
    filled = np.flatnonzero(np.diff(edges))
    if not k or not len(filled):
        return chosen, shares
    doc = np.repeat(np.arange(len(texts)), np.diff(edges))
    keys, counts = np.unique(doc << BITS | buckets, return_counts=True)
    counts = counts.astype(float)
    doc, buckets = keys >> BITS, keys & ((1 << BITS) - 1)
    edges = np.append(np.searchsorted(doc, filled), len(doc))
    logs = np.log(probabilities)
    # a mixture of few languages is small; with more, documents go in chunks, as any number may enter
    chunk = (edges[:-1] // _CHUNK) if k < len(probabilities) else np.zeros(len(filled), int)
    for c in np.unique(chunk):
        docs = np.flatnonzero(chunk == c)
        a, b = edges[docs[0]], edges[docs[-1] + 1]
        best, result = _best_sets(probabilities, logs, counts[a:b], buckets[a:b], edges[docs[0]:docs[-1] + 2] - a, k, penalty, rounds)
        if best.shape[1] > chosen.shape[1]:
            wider = ((0, 0), (0, best.shape[1] - chosen.shape[1]))
            chosen, shares = np.pad(chosen, wider, constant_values=-1), np.pad(shares, wider)
        order = np.argsort(-result, axis=1, kind="stable")
        found = np.take_along_axis(result, order, axis=1)
        shares[filled[docs], :best.shape[1]] = found
        chosen[filled[docs], :best.shape[1]] = np.where(found > 0, np.take_along_axis(best, order, axis=1), -1)
    return chosen, shares


def _best_sets(probabilities, logs, counts, buckets, edges, k, penalty, rounds):
    """Candidates and their shares in the best set, each documents x candidates."""
    n = len(edges) - 1
    totals = np.add.reduceat(counts, edges[:-1])
    alone = np.stack([np.add.reduceat(counts * row[buckets], edges[:-1]) for row in logs], axis=1)
    best = np.argsort(-alone, axis=1, kind="stable")[:, :k]
    score = alone[np.arange(n), best[:, 0]]
    best = _entered(best, probabilities, counts, buckets, edges, rounds)
    k = best.shape[1]
    price = penalty * np.log(totals + 1)
    p = _rows(best, probabilities, buckets, edges)
    full, top = _mixture(p, counts, edges, (best >= 0).astype(float), rounds)
    # a set of m languages scores its likelihood less m - 1 penalties; none beats the full mixture's likelihood
    result = np.zeros_like(full)
    result[:, 0] = 1
    by_share = np.argsort(-full, axis=1, kind="stable")
    for m in range(2, k + 1):
        open_ = np.flatnonzero((top - (m - 1) * price > score) & ((best >= 0).sum(axis=1) >= m))
        if not len(open_):
            break
        part, part_edges = _part(edges, open_)
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, by_share[open_, :m], 1, axis=1)
        share, likelihood = _mixture(p[:, part], counts[part], part_edges, allowed, rounds)
        better = likelihood - (m - 1) * price[open_] > score[open_]
        result[open_[better]] = share[better]
        score[open_[better]] = (likelihood - (m - 1) * price[open_])[better]
    return best, result


def _has_letter(text: bytes):
    return any(c.isalpha() for c in text.decode())


def identify(docs: DataFrame, model: LanguageModel, text="text", key="doc_id") -> DataFrame:
    """``key``, lang_pred, score and languages (name and share, largest first) of every row.

    lang_pred is the language with the largest share and score that share. A
    null text, a text without a letter, and every text if the model has no
    language: ``und``, score 0 and no languages. Equal texts get equal answers;
    a null key stays null, repeated rows are repeated, an empty frame gives
    none, other columns are not read. One pass, no shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.names, model.probabilities))  # at most MAX_LANGUAGES rows

    def run(batches):
        names, probabilities = shipped.value
        for batch in batches:
            for first, texts in _texts(batch.column(1)):
                chosen, shares = infer([t if _has_letter(t) else b"" for t in texts], probabilities)
                pred, score, sets = [], [], []
                for c, s in zip(chosen.tolist(), shares.tolist()):
                    found = [(names[i], x) for i, x in zip(c, s) if i >= 0]
                    pred.append(found[0][0] if found else UNKNOWN)
                    score.append(min(1.0, found[0][1]) if found else 0.0)
                    sets.append([{"lang": n, "share": x} for n, x in found])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                    pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["key", "lang_pred", "score", "languages"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def held_out(column="doc_id"):
    """The fold that training must not see: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Predictions for all documents by a model of those outside the held-out fold."""
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out()))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
