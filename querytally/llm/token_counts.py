"""Token counts: batch encoding in Arrow functions that hand back lengths only.

Texts are read in slices of about equal bytes. Where the tokenizer allows it, a
text is cut before every space that a visible character follows; a byte-level
pre-tokenizer never reaches across that place, so the counts of the pieces add
up to the count of the text, and no text, however long, is encoded as a whole.
Pieces not met before go to the tokenizer in batches of about equal bytes.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import text_groups
from .grams import worker_cache

BATCH_BYTES = 1_000_000
KNOWN_PIECES = 1_000_000  # counts kept by a worker; the dictionary starts anew beyond
_ODD_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")


def _balanced(texts, limit=BATCH_BYTES):
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _cuts_at_spaces(spec):
    """True if no rule of the tokenizer file reaches across a space before a visible character."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])))


class Counter:
    """Token counts of texts, for a tokenizers file (.json) or a sentencepiece file (.model)."""

    def __init__(self, path):
        self._known: dict[str, int] = {}
        self._piecewise = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                self._piecewise = _cuts_at_spaces(json.load(f))

    def _batches(self, texts):
        return [n for batch in _balanced(texts) for n in self._lengths(batch)]

    def counts(self, texts):
        if not self._piecewise:
            return self._batches(texts)
        if len(self._known) > KNOWN_PIECES:
            self._known = {}
        known, rows, lost = self._known, [], set()
        for text in texts:
            head, *rest = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
            found = list(map(known.get, rest))
            gap = None in found
            if gap:
                lost.update([p for p, n in zip(rest, found) if n is None])
            rows.append((head, rest, found, gap))
        lost = list(lost)
        known.update(zip(lost, self._batches([" " + p for p in lost])))
        heads = self._batches([row[0] for row in rows])
        return [n + sum(map(known.__getitem__, rest) if gap else found) for n, (_, rest, found, gap) in zip(heads, rows)]


def token_counts(docs: DataFrame, tokenizer: str, text="text", key="doc_id") -> DataFrame:
    """``key``, n_bytes (UTF-8) and n_tokens of every row; one pass, no shuffle.

    No begin, end or added special tokens; special strings inside a text count
    as the library takes them by default. A null text counts as empty (0, 0); a
    null key stays null, repeated rows give repeated rows, an empty frame gives
    none, and other columns are not read whatever their names.
    """
    def run(batches):
        counter = worker_cache(("counter", tokenizer), lambda: Counter(tokenizer))
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counter.counts(texts), pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
