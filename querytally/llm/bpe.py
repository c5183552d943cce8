"""Byte-level BPE encoding and decoding over contiguous rank arrays.

Words of one byte length are worked on together: a row holds the ids of a
word's parts and, beside them, the merge ranks of adjacent parts. Each round
scans every row for its smallest rank (the leftmost of equals), replaces the
two parts by their merge, deletes the boundary between them and looks up the
ranks of the two neighbouring pairs again. Long words would make the scan
quadratic and go through a heap with the same order of merges instead.

A text is cut before every space that a visible character follows: no rule of
the pre-tokenizer reaches across that place. The pieces recur, so a bounded
dictionary per Python worker keeps their ids.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .grams import byte_slices, worker_cache

# The split before the merges, as the vocabulary's README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KNOWN_PIECES = 1_000_000  # entries kept by a worker; the dictionary starts anew beyond
LONG_PIECE = 200  # characters; longer pieces hardly recur and are not kept
SHORT_WORD = 64
TEXT_BYTES = 4_000_000  # of texts that are encoded together
_NONE = np.iinfo(np.int64).max
_ODD_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")


def _byte_characters():
    """The printable stand-in of every byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class ByteBpe:
    """Vocabulary, merges and added tokens of a tokenizer file (byte-level BPE, no normalizer)."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" \
                or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError(f"{path}: added tokens that take in white space cannot be told apart piece by piece")
        characters = _byte_characters()
        byte_of = {c: b for b, c in characters.items()}
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[characters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ranked: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            ranked.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self._merged = np.zeros(len(pairs), np.int64)
        for rank, merged in ranked.values():
            self._merged[rank] = merged
        self._rank_of = {key: rank for key, (rank, _) in ranked.items()}
        self._fill(self._rank_of)
        self._split = regex.compile(PATTERN)
        self._added = {t["content"]: t["id"] for t in added}
        self._added_split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        self.bytes_of = [b""] * (max([*vocab.values(), *self._added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self._added.items():
            self.bytes_of[i] = token.encode()
        self._pieces: dict[str, bytes] = {}  # ids of a piece and the space before it

    def ids_follow_merges(self):
        return sorted(self.first.tolist()) == list(range(256)) and bool((self._merged == 256 + np.arange(len(self._merged))).all())

    def _fill(self, rank_of):
        """A table with one place a hash value; pairs that find theirs taken are kept sorted."""
        self._shift = np.uint64(64 - max(16, (8 * len(rank_of)).bit_length()))
        size = 1 << (64 - int(self._shift))
        keys = np.array(list(rank_of), np.int64)
        ranks = np.array(list(rank_of.values()), np.int64)
        place = self._place(keys)
        self._keys, self._ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        self._keys[place], self._ranks[place] = keys, ranks
        lost = self._keys[place] != keys
        order = np.argsort(keys[lost])
        self._rest_keys, self._rest_ranks = np.append(keys[lost][order], _NONE), np.append(ranks[lost][order], _NONE)
        self._shared = np.zeros(size, bool)
        self._shared[place[lost]] = True

    def _place(self, key):
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _look_up(self, left, right):
        """Merge ranks of adjacent parts; no merge: the largest number."""
        key = left << 32 | right
        place = self._place(key)
        ranks = np.where(self._keys[place] == key, self._ranks[place], _NONE)
        again = self._shared[place] & (ranks == _NONE)
        if again.any():
            rest = key[again]
            at = np.searchsorted(self._rest_keys, rest)
            ranks[again] = np.where(self._rest_keys[at] == rest, self._rest_ranks[at], _NONE)
        return ranks

    def _same_length(self, rows):
        """Ids of the words in a matrix of bytes, one word a row."""
        ids = self.first[rows]
        found = [b""] * len(rows)
        alive = np.arange(len(rows))
        ranks = self._look_up(ids[:, :-1], ids[:, 1:])
        while True:
            width = ids.shape[1]
            row = np.arange(len(ids))
            low = ranks.argmin(axis=1) if width > 1 else np.zeros(len(ids), np.int64)
            least = ranks[row, low] if width > 1 else np.full(len(ids), _NONE)
            done = least == _NONE
            if done.any():
                flat = ids[done].astype("<u4").tobytes()
                for n, i in enumerate(alive[done].tolist()):
                    found[i] = flat[4 * width * n:4 * width * (n + 1)]
                more = ~done
                alive, ids, ranks, low, least = alive[more], ids[more], ranks[more], low[more], least[more]
                row = np.arange(len(ids))
            if not len(alive):
                return found
            ids[row, low] = self._merged[least]
            keep = np.arange(width) != (low + 1)[:, None]
            ids = ids[keep].reshape(len(row), width - 1)
            keep = np.arange(width - 1) != low[:, None]  # the rank of the merged pair goes
            ranks = ranks[keep].reshape(len(row), width - 2)
            right = np.flatnonzero(low < width - 2)
            at = low[right]
            ranks[right, at] = self._look_up(ids[right, at], ids[right, at + 1])
            left = np.flatnonzero(low > 0)
            at = low[left]
            ranks[left, at - 1] = self._look_up(ids[left, at - 1], ids[left, at])

    def _long(self, word):
        """The same merges for one long word, through a heap and links between parts."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(self._look_up(ids[:-1], ids[1:]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        ids, merged, rank_of = ids.tolist(), self._merged, self._rank_of
        ids.append(0)  # behind the last part, where ``after`` ends

        def push(i):
            rank = rank_of.get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
            if rank is not None:
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = int(merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids[:n] if x >= 0], "<u4").tobytes()

    def _words(self, words):
        """Ids of distinct words, given as bytes."""
        out, by_length = {}, {}
        for w in words:
            if len(w) > SHORT_WORD:
                out[w] = self._long(w)
            else:
                by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            for i in range(0, len(group), 20_000):
                part = group[i:i + 20_000]
                out.update(zip(part, self._same_length(np.frombuffer(b"".join(part), np.uint8).reshape(-1, n))))
        return out

    def _split_words(self, piece):
        """Words and added tokens of a piece."""
        if piece[1:].isalpha() and piece[0] == " " or piece.isalpha():
            return [piece.encode()]
        out = []
        for text in self._added_split.split(piece) if self._added_split else [piece]:
            out += [text] if text in self._added else [w.encode() for w in self._split.findall(text)]
        return out

    def _learn(self, pieces):
        """Ids of each piece."""
        parts = [self._split_words(p) for p in pieces]
        distinct = {w for whole in parts for w in whole if isinstance(w, bytes)}
        known = self._words(distinct)
        known.update((t, np.array([i], "<u4").tobytes()) for t, i in self._added.items())
        return [known[w[0]] if len(w) == 1 else b"".join([known[x] for x in w]) for w in parts]

    def encode(self, texts):
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self._pieces) > KNOWN_PIECES:
            self._pieces = {}
        known, rows, lost = self._pieces, [], set()
        for text in texts:
            head, *rest = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
            ids = list(map(known.get, rest))
            gap = None in ids
            if gap:
                lost.update([p for p, i in zip(rest, ids) if i is None])
            rows.append((head, rest, ids, gap))
        lost = list(lost)
        fresh = dict(zip(lost, self._learn([" " + p for p in lost])))
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONG_PIECE)
        heads = self._learn([row[0] for row in rows])
        return [
            first + b"".join([i or fresh[p] for p, i in zip(rest, ids)] if gap else ids)
            for first, (_, rest, ids, gap) in zip(heads, rows)]

    def decode(self, ids):
        """The text of ids given as by encode; added tokens stay in it."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def bpe(path) -> ByteBpe:
    return worker_cache(("bpe", path), lambda: ByteBpe(path))


def text_groups(column):
    """Lists of texts of about equal bytes; null texts are empty."""
    for first, data, offsets in byte_slices(column, TEXT_BYTES):
        whole = data.tobytes()
        yield first, [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def encode_documents(docs: DataFrame, tokenizer: str, text="text", key="doc_id") -> DataFrame:
    """``key``, ids (binary, little-endian unsigned 32-bit), n_tokens and the decoded text per row.

    One pass without a shuffle. A null text counts as empty and has no ids; a
    null key stays null; repeated rows give repeated rows; other columns,
    whatever their names, are not read. The tokenizer's path must be readable on the executors.
    """
    def run(batches):
        coder = bpe(tokenizer)
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                ids = coder.encode(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)), pa.array(ids, pa.binary()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([coder.decode(x) for x in ids], pa.string()),
                ], ["key", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids binary, n_tokens long, decoded string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def encoding_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return encode_documents(docs, tokenizer).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
