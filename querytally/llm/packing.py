"""Packing of examples into sequences as vector bin packing.

A sequence is limited in tokens, segments and loss-bearing tokens at the same
time. Sequences are filled one after another by the dot-product heuristic: of
the waiting pieces that fit every limit, the one whose demand, weighted by how
scarce each resource is, points most along what the sequence has left.

Documents are cut first: at every full sequence, and then once at half a
sequence, which leaves a rest below half. Such pieces pack with hardly any
padding, while a document keeps all its ids in order over few pieces. Pieces
are dealt to tasks by a hash and packed there in bounded blocks; whatever a
sequence holds comes from one task, so sequence numbers need no exchange.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .bpe import PATTERN, ByteBpe, text_groups
from .grams import worker_cache
from .names import free_name

MAX_TOKENS = 2048
MAX_SEGMENTS = 64
END_ID = 1
BLOCK = 4096  # pieces that wait in a task at once
TASK_PIECES = 50_000  # about so many pieces a task
_SEQUENCE_BITS = 33
# runs that take the pattern engine's stack, or one word's merges, too far
_LONG_RUN = regex.compile(r"\s{200}|\p{L}{400}|\p{N}{400}|[^\s\p{L}\p{N}]{400}")


def cut_points(n, size=MAX_TOKENS):
    """Lengths of the pieces of n tokens: full sequences, half a one, the rest."""
    lengths = [size] * (n // size)
    rest = n % size
    if rest > size // 2:
        lengths.append(size // 2)
        rest -= size // 2
    return [*lengths, rest] if rest else lengths


def pack_block(demands, limits, last):
    """Sequences of one block of waiting pieces.

    ``demands`` is pieces x resources, every row within ``limits``. Returns lists of row numbers,
    a sequence each, and the rows still waiting: unless this is the ``last``
    block, a sequence that no waiting piece fits is closed only if it is nearly
    full, and its pieces wait again otherwise.
    """
    scaled = demands / limits
    whole = (scaled >= 1).any(axis=1)
    done, open_again = [[int(i)] for i in np.flatnonzero(whole)], []
    weights = scaled.mean(axis=0)
    order = np.argsort(-(scaled @ weights), kind="stable")
    order = order[~whole[order]]
    scaled, places = scaled[order], order
    waiting = np.ones(len(order), bool)
    left = len(order)
    while left:
        room = np.ones(len(limits))
        chosen = []
        while left:
            fit = waiting & (scaled <= room + 1e-12).all(axis=1)
            at = np.flatnonzero(fit)
            if not len(at):
                break
            best = at[np.argmax(scaled[at] @ (weights * room))]
            chosen.append(best)
            waiting[best] = False
            left -= 1
            room = room - scaled[best]
        rows = [int(places[i]) for i in chosen]
        if last or room.min() <= 0.01:
            done.append(rows)
        else:
            open_again += rows
            if len(open_again) >= len(order) // 2:
                break
    return done, sorted([*open_again, *(int(places[i]) for i in np.flatnonzero(waiting))])


def pack(pieces: DataFrame, max_tokens=MAX_TOKENS, max_segments=MAX_SEGMENTS, max_loss=MAX_TOKENS, task_pieces=TASK_PIECES) -> DataFrame:
    """``pieces`` (key, start, length, loss and more) with sequence_id and offset.

    Pieces are numbered and written, so that a task run again sees the same rows, and dealt to
    tasks by their number: rows that share a key, or have none, or are the same, spread
    like others. A piece with more than a limit allows raises an error: cut it first. Pieces without
    tokens are packed like others and take a segment. An empty frame gives none.
    """
    number = free_name(pieces, "number")
    columns = pieces.columns
    pieces = written(pieces.withColumn(number, F.monotonically_increasing_id()))
    limits = np.array([max_tokens, max_segments, max_loss], float)

    def fill(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << _SEQUENCE_BITS
        table = None
        for batch in [*batches, None]:
            last = batch is None
            if not last:
                fresh = pa.Table.from_batches([batch])
                table = fresh if table is None else pa.concat_tables([table, fresh])
            while table is not None and len(table) and (last or len(table) >= BLOCK):
                # the rows of a block; beyond it only the next batch waits
                block, rest = table.slice(0, BLOCK).combine_chunks(), table.slice(BLOCK)
                final = last and not len(rest)
                demands = np.stack([block.column("length").to_numpy(), np.ones(len(block)), block.column("loss").to_numpy()], axis=1)
                if (demands > limits).any():
                    raise ValueError("a piece is larger than a sequence may be")
                done, waiting = pack_block(demands, limits, final)
                if not done:
                    done, waiting = pack_block(demands, limits, True)
                if done:
                    lengths = demands[:, 0].astype(np.int64)
                    rows = np.concatenate([np.array(s, np.int64) for s in done])
                    ids = np.concatenate([np.full(len(s), number + i, np.int64) for i, s in enumerate(done)])
                    offsets = np.concatenate([np.cumsum(lengths[s]) - lengths[s] for s in done])
                    number += len(done)
                    packed = block.take(pa.array(rows)).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
                    yield from packed.combine_chunks().to_batches()
                table = pa.concat_tables([block.take(pa.array(waiting, pa.int64())), rest]) if waiting else rest

    count = pieces.count()
    usual = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-count // task_pieces), min(usual, -(-count // BLOCK)))
    dealt = pieces.repartition(tasks, F.xxhash64(number)).sortWithinPartitions(*columns, number)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(fill, schema).drop(number)


class Encoder:
    """Ids of whole texts as the tokenizer file gives them, special strings in the texts included.

    The merges run in a second public engine, made from the same file; that is
    possible where the ids of a byte-level vocabulary follow its merges. Texts with a long run of
    white space, letters, digits or signs, which that engine's pattern cannot take, go through ``ByteBpe``.
    """

    def __init__(self, path):
        import tiktoken

        self._whole = whole = ByteBpe(path)  # also checks that the file is of this kind
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if not whole.ids_follow_merges():
            raise ValueError(f"{path}: token ids do not follow the merges")
        ranks = {b: i for i, b in enumerate(whole.bytes_of) if b and i not in added.values()}
        self._encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self._special = re.compile("|".join(map(re.escape, added))) if added else None

    @staticmethod
    def has_long_run(text):
        words = text.split()
        if len(text) - sum(map(len, words)) - len(words) < 150 and max(map(len, words), default=0) < 400:
            return False
        return _LONG_RUN.search(text) is not None

    def ids(self, text):
        if self.has_long_run(text):
            return np.frombuffer(self._whole.encode([text])[0], "<u4").tolist()
        if self._special is not None and self._special.search(text):
            found = self._encoding.encode(text, allowed_special="all")
        else:
            found = self._encoding.encode_ordinary(text)
        return found


def document_pieces(docs: DataFrame, tokenizer: str, text="text", key="doc_id", end_id=END_ID, size=MAX_TOKENS) -> DataFrame:
    """Pieces of every document's ids (the end id last): key, start, length, ids_crc32, doc_tokens, loss.

    All tokens of a document bear loss. A null text has the end id alone.
    """
    def run(batches):
        encoder = worker_cache(("packing", tokenizer), lambda: Encoder(tokenizer))
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                rows, start, length, crc, total = [], [], [], [], []
                for i, text in enumerate(texts):
                    ids = encoder.ids(text)
                    ids.append(end_id)
                    raw, at = np.array(ids, "<u4").tobytes(), 0
                    for n in cut_points(len(ids), size):
                        rows.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * at:4 * (at + n)]))
                        total.append(len(ids))
                        at += n
                n = pa.array(length, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)).take(pa.array(rows, pa.int64())),
                    pa.array(start, pa.int64()), n, pa.array(crc, pa.int64()), pa.array(total, pa.int64()), n,
                ], ["key", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, loss long"
    return rows.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, text="text", key="doc_id", end_id=END_ID, max_tokens=MAX_TOKENS,
                     max_segments=MAX_SEGMENTS) -> DataFrame:
    """One row per piece of every document, with its place in a sequence.

    Texts are encoded once and only numbers are written and shuffled. A null
    text is empty, a null key stays null, repeated rows are packed each for itself, an
    empty table gives no rows, other columns are not read.
    """
    pieces = document_pieces(docs, tokenizer, text, key, end_id, max_tokens)
    packed = pack(pieces, max_tokens, max_segments, max_tokens)
    return packed.drop("loss").withColumnRenamed("key", key)
