"""Near-duplicate documents: MinHash, banding, verification on full sets, components.

Equal shingle sets are one class from the start. Classes that share a band of
their signatures are candidates: first every class of a bucket against the
smallest one, which is linear in the bucket. The other members are compared by
short signatures in blocks of bounded size, which hand on the members, not the
pairs, that may link; what of these is not in one component after the first
links is compared on full sets, again in blocks, and only links that join two
components leave a task. So no pair is lost for a bucket's size, and no bucket
turns into all its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .components import components
from .grams import byte_slices, lowered, mix, seeded, shingles, word_hashes, words
from .names import free_name

HASHES = 168
MISSED = 1e-5  # probability that a pair at the threshold shares no band
SHINGLE = 5
THRESHOLD = 80  # percent
BLOCK = 1024  # classes of a bucket that a task compares with another block
BLOCK_SHINGLES = 4_000_000  # of the full sets of a block, about: 32 MB


def bands_for(percent, hashes=HASHES, missed=MISSED):
    """Bands and rows: as many rows as keep the probability of missing a pair within ``missed``."""
    fits = [r for r in range(1, hashes + 1) if (1 - (percent / 100) ** r) ** (hashes // r) <= missed]
    rows = max(fits, default=1)
    return hashes // rows, rows


def _sets(column, shingle):
    """Sorted distinct shingle hashes of each text; no words, an empty array."""
    for first, data, offsets in byte_slices(column):
        data = lowered(data)
        starts, ends, edges = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        yield first, [np.unique(shingles(hashes[a:b], shingle)) for a, b in zip(edges[:-1], edges[1:])]


def _signature(values, a, b):
    """Minimum of every hash function a * x + b modulo 2**32 over a set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i:i + 1024, None] * a + b).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, text="text", key="doc_id", shingle=SHINGLE, hashes=HASHES) -> DataFrame:
    """id, n_shingles, members (digest of the whole set) and signature per row; no shuffle."""
    a, b = seeded(1, hashes).astype(np.uint32) | np.uint32(1), seeded(2, hashes).astype(np.uint32)

    def run(batches):
        for batch in batches:
            for first, found in _sets(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(found)), pa.array([len(s) for s in found], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found], pa.binary()),
                    pa.array([_signature(s, a, b).tobytes() if len(s) else None for s in found], pa.binary()),
                ], ["id", "n_shingles", "members", "signature"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, members binary, signature binary")


def _full_sets(docs: DataFrame, ids: DataFrame, text, key, shingle) -> DataFrame:
    """id, members, hashes (sorted 64-bit shingle hashes) of the documents named in ``ids``."""
    def run(batches):
        for batch in batches:
            for first, found in _sets(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(found)),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()),
                    pa.array([s.tobytes() for s in found], pa.binary())], ["id", "members", "hashes"])

    # the ids grow with the data: one plan at any size, a merge join
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ids.hint("merge"), "id", "left_semi")
    return rows.mapInArrow(run, "id long, members binary, hashes binary")


def _band_keys(classes: DataFrame, bands, rows) -> DataFrame:
    """key, id: one row per class and band."""
    def run(batches):
        for batch in batches:
            ids, packed = batch.column(0), batch.column(1)
            for i in range(0, len(ids), 2000):
                sig = np.frombuffer(b"".join(packed.slice(i, 2000).to_pylist()), np.uint32).reshape(-1, HASHES)
                keys = _keys(sig, bands, rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.reshape(-1).view(np.int64)),
                    ids.slice(i, 2000).take(pa.array(np.repeat(np.arange(len(sig)), bands)))], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def _keys(signature, bands, rows):
    part = signature[:, :bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(seeded(3, bands), (len(signature), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return keys


def _links(a, b, percent):
    """True if two sorted sets have ``percent`` of their union in common."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _may_link(same, sizes_a, sizes_b, percent, hashes=HASHES):
    """False only for pairs that cannot link: by their sizes, or six deviations below in their signatures."""
    t = percent / 100
    low = t - 6 * np.sqrt(t * (1 - t) / hashes)
    return (same >= low * hashes) & (100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b))


def _near(pairs: DataFrame, classes: DataFrame, percent) -> DataFrame:
    """Those of ``pairs`` (u, v) whose signatures do not rule a link out."""
    def compare(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("su", "sv"))
            ok = _may_link((x == y).sum(axis=1), batch.column("nu").to_numpy(), batch.column("nv").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok))

    u = classes.select(F.col("id").alias("u"), F.col("n_shingles").alias("nu"), F.col("signature").alias("su"))
    v = classes.select(F.col("id").alias("v"), F.col("n_shingles").alias("nv"), F.col("signature").alias("sv"))
    return pairs.join(v, "v").join(u, "u").mapInArrow(compare, "u long, v long")


def _confirmed(near: DataFrame, sets: DataFrame, percent) -> DataFrame:
    """Those of ``near`` (u, v) that link by their full sets."""
    def verify(batches):
        for batch in batches:
            ok = [_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(batch.column("hu").to_pylist(), batch.column("hv").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    hu, hv = (sets.select(F.col("id").alias(n), F.col("hashes").alias("h" + n)) for n in "uv")
    return near.join(hv, "v").join(hu, "u").mapInArrow(verify, "u long, v long")


def _in_blocks(members: DataFrame, block) -> DataFrame:
    """``members`` (key, id, size and more) dealt so that any two of a key meet in one (key, first, second).

    A key of a ``size`` up to ``block`` is one group; a larger one is cut into
    blocks of about that size, and every pair of blocks is a group.
    """
    blocks = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("id", "key"), blocks)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).drop("own", "other", "size")


def _promising(buckets: DataFrame, classes: DataFrame, percent, block) -> DataFrame:
    """key, id of bucket members with a possible link to another member that is not the smallest.

    Judged by one byte of every signature value, chance agreement allowed for; a member is sent on once a bucket.
    """
    t = percent / 100
    low = t - 6 * np.sqrt(t * (1 - t) / HASHES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").reset_index(drop=True)
        sig = np.frombuffer(b"".join(pdf.bytes), np.uint8).reshape(-1, HASHES)
        sizes, alive = pdf.n_shingles.to_numpy(), np.zeros(len(pdf), bool)
        for i in range(len(pdf) - 1):
            near = (sig[i + 1:] == sig[i]).sum(axis=1) >= low * HASHES
            near &= 100 * np.minimum(sizes[i + 1:], sizes[i]) >= percent * np.maximum(sizes[i + 1:], sizes[i])
            if near.any():
                alive[i] = True
                alive[i + 1:] |= near
        return pdf.loc[alive, ["key", "id"]]

    def short(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).astype(np.uint8).reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "n_shingles", "bytes"])

    bytes_ = classes.select("id", "n_shingles", "signature").mapInArrow(short, "id long, n_shingles long, bytes binary")
    members = buckets.filter("size > 2 AND id <> hub").select("key", "id", (F.col("size") - 1).alias("size"))
    return _in_blocks(members.join(bytes_, "id"), block).groupBy("key", "first", "second").applyInPandas(run, "key long, id long").distinct()


def _common_counts(sets):
    """Sizes of all pairwise intersections of sorted sets, by products of blocks of their incidence matrix."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # the others are in no intersection
    number = np.cumsum(shared) - 1
    use = shared[place]
    owner, column = owner[use], number[place][use]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for begin in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        out += part @ part.T
    return out


def _block_links(percent):
    """Links between different components in a block, or two blocks, of a bucket; as few as join them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id").reset_index(drop=True)
        sets = [np.frombuffer(h, np.uint64) for h in pdf.hashes]
        sizes = np.array([len(s) for s in sets])
        common = _common_counts(sets).astype(np.int64)
        parent = {c: c for c in pdf.component}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        ids, component, out = pdf.id.tolist(), pdf.component.tolist(), []
        for i in range(len(ids)):
            linked = 100 * common[i, i + 1:] >= percent * (sizes[i] + sizes[i + 1:] - common[i, i + 1:])
            for j in (np.flatnonzero(linked) + i + 1).tolist():
                a, b = root(component[i]), root(component[j])
                if a != b:
                    parent[a] = b
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


def _rest_links(promising: DataFrame, labels: DataFrame, sets: DataFrame, percent, block) -> DataFrame:
    """Links inside buckets that the comparison with the smallest class left in several components.

    Blocks are bounded by members and by the shingles of their sets: blocks of long texts have fewer members.
    """
    sizes = sets.select("id", (F.octet_length("hashes") / 8).alias("shingles"))
    members = written(promising.join(labels, F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")).join(sizes, "id"))
    weight = F.greatest(F.count("id").cast("double"), F.sum("shingles") * (block / BLOCK_SHINGLES))
    mixed = written(members.groupBy("key").agg(weight.alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
                    .filter("lo <> hi").select(F.col("key").alias("k"), "size"))
    found = members.drop("shingles").join(mixed, F.col("key") == F.col("k")).drop("k")
    return written(_in_blocks(found.join(sets, "id"), block).groupBy("key", "first", "second").applyInPandas(_block_links(percent), "u long, v long"))


def near_duplicates(docs: DataFrame, text="text", key="doc_id", shingle=SHINGLE, percent=THRESHOLD, block=BLOCK) -> DataFrame:
    """``key``, n_shingles, component_id and kept of every row.

    Words are runs of non-space characters, A-Z lower-cased; a set holds the
    distinct runs of ``shingle`` words, or the whole sequence if it is shorter.
    Documents link with 100 * intersection >= ``percent`` * union.

    A null or empty text, or one without words, has no shingles and links with
    nothing. Rows that share a key are one document; if their texts differ, one
    of their sets links, and each row reports its own count. A row with a null key
    has no component and is kept. An empty table gives no rows; other columns are not read.
    """
    bands, rows = bands_for(percent)
    signed = written(signatures(docs, text, key, shingle))
    one = signed.filter("id IS NOT NULL AND members IS NOT NULL").groupBy("id").agg(F.max("members").alias("members"))
    first = written(one.groupBy("members").agg(F.min("id").alias("class")))
    member = written(one.join(first, "members").select("id", "class"))
    classes = written(signed.join(first.withColumnRenamed("class", "id"), ["id", "members"], "left_semi").dropDuplicates(["id"]))
    keys = written(_band_keys(classes, bands, rows))
    hubs = written(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("id").alias("size")).filter("size > 1").withColumnRenamed("key", "k"))
    buckets = written(keys.join(hubs, F.col("key") == F.col("k")).select("key", "hub", "size", "id"))
    stars = buckets.filter("hub <> id").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    near = written(_near(stars, classes, percent))
    promising = written(_promising(buckets, classes, percent, block))
    ids = near.select(F.explode(F.array("u", "v")).alias("id")).union(promising.select("id")).distinct()
    sets = written(_full_sets(docs, ids, text, key, shingle).join(classes.select("id", "members"), ["id", "members"], "left_semi").select("id", "hashes").dropDuplicates(["id"]))
    links = written(_confirmed(near, sets, percent))
    labels = written(components(links))
    rest = _rest_links(promising, labels, sets, percent, block)
    if not rest.isEmpty():
        labels = written(components(links.union(rest)))
    found = member.join(labels, F.col("class") == F.col("node"), "left").select(
        F.col("id").alias("__id"), F.coalesce("component", "class").alias("component_id"))
    found = signed.select("id", "n_shingles").join(written(found), F.col("id") == F.col("__id"), "left")
    return found.select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"))


def first_of_each_group(docs: DataFrame, text="text", key="doc_id", shingle=SHINGLE, percent=THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without the copies of another document; edge cases as in ``near_duplicates``.

    Columns may have any names.
    """
    name = free_name(docs, "gone")
    gone = written(near_duplicates(docs, text, key, shingle, percent).filter("NOT kept").select(F.col(key).alias(name)).distinct())
    return docs.join(gone, docs[key] == gone[name], "left_anti")
