import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querytally.llm.packing import cut_points, pack, packed_documents
from querytally.llm.queries import TOKENIZER, op2
from querytally.session import written

SF = "/root/testdata/sf0.01"


def check(rows, texts, limit=2048, segments=64):
    """Every id lies in one piece, crc and lengths are right, sequences are gapless and within the limits."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at:at + p.length])
            assert p.length > 0 and (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(raw))
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit and len(pieces) <= segments
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding / sum(p.length for p in rows)


def test_documents(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert check(op2(spark, SF).collect(), texts) < 0.01


def test_odd_documents(spark):
    texts = {1: None, 2: "", 3: "a<|endoftext|> b", 4: "word " * 20_000, 5: "x" * 5000, None: "null id"}
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts.items()], "doc_id long, text string, length int, sequence_id string")
    check(packed_documents(docs, TOKENIZER).collect(), texts)
    twice = packed_documents(docs.filter("doc_id = 3").union(docs.filter("doc_id = 3")), TOKENIZER).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    assert packed_documents(docs.filter("false"), TOKENIZER).count() == 0


def test_all_limits_hold(spark):
    """Instruction examples: a few loss-bearing tokens each, many short segments."""
    rows = spark.range(3000).select(
        F.col("id").alias("key"), F.lit(0).cast("long").alias("start"), (1 + F.col("id") * 37 % 400).alias("length"),
        (F.col("id") * 37 % 400 % 97).alias("loss"))
    packed = pack(written(rows.repartition(3)), max_tokens=512, max_segments=4, max_loss=150)
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("key").alias("s"), F.sum("loss").alias("l"))
    assert sums.filter("t > 512 OR s > 4 OR l > 150").count() == 0
    assert packed.count() == 3000 and packed.select("key").distinct().count() == 3000
    least = max(rows.agg(F.sum("length")).first()[0] / 512, 3000 / 4, rows.agg(F.sum("loss")).first()[0] / 150)
    assert sums.count() < 1.25 * least
    with pytest.raises(Exception, match="larger than a sequence"):
        pack(written(rows), max_tokens=100).count()


def test_repeatable(spark):
    pieces = written(spark.range(500).selectExpr("id AS key", "0L AS start", "1 + id % 90 AS length", "1L AS loss"))
    one, two = (sorted(map(tuple, pack(pieces.repartition(n), max_tokens=100).collect())) for n in (1, 5))
    assert one == two


def test_long_runs(spark):
    """Texts that are one run of blanks, line feeds, letters, digits or signs."""
    n = 1_000_000
    texts = {
        1: "a" + " " * n + "b", 2: "\n" * n, 3: "x" * n, 4: "a" + " " * 5 * n + " b", 5: "7" * 100_000, 6: "=" * n, 7: " \n" * 300_000 + "é",
        8: "\t" * 150 + "a " * 1000 + " " * 200, 9: "word<|endoftext|>" + "\u3000" * 5000 + "b", 10: "漢字" * 5000, 11: "aB3/" * 100_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packed_documents(docs.repartition(8), TOKENIZER).collect(), texts)


def test_rows_of_one_key_spread(spark):
    """Rows without a key, and repeated rows, are dealt like others."""
    pieces = spark.range(0, 40_000, 1, 1).selectExpr("CAST(NULL AS long) AS key", "0L AS start", "100L AS length", "100L AS loss")
    packed = pack(pieces, task_pieces=5000).groupBy(F.shiftright("sequence_id", 33).alias("task")).count()
    sizes = [r["count"] for r in packed.collect()]
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) < 6000


def test_cuts():
    assert cut_points(1) == [1] and cut_points(2048) == [2048] and cut_points(1024) == [1024]
    assert cut_points(5000) == [2048, 2048, 904] and cut_points(3500) == [2048, 1024, 428]
