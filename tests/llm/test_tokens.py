import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from querytally.llm.bpe import encode_documents, encoding_digests
from querytally.llm.queries import TOKENIZER, op5, op8
from querytally.llm.token_counts import token_counts

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a  b", "a \n b", "\n\n x", "tab\t x", " lead", "trail ", "trail  ", "don't  'll I'LL", "<|endoftext|>", "a<|endoftext|> b",
    "<|endoftext|<|endoftext|>>", "x" * 3000, "ab" * 2000, "日本語 テキスト  。", "é ́", "   x \x85y \x1cz  \x1c w", "🙂🙂 👍🏽", "1234567890123 abc123",
    "ſ ǅ ²½ Ⅷ ٣", "\x00\x01 \x7f", "!!!'s 'S", "word " * 50_000, "aaaa" * 17, "a'll've b'", "　 wide  space ",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1, b"x") for i, t in enumerate(ODD)] + [(None, "null id", "k", 2, b""), (3, "  ", "again", 3, b"")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens int, ids binary")


def digests(text):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_odd_texts_encode_as_the_library(odd):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoding_digests(odd, TOKENIZER).collect())
    rows = [*enumerate(ODD), (-1, "null id"), (3, "  ")]
    assert got == sorted((i, *digests(t)) for i, t in rows)


def test_documents_encode_as_the_library(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op5(spark, SF).collect()}
    assert got == {i: digests(t) for i, t in texts.items()}


def test_counts_as_the_library(spark, odd):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in op8(spark, SF).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    for r in token_counts(odd, TOKENIZER).collect():
        text = "null id" if r.doc_id is None else ODD[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False).ids))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, odd, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for r in token_counts(odd.filter("doc_id < 20"), path).collect():
        assert r.n_tokens == len(encode(ODD[r.doc_id] or ""))


def test_empty_table(odd):
    none = odd.filter("false")
    assert encode_documents(none, TOKENIZER).count() == token_counts(none, TOKENIZER).count() == 0
