import hashlib

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as E
from helpers import TRICKY, odd_documents
from tessera.llm import bpe_reuse
from tessera.llm.units import UnitEncoder, first_break, last_break, load_tokenizer, split_units, tokenizer_blob

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bent = [t.replace(" ", c, 5) for t, c in zip(docs[:20], ["  ", "\n", " \n", " ", "", "　 ", "᠎", "\t ", "\x1c", "'s "] * 2)]
    return [t for t in TRICKY if t is not None] + docs + bent + ["".join(docs[0].split())[:20000]]


@pytest.mark.parametrize("file", FILES)
def test_chunk_encoding_equals_whole_text_encoding(spark, file):
    blob = tokenizer_blob(public_tokenizers.path(file))
    tok = load_tokenizer(blob)
    encode = bpe_reuse.ChunkEncoder(UnitEncoder(blob), bpe_reuse.part_separator(blob), store_chars=40_000)
    for _ in range(2):          # the second time with a warm store
        for t in texts(spark):
            want = tok.encode(t, add_special_tokens=False).ids
            ids, decoded = encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == want, t[:200]
            assert decoded == tok.decode(want, skip_special_tokens=False), t[:200]
    assert encode.reused > 0


@pytest.mark.parametrize("file", FILES)
def test_units_encode_alone(spark, file):
    blob = tokenizer_blob(public_tokenizers.path(file))
    units, tok = UnitEncoder(blob), load_tokenizer(blob)
    pieces = sorted({p for t in texts(spark) for p in split_units(t)[1:]})
    for p, ids in zip(pieces, units.many(pieces)):
        assert ids.tolist() == tok.encode(" " + p, add_special_tokens=False).ids, p


def test_cuts_are_content_defined():
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh "), 20000))
    one, two = "x" * 777 + shared, "some other start " * 100 + shared
    def chunks(t):
        ends = bpe_reuse.cut_points(t)
        return {t[i:j] for i, j in zip([0, *ends], ends)}
    both = chunks(one) & chunks(two)
    assert sum(map(len, both)) > 0.7 * len(shared)
    assert "".join(t for t in [one[i:j] for i, j in zip([0, *bpe_reuse.cut_points(one)], bpe_reuse.cut_points(one))]) == one


def test_breaks():
    assert first_break("ab cd ef") == 2 and last_break("ab cd ef") == 5
    assert first_break("ab  cd") == -1 and last_break(" a\n b ") == -1
    assert split_units("a  b c") == ["a  b", "c"]


def test_query_counts(spark, odd):
    tok = load_tokenizer(tokenizer_blob(public_tokenizers.path("byte_bpe_50k.json")))
    want = sorted((str(d["doc_id"]), len((d["text"] or "").encode()), len(tok.encode(d["text"] or "", add_special_tokens=False).ids))
                  for d in odd_documents())
    rows = E.queries()["op8_token_counts"](spark, odd).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


def test_query_digests(spark, odd):
    tok = load_tokenizer(tokenizer_blob(public_tokenizers.path("word_bpe_49k.json")))

    def answer(d):
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids
        return (str(d["doc_id"]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    rows = E.queries()["op5_bpe_reuse"](spark, odd).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(
        map(answer, odd_documents()))


def test_counts_with_a_nul_inside_a_frequent_piece(spark):
    from tessera.llm.token_counts import token_counts

    blob = tokenizer_blob(public_tokenizers.path("byte_bpe_50k.json"))
    tok = load_tokenizer(blob)
    texts = ["first nul\x00inside nul\x00inside unforgettable a internationalisation a b", "x internationalisation unforgettable \x00 b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, blob).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
