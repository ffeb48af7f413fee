import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheetlark.llm import bpe
from sheetlark.llm.queries import tokenizer_path

PATH = tokenizer_path()
TEXTS = [
    "", None, "hello world", "  two  spaces\n\n newline \t tab ", "a<|endoftext|>b <|endoftext|>", "it's we'll I'D <|endo", "éà ñandú déjà vu", "日本語のテキスト　全角", "x" * 5000,
    "1234 5 6,7 == !! ?? ...", "a b c  d", "emoji 😀😀 é", "\x00\x01 \x7f", " lead", "trail ", "a\nb\n\nc. \nd 'tis 1,000.50 x\u0301, «é» ×2÷3 a|b t|> <|endoftext|>x,<|endoftext|>", "=" * 700 + " " * 300 + "z", "the the the the",
]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((ids, t.decode(ids, skip_special_tokens=False)))
    return out


def test_matches_the_library(spark):
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(df, PATH).collect()}
    digests = {r.doc_id: r for r in bpe.encode_digests(df, PATH).collect()}
    for i, (ids, decoded) in enumerate(expected(TEXTS)):
        assert list(got[i].ids) == ids, TEXTS[i]
        assert got[i].decoded == decoded
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    merges = bpe.Merges(PATH)
    words = [b" the", b"the", b" hello", b"'s", b" and"]
    path = str(tmp_path_factory.mktemp("lex") / "x.bin")
    bpe.save_lexicon(bpe.compile_lexicon(words, merges.merge(words)), path)
    return bpe.Encoder(path, merges), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'the<|endoftxt>é×1,. -\u0301\u00a0 "), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_property(encoder, texts):
    import pyarrow as pa

    from sheetlark.llm.common import text_buffer

    mine, theirs = encoder
    ids, rows = mine.encode(*text_buffer(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        assert ids[rows[i] : rows[i + 1]].tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_shared_suffixes():
    merges = bpe.Merges(PATH)
    words = [b"walking", b"talking", b"walked", b"talked"]
    lexicon = bpe.compile_lexicon(words, merges.merge(words))
    assert len(lexicon["final"]) < sum(map(len, words)) // 2 + 1
    assert sorted(bpe.walk(lexicon, words).tolist()) == [0, 1, 2, 3]
    assert bpe.walk(lexicon, [b"walk", b"walkings", b""]).tolist() == [-1, -1, -1]


def test_documents_match_the_library(spark):
    """The registered query over a whole table, against the library."""
    from sheetlark.llm.queries import op10_bpe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op10_bpe(spark, sf).collect()}
    assert len(got) == len(docs)
    for r, (ids, decoded) in zip(docs, expected([r.text for r in docs])):
        mine = got[r.doc_id]
        assert (mine.n_tokens, mine.ids_sha256, mine.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_units_are_told_apart_by_their_bytes(encoder):
    import pyarrow as pa

    from sheetlark.llm.common import text_buffer

    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    mine, theirs = encoder
    for text in (a, a.translate({97: 98, 98: 97})):
        ids, _ = mine.encode(*text_buffer(pa.array([text])))
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
