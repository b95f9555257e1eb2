import hashlib

from helpers import by_id, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import bpe as B

SOURCE = B.word_bpe_source()
TOK = B.load_tokenizer(SOURCE)
TEXTS = ["The cat's 12 dogs", None, "", " \t\n", "naïve Café ñ ΑΣ ΣΑΣ İstanbul", "a<|endoftext|>B <|startoftext|>", "x\x1cy\x85z\xa0w v​u",
         "日本語 テスト 😀👍🏽", "it'll don't'S", "lone ́accent", "word " * 30000, "Ω" * 5000, "\x00\x01", "<|ENDOFTEXT|> <|endof text|>"]


def expected(text):
    ids = TOK.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_as_the_library(spark):
    pairs = list(enumerate(TEXTS)) + [(None, "the cat"), (3, "again again again")]
    got = by_id(B.digests(docs(spark, pairs * 2).repartition(3), SOURCE))
    assert sum(map(len, got.values())) == 2 * len(pairs)
    for i, t in pairs:
        assert expected(t) in {tuple(r)[1:] for r in got[i]}


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in B.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: expected(r.text) for r in table.collect()}


def test_empty(spark):
    assert B.digests(docs(spark, []), SOURCE).count() == 0


def test_ids_array(spark):
    lex = B.Lexicon.compile([], [])
    got = by_id(B.bpe(docs(spark, [(1, "The cat"), (2, "")]), SOURCE, lex).select("doc_id", B.ids_of(B.F.col("id_text")).alias("ids")))
    assert got[1][0].ids == TOK.encode("The cat", add_special_tokens=False).ids and got[2][0].ids == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(max_size=5), max_size=60), st.lists(st.binary(max_size=6), max_size=30))
def test_lexicon_is_a_minimal_perfect_hash(words, others):
    words = sorted(words)
    lex = B.Lexicon.mapped(B.Lexicon.compile(words, [[i, 2 * i] for i in range(len(words))]).dump())
    if words and any(words):
        assert lex.places(words).tolist() == list(range(len(words)))
        assert all(lex.tokens(i) == [i, 2 * i] for i in range(len(words)))
    assert all((p >= 0) == (w in words) for w, p in zip(others, lex.places(others).tolist(), strict=True) if words and any(words))


def test_equal_suffixes_share_states():
    lex = B.Lexicon.compile([b"taps", b"tops"], [[1], [2]])
    assert len(lex.final) == 5


def test_new_words_are_merged_many_at_a_time():
    letters = "aA's.é́İſK가가​\xa0\x85\x1c日👍"
    words = list(dict.fromkeys([a + b + c for a in letters for b in letters for c in letters] + ["<|endoftext|>", "a<|startoftext|>b", "<|endoftext", "word"]))
    enc = B.Encoder(SOURCE, B.Lexicon.compile([b"word"], [[7, 8]]).dump())
    tok, texts = enc.tok, []

    class Counting:
        def encode_batch(self, batch, **kw):
            texts.extend(batch)
            return tok.encode_batch(batch, **kw)

    enc.tok = Counting()
    got = [ids.split() for ids in enc.rows(words)[0].to_pylist()]
    assert 0 < len(texts) <= len(words) / 100
    assert got == [["7", "8"] if w == "word" else [str(i) for i in e.ids] for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False), strict=True)]


def test_forgotten_words_come_out_alike():
    enc = B.Encoder(SOURCE, B.Lexicon.compile([b"cat"], [[7]]).dump())
    texts = ["the cat", "", "naïve cat cat x1", "naïve"]
    first = [x.to_pylist() for x in enc.rows(texts)]
    enc.held = B.CACHE_BYTES + 1
    assert [x.to_pylist() for x in enc.rows(texts)] == first and first[1] == [enc.n[enc.number["the"]] + 1, 0, first[1][2], first[1][3]]
