import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratacat.llm import bpe_transducer as B
from stratacat.llm import token_counts as T

from .cases import ROWS, documents

MODEL = sentencepiece.SentencePieceProcessor(model_file=P.path(T.MODEL))
WORD = Tokenizer.from_file(P.path(B.MODEL))
WORD.no_truncation()
WORD.no_padding()
ENCODER = B.Encoder(P.path(B.MODEL))
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab cdé\n\t<|>'’ßΣ́")), max_size=80)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_cut_texts_have_the_same_count(text):
    pieces = T.parts(text, 10)
    assert sum(len(MODEL.encode(p)) for p in pieces) == len(MODEL.encode(text))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_bpe_matches_the_library(text):
    ids = WORD.encode(text, add_special_tokens=False).ids
    got = ENCODER.encode(text)
    assert got == (" ".join(map(str, ids)), WORD.decode(ids, skip_special_tokens=False), len(ids))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 2**31), min_size=1, max_size=4), max_size=40))
def test_lexicon_round_trip(entries):
    lexicon = B.Lexicon(B.compile_lexicon(entries))
    assert all(lexicon.get(k) == v for k, v in entries.items())
    assert all((lexicon.get(k + b"a") is None) == (k + b"a" not in entries) for k in entries)


def test_suffixes_are_shared():
    words = {f"{a}{b}ending".encode(): [i] for i, (a, b) in enumerate((x, y) for x in "abcdefgh" for y in "stuvwxyz")}
    states = int.from_bytes(B.compile_lexicon(words)[:4], "little")
    assert states == 2 + 7  # the start, one for all first letters, one per letter of the ending


def test_counts(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(repr(tuple(r)) for r in T.query(spark, str(tmp_path)).collect())
    want = []
    for doc, text, *_ in ROWS:
        n = len(MODEL.encode(text or ""))
        want.append(repr((doc, len((text or "").encode()), n, n > T.LIMIT)))
    assert got == sorted(want)


def test_encode_with_lexicon(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(repr(tuple(r)) for r in B.query(spark, str(tmp_path)).collect())
    want = []
    for doc, text, *_ in ROWS:
        ids = WORD.encode(text or "", add_special_tokens=False).ids
        want.append(repr((doc, len(ids), sha(" ".join(map(str, ids))), sha(WORD.decode(ids, skip_special_tokens=False)))))
    assert got == sorted(want)
    assert B.encode(documents(spark).limit(0), P.path(B.MODEL)).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="white space"):
        B.Encoder(P.path("byte_bpe_50k.json"))


LEXICON = B.Lexicon(B.build_lexicon([*"ab cd", "abc", "dé", "ßa", "re", "thereof", "it's"], P.path(B.MODEL)))
WITH_LEXICON = B.Encoder(P.path(B.MODEL), LEXICON)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdrestxABÀÖ×é÷ 0129'\"<|>\n\t"), max_size=60))
def test_latin_pieces_match_the_library(text):
    ids = WORD.encode(text, add_special_tokens=False).ids
    for encoder in (ENCODER, WITH_LEXICON):
        assert encoder.encode(text) == (" ".join(map(str, ids)), WORD.decode(ids, skip_special_tokens=False), len(ids))


def test_long_texts_come_in_segments(monkeypatch):
    monkeypatch.setattr(B, "SEGMENT", 50)
    texts = ["one two " * 40, None, "", "x" * 300 + " y", "It's <|endoftext|> Ünder 中文 " * 9, " \n " * 60, "end"]
    got = {k: [] for k in range(len(texts))}
    for owners, ids in WITH_LEXICON.segments(pa.array(texts)):
        for k, a, b in owners:
            got[k] += ids[a:b].tolist()
    assert got == {k: WORD.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_values_and_a_lexicon_in_the_shared_folder(spark):
    docs = documents(spark)
    words = B.frequent_words(docs.unionByName(docs).unionByName(docs))
    place = B.write_lexicon(words, P.path(B.MODEL))
    assert place.startswith(B.C.shared_dir(spark)) and B.Lexicon.opened(place).get(b"one") is not None
    for r in B.encode(docs, P.path(B.MODEL), with_values=True).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = WORD.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, WORD.decode(ids, skip_special_tokens=False))


def test_the_lexicon_keeps_its_limit(spark):
    rows = [(i, " ".join(["always"] * 40 + ["often"] * 10 + [f"rare{chr(97 + i)}{chr(97 + j)}" for j in range(20)] * 4), "en", "x", 0) for i in range(20)]
    assert {r.w for r in B.frequent_words(documents(spark, rows), 100).collect()} == {"always", "often"}
