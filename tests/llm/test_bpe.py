"""Against the tokenizer library itself."""

import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from cargolens.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def check(texts):
    for t, (ids, raw) in zip(texts, ENCODER.encode(texts), strict=True):
        assert ids == ",".join(map(str, LIBRARY.encode_ordinary(t or ""))) and raw == (t or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sla1.é")), max_size=40), max_size=6))
def test_any_text(texts):
    check(texts)


def test_spaces_and_contractions():
    check([" lead", "  two", "trail ", "a  b", "a \n b", "\n\n x", "it's we'll ' s", "a  b", "tab\t x", "<|endoftext|>", "", None,
           "x\x1c y", "\x85 z", "aaaaaaaaaaaaaaaaaaaaaaaa" * 20, "été ÉTÉ naïve", "日本語 テキスト", "🙂🙂 🙂", "1234567 12 3"])


def test_small_cache_and_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_UNITS", 6)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 30)
    monkeypatch.setattr(bpe, "PIECES_PER_QUERY", 3)
    check([f"word{i % 7} and more {i} words again" for i in range(40)])


def test_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "two words", 7), (3, "two words", 7), (None, "x " * 150_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(bpe.op7_bpe(df).collect(), key=lambda r: (r.n_tokens, str(r.doc_id)))
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r)[:2] for r in got[:4]] == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert got[0].ids_sha256 == got[0].decoded_sha256 == empty
    assert got[4].decoded_sha256 == hashlib.sha256(b"x " * 150_000).hexdigest()
    assert bpe.op7_bpe(df.limit(0)).count() == 0
    full = bpe.encode_texts(df, keep_ids=True).where("doc_id = 3").first()
    assert full.ids == LIBRARY.encode_ordinary("two words") and bytes(full.decoded) == b"two words"


def test_a_wrong_round_trip_is_an_error(monkeypatch):
    monkeypatch.setattr(bpe, "ENCODE", bpe.ENCODE.replace("ORDER BY piece, pos", "ORDER BY piece, pos DESC"))
    with pytest.raises(ValueError):
        bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode_pieces([b"zzyzxqwv"])


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_long_runs_stay_within_memory(n):
    """Runs without a break, of equal and of mixed characters, in DuckDB's 200 MB and without a file beside it."""
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    own.db.execute("SET temp_directory = ''")
    rnd = random.Random(5)
    texts = ["a" * n, "=" * n + "x", "ab" * (n // 2), "".join(rnd.choices("abc", k=n)), "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n // 50)), "\u65e5" * (n // 3)]
    for t, (ids, raw) in zip(texts, own.encode(texts), strict=True):
        assert raw == t.encode() and ids == ",".join(map(str, LIBRARY.encode_ordinary(t)))


def test_rounds_agree_with_the_recursive_query(monkeypatch):
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "LONG_PIECE", 3)
    texts = ["aaaaaaa bananabanana", "strawberries", "\n\n\n     x", "\u00e9\u00e9\u00e9\u00e9\u00e9 mississippi", "a" * 41, "=" * 40]
    for t, (ids, raw) in zip(texts, own.encode(texts), strict=True):
        assert raw == t.encode() and ids == ",".join(map(str, LIBRARY.encode_ordinary(t)))
