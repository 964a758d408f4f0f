import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import tokens

RANKS = tokens.load_ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
PUBLIC = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_merge_is_exact(text):
    own = [i for word in tokens._WORD.findall(text) for i in tokens.merge(word.encode(), RANKS)]
    assert own == PUBLIC.encode_ordinary(text)


def test_long_word():
    word = "ab" * 30_000
    assert tokens.merge(word.encode(), RANKS) == PUBLIC.encode_ordinary(word)


def test_lexicon_is_minimal_and_holds_its_words(tmp_path):
    random.seed(1)
    words = sorted({bytes(random.choices(b"abc", k=random.randint(1, 7))) for _ in range(900)})
    image = tokens.compile_lexicon(words, [[i, i + 1] for i in range(len(words))])
    (tmp_path / "l").write_bytes(image)
    lexicon = tokens.Lexicon(str(tmp_path / "l"))
    assert all(lexicon.get(w) == [i, i + 1] for i, w in enumerate(words))
    assert lexicon.get(b"") is None and lexicon.get(b"zz") is None and lexicon.get(words[0] + b"ccccccccc") is None
    suffixes = {frozenset(w[i:] for w in words if w[:i] == p[:i]) for p in words for i in range(len(p) + 1)}
    assert len(lexicon.final) == len(suffixes)  # as many states as different sets of endings


def test_encode(spark):
    rows = [(1, "Hello <|endoftext|> world"), (2, ""), (3, None), (4, "Hello <|endoftext|> world"), (5, " \n\n  x ünï ＡＰＩ ​"), (6, "ab" * 5000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {k: PUBLIC.encode_ordinary(t or "") for k, t in rows}
    assert tokens.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [[], [b""]])
def test_empty_lexicon(tmp_path, words):
    (tmp_path / "l").write_bytes(tokens.compile_lexicon(words, [[7]] * len(words)))
    lexicon = tokens.Lexicon(str(tmp_path / "l"))
    assert lexicon.get(b"") == ([7] if words else None) and lexicon.get(b"a") is None
