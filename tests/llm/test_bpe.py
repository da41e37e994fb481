import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from luminal.llm import bpe, counts

PATH, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    odd = ["", " ", "\n\n  x", "don't you'll 'sx", "a b c\x1cd", "日本語 текст ½² Ⅷ", "é ́", "x" * 30_000, "  \t\n" * 500, "😀" * 99 + "!!", "12345 6 ٣٤", "a<|endoftext|>b <|endoftext|>  <|endoftext|>", "<|endoftext|", "\x00\x01", "'S 's '' '"]
    mixed = ["".join(rng.choice("ab \n.'sé1,\tß") for _ in range(rng.randrange(200))) for _ in range(100)]
    return odd + mixed + mixed[:20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "b") for i, t in enumerate(texts())] + [(None, "null id", 2, "c"), (900, None, 3, "d"), (900, None, 3, "d")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, block string")


def test_encode_and_round_trip(docs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    lists = bpe.encode(docs, PATH, P.PATTERN, as_array=True).collect()
    assert sorted((str(r.doc_id), r.ids) for r in lists) == [(i, x) for i, x, _ in want]
    assert all(r.n_tokens == len(r.ids) for r in lists)
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((i, b) for i, _, b in want)


def test_counts(docs):
    tok = Tokenizer.from_file(JSON)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = counts.token_counts(docs, JSON, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_small_blocks_and_empty(spark, docs, monkeypatch):
    from luminal.llm import pretoken

    monkeypatch.setattr(pretoken, "BLOCK_WORDS", 50)
    a = sorted(map(tuple, counts.token_counts(docs.fillna(-1, ["doc_id"]), JSON, P.PATTERN).collect()))
    monkeypatch.undo()
    assert a == sorted(map(tuple, counts.token_counts(docs.fillna(-1, ["doc_id"]), JSON, P.PATTERN).collect()))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert counts.token_counts(none, JSON, P.PATTERN).count() == bpe.encode(none, PATH, P.PATTERN).count() == 0
