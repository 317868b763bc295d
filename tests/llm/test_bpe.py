import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import bpe
from tests.llm.util import documents, frame


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(str(public_tokenizers.path(bpe.DEFAULT_FILE)))
    t.no_truncation()
    t.no_padding()
    return t


def test_equals_the_library(reference):
    codec, rng = bpe.codec(None), random.Random(1)
    alphabet = "abcdefghijklmnop  \t\n'.,!?0123éßΣİñ中日本\u0301\u0085\x1c\x1f\u200b😀<|>endoftext"
    texts = [t or "" for _, t in documents()] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "aaaaaaaa" * 30, "ααΣ ΑΣ", "fox's don't we'll"]
    texts += ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for text in texts:
        expected, ids = reference.encode(text, add_special_tokens=False).ids, codec.encode(text)
        assert ids.tolist() == expected, text
        assert codec.decode(ids) == reference.decode(expected, skip_special_tokens=False)


def test_frames(spark, reference):
    docs = frame(spark)
    found = bpe.decode(bpe.encode(docs)).collect()
    for r in found:
        expected = reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == expected and r.decoded == reference.decode(expected, skip_special_tokens=False)
    for r in bpe.digests(docs).collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert (r._bpe.n_tokens, r._bpe.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.digests(docs.limit(0)).count() == 0


def test_caches_start_anew():
    memo = bpe.Memo(lambda k: k * 2, 3)
    assert [memo[k] for k in range(7)] == [0, 2, 4, 6, 8, 10, 12] and len(memo) <= 3


def test_caches_are_bounded_by_bytes():
    memo = bpe.Memo(lambda k: k * 1000, 10_000)
    for k in "abcdefghijklmnopqrstuvwxyz":
        assert memo[k] == memo[k] == k * 1000 and sum(len(v) for v in memo.values()) <= 10_000
    assert memo["long" * 10] and "long" * 10 not in memo and memo
