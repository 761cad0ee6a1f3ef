import base64
import random

import public_tokenizers
import pytest
import tiktoken

from framewright.llm import bpe
from framewright.llm.shared import text_groups

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = list("ab'stremvdl  \n\t.,!19é中 　\U0001f600'’ſΣ\0ǅ٣")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(0)
    made = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 40))) for _ in range(4000)]
    return made + ["", "a" * 3000, "ab" * 2000 + "'s", " " * 300, "\n" * 7 + "x", "'" * 99, "<|endoftext|>", "word " * 20000]


def test_same_ids_as_the_library(reference):
    coder = bpe.ByteBpe.load(PATH)
    all_texts = texts()
    got = [ids for group in text_groups(all_texts, 5000) for ids, _ in coder.encode_batch(group)]
    assert got == [reference.encode_ordinary(t) for t in all_texts]
    assert all(coder.decode(i).decode() == t for i, t in zip(got, all_texts))


def test_offsets_cut_the_text_into_pieces():
    coder = bpe.ByteBpe.load(PATH)
    for t in ("It's  a test\n\n of 12 things", "é中 x", "", "   "):
        ids, at = next(coder.encode_batch([t]))
        data = t.encode()
        pieces = [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]
        assert b"".join(pieces) == data and sum(len(bpe.merge(p, coder.ranks)) for p in pieces) == len(ids)


def test_scan_equals_stepping():
    import numpy as np

    symbols = np.random.default_rng(3).integers(0, 10, 5000).astype(np.uint8)
    state, want = bpe.CLOSED, []
    for s in symbols:
        want.append(state)
        state = bpe._step(state, int(s))[0]
    assert bpe._states(symbols).tolist() == want


def test_rows_nulls_and_clashes(spark):
    docs = spark.createDataFrame([(1, "It's", 9), (None, None, 9), (1, "It's", 9), (2**60 + 1, "", 9)], "doc_id long, text string, ids int")
    coded = bpe.encode_documents(docs, PATH)
    assert sorted((str(r.doc_id), len(r.ids)) for r in coded.collect()) == sorted([("1", 2), ("1", 2), ("None", 0), (str(2**60 + 1), 0)])
    assert sorted(bytes(r.data) for r in bpe.decode_documents(coded, PATH).collect()) == [b"", b"", b"It's", b"It's"]
    assert bpe.encode_documents(docs.where("false"), PATH).count() == 0
