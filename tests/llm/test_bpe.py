import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerleaf.llm import bpe

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = [
    "", " ", "\n\n", "a\n\n b'll don't 'sup  ''s x's  \t y", "It's O'Reilly's 12 ½ ²³ Ⅷ <|endoftext|> end<|startoftext|>'s x", "ΣΑΣ ǅ İ é 日本語 😀😀 ",
    "a" * 500, "!" * 77 + "'s ", " 's", "\n's 'RE're", "a\x1cb \x85c d　 e", "<|endoftext|>", "   <|endoftext|>   x", "the  \n", "é ñ", "᠎​﻿ x",
]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return Tokenizer.from_file(path), bpe.Encoder(path)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_library(pair, text):
    library, own = pair
    assert own([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in FILES}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60), max_size=6))
def test_batches_of_any_text(texts):
    for name in FILES:
        library, own = LIBRARY[name], bpe.encoder_of(public_tokenizers.path(name))
        assert [x.tolist() for x in own(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_is_that_of_the_library():
    path = public_tokenizers.path(FILES[0])
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    for ids in ([50256, 0, 5], [128, 129], list(range(0, 50257, 97)), []):
        assert own.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_digests_of_odd_rows(spark):
    path = public_tokenizers.path(FILES[0])
    rows = [(1, None, "x"), (None, "hello  world", "x"), (2, "", "x"), (2, "long " * 60_000, "x"), (2, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in bpe.digests(df, path).collect()), key=repr)
    library = Tokenizer.from_file(path)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(df.limit(0), path).count() == 0
    full = {(r.doc_id, r.decoded) for r in bpe.encode(df, path).collect()}
    assert full == {(i, t or "") for i, t, _ in rows}
