import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerleaf.llm import harmonic

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_cuts_fit_their_class():
    counts = harmonic.counts_of(4096)
    for length in [*range(1, 5000), 4096 * 3, 4096 * 3 + 1, 100_000]:
        pieces = harmonic.cut(length, 4096, counts)
        assert sum(n for n, _ in pieces) == length
        assert all(n > 0 and n * j <= 4096 for n, j in pieces)


@pytest.mark.parametrize("last", [10, 10_000])
def test_every_id_lies_in_one_piece(spark, monkeypatch, last):
    monkeypatch.setattr(harmonic, "LAST", last)
    monkeypatch.setattr(harmonic, "SHARE", 60)
    texts = {i: " ".join(["word", "another", "zebra"][(i + k) % 3] for k in range(i * 37 % 900)) for i in range(150)}
    texts |= {150: None, 151: "", 152: "x " * 20_000}
    df = spark.createDataFrame([(i, t, 0, "q") for i, t in texts.items()], "doc_id long, text string, start int, bin_count string").repartition(5)
    rows = harmonic.pack(df, PATH).collect()
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
    assert len(by_sequence) * 4096 <= total * 1.05 + 4096


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in harmonic.pack(df, PATH).collect()) == [(0, 1), (1, 3), (1, 3)]
    assert harmonic.pack(df.limit(0), PATH).count() == 0
