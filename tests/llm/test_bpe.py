import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinlink.llm import bpe

from .texts import DOCS, documents, prose

ODD = ["", "  \n", "It's I'LL we're don't 've", "ΣΑΣ Σ ΟΔΟΣ.", "İstanbul ß ẞ", "éà", "a​b﻿", "x<|endoftext|>y <|startoftext|>", "½ ² Ⅷ ٣٤ 3.14", "中文字 한국어 हिन्दी", "👍🏽👨‍👩", "\x1c\x1d\x85\xa0　 ", "qxzqxj ßßö ___ ''''s", "a\x00b", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT_FILE))
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_codec_agrees_with_the_library(library):
    codec = bpe.codec(public_tokenizers.path(bpe.DEFAULT_FILE))
    rng = random.Random(3)
    pool = "".join(ODD) + "abc XYZ éèß 0129 ,.!'"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(50)) for _ in range(800)] + [prose(3000, 1)]
    for t in texts:
        ids = codec.encode(t)
        assert (np.frombuffer(ids, "<u4").tolist(), codec.decode(ids)) == expected(library, t)


def test_cuts_are_certain(library):
    """No vocabulary token reaches across a cut, and fragments put together give the whole word's ids."""
    codec = bpe.codec(public_tokenizers.path(bpe.DEFAULT_FILE))
    for word in ("keitpföte", "qxzj", "ciónñ", "extraordinary"):
        parts = codec.fragments(word.encode())
        assert sum(map(len, parts)) == len(word.encode())
        assert [i for p in parts for i in codec.encode_fragment(p)] == library.encode(word).ids
    assert len(codec.fragments(b"qxzj")) > 1


def test_readable_round_trip():
    codec = bpe.codec(public_tokenizers.path(bpe.DEFAULT_FILE))
    assert codec.to_text(codec.encode("quiet  Garden, of 12 été")) == "quiet garden , of 1 2 été"


def test_query_rows(spark, library):
    texts = [(1, None), (2, ""), (3, prose(50, 2)), (3, prose(50, 2)), (4, "x" * 100_000), (None, "a<|endoftext|>")]
    got = bpe.bpe_digest(documents(spark, texts)).collect()
    want = []
    for i, t in texts:
        ids, text = expected(library, t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_columns_and_empty_table(spark):
    docs = documents(spark, [(1, "a b")]).withColumns({"ids": F.lit("mine"), "n_tokens": F.lit(0), "more": F.lit(5)})
    row = bpe.encode_documents(docs).first()
    assert row.more == 5 and row.n_tokens == 2 and len(row.ids) == 2
    assert bpe.bpe_digest(spark.createDataFrame([], DOCS)).count() == 0
