"""Null ids, clashing names and ties for the operators on documents: columns beside id and text change nothing."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, lmscore, media, quality, tokens
from colloquy.llm.common import scratch_path

CLASHING = ["ids", "sizes", "texts", "block", "bucket", "n", "grams", "counts", "totals", "g", "k", "c", "bin", "mean", "inverse", "spread", "distance", "kept", "part", "place", "row", "_h", "_text", "_id", "payload", "digest", "chunk", "n_words", "n_tokens", "size", "v_words", "base_failed"]


def rows():
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (3, 12, 40, 40, 400)]
    out = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts] + [(None, None), (None, None), (7, ""), (7, "same id " * 8), (7, texts[2])]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s") for k, (i, t) in enumerate(out)]


def features(docs):
    return media.media_features(docs)


def orc(docs):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = scratch_path(docs.sparkSession, "edges")
    tokens.write_orc(docs, tokenizer_json, path)
    return tokens.read_orc(docs.sparkSession, path)


def encoded(docs):
    ranks, pattern = bpe._public("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, ranks, pattern, ["doc_id"]).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@pytest.mark.parametrize("operator", [lmscore.score, quality.judge, encoded, features, orc])
def test_clashing_columns_and_null_ids(spark, operator):
    plain = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    wide = plain.withColumns({c: F.lit("own") for c in CLASHING})
    got = [Counter(map(str, operator(x).drop("start").collect())) for x in (plain, wide)]
    assert got[0] == got[1] and sum(got[0].values()) == len(rows())
    assert operator(wide.limit(0)).count() == 0


def test_ties_in_distance(spark):
    """Documents of one vector share a verdict, also an outlier's copies."""
    rng = random.Random(3)
    prose = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(4, 7))) for _ in range(rng.randrange(90, 110))) for _ in range(200)]
    odd = [" ".join(["#" * 9, "&" * 30] + ["".join(rng.choices("klm", k=3)) for _ in range(20)] + ["|" * 40])] * 3
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(prose + odd)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.distance, r.kept) for r in quality.judge(docs).collect()}
    assert len({got[200 + i] for i in range(3)}) == 1 and not got[200][1]
    assert sum(got[i][1] for i in range(200)) >= 195
