import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from colloquy.llm import bpe, langid, quality
from colloquy.llm.sql import mixing_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (7, "too short"), (8, "short too"), (9, prose(5)), (9, prose(5)), (None, "brief")]
    rows += [(3, prose(6)), (10, prose(7)), (10, prose(6) + " end"), (None, prose(6)), (None, prose(8)), (None, prose(8)), (12, prose(9)), (12, prose(9) + " end")]
    return spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], SCHEMA)


def pairs(rows):
    return Counter((r.doc_id, r.text) for r in rows.collect())


def test_quality_null_and_repeated_ids(spark, docs):
    long = docs.where(F.size(F.split("text", " ")) >= quality.MIN_WORDS)
    assert pairs(pipeline.quality_rules(spark, docs, "")) == pairs(long)


def test_neardup_null_and_repeated_ids(spark, docs):
    wanted = Counter({k: 1 for k in pairs(docs)})
    wanted[None, prose(8)] = 2
    for copy in ((10, prose(6) + " end"), (None, prose(6))):
        del wanted[copy]
    got = pairs(pipeline.near_duplicates(spark, docs, ""))
    twelve = [(12, prose(9)), (12, prose(9) + " end")]
    assert sum(got[x] for x in twelve) == 1
    for x in twelve:
        del wanted[x]
        got.pop(x, None)
    assert got == wanted


def test_language_id_stage(spark, docs):
    """Documents without a letter or in nothing that was learned go; null text, lang and source, repeated rows and an empty table don't crash."""
    extra = spark.createDataFrame([(50, None, "en", "s", 0), (51, "1234 5678", "en", None, 9), (52, "ёжик щука " * 20, None, None, 9), (53, prose(30), None, None, 9)], SCHEMA)
    got = pairs(pipeline.language_id(spark, docs.unionByName(extra), ""))
    long = docs.where(F.size(F.split("text", " ")) >= quality.MIN_WORDS)  # of three words, hardly an n-gram was learned
    assert got == pairs(long) + Counter([(53, prose(30))])
    assert pipeline.language_id(spark, docs.limit(0), "").count() == 0


def test_mixing_and_bpe_stages(spark, docs):
    """Copies are whole rows, two at most; encoding returns a row for each row, with nulls and repeated rows."""
    extra = docs.unionByName(spark.createDataFrame([(None, None, None, None, None)], SCHEMA))
    mixed = pipeline.mixing_to_weights(spark, extra, "")
    taken, there = pairs(mixed), pairs(extra)
    assert mixed.columns == extra.columns and all(n <= 2 * there[x] and n % there[x] == 0 for x, n in taken.items())
    encoded = pipeline.bpe_encoding(spark, extra, "").collect()
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in extra.collect())
    assert pipeline.bpe_encoding(spark, docs.limit(0), "").count() == pipeline.mixing_to_weights(spark, docs.limit(0), "").count() == 0


def test_whole_run(spark, tmp_path):
    """Against brute force, stage after stage: base rules, languages that were learned, the first of each group of near copies, SQL's copies, the library's ids."""
    import public_tokenizers
    import tiktoken

    rng = random.Random(12)
    rows = []
    for i in range(240):
        letters = "abcdefghij" if i % 3 else "klmnopqrst"
        rows.append((i, " ".join("".join(rng.choices(letters, k=rng.randrange(3, 8))) for _ in range(rng.randrange(60, 90))), "aa" if i % 3 else "bb", ("s1", "s2", "s3", None)[i % 4], 1))
    rows += [(1000 + i, rows[i][1] + (" end" if i % 2 else ""), *rows[i][2:]) for i in range(0, 60, 4)]
    rows += [(2000, "too short", "aa", "s1", 1), (2001, None, "aa", "s1", 1), (2002, "", None, None, 1), (2003, "same word " * 40, "aa", "s2", 1), (2004, "12345 67890 " * 9 + " ".join(map(str, range(70))), "aa", "s2", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    judged = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(judged[i] for i in (2000, 2001, 2002, 2003)) and sum(judged.values()) > 240
    kept = [r for r in rows if judged[r[0]]]
    known = {r.doc_id for r in langid.identify(spark.createDataFrame(kept, SCHEMA)).where(f"lang_pred <> 'und' and known >= {pipeline.LEAST_KNOWN}").collect()}
    kept = [r for r in kept if r[0] in known]
    assert 2004 not in known
    near = {i + 1000 for i in range(0, 60, 4) if any(r[0] == i for r in kept)}
    kept = [r for r in kept if r[0] not in near]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    copies = {x["doc_id"]: x["copies"] for x in con.sql(mixing_sql()).to_arrow_table().to_pylist()}
    ranks, _ = bpe._public("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = Counter()
    for i, text, *_ in kept:
        wanted[i, " ".join(map(str, library.encode_ordinary(text)))] += copies[i]
    got = Counter((r.doc_id, r.ids) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == +wanted and len(got) > 100


def test_whole_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
