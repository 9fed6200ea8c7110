"""What tasks hold at once is bounded by constants, whatever a batch has."""

import pyarrow as pa

from colloquy.llm import fim, tokens


def test_cut_yields_few_rows_at_once_and_keeps_what_is_asked(spark):
    """A batch is cut ROWS rows at a time, with the same rows as one after another; the text does not come back beside the output."""
    texts = ["", None, "é<P>", *(f"text {i} ünd ß" * (i % 7) for i in range(3 * fim.ROWS))]
    batch = pa.record_batch({"row": pa.array([{"doc_id": i} for i in range(len(texts))]), "_id": pa.array(range(len(texts)), pa.int64()), "_text": pa.array(texts, pa.string())})
    got = list(fim._cut(iter([batch])))
    assert max(x.num_rows for x in got) <= fim.ROWS and sum(x.num_rows for x in got) == len(texts)
    alone = [fim._cut(iter([batch.slice(i, 1)])) for i in range(len(texts))]
    assert pa.Table.from_batches(got).to_pylist() == [x for one in alone for y in one for x in y.to_pylist()]
    docs = spark.createDataFrame([(1, "a text of words", "x")], "doc_id long, text string, other string")
    assert fim.transform(docs, ["doc_id"]).select("row.*").columns == ["doc_id"]
    assert fim.transform(docs).select("row.*").columns == docs.columns


def test_frequent_words_stay_known_when_dictionaries_change(spark, monkeypatch):
    """With a dictionary for each few words ids are the same, and a word of every batch is encoded once."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    batches = [pa.record_batch({"doc_id": [i], "part": pa.array([0], pa.int32()), "text": [f"often, word{i}a Word{i}b. word{i}c"]}) for i in range(30)]
    whole = [x.column("ids").to_pylist() for x in tokens._encoder(tokenizer_json, 1)(iter(batches))]
    sent, encode_new = [], tokens.encode_new
    monkeypatch.setattr(tokens, "MEMO_WORDS", 5)
    monkeypatch.setattr(tokens, "encode_new", lambda tokenizer, words, cores: sent.extend(words) or encode_new(tokenizer, words, cores))
    assert [x.column("ids").to_pylist() for x in tokens._encoder(tokenizer_json, 1)(iter(batches))] == whole
    assert sent.count(b"often,") == 1


def test_bpe_stage_and_op4_fold_in_spark(spark, tmp_path):
    """The queries' ids come from the fold by higher-order functions, not from a worker's loop."""
    import corpus_pipeline
    from colloquy.llm import bpe

    docs = spark.createDataFrame([(1, "some words, some more", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for found in (corpus_pipeline.bpe_encoding(spark, docs, ""), bpe.op4_bpe(spark, str(tmp_path))):
        assert "aggregate" in found._jdf.queryExecution().analyzed().toString() and found.count() == 1


def test_bpe_fold_over_changing_dictionaries(spark, monkeypatch):
    """Small dictionaries and a new start each few words give the same ids; frequent words are numbered once, a row a document goes to the fold."""
    from colloquy.llm import bpe

    ranks, pattern = bpe._public("byte_bpe_50k.tiktoken")
    rows = [(i, None if i % 9 == 4 else f"often word{i}a aaaaaaaaa abaabaaba naïve{i} " + f"{i}" * (40 + i % 3) + "ß" * (i % 70)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    wanted = sorted(bpe.encode(docs, ranks, pattern, spark=False).collect())
    assert sorted(bpe.encode(docs, ranks, pattern, memo_words=50).collect()) == wanted
    batches = [pa.record_batch({"row": [{"doc_id": i}], "text": [t]}) for i, t in rows]
    got = [x for b in bpe._numberer(pattern, 50)(iter(batches)) for x in b.to_pylist()]
    assert len(got) == len(rows) and sum(x["new_words"].count(list(b"often")) for x in got) == 1
    monkeypatch.setattr(bpe, "MOST_NUMBERS", 300)
    assert sum(x["fresh"] for b in bpe._numberer(pattern, 50)(iter(batches)) for x in b.to_pylist()) > 1
    assert sorted(bpe.encode(docs, ranks, pattern, memo_words=50).collect()) == wanted


def test_perfect_hash_finds_all_pairs_and_no_others():
    from colloquy.llm import bpe

    pairs = {(i * 37 % 1009, i * i % 997): i for i in range(500)}
    shifts, slots = bpe.perfect_hash(pairs)
    at = lambda k: slots[(k + shifts[k % len(shifts)]) % len(slots)]
    for a in range(200):
        for b in range(200):
            k = a * bpe.PAIR + b
            assert (at(k) >> bpe.PAIR_BITS == k) == ((a, b) in pairs)
    for (a, b), r in pairs.items():
        assert at(a * bpe.PAIR + b) == (a * bpe.PAIR + b) * bpe.PAIR + r
