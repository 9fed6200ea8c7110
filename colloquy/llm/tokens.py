"""Token ids in ORC: run-length-encoded integers, row indexes, Bloom filters on doc_id.

Documents are sorted by doc_id over range partitions, so files follow one another in ascending
order and their stripes' minima and maxima prune; a Bloom filter on doc_id prunes row groups.
Words between ASCII white space don't touch each other in this tokenizer (white space is dropped
and no match spans it), so each distinct word goes to the library once per dictionary. A text that
holds the string of an added token goes to the library whole, which gives that token's own id.

Results at the edges: null text is the end id alone; a null doc_id sorts first; rows of one doc_id
(or of none) follow one another by a hash of the text, then by the text, and may lie in several
files; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, scratch_path

END_ID = 1
#: Words after which a worker begins a new dictionary; the one before it still answers, so frequent words stay known.
MEMO_WORDS = 1 << 19
ROWS = 1024
PART_BYTES = 128 << 20
ORC = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.encoding.strategy": "COMPRESSION",
}


def encode_words(tokenizer, words: list[bytes]) -> list[bytes]:
    """Each word's ids as little-endian bytes; many words a call, told apart by the places of their tokens."""
    out = []
    for i in range(0, len(words), 512):
        part = [w.decode("utf-8", "replace") for w in words[i : i + 512]]
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in part])))
        got = tokenizer.encode(" ".join(part), add_special_tokens=False)
        word = np.searchsorted(starts, np.array([x[0] for x in got.offsets], np.int64), "right") - 1
        cut, raw = np.searchsorted(word, np.arange(len(part) + 1)) * 4, np.array(got.ids, "<u4").tobytes()
        out += [raw[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return out


def encode_new(tokenizer, words: list[bytes], cores: dict[bytes, bytes]) -> list[bytes]:
    """Encodes words (without line feeds) through cores, which knows the empty word: ASCII lower case (the tokenizer lowers all) without full stops and commas at the end.

    Those stand apart in this tokenizer after an ASCII letter or digit; after anything else the word is its own core.
    """
    if not words:
        return []
    lows = b"\n".join(words).lower().split(b"\n")
    stems = [x.rstrip(b".,") for x in lows]
    stems = [x if x[-1:].isalnum() else low for x, low in zip(stems, lows, strict=True)]
    tails = [b"" if len(x) == len(low) else low[len(x) :] for x, low in zip(stems, lows, strict=True)]
    wanted = set(filterfalse(cores.__contains__, chain(stems, tails)))
    # letters alone are one match that normalization leaves as it is: the library's model takes them directly
    plain = set(filter(bytes.isalpha, wanted))
    model = tokenizer.model
    for x in plain:
        ids = [t.id for t in model.tokenize(x.decode())]
        cores[x] = struct.pack(f"<{len(ids)}I", *ids)
    others = list(wanted - plain)
    cores.update(zip(others, encode_words(tokenizer, others), strict=True))
    return [cores[a] + cores[b] if b else cores[a] for a, b in zip(stems, tails, strict=True)]


def _encoder(tokenizer_json: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        # words in lower case must not turn into added tokens, so words have a tokenizer that knows none; the whole one is loaded for the first text that holds one
        library, tokenizer = None, Tokenizer.from_str(tokenizer_json)
        tokenizer.encode_special_tokens = True
        added = "|".join(re.escape(x.content) for x in tokenizer.get_added_tokens_decoder().values())
        memo: dict[bytes, bytes] = {b"": b""}
        cores: dict[bytes, bytes] = {b"": b""}
        before: dict[bytes, bytes] = {}
        place = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if len(memo) > MEMO_WORDS:
                    before, memo, cores = memo, {b"": b""}, {b"": b""}
                texts = pc.fill_null(part.column("text"), "")
                marked = pc.match_substring_regex(texts, added) if added else pa.array([False] * part.num_rows)
                split = pc.ascii_split_whitespace(pc.if_else(marked, "", texts))
                flat = split.values.dictionary_encode()
                # the distinct words of these rows (an empty one at the edges of a text among them)
                words = flat.dictionary.cast(pa.binary()).to_pylist()
                got = list(map(memo.get, words))
                missing = []
                for i in [i for i, x in enumerate(got) if x is None]:
                    if (x := before.get(words[i])) is None:
                        missing.append(i)
                    else:
                        got[i] = memo[words[i]] = x
                new = [words[i] for i in missing]
                for i, w, x in zip(missing, new, encode_new(tokenizer, new, cores), strict=True):
                    got[i] = memo[w] = x
                pool = np.frombuffer(b"".join(got), "<i4")
                sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
                index, cuts = flat.indices.to_numpy(), split.offsets.to_numpy()
                firsts, of_word = (np.cumsum(sizes) - sizes)[index], sizes[index]
                ends = np.concatenate(([0], np.cumsum(of_word)))
                # the end id stays wherever no word's id goes: one place after each row's words
                offsets = (ends[cuts] + np.arange(len(cuts))).astype(np.int32)
                values, at_token = np.full(offsets[-1], end_id, "<i4"), np.arange(ends[-1])
                values[at_token + np.repeat(np.arange(part.num_rows), np.diff(ends[cuts]))] = pool[at_token + np.repeat(firsts - ends[:-1], of_word)]
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                if (at_once := np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist()):
                    lists, library = ids.to_pylist(), library or Tokenizer.from_str(tokenizer_json)
                    for i in at_once:
                        lists[i] = [*library.encode(texts[i].as_py(), add_special_tokens=False).ids, end_id]
                    ids = pa.array(lists, pa.list_(pa.int32()))
                places = pa.array(np.arange(place, place + part.num_rows, dtype=np.int64))
                place += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), places, ids], names=["doc_id", "part", "place", "ids"])

    return encode


def write_orc(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = END_ID) -> None:
    """doc_id, part (file order), place (in the file), ids; ascending doc_id."""
    ready = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"))
    spark = docs.sparkSession
    # a dictionary serves one task, so tasks are large: about PART_BYTES of input each, two a core at least
    splits = docs.rdd.getNumPartitions() * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    n = max(splits // PART_BYTES, 2 * spark.sparkContext.defaultParallelism)
    ready = ready.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    ready.mapInArrow(_encoder(tokenizer_json, end_id), "doc_id long, part int, place long, ids array<int>").write.options(**ORC).orc(path)


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), "<i4").view(np.uint8)
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "place")), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: a running sum in each part, and the parts' sums before it."""
    stored = spark.read.orc(path)
    rows = stored.mapInArrow(_summarize, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(parts, "part").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = scratch_path(spark, "tokens")
    write_orc(read(spark, sf_dir, "documents"), tokenizer_json, path)
    return read_orc(spark, path)
