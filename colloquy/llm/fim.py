"""Fill-in-the-middle by succinct rank and select over packed boundary bits.

A batch of texts is one run of UTF-8 bytes. A bit for each byte says whether a code point begins
there; the bits are packed into 64-bit words, and a directory holds the popcount before each block
of BLOCK_WORDS words. rank(i) is the directory's entry, the popcounts of the block's words before
i, and those of i's own word under a mask. select(k) finds the block in the directory, the word in
the block and the bit in the word. So a text of n code points, n from the ranks of its ends, is cut
at two ranks without being decoded.

Results at the edges: null text is empty, and plain; so is a text that holds one of the three
marks; a null doc_id is hashed as no digits; repeated rows give equal rows; an empty table gives an
empty result; the columns of keep, or all of the caller's, come back in the struct row, so that no
name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: from PLAIN_FROM on a text stays as it is; of the others, those below SPM_BELOW have the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
SALT = "1:"
BLOCK_WORDS = 8
#: Rows that are cut at once; their bits and outputs are what a task holds besides a batch.
ROWS = 256
_BYTE_BITS = np.array([i.bit_count() for i in range(256)], np.uint8)
#: Where the k-th set bit of a byte is.
_BIT_OF = np.array([([j for j in range(8) if i >> j & 1] + [8] * 8)[:8] for i in range(256)], np.uint8)


class Boundaries:
    """Rank and select over the starts of code points in a run of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        # padded to whole blocks; bit i of the run is bit i % 8 of byte i // 8
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        self.packed = np.zeros(-(-(len(packed) + 1) // (8 * BLOCK_WORDS)) * 8 * BLOCK_WORDS, np.uint8)
        self.packed[: len(packed)] = packed
        per_word = np.bitwise_count(self.packed.view("<u8")).astype(np.int64).reshape(-1, BLOCK_WORDS)
        #: popcount before each block, and within a block before each of its words
        self.blocks = np.concatenate(([0], np.cumsum(per_word.sum(axis=1))))
        self.inside = np.cumsum(per_word, axis=1) - per_word

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Starts before each byte offset."""
        word, bit = at // 64, (at % 64).astype(np.uint64)
        below = self.packed.view("<u8")[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.blocks[word // BLOCK_WORDS] + self.inside[word // BLOCK_WORDS, word % BLOCK_WORDS] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of the k-th start, from 0; k below their number."""
        block = np.searchsorted(self.blocks, k, "right") - 1
        left = k - self.blocks[block]
        in_block = (self.inside[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.inside[block, in_block]
        octets = self.packed.reshape(-1, 8)[block * BLOCK_WORDS + in_block]
        counts = _BYTE_BITS[octets].astype(np.int64)
        before = np.cumsum(counts, axis=1) - counts
        octet = (before <= left[:, None]).sum(axis=1) - 1
        rows = np.arange(len(k))
        return (block * BLOCK_WORDS + in_block) * 64 + octet * 8 + _BIT_OF[octets[rows, octet], left - before[rows, octet]]


def draws(doc_id: int | None) -> list[int]:
    """The four numbers that a document's choices follow from."""
    digest = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        texts = pc.fill_null(batch.column("_text"), "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        data, ends = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        bits = Boundaries(data)
        ranks = bits.rank(ends)
        n = np.diff(ranks)
        h = np.array([draws(i) for i in batch.column("_id").to_pylist()], np.int64)
        cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
        # the place behind a text's last code point is the end of the text
        at = np.where(cuts < n[:, None], bits.select(np.minimum(ranks[:-1, None] + cuts, max(ranks[-1] - 1, 0)).ravel()).reshape(-1, 2) if ranks[-1] else 0, ends[1:, None])
        raw, forms, outputs = data.tobytes(), [], []
        for i in range(batch.num_rows):
            begin, first, second, end = ends[i], at[i, 0], at[i, 1], ends[i + 1]
            text = raw[begin:end]
            if not text or any(m in text for m in marks) or h[i, 2] % 100 >= PLAIN_FROM:
                forms.append("plain"), outputs.append(text)
                continue
            prefix, middle, suffix = raw[begin:first], raw[first:second], raw[second:end]
            spm = h[i, 3] % 100 < SPM_BELOW
            forms.append("spm" if spm else "psm")
            outputs.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle) if spm else (marks[0], prefix, marks[1], suffix, marks[2], middle)))
        plain = np.array([f == "plain" for f in forms])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(cuts[:, 0], pa.int64(), mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
            names=["row", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def transform(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs with doc_id and text to (row, n, form, prefix_chars, middle_chars, output), row with the columns of keep, or all of docs."""
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    return ready.mapInArrow(_cut, f"row {ready.schema['row'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The exact text from output and form. No mark is in a text that was cut, nor can one arise where a mark meets a piece."""
    between = lambda begin, end: F.substring(output, F.locate(begin, output) + len(begin), F.locate(end, output) - F.locate(begin, output) - len(begin))
    middle = F.substring(output, F.locate(MIDDLE, output) + len(MIDDLE), F.char_length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    digests = [F.sha2(x, 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (restore(F.col("output"), F.col("form")), "restored_sha256"))]
    return found.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
