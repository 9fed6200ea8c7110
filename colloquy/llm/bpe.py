"""Byte-level BPE: ranked merges folded over distinct words; decoding concatenates binary pieces.

A pass over each task's documents splits texts by the tokenizer's pattern. A distinct word is encoded
once as long as a dictionary knows it, by ranked merges over its bytes; documents are put together from
words. There is no shuffle. Dictionaries end at MEMO_WORDS words, so memory is bounded.

The merges are a fold by Spark's higher-order functions: workers number the words, `aggregate` merges
in every step the adjacent pair of lowest rank (leftmost on ties), and workers put documents together
again, over the same rows in the same order. An entry of the folded array is a number: the rank of the
pair that begins there, its place and its id, so that the least entry is the next merge and a step looks
up two ranks; ranks are literal arrays under a perfect hash. `spark=False` runs the same merges in the
worker that splits the text, and gives the same ids. Words over FOLD_BYTES bytes, for which the fold's
square of the length is too much, take them from a heap in either style.

Results at the edges: null text is empty, with no ids; repeated rows are encoded alike; an empty
table gives an empty result; a null doc_id is kept; the columns named in keep come back in a
struct of their own, so that no name can clash, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import random
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import merged_splits, read

#: A place in a word has PLACE_BITS.
FOLD_BYTES, PLACE_BITS = 64, 6
#: Words after which a worker begins a new dictionary; the one before it still answers, so frequent words stay known.
MEMO_WORDS = 1 << 18
#: Numbered words after which both dictionaries and the words' ids are forgotten.
MOST_NUMBERS = 1 << 21
#: Ids and ranks are under PAIR.
PAIR_BITS = 17
PAIR = 1 << PAIR_BITS
NO_RANK = 1 << 30
RANK_BITS = PAIR_BITS + PLACE_BITS
_ROWS = 256
#: Words that are put together at once, or those of one document.
_WORDS = 1 << 16


def load_ranks(lines: list[bytes]) -> dict[bytes, int]:
    """Ranks of byte strings from a .tiktoken file's lines."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return load_ranks(f.readlines())


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Ids of adjacent pairs to the id of both as one, for every way to cut a piece in two."""
    return {(ranks[x[:i]], ranks[x[i:]]): r for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks}


def perfect_hash(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """(shifts, slots): key a * PAIR + b is in slot (key + shifts[key % len(shifts)]) % len(slots), as key * PAIR + id; free slots are -1."""
    keys = {a * PAIR + b: r for (a, b), r in pairs.items()}
    n_slots, n_groups = len(keys) * 4 // 3 | 1, len(keys) // 3 | 1
    groups: list[list[int]] = [[] for _ in range(n_groups)]
    for k in keys:
        groups[k % n_groups].append(k)
    while any(len({k % n_slots for k in g}) < len(g) for g in groups):
        n_slots += 2
    shifts, slots, free, draw = [0] * n_groups, [-1] * n_slots, 0, random.Random(0)
    for i in sorted(range(n_groups), key=lambda i: -len(groups[i])):
        at = draw.randrange(n_slots)
        while len(groups[i]) > 1 and any(slots[(k + at) % n_slots] >= 0 for k in groups[i]):
            at = draw.randrange(n_slots)
        if len(groups[i]) == 1:
            while slots[free] >= 0:
                free += 1
            at = (free - groups[i][0]) % n_slots
        shifts[i] = at
        for k in groups[i]:
            slots[(k + at) % n_slots] = k * PAIR + keys[k]
    return shifts, slots


def literal_array(values: list[int]) -> Column:
    """array<bigint>; constant folding makes it one literal, which no row builds again."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<bigint>")


def _with(value: Column, like: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) of the type that like has, value computed once; unlike an element of an array, an aggregate does not derive its type again for each row."""
    return F.aggregate(F.array_repeat(value, 1), like, lambda _, x: use(x))


def merge_fold(ranks: dict[bytes, int]) -> Callable[[Column], Column]:
    """A word's bytes (array<int>) to its token ids, as the low PAIR_BITS of each entry of an array<bigint>."""
    pairs = pair_ranks(ranks)
    if max(ranks.values()) >= PAIR:
        raise ValueError(f"ids of {PAIR} and more")
    ids = [ranks[bytes([i])] for i in range(256)]
    # for a byte and the next (256: none) the first entry, at place 0
    first = literal_array([pairs.get((a, b), PAIR) << RANK_BITS | a for a in ids for b in (*ids, -1)])
    shifts, slots = perfect_hash(pairs)
    n_shifts, n_slots, shifts, slots = len(shifts), len(slots), literal_array(shifts), literal_array(slots)
    long = lambda x: F.lit(x).cast("long")
    id_of, place_of, none = lambda x: x.bitwiseAND(long(PAIR - 1)), lambda x: x.bitwiseAND(long((1 << RANK_BITS) - PAIR)), long(PAIR << RANK_BITS)

    def rank(a: Column, b: Column) -> Column:
        """The rank's bits of an entry; those of PAIR for no such pair, or none of b."""
        slot = lambda k: F.get(slots, ((k + F.get(shifts, (k % long(n_shifts)).cast("int"))) % long(n_slots)).cast("int"))
        found = lambda e, k: F.when(F.shiftright(e, PAIR_BITS) == k, F.shiftleft(id_of(e), RANK_BITS)).otherwise(none)
        return _with(F.shiftleft(a, PAIR_BITS).bitwiseOR(b), long(0), lambda k: _with(slot(k), long(0), lambda e: found(e, k)))

    def merged(parts: Column, low: Column, at: Column) -> Column:
        """parts with entry low, which has at others before it, and the next as one."""
        new = F.shiftright(low, RANK_BITS)
        one = rank(new, id_of(F.get(parts, at + 2))).bitwiseOR(place_of(low)).bitwiseOR(new)
        left = lambda x: rank(id_of(x), new).bitwiseOR(x.bitwiseAND(long((1 << RANK_BITS) - 1)))
        kept = F.filter(parts, lambda x, i: i != at + 1)
        return _with(one, parts, lambda y: F.transform(kept, lambda x, i: F.when(i == at, y).when(i == at - 1, left(x)).otherwise(x)))

    def step(parts: Column, _) -> Column:
        before = lambda low: _with(place_of(low), F.lit(0), lambda p: F.size(F.filter(parts, lambda x: place_of(x) < p)))
        return _with(F.array_min(parts), parts, lambda low: F.when(low < none, _with(before(low), parts, lambda at: merged(parts, low, at))).otherwise(parts))

    def fold(word: Column) -> Column:
        entry = lambda x, i: F.get(first, x * 257 + F.coalesce(F.get(word, i + 1), F.lit(256))).bitwiseOR(F.shiftleft(i.cast("long"), PAIR_BITS))
        return F.aggregate(word, F.transform(word, entry), step)

    return fold


def merge_with_heap(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges in O(n log n): a heap of (rank, place) over a linked list."""
    ids, right, left = list(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        right[i] = right[j]
        if right[i] < len(ids):
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < len(ids) and (q := pairs.get((ids[x], ids[y]))) is not None:
                heapq.heappush(heap, (q, x, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


def merge_short(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The merges by a scan of all adjacent pairs in each step; fastest for short words."""
    ranks = [pairs.get(x, NO_RANK) for x in zip(ids, ids[1:])]
    while ranks:
        low = min(ranks)
        if low == NO_RANK:
            break
        at = ranks.index(low)
        ids[at : at + 2] = [low]
        del ranks[at]
        if at:
            ranks[at - 1] = pairs.get((ids[at - 1], low), NO_RANK)
        if at < len(ranks):
            ranks[at] = pairs.get((low, ids[at + 1]), NO_RANK)
    return ids


class Pieces(dict):
    """A word to (number of ids, ids as text, decoded bytes), encoded at first sight."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs, self.byte_ids = pair_ranks(ranks), [ranks[bytes([i])] for i in range(256)]
        self.pieces = {r: x for x, r in ranks.items()}

    def __missing__(self, word: str) -> tuple[int, str, bytes]:
        raw = [self.byte_ids[x] for x in word.encode("utf-8", "surrogatepass")]
        self[word] = out = self.of((merge_short if len(raw) <= FOLD_BYTES else merge_with_heap)(raw, self.pairs))
        return out

    def of(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), " ".join(map(str, ids)), b"".join([self.pieces[x] for x in ids])


def _row(words: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes]:
    n, ids, raw = zip(*words, strict=True) if words else ((), (), ())
    return sum(n), " ".join(ids), b"".join(raw)


def _columns(rows: list[tuple[int, str, bytes]], with_ids: bool) -> list[pa.Array]:
    out = [pa.array([x[0] for x in rows], pa.int64())]
    out.append(pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in rows], pa.string()))
    out.append(pa.array([hashlib.sha256(x[2]).hexdigest() for x in rows], pa.string()))
    return [*out, pa.array([x[1] for x in rows], pa.string())] if with_ids else out


def _names(with_ids: bool) -> list[str]:
    return ["row", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]


def _encoder(pattern: str, ranks: dict[bytes, int], with_ids: bool):
    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, memo = regex.compile(pattern).findall, Pieces(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                rows = [_row([memo[w] for w in find(x or "")]) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), *_columns(rows, with_ids)], names=_names(with_ids))

    return encode_batches


class _Numbers(dict):
    """A word to its number, that in the dictionary before this one or else the next; new has the words that got one since it was last emptied."""

    def __init__(self, before: dict[str, int], count: int):
        self.before, self.count, self.new = before, count, []

    def __missing__(self, word: str) -> int:
        n = self.before.get(word)
        if n is None:
            n = self.count
            self.count += 1
            self.new.append(word)
        self[word] = n
        return n


def _numberer(pattern: str, memo_words: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document, its words as numbers (deflated, for batches are cut by rows); the first of each _ROWS has their new words, long ones apart by place."""
        import regex

        find, seen = regex.compile(pattern).findall, _Numbers({}, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                fresh = seen.count > MOST_NUMBERS
                if fresh:
                    seen = _Numbers({}, 0)
                elif len(seen) > memo_words:
                    seen.before = {}
                    seen = _Numbers(seen, seen.count)
                codes = []
                for text in part.column("text"):
                    words = find(text.as_py() or "")
                    codes.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)).tobytes())
                counts = [len(x) // 4 for x in codes]
                codes = [zlib.compress(x, 1) for x in codes]
                new, seen.new = [w.encode("utf-8", "surrogatepass") for w in seen.new], []
                long = [i for i, w in enumerate(new) if len(w) > FOLD_BYTES]
                long_words = [new[i] for i in long]
                for i in long:
                    new[i] = b""
                ends = np.cumsum([0, *map(len, new)], dtype=np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(new), np.uint8).astype(np.int32)))
                first = lambda x, n=part.num_rows: pa.ListArray.from_arrays(pa.array([0, *[len(x)] * n], pa.int32()), x)
                columns = [part.column("row"), pa.array(codes, pa.binary()), pa.array(counts, pa.int32()), pa.array([fresh, *[False] * (part.num_rows - 1)]), first(words), first(pa.array(long, pa.int32())), first(pa.array(long_words, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "codes", "n_words", "fresh", "new_words", "long_at", "long_words"])

    return number


class _Pool:
    """Ids of numbered words, end to end."""

    def __init__(self):
        self.ids, self.ends, self.words = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    @staticmethod
    def _put(held: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
        if at + len(more) > len(held):
            held = np.concatenate([held, np.empty(max(len(held), len(more)), held.dtype)])
        held[at : at + len(more)] = more
        return held

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        last = self.ends[self.words]
        self.ids = self._put(self.ids, last, ids)
        self.ends = self._put(self.ends, self.words + 1, last + np.cumsum(sizes))
        self.words += len(sizes)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and each word's number of them."""
        starts, sizes = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        return self.ids[np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)], sizes


def _joined(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The pieces of ids from one end to the next, end to end."""
    found = pieces.take(pa.array(ids))
    _, offsets, data = found.buffers()
    cuts, data = np.frombuffer(offsets, np.int64)[ends].tolist(), memoryview(data if data is not None else b"")
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _assembler(ranks: dict[bytes, int], with_ids: bool):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {r: x for x, r in ranks.items()}
        size = max(by_id) + 1
        pieces = pa.array([by_id.get(i) for i in range(size)], pa.large_binary())
        numbers = pa.array([b" %d" % i for i in range(size)], pa.large_binary())
        heap: Pieces | None = None  # for long words alone
        pool = _Pool()
        for batch in batches:
            fresh, counts = batch.column("fresh").to_numpy(zero_copy_only=False), batch.column("n_words").to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                # documents up to _WORDS words, as long as the next has no new dictionary
                end, total = at + 1, counts[at]
                while end < batch.num_rows and total + counts[end] <= _WORDS and not fresh[end]:
                    total += counts[end]
                    end += 1
                part = batch.slice(at, end - at)
                if fresh[at]:
                    pool = _Pool()
                new = part.column("new_ids").flatten()
                ids, sizes = new.flatten().to_numpy().astype(np.int32) & (PAIR - 1), np.diff(new.offsets.to_numpy())
                long_words = part.column("long_words").flatten().to_pylist()
                if long_words:
                    heap = heap or Pieces(ranks)
                    # places count from each row's first new word
                    firsts = np.repeat(part.column("new_ids").offsets.to_numpy()[:-1] - part.column("new_ids").offsets[0].as_py(), pc.list_value_length(part.column("long_at")).to_numpy())
                    lists = np.split(ids, np.cumsum(sizes)[:-1])
                    for i, w in zip((firsts + part.column("long_at").flatten().to_numpy()).tolist(), long_words, strict=True):
                        lists[i] = np.array(merge_with_heap([heap.byte_ids[x] for x in w], heap.pairs), np.int32)
                    ids, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
                pool.add(ids, sizes)
                ids, sizes = pool.of(np.concatenate([np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32) for x in part.column("codes")]).astype(np.int64))
                ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts[at:end])))]
                texts = [x[1:] for x in _joined(numbers, ids, ends)]
                columns = [part.column("row"), pa.array(np.diff(ends)), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([hashlib.sha256(x).hexdigest() for x in _joined(pieces, ids, ends)])]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([str(x, "ascii") for x in texts], pa.string())] * with_ids], names=_names(with_ids))
                at = end

    return assemble


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None, with_ids: bool = True, spark: bool = True, memo_words: int = MEMO_WORDS) -> DataFrame:
    """docs (text and the columns of keep) to row (a struct of keep), n_tokens, ids_sha256, decoded_sha256, ids (decimal, joined by spaces).

    memo_words bounds a worker's dictionary and changes no result.
    """
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or ["doc_id"]]).alias("row"), "text")
    row = ready.schema["row"].dataType.simpleString()
    schema = ", ".join([f"row {row}, n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids string"] * with_ids])
    if not spark:
        return ready.mapInArrow(_encoder(pattern, ranks, with_ids), schema)
    numbered = merged_splits(ready).mapInArrow(_numberer(pattern, memo_words), f"row {row}, codes binary, n_words int, fresh boolean, new_words array<array<int>>, long_at array<int>, long_words array<binary>")
    folded = numbered.withColumn("new_ids", F.transform("new_words", merge_fold(ranks))).drop("new_words")
    return folded.mapInArrow(_assembler(ranks, with_ids), schema)


@cache
def _public(name: str) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = _public("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return encode(docs, ranks, pattern, with_ids=False).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
