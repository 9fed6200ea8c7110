"""Sharding, fill-in-the-middle and conversation repair against brute force, and at the edges."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import fim, langid, neardup, repair, sharding, tokens
from colloquy.llm.common import scratch_path

DOCS = "doc_id long, text string, row string, n long, output string, shard int, node long"
TURNS = "conv_id long, turn long, role string, text string, fault string, seen string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1, "own", 99, 7) for i, t in rows], DOCS)


def test_rank_and_select():
    rng = random.Random(3)
    for n in (0, 1, 7, 63, 64, 65, 511, 512, 513, 5000):
        text = "".join(rng.choice(["a", "é", "€", "𝄞", "\0"]) for _ in range(n))
        data = text.encode()
        bits = fim.Boundaries(np.frombuffer(data, np.uint8))
        starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
        at = np.arange(len(data) + 1)
        assert bits.rank(at).tolist() == [sum(s < i for s in starts) for i in at] if n <= 513 else bits.rank(at[-1:]).tolist() == [n]
        if n:
            assert bits.select(np.arange(n)).tolist() == starts


def cut(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_brute_force(spark):
    """Nulls, empty and very long texts, marks and their halves, wide code points, repeated rows, null ids, clashing columns."""
    rng = random.Random(4)
    rows = [(None, "abc"), (None, None), (1, ""), (2, None), (3, "x<M>y"), (4, "<" * 9 + "P>"), (5, "wörd " * 300_000), (6, "𝄞" * 40), (6, "𝄞" * 40), (6, "a\0b")]
    rows += [(i, "".join(rng.choice("a<S>P€𝄞 \n") for _ in range(rng.randrange(60)))) for i in range(10, 400)]
    docs = docs_of(spark, rows)
    got = Counter((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.transform(docs).collect())
    assert got == Counter((i, *cut(i, t)) for i, t in rows) and {x[2] for x in got} == {"plain", "psm", "spm"}
    back = fim.transform(docs).select("row.doc_id", "row.output", fim.restore(F.col("output"), F.col("form")).alias("t"))
    back = fim.transform(docs).select("row.doc_id", F.col("row.output").alias("own"), fim.restore(F.col("output"), F.col("form")).alias("t"))
    assert Counter(map(tuple, back.collect())) == Counter((i, "own", t or "") for i, t in rows)
    assert fim.transform(docs.limit(0)).count() == 0


def legal(letters):
    rest = letters.removeprefix("s")
    return letters == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def cheapest(turns):
    """All edits with at most two insertions in each gap, by trial."""
    found = []
    for own in product("KRD", repeat=len(turns)):
        for gaps in product(range(3), repeat=len(turns) + 1):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(gaps):
                audit, cost, out = audit + "I" * gap, cost + 2 * gap, out + [None] * gap
                if i < len(turns):
                    role, text, fault = turns[i]
                    audit += own[i]
                    if own[i] == "D":
                        cost += 3
                        continue
                    if fault in ("blank", "duplicate"):
                        break
                    cost += (fault == "truncated") + (2 if own[i] == "R" else 0)
                    out.append(None if own[i] == "R" else role[:1] or "?")
            else:
                if out[:1] == ["s"] and len(out) > 1:
                    letters = "s" + "".join(x or "ua"[k % 2] for k, x in enumerate(out[1:]))
                else:
                    letters = "".join(x or "ua"[k % 2] for k, x in enumerate(out))
                if legal(letters):
                    found.append((cost, audit))
    return min(found)


def test_repair_brute_force(spark):
    rng = random.Random(8)
    turns, wanted = [], {}
    for conv in range(60):
        n = rng.randrange(4)
        rows = [(k, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["Hello.", "Hm", " \n", "Well. ", "So?", "Yes!\t"])) for k in range(n)]
        turns += [(conv, k, role, text, "own", "own", False) for k, role, text in rows] or [(conv, 0, "user", "x", "own", "own", True)]
        seen, flagged = set(), []
        for _, role, text in rows:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            flagged.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        wanted[conv] = (cheapest(flagged), Counter(f for *_, f in flagged), sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in zip(flagged, flagged[1:], strict=False)))
    frame = spark.createDataFrame(turns, TURNS + ", gone boolean")
    got = {r.conv_id: r for r in repair.repair(repair.faults(frame.drop("fault", "seen"))).collect()}
    assert set(got) == set(wanted)
    for conv, ((cost, audit), counts, illegal) in wanted.items():
        r = got[conv]
        assert (r.cost, r.audit, r.illegal, r.gaps) == (cost, audit, illegal, 0), conv
        assert (r.blank, r.duplicate, r.truncated) == (counts["blank"], counts["duplicate"], counts["truncated"])
        assert legal("".join(t.role[0] for t in r.repaired)) and len(r.repaired) == len(audit) - audit.count("D")
        assert sum(t.text == "" for t in r.repaired) >= audit.count("I")


def test_damage_and_edges(spark):
    """Each kind of damage, nulls in every column, ties of turn, repeated rows, a long conversation, an empty table."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Text {k}. Done!") for k in range(200)]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (2, None, "user", "a."), (2, 5, "user", "b."), (2, 5, "user", "b."), (2, 9, "assistant", None), (3, 1, "user", "x" * 200_000)]
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], TURNS)
    kinds = [zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, *_ in rows]
    assert set(range(5)) <= set(kinds)
    wanted = Counter()
    for (c, t, role, text), kind in zip(rows, kinds, strict=True):
        text = "" if kind == 1 else "".join(x for x in text or " " if kind != 2 or x not in ".!?")
        if kind:
            wanted[c, t, "user" if kind == 4 else role or " ", text] += 2 if kind == 3 else 1
    hurt = repair.damage(frame)
    assert Counter(tuple(r)[:4] for r in hurt.where("not gone").collect()) == wanted
    out = {r.conv_id: r for r in repair.repair(repair.faults(hurt)).collect()}
    assert set(out) == {1, 2, 3, None}
    ones = [x for x in wanted if x[0] == 1]
    assert out[1].gaps == max(x[1] for x in ones) - min(x[1] for x in ones) + 1 - len({x[1] for x in ones})
    assert out[1].duplicate == sum(wanted[x] - 1 for x in ones) and legal("".join(t.role[0] for t in out[1].repaired))
    assert repair.repair(repair.faults(repair.damage(frame.limit(0)))).count() == 0
    nothing = repair.repair(repair.faults(hurt.where("conv_id = 1").withColumn("gone", F.lit(True)))).first()
    assert tuple(nothing)[1:8] == (0, 0, 0, 0, 0, 0, "") and nothing.repaired == []


def check_law(rows, n, shards=16):
    """Counts at most one apart, slots gapless, sizes and check sums right."""
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and sorted((sizes[j] for j in range(shards)), reverse=True) == sharding.quotas(n, shards)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("parts", [1, 5])
def test_shards_by_law(spark, parts):
    """A text on a third of the rows, groups of copies, nulls, repeated rows, clashing columns."""
    rows = [(i, "copy of all") for i in range(300)] + [(i, f"group {i // 6}") for i in range(300, 600)] + [(i, f"alone {i}") for i in range(600, 880)]
    rows += [(None, None)] * 10 + [(900, "")] * 5 + [(None, "né")] * 5
    random.Random(1).shuffle(rows)
    got = sharding.place(docs_of(spark, rows).repartition(parts)).collect()
    check_law(got, len(rows))
    wanted = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.row.doc_id, r.size, r.text_crc32) for r in got) == wanted and {r.row.shard for r in got} == {99}
    where = defaultdict(Counter)
    for r in got:
        where[r.text_crc32][r.shard] += 1
    texts = {zlib.crc32(t.encode()): t for _, t in rows if t}
    split = [k for k, c in where.items() if len(c) > 1 and texts.get(k) != "copy of all"]
    assert len(split) <= 10  # of 53 groups; the text of all rows can't lie in one shard


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(1, "a"), (1, "a"), (None, None)], [(i, "same") for i in range(100)], [(i, str(i)) for i in range(100)]])
def test_shards_at_the_edges(spark, rows):
    check_law(sharding.place(docs_of(spark, rows)).collect(), len(rows))


def test_given_links(spark):
    """Links between texts pull documents together; ids that no document has, loops and repeated links change nothing."""
    rows = [(i, f"text {i}") for i in range(160)]
    links = spark.createDataFrame([(i, i - i % 5) for i in range(160)] + [(1, 10_000), (3, 0)], "a long, b long")
    got = sharding.place(docs_of(spark, rows), 8, links).collect()
    check_law(got, 160, 8)
    at = {r.row.doc_id: r.shard for r in got}
    assert sum(at[i] != at[i - i % 5] for i in range(160)) < 56  # 128 links, 112 cut by chance


def test_flows():
    """No shard gains more than its room, full shards exchange, nothing moves that does not want to."""
    rng = np.random.default_rng(1)
    for turn in range(50):
        wanted = rng.integers(0, 40, (6, 6)) * (rng.random((6, 6)) < 0.5)
        np.fill_diagonal(wanted, 0)
        room = rng.integers(-5, 12, 6)
        flow = sharding.flows(wanted, room, turn, 7)
        assert (flow >= 0).all() and (flow <= wanted).all()
        held = sharding._within(flow, room)
        assert (held.sum(axis=0) - held.sum(axis=1) <= np.maximum(room, 0)).all() and ((held == flow) | (held == 0)).all()
    even = np.full((4, 4), 9) - 9 * np.eye(4, dtype=int)
    assert (sharding.flows(even, np.zeros(4), 0, 7) == even).all()


def test_propagation_brute_force(spark):
    """Against all single moves: where it ends, no node that would cut fewer links finds room; quotas hold on the way."""
    rng = random.Random(2)
    links = [(rng.randrange(40) + 40 * c, rng.randrange(40) + 40 * c) for c in range(8) for _ in range(160)] + [(rng.randrange(320), rng.randrange(320)) for _ in range(60)]
    weights = {i: rng.choice((1, 1, 2, 3)) for i in range(320)}
    quota = [int(1.3 * sum(weights.values()) / 8)] * 8
    nodes = spark.createDataFrame(list(weights.items()), "node long, weight long")
    edges = spark.createDataFrame([x for x in links if x[0] != x[1]], "u long, v long")
    found = {r.node: r.shard for r in sharding.propagate(nodes, edges, quota, rounds=40).collect()}
    assert set(found) == set(weights)
    loads = Counter()
    for i, j in found.items():
        loads[j] += weights[i]
    assert all(loads[j] <= q + max(1, int(sharding.SLACK * q)) for j, q in enumerate(quota))
    near = defaultdict(Counter)
    for u, v in links:
        if u != v:
            near[u][found[v]] += 1
            near[v][found[u]] += 1
    movers = [i for i in weights for j, n in near[i].items() if n > near[i][found[i]] and loads[j] + weights[i] + 8 <= quota[j]]
    assert len(movers) <= 16
    cut = sum(found[u] != found[v] for u, v in links)
    placed = spark.createDataFrame(list(found.items()), "node long, shard int")
    assert tuple(sharding.cut_links(edges, placed).first()) == (sum(u != v for u, v in links), cut)
    assert cut < 0.5 * 7 / 8 * len(links)


def test_parity_filter_loses_no_link(spark):
    """On pairs of sets of all sizes and similarities: no linked pair is dropped, and most pairs of similarity 0.6 are."""
    rng, rows, linked = np.random.default_rng(5), [], []
    for k in range(600):
        n = int(rng.choice([1, 2, 3, 7, 20, 100, 256, 257, 900, 3000, 9000]))
        share = float(rng.choice([0.3, 0.6, 0.72, 0.75, 0.76, 0.9, 1.0]))
        both = max(1, round(n * 2 * share / (1 + share)))
        extra = n - both
        pool = rng.integers(0, 2**63, both + 2 * extra + 3).astype(np.uint64)
        a, b = pool[: both + extra], np.concatenate([pool[:both], pool[both + extra : both + 2 * extra + int(rng.integers(3))]])
        rows.append([k, *[x for s in (a, b) for x in (len(s), neardup.parities(s, neardup.CELLS).tolist(), neardup.parities(s, neardup.WIDE_CELLS).tolist() if len(s) > neardup.WIDE_FROM else None)]])
        meet = len(np.intersect1d(a, b))
        linked.append((100 * meet >= 75 * (len(a) + len(b) - meet), share, n))
    kind = "struct<n:long,odd:array<long>,wide:array<long>>"
    frame = spark.createDataFrame([(k, (n, x, y), (m, u, v)) for k, n, x, y, m, u, v in rows], f"k long, a {kind}, b {kind}")
    kept = {r.k for r in frame.where(neardup.maybe_similar("a", "b")).select("k").collect()}
    assert all(k in kept for k, (is_linked, *_) in enumerate(linked) if is_linked)
    apart = [k for k, (_, share, n) in enumerate(linked) if share <= 0.6 and 20 <= n <= 900]
    assert sum(k in kept for k in apart) < 0.05 * len(apart)


def test_neardup_edges(spark):
    """Null ids, one id with two texts of which only one is linked, repeated rows, clashing columns, an empty table."""
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    long = words(80)
    near = " ".join([*long[:78], "x", "y"])
    rows = [(1, " ".join(long)), (5, near), (5, " ".join(words(50))), (None, near), (None, None), (None, " ".join(words(9))), (7, ""), (7, ""), (8, "a b c"), (9, "A b\tC")]
    frame = spark.createDataFrame([(i, t, 1, "own", 2) for i, t in rows], "doc_id long, text string, rep long, bucket string, cls long")
    got = Counter(map(tuple, neardup.near_duplicates(frame).select("doc_id", "component_id", "kept").collect()))
    assert got == Counter([(1, 1, True), (5, 1, False), (5, 1, False), (None, 1, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 8, True), (9, 8, False)])
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def grams_of(text, n):
    """n-grams of letters in lower case, words apart, as texts."""
    low = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in low:
        low = low.replace("  ", " ")
    return [low[i : i + n] for i in range(len(low) - n + 1)]


def test_language_filter_against_exact_sets(spark):
    """Corrected popcounts of the filter near those of exact sets, in a sparse filter and in one so dense that half of all hits are false."""
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(70)]
    for slots in (1 << 18, 1 << 13):
        words = np.zeros((slots, 2), np.uint64)
        for i, s in enumerate(sets):
            for slot in langid.slots_of(s, slots):
                np.bitwise_or.at(words[:, i // 64], slot, np.uint64(1) << np.uint64(i % 64))
        model = langid.BitSlicedFilter([f"l{i:02d}" for i in range(70)], words)
        query = np.concatenate([sets[5][:900], sets[69][:300], rng.integers(0, 2**63, 1800).astype(np.uint64)])
        exact = np.array([np.isin(query, s).sum() for s in sets])
        raw = np.array([np.count_nonzero(model.masks(query)[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(70)])
        assert (raw >= exact).all() and np.abs(model.hits(query) - exact).max() < (10 if slots > 1 << 13 else 150)
        if slots == 1 << 13:
            assert (raw - exact).max() > 500
        assert int(model.hits(query).argmax()) == 5


def test_language_id_brute_force(spark):
    """The whole prediction against exact sets of n-grams; held-out documents, nulls and texts without letters; labels beyond the bound."""
    rng = random.Random(11)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmno"}
    some = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randrange(2, 7))) for _ in range(n))
    rows = [(i, some(lang, rng.randrange(3, 40)), lang) for i, lang in enumerate(rng.choices(list(letters), [5, 2, 1], k=500))]
    rows += [(900, None, "aa"), (901, "12 34!", "aa"), (902, some("bb", 30), None), (None, some("cc", 30), None)]
    docs = spark.createDataFrame([(i, t, x, "own") for i, t, x in rows], "doc_id long, text string, lang string, row string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    train = [(t, x) for i, t, x in rows if t is not None and x is not None and not held(i)]
    n_docs = Counter(x for _, x in train)
    known = {}
    for lang in letters:
        for n in (4, 3, 2, 1):
            per = Counter(g for t, x in train if x == lang for g in set(grams_of(t, n)))
            known[lang, n] = {g for g, c in per.items() if c >= max(min(langid.MIN_DOCS, n_docs[lang]), langid.MIN_SHARE * n_docs[lang])}
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            assert (i, "und") in got
            continue
        for n in (4, 3, 2, 1):
            hits = {x: sum(g in known[x, n] for g in grams_of(t, n)) for x in letters}
            if any(hits.values()):
                best = sorted(hits, key=lambda x: (-hits[x], x))
                if hits[best[0]] > 1.05 * hits[best[1]] + 1:  # the filter is exact but for a few false positives
                    assert (i, best[0]) in got
                break


@pytest.mark.parametrize("labels", [70, 700])
def test_many_languages(spark, monkeypatch, labels):
    """More values of lang than bits in a long, and more than the filter has room for: no crash, the bound's languages are learned."""
    rng = random.Random(labels)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(labels)}
    rows = [(i, " ".join(rng.choices(words[f"l{i % labels:03d}"], k=20)), f"l{i % labels:03d}") for i in range(12 * labels)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    right = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    if labels == 70:
        monkeypatch.setattr(langid, "MAX_LANGUAGES", 50)
        assert langid.identify(docs).select("lang_pred").distinct().count() <= 50


def test_training_rows_are_bounded(spark, monkeypatch):
    """At most the bound of each language, exactly the bound where there are enough rows, whatever the ids."""
    monkeypatch.setattr(langid, "TRAIN_DOCS", 40)
    rows = [(None if i % 2 else i, f"text {i}", "aa" if i % 10 else "bb") for i in range(3000)] + [(None, "same", "cc")] * 30
    got = Counter(r.lang for r in langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    assert got == {"aa": 40, "bb": 40, "cc": 30}


def test_orc_files_prune(spark):
    """Files hold Bloom filters on doc_id and row indexes, in stripes by ascending id; a search for an id that no row has reads no row."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = scratch_path(spark, "orc")
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    tokens.write_orc(docs, tokenizer_json, path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = [x.getPath() for x in at.getFileSystem(conf).listStatus(at) if x.getPath().getName().endswith(".orc")]
    ends = []
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        kinds = set()
        for stripe in reader.getStripes():
            assert stripe.getIndexLength() > 0
            footer = reader.rows().readStripeFooter(stripe) if hasattr(reader.rows(), "readStripeFooter") else None
            kinds |= {s.getKind().toString() for s in footer.getStreamsList()} if footer is not None else set()
        assert not kinds or {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
        statistics = reader.getStatistics()[1]
        ends.append((statistics.getMinimum(), statistics.getMaximum()))
    ends.sort()
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0 and ends[-1][1] == 39_998

    def rows_read(i):
        found = spark.read.orc(path).where(F.col("doc_id") == i).select("ids")
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        scan = [p for p in [plan, *(plan.collectLeaves().apply(k) for k in range(plan.collectLeaves().size()))] if "Scan" in p.nodeName()]
        return len(rows), min(p.metrics().apply("numOutputRows").value() for p in scan)

    assert rows_read(1000)[0] == 1 and rows_read(1000)[1] <= 1000  # one row group, by its minimum and maximum
    assert rows_read(1001) == (0, 0)  # within a row group's limits, but not in its Bloom filter
