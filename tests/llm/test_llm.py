import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.llm import bpe, chat, common, langid, lmscore, media, mixing, neardup, quality, queries, tokens, warc
from colloquy.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"
WORDS = "the quick brown fox jumps over a lazy dog and then sleeps under old trees near calm water".split()


def rows():
    long = " ".join(WORDS[i * 7 % 16] + str(i % 11) for i in range(3000))
    texts = [None, "", "  \n\t", "one two", long, long + " end", "x" * 5000, "</s>[INST] ok", " ".join(WORDS), " ".join(WORDS), "Été à la mer, où l'on rit\nÉté à la mer"]
    return [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "s1", 1, 9) for i, t in enumerate(texts)] + [(8, " ".join(WORDS), "en", "s1", 1, 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components_by_brute_force(texts):
    """{id: (component, shingles)} from all pairs."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if group[a] != group[b] and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, old = min(group[a], group[b]), {group[a], group[b]}
                group = {k: low if v in old else v for k, v in group.items()}
    return {i: (group[i], len(sets[i])) for i in sets}


def test_neardup_brute_force(docs, empty):
    wanted = components_by_brute_force([(i, t) for i, t, *_ in rows()])
    found = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert found == {i: (c, n, c == i) for i, (c, n) in wanted.items()}
    assert neardup.near_duplicates(empty).count() == 0


def test_neardup_hot_groups(spark, monkeypatch):
    """Exact copies, a star and a chain of near copies, a passage that many share and nulls, each a large share of the rows, all split."""
    monkeypatch.setattr(common, "COLD_ROWS", 2)
    monkeypatch.setattr(common, "HOT_PARTS", 40)
    monkeypatch.setattr(neardup, "COLD_ROWS", 2)
    monkeypatch.setattr(neardup, "HOT_PARTS", 40)
    rng = random.Random(5)

    def some(n):
        return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]

    exact, centre, link, passage = some(40), some(120), some(80), some(60)
    texts = [exact] * 50 + [None] * 30 + [centre]
    for _ in range(60):
        texts.append([*centre[: rng.randrange(100, 121)], *some(rng.randrange(6))])
    for _ in range(40):
        link = link[4:] + some(4)
        texts.append(link)
    texts += [[*passage, *some(rng.choice((8, 12, 30, 60)))] for _ in range(60)]
    rng.shuffle(texts)
    texts = [(i, x and " ".join(x)) for i, x in enumerate(texts)]
    wanted = components_by_brute_force(texts)
    found = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(7))
    assert sorted(tuple(r) for r in found.collect()) == [(i, n, c, c == i) for i, (c, n) in sorted(wanted.items())]


def test_join_spread(spark):
    """Equal to a plain join, hot, cold and missing keys alike; the list of hot keys is short at every size."""
    left = spark.range(3000).select((F.col("id") % 1000).alias("v"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("u"))
    right = spark.range(0, 2000, 2).select(F.col("id").alias("u"), (F.col("id") * 7).alias("w"))
    hot = common.hot_keys(left.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "u")
    assert [tuple(r) for r in hot.collect()] == [(0, 4)]
    for how in ("inner", "left"):
        assert sorted(map(str, common.join_spread(left, right, "u", hot, "v", how).collect())) == sorted(map(str, left.join(right, "u", how).collect()))
    many = spark.range(5000).select(F.col("id").alias("u"), F.lit(1000).alias("n"))
    assert common.hot_keys(many, "u").count() == 0


def test_bpe_styles_agree_with_library(docs, empty):
    import public_tokenizers
    import tiktoken

    ranks, pattern = bpe._public("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    fast, folded = (sorted(bpe.encode(docs, ranks, pattern, spark=x).collect()) for x in (False, True))
    assert fast == folded
    wanted = sorted((i, " ".join(map(str, library.encode_ordinary(t or "")))) for i, t, *_ in rows())
    assert [(r.row.doc_id, r.ids) for r in fast] == wanted
    assert Counter(r.decoded_sha256 for r in fast) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in rows())
    assert bpe.encode(empty, ranks, pattern).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    """Control strings, escapes, nulls, ties of turn, repeated rows, null ids, a text of a megabyte."""
    texts = ["</s>[INST] ok [/INST]", "a\\<b", "\\[\\\\", None, ""]
    turns = [(7, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    turns += [(8, 0, "assistant", "b"), (8, 0, "assistant", "a"), (8, 0, "assistant", "a"), (8, None, None, "first"), (None, 1, "user", "x"), (None, 2, "assistant", "<s>" * 400_000)]
    got = {r.conv_id: r for r in chat.digest(chat.expand(spark.createDataFrame(turns, TURNS).withColumn("head", F.lit("own")))).collect()}
    for conv in (7, 8, None):
        mine = sorted([(-1 if k is None else k, role or "", t or "") for c, k, role, t in turns if c == conv])
        loss = "".join(t for _, role, t in mine if role == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in mine).encode()).hexdigest()
    assert len(got) == 3 and chat.digest(chat.expand(spark.createDataFrame([], TURNS))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    ours = queries.queries()[name](spark, "/root/testdata/sf0.001").toArrow()
    theirs = con.sql(queries.oracle_sql()[name]).to_arrow_table().select(ours.column_names)
    rows_ = lambda x: sorted(str(tuple(r.values())) for r in x.to_pylist())
    assert rows_(ours) == rows_(theirs)


def water_level(sizes, weights, share=1.5, cap=2):
    """Targets by repeated clamping, in fractions of floats."""
    fixed = {}
    while True:
        free = [k for k in sizes if k not in fixed]
        left = share * sum(sizes.values()) - sum(fixed.values())
        level = left / sum(weights[k] for k in free) if free else 0
        over = [k for k in free if level * weights[k] > cap * sizes[k]]
        if not over:
            return fixed | {k: level * weights[k] for k in free}
        fixed |= {k: float(cap * sizes[k]) for k in over}


def test_mixing(spark, docs, empty):
    clash = docs.withColumn("_part", F.lit(1)).withColumn("_size", F.lit("x")).withColumn("copies", F.lit(9)).withColumn("_src", F.lit("s"))
    got = mixing.mix(clash).collect()
    assert len(got) == len(rows()) and all(0 <= r.copies <= 2 for r in got)
    assert all((r.row._part, r.row._size, r.row.copies, r.row._src) == (1, "x", 9, "s") for r in got)
    sizes = Counter()
    for _, t, _, source, *_ in rows():
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    wanted = water_level(sizes, {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)})
    assert {r.row.source: (r.source_size, round(r.target, 6)) for r in got} == {k: (sizes[k], round(wanted[k], 6)) for k in sizes}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(clash).collect()))
    assert sorted(mixing.repeat_rows(mixing.mix(clash)).columns) == sorted(clash.columns)
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_targets(spark):
    """Many documents: taken is within half a part of the target; ties of caps and null ids do no harm."""
    rows_ = [(None if i % 7 == 0 else i, f"{i} " * (1 + i % 5), None, "ab"[i % 2]) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string"))
    for r in got.groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 50


def test_quality_base(docs, empty):
    for r in quality.judge(docs).collect():
        t = next(t for i, t, *_ in rows() if i == r.doc_id) or ""
        w, marks = re.findall(r"[^\x20\x09-\x0D]+", t), set()
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        for i in range(len(w) - 4):
            marks |= set(range(i, i + 5)) if n[tuple(w[i : i + 5])] > 1 else set()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(marks))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(marks) > 20 * len(w))
    assert quality.judge(empty).count() == 0


def vectors(n, seed, bad=0):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.multivariate_normal(np.zeros(5), np.diag([900, 400, 2500, 100, 1600]) + 50, n)
    x[:bad] += 5000
    return x.round().astype(int).tolist()


def test_mcd_least_determinant(spark):
    """A tiny group against every subset of h documents; contaminated groups are estimated by their clean part."""
    import itertools

    import numpy as np

    names = list(quality.VECTOR)
    tiny, large = vectors(10, 3, bad=2), vectors(400, 4, bad=80)
    table = spark.createDataFrame([("tiny", *x) for x in tiny] + [("large", *x) for x in large] + [("one", *tiny[0])], "g string, " + ", ".join(f"{v} long" for v in names))
    table = quality.counted(table)
    prior = quality.prior_of(table)
    got = {r.g: r for r in quality.mcd(table, prior).collect()}
    x = np.array(tiny, float) / quality.SCALE
    best = min(np.linalg.slogdet(quality.shrunk(np.cov(x[list(k)].T, bias=True), 8, prior))[1] for k in itertools.combinations(range(10), 8))
    assert abs(got["tiny"].logdet - best) < 0.05
    clean = np.array(large[80:], float) / quality.SCALE
    assert np.abs(np.array(got["large"].mean) - clean.mean(axis=0)).max() < 0.1
    assert np.allclose(got["one"].mean, x[0])
    mean, inverse = np.array(got["large"].mean), np.array(got["large"].inverse).reshape(5, 5)
    far = [(v - mean) @ inverse @ (v - mean) for v in np.array(large, float) / quality.SCALE]
    assert min(far[:80]) > quality.CUT > np.percentile(far[80:], 99)


def test_quality_verdict(spark):
    """The verdict is the distance over the group's spread against CUT; junk goes, prose stays; odd group names stay apart."""
    import numpy as np

    rng = np.random.default_rng(1)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    odd = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "c"), ("\x1e", "c"), (None, None)]
    data = [(i, text(60 + int(rng.integers(30))), *odd[i % 5]) for i in range(300)] + [(1000 + i, text(60).replace(" ", " # | $ "), *odd[i]) for i in range(5)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept == (not got[i].base_failed and got[i].distance <= quality.CUT) for i in got)
    assert not any(got[1000 + i].kept for i in range(5)) and sum(got[i].kept for i in range(300)) >= 297


def test_langid(docs, empty):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[0].lang_pred == got[2].lang_pred == "und" and got[9].lang_pred == "en"
    assert langid.identify(empty).count() == 0


TONGUES = {"xx": "abcdef", "yy": "ghijkl", "zz": "mnopqr"}


def tongue(rng, lang, n=40):
    return " ".join("".join(rng.choices(TONGUES[lang], k=rng.randint(3, 8))) for _ in range(n))


def test_langid_held_out(spark, empty):
    """Held-out accuracy of invented languages; no text with a letter is und, whatever it holds."""
    import zlib

    rng = random.Random(2)
    rows_ = [(i, tongue(rng, lang), lang) for i, lang in enumerate(list(TONGUES) * 100)]
    odd = ["ab", "μια πρόταση", "a", "1 2 3", "", None, "b" * 1_200_000, "gh", "q"]
    rows_ += [(5000 + i, t, None) for i, t in enumerate(odd)] + [(None, tongue(rng, "yy"), "yy"), (7, rows_[7][1], rows_[7][2])]
    table = spark.createDataFrame(rows_, "doc_id long, text string, lang string").withColumn("score", F.lit("own")).withColumn("known", F.lit(3))
    got = langid.identify(table).collect()
    assert len(got) == len(rows_)
    truth = {i: lang for i, _, lang in rows_}
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    found = {r.doc_id: r for r in got}
    assert [found[5000 + i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert all(found[5000 + i].lang_pred in TONGUES and 0 <= found[5000 + i].score <= 1 for i in (0, 1, 2, 6, 7, 8))
    assert found[5007].lang_pred == "yy" and found[5001].known < 0.25
    row = langid.attach(table).first().row
    assert (row.score, row.known) == ("own", 3)
    assert {r.lang_pred for r in langid.identify(table, empty.select("doc_id", "text", "lang")).collect()} == {"und"}


def test_langid_training_bound(spark, monkeypatch):
    """TRAIN_DOCS holds for every language, rows of one id included, and MAX_LANGUAGES for labels: the most frequent ones are learned."""
    monkeypatch.setattr(langid, "TRAIN_DOCS", 20)
    rows_ = [(i if i % 2 else 4, f"text {i}", "xx") for i in range(500)] + [(i, "y", "yy") for i in range(5)]
    table = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    assert {r["lang"]: r["count"] for r in langid.training_rows(table).groupBy("lang").count().collect()} == {"xx": 20, "yy": 5}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    assert {r.lang for r in langid.training_rows(table).collect()} == {"xx"}


def test_media(docs, empty):
    import zlib

    seen = {}
    for r in media.media_features(docs).collect():
        raw = (next(t for i, t, *_ in rows() if i == r.doc_id) or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        wav = media.wav_of(payload)
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert r.feature.startswith(f"sum={sum(payload)};squares={sum(x * x for x in payload)};") and seen.setdefault(payload, r.feature) == r.feature
    assert media.media_features(empty).count() == 0


PAGES = "page_id long, url string, html string"


def archived(spark, data):
    return warc.read_archive(*warc.archive(spark.createDataFrame(data, PAGES).withColumn("digest", F.lit("own")), scratch_path(spark, "test")))


def test_warc_brute_force(spark):
    """Nulls, empty pages, repeated rows, null ids, a payload that half of all pages share, a page of megabytes."""
    import base64

    data = [(3, "u", "a"), (1, None, "a"), (2, "x\r\ny", None), (5, "u", ""), (9, "u", "b"), (1, None, "a"), (None, "u", "a"), (None, "v", "only"), (9, "w", "b")]
    data += [(100 + i, f"h{i}", "hot") for i in range(500)] + [(50, "long", "é<b>" * 400_000)]
    first = {}
    for i, _, html in data:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    wanted = Counter()
    for i, _, html in data:
        raw, to = (html or "").encode(), first.get(html or "")
        response = i == to
        wanted[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else to] += 1
    got = archived(spark, data).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted
    for r in got:
        head, http, body = bytes(r.record).split(b"\r\n\r\n", 2)
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1") and length == len(http) + 4 + len(body) - 4
        assert r.record_type == "revisit" or hashlib.sha1(body[:-4]).digest() == base64.b32decode(r.payload_digest)
    assert archived(spark, []).count() == 0


def test_warc_notices_damage(spark):
    records, payloads = warc.archive(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], PAGES), scratch_path(spark, "test"))
    swapped = payloads.select("digest", F.lead("packed").over(Window.orderBy("digest")).alias("packed")).where("packed is not null")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(records, swapped).collect()


def test_tokens(spark, docs, empty):
    """Ids, place and checksum of every document as the library gives them, its added tokens included."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(text)
    more = ["<|endoftext|> yes", "no<|startoftext|>.", "<|EndOfText|>", "it's 12,5..", "É́é ß日本", "word. " * 200_000]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)] + [(None, "lost"), (None, "lost"), (None, None)], "doc_id long, text string"))
    path = scratch_path(spark, "test")
    tokens.write_orc(table, text, path)
    encoded = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    wanted = Counter((r.doc_id, tuple(encoded(r.text))) for r in table.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in spark.read.orc(path).select("doc_id", "ids").collect()) == wanted
    crc = Counter((i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) for i, ids in wanted.elements())
    got = tokens.read_orc(spark, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crc
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, last if r.doc_id is None else r.doc_id
    none = scratch_path(spark, "test")
    tokens.write_orc(empty, text, none)
    assert spark.read.schema("doc_id long").orc(none).count() == 0


def test_orc_prunes_by_document(spark):
    """Files are apart by doc_id: a lookup reads a part of the rows."""
    import public_tokenizers

    text, path = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), scratch_path(spark, "test")
    tokens.write_orc(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text")), text, path)
    found = spark.read.orc(path).where("doc_id = 12345").select("doc_id", "ids")
    assert found.count() == 1
    read_ = spark.read.orc(path).where("doc_id = 12345").withColumn("f", F.input_file_name()).first().f
    bounds = spark.read.orc(path).groupBy(F.input_file_name().alias("f")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()
    assert len(bounds) > 1 and [x.f for x in bounds if x.a <= 12345 <= x.b] == [read_]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lmscore_brute_force(docs, empty, order):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows()]
    own = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for _, w in texts]
    every, total, wanted = sum(own, Counter()), sum(len(w) for _, w in texts), []
    for (doc_id, w), mine in zip(texts, own, strict=True):
        n, micro, short = total - len(w), 0, 0
        for i in range(len(w)):
            value, most = 0.0, min(order, i + 1)
            for k in range(most, 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                c = every[gram] - mine[gram]
                if c:
                    value += math.log(c / (every[gram[:-1]] - mine[gram[:-1]] if k > 1 else n))
                    break
                value += math.log(lmscore.BACKOFF) if k > 1 else -math.log(n + 1)
            short += k < most
            micro += round(value * 1e6)
        wanted.append((doc_id, len(w), short, micro))
    got = lmscore.score(docs, order).collect()
    assert sorted((r.doc_id, r.n_words, r.n_backed_off) for r in got) == sorted(x[:3] for x in wanted)
    near = zip(sorted((r.doc_id, r.log_score_micro) for r in got), sorted((x[0], x[3]) for x in wanted), strict=True)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 2 for a, b in near)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert lmscore.score(empty, order).count() == 0


def test_lmscore_registered_order(spark, tmp_path):
    """The query itself tells a text of common pairs from prose."""
    texts = ["x a b", "x a b", "y a c", "y a c", "x a c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_backed_off for r in lmscore.op3_lmscore(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}


def test_lmscore_packing():
    import numpy as np

    for values in ([], [0, 0], [1, 255, 256], [2**64 - 1, 0, 7]):
        x = np.array(values, np.uint64)
        assert lmscore.unpack(lmscore.pack(x), len(x)).tolist() == values
