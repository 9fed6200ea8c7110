"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Statistics of a text are transformed to integers of 1/256, so sums of them and of their products
are exact and order-free. Each language and source is a group with an estimate of its own. Several
starts go side by side: medians and quartiles, all documents, and ELEMENTS seeded draws of d + 1
vectors. A concentration step takes the h = 75 % of the group nearest by Mahalanobis distance and
computes their mean and covariance; steps go on until no start's determinant falls, and the start
of the least determinant wins. All documents count in every step: vectors are integers, so documents
of one vector are one row with their count, and a step is one aggregation of counts, sums and
products of these rows by group, start and bin of distance. No group meets in one task; what meets
there is one row a start and bin. A step that gains less than GAIN ends its start, and regularized
determinants have a lower bound, so all starts end.

Covariances are regularized: a diagonal of the whole table's squared robust scales counts as PRIOR
documents of the group. That holds alike for groups of every size, so a small group is judged by
the table's scales around its own centre, a large one by its own.

Results at the edges: null text has no words and fails the base rules; null lang or source is a
value of its own; a document alone in its group is its own centre and is kept if it passes the base
rules; ties in distance share a bin and a verdict; repeated rows each count; null and repeated
doc_ids are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, materialize, read, windows

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
SCALE = 256
#: Statistics of the vector; the least standard deviation of each, so that a constant statistic rejects nothing by itself.
VECTOR = {"v_words": 0.5, "v_word_chars": 0.05, "v_symbols": 0.5, "v_dup_lines": 0.3, "v_repeats": 0.3}
#: Squared distance, in units of the group's usual spread, beyond which a document is an outlier. On the training fold of sf0.1
#: (crc32 of the id not 2 modulo 4) it parts labelled junk from clean documents best.
CUT = 90.0
#: The median of chi-square with 5 degrees of freedom (fixed value).
CHI2_MEDIAN = 4.351460191095526
#: Share of a group that estimates it, documents that the prior counts as, seeded starts, least gain of a step in log determinant.
COVERAGE, PRIOR, ELEMENTS, GAIN = 0.75, 50.0, 3, 1e-3
BINS_PER_DOUBLING = 32

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_WHITE = " \t\n\r\x0b\x0c"


def _repeated(h: np.ndarray) -> int:
    """Words in windows found twice or more."""
    if len(h) < WINDOW:
        return 0
    _, back, n = np.unique(windows(h, WINDOW), return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[back] > 1)
    if not len(again):
        return 0
    marks = np.zeros(len(h) + 1, np.int32)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def base_statistics(text: str | None, memo: WordHashes) -> tuple[int, int, int, int, int, int]:
    """BASE and the number of lines with a word."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    chars = len(text) - sum(map(text.count, _WHITE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(memo.of(words)), len(lines)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        rows = np.array([base_statistics(x, memo) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, 6)
        keep = [batch.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(rows[:, i]) for i in range(6))], names=["doc_id", "lang", "source", *BASE, "n_lines"])


def measure(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*BASE, "n_lines"])
    out = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(_measure, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    words = F.greatest("n_words", F.lit(1))
    vector = {
        "v_words": F.log1p("n_words"),
        "v_word_chars": F.log1p(F.col("word_chars") / words),
        "v_symbols": F.log1p(100 * F.col("n_symbols") / words),
        "v_dup_lines": F.log1p(10 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "v_repeats": F.log1p(10 * F.col("n_repeat_words") / words),
    }
    return out.withColumn("base_failed", failed).withColumns({k: F.round(v * SCALE).cast("long") for k, v in vector.items()})


def group_of() -> Column:
    """A document's group: language and source, nulls apart from all strings."""
    return F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")))


def shrunk(cov: np.ndarray, n: float, prior: np.ndarray) -> np.ndarray:
    """A covariance of n documents with the prior's diagonal as PRIOR more."""
    return (n * cov + PRIOR * np.diag(prior)) / (n + PRIOR)


def _state(g: str, k: int, mean: np.ndarray, cov: np.ndarray, n: float, prior: np.ndarray, last: float | None = None) -> tuple:
    cov = shrunk(cov, n, prior)
    det = float(np.linalg.slogdet(cov)[1])
    return g, k, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), det, last is not None and not det <= last - GAIN


_STATE = "g string, k int, mean array<double>, inverse array<double>, logdet double, done boolean"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_D = len(VECTOR)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_SUMS = ["n", *(f"s{i}" for i in range(_D)), *(f"p{i}{j}" for i, j in _PAIRS)]


def moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a row of _SUMS over integers of 1 / SCALE."""
    n, mean = float(sums[0]), sums[1 : 1 + _D].astype(float) / float(sums[0])
    cross = np.zeros((_D, _D))
    for (i, j), x in zip(_PAIRS, sums[1 + _D :], strict=True):
        cross[i, j] = cross[j, i] = float(x) / n
    return mean / SCALE, (cross - np.outer(mean, mean)) / SCALE**2


def _starter(prior: np.ndarray):
    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for r in rows.to_dict("records"):
                q = np.array([r[f"q{i}"] for i in range(_D)], float) / SCALE
                out.append(_state(r["g"], 0, q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2), r["n"], prior))
                out.append(_state(r["g"], 1, *moments(np.array([r[c] for c in _SUMS])), r["n"], prior))
                for k in range(ELEMENTS):
                    x = np.array([r[f"e{k}{j}"] for j in range(_D + 1)], float) / SCALE
                    out.append(_state(r["g"], 2 + k, x.mean(axis=0), np.cov(x.T, bias=True), len(x), prior))
            yield pd.DataFrame(out, columns=_NAMES)

    return start


_ARROW = pa.schema([("g", pa.string()), ("k", pa.int32()), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("logdet", pa.float64()), ("done", pa.bool_())])


def _stepper(prior: np.ndarray):
    def step(sums: pa.Table, states: pa.Table) -> pa.Table:
        """All bins of one group and its open starts to the starts after a step."""
        k, bins = sums.column("k").to_numpy(), sums.column("bin").to_numpy()
        order = np.lexsort((bins, k))
        k, values = k[order], np.array([sums.column(c).to_numpy() for c in _SUMS])[:, order]
        out = []
        for old in states.to_pylist():
            rows = values[:, k == old["k"]]
            so_far = rows[0].cumsum()
            last = int(np.searchsorted(so_far, np.ceil(COVERAGE * so_far[-1])))
            near = rows[:, : last + 1].sum(axis=1)
            new = _state(old["g"], old["k"], *moments(near), near[0], prior, None if np.isnan(old["logdet"]) else old["logdet"])
            out.append(old | {"done": True} if new[-1] else dict(zip(_NAMES, new, strict=True)))
        return pa.Table.from_pylist(out, schema=_ARROW)

    return step


def distance() -> Column:
    """Squared Mahalanobis distance of the vector, from columns mean and inverse."""
    x = [F.col(v) / SCALE - F.col("mean")[i] for i, v in enumerate(VECTOR)]
    return sum(((x[i] * x[j] * F.col("inverse")[i * _D + j]) * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(0.0)) + 1) * BINS_PER_DOUBLING).cast("int")


def _sums() -> list[Column]:
    names = list(VECTOR)
    out = [F.sum("c").alias("n"), *(F.sum(F.col(v) * F.col("c")).alias(f"s{i}") for i, v in enumerate(names))]
    return [*out, *(F.sum(F.col(names[i]) * F.col(names[j]) * F.col("c")).alias(f"p{i}{j}") for i, j in _PAIRS)]


def counted(vectors: DataFrame) -> DataFrame:
    """(g, v_...) to (g, v_..., c): each vector of a group once, with its number of documents."""
    return vectors.groupBy("g", *VECTOR).agg(F.count(F.lit(1)).alias("c"))


def prior_of(vectors: DataFrame) -> np.ndarray | None:
    """Squared robust scales of the whole table, at least those of VECTOR; None for no rows."""
    row = vectors.agg(*[F.percentile(v, [0.25, 0.75], F.col("c")).alias(v) for v in VECTOR]).first()
    if row[0] is None:
        return None
    return np.array([max((b - a) / SCALE / 1.349, least) ** 2 for (a, b), least in zip(row, VECTOR.values(), strict=True)])


def mcd(vectors: DataFrame, prior: np.ndarray) -> DataFrame:
    """counted vectors to (g, mean, inverse, logdet): the estimate of the least determinant of each group."""
    vector = F.array(*VECTOR)
    quartiles = [F.percentile(v, [0.25, 0.5, 0.75], F.col("c")).alias(f"q{i}") for i, v in enumerate(VECTOR)]
    drawn = [F.min_by(vector, F.xxhash64(F.lit(k), F.lit(j), *VECTOR)).alias(f"e{k}{j}") for k in range(ELEMENTS) for j in range(_D + 1)]
    begun = vectors.groupBy("g").agg(*_sums(), *quartiles, *drawn).mapInPandas(_starter(prior), _STATE)
    # a start's determinant is that of no h documents, so the first step always counts
    state = materialize(begun.withColumn("logdet", F.lit(float("nan"))).withColumn("done", F.lit(False)), "mcd")
    while not (now := state.where("not done")).isEmpty():
        starts = now.groupBy("g").agg(F.collect_list(F.struct("k", "mean", "inverse")).alias("starts"))
        each = vectors.join(starts, "g").select("g", *VECTOR, "c", F.explode("starts").alias("x")).select("g", *VECTOR, "c", "x.*")
        sums = each.withColumn("bin", _bin(distance())).groupBy("g", "k", "bin").agg(*_sums())
        stepped = sums.groupBy("g").cogroup(now.groupBy("g")).applyInArrow(_stepper(prior), _STATE)
        state = materialize(stepped.unionByName(state.where("done")), "mcd")
    best = state.groupBy("g").agg(F.min_by(F.struct("mean", "inverse", "logdet"), F.struct("logdet", "k")).alias("b"))
    return materialize(best.select("g", "b.*"), "mcd")


def with_spread(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds spread: the group's median distance over that of chi-square, 1 at least."""
    counts = vectors.join(estimates, "g").withColumn("bin", _bin(distance())).groupBy("g", "bin").agg(F.sum("c").alias("n"))
    w = Window.partitionBy("g")
    counts = counts.withColumn("so_far", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    middle = counts.where(F.col("so_far") >= F.col("all") * 0.5).groupBy("g").agg(F.min("bin").alias("b"))
    spread = F.greatest((F.pow(F.lit(2.0), (F.col("b") + 1) / BINS_PER_DOUBLING) - 1) / CHI2_MEDIAN, F.lit(1.0))
    return materialize(estimates.join(middle, "g").select("g", "mean", "inverse", spread.alias("spread")), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """docs to (doc_id, BASE, base_failed, distance, kept)."""
    stats = materialize(measure(docs).withColumn("g", group_of()), "statistics")
    vectors = materialize(counted(stats.where("not base_failed")), "vectors")
    prior = prior_of(vectors)
    if prior is None:
        out = stats.withColumn("distance", F.lit(None).cast("double"))
    else:
        estimates = with_spread(vectors, mcd(vectors, prior))
        out = stats.join(estimates, "g", "left").withColumn("distance", distance() / F.col("spread"))
    return out.select("doc_id", *BASE, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
