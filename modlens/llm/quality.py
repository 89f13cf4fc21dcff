"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its words, hashed into WORD_BUCKETS buckets (log counts, scaled to length 1);
its structure statistics (shares of letters, digits, symbols and capitals, repeats of words and lines, lengths
and so on), each one in a bin between quantiles of the sample; and metadata columns, hashed into META_BUCKETS
buckets each. The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

where the last sum over RANK factors is every pairwise interaction <v_i, v_j> x_i x_j, by the sum-of-squares identity
in time linear in the document's features.

Training takes a bounded sample of labelled documents: at most SAMPLE_ROWS of each label, the first by a hash of
their ids, each with its whole text. Features are made in the tasks; the driver gets these vectors, whose length is bounded
by the buckets (64 KB a document at most, some 2 KB as a rule), and fits by Adagrad. Rows of a label are weighted by how
many there are of it for each one sampled, so scores are probabilities at the corpus' rate. Buckets that no sampled
document has weigh nothing.

Defined results: a null text counts as empty and has the score of an empty text; texts are scored whole, of any
length; rows are independent, so repeated rows get equal scores; null metadata is a value of its own; without labels of
both kinds every score is the share of label 1 (0 without labels); several labels of one document count as 0 if one is.
Other columns pass through.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.llm import memory
from modlens.llm.bpe import unused

WORD_BUCKETS, META_BUCKETS, BINS, RANK = 8192, 64, 8, 8
#: Bound of the training sample: documents of each label.
SAMPLE_ROWS = 2500
EPOCHS, BATCH, RATE, SHRINK = 25, 128, 0.2, 1e-3
#: Hashed words that a worker keeps: a bound of memory.
KEPT_WORDS = 300_000

STATISTICS = (
    "log_bytes", "log_words", "capitals", "letters", "digits", "other_bytes", "symbols", "exclamations", "bars", "commas", "stops",
    "word_length", "longest_word", "distinct_words", "commonest_word", "repeats_in_row", "plain_words", "log_lines",
    "words_a_line", "distinct_lines", "short_lines", "byte_entropy",
)
SYMBOLS = np.array([c in b"#$%&*@^~|<>{}[]=+_\\/" for c in range(256)])


@dataclasses.dataclass(frozen=True)
class Model:
    """edges: bin limits of each statistic; weights and factors: of words, bins and metadata, in this order."""

    bias: float
    edges: np.ndarray
    weights: np.ndarray
    factors: np.ndarray


class Buckets(dict):
    """The bucket of each word met."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        bucket = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return bucket


_buckets = Buckets()


def describe(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a text's words with their values, and its statistics."""
    lower = text.lower()
    words = lower.split()
    n, counts = max(1, len(words)), Counter(words)
    data, small = (np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8) for t in (text, lower))
    seen = np.bincount(data, minlength=256)
    size = max(1, len(data))
    capitals = np.count_nonzero(data != small) if len(data) == len(small) else int(seen[65:91].sum())
    letters = int(seen[65:91].sum() + seen[97:123].sum())
    other = int(seen[128:].sum())
    lines = lower.split("\n")
    lengths = [len(line) for line in lines]
    share = seen[seen > 0] / size
    statistics = np.array([
        np.log1p(len(data)), np.log1p(len(words)), capitals / max(1, letters + other), letters / size, seen[48:58].sum() / size, other / size,
        seen[SYMBOLS].sum() / n, seen[33] / n, seen[124] / n, seen[44] / n, seen[46] / n,
        (size - seen[32] - seen[10]) / n, max(map(len, counts), default=0), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, sum(k for w, k in counts.items() if w.isalpha()) / n, np.log(len(lines)),
        n / len(lines), len(set(lines)) / len(lines), sum(k < 20 for k in lengths) / len(lines), -(share * np.log(share)).sum(),
    ], dtype=np.float64)
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32), statistics
    into = np.fromiter(map(_buckets.__getitem__, counts), dtype=np.int64, count=len(counts))
    values = np.bincount(into, weights=np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts))))
    where = np.flatnonzero(values)
    values = values[where]
    return where.astype(np.int32), (values / np.sqrt((values * values).sum())).astype(np.float32), statistics


def meta_buckets(column: pa.Array) -> np.ndarray:
    """A bucket for each value: numbers by their size in powers of two, others by a hash of their text."""
    out = np.empty(len(column), dtype=np.int64)
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_decimal(column.type)
    for k, v in enumerate(column.to_pylist()):
        if v is None:
            out[k] = 0
        elif number:
            out[k] = 1 + (0 if v != v else min(META_BUCKETS // 2 - 2, int(np.log2(1 + min(abs(float(v)), 1e300)))) + (v < 0) * (META_BUCKETS // 2 - 1))
        else:
            out[k] = 1 + zlib.crc32(str(v).encode("utf-8", "surrogatepass")) % (META_BUCKETS - 1)
    return out


def binned(edges: np.ndarray, statistics: np.ndarray) -> np.ndarray:
    """The feature of each statistic's bin, behind the words."""
    return WORD_BUCKETS + np.arange(len(edges)) * BINS + (statistics[:, None] >= edges).sum(1)


def assemble(edges: np.ndarray, where: np.ndarray, values: np.ndarray, statistics: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of a document; statistics and metadata together weigh as much as the words."""
    behind = WORD_BUCKETS + len(edges) * BINS
    fixed = np.concatenate([binned(edges, statistics), behind + np.arange(len(meta)) * META_BUCKETS + meta])
    return np.concatenate([where, fixed]), np.concatenate([values, np.full(len(fixed), len(fixed) ** -0.5)])


def margin(model: Model, features: np.ndarray, x: np.ndarray) -> float:
    """The machine's sum, in time linear in the features."""
    v = model.factors[features]
    first = x @ v
    return float(model.bias + x @ model.weights[features] + 0.5 * (first @ first - (x * x) @ (v * v).sum(1)))


def logistic(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple], n_meta: int, share: float, seed: int = 0) -> Model:
    """From (buckets, values, statistics, metadata, label, weight) rows; share: that of label 1."""
    size = WORD_BUCKETS + len(STATISTICS) * BINS + n_meta * META_BUCKETS
    share = min(1 - 1e-6, max(1e-6, share))
    bias = float(np.log(share / (1 - share)))
    if len({r[4] for r in rows}) < 2:
        return Model(bias, np.zeros((len(STATISTICS), BINS - 1)), np.zeros(size), np.zeros((size, RANK)))
    edges = np.quantile(np.array([r[2] for r in rows]), np.arange(1, BINS) / BINS, axis=0).T
    sparse = [assemble(edges, *r[:4]) for r in rows]
    y, weight = (np.array([r[k] for r in rows], dtype=np.float64) for k in (4, 5))
    weight = weight / weight.mean()
    mixed = np.random.default_rng(seed)
    w, v = np.zeros(size), mixed.normal(0, 0.1, (size, RANK))
    seen = np.zeros(size, dtype=bool)
    for f, _ in sparse:
        seen[f] = True
    v[~seen] = 0
    slow_b, slow_w, slow_v = 1.0, np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(EPOCHS):
        order = mixed.permutation(len(sparse))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            sizes = [len(sparse[i][0]) for i in some]
            f, x = (np.concatenate([sparse[i][part] for i in some]) for part in (0, 1))
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = v[f] * x[:, None]
            first = np.add.reduceat(vx, at)
            z = bias + np.add.reduceat(w[f] * x, at) + 0.5 * ((first * first).sum(1) - np.add.reduceat((vx * vx).sum(1), at))
            g = (logistic(z) - y[some]) * weight[some]
            gx = np.repeat(g, sizes) * x
            touched, into = np.unique(f, return_inverse=True)
            grad_w = np.bincount(into, weights=gx) + SHRINK * w[touched]
            grad_v = np.bincount((into[:, None] * RANK + np.arange(RANK)).ravel(), weights=(gx[:, None] * (np.repeat(first, sizes, axis=0) - vx)).ravel(), minlength=len(touched) * RANK).reshape(-1, RANK)
            grad_v += SHRINK * v[touched]
            slow_b += g.sum() ** 2
            slow_w[touched] += grad_w**2
            slow_v[touched] += grad_v**2
            bias -= RATE * g.sum() / np.sqrt(slow_b)
            w[touched] -= RATE * grad_w / np.sqrt(slow_w[touched])
            v[touched] -= RATE * grad_v / np.sqrt(slow_v[touched])
    return Model(float(bias), edges, w, v)


def described(df: DataFrame, kept: list[str], text: str, metadata: Sequence[str]) -> DataFrame:
    """The kept columns, with buckets, values, statistics and metadata buckets of each row."""
    source = df.select(*[F.col(f"`{c}`") for c in (*kept, *metadata)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    fields = [df.schema[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.only("quality", _buckets.clear)
        for batch in batches:
            made = [describe(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            meta = np.stack([meta_buckets(batch.column(len(kept) + k)) for k in range(len(metadata))], axis=1) if metadata else np.zeros((batch.num_rows, 0), dtype=np.int64)
            lists = [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32())), pa.array([m[2] for m in made], pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *lists], names=[*kept, "where", "values", "statistics", "meta"])

    lists = [("where", T.IntegerType()), ("values", T.FloatType()), ("statistics", T.DoubleType()), ("meta", T.LongType())]
    return source.mapInArrow(run, T.StructType([*fields, *[T.StructField(c, T.ArrayType(t)) for c, t in lists]]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", metadata: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model to the labelled documents that come first by a hash of their ids, so many of each label at most.

    The sampled ids are so few that they are broadcast; texts are neither shuffled nor collected.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__sampled")).agg(F.min(label).cast("int").alias("__label"))
    totals = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    ids = [known.where(F.col("__label") == k).orderBy(F.xxhash64(F.lit(1), F.col("__sampled")), "__sampled").limit(sample_rows) for k in (0, 1)]
    columns = list(dict.fromkeys([text, *metadata]))
    texts = docs.select(F.col(f"`{doc_id}`").alias("__sampled"), *[F.col(f"`{c}`").alias(f"__{n}") for n, c in enumerate(columns)])
    found = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "__sampled").withColumn("__order", F.xxhash64("__sampled", "__0"))
    made = described(found, ["__order", "__label"], "__0", [f"__{columns.index(c)}" for c in metadata])
    # Ids may repeat in the table, so the number of rows is bounded too, whatever order they come in.
    rows = made.orderBy("__order", "__label", "meta").limit(4 * sample_rows).toArrow().to_pylist()
    taken = Counter(r["__label"] for r in rows)
    weight = {k: totals.get(k, 0) / n for k, n in taken.items()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    sample = [(np.array(r["where"], dtype=np.int64), np.array(r["values"]), np.array(r["statistics"]), np.array(r["meta"], dtype=np.int64), r["__label"], weight[r["__label"]]) for r in rows]
    return fit(sample, len(metadata), share if totals else 0.0)


def quality_scores(df: DataFrame, model: Model, text: str = "text", metadata: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Adds the score; a column of that name is replaced. metadata: the same columns as in training."""
    kept = [f for f in df.schema.fields if f.name != score]
    names = [f.name for f in kept]
    source = df.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").alias(unused(df, f"__meta{n}")) for n, c in enumerate(metadata)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(unused(df, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.only("quality", _buckets.clear)
        for batch in batches:
            meta = np.stack([meta_buckets(batch.column(len(kept) + k)) for k in range(len(metadata))], axis=1) if metadata else np.zeros((batch.num_rows, 0), dtype=np.int64)
            scores = [float(logistic(margin(model, *assemble(model.edges, *describe(t.as_py()), m)))) for t, m in zip(batch.column(batch.num_columns - 1), meta, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64())], names=[*names, score])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(score, T.DoubleType())]))
