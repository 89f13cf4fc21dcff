"""Toxicity by compression distance to two zstandard dictionaries.

Training, on a bounded sample of labelled documents: words (with the space before them) that toxic
documents have more often than ordinary ones, and the frequent words of ordinary ones, are the
samples of two dictionaries. The ordinary dictionary codes with the second; the toxic one holds the
content of both under the same coding tables, so lengths differ only where toxic content helps.

Scoring, on whole texts: a window is a word, written several times over so that the fixed costs of a
small frame do not hide its coding. Its margin is how many bytes shorter the toxic dictionary makes it, added
up over three kinds of match search. A document's margins (how many are large, the largest, their share)
go into a logistic model fitted to the sample, which gives the score.

Defined results: a null text counts as empty and has the score of a text without toxic words; texts
of any length are scored whole; rows are independent, so repeated rows get equal scores; without
labels of both kinds every score is the share of toxic ones (0 without labels); several labels of
one document count as toxic if one is. Other columns pass through; of the input only the text is read.
"""

from __future__ import annotations

import dataclasses
import functools
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.llm import memory
from modlens.llm.bpe import unused

#: Bounds of the training sample: documents of each label, and characters of a document that may be in it.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 2000, 6000, 20_000
#: Words that the toxic and the ordinary dictionary are trained on, and the dictionaries' bytes.
TOXIC_WORDS, ORDINARY_WORDS = 200, 24_000
TOXIC_BYTES, ORDINARY_BYTES = 6144, 8192
#: A toxic word's least log-odds and least number of toxic documents.
LEAST_ODDS, LEAST_ROWS = 1.5, 3
REPEATS = 4
#: Match searches (strategy, least match) whose margins are added up, so that they tell more than whole bytes.
SEARCHES = ((zstandard.STRATEGY_BTLAZY2, 4), (zstandard.STRATEGY_BTULTRA, 3), (zstandard.STRATEGY_BTLAZY2, 5))
#: Margins from which words are counted, and the largest that is told apart.
STEPS = (5, 6, 7, 8, 10, 12, 14)
MOST = 60
#: Word margins kept by a worker in each of two generations: a bound of memory.
KEPT_WORDS = 300_000
#: The repeat offsets that a trained dictionary has before its content: a fixed value of the format.
OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


@dataclasses.dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class Margins(dict):
    """The margin of each word met."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.older: dict[bytes, int] = {}
        self.pairs = []
        for strategy, least in SEARCHES:
            settings = zstandard.ZstdCompressionParameters(strategy=strategy, min_match=least, window_log=17, hash_log=17, chain_log=17, search_log=8, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.pairs.append(tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=settings).compress if d else (lambda x: x) for d in (ordinary, toxic)))

    def __missing__(self, word: bytes) -> int:
        margin = self.older.get(word)
        if margin is None:
            window = (b" " + word) * REPEATS + b" "
            margin = sum(len(ordinary(window)) - len(toxic(window)) for ordinary, toxic in self.pairs)
            margin = min(MOST, max(-MOST, margin))
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = margin
        return margin


def features(margins: Margins, text: str) -> list[float]:
    found = words(text)
    if not found:
        return [0.0] * (5 + 2 * len(STEPS))
    n = len(found)
    counts = np.bincount(np.fromiter(map(margins.__getitem__, found), dtype=np.int64, count=n) + MOST, minlength=2 * MOST + 1)
    best = np.repeat(np.arange(MOST, -MOST - 1, -1), np.minimum(counts[::-1], 5))[:5].astype(float)
    above = [int(counts[MOST + k :].sum()) for k in STEPS]
    return [best[0], best[:2].mean(), best[:3].mean(), best.mean(), *np.log1p(above), *np.sqrt(np.array(above) / n), np.log(n)]


def train_content(samples: list[bytes], size: int) -> tuple[bytes, bytes]:
    """Coding tables and content of a trained dictionary; without tables where the samples are too few."""
    try:
        made = zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
        start = made.index(OFFSETS) + len(OFFSETS)
        return made[:start], made[start:]
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(dict.fromkeys(samples))[:size]


def fit(sample: list[tuple[str, int]]) -> Model:
    """From (text, label) rows."""
    sample = list(dict.fromkeys((text or "", int(label)) for text, label in sample))
    total = [sum(1 for _, y in sample if y == k) for k in (0, 1)]
    if not all(total):
        share = min(1 - 1e-6, max(1e-6, total[1] / max(1, len(sample))))
        n = 5 + 2 * len(STEPS)
        return Model(b"", b"", (0.0,) * n, (1.0,) * n, (*(0.0,) * n, float(np.log(share / (1 - share)))))
    rows: tuple[Counter, Counter] = Counter(), Counter()
    for text, label in sample:
        rows[label].update(set(words(text)))
    odds = {w: np.log((k + 0.1) / (total[1] + 0.2)) - np.log((rows[0][w] + 0.1) / (total[0] + 0.2)) for w, k in rows[1].items() if k >= LEAST_ROWS}
    marked = sorted((w for w in odds if odds[w] > LEAST_ODDS), key=lambda w: (-odds[w] * rows[1][w], w))[:TOXIC_WORDS]
    common = sorted(rows[0], key=lambda w: (-rows[0][w], w))[:ORDINARY_WORDS]
    mixed = random.Random(0)

    def samples(chosen: list[bytes], counts: Counter, most: int) -> list[bytes]:
        out = [b" " + w + b" " for w in chosen for _ in range(min(most, counts[w]))]
        mixed.shuffle(out)
        return out

    _, toxic = train_content(samples(marked, rows[1], 1000), TOXIC_BYTES)
    tables, ordinary = train_content(samples(common, rows[0], 200)[:200_000], ORDINARY_BYTES)
    dictionaries = tables + ordinary, tables + toxic + ordinary
    margins = Margins(*dictionaries)
    x = np.array([features(margins, text) for text, _ in sample])
    y = np.array([label for _, label in sample], dtype=float)
    center, scale = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - center) / scale, np.ones(len(x))]
    weights = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(weights))
        weights -= np.linalg.solve(curve, x.T @ (p - y) + 0.5 * weights)
    return Model(*dictionaries, tuple(center.tolist()), tuple(scale.tolist()), tuple(weights.tolist()))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fits a model to the labelled documents that come first by a hash of their ids, so many of each label at most.

    The sampled ids are so few that they are broadcast; the documents are not shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("label"))
    ids = [known.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(1), F.col(doc_id)), doc_id).limit(n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    sample = ids[0].unionByName(ids[1]).select(F.col(doc_id).alias("sampled"), "label")
    texts = docs.select(F.col(f"`{doc_id}`").alias("sampled"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("sampled_text")).where(F.length("sampled_text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(sample), "sampled").select("sampled", "sampled_text", "label").limit(2 * (toxic_rows + ordinary_rows)).collect()
    return fit([(r.sampled_text, r.label) for r in sorted(found, key=lambda r: (r.sampled, r.sampled_text))])


@functools.lru_cache(maxsize=1)
def margins_of(ordinary: bytes, toxic: bytes) -> Margins:
    return Margins(ordinary, toxic)


def score_text(model: Model, text: str) -> float:
    x = (np.array(features(margins_of(model.ordinary, model.toxic), text)) - model.center) / model.scale
    z = float(x @ np.array(model.weights[:-1]) + model.weights[-1])
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def toxicity_scores(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the score; a column of that name is replaced."""
    kept = [f for f in df.schema.fields if f.name != score]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(unused(df, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.only("toxicity", margins_of.cache_clear)
        for batch in batches:
            scores = [score_text(model, t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64())], names=[*[f.name for f in kept], score])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(score, T.DoubleType())]))
