"""BPE encoding and decoding by an index of pair occurrences.

The new words of a block of text lie in one linked list of symbols. An index maps each mergeable pair to all its
positions; a heap holds the ranks of pairs that have positions. The lowest rank is taken and applied at all
its positions at once, in arrays, and the pairs that this makes go into the index. So a pair costs a few
array operations per block however many words hold it. Where a merge may make a pair of a lower rank than
the one at work, it is applied at one position of each word at a time, so that such a pair goes first and every word
comes out as if it were encoded alone.

Defined results: a null text counts as empty and has no ids; special tokens written in a text become
their ids, as in the library; texts of any length are encoded whole. Rows are independent: repeated
rows repeat, an empty table stays empty, and other columns (of any name but the two added ones, which
are replaced) pass through.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.llm import memory

#: New words merged at once, words kept, and bytes of text worked on at once: bounds of memory, not of results.
BLOCK_WORDS = 40_000
KEPT_WORDS = 150_000
BATCH_BYTES = 2_000_000

#: Unicode's white space, without the four separators that Python's str.split adds.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(256)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Rules:
    """Merges in order of their ranks, as arrays. made: the symbol that each makes."""

    def __init__(self, left: list[int], right: list[int], made: list[int]):
        self.left, self.right, self.made = (np.array(x, dtype=np.int64) for x in (left, right, made))
        ranks = np.arange(len(self.left))
        pairs = self.left << 32 | self.right
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]
        # Merges whose symbol is in a pair of no higher rank: what they make may have to go first.
        lowest = np.full(max([0, *left, *right, *made]) + 1, len(ranks))
        np.minimum.at(lowest, self.left, ranks)
        np.minimum.at(lowest, self.right, ranks)
        self.careful = lowest[self.made] <= ranks

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge."""
        if not len(self.pairs):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.order[at], -1)


def merge(symbols: np.ndarray, sizes: np.ndarray, rules: Rules) -> np.ndarray:
    """Applies all merges to words that lie one after the other; absorbed symbols become -1, in place.

    An index maps each pair that merges, by its rank, to all its positions. The lowest rank is applied at
    all of them, and the pairs that this makes are put into the index.
    """
    total, some = len(symbols), sizes > 0
    ends = np.cumsum(sizes)
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    after[ends[some] - 1] = -1
    before[(ends - sizes)[some]] = -1
    word = np.repeat(np.arange(len(sizes)), sizes)
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def put(positions: np.ndarray, pairs: np.ndarray) -> None:
        ranks = rules.ranks(pairs)
        known = ranks >= 0
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, own in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts) if len(cuts) else [positions], strict=True):
            if rank in index:
                index[rank].append(own)
            else:
                index[rank] = [own]
                heapq.heappush(waiting, rank)

    begin = np.flatnonzero(after >= 0)
    put(begin, symbols[begin] << 32 | symbols[np.minimum(begin + 1, max(0, total - 1))])
    while waiting:
        rank = heapq.heappop(waiting)
        lists = index.pop(rank)
        at = np.sort(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
        if len(at) > 1:
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        left, right, made = rules.left[rank], rules.right[rank], rules.made[rank]
        second = after[at]
        there = (symbols[at] == left) & (second >= 0) & (symbols[second] == right)
        if not there.all():
            at, second = at[there], second[there]
            if not len(at):
                continue
        if rules.careful[rank]:
            # One position of each word, the leftmost; the others wait until all lower ranks are done.
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(waiting, rank)
                at, second = at[first], second[first]
        elif left == right and len(at) > 1:
            # In a row of equal symbols every other pair merges, from the left.
            number = np.arange(len(at))
            row = np.maximum.accumulate(np.where(np.concatenate([[True], at[1:] != second[:-1]]), number, 0))
            every = (number - row) % 2 == 0
            at, second = at[every], second[every]
        third = after[second]
        symbols[at], symbols[second], after[at] = made, -1, third
        inner = third >= 0
        here, third = at[inner], third[inner]
        before[third] = here
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        put(np.concatenate([here, ahead]), np.concatenate([made << 32 | symbols[third], symbols[ahead] << 32 | made]))
    return symbols


def merge_block(words: list[list[int]], merges: dict[int, tuple[int, int]], by_rank: list[tuple[int, int, int]]) -> list[list[int]]:
    """:func:`merge` for words given as lists. merges: pair (left << 32 | right) to (rank, symbol); by_rank: the same by rank."""
    rules = Rules(*([r[k] for r in by_rank] for k in range(3)))
    symbols = np.array([s for word in words for s in word], dtype=np.int64)
    sizes = np.array([len(word) for word in words], dtype=np.int64)
    done = np.split(merge(symbols, sizes, rules), np.cumsum(sizes)[:-1])
    return [word[word >= 0].tolist() for word in done]


class WordBPE:
    """A tokenizer file of the word-end kind: lower case, white space dropped, `</w>` on last symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.symbol = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        merges = [(self.vocab[x], self.vocab[y], self.vocab[x + y]) for x, y in model["merges"]]
        self.rules = Rules(*map(list, zip(*merges, strict=True)))
        self.symbol, self.last = np.array(self.symbol, dtype=np.int64), np.array(self.last, dtype=np.int64)
        #: Each token's text, a space behind it; nothing for unknown ids.
        size = max(self.tokens) + 1
        self.written = pa.array([(self.tokens[i] + " ").encode() if i in self.tokens else b"" for i in range(size)], pa.binary())
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _pieces(self, word: str) -> list[str]:
        """The pre-tokens of a word without white space, special tokens apart."""
        if word.isascii():
            text = word.lower()
            return [text] if text.isalpha() else self.words.findall(text)
        return self.words.findall(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower())

    def split(self, text: str) -> list[str]:
        """White-space separated words, special tokens apart."""
        if self.cut_special and "<|" in text:
            parts = self.cut_special.split(text)
            return [w for p in parts for w in ([p] if p in self.special else SPACE.split(p)) if w]
        if SEPARATORS.search(text):
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def learn(self, words: set[str]) -> None:
        """Keeps the coding of words; those kept before the last KEPT_WORDS are forgotten unless used again."""
        fresh = []
        for word in words:
            if (coding := self.older.get(word)) is not None:
                self.kept[word] = coding
            elif word in self.special:
                self._keep([word], np.array([self.special[word]]), np.array([1]))
            else:
                fresh.append(word)
        for k in range(0, len(fresh), BLOCK_WORDS):
            names = fresh[k : k + BLOCK_WORDS]
            pieces = [self._pieces(w) for w in names]
            data = [p.encode("utf-8", "surrogatepass") for own in pieces for p in own]
            sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
            letters, ends = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(sizes)
            symbols = self.symbol[letters]
            symbols[ends - 1] = self.last[letters[ends - 1]]
            merge(symbols, sizes, self.rules)
            left = symbols >= 0
            of_word = np.repeat(np.arange(len(names)), np.fromiter(map(len, pieces), dtype=np.int64, count=len(names)))
            counts = np.bincount(np.repeat(of_word, sizes)[left], minlength=len(names))
            self._keep(names, symbols[left], counts)

    def _keep(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Notes the ids of words, as bytes, and the text of their tokens."""
        texts = self.written.take(pa.array(ids))
        lengths = np.frombuffer(texts.buffers()[1], dtype=np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int32)
        ends = np.concatenate([[0], np.cumsum(counts)])
        data, plain = ids.astype("<i4").tobytes(), (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes() if len(ids) else b""
        at, text_at = (ends * 4).tolist(), lengths[ends].tolist()
        for k, name in enumerate(names):
            self.kept[name] = data[at[k] : at[k + 1]], plain[text_at[k] : text_at[k + 1]]

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids as little-endian 32-bit integers, and the decoded text in UTF-8, of each text."""
        split = [self.split(t) for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.older, self.kept = self.kept, {}
        missing = set().union(*split) - self.kept.keys()
        if missing:
            self.learn(missing)
        kept = self.kept
        ids, decoded = [], []
        for words in split:
            found = [kept[w] for w in words]
            ids.append(b"".join([f[0] for f in found]))
            decoded.append(b"".join([f[1] for f in found])[:-1])  # tokens are joined by spaces
        return ids, decoded


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text each."""
    return slices(pc.binary_length(texts).to_pylist(), most)


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so much text each."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bpe_round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids (array of int) and the text decoded from them; tokenizer: path of its file on every node."""
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(unused(df, "__text")))
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.only("bpe", load.cache_clear)
        bpe = load(os.fspath(tokenizer))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in text_slices(texts, BATCH_BYTES):
                coded, plain = bpe.encode_batch(texts.slice(a, b - a).to_pylist())
                offsets = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(coded), dtype=np.int32), type=pa.int32())
                columns = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                names = [*[f.name for f in kept], ids, decoded]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, values), pa.array(plain, pa.binary()).cast(pa.string())], names=names)

    return source.mapInArrow(run, schema)
