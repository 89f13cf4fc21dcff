"""Links between the tokens that two tokenizers make of the same text, and how often each pair of ids is linked.

Both tokenizers are lossless on the texts that take part, so their tokens are ranges of the same bytes. The
byte offsets where both end a token cut a text into groups; every token of one side is linked with every
token of the other side in its group.

Most groups are one token of each side with the same bytes. An identity map, made once from the two
vocabularies, names for each id of A the id of B of the same bytes. A link that follows the map needs no pair:
it is counted in a vector as long as A's vocabulary. Only the other pairs, which come from irregular groups,
are shuffled, a row per part of the input and distinct pair, and their totals go back to the parts that asked.

A part is a run of documents with about PART_BYTES of text. Both tokenizers start anew at a space that stands
between two other characters that are no white space, so a part is cut there, and its distinct pieces are
coded once, all in arrays: offsets, groups and links come from sorted searches and running sums.

The first pass stores per part the documents' figures, their pieces, the pieces' ids and the pairs; the second
reads these and the totals, never the text. What it needs besides is one number per id of A: the highest
count of any of its links.

Defined results: null texts, empty ones and texts that either side does not give back byte for byte (as the
second may for U+2581) have no tokens: zeros, and '' as groups. Texts of any length are aligned whole. Repeated
rows are documents of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.llm import memory
from modlens.llm.bpe import byte_letters, text_slices
from modlens.llm.pieces import joined_ids
from modlens.session import shared_folder

#: Bytes of text of a part, distinct pieces coded at once, links and words worked on at once: bounds of memory.
PART_BYTES = 10_000_000
CODED_PIECES = 20_000
LINKS = 1_000_000
WORDS = 200_000

#: Texts in which a space stands at an end, or behind other white space: those are cut with more care.
RUNS = r"^ | $|[\s\x0b\x{85}\p{Z}] "
CUT = regex.compile(r"(?<=\S) (?=\S)")


class Sides:
    """The two tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True  # their strings are plain text
        letter = {c: n for n, c in enumerate(byte_letters())}
        with open(a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in (self.b.id_to_piece(i),)]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], dtype=np.int64) for x in (a_bytes, b_bytes))
        same = {t: i for i, t in enumerate(b_bytes) if self.b.is_byte(i)}
        same |= {t: i for i, t in enumerate(b_bytes) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.identity = np.array([same.get(t, -1) if t else -1 for t in a_bytes], dtype=np.int64)
        # Written forms of ids, with what stands before them, in one table: first of a group, of A, of B, first of B.
        n = max(len(a_bytes), len(b_bytes))
        self.written = pa.array([f"{mark}{i}" for mark in ";,|" for i in range(n)], pa.binary())
        self.n = n


@functools.lru_cache(maxsize=1)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


def identity_map(a: str, b: str) -> np.ndarray:
    """For each id of A the id of B of the same bytes, or -1."""
    return sides(a, b).identity


def running(sizes: np.ndarray) -> np.ndarray:
    """Offsets of consecutive ranges, from 0 to the total."""
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after the other."""
    at = running(sizes)
    return np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])


def joined(tokens: pa.Array) -> np.ndarray:
    """The bytes of binary values that were taken, in one array."""
    _, offsets, data = tokens.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, dtype=np.int32)
    return np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]


class Coded:
    """Pieces as ids of both sides. a_at, b_at: offsets of each piece's ids. good: whether both give its bytes back."""

    def __init__(self, side: Sides, pieces: list[str]):
        a_ids, a_counts, b_ids, b_counts, good = [], [], [], [], []
        for k in range(0, len(pieces), CODED_PIECES):
            some = pieces[k : k + CODED_PIECES]
            texts = [" " + p for p in some]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            sizes = np.array([len(r) for r in raw], dtype=np.int64)
            ids, counts = joined_ids(side.a, texts, sizes, side.a_sizes)
            plain = side.b.encode(some, num_threads=1)
            b = np.fromiter(itertools.chain.from_iterable(plain), dtype=np.int64)
            n = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
            expected = np.frombuffer(b"".join(raw), dtype=np.uint8)
            right = self._same(side.a_bytes, side.a_sizes, ids, counts, expected, sizes)
            right &= self._same(side.b_bytes, side.b_sizes, b, n, expected, sizes)
            a_ids.append(ids)
            a_counts.append(counts)
            b_ids.append(b)
            b_counts.append(n)
            good.append(right)
        empty = np.zeros(0, dtype=np.int64)
        self.a, self.b = np.concatenate([empty, *a_ids]), np.concatenate([empty, *b_ids])
        self.a_at, self.b_at = running(np.concatenate([empty, *a_counts])), running(np.concatenate([empty, *b_counts]))
        self.good = np.concatenate([np.zeros(0, dtype=bool), *good])

    @staticmethod
    def _same(tokens: pa.Array, token_sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, expected: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each piece are its bytes."""
        at = running(counts)
        made = running(token_sizes[ids])
        right = made[at[1:]] - made[at[:-1]] == sizes
        some = np.flatnonzero(right)
        got = joined(tokens.take(pa.array(ids[ranges(at[some], counts[some])])))
        wanted = expected if right.all() else expected[ranges(running(sizes)[some], sizes[some])]
        wrong = np.flatnonzero(got != wanted)
        if len(wrong):
            right[some[np.unique(np.searchsorted(running(sizes[some]), wrong, side="right") - 1)]] = False
        return right

    def extended(self, more: Coded) -> Coded:
        out = object.__new__(Coded)
        out.a, out.b = np.concatenate([self.a, more.a]), np.concatenate([self.b, more.b])
        out.a_at, out.b_at = np.concatenate([self.a_at, more.a_at[1:] + self.a_at[-1]]), np.concatenate([self.b_at, more.b_at[1:] + self.b_at[-1]])
        out.good = np.concatenate([self.good, more.good])
        return out


class Groups:
    """The groups of coded pieces. of: piece of each group; a_from, a_size, b_from, b_size: its ranges of ids."""

    def __init__(self, side: Sides, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray):
        a_end, b_end = np.cumsum(side.a_sizes[a]), np.cumsum(side.b_sizes[b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_last, b_last = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        self.a_from, self.b_from = np.r_[0, a_last[:-1] + 1][: len(cuts)], np.r_[0, b_last[:-1] + 1][: len(cuts)]
        self.a_size, self.b_size = a_last + 1 - self.a_from, b_last + 1 - self.b_from
        self.of = np.searchsorted(a_at, a_last, side="right") - 1
        self.at = np.searchsorted(self.of, np.arange(len(a_at)))  # groups of each piece

    def written(self, side: Sides, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """Each group as text, a semicolon before it."""
        n = len(self.of)
        both = self.a_size + self.b_size
        at = running(both)
        codes = np.empty(int(at[-1]), dtype=np.int64)
        spots_a, spots_b = ranges(at[:-1], self.a_size), ranges(at[:-1] + self.a_size, self.b_size)
        codes[spots_a], codes[spots_b] = a + side.n, b + side.n
        codes[at[:-1]] -= side.n
        codes[at[:-1] + self.a_size] += side.n
        tokens = side.written.take(pa.array(codes))
        ends = np.frombuffer(tokens.buffers()[1], dtype=np.int32)[at] if n else np.zeros(1, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), tokens.buffers()[2] if n else pa.py_buffer(b"")])


def links(groups: Groups, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece, id of A, id of B and number of times of all links, in blocks; a block may name a link again.

    Groups are taken while they have LINKS links in all. A group with more is worked off by its
    distinct ids of A, each with all distinct ids of B.
    """
    sizes = groups.a_size * groups.b_size
    large = np.flatnonzero(sizes > LINKS)
    at = running(np.where(sizes > LINKS, 0, sizes))
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + LINKS, side="right")) - 1)
        some = np.arange(start, stop)
        some = some[sizes[some] <= LINKS]
        start = stop
        first = ranges(groups.a_from[some], groups.a_size[some])  # ids of A, each as often as its group has ids of B
        width = np.repeat(groups.b_size[some], groups.a_size[some])
        second = ranges(np.repeat(groups.b_from[some], groups.a_size[some]), width)
        yield np.repeat(np.repeat(groups.of[some], groups.a_size[some]), width), np.repeat(a[first], width), b[second], np.ones(len(second), dtype=np.int64)
    for g in large:
        left, left_n = np.unique(a[groups.a_from[g] : groups.a_from[g] + groups.a_size[g]], return_counts=True)
        right, right_n = np.unique(b[groups.b_from[g] : groups.b_from[g] + groups.b_size[g]], return_counts=True)
        step = max(1, LINKS // len(right))
        for k in range(0, len(left), step):
            n = len(left[k : k + step])
            yield np.full(n * len(right), groups.of[g]), np.repeat(left[k : k + step], len(right)), np.tile(right, n), np.outer(left_n[k : k + step], right_n).ravel()


def distinct_links(groups: Groups, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, pair (a << 32 | b) and number of times of each distinct link of each piece, in order of the piece."""
    found = []
    for of, left, right, times in links(groups, a, b):
        pair = left << 32 | right
        order = np.lexsort((pair, of))
        of, pair, times = of[order], pair[order], times[order]
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])][: len(of)])
        found.append((of[new], pair[new], np.add.reduceat(times, new) if len(new) else times))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    of, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:  # a piece may lie in two blocks
        order = np.argsort(of, kind="stable")
        of, pair, times = of[order], pair[order], times[order]
    return of, pair, times


def digests(texts: pa.Array, words: np.ndarray, at: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups: texts holds those of each piece, words the pieces of all documents."""
    out = [hashlib.sha256() for _ in range(len(at) - 1)]
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo in range(0, len(words), WORDS):
        hi = min(len(words), lo + WORDS)
        ends = running(sizes[words[lo:hi]])
        data = joined(texts.take(pa.array(words[lo:hi])))
        for d in range(int(np.searchsorted(at, lo, side="right")) - 1, len(out)):
            if at[d] >= hi:
                break
            if at[d] == at[d + 1]:
                continue
            start = ends[max(at[d], lo) - lo] + (at[d] >= lo)  # without the first semicolon
            out[d].update(data[start : ends[min(at[d + 1], hi) - lo]])
    return [h.hexdigest() if at[d] < at[d + 1] else "" for d, h in enumerate(out)]


def pieces_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the pieces of all texts as numbers, and the offsets of each text's. Empty texts have none."""
    rough = pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.if_else(pa.array(rough), pa.scalar("", texts.type), texts), " ")
    if rough.any():
        by_hand = iter([CUT.split(t) for t in texts.filter(pa.array(rough)).to_pylist()])
        plain = split.filter(pa.array(~rough))
        split = pa.concat_arrays([plain, pa.array(list(by_hand), plain.type)])
        back = np.empty(len(texts), dtype=np.int64)
        back[np.r_[np.flatnonzero(~rough), np.flatnonzero(rough)]] = np.arange(len(texts))
        split = split.take(pa.array(back))
    coded = split.flatten().dictionary_encode()
    words, at = coded.indices.to_numpy().astype(np.int64), running(pc.list_value_length(split).to_numpy().astype(np.int64))
    if not some.all():
        sizes = np.diff(at)
        keep = np.repeat(some, sizes)
        words, at = words[keep], running(np.where(some, sizes, 0))
    return coded.dictionary.to_pylist(), words, at


class Part:
    """A run of documents: their pieces, coded, without the texts that either side changes."""

    def __init__(self, side: Sides, texts: pa.Array):
        pieces, words, at = pieces_of(texts)
        coded = Coded(side, pieces)
        bad = ~coded.good
        if bad.any():
            # A text with such a piece is coded whole, to be judged by its own bytes; most have no tokens then.
            docs = np.repeat(np.arange(len(texts)), np.diff(at))
            changed = np.unique(docs[bad[words]])
            more = Coded(side, [texts[int(d)].as_py() for d in changed])
            lists = {int(d): np.array([len(coded.good) + n] if ok else [], dtype=np.int64) for n, (d, ok) in enumerate(zip(changed, more.good, strict=True))}
            coded = coded.extended(more)
            keep = ~np.isin(docs, changed)
            sizes = np.bincount(docs[keep], minlength=len(texts))
            for d, own in lists.items():
                sizes[d] = len(own)
            at_new = running(sizes)
            fresh = np.empty(int(at_new[-1]), dtype=np.int64)
            fresh[ranges(at_new[:-1][~np.isin(np.arange(len(texts)), changed)], sizes[~np.isin(np.arange(len(texts)), changed)])] = words[keep]
            for d, own in lists.items():
                fresh[at_new[d] : at_new[d + 1]] = own
            words, at = fresh, at_new
        # Only the pieces of texts that take part stay.
        used, words = np.unique(words, return_inverse=True)
        a_size, b_size = np.diff(coded.a_at)[used], np.diff(coded.b_at)[used]
        self.a, self.b = coded.a[ranges(coded.a_at[used], a_size)], coded.b[ranges(coded.b_at[used], b_size)]
        self.a_at, self.b_at = running(a_size), running(b_size)
        self.words, self.at = words.reshape(-1).astype(np.int64), at
        self.groups = Groups(side, self.a, self.a_at, self.b, self.b_at)

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, piece and number of times of each distinct piece of each document."""
        if not len(self.words):
            return (np.zeros(0, dtype=np.int64),) * 3
        n = len(self.a_at) - 1
        keys, times = np.unique(np.repeat(np.arange(len(self.at) - 1), np.diff(self.at)) * n + self.words, return_counts=True)
        return keys // n, keys % n, times


def sums(values: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per document, the sum of what its pieces have."""
    total = running(values[words])
    return total[at[1:]] - total[at[:-1]]


def documents_with(part: Part, of: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """In how many documents each item is; of, item: the items of each piece, in order of the piece."""
    counts = np.zeros(n, dtype=np.int64)
    begin = np.searchsorted(of, np.arange(len(part.a_at)))
    docs, pieces, _ = part.distinct_words()
    sizes = (begin[1:] - begin[:-1])[pieces] if len(pieces) else pieces
    ends = running(np.bincount(docs, weights=sizes, minlength=len(part.at) - 1).astype(np.int64))
    rows = np.searchsorted(docs, np.arange(len(part.at)))
    start = 0
    while start < len(part.at) - 1:  # whole documents, as many as have LINKS items
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + LINKS, side="right")) - 1)
        some = slice(rows[start], rows[stop])
        keys = np.repeat((docs[some] - start) * n, sizes[some]) + item[ranges(begin[pieces[some]], sizes[some])]
        counts += np.bincount(np.unique(keys) % n, minlength=n) if len(keys) else 0
        start = stop
    return counts


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small whole numbers as one compressed value."""
    out = []
    for x in arrays:
        x = x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x.astype(np.uint32 if x.max() < 1 << 32 else np.uint64)
        out.append(struct.pack("<BQ", x.itemsize, len(x)) + x.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        width, n = struct.unpack_from("<BQ", data, at)
        out.append(np.frombuffer(data, dtype=f"<u{width}", count=n, offset=at + 9).astype(np.int64))
        at += 9 + width * n
    return out


def first_pass(side: Sides, keys: pa.Array, texts: pa.Array, number: int) -> dict:
    """What is stored of a part: see the module's text. Lists are in order of the documents."""
    part = Part(side, texts)
    groups, n_words = part.groups, len(part.a_at) - 1
    per_piece = [np.diff(part.a_at), np.diff(part.b_at), np.diff(groups.at), np.bincount(groups.of, weights=groups.a_size * groups.b_size, minlength=n_words).astype(np.int64)]
    written = groups.written(side, part.a, part.b)
    whole = np.frombuffer(written.buffers()[1], dtype=np.int32)[groups.at] if len(written) else np.zeros(n_words + 1, dtype=np.int32)
    by_piece = pa.Array.from_buffers(pa.binary(), n_words, [None, pa.py_buffer(whole.astype(np.int32).tobytes()), written.buffers()[2]])
    of, pair, times = distinct_links(groups, part.a, part.b)
    left = pair >> 32
    along = side.identity[left] == pair & 0xFFFFFFFF
    vector = documents_with(part, of[along], left[along], len(side.a_sizes))
    pairs, local = np.unique(pair[~along], return_inverse=True)
    counts = documents_with(part, of[~along], local.reshape(-1), max(1, len(pairs)))[: len(pairs)]
    docs, pieces, often = part.distinct_words()
    figures = [sums(x, part.at, part.words) for x in per_piece]
    return {
        "part": number,
        "doc_id": keys,
        "n_a": figures[0],
        "n_b": figures[1],
        "n_groups": figures[2],
        "n_links": figures[3],
        "groups_sha256": digests(by_piece, part.words, part.at),
        "pieces": packed(np.bincount(docs, minlength=len(texts)), pieces, often, part.a, np.diff(part.a_at), part.b, np.diff(part.b_at)),
        "pair": pairs,
        "n": counts,
        "along": np.flatnonzero(vector),
        "along_n": vector[vector > 0],
    }


def second_pass(side: Sides, stored: bytes, pairs: np.ndarray, totals: np.ndarray, vector: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_best and count_sum of a part's documents. pairs, totals: the pairs off the map, ascending, with their counts."""
    per_doc, pieces, often, a, a_size, b, b_size = unpacked(stored)
    groups = Groups(side, a, running(a_size), b, running(b_size))
    of, pair, times = distinct_links(groups, a, b)
    left = pair >> 32
    along = side.identity[left] == pair & 0xFFFFFFFF
    count = vector[left]
    count[~along] = totals[np.searchsorted(pairs, pair[~along])]
    n = len(a_size)

    def per_piece(values: np.ndarray) -> np.ndarray:
        total = running(values)
        at = np.searchsorted(of, np.arange(n + 1))
        return total[at[1:]] - total[at[:-1]]

    at = running(per_doc)
    out = []
    for values in (np.where(count == best[left], times, 0), count * times):
        total = running(per_piece(values)[pieces] * often)
        out.append(total[at[1:]] - total[at[:-1]])
    return out[0], out[1]


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def align(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links per document, and the corpus' pairs with their counts.

    a: file of a byte-level tokenizer; b: file of a sentencepiece model; both at the same path on every node.
    The first table has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the second a_id, b_id and
    n_docs, the number of documents in which the pair is linked.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "alignment")
    key = df.schema[doc_id].dataType
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("doc_id", T.ArrayType(key)), *[T.StructField(c, longs) for c in FIGURES], T.StructField("groups_sha256", T.ArrayType(T.StringType())), T.StructField("pieces", T.BinaryType()), *[T.StructField(c, longs) for c in ("pair", "n", "along", "along_n")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.only("alignment", sides.cache_clear)
        side = sides(a, b)
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            together = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
            found = first_pass(side, together.column(0), together.column(1), number)
            number += 1
            arrays = []
            for field in schema.names:
                value = found[field]
                if field in ("part", "pieces"):
                    arrays.append(pa.array([value]))
                else:
                    value = value if isinstance(value, pa.Array) else pa.array(value)
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            for lo, hi in text_slices(batch.column(1), PART_BYTES):
                if (more := pc.sum(pc.binary_length(batch.column(1).slice(lo, hi - lo))).as_py() or 0) + size > PART_BYTES and held:
                    yield flush()
                held.append(batch.slice(lo, hi - lo))
                size += more
        if held:
            yield flush()

    rows.mapInArrow(run, schema).write.parquet(f"{folder}/parts", compression="zstd")
    parts = spark.read.schema(schema).parquet(f"{folder}/parts")
    asked = parts.select("part", F.explode(F.arrays_zip("pair", "n")).alias("x")).select(F.col("part").alias("asked_by"), "x.pair", "x.n")
    asked.groupBy("pair").agg(F.sum("n").alias("total")).write.parquet(f"{folder}/totals", compression="zstd")
    totals = spark.read.schema("pair long, total long").parquet(f"{folder}/totals")
    along = parts.select(F.explode(F.arrays_zip("along", "along_n")).alias("x")).groupBy(F.col("x.along").alias("a")).agg(F.sum("x.along_n").alias("n"))
    highest = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("total").alias("n"))

    # Two vectors as long as A's vocabulary: the counts along the map, and the highest count of each id.
    size = len(sides(a, b).a_sizes)
    vector, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for out, found in ((vector, along), (best, highest)):
        for r in found.collect():
            out[r.a] = r.n
    np.maximum(best, vector, out=best)

    answers = asked.select("asked_by", "pair").join(totals, "pair").select("asked_by", "pair", "total")
    result = T.StructType([T.StructField("doc_id", key), *[T.StructField(c, T.LongType()) for c in (*FIGURES, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def finish(found: pa.Table, counted: pa.Table) -> pa.Table:
        memory.only("alignment", sides.cache_clear)
        side = sides(a, b)
        order = np.argsort(pairs := counted.column("pair").to_numpy())
        out = []
        for row in found.combine_chunks().to_batches():
            stored = row.column("pieces")[0].as_py()
            n_best, count_sum = second_pass(side, stored, pairs[order], counted.column("total").to_numpy()[order], vector, best)
            lists = {c: row.column(c).flatten() for c in ("doc_id", *FIGURES, "groups_sha256")}
            out.append(pa.table({**{c: lists[c] for c in ("doc_id", *FIGURES)}, "n_best": n_best, "count_sum": count_sum, "groups_sha256": lists["groups_sha256"]}))
        return pa.concat_tables(out) if out else pa.table({c: [] for c in result.names})

    kept = parts.select("part", "doc_id", *FIGURES, "groups_sha256", "pieces")
    per_document = kept.groupBy("part").cogroup(answers.groupBy("asked_by")).applyInArrow(finish, result)

    followed = spark.createDataFrame(pa.table({"a_id": np.flatnonzero(vector), "b_id": sides(a, b).identity[vector > 0], "n_docs": vector[vector > 0]}))
    counted = totals.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), F.col("total").alias("n_docs"))
    return per_document, followed.unionByName(counted)
