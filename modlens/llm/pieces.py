"""Byte-level BPE through the tokenizers library, which sees each distinct piece of a block once.

A byte-level tokenizer of this kind starts a new pre-token at a single space, or line feed, between two
characters that are no white space, whatever stands before. So texts are cut there, exactly, and the library's
coding of a piece is kept for the next texts. All other white space stays inside its piece.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

#: Pieces kept in each of two generations: a bound of memory, not of results.
KEPT_PIECES = 600_000

RUNS = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S)(?= \S)")


def cut(text: str) -> list[str]:
    """The first piece, then the others without the space before them; those after a line feed keep that."""
    if RUNS.search(text):
        first, *rest = CUT.split(text)
        return [first, *[r[1:] for r in rest]]
    return text.replace("\n", " \n").split(" ")


def whole(piece: str) -> str:
    """A piece after the first, as it stands in the text."""
    return piece if piece[:1] == "\n" else " " + piece


#: Pieces that are joined to one text, as a call for each costs more than its coding.
JOINED = 2000


def joined_ids(tokenizer, pieces: list[str], sizes: np.ndarray, token_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, each of which starts with white space that cuts, and the number of ids of each.

    Pieces are joined where none ends with white space, so that the tokenizer starts anew at each; what they
    are in bytes (sizes, token_sizes) tells where each ends.
    """
    apart = np.array([p[-1:].isspace() for p in pieces], dtype=bool)
    groups, start = [], 0
    for stop in [*np.flatnonzero(apart).tolist(), len(pieces)]:
        groups += [(k, min(stop, k + JOINED)) for k in range(start, stop, JOINED)]
        if stop < len(pieces):
            groups.append((stop, stop + 1))
        start = stop + 1
    coded = tokenizer.encode_batch_fast(["".join(pieces[a:b]) for a, b in groups], add_special_tokens=False)
    ids = np.fromiter((i for e in coded for i in e.ids), dtype=np.int64, count=sum(len(e) for e in coded))
    ends = np.concatenate([[0], np.cumsum(token_sizes[ids])])
    at = np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes)]))
    if (ends[at] != np.concatenate([[0], np.cumsum(sizes)])).any():  # not lossless: one by one
        coded = tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        counts = np.array([len(e) for e in coded], dtype=np.int64)
        return np.array([i for e in coded for i in e.ids], dtype=np.int64), counts
    return ids, np.diff(at)


class Kept(dict):
    """Codings of the latest pieces. A piece that has none yet gives None and is noted in `fresh`."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}
        self.fresh: dict[str, None] = {}

    def __missing__(self, piece: str):
        coding = self.older.get(piece)
        if coding is None:
            self.fresh[piece] = None
        else:
            self[piece] = coding
        return coding

    def learn(self, code, written) -> None:
        """Codes what is noted; what was kept KEPT_PIECES ago and not used since goes."""
        fresh, self.fresh = list(self.fresh), {}
        self.update(zip(fresh, code([written(p) for p in fresh]), strict=True))

    def age(self) -> None:
        if len(self) > KEPT_PIECES:
            self.older = dict(self)
            self.clear()


class Pieces:
    """A tokenizer file and the codings of the pieces met lately."""

    def __init__(self, path: str, spans: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.spans = spans
        self.wide = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # Tokens of this kind are written with a letter for each byte; added ones as they are.
        added = self.tokenizer.get_added_tokens_decoder()
        self.sizes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token.encode()) if i in added else len(token)
        self.firsts, self.others = Kept(), Kept()

    def code(self, pieces: list[str]) -> list:
        """Ids as bytes; or starts, ends, number of tokens and length.

        Pieces that begin with the white space before them are coded many at once; first pieces on their own.
        """
        if self.spans:
            coded = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
            return [(array("i", [a for a, _ in e.offsets]).tobytes(), array("i", [b for _, b in e.offsets]).tobytes(), len(e.offsets), len(p)) for p, e in zip(pieces, coded, strict=True)]
        if not pieces or not all(p[:1] in (" ", "\n") for p in pieces):
            return [np.array(e.ids, dtype=self.wide).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.array([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in pieces], dtype=np.int64)
        ids, counts = joined_ids(self.tokenizer, pieces, sizes, self.sizes)
        data, ends = ids.astype(self.wide).tobytes(), (np.cumsum(counts) * self.wide.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def look_up(self, texts: list[str]) -> list[list]:
        """The codings of the pieces of each text."""
        firsts, others = self.firsts, self.others
        firsts.age()
        others.age()
        split = [cut(t) for t in texts]
        found = []
        for pieces in split:
            firsts[pieces[0]]  # notes it
            codings = list(map(others.__getitem__, pieces[1:]))
            codings.insert(0, b"")
            found.append(codings)
        firsts.learn(self.code, lambda p: p)
        others.learn(self.code, whole)
        for pieces, codings in zip(split, found, strict=True):
            codings[0] = firsts[pieces[0]]
            k = 0
            for _ in range(codings.count(None)):
                k = codings.index(None, k)
                codings[k] = others[pieces[k]]
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, of type `wide`."""
        return [b"".join(codings) for codings in self.look_up(texts)]

    def token_spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """First and end character of each token of each text."""
        out = []
        for coded in self.look_up(texts):
            starts, ends, sizes, lengths = zip(*coded, strict=True)
            base = np.cumsum((0, *lengths[:-1])).repeat(sizes)
            out.append((np.frombuffer(b"".join(starts), dtype=np.int32) + base, np.frombuffer(b"".join(ends), dtype=np.int32) + base))
        return out


@functools.lru_cache(maxsize=2)
def load(path: str, spans: bool = False) -> Pieces:
    return Pieces(path, spans)
