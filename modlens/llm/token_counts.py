"""Token counts of sections, from one encoding of each whole document.

The document is encoded once with the tokens' character spans; the spans are then joined with the
intervals of the sections. A token inside one section counts there. A token over a boundary counts by the
rule: `first` (where its first character is), `last` (where its last character is) or `most` (where
most of its characters are, the earlier of equals). Characters are code points. So the counts of all
sections, with those outside of any, add up to the document's count.

Defined results: a null text counts as empty; null sections as none; null sections inside the array, those
with a null bound or of no length get a row with no tokens. Where sections overlap, the one that starts
last has the shared characters (of equal starts, the later in the array). Tokens in no section are
in a row with section -1, which every document has, so that no document is lost. Repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm import memory, pieces
from modlens.llm.bpe import text_slices

BLOCK_BYTES = 2_000_000
RULES = ("first", "last", "most")


def elementary(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the text, ascending, and the section that holds the stretch from each cut on (-1: none)."""
    live = np.flatnonzero(ends > starts)
    cuts = np.unique(np.concatenate([[0], starts[live], ends[live]]))
    if (starts[live][1:] >= ends[live][:-1]).all():  # in order and apart, the usual case
        owner = np.full(len(cuts), -1)
        owner[np.searchsorted(cuts, starts[live])] = live
        return cuts, owner
    owner = np.full(len(cuts), -1)
    for k in live[np.argsort(starts[live], kind="stable")]:
        owner[np.searchsorted(cuts, starts[k]) : np.searchsorted(cuts, ends[k])] = k
    return cuts, owner


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none), and whether the token lies over a boundary."""
    cuts, owner = elementary(starts, ends)
    last = np.maximum(end - 1, first)
    a, b = np.searchsorted(cuts, first, side="right") - 1, np.searchsorted(cuts, last, side="right") - 1
    crossing = owner[a] != owner[b]
    section = owner[b if rule == "last" else a].copy()
    if rule == "most":
        for t in np.flatnonzero(a != b):
            share: dict[int, int] = {}
            for k in range(a[t], b[t] + 1):
                stop = cuts[k + 1] if k + 1 < len(cuts) else end[t]
                share[int(owner[k])] = share.get(int(owner[k]), 0) + int(min(end[t], stop) - max(first[t], cuts[k]))
            section[t] = max(share, key=share.get)  # the first of equals, as dicts keep order
            crossing[t] = len(share) > 1
    return section, crossing


def bounds(sections: str, bound: str) -> F.Column:
    return F.transform(F.col(f"`{sections}`"), lambda s: F.coalesce(s[bound].cast("int"), F.lit(0))).alias(f"{bound}s")


def line_bounds(text: str) -> tuple[list[int], list[int]]:
    ends = [m.end() for m in re.finditer("\n", text)] + [len(text)]
    return [0, *ends[:-1]], ends


def section_tokens(df: DataFrame, tokenizer: str, rule: str = "first", doc_id: str = "doc_id", text: str = "text", sections: str | None = "sections") -> DataFrame:
    """doc_id, section (index in the array, -1: outside), start, stop, n_tokens, n_crossing.

    sections: array of structs with integer start and stop (further fields are ignored), or None for
    the lines of the text, each with the line feed that ends it.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    key = df.schema[doc_id].dataType
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *([] if sections is None else [bounds(sections, b) for b in ("start", "stop")]))

    def given(part: pa.RecordBatch, texts: list[str]) -> list[list]:
        if sections is None:
            return [list(x) for x in zip(*map(line_bounds, texts), strict=True)]
        return [part.column(k).to_pylist() for k in (2, 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.only("pieces", pieces.load.cache_clear)
        bpe = pieces.load(tokenizer, spans=True)
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = part.column(1).to_pylist()
                of, number, begin, stop, tokens, over = [], [], [], [], [], []
                for i, (spans, starts, ends) in enumerate(zip(bpe.token_spans(texts), *given(part, texts), strict=True)):
                    starts, ends = (np.array(x or [], dtype=np.int64) for x in (starts, ends))
                    n = len(starts)
                    section, crossing = attribute(*spans, starts, ends, rule)
                    of.append(np.full(n + 1, i))
                    number.append(np.arange(-1, n))
                    begin.append(np.concatenate([[0], starts]))
                    stop.append(np.concatenate([[0], ends]))
                    tokens.append(np.bincount(section + 1, minlength=n + 1))
                    over.append(np.bincount(section[crossing] + 1, minlength=n + 1))
                columns = [np.concatenate(x) for x in (number, begin, stop, tokens, over)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(of))), *[pa.array(c.astype(np.int64)) for c in columns]], names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return rows.mapInArrow(run, f"doc_id {key.simpleString()}, section long, start long, stop long, n_tokens long, n_crossing long")
