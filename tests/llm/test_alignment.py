"""Links of two tokenizers' tokens against a plain walk over the texts."""

import collections
import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from modlens.llm import alignment
from modlens.llm.bpe import byte_letters
from modlens.llm.queries import QUERIES, vocabulary

SMALL = "/root/testdata/sf0.001"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = [
    None,
    "",
    " ",
    "  ",
    "a",
    " a",
    "a ",
    "a  b   c",
    "a \n b\n\nc\t d",
    "plain words of a plain text, and some unimaginably longworded ones",
    "plain words of a plain text, and some unimaginably longworded ones",
    "mark ▁ of the second side",
    "good text with▁mark",
    "<|endoftext|> is <s> plain </s> text <0x41>",
    "naïve café \U0001f600 漢字かな交じり 한국어 ﬁ ½ ́x",
    "a\x1cb \x85 　 z y",
    "x" * 3000,
    "tokenization " * 2000,
    "=" * 700 + " " * 70 + "-" * 333,
]


def plain(rows):
    """doc_id to all figures, by walking over bytes."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {c: n for n, c in enumerate(byte_letters())}
    names = {i: bytes(letter[c] for c in t) for t, i in json.load(open(A))["model"]["vocab"].items() if all(c in letter for c in t)}
    found, counts = {}, collections.Counter()
    for key, text in rows:
        groups = []
        if text:
            left = [(i, names[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(t for _, t in left) == whole == b"".join(t for _, t in right):
                i = j = x = y = 0
                start = 0, 0
                while i < len(left) or j < len(right):
                    if x <= y and i < len(left) or j >= len(right):
                        x += len(left[i][1])
                        i += 1
                    else:
                        y += len(right[j][1])
                        j += 1
                    if x == y:
                        groups.append(([t for t, _ in left[start[0] : i]], [t for t, _ in right[start[1] : j]]))
                        start = i, j
        links = [(p, q) for g, h in groups for p in g for q in h]
        counts.update(set(links))
        found[key] = groups, links
    best = collections.Counter()
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = {}
    for key, (groups, links) in found.items():
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out[key] = (sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest)
    return out, counts


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_equals_a_plain_walk(spark, docs, monkeypatch):
    rows = list(enumerate(TEXTS))
    expected, counts = plain(rows)
    for links, words, part in ((2_000_000, 400_000, 24_000_000), (50, 7, 30)):
        monkeypatch.setattr(alignment, "LINKS", links)
        monkeypatch.setattr(alignment, "WORDS", words)
        monkeypatch.setattr(alignment, "PART_BYTES", part)
        frame = docs(rows).withColumnRenamed("lang", "part").withColumnRenamed("source", "n_a")
        done, pairs = alignment.align(frame, A, B)
        assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in done.collect()} == expected
        assert {(r.a_id, r.b_id): r.n_docs for r in pairs.collect()} == counts
    assert expected[3][0] and expected[9][2] > 5 and not expected[11][0] and not expected[12][0]


def test_bounds_of_memory_change_nothing(monkeypatch):
    side = alignment.sides(A, B)
    texts, keys = pa.array([t or "" for t in TEXTS]), pa.array(range(len(TEXTS)))
    one = alignment.first_pass(side, keys, texts, 0)
    for name, value in (("LINKS", 40), ("WORDS", 5), ("CODED_PIECES", 3)):
        monkeypatch.setattr(alignment, name, value)
    two = alignment.first_pass(side, keys, texts, 0)
    for field in one:
        assert list(np.ravel(one[field])) == list(np.ravel(two[field])) if field not in ("pieces", "doc_id") else True, field


def test_rows_without_tokens(spark, docs):
    done = alignment.align(docs([(1, None), (None, ""), (1, "a"), (1, "a")]), A, B)[0]
    assert sorted(((r.doc_id, r.n_a, r.count_sum) for r in done.collect()), key=str) == [(1, 0, 0), (1, 1, 2), (1, 1, 2), (None, 0, 0)]
    done, pairs = alignment.align(docs([]), A, B)
    assert done.collect() == pairs.collect() == []


@pytest.mark.parametrize("folder", [SMALL])
def test_query(spark, folder):
    done = {r.doc_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op13_token_alignment"](spark, folder).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert done == plain(rows)[0]
