"""BPE round trip, token records and token counts against the tokenizers library."""

import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from modlens.llm import bpe, records, token_counts
from modlens.llm.crc32c import crc32c
from modlens.llm.queries import QUERIES, vocabulary

SMALL = "/root/testdata/sf0.001"
WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " ",
    "a  b\n\n c\n\n\nd \n e",
    "Don't STOP <|endoftext|>x<|startoftext|> y <|endoftext|><|endoftext|>",
    "ΑΣ ΟΔΟΣ Σ é İstanbul ǅ ﬁ ¼ ²",
    "a\x1cb \x85 　 z y",
    "\U0001f600\U0001f600 x‍y ́ ́a",
    "aaaaaaaa" * 5000,
    "word, " * 40_000,
    "same",
    "same",
]


def test_bpe_equals_the_library(docs):
    frame = docs(list(enumerate(TEXTS))).withColumnRenamed("lang", "ids").withColumnRenamed("source", "__text")
    done = bpe.bpe_round_trip(frame, WORDS)
    assert done.columns == ["doc_id", "text", "__text", "n_chars", "ids", "decoded"]
    library = Tokenizer.from_file(WORDS)
    for row in done.collect():
        ids = library.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids and row.text == TEXTS[row.doc_id]
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_round_trip(frame.limit(0), WORDS).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_merges_by_index_equal_merges_by_word(seed):
    """Also where a merge makes a pair of a lower rank, which trained files hardly have."""
    mixed = random.Random(seed)
    merges, by_rank = {}, []
    for rank in range(30):
        pair = mixed.randrange(12), mixed.randrange(12)
        if pair[0] << 32 | pair[1] not in merges:
            made = mixed.randrange(4, 12)
            merges[pair[0] << 32 | pair[1]] = len(by_rank), made
            by_rank.append((*pair, made))

    def plain(word):
        word = list(word)
        while found := [(merges[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(word, word[1:])) if a << 32 | b in merges]:
            rank, i = min(found)
            word[i : i + 2] = [by_rank[rank][2]]
        return word

    words = [[mixed.randrange(4) for _ in range(mixed.randrange(12))] for _ in range(200)]
    assert bpe.merge_block(words, merges, by_rank) == [plain(w) for w in words]


def test_checksum():
    assert crc32c([b"123456789", b"", b"\0" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]
    long = random.Random(0).randbytes(5000)
    table = [0] * 256
    for n in range(256):
        c = n
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        table[n] = c
    for size in (1, 7, 255, 256, 257, 2048, 5000):
        c = 0xFFFFFFFF
        for b in long[:size]:
            c = table[(c ^ b) & 255] ^ c >> 8
        assert crc32c([long[:size]])[0] == c ^ 0xFFFFFFFF


def test_records_round_trip(docs, tmp_path):
    rows = [(None, "no id"), *enumerate(TEXTS), (3, "again")]
    folder = str(tmp_path / "records")
    index = records.write_token_records(docs(rows), folder, BYTES, 7)
    back = records.read_token_records(index, folder).collect()
    library = Tokenizer.from_file(BYTES)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(back, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [k for k, _ in want]
    start = 0
    for row, (_, text) in zip(got, want, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 7]
        assert (row.start, row.n_tokens, row.ids) == (start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    some = records.read_token_records(index.where("doc_id % 2 = 1"), folder, with_ids=False)
    assert some.count() == sum(1 for k, _ in rows if k is not None and k % 2)
    empty = records.write_token_records(docs([]), str(tmp_path / "none"), BYTES, 7)
    assert records.read_token_records(empty, str(tmp_path / "none")).collect() == []


def test_broken_records_are_found():
    good = records.frame([b"abc", b""])
    assert records.unframe(good) == [b"abc", b""]
    for bad in (good[0][:-1], good[0][:12] + b"x" + good[0][13:], good[0][:8] + b"\0" + good[0][9:]):
        with pytest.raises(ValueError):
            records.unframe([bad])


def sections_by_hand(text, sections, rule):
    counts = {-1: 0} | {k: 0 for k in range(len(sections))}
    owner = []
    for c in range(len(text)):
        inside = [(a, k) for k, (a, b) in enumerate(sections) if a <= c < b]
        owner.append(max(inside)[1] if inside else -1)
    for a, b in Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).offsets:
        held = owner[a : max(b, a + 1)]
        pick = {"first": held[0], "last": held[-1], "most": max(dict.fromkeys(held), key=held.count)}
        counts[pick[rule]] += 1
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    text = "The quick, brown fox jumps  over\n\n\nthe déjà-vu \U0001f600 dog again and again"
    cases = [
        [(0, 4), (4, 40), (40, 60)],
        [(2, 7), (7, 7), (20, 33)],
        [(0, 50), (10, 20), (10, 30)],
        [],
    ]
    frame = spark.createDataFrame([(k, text, c) for k, c in enumerate(cases)] + [(9, None, None)], "doc_id long, text string, sections array<struct<start:int,stop:int>>")
    got = token_counts.section_tokens(frame, BYTES, rule).collect()
    for k, c in enumerate(cases):
        assert {r.section: r.n_tokens for r in got if r.doc_id == k} == sections_by_hand(text, c, rule)
    assert [(r.section, r.n_tokens) for r in got if r.doc_id == 9] == [(-1, 0)]


def test_token_counts_of_lines(docs):
    got = token_counts.section_tokens(docs(list(enumerate(TEXTS))), BYTES, sections=None).collect()
    library = Tokenizer.from_file(BYTES)
    for k, text in enumerate(TEXTS):
        own = sorted((r for r in got if r.doc_id == k and r.section >= 0), key=lambda r: r.section)
        assert len(own) == (text or "").count("\n") + 1
        starts = np.array([r.start for r in own])
        want = np.zeros(len(own), dtype=int)
        for a, _ in library.encode(text or "", add_special_tokens=False).offsets:
            want[np.searchsorted(starts, a, side="right") - 1] += 1
        assert [r.n_tokens for r in own] == want.tolist()


def test_queries(spark):
    import hashlib

    import pyarrow.parquet as pq

    table = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    texts = {k: t or "" for k, t in zip(table["doc_id"], table["text"], strict=True)}
    library, other = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    for row in QUERIES["op1_bpe_round_trip"](spark, SMALL).collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    start = 0
    for row in sorted(QUERIES["op3_token_records"](spark, SMALL).collect(), key=lambda r: r.doc_id):
        ids = [*other.encode(texts[row.doc_id], add_special_tokens=False).ids, 0]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    per_document = {}
    for row in QUERIES["op9_token_counts"](spark, SMALL).collect():
        per_document[row.doc_id] = per_document.get(row.doc_id, 0) + row.n_tokens
    assert per_document == {k: len(other.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
