import hashlib
import random

import pyarrow.parquet as pq
import pytest
from brute import components, removed_lines
from pyspark.sql import functions as F

from modlens.llm import exact, exchange, lines, ngram_join
from modlens.llm.components import connected_components
from modlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
ODD = [(900, None), (901, ""), (902, "  \n \t"), (903, "one"), (904, "ONE"), (905, "one two three"), (906, "x y z"), (907, "word " * 30_000), (908, "")]


def small():
    table = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    return list(zip(table["doc_id"], table["text"], strict=True))


def near_copies(n, seed=0, words=150, first=10_000):
    mixed = random.Random(seed)
    base = [f"w{mixed.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(mixed.randrange(9)):
            own[mixed.randrange(words)] = f"v{mixed.randrange(400)}"
        out.append((first + k, " ".join(own)))
    return out


def test_golomb_codes():
    import numpy as np

    mixed = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 70_000):
        for high in (2**64 - 1, 2**48, n + 1):
            values = np.unique(mixed.integers(0, high, n, dtype=np.uint64))
            assert (exchange.golomb_decode(exchange.golomb_encode(values)) == values).all()


def test_exact_duplicates(docs):
    rows = [*small(), *ODD, (5000, "copy"), (5001, "copy"), (None, "copy"), (5001, "copy"), (7, "copy "), (None, "alone")]
    got = exact.exact_duplicates(docs(rows, 5).withColumnRenamed("source", "row").withColumnRenamed("lang", "sha256")).collect()
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    keep = {t: max((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(rows)
    for r in got:
        t = digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (keep[t], len(groups[t]))
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact.exact_duplicates(docs([])).collect() == []


def test_components_of_links(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1000), (1000, 1002)] + [(5000, 5001 + k) for k in range(300)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000} | {5000 + k: 5000 for k in range(301)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ngram_join(docs):
    rows = [*small(), *ODD, *near_copies(250), *near_copies(40, 1, 12, 20_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(rows, 6)).collect()}
    assert got == components(rows)


def test_ngram_join_in_blocks(docs, monkeypatch):
    """Short limits, so that lists are cut into blocks and gone over twice."""
    rows = near_copies(120, 2)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 16)
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "FEW", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(rows)).collect()}
    assert got == components(rows)


def test_counts_of_answers(spark, tmp_path):
    """A message counts all its rows, so that a list is cut by its real length."""
    import numpy as np

    sent = exchange.send("p", [np.array([5, 1 << 40], dtype=np.uint64)] * 5000 + [np.array([7], dtype=np.uint64)] * 256, 1, 48)
    exchange.answers(spark.createDataFrame(sent.to_pandas(), exchange.SENT), str(tmp_path / "answers"), shared_only=True)
    values, classes = exchange.Answers(str(tmp_path / "answers")).of("p")
    assert dict(zip(values.tolist(), classes.tolist(), strict=True)) == {5: 12, 7: 8, 1 << 40: 12}


def test_owners_follow_the_table(spark, docs, tmp_path, monkeypatch):
    """However few shuffle partitions are set, an owner merges a bounded share of the fingerprints."""
    rows = small() + near_copies(30)
    docs(rows, 4).write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(exchange, "OWNER_PRINTS", 20)
    monkeypatch.setattr(exact, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        kept = {r.doc_id: r.keep_id for r in exact.exact_duplicates(frame).collect()}
        assert exchange.stored_bytes(frame.select("text")) > 1000
        monkeypatch.setattr(exchange, "OWNER_PRINTS", 5000)
        joined = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    owned = {}
    for file in (tmp_path / "exact-dedup" / "answers").glob("part=*/*.parquet"):
        table = pq.ParquetFile(file).read(columns=["owner", "codes"]).to_pydict()
        for owner, codes in zip(table["owner"], table["codes"], strict=True):
            owned.setdefault(owner, set()).update(exchange.golomb_decode(codes).tolist())
    assert len(owned) > 8 and max(map(len, owned.values())) < 50
    last = {}
    for k, t in rows:
        last[t or ""] = max(k, last.get(t or "", k))
    assert kept == {k: last[t or ""] for k, t in rows}
    assert joined == components(rows)


def answered(folder):
    """Rows of each part's answers, below a shared folder."""
    found = {}
    for file in folder.glob("*/answers/part=*/*.parquet"):
        table = pq.ParquetFile(file).read()
        n = sum(len(exchange.golomb_decode(c)) for c in table.column("codes").to_pylist())
        found[file.parent.name] = found.get(file.parent.name, 0) + n
    return found


@pytest.mark.parametrize("kind", ["parquet", "json", "memory", "sorted"])
def test_parts_of_one_file(spark, docs, tmp_path, monkeypatch, kind):
    """A large file is many parts, and so is a table that is no file; the results are the same."""
    rows = small() + [(20_000 + k, t) for k, t in small()[:50]]
    frame = docs(rows, 1)
    if kind != "memory":
        getattr(frame.write, "json" if kind == "json" else "parquet")(str(tmp_path / "in"))
        frame = getattr(spark.read.schema(frame.schema), "json" if kind == "json" else "parquet")(str(tmp_path / "in"))
    if kind == "sorted":
        frame = frame.sort("text")
    monkeypatch.setattr(exact, "PART_ROWS", 40)
    monkeypatch.setattr(exact, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    got = exact.exact_duplicates(frame).collect()
    sizes = {}
    for _, t in rows:
        sizes[t or ""] = sizes.get(t or "", 0) + 1
    text = dict(rows)
    assert len(got) == len(rows) and all(r.group_size == sizes[text[r.doc_id] or ""] for r in got)
    parts = answered(tmp_path)
    assert len(parts) >= 7 and max(parts.values()) <= 40
    assert (tmp_path / "exact-dedup" / "table").exists() == (kind != "parquet")


def list_of(n, groups=3):
    """Rows of a list: near copies of a few sets, each copy its own node."""
    import numpy as np

    mixed = np.random.default_rng(4)
    bases = [mixed.integers(0, 2**63, 150, dtype=np.uint64) for _ in range(groups)]
    out = []
    for node in range(n):
        values = np.unique(np.concatenate([bases[node % groups][mixed.permutation(150)[: 150 - node % 9]], mixed.integers(0, 2**63, node % 7, dtype=np.uint64)]))
        marks = (values[:60] & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
        out.append((node, node, len(values), len(values), 1 + node % 4, ngram_join.parity_map(values), marks))
    return out


def test_candidates_in_tiles(monkeypatch):
    """All pairs of a list, never more than a tile's at once; a forest that spans what they span."""
    import numpy as np

    rows = list_of(300)
    want = {(i, j): bits for i, j, bits in ngram_join.few_candidates(rows)}
    monkeypatch.setattr(ngram_join, "TILE", 32)
    monkeypatch.setattr(ngram_join, "MARKS", 16)
    tiles = list(ngram_join.candidates(rows))
    assert len(want) > 10_000 and max(len(a) for a, _, _ in tiles) <= 32 * 32
    got = [(i, j, bits) for tile in tiles for i, j, bits in zip(*(x.tolist() for x in tile), strict=True)]
    assert len(got) == len(want) and {(i, j): bits for i, j, bits in got} == want
    (a, b, bits), pending = ngram_join.few_or_spanning(rows)
    assert pending and len(a) == 297
    i, j, all_bits = (np.array(x) for x in zip(*got, strict=True))
    assert bits.sum() == all_bits[ngram_join.spanning(300, i, j, all_bits)].sum()


@pytest.mark.parametrize("short", [24, 0])
def test_marks_of_different_tokens(monkeypatch, short):
    """Two shared tokens of equal low 16 bits count as two; a pair that shares exactly the need stays."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "SHORT", short)
    sets = [np.array([1 << 20 | 77, 2 << 20 | 77, *(k << 20 | k for k in own)], dtype=np.uint64) for own in (range(300, 310), range(400, 410))]
    marks = [(v & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for v in sets]
    for need, many in ((2, 1), (3, 0)):
        rows = [(k, k, 100, 100, need, bytes(64), m) for k, m in enumerate(marks)]
        assert sum(len(a) for a, _, _ in ngram_join.candidates(rows)) == many
    # More pairs than rows are counted by a product.
    rows = [(k, k, 100, 100, 2, bytes(64), marks[k % 2]) for k in range(6)]
    assert sum(len(a) for a, _, _ in ngram_join.candidates(rows)) == 15


def test_ngram_join_of_odd_tables(docs):
    assert ngram_join.ngram_components(docs([])).collect() == []
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b C d e f"), (None, "q"), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.keeper) for r in ngram_join.ngram_components(docs(twice)).collect()), key=str)
    assert [g[:3] for g in got] == [(1, 2, 1), (1, 2, 1), (3, 0, 3), (None, 1, None), (None, 2, 1)]
    assert sum(g[3] for g in got if g[2] == 1) == 1


def test_lines(docs):
    rows = [*small()[:120], *ODD, (920, "a b c d e\nf"), (921, "f\nb a c d e x\na b c d e"), (922, "\n\n"), (923, "f ")]
    rows += [(1000 + k, "\n".join(t.split(" ")[0] + t[20:160] for _, t in near_copies(3, k))) for k in range(8)]
    got = {(r.doc_id, r.line_no): r.removed for r in lines.line_matches(docs(rows)).collect()}
    assert got == removed_lines(rows)
    assert lines.line_matches(docs([])).collect() == []


def test_line_matches_and_cleaning(docs):
    frame = docs([(1, "a b c d e\nkeep"), (2, "x\na b c d e f\nx"), (3, "a b c d e\n\n"), (4, None)])
    matches = lines.line_matches(frame)
    got = {(r.doc_id, r.line_no): (r.match_doc_id, r.match_line) for r in matches.collect() if r.removed}
    assert got == {(2, 1): (1, 0), (2, 2): (2, 0), (3, 0): (1, 0)}
    cleaned = {r.doc_id: r.text for r in lines.without_lines(frame, matches).collect()}
    assert cleaned == {1: "a b c d e\nkeep", 2: "x", 3: "\n", 4: None}


@pytest.mark.parametrize("cold", [1, 3])
def test_lines_by_class(docs, monkeypatch, cold):
    """Lists of low and of high class give the same: groups of near copies, lines of common words, few shared words."""
    rows = [(k, " ".join(f"w{j}" for j in range(40) if j not in (k % 7, 7 + k % 5, 20 + k))) for k in range(16)]
    rows += [(100 + k, "\n".join(" ".join(f"c{(k * m + j) % 13}" for j in range(9)) for m in range(1, 4))) for k in range(12)]
    rows = [(-1, "a b c d e\tf"), *rows, (200, "a\x0bb c d\x0ce f f"), (201, "a b c\rd e g")]
    monkeypatch.setattr(lines, "COLD", cold)
    got = {(r.doc_id, r.line_no): (r.removed, r.match_doc_id, r.match_line) for r in lines.line_matches(docs(rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == removed_lines(rows)
    sets = {(i, n): set(line.split()) for i, t in rows for n, line in enumerate(t.split("\n"))}
    order = list(sets)
    for key, (removed, *match) in got.items():
        if removed:
            a, b = sets[tuple(match)], sets[key]
            assert 100 * len(a & b) >= 80 * len(a | b) and order.index(tuple(match)) < order.index(key)


def test_lists_split_lines_once(docs, capsys, tmp_path):
    """Neither a filter by the size of what is exploded nor a condition on pairs works out a line's words again."""
    frame = docs([(1, "a b c"), (2, "a b d")]).select("doc_id", F.lit(0).alias("id"), F.lit(0).alias("line_no"), F.col("text").alias("line"))
    lines.slot_classes(frame).write.parquet(str(tmp_path / "rarity"))
    rarity = frame.sparkSession.read.parquet(str(tmp_path / "rarity"))
    lines.listed(frame, rarity).explain()
    assert capsys.readouterr().out.count("split(") == 1


@pytest.mark.parametrize("name", ["op7_line_dedup", "op10_ngram_join"])
def test_queries(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    if name == "op7_line_dedup":
        assert {(r.doc_id, r.line_no): r.removed for r in rows} == removed_lines(small())
    else:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(small())
