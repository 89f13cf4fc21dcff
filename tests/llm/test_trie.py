"""The trie of conversations against a plain one, and the radix tree against plain sets."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from brute import WORD

from modlens.llm import radix, trie
from modlens.llm.queries import QUERIES
from modlens.llm.sql import ORACLE

SMALL = "/root/testdata/sf0.001"


def plain_trie(members):
    """{conv_id: [(role, text), ...]} to the rows of RESULT."""
    holders, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            holders[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = collections.Counter(p[:-1] for p in holders if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in holders.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    digest = {p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() for p in holders}
    return sorted(((min(own), len(p), min(holders[p[:-1]]) if p else None, len(own), kids[p], leaves[p], saved[p], digest[p]) for p, own in holders.items()), key=str)


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            ident = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, ident, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def found(frame):
    return sorted((tuple(r[f] for f in trie.RESULT) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_plain_sets(seed):
    mixed = random.Random(seed)
    for width in (1, 2, 4):
        for spread in (2, 20, 256):
            keys = [bytes(mixed.randrange(spread) for _ in range(width * mixed.randrange(6))) for _ in range(mixed.randrange(1, 900))]
            tree, wanted = radix.Tree(width), {}
            for key in keys:
                tree.add(key, 1, int.__add__)
                for d in range(0, len(key) + 1, width):
                    wanted.setdefault(key[:d], 0)
                wanted[key] += 1
            steps, open_nodes = list(tree.walk()), []
            assert [(k, v or 0) for k, entering, v in steps if entering] == sorted(wanted.items())
            for key, entering, _ in steps:
                if entering:
                    assert key[:-width] == open_nodes[-1] if open_nodes else key == b""
                    open_nodes.append(key)
                else:
                    assert open_nodes.pop() == key


def test_layouts_grow_and_paths_are_compressed():
    tree, kinds = radix.Tree(2), []
    for n in range(256):
        tree.add(bytes([7, n]), n, max)
        kinds.append(type(tree.root.layout).__name__ + str(tree.root.layout.room if tree.root.layout else ""))
    assert tree.root.prefix == b"\x07"
    assert [kinds.index(k) for k in ("Few4", "Few16", "Slots48", "All256")] == [1, 4, 16, 48]
    with pytest.raises(ValueError):
        tree.add(b"abc", 0, max)
    assert list(radix.Tree(2).walk()) == []


CONVERSATION = "conv_id long, turn long, role string, text string, node string"


def odd_rows(mixed, n):
    rows = []
    for c in range(-45, n):
        if c % 13 == 5:
            continue
        for k in range(mixed.randrange(1, 7)):
            rows.append((c, mixed.choice([k, k, None]), mixed.choice(["user", "assistant", None]), mixed.choice(["", None, "a", "b c", " d  e\x0bf g "])))
    for c in range(n, n + 60):  # copies of one conversation
        rows += [(c * 20 + 3, 0, "user", "same start"), (c * 20 + 3, 1, "user", "x"), (c * 20 + 3, 1, "user", "x")]
    rows += [(None, 0, "user", "nobody"), (9999, 0, "u", "long " * 20_000)]
    rows += [(8888, k, "u", f"turn {k}") for k in range(400)]
    return rows


@pytest.mark.parametrize("run_rows,ends", [(100_000, 50_000), (7, 2), (1, 1)])
def test_equals_a_plain_trie(spark, monkeypatch, run_rows, ends):
    """Also where runs cut hot nodes, and where each conversation is a run of its own."""
    import modlens.llm.trie as module

    rows = odd_rows(random.Random(run_rows), 150)
    frame = spark.createDataFrame([(*r, "x") for r in rows], CONVERSATION).repartition(5)
    monkeypatch.setattr(module, "RUN_ROWS", run_rows)
    monkeypatch.setattr(module, "ENDS_IDS", ends)
    rows_of_runs, nodes = sized_runs(run_rows, ends)
    monkeypatch.setattr(module, "runs", rows_of_runs)
    assert found(module.prefix_trie(module.with_shared_starts(frame))) == plain_trie(rebuilt(rows))


def sized_runs(run_rows, ends):
    """`runs` with its bounds set inside the workers, which import the module anew."""

    def run(batches):
        from modlens.llm import trie as module

        module.RUN_ROWS, module.ENDS_IDS = run_rows, ends
        try:
            yield from module.runs(batches)
        finally:
            module.RUN_ROWS, module.ENDS_IDS = 100_000, 50_000

    return run, None


def test_sequences_as_they_are(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, None, None, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], CONVERSATION)
    wanted = plain_trie({1: [("u", "a"), ("u", "b")], 2: [("u", "a")], 3: [("", "")]})
    assert found(trie.prefix_trie(trie.sequences(frame))) == wanted
    assert found(trie.prefix_trie(trie.with_shared_starts(frame.limit(0)))) == []


def test_query(spark):
    table = f"{SMALL}/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(table).select("conv_id", "turn", "role", "text").collect()]
    frame = QUERIES["op12_conversation_trie"](spark, SMALL)
    assert found(frame) == plain_trie(rebuilt(rows))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{table}'")
    result = connection.sql(ORACLE["op12_conversation_trie"])
    assert sorted(result.columns) == sorted(frame.columns)
    at = [result.columns.index(c) for c in trie.RESULT]
    assert sorted((tuple(r[k] for k in at) for r in result.fetchall()), key=str) == found(frame)
