"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of `WORDS` words as 64-bit hashes. Two documents
link when 100 * intersection >= `PERCENT` * union. The steps:

1. Rarity. Parts exchange Golomb-coded shingle fingerprints with owners (see exchange.py) and learn
   which of their shingles other documents have, and how many, to a power of two. The global order of
   shingles goes by this class, then by hash; shingles of one document alone come first.
2. Prefixes. A set of s shingles that links has ceil(0.8 s) of them in common with its partner. So two
   linked sets share `need` shingles of their first s - ceil(0.8 s) + need, for any need. Each document
   picks its need by the cost that its shingles' classes let expect: a longer prefix costs reads, and leaves
   fewer candidates as more matches are required. A pair must match as often as the smaller need of
   the two says. Documents whose prefix is theirs alone have no partner and go no further.
3. Equal sets become one node. Nodes meet in the lists of their prefix shingles. A pair of a list is a
   candidate if it passes the filters by size, by shared shingles, by prefix matches, and by the
   number of differing bits of 512-bit parity maps, which is never above the number of differing shingles.
4. A list emits its candidates if they are few; else those of a minimum spanning forest by differing
   bits. Their sets are intersected, and links give components. Lists with further candidates are then
   gone over again for pairs between different components, so that no component is missed,
   while a large group of near copies never gives all of its pairs.

Lists of very common shingles are cut into blocks by the shingle's class, and pairs of blocks go to
different tasks, which work them off in tiles. Nothing is dropped or capped.

Words are runs of other characters than white space of ASCII, with A-Z in lower case. Texts of
fewer words than a shingle are one shingle; a null text or one without words has an empty set and no links. Ids need
not be unique: the component's id is the smallest of its documents. A null id is left out of that; a
component with null ids only has the id null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm import memory
from modlens.llm.components import connected_components
from modlens.llm.exchange import SENT, Answers, answers, owner_count, sender, stored_bytes, with_parts
from modlens.session import shared_folder

WORDS = 5
PERCENT = 80
#: Bits of a shingle's hash that the rarity exchange uses; a clash makes a shingle look less rare, no more.
RARITY_BITS = 48
MAP_BITS = 512
#: Rows of a part of the rarity exchange.
PART_ROWS = 4096
#: About how many shingles a byte of compressed Parquet has; it only sets the number of owners.
PRINTS_A_BYTE = 0.5
#: Prefix matches a document may require.
NEEDS = (1, 2, 3, 4)
#: Cost of a candidate against a row of a list.
CANDIDATE_COST = 4.0
#: Rows of a block; longer lists are cut, and two blocks meet in one task.
LIST_ROWS = 4096
#: Rows of a list on each side of a tile, whose pairs are held at once.
TILE = 1024
#: Marks that are counted at once for the rows of a tile.
MARKS = 4096
#: A list of n rows emits all its candidates if they are no more than n times this.
FEW = 2
#: Lists up to this length are gone over in plain Python, which costs less than arrays there.
SHORT = 24
#: Word hashes kept: a bound of memory.
KEPT_WORDS = 500_000

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


KNOWN = WordHashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, for both
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(KNOWN.__getitem__, words), dtype=np.uint64, count=n)
    count = max(1, n - WORDS + 1)
    mixed = np.full(count, min(n, WORDS), dtype=np.uint64)
    for k in range(min(n, WORDS)):
        mixed += hashes[k : k + count] * ODD[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= ODD[0]
    mixed ^= mixed >> np.uint64(29)
    mixed *= ODD[1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def rarity_prints(text: str) -> np.ndarray:
    memory.only("shingles", KNOWN.clear)
    return shingles(text) >> np.uint64(64 - RARITY_BITS)


def overlap(s: int) -> int:
    """Shingles that a set of s has in common with any set it links to, at least."""
    return -(-PERCENT * s // 100)


def choose_prefix(s: int, alone: int, classes: np.ndarray) -> tuple[int, int]:
    """Length of the prefix among the shared shingles (rarest first), and the matches it needs."""
    least = overlap(s)
    costs = []
    for need in NEEDS:
        if need > least:
            break
        length = min(len(classes), s - least + need - alone)
        rows = float(np.exp2(classes[:length].astype(np.float64)).sum())
        costs.append((rows + CANDIDATE_COST * rows / need, length, need))
    _, length, need = min(costs)
    return length, need


def parity_map(values: np.ndarray) -> bytes:
    """Which of the map's cells hold an odd number of shingles."""
    cells = (values & np.uint64(MAP_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=MAP_BITS) & 1).tobytes()


def prepare(df: DataFrame, folder: str, doc_id: str, text: str) -> DataFrame:
    """A stored row per document: row, doc_id, s, and where links are possible the set's digest, its shared shingles, prefix and map."""
    spark = df.sparkSession
    texts = with_parts(df, [F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{doc_id}`").alias("doc_id")], PART_ROWS, folder)
    owners = owner_count(texts, PRINTS_A_BYTE * stored_bytes(texts))
    sent = texts.select("part", "text").mapInArrow(sender(rarity_prints, owners, RARITY_BITS), SENT)
    answers(sent, f"{folder}/answers", shared_only=True)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.only("shingles", KNOWN.clear)
        got = Answers(f"{folder}/answers")
        number = TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "s", "digest", "shared", "classes", "prefix", "need", "map"]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                rows = []
                for part, t in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    values = shingles(t.as_py())
                    s = len(values)
                    known, classes = got.of(part)
                    prints = values >> np.uint64(64 - RARITY_BITS)
                    at = np.minimum(np.searchsorted(known, prints), max(0, len(known) - 1))
                    common = known[at] == prints if len(known) else np.zeros(s, dtype=bool)
                    alone = s - int(common.sum())
                    if not s or alone > s - overlap(s):
                        rows.append((s, None, None, None, None, None, None))
                        continue
                    shared, rarity = values[common], classes[at[common]]
                    order = np.lexsort((shared, rarity))
                    shared, rarity = shared[order], rarity[order]
                    length, need = choose_prefix(s, alone, rarity)
                    rows.append((s, hashlib.blake2b(values.tobytes(), digest_size=16).digest(), shared.view(np.int64), rarity[:length].tobytes(), length, need, parity_map(values)))
                n = len(rows)
                sizes = np.zeros(n + 1, dtype=np.int32)
                np.cumsum([0 if r[2] is None else len(r[2]) for r in rows], out=sizes[1:])
                flat = np.concatenate([r[2] for r in rows if r[2] is not None] or [np.zeros(0, dtype=np.int64)])
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + n)),
                        some.column(2),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.binary()),
                        pa.ListArray.from_arrays(sizes, pa.array(flat)),
                        pa.array(columns[3], pa.binary()),
                        pa.array(columns[4], pa.int32()),
                        pa.array(columns[5], pa.int32()),
                        pa.array(columns[6], pa.binary()),
                    ],
                    names=names,
                )
                number += n

    schema = f"row long, doc_id {kind}, s long, digest binary, shared array<long>, classes binary, prefix int, need int, map binary"
    texts.mapInArrow(run, schema).write.parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


LISTED = "token long, pair long, node long, label long, s int, d int, need int, map binary, tokens binary"


def list_rows(nodes: DataFrame) -> DataFrame:
    """A row per node and prefix shingle (and pair of blocks, where the shingle is very common), grouped by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                out: list[list] = [[] for _ in range(9)]
                for row in batch.slice(start, 200).to_pylist():
                    tokens = np.array(row["head"], dtype=np.int64)
                    marks = (tokens & 0xFFFF).astype(np.uint16).tobytes()  # equal tokens have equal marks; so may others
                    for token, rarity in zip(tokens.tolist(), row["classes"], strict=True):
                        blocks = max(1, (2 << rarity) // LIST_ROWS)
                        own = xxhash.xxh32_intdigest(row["node"].to_bytes(8, "little")) % blocks
                        for other in range(blocks):
                            pair = min(own, other) * blocks + max(own, other)
                            for column, value in zip(out, (token, pair, row["node"], row["label"], row["s"], row["d"], row["need"], row["map"], marks), strict=True):
                                column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                names = [c.split()[0] for c in LISTED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    columns = nodes.select("node", "label", "s", F.size("shared").alias("d"), F.slice("shared", 1, F.col("prefix")).alias("head"), "classes", "need", "map")
    return columns.mapInArrow(run, LISTED)


Row = tuple[int, int, int, int, int, bytes, bytes]  # node, label, s, d, need, map, tokens


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[Row]]]:
    """The groups of rows of equal (token, pair), of batches sorted by them."""
    held: list[Row] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, pairs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(tokens) != 0) | (np.diff(pairs) != 0)) + 1
        # Rows that are alone in their list go at once, but for the first and last, whose lists may go on.
        sizes = np.diff(cuts, prepend=0, append=len(tokens))
        wanted = sizes > 1
        wanted[[0, -1]] = True
        rows_wanted = np.repeat(wanted, sizes)
        batch, tokens, pairs = batch.filter(pa.array(rows_wanted)), tokens[rows_wanted], pairs[rows_wanted]
        cuts = (np.flatnonzero((np.diff(tokens) != 0) | (np.diff(pairs) != 0)) + 1).tolist()
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(2, batch.num_columns)), strict=True))
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if a == b:
                continue
            this = int(tokens[a]), int(pairs[a])
            if this != key and held:
                yield key, held
                held = []
            key = this
            held += rows[a:b]
    if held:
        yield key, held


def common_at_most(left: bytes, right: bytes) -> int:
    """At least the number of tokens that two rows have in common: common marks, and tokens beyond one a mark."""
    x, y = memoryview(left).cast("H"), memoryview(right).cast("H")
    own, others = set(x), set(y)
    return len(own & others) + min(len(x) - len(own), len(y) - len(others))


def few_candidates(rows: list[Row]) -> list[tuple[int, int, int]]:
    """As candidates(), for short lists: i, j, differing bits."""
    maps = [int.from_bytes(r[5], "little") for r in rows]
    found = []
    for j in range(1, len(rows)):
        _, label, s, d, need, _, tokens = rows[j]
        for i in range(j):
            other = rows[i]
            t = other[2]
            if label == other[1] or PERCENT * max(s, t) > 100 * min(s, t):
                continue
            shared = -(-PERCENT * (s + t) // (100 + PERCENT))
            if min(d, other[3]) < shared:
                continue
            bits = (maps[i] ^ maps[j]).bit_count()
            if bits > s + t - 2 * shared:
                continue
            if common_at_most(tokens, other[6]) >= min(need, other[4]):
                found.append((i, j, bits))
    return found


def matches(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many marks each row of the left has in common with each of the right."""
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for marks in (left, right):
        flat, row = np.concatenate(marks), np.repeat(np.arange(len(marks)), [len(m) for m in marks])
        place = np.searchsorted(known, flat)
        met = known[np.minimum(place, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(place[met], kind="stable")
        sides.append((len(marks), row[met][order], place[met][order]))
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, len(known), MARKS):
        has = []
        for m, row, place in sides:
            a, b = np.searchsorted(place, (start, start + MARKS))
            has.append(np.zeros((m, min(MARKS, len(known) - start)), dtype=np.float32))
            has[-1][row[a:b], place[a:b] - start] = 1
        both += has[0] @ has[1].T
    return both


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]  # i, j, differing bits of their maps


def candidates(rows: list[Row]) -> Iterator[Pairs]:
    """Pairs i < j of a list that pass all filters, tile by tile."""
    m = len(rows)
    if m <= SHORT:
        few = np.array(few_candidates(rows), dtype=np.int64).reshape(-1, 3)
        if len(few):
            yield few[:, 0], few[:, 1], few[:, 2]
        return
    _, label, s, d, need, maps, tokens = zip(*rows, strict=True)
    label, s, d, need = (np.array(x, dtype=np.int64) for x in (label, s, d, need))
    maps = np.frombuffer(b"".join(maps), dtype=np.uint64).reshape(m, -1)
    marks = [np.unique(np.frombuffer(t, dtype=np.uint16)) for t in tokens]
    extra = np.array([len(t) // 2 - len(u) for t, u in zip(tokens, marks, strict=True)])  # tokens whose mark is another's too
    for top in range(0, m, TILE):
        for left in range(top, m, TILE):
            rows_end, end = min(m, top + TILE), min(m, left + TILE)
            found = []
            for i in range(top, rows_end):
                first = max(i + 1, left)
                j = slice(first, end)
                total = s[i] + s[j]
                ok = (label[j] != label[i]) & (PERCENT * np.maximum(s[i], s[j]) <= 100 * np.minimum(s[i], s[j]))
                shared = -(-PERCENT * total // (100 + PERCENT))  # of two sets that link, at least
                ok &= np.minimum(d[i], d[j]) >= shared
                at = np.flatnonzero(ok)
                if len(at):
                    bits = np.bitwise_count(maps[i] ^ maps[first + at]).sum(axis=1).astype(np.int32)
                    good = bits <= total[at] - 2 * shared[at]
                    if good.any():
                        found.append((np.full(int(good.sum()), i), first + at[good], bits[good]))
            if not found:
                continue
            a, b, bits = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a) > end - top:
                both = matches(marks[top:rows_end], marks[left:end])[a - top, b - left]
            else:
                both = np.array([len(np.intersect1d(marks[x], marks[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            enough = both + np.minimum(extra[a], extra[b]) >= np.minimum(need[a], need[b])  # at least the common tokens
            if enough.any():
                yield a[enough], b[enough], bits[enough]


def spanning(m: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of the pairs of a minimum spanning forest."""
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    order = np.argsort(bits, kind="stable")
    while len(order) and len(kept) < m - 1:
        some, order = order[: 4 * m], order[4 * m :]
        for k, x, y in zip(some.tolist(), a[some].tolist(), b[some].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[x] = y
                kept.append(k)
        if len(order):  # without the pairs that are joined by now
            roots = np.array([root(x) for x in range(m)])
            order = order[roots[a[order]] != roots[b[order]]]
    return np.array(kept, dtype=np.int64)


def few_or_spanning(rows: list[Row]) -> tuple[Pairs | None, bool]:
    """The candidates of a list if they are few, else those of a minimum spanning forest; and whether there are more."""
    held: Pairs | None = None
    count = 0
    for tile in candidates(rows):
        count += len(tile[0])
        held = tile if held is None else tuple(np.concatenate(x) for x in zip(held, tile, strict=True))
        if count > FEW * len(rows):
            kept = spanning(len(rows), *held)
            held = held[0][kept], held[1][kept], held[2][kept]
    return held, count > FEW * len(rows)


FOUND = "token long, pair long, a long, b long, pending boolean"


def emit(every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over sorted list rows: candidates, all of them or few per list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["token", "pair", "a", "b", "pending"])

        for (token, pair), rows in lists(batches):
            if len(rows) < 2:
                continue
            nodes = np.array([r[0] for r in rows])
            for tile, pending in ((t, False) for t in candidates(rows)) if every else (few_or_spanning(rows),):
                if tile is None:
                    continue
                x, y = nodes[tile[0]], nodes[tile[1]]
                for column, values in zip(out, (np.full(len(x), token), np.full(len(x), pair), np.minimum(x, y), np.maximum(x, y), np.full(len(x), pending)), strict=True):
                    column.append(values)
                held += len(x)
                if held > 50_000:
                    yield batch()
                    out, held = [[] for _ in range(5)], 0
        if held:
            yield batch()

    return run


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    sets = nodes.select("node", "s", "shared")
    left, right = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"), F.col("shared").alias(f"shared_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("shared_a", "shared_b")))
    return both.where(100 * F.col("n") >= PERCENT * (F.col("s_a") + F.col("s_b") - F.col("n"))).select("a", "b")


def ngram_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, row (unique) and keeper (one row of each component is)."""
    spark = df.sparkSession
    folder = shared_folder(spark, "ngram-join")
    rows = prepare(df, folder, doc_id, text)

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    possible = rows.where("digest IS NOT NULL")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    groups = stored(possible.groupBy("digest").agg(F.min("row").alias("node"), low.alias("low")), "groups")
    speakers = possible.withColumnRenamed("row", "node").join(groups.select("node"), "node")
    nodes = stored(speakers.select("node", F.col("node").alias("label"), "s", "shared", "classes", "prefix", "need", "map"), "nodes")

    def meet(listed: DataFrame, every: bool) -> DataFrame:
        return listed.repartition("token", "pair").sortWithinPartitions("token", "pair").mapInArrow(emit(every), FOUND)

    first = stored(meet(list_rows(nodes), every=False), "candidates")
    links = stored(verified(first.select("a", "b").distinct(), nodes), "links")
    parts = stored(connected_components(links), "parts")
    pending = stored(first.where("pending").select("token", "pair").distinct(), "pending")
    if not pending.isEmpty():
        labelled = nodes.drop("label").join(parts, "node", "left").withColumn("label", F.coalesce("component", "node"))
        again = list_rows(labelled).join(pending, ["token", "pair"], "left_semi")
        more = stored(verified(meet(again, every=True).select("a", "b").distinct(), nodes), "more-links")
        if not more.isEmpty():
            known = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            parts = stored(connected_components(known.unionByName(more)), "all-parts")
    placed = groups.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("low").alias("low"))
    placed = placed.select("digest", "component").join(names, "component").select("digest", "low")
    alone = rows.where("digest IS NULL").select("doc_id", F.col("s").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row", F.lit(True).alias("keeper"))
    together = rows.where("digest IS NOT NULL").select("doc_id", "s", "row", "digest").join(placed, "digest")
    return alone.unionByName(together.select("doc_id", F.col("s").alias("n_shingles"), F.col("low.doc_id").alias("component_id"), "row", (F.col("low.row") == F.col("row")).alias("keeper")))
