"""The trie of all beginnings of conversations, by adaptive radix trees over fixed-width turn ids.

A turn's id is 16 bytes: the first half of the SHA-256 of its role and text. A conversation is the key of its ids, one
after the other, so the trie's nodes are the depths of a radix tree that are whole ids (see radix.py).

Keys are dealt out by range and sorted, and each task builds a tree of every run of RUN_ROWS conversations or
RUN_BYTES of keys. A node that begins neither the first nor the last key of its run lies in that run alone, and is
complete there, with all below it. The others, a run's spine, may go on in the runs before and after: they are few (twice
the longest conversation, per run). Their figures are added up by node; sums over subtrees follow from running sums along
each run's two spine paths, in which every node's own share stands once, in the first run that has it. So a beginning that
a third of all conversations share, or a conversation that comes a million times, costs a few rows per run.

Ids of conversations that end at a node are joined in runs and hashed: SHA-256 takes its bytes in order, so those of one
node are hashed by one task, from pieces of ENDS_IDS ids, which it reads one at a time.

Defined results: rows of a null conversation id are left out; null roles and texts are empty; turns are ordered by
`turn`, null first, and rows of one turn by the id made of their role and text, so repeated rows stay, side by side.
Texts may be empty or of any length, only their ids are moved. Turns of one conversation are one value, its key. An empty
table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlens.llm.radix import Tree
from modlens.session import shared_folder

WIDTH = 16
#: Conversations and bytes of keys of a tree, and conversation ids hashed at once: bounds of memory.
RUN_ROWS, RUN_BYTES, ENDS_IDS = 100_000, 32_000_000, 50_000

WORDS = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", near: F.Column | None = None) -> DataFrame:
    """conv_id, near, turns: array of (order, id in hex, words), one row per conversation, by a single shuffle.

    near: what conversations are dealt out by (a function of their id), so that a window over it needs no other shuffle.
    """
    key, who, said = F.col(f"`{conv_id}`").cast("long"), F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.left(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), F.lit(2 * WIDTH))
    rows = df.where(key.isNotNull()).select(key.alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), ident.alias("id"), F.regexp_count(said, F.lit(WORDS)).alias("words")).alias("one"))
    rows = rows.withColumn("near", near if near is not None else F.col("conv_id"))
    return rows.repartition("near").groupBy("near", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def with_shared_starts(df: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Sequences in which each conversation c begins as its family's first, c - c % family, does.

    It has that one's first h turns (all if fewer, none if there is no such conversation), h being the CRC-32 of c in decimal
    modulo `most`, and then its own turns after its first h.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    found = sequences(df, near=first)
    donor = F.max(F.when(F.col("conv_id") == F.col("near"), F.slice("turns", 1, most - 1))).over(Window.partitionBy("near"))
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    found = found.withColumn("donor", F.coalesce(donor, F.slice("turns", 1, 0))).withColumn("h", taken.cast("int"))
    begin = F.when(F.col("h") > 0, F.slice("donor", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return found.select("conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


STORED = (
    "kind int, run long, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, words long, on_first boolean, on_last boolean, chunk long, ends string"
)
FIELDS = [part.split()[0] for part in STORED.split(", ")]
NODE, SPINE, ENDS = range(3)


class Frame:
    """A node on the way down; children: rows of its complete children, which wait for its smallest member."""

    __slots__ = ("ident", "depth", "words", "n", "conv", "kids", "leaves", "saved", "ends", "first", "last", "children")

    def __init__(self, ident: bytes, depth: int, words: int, first: bool, last: bool):
        self.ident, self.depth, self.words, self.first, self.last = ident, depth, words, first, last
        self.n, self.conv, self.kids, self.leaves, self.saved, self.ends, self.children = 0, None, 0, 0, 0, [], []


def nodes_of_run(run: int, rows: list[tuple[bytes, int, list[int]]]) -> Iterator[dict]:
    """Rows of STORED for a run of (key, conv_id, words), sorted by key and conv_id."""
    tree, words = Tree(WIDTH), {}
    for key, same in groupby(rows, key=lambda r: r[0]):
        members = list(same)
        tree.add(key, [m[1] for m in members], lambda old, new: old + new)
        words.update(zip((key[k : k + WIDTH] for k in range(0, len(key), WIDTH)), members[0][2], strict=True))
    first, last = rows[0][0], rows[-1][0]
    above: list[Frame] = []
    for key, entering, ends in tree.walk():
        if entering:
            parent = above[-1] if above else None
            ident = hashlib.blake2b(parent.ident + key[-WIDTH:], digest_size=16).digest() if parent else b""
            depth = len(key)
            # A node on a spine path has its parent on it.
            frame = Frame(
                ident, depth // WIDTH, words[key[-WIDTH:]] if parent else 0,
                (parent is None or parent.first) and first[depth - WIDTH * (depth > 0) : depth] == key[depth - WIDTH * (depth > 0) :],
                (parent is None or parent.last) and last[depth - WIDTH * (depth > 0) : depth] == key[depth - WIDTH * (depth > 0) :],
            )
            if ends:
                frame.ends, frame.n, frame.conv = ends, len(ends), ends[0]
            above.append(frame)
            continue
        done = above.pop()
        parent = above[-1] if above else None
        if parent:
            parent.n += done.n
            parent.conv = done.conv if parent.conv is None else min(parent.conv, done.conv)
        if done.first or done.last:
            yield {
                "kind": SPINE, "run": run, "node": done.ident, "parent": parent.ident if parent else None, "depth": done.depth, "conv_id": done.conv,
                "n_convs": done.n, "n_children": done.kids, "n_leaves": done.leaves, "saved_tokens": done.saved, "words": done.words, "on_first": done.first, "on_last": done.last,
            }
            for chunk, k in enumerate(range(0, len(done.ends), ENDS_IDS)):
                yield {"kind": ENDS, "run": run, "node": done.ident, "chunk": chunk, "ends": ",".join(map(str, done.ends[k : k + ENDS_IDS]))}
            for row in done.children:
                yield row | {"parent": done.ident}
            continue
        leaves, saved = done.leaves or 1, done.saved + (done.n - 1) * done.words
        parent.kids += 1
        parent.leaves += leaves
        parent.saved += saved
        parent.children.append({
            "kind": NODE, "run": run, "depth": done.depth, "conv_id": done.conv, "n_convs": done.n, "n_children": done.kids, "n_leaves": leaves,
            "saved_tokens": saved, "ends_sha256": hashlib.sha256(",".join(map(str, done.ends)).encode()).hexdigest() if done.ends else NOTHING,
        })
        for row in done.children:
            yield row | {"parent_conv_id": done.conv}


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


ARROW = pa.schema([(f, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[part.split()[1]]) for f, part in zip(FIELDS, STORED.split(", "), strict=True)])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32

    def built(rows: list) -> Iterator[pa.RecordBatch]:
        out = []
        for row in nodes_of_run(number, rows):
            out.append(row)
            if len(out) == 10_000:
                yield as_batch(out, ARROW)
                out = []
        if out:
            yield as_batch(out, ARROW)

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[0])
            if len(held) >= RUN_ROWS or size >= RUN_BYTES:
                yield from built(held)
                number, held, size = number + 1, [], 0
    if held:
        yield from built(held)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends; rows of a node come together, in order, and are read one after the other."""
    node, state = None, None
    for batch in batches:
        done = []
        for ident, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or ident != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = ident, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(found: DataFrame) -> DataFrame:
    """A row per node of the trie of sequences (conv_id, turns): see RESULT; conv_id is the node's smallest member."""
    spark = found.sparkSession
    folder = shared_folder(spark, "trie")
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    found.select(key.alias("key"), "conv_id", F.transform("turns", lambda t: t["words"].cast("int")).alias("words")).write.parquet(f"{folder}/keys")
    keys = spark.read.schema("key binary, conv_id long, words array<int>").parquet(f"{folder}/keys")
    dealt = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    dealt.mapInArrow(runs, STORED).write.parquet(f"{folder}/runs")

    def stored(kind: int) -> DataFrame:
        return spark.read.schema(STORED).parquet(f"{folder}/runs").where(F.col("kind") == kind)

    # The spine: figures by node. What lies below a node off the spine is in its leaves and saved tokens already.
    spine = stored(SPINE).select("run", "node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "on_first", "on_last")
    added = {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id"), "kids": F.sum("n_children"), "leaves": F.sum("n_leaves"), "saved": F.sum("saved_tokens"), "owner": F.min("run")}
    shared = {c: F.first(c) for c in ("parent", "depth", "words")}
    merged = spine.groupBy("node").agg(*[v.alias(k) for k, v in (added | shared).items()])
    merged.write.parquet(f"{folder}/spine")

    def spine_nodes(**named: str) -> DataFrame:
        read = spark.read.schema("node binary, n_convs long, conv_id long, kids long, leaves long, saved long, owner long, parent binary, depth long, words long").parquet(f"{folder}/spine")
        return read.select(*[F.col(c).alias(n) for n, c in named.items()]) if named else read

    on_spine = spine_nodes(node="parent").where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("more"))
    total = spine_nodes().join(on_spine, "node", "left").withColumn("n_children", F.col("kids") + F.coalesce("more", F.lit(0)))
    own = total.select("node", "owner", (F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("own_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("own_saved"))
    # Each run's paths to its first and last key; a node's own share stands in one path of its first run.
    sides = F.filter(F.array(F.when(F.col("on_first"), F.lit(0)), F.when(F.col("on_last"), F.lit(1))), lambda s: s.isNotNull())
    paths = spine.select("run", "node", "depth", F.explode(sides).alias("side"), F.when(F.col("on_first"), 0).otherwise(1).alias("counts")).join(own, "node")
    mine = (F.col("run") == F.col("owner")) & (F.col("side") == F.col("counts"))
    upward = Window.partitionBy("run", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    paths = paths.select("node", *[F.sum(F.when(mine, F.col(f"own_{c}")).otherwise(0)).over(upward).alias(c) for c in ("leaves", "saved")])
    sums = paths.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = stored(ENDS).select("node", "ends", "run", "chunk").repartition("node").sortWithinPartitions("node", "run", "chunk").select("node", "ends")
    ends = ends.mapInArrow(hashed, "node binary, ends_sha256 string")
    over = spine_nodes(parent="node", parent_conv_id="conv_id")
    on_paths = total.join(sums, "node").join(over, "parent", "left").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*RESULT)

    # Nodes off the spine are complete, but for the smallest member of a parent that is on it; that is looked up by run.
    nodes = stored(NODE)
    of_run = spine.select("run", F.col("node").alias("parent")).join(spine_nodes(parent="node", parent_conv_id="conv_id"), "parent")
    below = nodes.where("parent IS NOT NULL").drop("parent_conv_id").join(of_run, ["run", "parent"])
    return on_paths.unionByName(nodes.where("parent IS NULL").select(*RESULT)).unionByName(below.select(*RESULT))
