"""Prefix trie of conversations: how many conversations share each opening, and what storing it once would save.

A conversation is the sequence of its turns (role, text). Each distinct sequence of first d turns is a node of depth d, from the
textless root at depth 0. A turn is named by 16 bytes of SHA-256 over role and text, and a conversation by its turns' names laid end
to end, so sorted conversations stand in an order of the trie.

1. Conversations are range-partitioned and sorted by (name, conv_id). A slice of sorted rows gives a forest by union-find: the
   edges between neighbours are taken by descending length of their longest common prefix, and every merge of two components
   creates the branching node at that depth, or extends it; the turns between a node and the node above it are its unary chain.
2. In a slice only the prefixes of its first and of its last row can have members outside. All other nodes are closed: they leave as
   rows, and their sums stay with the node above them. What is left, the open nodes of two paths, is the contracted forest.
3. Contracted forests of neighbouring slices are merged: equal prefixes are united, and the nodes on neither outer path are closed.
   A task merges its slices one after the other, then Spark merges `FAN` neighbouring partitions at a time until one is left.

The conversations that end at a node are digested in ascending conv_id. A run of equal conversations that reaches the edge of a
slice leaves in chunks of a slice's length, which are sorted and digested as a stream.

Results for special input: null role and text are ''; turns are ordered by turn (null first), then role, then text; a null conv_id
is no conversation; a conversation without turns is a member of the root alone; an empty table gives no rows; only the columns
named are read, whatever other columns exist.

Skew: equal conversations are split by conv_id, so a group of any size is spread over partitions; its digest is a stream over its
chunks. One conversation is one row of 24 bytes for each turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import prepare, release, shuffle_partitions, stored
from claimspark.operators.joins import join_checked

#: Bytes that name a turn.
NAME = 16
#: Partitions whose contracted forests one task merges.
FAN = 32

NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, " \
       "n_leaves long, saved_tokens long, ends_sha256 string"
#: kind: 0 closed node, 1 open node, 2 chunk of conv_ids that end at `key`. first, last: the open node lies on that outer path.
ROW = "kind int, part long, first boolean, last boolean, chars long, ids string, " + NODE
_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("chars", pa.int64()),
                     ("ids", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()),
                     ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                     ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# -- conversations ------------------------------------------------------------------

def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation numbered from 0."""
    clean = rows.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return clean.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def share_openings(rows: DataFrame, block: int = 100, longest: int = 6) -> DataFrame:
    """(conv_id, pos, role, text): each conversation c after its first h turns gave way to those of conversation c - c % block,
    where h = crc32(decimal c) % longest. A conversation left without turns has one row with a null pos."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    own = numbered_turns(rows).where(F.col("pos") >= h)
    openings = numbered_turns(rows.where(F.col("conv_id") % block == 0)).where(F.col("pos") < longest).withColumnRenamed(
        "conv_id", "__base")
    ids = rows.where(F.col("conv_id").isNotNull()).select("conv_id").distinct().select(
        "conv_id", h.alias("__h"), (F.col("conv_id") - F.col("conv_id") % block).alias("__base"))
    given = ids.join(openings, "__base").where(F.col("pos") < F.col("__h")).select("conv_id", "pos", "role", "text")
    none = ids.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return own.unionByName(given).unionByName(none)


def named_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, name, chars): the names of a conversation's turns end to end, and the code points of each text.

    `turns` has conv_id, pos, role and text; a row with a null pos is a conversation, but no turn of it.
    """
    role, text = (F.encode(c, "utf-8") for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text), 256)
    turn = F.when(F.col("pos").isNotNull(), F.struct(
        "pos", F.substr(digest, F.lit(1), F.lit(2 * NAME)).alias("name"), F.char_length("text").cast("long").alias("chars")))
    listed = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.unhex(F.array_join("t.name", "")).alias("name"), F.col("t.chars").alias("chars"))


# -- a forest: open nodes of two outer paths, and the rows of closed nodes --------------

class Node:
    """A node with its sums over the closed nodes below it."""

    __slots__ = ("key", "up", "depth", "chars", "n", "low", "kids", "leaves", "saved")

    def __init__(self, key, up, depth, chars, n, low, kids=0, leaves=0, saved=0):
        self.key, self.up, self.depth, self.chars = key, up, depth, chars
        self.n, self.low, self.kids, self.leaves, self.saved = n, low, kids, leaves, saved

    def closed(self) -> tuple[int, int]:
        """(leaves, saved) of the whole subtree, when nothing below is open."""
        return self.leaves if self.kids else 1, self.saved + (self.n - 1) * self.chars

    def absorb(self, other: "Node") -> None:
        """The same prefix in a neighbouring forest."""
        self.n += other.n
        self.low = min(self.low, other.low)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved


class Forest:
    """Open nodes by key, and the keys of the two outer paths from the root down."""

    def __init__(self, nodes: dict, first: list, last: list):
        self.nodes, self.first, self.last = nodes, first, last


def path_keys(name: bytes) -> list[bytes]:
    """Keys of all prefixes of a conversation, the root's first."""
    run, out = hashlib.blake2b(digest_size=NAME), []
    out.append(run.copy().digest())
    for at in range(0, len(name), NAME):
        run.update(name[at:at + NAME])
        out.append(run.copy().digest())
    return out


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two conversations share from the start."""
    n = min(len(a), len(b)) // NAME
    if a[:n * NAME] == b[:n * NAME]:
        return n
    x, y = (np.frombuffer(s, dtype=np.uint8, count=n * NAME) for s in (a, b))
    return int(np.argmax(x != y)) // NAME


def slice_forest(ids: list[int], names: list[bytes], chars: list[list[int]], emit) -> Forest:
    """The forest of sorted conversations; `emit` takes the closed nodes, and the conv_ids that end at open ones."""
    m = len(ids)
    shared = [common_turns(names[i], names[i + 1]) for i in range(m - 1)]
    head = list(range(m))                                               # union-find over rows
    low_row, high_row, low_id = list(range(m)), list(range(m)), list(ids)
    size = [len(s) // NAME for s in names]
    nodes: list[list] = [[size[i], 0, 0, 0] for i in range(m)]          # depth, and kids, leaves, saved of closed subtrees below
    top = list(range(m))                                                # a component's topmost node
    waiting: list[list] = [[] for _ in range(m)]                        # closed rows whose parent is that node
    paths = {0: path_keys(names[0])}
    paths[m - 1] = path_keys(names[-1]) if m > 1 else paths[0]
    open_nodes: dict[bytes, Node] = {}

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    def run_end(i: int) -> int:
        """End of the rows that are as long as component i's first row is, its topmost node's own: sorted, they come first."""
        end = low_row[i] + 1
        while end <= high_row[i] and names[end] == names[end - 1]:
            end += 1
        return end

    def ends(i: int) -> str:
        lo = low_row[i]
        if size[lo] != nodes[top[i]][0]:
            return _NO_ENDS
        return hashlib.sha256(",".join(map(str, ids[lo:run_end(i)])).encode()).hexdigest()

    def climb(i: int, depth: int):
        """Finish component i's nodes from its topmost one up to `depth` + 1: (leaves, saved, row that waits for its parent)."""
        d, kids, leaves, saved = nodes[top[i]]
        lo, hi, low, n = low_row[i], high_row[i], low_id[i], high_row[i] - low_row[i] + 1
        edge = 0 if lo == 0 else m - 1 if hi == m - 1 else None
        below = waiting[top[i]]
        for at in range(d, depth, -1):
            length = chars[lo][at - 1] if at else 0
            if edge is not None:  # a prefix of an outer row stays open
                keys = paths[edge]
                open_nodes[keys[at]] = Node(keys[at], keys[at - 1] if at else None, at, length, n, low, kids, leaves, saved)
                if at == d and size[lo] == d:
                    emit.chunk(keys[at], ids[lo:run_end(i)])
                for row in below:
                    emit(row, None, keys[at])
                below, kids, leaves, saved = [], 0, 0, 0
                continue
            leaves = leaves if kids else 1
            saved += (n - 1) * length
            for row in below:
                emit(row, low, None)
            below = [(at, low, n, kids, leaves, saved, ends(i) if at == d else _NO_ENDS)]
            kids = 1
        # `kids` counts the chain's top as one child of the node above when it is closed
        return (1, leaves, saved, below) if edge is None else (0, 0, 0, [])

    def merge(i: int, j: int, depth: int) -> None:
        """Unite components i and j (neighbours, i first) under the node at `depth`."""
        made = None
        for c in (i, j):
            if nodes[top[c]][0] == depth:  # this component's topmost node is the one
                if made is None:
                    made = top[c]
                else:
                    a, b = nodes[made], nodes[top[c]]
                    a[1], a[2], a[3] = a[1] + b[1], a[2] + b[2], a[3] + b[3]
                    waiting[made] += waiting[top[c]]
                    waiting[top[c]] = []
        parts = [climb(c, depth) for c in (i, j) if nodes[top[c]][0] > depth]
        if made is None:
            made = len(nodes)
            nodes.append([depth, 0, 0, 0])
            waiting.append([])
        node = nodes[made]
        for kids, leaves, saved, below in parts:
            node[1], node[2], node[3] = node[1] + kids, node[2] + leaves, node[3] + saved
            waiting[made] += below
        head[j] = i
        high_row[i] = high_row[j]
        low_id[i] = min(low_id[i], low_id[j])
        top[i] = made

    for e in np.argsort(-np.array(shared, dtype=np.int64), kind="stable") if m > 1 else []:
        merge(find(int(e)), find(int(e) + 1), shared[e])
    whole = find(0)
    climb(whole, -1)  # the rest of the path up to the root: all rows are below it, so it is open
    return Forest(open_nodes, paths[0], paths[m - 1])


def join_forests(left: Forest, right: Forest, emit) -> Forest:
    """Merge the forest of a run of rows with that of the rows right after it."""
    nodes = left.nodes
    for key, node in right.nodes.items():
        if key in nodes:
            nodes[key].absorb(node)
        else:
            nodes[key] = node
    keep = {*left.first, *right.last}
    gone = sorted((n for k, n in nodes.items() if k not in keep), key=lambda n: -n.depth)
    for node in gone:
        leaves, saved = node.closed()
        emit.node(node, leaves, saved)
        above = nodes[node.up]
        above.kids, above.leaves, above.saved = above.kids + 1, above.leaves + leaves, above.saved + saved
        del nodes[node.key]
    return Forest(nodes, left.first, right.last)


class Rows:
    """Collects rows of ROW for one task."""

    def __init__(self, part: int = 0):
        self.part, self.rows = part, []

    def __call__(self, row: tuple, parent_conv_id, parent_key) -> None:
        """A closed node of a slice, whose parent is known by its conv_id or is an open node."""
        depth, low, n, kids, leaves, saved, ends = row
        self.rows.append((0, self.part, None, None, None, None, None, parent_key, depth, low, parent_conv_id, n, kids, leaves, saved, ends))

    def node(self, n: Node, leaves: int, saved: int) -> None:
        """A node that was open once: its parent was, too, and its ends are among the chunks."""
        self.rows.append((0, self.part, None, None, None, None, n.key, n.up, n.depth, n.low, None, n.n, n.kids, leaves, saved, None))

    def chunk(self, key: bytes, ids: list[int]) -> None:
        self.rows.append((2, self.part, None, None, None, ",".join(map(str, ids)), key, None, None, ids[0], None, len(ids), None, None,
                          None, None))

    def forest(self, f: Forest) -> None:
        first, last = set(f.first), set(f.last)
        for n in f.nodes.values():
            self.rows.append((1, self.part, n.key in first, n.key in last, n.chars, None, n.key, n.up, n.depth, n.low, None, n.n, n.kids,
                              n.leaves, n.saved, None))

    def root(self, f: Forest) -> None:
        """Close all that is open, when no neighbour is left."""
        nodes = f.nodes
        for n in sorted(nodes.values(), key=lambda n: -n.depth):
            leaves, saved = n.closed()
            self.node(n, leaves, saved)
            if n.up is not None:
                above = nodes[n.up]
                above.kids, above.leaves, above.saved = above.kids + 1, above.leaves + leaves, above.saved + saved

    def take(self):
        """The rows so far as a record batch."""
        columns = zip(*self.rows) if self.rows else [[] for _ in _SCHEMA]
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
        self.rows = []
        return batch


def _partition_forest(batches):
    """Sorted conversations of a partition -> closed nodes, chunks, and the partition's contracted forest."""
    forest = out = None
    for batch in batches:
        if not len(batch):
            continue
        out = out or Rows(int(batch.column("part")[0].as_py()))
        own = slice_forest(batch.column("conv_id").to_pylist(), batch.column("name").to_pylist(), batch.column("chars").to_pylist(), out)
        forest = own if forest is None else join_forests(forest, own, out)
        yield out.take()
    if forest is not None:
        out.forest(forest)
        yield out.take()


def _merge_forests(last_round: bool):
    def run(key, table):
        rows = table.sort_by([("part", "ascending"), ("depth", "ascending")]).to_pylist()
        out, forest = Rows(int(key[0].as_py())), None
        begin = 0
        while begin < len(rows):
            end = begin
            while end < len(rows) and rows[end]["part"] == rows[begin]["part"]:
                end += 1
            part = rows[begin:end]
            nodes = {r["key"]: Node(r["key"], r["parent_key"], r["depth"], r["chars"], r["n_convs"], r["conv_id"], r["n_children"],
                                    r["n_leaves"], r["saved_tokens"]) for r in part}
            own = Forest(nodes, [r["key"] for r in part if r["first"]], [r["key"] for r in part if r["last"]])
            forest = own if forest is None else join_forests(forest, own, out)
            begin = end
        if last_round:
            out.root(forest)
        else:
            out.forest(forest)
        return pa.Table.from_batches([out.take()])
    return run


def _digest_chunks(batches):
    """Chunks sorted by (key, conv_id) -> one SHA-256 for each key, over the ids of all its chunks joined by commas."""
    key, run = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([run.hexdigest()])], names=["key", "digest"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if run is not None:
                    yield done()
                key, run = k, hashlib.sha256()
            else:
                run.update(b",")
            run.update(ids.encode())
    if run is not None:
        yield done()


# -- the operator ---------------------------------------------------------------------

def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. `turns` has conv_id, pos, role and text (see `numbered_turns` and `share_openings`)."""
    spark = turns.sparkSession
    prepare(spark)
    parts = shuffle_partitions(spark)
    named = stored(named_conversations(turns), "trie-conversations")  # read twice: the cut points are sampled
    rows = stored(named.repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id")
                  .withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_partition_forest, ROW), "trie-rows")
    release(named)
    closed, open_rows, held = [rows.where("kind = 0")], rows.where("kind = 1"), [rows]
    rounds, left = 1, parts
    while left > FAN:
        rounds, left = rounds + 1, -(-left // FAN)
    for k in range(rounds):
        slot = F.lit(0) if k == rounds - 1 else F.expr(f"part div {FAN}")
        merged = stored(open_rows.withColumn("slot", slot.cast("long")).groupBy("slot").applyInArrow(
            _merge_forests(k == rounds - 1), ROW), "trie-merge")
        closed.append(merged.where("kind = 0"))
        open_rows = merged.where("kind = 1")
        held.append(merged)
    nodes = closed[0]
    for more in closed[1:]:
        nodes = nodes.unionByName(more)
    nodes = stored(nodes.select(*[c.split()[0] for c in NODE.split(", ")]), "trie-nodes")
    digests = stored(rows.where("kind = 2").select("key", "conv_id", "ids").repartition(parts, "key")
                     .sortWithinPartitions("key", "conv_id").mapInArrow(_digest_chunks, "key binary, digest string"), "trie-digests")
    for df in held:
        release(df)

    # nodes that were open once: two paths for each partition at most
    paths = nodes.where(F.col("key").isNotNull())
    done = join_checked(paths.drop("ends_sha256"), digests, "key", "left").withColumn(
        "ends_sha256", F.coalesce("digest", F.lit(_NO_ENDS))).drop("digest")
    nodes = nodes.where(F.col("key").isNull()).unionByName(done)
    wanted = join_checked(nodes.where(F.col("parent_key").isNotNull()).drop("parent_conv_id"),
                          paths.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    return nodes.where(F.col("parent_key").isNull()).unionByName(wanted).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
