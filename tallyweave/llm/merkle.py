"""Merkle manifest of a dataset whose inner nodes keep the hash states between their children.

Rows are the leaves of one tree per source, the trees' roots those of a last
tree.  Nodes are hashed in runs of three.  A digest enters a hash as 64 hex
characters, which is one block of SHA-256, so the state before each child slot
is eight words, and a parent keeps a copy of each (``states``).  To fold a changed
child up to the root, the state before its slot is resumed with the new digest and the
siblings to its right; those to its left are in the state already.

A tree is built in pages of 3**7 entries, seven levels at a time, so a source
may hold any share of the rows: pages are dealt out by (tree, page), their roots
are the entries of the next round.  Places of leaves come from a range partition
with counts per partition.  Paths to the root are handed down page by page; they
meet the leaves by page, never a whole tree in one task.  The node tables are
stored and can be folded against later.

Defined results: NULL in any column is ``-``; a NULL doc_id stands first and is
never changed; rows that repeat an id are ordered by their digest, equal rows
are leaves of their own; a source of one row has the leaf as its root; texts of
any length are hashed whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import stored
from tallyweave.operators.lookup import lookup

FAN = 3
#: Levels of a page.
DEEP = 7
PAGE = FAN**DEEP

# --- SHA-256 of many inputs at once, from and to states ------------------------------


def _roots(power: int, many: int) -> list[int]:
    """The first 32 bits behind the point of square or cube roots of the first primes."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, p))][:many]
    found = []
    for p in primes:
        low, high = 0, 1 << 40
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if middle**power <= p << (32 * power) else (low, middle - 1)
        found.append(low & 0xFFFFFFFF)
    return found


START = np.array(_roots(2, 8), np.uint32)
ROUND = np.array(_roots(3, 64), np.uint32)
HEX = np.frombuffer(b"".join(b"%02x" % b for b in range(256)), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one block (16, n) each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(
                w[t - 16]
                + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                + w[t - 7]
                + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
            )
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def words(raw: np.ndarray) -> np.ndarray:
    """(n, 4 k) bytes as (k, n) words."""
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).T


def raw(state: np.ndarray) -> np.ndarray:
    """(8, n) words as (n, 32) bytes."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block that a digest's 64 hex characters make."""
    return words(HEX[digests].reshape(len(digests), 64))


def close(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of inputs of so many whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 0x80000000, 512 * blocks
    return raw(compress(state, last))


def resume(state: np.ndarray, slot: np.ndarray, digest: np.ndarray, right: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Digests of parents: kept states (n, 32) before ``slot``, then the digest and ``many`` of its right siblings."""
    h = compress(words(state), hex_block(digest))
    for k in range(FAN - 1):
        some = np.flatnonzero(many > k)
        if len(some):
            h[:, some] = compress(h[:, some], hex_block(right[some, k]))
    return close(h, slot + 1 + many)


@dataclass
class Level:
    """All parents of one level of some pages; ``children`` and ``states`` have three places each."""

    page: np.ndarray
    node: np.ndarray
    many: np.ndarray
    children: np.ndarray
    states: np.ndarray
    digest: np.ndarray


def grow(sizes: np.ndarray, levels: np.ndarray, digests: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Parents level by level above pages of entries, and the root of each page."""
    roots, out = np.zeros((len(sizes), 32), np.uint8), []
    page, level = np.repeat(np.arange(len(sizes)), sizes), 0
    while len(page):
        done = levels[page] == level
        roots[page[done]] = digests[done]
        page, digests = page[~done], digests[~done]
        if not len(page):
            break
        sizes = np.bincount(page, minlength=len(levels))
        index = np.arange(len(page)) - np.repeat(np.r_[0, sizes.cumsum()[:-1]], sizes)
        above = -(-sizes // FAN)
        parent, slot = np.repeat(np.r_[0, above.cumsum()[:-1]], sizes) + index // FAN, index % FAN
        many = int(above.sum())
        children, states = np.zeros((2, many, FAN, 32), np.uint8)
        h = np.repeat(START[:, None], many, axis=1)
        for k in range(FAN):
            own = np.flatnonzero(slot == k)
            if len(own):
                to = parent[own]
                children[to, k], states[to, k] = digests[own], raw(h[:, to])
                h[:, to] = compress(h[:, to], hex_block(digests[own]))
        count = np.bincount(parent, minlength=many)
        page = np.repeat(np.arange(len(levels)), above)
        digests = close(h, count)
        out.append(Level(page, np.arange(many) - np.repeat(np.r_[0, above.cumsum()[:-1]], above), count, children, states, digests))
        level += 1
    return out, roots


def levels_of(count: int) -> int:
    """Levels above so many entries within a page."""
    levels, reach = 0, 1
    while reach < count and levels < DEEP:
        levels, reach = levels + 1, reach * FAN
    return levels


# --- pages of sorted rows ---------------------------------------------------------------


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[pa.Table]:
    """Rows that are sorted by ``keys``, in tables of whole groups and about ``least`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = starts_of(table, keys)[-1]
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows -= int(cut)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of groups."""
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        change |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(change) + 1]


def digests_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


NODES = "tree string, page bigint, level int, node bigint, count bigint, digest binary, children binary, states binary"
_NODE_FIELDS = pa.schema(
    [("tree", pa.string()), ("page", pa.int64()), ("level", pa.int32()), ("node", pa.int64()), ("count", pa.int64()),
     ("digest", pa.binary()), ("children", pa.binary()), ("states", pa.binary())]
)


def _nodes_of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of whole pages of entries; the row of level -1 holds the page's root."""
    for table in whole_groups(batches, ["tree", "page"]):
        starts = starts_of(table, ["tree", "page"])
        first = table.take(starts)
        tree, page, count = (first.column(c).to_pylist() for c in ("tree", "page", "count"))
        sizes = np.diff(np.r_[starts, table.num_rows])
        levels, roots = grow(sizes, np.array(list(map(levels_of, count))), digests_of(table.column("digest")))
        yield _node_batch(tree, page, count, np.arange(len(tree)), -1, [0] * len(tree), roots, [b""] * len(tree), [b""] * len(tree))
        for k, level in enumerate(levels):
            children = [c[:n].tobytes() for c, n in zip(level.children, level.many, strict=True)]
            states = [c[:n].tobytes() for c, n in zip(level.states, level.many, strict=True)]
            yield _node_batch(tree, page, count, level.page, k, level.node, level.digest, children, states)


def _node_batch(tree, page, count, own, level, node, digest, children, states) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([tree[i] for i in own], pa.string()),
            pa.array([page[i] for i in own], pa.int64()),
            pa.array([level] * len(own), pa.int32()),
            pa.array(node, pa.int64()),
            pa.array([count[i] for i in own], pa.int64()),
            pa.array([d.tobytes() for d in digest], pa.binary()),
            pa.array(children, pa.binary()),
            pa.array(states, pa.binary()),
        ],
        schema=_NODE_FIELDS,
    )


# --- building ------------------------------------------------------------------------------


def framed(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(framed, columns)), 256))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place ``at`` within ``tree`` by ``order`` and the ``count`` of the tree's rows.

    Ranges of all rows are sorted one by one; counts per tree and range give where a range begins.
    """
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = sorted_rows.withColumns({"range": F.spark_partition_id(), "k": F.lit(0).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, passed = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            starts = starts_of(table, ["tree"])
            k = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.r_[starts, batch.num_rows]))
            tree = batch.column("tree")
            if tree[0].as_py() == last:
                k[: starts[1] if len(starts) > 1 else None] += passed
            last, passed = tree[-1].as_py(), int(k[-1]) + 1
            at = batch.schema.get_field_index("k")
            yield batch.set_column(at, "k", pa.array(k, pa.int64()))

    placed = stored(placed.mapInArrow(run, placed.schema), name)
    counts = placed.groupBy("tree", "range").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(tree).alias("count")
    )
    found = lookup(placed, starts, ["tree", "range"], "inner")
    return found.withColumn("at", F.col("start") + F.col("k")).drop("range", "k", "start")


@dataclass
class Forest:
    """Trees by name: entries with their places, stored nodes by round, and (tree, digest) of the roots."""

    entries: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame


def build(rows: DataFrame, order: list[str], name: str = "merkle") -> Forest:
    """Trees over rows (``tree``, ``digest``, others), ordered by ``order`` within a tree."""
    entries = stored(numbered(rows, order, f"{name}-sorted"), f"{name}-leaves")
    current, rounds, roots = entries.select("tree", "at", "count", "digest"), [], None
    while True:
        pages = current.withColumn("page", F.floor(F.col("at") / PAGE).cast("long"))
        sorted_pages = pages.repartition("tree", "page").sortWithinPartitions("tree", "page", "at")
        nodes = stored(sorted_pages.mapInArrow(_nodes_of_pages, NODES), f"{name}-nodes")
        rounds.append(nodes)
        tops = nodes.where("level = -1")
        ended = tops.where(F.col("count") <= PAGE).select("tree", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        current = tops.where(F.col("count") > PAGE).select(
            "tree", F.col("page").alias("at"), F.ceil(F.col("count") / PAGE).alias("count"), "digest"
        )
        if not current.take(1):
            return Forest(entries, rounds, roots)


# --- paths and folding ----------------------------------------------------------------------


@dataclass
class Step:
    """One level of the paths of a page's entries: kept state, slot and right siblings for each."""

    state: np.ndarray
    slot: np.ndarray
    right: np.ndarray
    many: np.ndarray
    #: Hex text of all siblings by parent and slot, and each entry's parent.
    beside: list[list[bytes]]
    parent: np.ndarray


def steps_of(nodes: list[tuple[int, int, bytes, bytes]], size: int) -> list[Step]:
    """Steps of a page's entries from its node rows (level, node, children, states)."""
    steps, index = [], np.arange(size)
    by_level: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for level, node, children, states in nodes:
        by_level.setdefault(level, []).append((node, children, states))
    for level in sorted(by_level):
        rows = sorted(by_level[level])
        padded = np.zeros((2, len(rows), FAN + 2, 32), np.uint8)
        many = np.array([len(c) // 32 for _, c, _ in rows])
        for k, (_, children, states) in enumerate(rows):
            padded[0, k, : many[k]] = np.frombuffer(children, np.uint8).reshape(-1, 32)
            padded[1, k, : many[k]] = np.frombuffer(states, np.uint8).reshape(-1, 32)
        parent, slot = index // FAN, index % FAN
        right = np.stack([padded[0, parent, slot + 1], padded[0, parent, slot + 2]], 1)
        beside = []
        for _, children, _ in rows:
            text = [children[a : a + 32].hex().encode() for a in range(0, len(children), 32)]
            beside.append([b"".join(text[:k] + text[k + 1 :]) for k in range(len(text))])
        steps.append(Step(padded[1, parent, slot], slot, right, many[parent] - 1 - slot, beside, parent))
        index = parent  # from here on every entry follows its ancestor
    return steps


def beside_of(steps: list[Step], entry: int) -> bytes:
    """Hex text of an entry's siblings within its page, level by level, left to right."""
    return b"".join(s.beside[s.parent[entry]][s.slot[entry]] for s in steps)


def packed(steps: list[Step], entry: int) -> bytes:
    """Slot, number of right siblings, state and right siblings of each level."""
    return b"".join(
        bytes([s.slot[entry], s.many[entry]]) + s.state[entry].tobytes() + s.right[entry, : s.many[entry]].tobytes()
        for s in steps
    )


def unpacked(path: bytes) -> list[tuple[int, int, bytes, bytes]]:
    found, at = [], 0
    while at < len(path):
        slot, many = path[at], path[at + 1]
        end = at + 34 + 32 * many
        found.append((slot, many, path[at + 2 : at + 34], path[at + 34 : end]))
        at = end
    return found


#: What meets by page, in the order of ``kind``: the path from the page's root up (a: hex siblings, b: packed steps,
#: c: root of the tree), nodes (a: children, b: states) and entries (a: digest, b: changed digest).
MEETING = ["tree", "page", "kind", "level", "at", "a", "b", "c"]


def _meet(paths: DataFrame, nodes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    none = F.lit(None).cast("binary")
    up = paths.select("tree", "page", F.lit(0).alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("at"),
                      F.col("beside").alias("a"), F.col("steps").alias("b"), F.col("subroot").alias("c"))
    inner = nodes.where("level >= 0").select("tree", "page", F.lit(1).alias("kind"), "level", F.col("node").alias("at"),
                                             F.col("children").alias("a"), F.col("states").alias("b"), none.alias("c"))
    rows = up.unionByName(inner)
    if more is not None:
        rows = rows.withColumn("doc_id", F.lit(None).cast(more.schema["doc_id"].dataType)).unionByName(more)
    return rows.repartition("tree", "page").sortWithinPartitions("tree", "page", "kind", "level", "at")


def _pages(table: pa.Table) -> Iterator[tuple[int, int, dict]]:
    """(first row, end, columns) of each page of a table of MEETING rows."""
    starts = starts_of(table, ["tree", "page"])
    columns = {c: table.column(c).to_pylist() for c in ("tree", "page", "kind", "level", "at", "a", "b", "c")}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
        yield a, b, columns


PATHS = "tree string, page bigint, beside binary, steps binary, subroot binary"


def _paths_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of all entries of pages, from paths of the pages and their nodes."""
    for table in whole_groups(batches, ["tree", "page"]):
        out: list[list] = [[], [], [], [], []]
        for a, b, c in _pages(table):
            rows = [(c["level"][i], c["at"][i], c["a"][i], c["b"][i]) for i in range(a + 1, b)]
            size = sum(len(r[2]) // 32 for r in rows if r[0] == 0) if rows else 1
            steps = steps_of(rows, size)
            for k in range(size):
                place = c["page"][a] * PAGE + k
                for column, value in zip(
                    out, (c["tree"][a], place, beside_of(steps, k) + c["a"][a], packed(steps, k) + c["b"][a], c["c"][a]), strict=True
                ):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.binary()) for x in out[2:])],
            names=["tree", "page", "beside", "steps", "subroot"],
        )


def page_paths(forest: Forest, tops: DataFrame, name: str = "merkle-paths") -> DataFrame:
    """Paths of the first round's pages; ``tops`` (PATHS, page 0) holds those of the trees' roots.

    Pages of one round are the entries of the next, so paths go down round by round.
    """
    found = None
    for k in range(len(forest.rounds) - 1, -1, -1):
        # Trees whose only page in this round holds their root.
        ended = forest.rounds[k].where((F.col("level") == -1) & (F.col("count") <= PAGE)).select("tree")
        here = lookup(tops, ended, ["tree"], "inner").select("tree", "page", "beside", "steps", "subroot")
        found = here if found is None else found.unionByName(here)
        if k:
            found = entry_paths(found, forest.rounds[k], name)
    return found


def entry_paths(paths: DataFrame, nodes: DataFrame, name: str = "merkle-paths") -> DataFrame:
    """Paths of all entries of pages; ``page`` is the entry's place, which is the page it stands for."""
    return stored(_meet(paths, nodes).mapInArrow(_paths_down, PATHS), name)


def fold(digests: np.ndarray, pages: list[tuple[int, list[Step], list[tuple[int, int, bytes, bytes]]]]) -> np.ndarray:
    """Roots from changed digests; each page brings its number of entries, their steps and the path above."""
    digests = digests.copy()
    begins = np.r_[0, np.cumsum([n for n, _, _ in pages])]
    for k in range(max((len(s) + len(u) for _, s, u in pages), default=0)):
        some, state, slot, right, many = [], [], [], [], []
        for p, (n, steps, above) in enumerate(pages):
            if k < len(steps):
                s = steps[k]
                parts = s.state, s.slot, s.right, s.many
            elif k < len(steps) + len(above):
                own, rest, kept, others = above[k - len(steps)]
                beside = np.zeros((FAN - 1, 32), np.uint8)
                beside[:rest] = np.frombuffer(others, np.uint8).reshape(-1, 32)
                parts = (
                    np.broadcast_to(np.frombuffer(kept, np.uint8), (n, 32)),
                    np.full(n, own),
                    np.broadcast_to(beside, (n, FAN - 1, 32)),
                    np.full(n, rest),
                )
            else:
                continue
            some.append(np.arange(begins[p], begins[p + 1]))
            for to, x in zip((state, slot, right, many), parts, strict=True):
                to.append(x)
        rows = np.concatenate(some)
        digests[rows] = resume(
            np.concatenate(state), np.concatenate(slot), digests[rows], np.concatenate(right), np.concatenate(many)
        )
    return digests


VERIFIED = "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verified(root: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["tree", "page"]):
            ids = table.column("doc_id").combine_chunks()
            pages, rows, changed, proofs, subroots, leaves = [], [], [], [], [], []
            for a, b, c in _pages(table):
                first = next(i for i in range(a + 1, b) if c["kind"][i] == 2)
                steps = steps_of([(c["level"][i], c["at"][i], c["a"][i], c["b"][i]) for i in range(a + 1, first)], b - first)
                pages.append((b - first, steps, unpacked(c["b"][a])))
                rows += range(first, b)
                leaves += [x.hex() for x in c["a"][first:b]]
                changed += [x or y for x, y in zip(c["b"][first:b], c["a"][first:b], strict=True)]
                subroots += [c["c"][a].hex()] * (b - first)
                proofs += [hashlib.sha256(beside_of(steps, k) + c["a"][a]).hexdigest() for k in range(b - first)]
            folded = [x.tobytes() for x in fold(np.frombuffer(b"".join(changed), np.uint8).reshape(-1, 32), pages)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows, pa.int64())),
                    pa.array(leaves, pa.string()),
                    pa.array(subroots, pa.string()),
                    pa.array([root.hex()] * len(rows), pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array([x.hex() for x in folded], pa.string()),
                    pa.array([x == root for x in folded], pa.bool_()),
                ],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return run


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, changed) of each row; ``changed`` is the digest of rows that are tampered with.

    Trees stand in the order of their name: the empty one, of rows without a source, first.
    """
    number = F.col("doc_id").cast("string")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        "doc_id",
        leaf([*others, F.col("text")]).alias("digest"),
        F.when(F.crc32(number) % 2 == 0, leaf([*others, bare])).alias("changed"),
    )


def manifest(docs: DataFrame) -> tuple[Forest, Forest]:
    """The trees of all sources, and the tree above their roots, named ``''``."""
    forest = build(stored(leaves(docs), "merkle-digests"), ["doc_id", "digest"])
    roots = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest")
    return forest, build(roots, ["source_tree"], "merkle-top")


def verify(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of each row, and the root folded from its changed digest."""
    forest, top = manifest(docs)
    kind = docs.schema["doc_id"].dataType
    row = top.roots.first()
    if row is None:
        return docs.sparkSession.createDataFrame([], VERIFIED.format(id=kind.simpleString()))
    root = bytes(row["digest"])
    start = docs.sparkSession.createDataFrame([("", 0, b"", b"", root)], PATHS)
    above = entry_paths(page_paths(top, start), top.rounds[0])
    named = lookup(
        above.select(F.col("page").alias("at"), "beside", "steps"),
        top.entries.select("at", F.col("source_tree").alias("tree"), F.col("digest").alias("subroot")),
        ["at"],
        "inner",
    )
    tops = named.select("tree", F.lit(0).cast("long").alias("page"), "beside", "steps", "subroot")
    by_page = page_paths(forest, tops)
    entries = forest.entries.select(
        "tree", F.floor(F.col("at") / PAGE).cast("long").alias("page"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "at",
        F.col("digest").alias("a"), F.col("changed").alias("b"), F.lit(None).cast("binary").alias("c"), "doc_id",
    )
    meeting = _meet(by_page, forest.rounds[0], entries)
    return meeting.mapInArrow(_verified(root), VERIFIED.format(id=kind.simpleString()))
