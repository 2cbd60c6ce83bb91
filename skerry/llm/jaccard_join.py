"""N-gram Jaccard join: prefix-tree join over globally ordered word shingles.

Rows with equal shingle sets share a node. Two prefix filters leave the nodes that may have a partner: the first takes
each set's smallest hashes, the second each set's rarest shingles (document frequency, then hash, is the global order).
Nodes that meet in a rare prefix form candidate clusters. In each cluster a compressed trie holds the ordered sets; a
set walks it once, sharing partial overlaps, and leaves subtrees that the remaining lengths cannot lift to the threshold
or that are already in its component. Large clusters are dealt out in blocks, so no task holds an unbounded group.

Defined results: null text, or text without words: no shingles, its own component. Fewer words than the shingle
length: the whole sequence is one shingle. Null doc_id: the row is returned with a null component and links nothing.
Repeated rows count as copies. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import hashing
from skerry.llm.components import components
from skerry.llm.exchange import Workspace, batches, binary_column, partitions, tasks_for, tidy
from skerry.llm.packs import by_shard, chunks, dump, load, pack

_PIECE = 1 << 20
_CHUNK = 8 << 20
#: Bytes of text in a shard of the nodes that may have a partner, and the shards that small tables have.
_SHARD, _FEW = 16 << 20, 24
#: A bucket's or chunk's counts go to a share of the shards: they are small, and each is a message.
_COUNTS = 16
#: What a text with a word has: a character that isn't white space.
_WORD = r"[^\x20\x09-\x0D]"


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array."""
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.concatenate(([True], new))]


def items_of(sets: np.ndarray) -> np.ndarray:
    """The first 48 bits of a set's hashes, in their order."""
    return _distinct(sets >> np.uint64(16))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    words, first = hashing.words_of(texts)
    whole = hashing.fold([words[k : len(words) - width + 1 + k] for k in range(width)]) if len(words) >= width else words[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(_distinct(np.sort(whole[a : b - width + 1])))
        elif b > a:
            out.append(hashing.fold([words[k : k + 1] for k in range(a, b)]))
        else:
            out.append(words[:0])
    return out


def node_of(sets: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set, the same for equal sets."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(sets.tobytes()) or 1)))


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's first items a partner of sufficient similarity must meet."""
    return n - -(-n * percent // 100) + 1


def sample_length(n: int, percent: int) -> int:
    """The first filter looks at a tenth of the set more than the prefix; that many items and one must then be shared."""
    return min(n, prefix_length(n, percent) + n // 10)


def pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def bucket_of(h48: np.ndarray, buckets: int) -> np.ndarray:
    return ((h48 >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(h48: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[tuple]:
    """The items of each bucket, in order of bucket and hash."""
    where = bucket_of(h48, buckets)
    order = np.lexsort((h48, where))
    h48, where, more = h48[order], where[order], [m[order] for m in more]
    cuts = np.flatnonzero(np.diff(where, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True):
        yield int(where[a]), h48[a:b], *(m[a:b] for m in more)


_SKETCH = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("text_hash", pa.int64()), ("size", pa.int64())])


def _sketch(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """kind 0: a row for each document; kind 1: sampled items of a bucket with a node that has each and whether others
    of the same chunk have it; kind 2: how many sampled items each node shares within its chunk."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def samples(held: dict[int, tuple[int, np.ndarray]]) -> Iterator[tuple]:
            if not held:
                return
            nodes = np.fromiter(held, np.int64, len(held))
            sizes = np.array([n for n, _ in held.values()], np.int64)
            h = np.concatenate([x for _, x in held.values()])
            who = np.repeat(np.arange(len(nodes), dtype=np.uint32), [len(x) for _, x in held.values()])
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            many = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
            count = np.bincount(who[many[np.cumsum(new) - 1]], minlength=len(nodes))
            for shard, payload in _by_node(nodes[count > 0], count[count > 0], sizes[count > 0], -(-buckets // _COUNTS)):
                yield 2, shard, 0, 0, 0, payload, 0, 0
            for bucket, items, lead, flag in _by_bucket(h[new], buckets, who[new], many):
                used, where = np.unique(lead, return_inverse=True)
                yield 1, bucket, 0, 0, 0, dump(pack48(items), nodes[used], sizes[used], where.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), np.packbits(flag)), 0, 0

        def out() -> Iterator[tuple]:
            held: dict[int, tuple[int, np.ndarray]] = {}
            weight = 0
            for b in it:
                ids, texts, hashes = b.column(0).to_pylist(), binary_column(b, "text"), b.column(2).to_pylist()
                at = 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= _PIECE):
                        size += len(texts[end])
                        end += 1
                    for doc, text_hash, text, s in zip(ids[at:end], hashes[at:end], texts[at:end], shingle_sets(texts[at:end], width), strict=True):
                        node = node_of(s) if len(s) and doc is not None else None
                        yield 0, 0, doc, node, len(s), b"", text_hash, len(text)
                        if node is not None and node not in held:
                            held[node] = len(s), items_of(s)[: sample_length(len(s), percent)]
                    weight += size
                    at = end
                    if weight >= _CHUNK:
                        yield from samples(held)
                        held, weight = {}, 0
            yield from samples(held)

        yield from batches(_SKETCH, out())

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(tidy(run), "kind int, shard int, doc_id bigint, node bigint, n bigint, payload binary, text_hash bigint, size bigint")


_PART = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_PART_SQL = "shard int, kind int, payload binary"


def _by_node(nodes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    where = hashing.mix(nodes.view(np.uint64)) % np.uint64(shards)
    for shard in np.unique(where):
        at = where == shard
        yield int(shard), dump(nodes[at], counts[at].astype(np.int64), sizes[at])


def _met(shards: int):
    """How many items each node shares with nodes of other chunks, where its own chunk hasn't counted them."""

    def met(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        h, who, size, flag = [], [], [], []
        for _kind, payload in rows:
            items, nodes, sizes, where, bits = load(payload)
            h.append(unpack48(items))
            who.append(nodes[where])
            size.append(sizes[where])
            flag.append(np.unpackbits(bits, count=len(where)).astype(bool))
        h, who, size, flag = (np.concatenate(x) for x in (h, who, size, flag))
        order = np.argsort(h)
        h = h[order]
        again = h[1:] == h[:-1]
        shared = np.concatenate((again, [False])) | np.concatenate(([False], again))  # an item that one chunk has counts nothing here
        h, order = h[shared], order[shared]
        who, size, flag = who[order], size[order], flag[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
        run = np.cumsum(new) - 1
        other = who != who[np.flatnonzero(new)][run]
        counted = (np.bincount(run, other | flag) > 0)[run] & ~flag
        nodes, first, count = np.unique(who[counted], return_index=True, return_counts=True)
        for shard, payload in _by_node(nodes, count, size[counted][first], shards):
            yield shard, 2, payload

    return met


_NODE = pa.schema([("node", pa.int64())])


def _enough(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
    """The nodes whose shared items are as many as a partner needs."""
    nodes, counts, sizes = (np.concatenate(x) for x in zip(*(load(p) for _, p in rows), strict=True))
    nodes, first, where = np.unique(nodes, return_index=True, return_inverse=True)
    n = sizes[first]
    yield from ((x,) for x in nodes[np.bincount(where, counts) >= np.minimum(n, 1 + n // 10)].tolist())


def _ask(buckets: int, width: int):
    """A shard's distinct shingles with the number of its nodes that have each."""

    def ask(shard: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        kept = list({node: s for cols, texts in chunks(rows) for node, s in zip(cols[0].tolist(), shingle_sets(texts, width), strict=True)}.values())
        items, count = np.unique(np.concatenate([items_of(s) for s in kept]), return_counts=True)
        for bucket, h, c in _by_bucket(items, buckets, count.astype(np.uint32)):
            yield bucket, shard, dump(pack48(h), c)

    return ask


def _answer(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
    """For each shard that asked, the number of nodes in all shards, in the order asked."""
    parts = [(shard, *load(p)) for shard, p in rows]
    h = np.concatenate([unpack48(x[1]) for x in parts])
    _, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([x[2] for x in parts]))[inverse].astype(np.uint32)
    at = 0
    for shard, raw, count in parts:
        yield shard, 1, dump(raw, total[at : at + len(count)])
        at += len(count)


_LISTS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("payload", pa.binary())])
_LISTS_SQL = "kind int, shard int, a bigint, b bigint, payload binary"


def _lists(buckets: int, width: int, percent: int):
    """kind 0: a node (a), its size (b) and its shared shingles; kind 1: rare-prefix postings; kind 2: nodes a, b that met."""

    def lists(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        answers = [load(p) for kind, p in rows if kind]
        known = np.concatenate([unpack48(x[0]) for x in answers]) if answers else np.zeros(0, np.uint64)
        total = np.concatenate([x[1] for x in answers]) if answers else np.zeros(0, np.uint32)
        order = np.argsort(known)
        known, total = known[order], total[order]
        seen: set[int] = set()
        heads, who = [], []
        for cols, texts in chunks(rows):
            for node, s in zip(cols[0].tolist(), shingle_sets(texts, width), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                items = items_of(s)
                df = total[np.searchsorted(known, items)]
                shared = items[df > 1]
                reach = prefix_length(len(s), percent) - (len(s) - len(shared))
                if reach <= 0:
                    continue
                yield 0, 0, node, len(s), dump(pack48(shared))
                head = shared[np.lexsort((shared, df[df > 1]))[:reach]]
                heads.append(head)
                who.append(np.full(len(head), node, np.int64))
        if not heads:
            return
        h, w = np.concatenate(heads), np.concatenate(who)
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        lead = w[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        for a, b in np.unique(np.stack((w[~new], lead[~new]), 1), axis=0).tolist():
            yield 2, 0, a, b, b""
        for bucket, items, first in _by_bucket(h[new], buckets, w[new]):
            yield 1, bucket, 0, 0, dump(pack48(items), first)

    return lists


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _meet(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
    """Each posting's node with the smallest node of the same shingle."""
    parts = [load(p) for _, p in rows]
    h, who = np.concatenate([unpack48(x[0]) for x in parts]), np.concatenate([x[1] for x in parts])
    order = np.lexsort((who, h))
    h, who = h[order], who[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    lead = who[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    yield from map(tuple, np.unique(np.stack((who[~new], lead[~new]), 1), axis=0).tolist())


class _Branch:
    """A compressed trie node: the edge's items, the sets that end here, and the nodes below."""

    __slots__ = ("edge", "ends", "below")

    def __init__(self, edge: np.ndarray):
        self.edge, self.ends, self.below = edge, [], []


#: Edges from a depth below this one end at it at the latest, deeper ones where they are twice as deep: bounds cut long paths early.
_REACH = 32


def _grow(order: list[int], sets: list[np.ndarray]) -> _Branch:
    """The trie of lexicographically sorted sets; order lists them."""
    root = _Branch(sets[0][:0])
    stack: list[tuple[int, int, int, _Branch]] = [(0, len(order), 0, root)]
    while stack:
        lo, hi, depth, at = stack.pop()
        while lo < hi and len(sets[order[lo]]) == depth:
            at.ends.append(order[lo])
            lo += 1
        while lo < hi:
            a, item = sets[order[lo]], sets[order[lo]][depth]
            end = lo + 1
            while end < hi and sets[order[end]][depth] == item:
                end += 1
            b = sets[order[end - 1]]
            n = min(len(a), len(b), max(_REACH, 2 * depth))
            differ = np.flatnonzero(a[depth:n] != b[depth:n])
            step = int(differ[0]) if len(differ) else n - depth
            child = _Branch(a[depth : depth + step])
            at.below.append(child)
            stack.append((lo, end, depth + step, child))
            lo = end
    return root


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as counted."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


class _Trie:
    """The trie as arrays, level by level, with bounds over all sets below each node: the longest rest, the least set size
    and, where all sets below are in one component, a set of it (else -1)."""

    def __init__(self, root: _Branch, sizes: np.ndarray, label: np.ndarray):
        nodes = [root]
        for x in nodes:  # grows while it is read
            nodes += x.below
        self.edges = np.concatenate([x.edge for x in nodes])
        self.length = np.array([len(x.edge) for x in nodes], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.kids = np.array([len(x.below) for x in nodes], np.int64)
        self.kid = 1 + np.cumsum(self.kids) - self.kids
        self.last = np.array([x.edge[-1] if len(x.edge) else 0 for x in nodes], np.int64)
        self.ends = np.array([k for x in nodes for k in x.ends], np.int64)
        self.end_count = np.array([len(x.ends) for x in nodes], np.int64)
        self.end = np.cumsum(self.end_count) - self.end_count
        own, size, kid, kids, length = label.tolist(), sizes.tolist(), self.kid.tolist(), self.kids.tolist(), self.length.tolist()
        longest, least, one = [0] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
        root_of = [-1] * len(nodes)
        for x in range(len(nodes) - 1, -1, -1):
            below, ends = range(kid[x], kid[x] + kids[x]), nodes[x].ends
            roots = {own[k] for k in ends} | {root_of[y] for y in below}
            if len(roots) == 1 and -1 not in roots:
                root_of[x] = roots.pop()
                one[x] = ends[0] if ends else one[kid[x]]
            longest[x] = max((length[y] + longest[y] for y in below), default=0)
            least[x] = min([*(size[k] for k in ends), *(least[y] for y in below)])
        self.longest, self.least, self.one = (np.array(v, np.int64) for v in (longest, least, one))


def link(sizes: list[int], lists: list[np.ndarray], labels: list[int], percent: int = 80, asks: list[bool] | None = None) -> list[int]:
    """The component of each set: a link is percent * union <= 100 * intersection. Sets of one label are known to be linked.

    Items that only one set has are left out of lists; sizes count them. asks: the sets whose links are searched, all by
    default; those between two others are left to other calls.
    """
    m = len(sizes)
    _, first, inverse = np.unique(np.array(labels), return_index=True, return_inverse=True)
    label = first[inverse]
    flat = np.concatenate(lists)
    items, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(items), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(items))
    codes = rank[inverse]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    size = np.array(sizes, np.int64)
    sets = [np.sort(codes[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    flat = np.concatenate(sets)
    enough = lambda o, x, y: (100 + percent) * o >= percent * (x + y)
    mask = np.zeros(len(items) + 1, bool)

    def join(k: int, others: np.ndarray) -> None:
        roots = np.unique(label[np.append(others, k)])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]

    # Hubs: one set of each component found so far against all sets at once. This only unites early what the trie would.
    tried = np.zeros(m, bool)
    for _ in range(64 if asks is None else 0):
        rest = np.flatnonzero(~tried)
        if not len(rest):
            break
        k = int(rest[0])
        mask[sets[k]] = True
        sums = np.concatenate(([0], np.cumsum(mask[flat])))
        overlap = sums[starts[1:]] - sums[starts[:-1]]
        mask[sets[k]] = False
        join(k, np.flatnonzero(enough(overlap, size[k], size)))
        if (label == label[0]).all():
            return label.tolist()
        tried |= label == label[k]

    trie = _Trie(_grow(sorted(range(m), key=lambda k: sets[k].astype(">u4").tobytes()), sets), size, label)
    for k in range(m) if asks is None else np.flatnonzero(asks).tolist():
        mine, n = sets[k], sizes[k]
        mask[mine] = True
        at, overlap, used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            good = enough(overlap + np.minimum(trie.longest[at], len(mine) - used), n, np.maximum(trie.least[at], -(-n * percent // 100)))
            at, overlap = at[good], overlap[good]
            if (count := trie.end_count[at]).any():
                j, shared = trie.ends[_spread(trie.end[at], count)], np.repeat(overlap, count)
                join(k, j[enough(shared, n, size[j])])
            count = trie.kids[at]
            at, overlap = _spread(trie.kid[at], count), np.repeat(overlap, count)
            open_ = (trie.one[at] < 0) | (label[trie.one[at]] != label[k])
            at, overlap = at[open_], overlap[open_]
            if not len(at):
                break
            length = trie.length[at]
            overlap = overlap + np.add.reduceat(mask[trie.edges[_spread(trie.start[at], length)]], np.cumsum(length) - length, dtype=np.int64)
            used = np.searchsorted(mine, trie.last[at], "right")
        mask[mine] = False
    return label.tolist()


def _link_tasks(rows: DataFrame, percent: int, parts: int | None = None) -> DataFrame:
    """rows: task, node, label, n, payload, asks. Edges a, b between each node and the least node of its component in the task;
    links between two nodes that don't ask aren't searched.

    parts: partitions; None lets Spark join small ones, which suits tasks that take time in proportion to their bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            task, held = None, []
            for b in it:
                for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if row[0] != task and held:
                        yield held
                        held = []
                    task = row[0]
                    held.append(row)
            if held:
                yield held

        def out() -> Iterator[tuple]:
            for held in groups():
                held = list({r[1]: r for r in sorted(held, key=lambda r: r[5])}.values())
                asks = [r[5] for r in held]
                roots = link([r[3] for r in held], [unpack48(load(r[4])[0]) for r in held], [r[2] for r in held], percent, None if all(asks) else asks)
                least: dict[int, int] = {}
                for r, root in zip(held, roots, strict=True):
                    least[root] = min(least.get(root, r[1]), r[1])
                for r, root in zip(held, roots, strict=True):
                    if r[1] != least[root]:
                        yield r[1], least[root]

        yield from batches(_EDGE, out())

    return rows.select("task", "node", "label", "n", "payload", "asks").repartition(*([parts] if parts else []), "task").sortWithinPartitions("task").mapInArrow(tidy(run), "a bigint, b bigint")


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text): components of the pairs of sufficient similarity.

    width: words in a shingle. percent: least similarity in percent. block: nodes of a candidate cluster in one task.
    """
    spark = docs.sparkSession
    space, parts = Workspace(spark, "jaccard"), partitions(spark)
    sketch, size = space.weighed(_sketch(docs, width, percent, parts), "sketch")
    rows = space.settle(sketch.where("kind = 0").select("doc_id", "node", "n", "text_hash", "size"), "rows")
    chosen, size = space.weighed(_chosen(sketch, rows, parts, tasks_for(size, parts)), "chosen", F.col("_size"))
    space.drop("sketch")
    shards = min(parts, max(_FEW, -(-size // _SHARD)))
    packs, size = space.weighed(_packs(docs, chosen, shards), "packs")
    space.drop("chosen")
    tasks = tasks_for(size, shards)
    lists = space.settle(_shared_lists(packs, width, percent, shards, tasks), "lists")
    space.drop("packs")

    edges = by_shard(lists.where("kind = 1"), tasks, _meet, "a bigint, b bigint", _EDGE)
    clusters = components(edges.unionByName(lists.where("kind = 2").select("a", "b")).distinct(), space, "met")
    roots = space.settle(_link_clusters(lists.where("kind = 0"), clusters, percent, block, parts, space), "roots")

    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(roots, "node", "left")
    least = space.settle(least.select("node", "doc_id", F.coalesce("root", "node").alias("root")), "least")
    heads = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = least.join(heads, "root").select("node", "component_id", "root")
    linked = rows.where("node is not null").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "root", "text_hash")
    alone = rows.where("node is null")
    alone = alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("root"), "text_hash")
    space.sweep()
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, the first by doc_id and text; rows that link nothing stay, repeated or not."""
    joined = jaccard_join(docs, width, percent)
    first = joined.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias("doc_"), F.col("x.text_hash").alias("hash_"))
    # Rows that link nothing go on as they are: however many there are, they meet in no task.
    links = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(_WORD), F.lit(False))
    keyed = docs.where(links).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), F.col("doc_id").cast("bigint").alias("id_"), F.xxhash64("text").alias("text_"))
    keyed = keyed.join(kept.hint("merge"), (F.col("id_") == F.col("doc_")) & (F.col("text_") == F.col("hash_")))
    again = F.row_number().over(Window.partitionBy("id_", "text_").orderBy("hash_"))  # exact repeats of one row only
    return keyed.withColumn("again_", again).where("again_ = 1").select("row_.*").unionByName(docs.where(~links))


def _chosen(sketch: DataFrame, rows: DataFrame, parts: int, tasks: int) -> DataFrame:
    """_node, _doc, _hash, _size: the nodes that share enough sampled items to have a partner, a document of each by its
    doc_id and the hash of its text, and the bytes of that text."""
    few = -(-parts // _COUNTS)
    met = by_shard(sketch.where("kind = 1"), tasks, _met(few), _PART_SQL, _PART)
    met = by_shard(met.unionByName(sketch.where("kind = 2").select("shard", "kind", "payload")), few, _enough, "node bigint", _NODE)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "size")).alias("x"))
    return nodes.join(met, "node").select(F.col("node").alias("_node"), F.col("x.doc_id").alias("_doc"), F.col("x.text_hash").alias("_hash"), F.col("x.size").alias("_size"))


def _packs(docs: DataFrame, chosen: DataFrame, shards: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64("text").alias("_hash"), "text").join(chosen.hint("merge"), ["_doc", "_hash"])
    return pack(texts.select(F.pmod(F.xxhash64("_node"), F.lit(shards)).cast("int").alias("shard"), F.col("_node").alias("node"), "text"), ["node"])


def _shared_lists(packs: DataFrame, width: int, percent: int, parts: int, tasks: int) -> DataFrame:
    asked = by_shard(packs, tasks, _ask(parts, width), _PART_SQL, _PART)
    answers = by_shard(asked, tasks, _answer, _PART_SQL, _PART)
    return by_shard(packs.unionByName(answers), tasks, _lists(parts, width, percent), _LISTS_SQL, _LISTS)


def _link_clusters(lists: DataFrame, clusters: DataFrame, percent: int, block: int, parts: int, space: Workspace) -> DataFrame:
    """node, root for the nodes that link; the links are those of the trie joins of all blocks of each cluster."""
    sized = clusters.join(clusters.groupBy("root").agg(F.count("*").alias("size")), "root")
    members = lists.select(F.col("a").alias("node"), F.col("b").alias("n"), "payload").join(sized.select("node", F.col("root").alias("cluster"), "size"), "node")
    members = space.settle(members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size"), "members")

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    name = lambda *x: F.concat_ws("/", *x)
    mine = members.select(name("cluster", own).alias("task"), "node", F.col("node").alias("label"), "n", "payload")
    large = members.where("blocks > 1")
    picks = [F.min_by(F.struct("node", "n", "payload"), F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in range(4)]
    hubs = large.groupBy("cluster", "blocks").agg(*picks)
    hubs = hubs.select("cluster", F.explode(F.array_distinct(F.array(*(f"h{k}" for k in range(4))))).alias("h"), "blocks")
    hubs = hubs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    extra = hubs.select(name("cluster", "block").alias("task"), "h.node", F.col("h.node").alias("label"), "h.n", "h.payload")
    first = space.settle(_link_tasks(mine.unionByName(extra).withColumn("asks", F.lit(True)), percent), "first")
    if not large.limit(1).count():
        return first.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(first.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

    roots = components(first, space, "blocks")
    labelled = large.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    count = labelled.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    most = count.groupBy("cluster").agg(F.max_by("label", "k").alias("most"), F.sum("k").alias("all"), F.max("k").alias("top")).where("all > top")
    most = most.withColumn("rests", F.ceil((F.col("all") - F.col("top")) / block).cast("int")).drop("all", "top")
    open_ = labelled.join(most, "cluster")
    rest = open_.where("label <> most").select("*", F.pmod(F.xxhash64("node"), F.col("rests")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
    every = open_.select("*", own.alias("c"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("r"))
    # Nodes of one block have met in the first round, so only the rest asks.
    cols = ["cluster", "r", "c", "node", "label", "n", "payload"]
    both = rest.select(*cols, F.lit(True).alias("asks")).unionByName(every.select(*cols, F.lit(False).alias("asks")))
    second = _link_tasks(both.withColumn("task", name("cluster", "r", "c")), percent, parts)
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(space.settle(known.unionByName(second), "second"), space, "all")
