"""N-gram Jaccard self-join by a MinHash LSH forest and exact verification.

Documents become sets of word n-gram hashes. Equal sets are one class, represented by its least document. Each
representative has `trees` labels of MinHash values; a tree's labels, sorted, are its prefix trie. All labels of a tree are
looked up at the prefix of `base` values that the threshold allows at most to be common to all; longer prefixes are met below it, at LEVELS.

A document's matched prefix in a tree ends where it has little company (CROWD members at most), or is the longest one where it
always has more. Then prefixes are shortened level by level, least crowded places first, until a partner of the least similarity that the
document's size admits (at or above the threshold) is met with the target recall: the product over trees of (1 - s**length) must
fall below 1 - recall; where that leaves room, the most crowded places are not looked up. So crowded places of the forest are met
at long prefixes or not at all, and only as far as recall needs them. What decides is crowds, in powers of four, never whether a
node has two members or one: a choice that told a partner's presence from its absence would choose where the partner is not.

What a document looks up is a node; everybody below the shortest node that anybody looks up on its path meets there. (Recall is that
of one partner, taken on its own: agreements of several partners with a document are not independent, and lookups of both sides count.)

Candidates are verified on the sets of hashes (48 bits of each n-gram's), inside their node, as products of incidence matrices: no pair
becomes a row. A pair is counted only in the first tree where it shares a node. Large nodes are cut into blocks, and each pair
of blocks is verified apart, so no task holds more than two blocks. Only links per document and a spanning star per
verified node leave the tasks; classes are the connected components of the links.

Defined cases: a null, empty or wordless text has no n-grams, no links and a class of its own (such texts are not copies of each
other); a text with fewer words than n has one n-gram of all its words; repeated rows and equal sets share a class;
different texts with one id are members of their own; a null doc_id takes no part and comes back with a null class; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_text, pieces_of, released
from .components import components, written
from .words import Words, mix

SIGNED = "id long, row long, size int, key1 long, key2 long, least double, prefixes array<long>, tails array<int>"
FIELD, FIELDS = 5, 6  # bits of each value beyond the common prefix, and how many such values a label has at most
CROWD = 8  # members of a node that is looked up whole
LEVELS = (0, 1, 3)  # values beyond the common prefix at which prefixes are looked up
MEMBER = "tree int, node long, i int, j int, b int, id long, row long, labels binary, grams binary"
WIDTH = 1 << 16  # n-grams in a block of an incidence matrix


def prefix_depth(threshold: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix at which a pair of similarity `threshold` agrees in some tree with probability `recall`."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(size: int, threshold: float) -> float | None:
    """The least Jaccard similarity at or above the threshold that a set of `size` members can have with a different set."""
    best = None
    for other in range(max(1, int(size * threshold) - 1), int(size / threshold) + 2):
        common = int(np.ceil(threshold * (size + other) / (1 + threshold) - 1e-9))
        if common <= min(size, other) and common < max(size, other):
            value = common / (size + other - common)
            best = value if best is None else min(best, value)
    return best


def least_similarities(threshold: float, most: int = 1 << 10) -> np.ndarray:
    """The least similarity of a partner by the size of a set (up to `most`; larger sets as that); 0 where there is none."""
    out = np.zeros(most + 1)
    for size in range(1, most + 1):
        out[size] = least_similarity(size, threshold) or 0.0
    out[most] = threshold
    return out


def lookups(places: list[tuple[int, list[int]]], least: float, recall: float, trees: int, base: int) -> dict[int, int]:
    """{tree: level} of what a document looks up. places: (tree, members of its node at each of LEVELS) where it is not
    alone; it is alone in all other trees, which counts as looked up."""
    gain = [-np.log1p(-(least ** (base + x))) for x in LEVELS]
    crowd = lambda n: max(0, int(np.ceil(np.log2(max(n, 1) / CROWD) / 2)))
    classes = {tree: [crowd(n) for n in sizes] for tree, sizes in places}
    out = {tree: next((k for k, c in enumerate(cs) if not c), len(cs) - 1) for tree, cs in classes.items()}
    missing = -np.log(1 - recall)
    missing -= (trees - len(places)) * gain[0] + sum(gain[k] for k in out.values())
    steps = [(classes[t][k - 1], t) for t, k in out.items() if k]
    heapq.heapify(steps)
    while missing > 0 and steps:
        _, t = heapq.heappop(steps)
        missing -= gain[out[t] - 1] - gain[out[t]]
        out[t] -= 1
        if out[t]:
            heapq.heappush(steps, (classes[t][out[t] - 1], t))
    for c, t in sorted(((classes[t][k], t) for t, k in out.items()), reverse=True):
        if c and missing + gain[out[t]] <= 0:
            missing += gain[out.pop(t)]
    return out


def gram_sets(array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of distinct word n-grams of all texts, sorted within each; where each text's begin and the last ends)."""
    words = Words(*flat_text(array))
    grams = words.grams(n)
    counts = np.diff(words.first)
    at = np.flatnonzero(grams != np.iinfo(np.uint64).max)
    values, text = grams[at], words.text[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    for m in np.unique(counts[short]).tolist():
        some = short[counts[short] == m]
        values = np.concatenate([values, mix(words.grams(m)[words.first[some]] + np.uint64(m))])
        text = np.concatenate([text, some])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(counts) + 1))


def sign(docs: DataFrame, n: int, threshold: float, recall: float, trees: int, depth: int) -> DataFrame:
    """id, hash of the text, size of the set, 128 bits that name the set, the least similarity of its partners, and each
    tree's label: a hash of the values that all look up, and the others by FIELD bits each. No labels for sets without partners."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = rng.integers(1, 1 << 63, trees, dtype=np.uint64)
    base = prefix_depth(threshold, recall, trees, depth)
    depth = min(depth, base + FIELDS)
    partners = least_similarities(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text", 1 << 20):
                values, bounds = gram_sets(batch.column("text"), n)
                sizes = np.diff(bounds)
                least_of = partners[np.minimum(sizes, len(partners) - 1)]
                full = np.flatnonzero(sizes)
                heads, tails = np.zeros((2, len(sizes), trees), np.uint64)
                keys = np.zeros((2, len(sizes)), np.uint64)
                if len(full):
                    first = bounds[full]
                    for t in range(trees):
                        h, tail = np.full(len(full), salts[t]), np.zeros(len(full), np.uint64)
                        for d in range(depth):
                            least = mix(np.minimum.reduceat((values * factors[t * depth + d]) >> np.uint64(20), first))
                            if d < base:
                                h = mix(h ^ least)
                            else:
                                tail |= least >> np.uint64(64 - FIELD) << np.uint64(FIELD * (FIELDS - 1 - d + base))
                        heads[full, t], tails[full, t] = h, tail
                    keys[0, full] = mix(np.add.reduceat(mix(values), first) + sizes[full].astype(np.uint64))
                    keys[1, full] = mix(np.add.reduceat(mix(values ^ salts[0]), first) ^ salts[1 % trees])
                live = np.flatnonzero(least_of)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(least_of > 0, trees, 0))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (heads[live].ravel().view(np.int64), tails[live].ravel().astype(np.int32))]
                columns = [batch.column("id"), batch.column("row"), pa.array(sizes.astype(np.int32)), *(pa.array(k.view(np.int64)) for k in keys), pa.array(least_of), *lists]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SIGNED.split(", ")])

    return docs.mapInArrow(released(run), SIGNED)


def packed(values: np.ndarray) -> bytes:
    """The upper 48 of the 63 bits of sorted gram hashes: what members carry for their verification. (Two grams of a pair of texts with 500 each are confused once in a billion pairs.)"""
    return np.ascontiguousarray((values >> np.uint64(15)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Group:
    """The members of a node, or of two blocks of one: ids, the nodes that each meets others in, and sets."""

    def __init__(self, rows: list[tuple], tree: int, threshold: float, trees: int):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.rows = np.array([r[1] for r in rows], np.int64)
        self.block = np.array([r[2] for r in rows])
        self.nodes = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(len(rows), trees)
        sets = [unpacked(r[4]) for r in rows]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # n-grams that one member alone has are in no intersection
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        names = np.cumsum(shared) - 1
        some = shared[column]
        self.member, self.column = np.repeat(np.arange(len(rows)), self.sizes)[some], names[column[some]]
        self.begin = np.searchsorted(self.member, np.arange(len(rows) + 1))
        self.width = int(shared.sum())
        self.tree, self.threshold = tree, threshold

    def links(self, both: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Verified pairs of places, each once; with both, only pairs across the two blocks."""
        left, right = [], []
        n = len(self.ids)
        for a in range(0, n, step):
            for b in range(a, n, step):
                common = self._common(a, min(n, a + step), b, min(n, b + step))
                total = self.sizes[a : a + step, None] + self.sizes[None, b : b + step]
                ok = common >= self.threshold * (total - common) - 1e-6
                i, j = np.nonzero(ok)
                i, j = i + a, j + b
                keep = i < j
                if both:
                    keep &= self.block[i] != self.block[j]
                for t in range(self.tree):  # a pair is counted in the first tree that it meets in
                    keep &= (self.nodes[i, t] != self.nodes[j, t]) | (self.nodes[i, t] == 0)
                left.append(i[keep])
                right.append(j[keep])
        return np.concatenate(left), np.concatenate(right)

    def _common(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """Sizes of the intersections of members a..b with c..d, WIDTH n-grams at a time."""
        out = np.zeros((b - a, d - c), np.float32)
        for w in range(0, self.width, WIDTH):
            x = self._matrix(a, b, w)
            out += x @ (x if (a, b) == (c, d) else self._matrix(c, d, w)).T
        return out

    def _matrix(self, a: int, b: int, w: int) -> np.ndarray:
        out = np.zeros((b - a, min(WIDTH, self.width - w)), np.float32)
        lo, hi = self.begin[a], self.begin[b]
        member, column = self.member[lo:hi] - a, self.column[lo:hi] - w
        some = (column >= 0) & (column < out.shape[1])
        out[member[some], column[some]] = 1
        return out


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least place that each place is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def ngram_join(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.99999, trees: int = 16, depth: int = 8, block: int = 1024) -> DataFrame:
    """doc_id, class_id (least document of its class), rep_id (least document with the same set), n_links (other representatives at the threshold or above).

    block bounds the members of a group that a task holds at once (two blocks); groups of any size are verified whole.
    """
    return _classes(docs, id, text, n, threshold, recall, trees, depth, block).drop("row")


def texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, text and a hash of the text, which tells the texts of one id apart."""
    return docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))


def _classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.99999, trees: int = 16, depth: int = 8, block: int = 1024) -> DataFrame:
    """What ngram_join returns, and the hash of the row's text."""
    rows = texts(docs, id, text)
    base = prefix_depth(threshold, recall, trees, depth)
    signed = written(sign(rows.where("id is not null"), n, threshold, recall, trees, depth), "signed")
    # the least document of each set, with its labels, pre-aggregated: equal sets meet in no list and no join
    classes = signed.where("size > 0").groupBy("key1", "key2").agg(F.min(F.struct("id", "row", "least", "prefixes", "tails")).alias("rep"))
    reps = written(classes.select("key1", "key2", "rep.*"), "reps")
    classes = reps.select("key1", "key2", F.struct("id", "row").alias("rep"))
    reps = reps.select("id", "row", "least", "prefixes", "tails")
    met = forest(reps, recall, trees, base)
    members = rows.where("id is not null").join(met, ["id", "row"]).mapInArrow(released(_members(n, block, trees)), MEMBER)
    sorted_members = members.repartition("tree", "node", "i", "j").sortWithinPartitions("tree", "node", "i", "j", "id", "row")
    verified = written(sorted_members.mapInArrow(released(_verify(threshold, trees)), "id long, row long, root_id long, root_row long, links long"), "links")
    links = verified.groupBy("id", "row").agg(F.sum("links").alias("n"))
    links = links.select(F.struct("id", "row").alias("rep"), "n")
    roots = components(verified.select(F.struct("id", "row").alias("u"), F.struct(F.col("root_id").alias("id"), F.col("root_row").alias("row")).alias("v")).where("u <> v"))
    out = signed.select("id", "row", "key1", "key2").join(classes, ["key1", "key2"], "left")
    out = out.withColumn("rep", F.coalesce("rep", F.struct("id", "row"))).select("id", "row", "rep")
    out = out.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select(F.col("id").alias("doc_id"), F.coalesce("root.id", "rep.id").alias("class_id"), F.col("rep.id").alias("rep_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "row")
    nobody = rows.where("id is null").select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), "row")
    return out.unionByName(nobody)


def level_key(tail, level: int):
    """What a label's prefix has at a level beyond the common one."""
    shift = FIELD * (FIELDS - LEVELS[level])
    return F.shiftright(tail, shift) if isinstance(tail, Column) else tail >> shift


def forest(reps: DataFrame, recall: float, trees: int, base: int) -> DataFrame:
    """(id, row, groups) of the documents that share nodes: groups are (tree, node, members). reps: id, row, least, prefixes, tails."""
    leaves = reps.select("id", "row", F.posexplode(F.arrays_zip("prefixes", "tails")).alias("tree", "leaf")).select("id", "row", "tree", F.col("leaf.prefixes").alias("prefix"), F.col("leaf.tails").alias("tail"))
    # below shared prefixes only; counts are pre-aggregated
    shared = leaves.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    live = written(leaves.join(shared, ["tree", "prefix"]), "live-labels")
    # the tries: labels in order; how many share longer prefixes is counted along them, batch by batch, and decides costs only
    tries = live.repartitionByRange("tree", "prefix", "tail", "id").sortWithinPartitions("tree", "prefix", "tail", "id").mapInArrow(_sizes, "id long, row long, tree int, prefix long, tail int, sizes array<int>")
    places = tries.groupBy("id", "row").agg(F.collect_list(F.struct("tree", "prefix", "tail", "sizes")).alias("places"))
    asked = places.join(reps.select("id", "row", "least"), ["id", "row"]).mapInArrow(released(_ask(recall, trees, base)), "tree int, prefix long, level int, key int").distinct()
    path = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), level_key(F.col("tail"), i).alias("key")) for i in range(len(LEVELS))]))
    below = live.select("id", "row", "tree", "prefix", path.alias("p")).select("id", "row", "tree", "prefix", "p.level", "p.key").join(asked, ["tree", "prefix", "level", "key"])
    node = F.min_by(F.xxhash64("tree", "prefix", "level", "key"), "level")
    below = written(below.groupBy("id", "row", "tree").agg(node.alias("node")), "nodes")
    sizes = below.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return below.join(sizes, ["tree", "node"]).groupBy("id", "row").agg(F.collect_list(F.struct("tree", "node", "members")).alias("groups"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted labels with the number of neighbours in the batch that share their prefix at each level, and at the first the exact number."""
    for batch in batches:
        tree, prefix, tail = (batch.column(c).to_numpy() for c in ("tree", "prefix", "tail"))
        sizes = [batch.column("members").to_numpy()]
        for level in range(1, len(LEVELS)):
            key = level_key(tail, level)
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]) | (key[1:] != key[:-1])]))
            n = np.diff(np.append(new, len(key)))
            sizes.append(np.repeat(n, n))
        table = np.stack(sizes, axis=1).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * len(LEVELS), pa.int32()), pa.array(table.ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row", "tree", "prefix", "tail")), lists], ["id", "row", "tree", "prefix", "tail", "sizes"])


def _ask(recall: float, trees: int, base: int):
    """The nodes that documents look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for places, least in zip(batch.column("places").to_pylist(), batch.column("least").to_pylist(), strict=True):
                where = {p["tree"]: p for p in places}
                for tree, level in lookups(sorted((t, p["sizes"]) for t, p in where.items()), least, recall, trees, base).items():
                    p = where[tree]
                    out.append((tree, p["prefix"], level, level_key(p["tail"], level)))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["tree", "prefix", "level", "key"])

    return run


def _members(n: int, block: int, trees: int):
    """Each document once per node and pair of blocks that it is in, with its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEMBER.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for whole in batches:
            for batch in pieces_of(whole, "text", 1 << 20):
                values, bounds = gram_sets(batch.column("text"), n)
                out: list[tuple] = []
                held = 0
                for k, (id, row, groups) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "row", "groups")), strict=True)):
                    grams = packed(values[bounds[k] : bounds[k + 1]])
                    nodes = np.zeros(trees, np.int64)
                    for g in groups:
                        nodes[g["tree"]] = g["node"]
                    labels = nodes.tobytes()
                    mixed = int(mix(np.array([id ^ row], np.int64).view(np.uint64))[0])
                    for g in groups:
                        blocks = -(-g["members"] // block)
                        b = mixed % blocks
                        for other in range(blocks):
                            out.append((g["tree"], g["node"], min(b, other), max(b, other), b, id, row, labels, grams))
                            held += len(grams) + 200
                            if held > 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)
                                out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

    return run


def _verify(threshold: float, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]

        def close(key, rows: list[tuple]) -> None:
            # repeated rows of a document are one member
            rows = [r for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]
            if len(rows) < 2 or key[2] != key[3] and len({r[2] for r in rows}) < 2:
                return
            group = Group(rows, key[0], threshold, trees)
            left, right = group.links(key[2] != key[3])
            if len(left):
                n = len(rows)
                degree = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
                root = spanning(n, left, right)
                some = np.flatnonzero(degree)
                for column, values in zip(out, (group.ids[some], group.rows[some], group.ids[root[some]], group.rows[root[some]], degree[some]), strict=True):
                    column += values.tolist()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "row", "root_id", "root_row", "links"])
            for x in out:
                x.clear()
            return batch

        key, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "node", "i", "j", "id", "row", "b", "labels", "grams")]
            for r in zip(*columns, strict=True):
                if r[:4] != key:
                    if rows:
                        close(key, rows)
                    key, rows = r[:4], []
                rows.append(r[4:])
            if len(out[0]) > 100_000:
                yield flush()
        if rows:
            close(key, rows)
        yield flush()

    return run


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the least document of each class only, same columns; documents without id stay. Of an id with different texts only the rows of those that are copies go."""
    gone = _classes(docs, id, text, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("__j_id"), F.col("row").alias("__j_row")).distinct()
    same = (docs[id] == gone["__j_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["__j_row"])
    return docs.join(gone, same, "left_anti")
