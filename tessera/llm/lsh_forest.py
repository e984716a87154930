"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document's shingles are its runs of five words. It has a label of ``levels`` MinHash values in each of ``trees`` tries.

1. Equal texts are one node (a digest); copies are never paired.
2. The labels of all tries are sorted by range. Neighbours in that order share the longest prefixes, so one pass tells each
   node how long a prefix it shares with any other in each trie; labels that share less than the floor are leaves alone.
3. Nodes that share a prefix at the floor, the longest prefix at which even a pair at the threshold meets with the target
   probability, are dealt by connected components. A component of over ``block`` nodes is cut into slices of nodes with equal
   prefixes, and only slices that hold nodes that met are compared.
4. In a job, nodes first meet where whole labels agree, and what meets is verified exactly. Then prefixes are shortened level
   by level, for those nodes only that still fall short of the target recall (Bawa, Condie and Ganesan, 2005). A link of
   similarity s is found at depth d with the chance 1 - (1 - s^d)^trees, so the links that a node has say how many it
   lacks: each stands for (1 - chance) / chance more. A node without links is short until the floor. Sets are compared by
   sparse products; counts of links and a spanning forest leave a task, so rows grow with nodes and not with pairs.

Defined results: words are split at white space; texts of one to four words have a single shingle, all their words; null
texts count as empty; texts without words link to no other text, but equal ones share a class; null ids never name a class
unless all its ids are null; rows that repeat are each answered; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SINGLE_TASK_EDGES, Scratch, connected_components, map_arrow, row_of, shuffle_partitions

WORDS, THRESHOLD, TREES, LEVELS, TARGET = 5, 0.8, 20, 7, 0.999
#: Nodes that are sent to all executors at most, 48 bytes each; beyond that texts and nodes meet by a shuffle.
BROADCAST_NODES = 500_000


def recall(similarity: float, trees: int, depth: int) -> float:
    """Chance that a pair shares a prefix of ``depth`` levels in at least one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(trees: int, levels: int, threshold: float, target: float) -> int:
    """The longest prefix at which a pair at the threshold meets with the target probability; a single level if none does."""
    depth = levels
    while depth > 1 and recall(threshold, trees, depth) < target:
        depth -= 1
    return depth


def node_of(text: str) -> F.Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16)


class Shingler:
    """Distinct 64-bit hashes of a text's shingles; word hashes are remembered up to a bound."""

    def __init__(self, words: int = WORDS, remember: int = 300_000) -> None:
        self.words, self.remember, self.cache = words, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        cache, words = self.cache, (text or "").split()
        if len(cache) > self.remember:
            cache.clear()
        codes = []
        for w in words:
            c = cache.get(w)
            if c is None:
                c = cache[w] = xxhash.xxh64_intdigest(w)
            codes.append(c)
        a = np.array(codes, dtype=np.uint64)
        n = min(self.words, len(a))
        if not n:
            return a
        h = np.full(len(a) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + a[j : len(a) - n + 1 + j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return np.unique(h)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values, each the 16 high bits of a mixed minimum."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            x = shingles[i : i + 2048, None] * a + b
            x ^= x >> np.uint64(31)
            np.minimum(least, (x * np.uint64(0x94D049BB133111EB)).min(axis=0), out=least)
        least ^= least >> np.uint64(30)
        least *= np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(48)).astype("<u2")


def _sign(words: int, trees: int, levels: int, seed: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(1, 2**63, trees * levels, dtype=np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**63, trees * levels, dtype=np.uint64)
        shingles = Shingler(words)
        for batch in batches:
            labels = []
            for text in batch.column("text"):
                own = shingles(text.as_py())
                labels.append(signature(own, a, b).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(labels, pa.binary())], ["doc_id", "node", "labels"])

    return run


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, piece: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the ``left`` with the ``right`` sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, top, piece):
        a, b = np.searchsorted(column, (c, c + piece))
        width = min(piece, top - c)
        sides = []
        for k, n in ((0, len(left)), (1, len(right))):
            row = place[k, owner[a:b]]
            m = np.zeros((n, width), np.float32)
            m[row[row >= 0], column[a:b][row >= 0] - c] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def similarities(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs reach the threshold, by integers, and all similarities."""
    t = Fraction(threshold).limit_denominator(10_000)
    size = np.array([len(s) for s in sets], np.int64)
    both = intersections(sets, left, right).astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - both
    return (both * t.denominator >= union * t.numerator) & (both > 0), both / np.maximum(union, 1)


# --- tries


def shared_levels(labels: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Levels that each of the sorted labels (a row of values each) shares with the next; none with that of another trie."""
    same = (labels[1:] == labels[:-1]) & (tree[1:] == tree[:-1])[:, None]
    return np.cumprod(same, axis=1).sum(axis=1)


def _neighbours(levels: int, least: int):  # noqa: ANN202
    """Sorted labels to those that share at least ``least`` levels with a neighbour, and how many they share with the nearer.

    The first and the last of a task may have neighbours in other tasks, and count as shared whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, levels
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            raw = np.frombuffer(b"".join(table.column("label").to_pylist()), np.uint16).reshape(-1, levels)
            common = shared_levels(raw, table.column("tree").to_numpy())
            longest = np.maximum(np.concatenate([[before], common[:-1]]), common) if len(common) else common
            done = table.slice(0, len(table) - 1).append_column("longest", pa.array(longest, pa.int32()))
            before = int(common[-1]) if len(common) else before
            held = table.slice(len(table) - 1).to_batches()[0]
            yield from done.filter(pa.array(longest >= least)).combine_chunks().to_batches()
        if held is not None:
            yield pa.Table.from_batches([held]).append_column("longest", pa.array([levels], pa.int32())).to_batches()[0]

    return run


# --- verification


def met(labels: np.ndarray, left: np.ndarray, right: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Which pairs share a prefix of ``depth`` levels in a trie; ``labels`` has a row for each node."""
    out = np.zeros((len(left), len(right)), bool)
    levels = labels.shape[1] // trees
    for t in range(trees):
        own = np.ascontiguousarray(labels[:, t * levels : t * levels + depth]).view(f"V{2 * depth}").reshape(-1)
        _, code = np.unique(own, return_inverse=True)
        out |= code[left][:, None] == code[right][None, :]
    return out


def shorten(labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, trees: int, levels: int, least: int, target: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the ``left`` and the ``right`` nodes, how many more each node's links stand for, and the depth that it came to.

    Prefixes are shortened from ``levels`` to ``least`` for the nodes that fall short of the target recall.
    """
    n = len(sets)
    linked, known = np.zeros((2, len(left), len(right)), bool)
    similarity = np.zeros((len(left), len(right)))
    short, lacking, depth_of = np.ones(n, bool), np.zeros(n), np.full(n, levels)
    for depth in range(levels, least - 1, -1):
        depth_of[short] = depth
        want = met(labels, left, right, trees, depth) & ~known & (short[left][:, None] | short[right][None, :])
        want &= left[:, None] != right[None, :]
        i, j = np.flatnonzero(want.any(axis=1)), np.flatnonzero(want.any(axis=0))
        if len(i):
            involved = np.union1d(left[i], right[j])
            reach, near = similarities([sets[k] for k in involved], np.searchsorted(involved, left[i]), np.searchsorted(involved, right[j]), threshold)
            at = np.ix_(i, j)
            linked[at] |= reach & want[at]
            similarity[at] = np.where(want[at], near, similarity[at])
            known |= want
        a, b = np.nonzero(linked)
        chance = recall(similarity[a, b], trees, depth)
        more = (1 - chance) / np.maximum(chance, 1e-12)
        links = np.bincount(left[a], minlength=n) + np.bincount(right[b], minlength=n)
        lacking = np.bincount(left[a], more, n) + np.bincount(right[b], more, n)
        short = (links == 0) | (lacking > (1 - target) * (links + lacking))
        if not short.any():
            break
    return linked, lacking, depth_of


def _verify(words: int, threshold: float, trees: int, levels: int, least: int, target: float):  # noqa: ANN202
    """Texts in order of job to ``node, root, n_links, lacking, depth``: the least node that it is connected with in the job, its
    links there, how many more they stand for, and the prefix that they took."""

    def decide(rows: list[dict], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n, cross = len(rows), rows[0]["i"] != rows[0]["j"]
        side = np.array([r["slice"] == r["j"] for r in rows])
        left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(n), np.arange(n))
        if n < 2 or not len(left) or not len(right):
            return
        labels = np.stack([np.frombuffer(r["labels"], "<u2") for r in rows])
        hit, lacking, depth = shorten(labels, sets, left, right, threshold, trees, levels, least, target)
        a, b = np.nonzero(hit)
        if not len(a):
            return
        a, b = left[a], right[b]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        if not cross:  # each link was counted from both ends
            degree, lacking = degree // 2, lacking / 2
        nodes = [r["node"] for r in rows]
        by_rank = sorted(range(n), key=nodes.__getitem__)
        root = np.empty(n, np.int64)
        root[by_rank] = np.arange(n)
        while True:  # ranks are lowered along links
            lower = root.copy()
            np.minimum.at(lower, a, root[b])
            np.minimum.at(lower, b, root[a])
            if (lower == root).all():
                break
            root = lower
        own = np.flatnonzero(degree)
        yield pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i in own], pa.binary()), pa.array([nodes[by_rank[root[i]]] for i in own], pa.binary()), pa.array(degree[own], pa.int64()), pa.array(lacking[own], pa.float64()), pa.array(depth[own], pa.int32())],
            ["node", "root", "n_links", "lacking", "depth"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        at, rows, sets = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["component"], row["i"], row["j"])
                if key != at:
                    if rows:
                        yield from decide(rows, sets)
                    at, rows, sets = key, [], []
                sets.append(shingles(row.pop("text")))
                rows.append(row)
        if rows:
            yield from decide(rows, sets)

    return run


# --- the join


@dataclass(frozen=True)
class Joined:
    """``rows`` as of ``similar``; ``links`` are those found of each node and job, with the depth that it took and how many more they
    stand for."""

    rows: DataFrame
    links: DataFrame

    def recall(self) -> float:
        """The share of links that was found, as the links found tell; 1 without any."""
        found, lacking = self.links.agg(F.sum("n_links"), F.sum("lacking")).first()
        return found / (found + lacking) if found else 1.0

    def depths(self) -> dict[int, int]:
        """How many nodes with links stopped at each depth."""
        return {r.depth: r["count"] for r in self.links.groupBy("depth").count().collect()}


def join(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS,
    target: float = TARGET, least: int | None = None, block: int = 1024, broadcast_nodes: int = BROADCAST_NODES, single_task_edges: int = SINGLE_TASK_EDGES, seed: int = 1,
) -> Joined:
    """The join and what it found on its way. ``least`` is the shortest prefix, by default ``floor_depth``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "forest")
    parts = shuffle_partitions(spark)
    least = least or floor_depth(trees, levels, threshold, target)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), node_of(text_col).alias("node"))
    signed = scratch.save(map_arrow(rows, _sign(words, trees, levels, seed), "doc_id long, node binary, labels binary"), "signed")

    # the tries: labels of all, sorted by range, so that no prefix is too frequent for a task
    leaves = scratch.save(signed.where("labels is not null").select("node", "labels").distinct(), "leaves")
    label = F.substring("labels", F.col("tree") * (2 * levels) + 1, F.lit(2 * levels))
    tries = leaves.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select("tree", label.alias("label"), "node")
    tries = tries.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    shared = scratch.save(map_arrow(tries, _neighbours(levels, least), "tree int, label binary, node binary, longest int"), "shared")

    # nodes that share a prefix at the floor: each is a star around the least of them
    here = shared.select("node", F.xxhash64("tree", F.substring("label", 1, 2 * least)).alias("prefix"))
    heads = here.groupBy("prefix").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("prefix", "head")
    here = scratch.save(here.join(heads, "prefix"), "here")
    components = scratch.save(connected_components(scratch, here.select(F.col("node").alias("a"), F.col("head").alias("b")), "meet", single_task_edges), "components")
    jobs = scratch.save(_jobs(scratch, here, components, block, parts), "jobs")
    texts = docs.select(node_of(text_col).alias("node"), F.col(text_col).alias("text"))
    if components.count() <= broadcast_nodes:
        texts = texts.join(F.broadcast(components.select("node")), "node", "left_semi")
    texts = texts.groupBy("node").agg(F.first("text").alias("text")).join(jobs, "node").join(leaves, "node")
    texts = texts.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    linked = scratch.save(map_arrow(texts, _verify(words, threshold, trees, levels, least, target), "node binary, root binary, n_links long, lacking double, depth int"), "linked")
    degrees = linked.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min("root").alias("root"))
    if jobs.where("large").take(1):  # slices of one component each have a forest of their own
        joined = connected_components(scratch, linked.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes", single_task_edges)
        degrees = degrees.drop("root").join(joined.select("node", F.col("component").alias("root")), "node")
    degrees = scratch.save(degrees, "degrees")

    known = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    known = scratch.save(known.join(degrees, "node", "left"), "known")
    classes = known.where("root is not null").groupBy("root").agg(F.min("least").alias("class_least"))
    joined = known.where("root is not null").join(classes, "root").select("node", "n_copies", "n_links", F.col("root").alias("class_node"), F.col("class_least").alias("class_id"))
    alone = known.where("root is null").select("node", "n_copies", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("class_node"), F.col("least").alias("class_id"))
    known = scratch.save(joined.union(alone), "answers")
    scratch.drop("leaves", "shared", "here", "components", "jobs", "degrees", "known")
    return Joined(signed.select("doc_id", "node").join(known, "node").select("doc_id", "class_id", "n_links", "n_copies", "node", "class_node"), linked)


def _jobs(scratch: Scratch, here: DataFrame, components: DataFrame, block: int, parts: int) -> DataFrame:
    """``node, component, large, slice, i, j``: a row for each job that compares the node, slices ``i`` and ``j`` of its component."""
    sizes = scratch.save(components.groupBy("component").count(), "sizes")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    block = min(block, max(256, -(-total // (4 * parts))))  # about four slices a task; a text goes to as many jobs as its component has slices
    many = scratch.save(sizes.where(F.col("count") > block).select("component", F.lit(True).alias("large")), "many")
    zero = [F.lit(0).cast("long").alias(c) for c in ("slice", "i", "j")]
    if not many.take(1):
        return components.select("node", "component", F.lit(False).alias("large"), *zero)
    nodes = scratch.save(components.join(many, "component", "left").fillna(False, ["large"]), "nodes")
    # in a large component nodes with the same least prefix are dealt to one slice, or to several of their own if they are many
    own = here.join(nodes.where("large").select("node"), "node", "left_semi")
    keyed = scratch.save(nodes.where("large").join(own.groupBy("node").agg(F.min("prefix").alias("key")), "node").select("node", "component", "key"), "keyed")
    keys = scratch.save(keyed.groupBy("component", "key").agg(F.count("*").alias("n")), "keys")
    rest = keys.where(F.col("n") <= block).groupBy("component").agg(F.ceil(F.sum("n") / block).alias("slices"))
    dealt = keyed.join(keys, ["component", "key"]).join(rest, "component", "left")
    hot = F.col("n") > block
    place = F.when(hot, F.xxhash64("component", "key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)))).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("key"), F.col("slices"))))
    slices = scratch.save(dealt.select("node", "component", place.alias("slice")), "slices")
    spans = scratch.save(own.select("node", "prefix").join(slices.select("node", "slice"), "node").select("prefix", "slice").distinct(), "spans")
    meet = scratch.save(spans.join(spans.withColumnRenamed("slice", "other"), "prefix").where("slice < other").select("slice", "other").distinct(), "meet")
    i, j = F.col("slice").alias("i"), F.col("other").alias("j")
    pairs = meet.select("slice", i, j).union(meet.select(F.col("other").alias("slice"), i, j)).union(slices.select("slice", i, F.col("slice").alias("j")).distinct())
    large = slices.join(pairs, "slice").select("node", "component", F.lit(True).alias("large"), "slice", "i", "j")
    return nodes.where("not large").select("node", "component", "large", *zero).union(large)


def similar(docs: DataFrame, **options: object) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, n_copies, node, class_node``; options as of ``join``.

    ``class_id`` is the least id among all documents that links connect, ``n_links`` the number of different other texts
    at or above the threshold, ``n_copies`` the number of rows with this very text; nodes are digests of texts.
    """
    return join(docs, **options).rows


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` with the least id of each class, one per class, with all their columns."""
    found = similar(docs, id_col=id_col, text_col=text_col, **options).where("doc_id <=> class_id")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("class_node").orderBy("node"))).where("n = 1").select("doc_id", "node")
    rows = docs.select(row_of(docs), node_of(text_col).alias("node"), F.col(id_col).cast("long").alias("doc_id"))
    kept = rows.join(found, rows["node"].eqNullSafe(found["node"]) & rows["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("node", "doc_id").orderBy(F.lit(1)))).where("n = 1").select("row.*")
