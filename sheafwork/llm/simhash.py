"""Near-duplicate detection: SimHash fingerprints linked through vantage-point trees.

Fingerprints are 64-bit SimHashes of three-word shingles. Two fingerprints link when they differ in at most ``radius`` bits. The
distinct fingerprints are dealt to the leaves of vantage-point trees: an inner node holds a vantage fingerprint and a threshold, and
sends a fingerprint inward if its Hamming distance to the vantage is below the threshold. By the triangle inequality a partner on
the other side of a threshold can exist only within reach of it, so only fingerprints that near a boundary are also sent, as
visitors, to the leaves beyond. Each leaf then finds its exact pairs with one more tree in memory. What a leaf returns is a star
for each connected group it sees, never its pairs; the stars are joined into components over the whole table.

There are two trees, one measuring distances on the lower half of the bits and one on the upper half. Of two fingerprints that differ
in 3 bits, one half differs in at most 1, so the tree of that half needs to reach 1 bit beyond a threshold only. Distances of 64 random
bits crowd around 32, and a reach of 3 would send most points to both sides at every level; the halves keep visitors few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import prepare, rows_of, texts_of

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Distinct fingerprints at home in a leaf, and the least number of leaves, which keeps a small table parallel.
LEAF_ROWS = 32_768
LEAST_LEAVES = 64
#: Fingerprints sampled per leaf to place the vantage points, and the bound of a whole sample.
SAMPLE_PER_LEAF = 64
SAMPLE_BOUND = 65_536
#: Trees, each over an equal part of the bits.
TREES = 2
#: Sides of the blocks that are compared without further pruning.
BLOCK_ROWS = 1024
_CHUNK = 1 << 19


def fingerprint(raw: bytes | None) -> int:
    """SimHash of one text: lower-cased A-Z, words between ASCII white space, XXH64 of three-word shingles, majority per bit."""
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    width = min(SHINGLE_WORDS, n)
    total = n - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        stop = min(total, at + _CHUNK)
        pieces = (text[s:e] for s, e in zip(starts[at:stop], ends[at + width - 1 : stop + width - 1], strict=True))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8", count=stop - at)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, raws in rows_of(batches):
        bits = np.array([fingerprint(raw) for raw in raws], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bits, pa.int64())], ["doc_id", "fp"])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number; null and empty texts have 0."""
    prepare(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


@dataclass
class Node:
    """An inner node of the tree; ``inner`` and ``outer`` are nodes or leaf numbers."""

    vantage: int
    threshold: int
    inner: Node | int
    outer: Node | int


def tree_masks(radius: int) -> list[tuple[int, int]]:
    """(mask of bits, reach) of each tree; of radius differing bits, at most the reach lie in some mask."""
    return [(0xFFFFFFFF, radius // TREES), (0xFFFFFFFF << 32, radius // TREES)]


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """The vantage point with the widest spread among a few candidates, and the median distance; None if it splits nothing."""
    tries = points[np.linspace(0, len(points) - 1, min(len(points), 12)).astype(int)]
    spread = [(far := _far(points, v)).std() for v in tries]
    vantage = tries[int(np.argmax(spread))]
    far = _far(points, vantage)
    threshold = int(np.median(far))
    if not (far < threshold).any():
        threshold += 1
    return (int(vantage), threshold) if 0 < (far < threshold).sum() < len(points) else None


def plan_tree(sample: np.ndarray, depth: int) -> Node | int:
    """A tree of ``depth`` levels whose leaves are numbered from inside to outside."""
    leaves = iter(range(1 << 62))

    def grow(points: np.ndarray, left: int) -> Node | int:
        cut = _split(points) if left and len(points) > 1 else None
        if cut is None:
            return next(leaves)
        near = _far(points, np.uint64(cut[0])) < cut[1]
        return Node(*cut, grow(points[near], left - 1), grow(points[~near], left - 1))

    return grow(sample, depth)


def _route(tree: Node | int, points: np.ndarray, mask: int, reach: int, home: bool = True) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, points, at home). A point is at home in one leaf, and visits the leaves further out that its ball reaches; what comes to
    the tree as a visitor visits only."""
    todo: list[tuple[Node | int, np.ndarray, bool]] = [(tree, points, home)]
    bits = np.uint64(mask)
    while todo:
        node, own, home = todo.pop()
        if not len(own):
            continue
        if isinstance(node, int):
            yield node, own, home
            continue
        far = _far(own & bits, np.uint64(node.vantage))
        if home:
            todo += [(node.inner, own[far < node.threshold], True), (node.outer, own[far >= node.threshold], True)]
            todo.append((node.outer, own[(far < node.threshold) & (far + reach >= node.threshold)], False))
        else:
            todo += [(node.inner, own[far - reach < node.threshold], False), (node.outer, own[far + reach >= node.threshold], False)]


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) connect it with."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label = label[label]


def _dense(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the matrix of matches connects, at most one for each row and column."""
    big = np.iinfo(np.int64).max
    label = np.arange(len(rows), dtype=np.int64)
    while True:
        of_cols = np.where(hit, label[:, None], big).min(axis=0)
        least = np.minimum(label, np.where(hit, of_cols[None, :], big).min(axis=1))
        if (least == label).all():
            break
        label = least
    met = of_cols < big
    return np.concatenate([rows, cols[met]]), np.concatenate([rows[label], rows[of_cols[met]]])


def _pairs(home: np.ndarray, guests: np.ndarray, bits: np.ndarray, radius: int, mask: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges between positions of bits: all links of ``home`` with ``guests`` (which hold home too), up to connectivity, among those
    that differ in at most ``reach`` bits of the mask."""
    todo, seen = [(home, guests)], bits & np.uint64(mask)
    while todo:
        own, other = todo.pop()
        if not len(own) or not len(other):
            continue
        cut = _split(seen[own]) if len(own) > BLOCK_ROWS else None
        if cut is not None:
            vantage, threshold = np.uint64(cut[0]), cut[1]
            near, far = _far(seen[own], vantage) < threshold, _far(seen[other], vantage)
            todo += [(own[near], other[far - reach < threshold]), (own[~near], other[far + reach >= threshold])]
            continue
        step = max(1, (1 << 22) // len(other))
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            hit = np.bitwise_count(bits[rows][:, None] ^ bits[other][None, :]) <= radius
            if np.count_nonzero(hit) <= 1 << 18:
                i, j = np.nonzero(hit)
                yield rows[i], other[j]
            else:
                yield _dense(hit, rows, other)


def leaf_stars(home: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, mask: int = (1 << 64) - 1, reach: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) for each group of two or more that links of ``home`` connect; fingerprints as unsigned numbers."""
    bits = np.unique(np.concatenate([home, visitors]))
    own = np.searchsorted(bits, np.unique(home))
    label = np.arange(len(bits))
    for a, b in _pairs(own, np.arange(len(bits)), bits, radius, mask, reach):
        la, lb = label[a], label[b]
        if (la != lb).any():
            label = _smallest(len(bits), la, lb)[label]
    moved = np.nonzero(label != np.arange(len(bits)))[0]
    return bits[moved], bits[label[moved]]


def _depth(rows: int, leaf_rows: int) -> int:
    return (-(-rows // leaf_rows) - 1).bit_length()


def _dealt(parts: list[tuple[int, np.ndarray, bool]]) -> pa.RecordBatch:
    leaf, home = (np.repeat([p[k] for p in parts], [len(p[1]) for p in parts]) for k in (0, 2))
    points = np.concatenate([own for _, own, _ in parts]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(points), pa.array(home, pa.bool_())], ["leaf", "fp", "home"])


def _split_leaves(rows: DataFrame, masks: list[tuple[int, int]], next_leaf: int, leaf_rows: int, sample_bound: int, settled: set[int]) -> tuple[DataFrame, int] | None:
    """Splits the leaves that hold over twice ``leaf_rows`` home rows by trees over samples of their own rows; None if there is none.

    At most ``sample_bound`` fingerprints are sampled in a round, so a round takes the fullest leaves and the next one goes on. A leaf
    whose rows agree in all bits of its mask cannot be split: it is ``settled``, and its pairs are found in blocks.
    """
    most = max(1, sample_bound // SAMPLE_PER_LEAF)
    sizes = rows.where("home").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf_rows)
    full = {r["leaf"]: r["n"] for r in sizes.orderBy(F.desc("n"), "leaf").limit(most + len(settled)).collect() if r["leaf"] not in settled}
    if not full:
        return None
    share = {leaf: max(2, sample_bound // len(full)) for leaf in full}
    wanted = {leaf: min(share[leaf], SAMPLE_PER_LEAF << _depth(n, leaf_rows)) for leaf, n in full.items()}
    take = F.create_map(*[F.lit(x) for leaf, n in wanted.items() for x in (leaf, n)])
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("fp"), "fp"))
    of_full = rows.where(F.col("home") & F.col("leaf").isin(list(full))).withColumn("rank", rank).where(F.col("rank") <= max(wanted.values()))
    points: dict[int, list[int]] = {leaf: [] for leaf in full}
    for r in of_full.where(F.col("rank") <= take[F.col("leaf")]).select("leaf", "fp").collect():
        points[r["leaf"]].append(r["fp"])
    trees: dict[int, tuple[Node | int, int]] = {}
    for leaf in sorted(full):
        mask, _ = masks[leaf % len(masks)]
        depth = min(_depth(full[leaf], leaf_rows), max(1, len(points[leaf]).bit_length() - 4))
        tree = plan_tree(np.array(points[leaf], np.int64).view(np.uint64) & np.uint64(mask), depth)
        if isinstance(tree, int):
            settled.add(leaf)
        else:
            trees[leaf] = tree, next_leaf
            next_leaf += 1 << depth

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            points, home, parts = fp.astype(np.int64).view(np.uint64), home.astype(bool), []
            for own in np.unique(leaf).tolist():
                here = leaf == own
                if own not in trees:
                    parts += [(own, points[here & (home == h)], h) for h in (True, False)]
                    continue
                tree, first = trees[own]
                k = own % len(masks)
                for h in (True, False):
                    parts += [((first + n) * len(masks) + k, got, at_home) for n, got, at_home in _route(tree, points[here & (home == h)], *masks[k], h)]
            if parts:
                yield _dealt(parts)

    return rows.mapInArrow(deal, "leaf long, fp long, home boolean").checkpoint(), next_leaf


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, sample_bound: int = SAMPLE_BOUND) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints ``nodes(fp)``.

    The first trees are planned on a bounded sample, and a leaf that turns out too full is split again by its own rows, until none is;
    samples place the boundaries only and drop nothing. On the driver are one round's sample and the trees, a few numbers for every
    ``leaf_rows`` fingerprints.
    """
    n = nodes.count()
    masks = tree_masks(radius)
    depth = min(max(_depth(LEAST_LEAVES, 1), _depth(max(1, n), leaf_rows)), _depth(max(1, sample_bound // SAMPLE_PER_LEAF), 1))
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(sample_bound, SAMPLE_PER_LEAF << depth)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = [plan_tree(sample & np.uint64(mask), depth) if len(sample) else 0 for mask, _ in masks]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            parts = []
            for k, (tree, (mask, reach)) in enumerate(zip(trees, masks, strict=True)):
                parts += [(leaf * len(masks) + k, own, home) for leaf, own, home in _route(tree, points, mask, reach)]
            if parts:
                yield _dealt(parts)

    def stars(table: pa.Table) -> pa.Table:
        mask, reach = masks[table.column("leaf")[0].as_py() % len(masks)]
        bits, home = table.column("fp").to_numpy().astype(np.int64).view(np.uint64), table.column("home").to_numpy()
        member, centre = leaf_stars(bits[home], bits[~home], radius, mask, reach)
        return pa.table({"a": member.view(np.int64), "b": centre.view(np.int64)})

    rows = nodes.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean").checkpoint()
    next_leaf, settled = 1 << depth, set()
    while made := _split_leaves(rows, masks, next_leaf, leaf_rows, sample_bound, settled):
        rows, next_leaf = made
    return rows.groupBy("leaf").applyInArrow(stars, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each cut off from its lineage by a checkpoint.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        # large star: all larger neighbours of a node go to its smallest one
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        # small star: all smaller neighbours of a node, and the node, go to the smallest one
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = moved.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b"))).distinct()


def _labelled(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes(fp, least)`` with the label of the component of each fingerprint."""
    nodes = nodes.checkpoint()
    member = components(link_fingerprints(nodes, radius)).checkpoint()
    return nodes.join(member, nodes["fp"] == member["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Null and empty texts have the fingerprint 0 and link like any other. Rows that repeat a doc_id stay, each with its own
    fingerprint. A null doc_id stays null, and never names a component unless no member has an id. An empty table gives an empty
    result. Other columns of docs are ignored. Exact copies meet as one node, so a large group of copies costs one row in the search.
    """
    fps = simhash_fingerprints(docs, id_col, text_col).checkpoint()
    labelled = _labelled(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), radius)
    of_label = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(of_label, "label").select("fp", "component_id").checkpoint()
    return fps.join(of_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, raws in rows_of(batches):
        bits = np.array([fingerprint(raw) for raw in raws], dtype=np.uint64).view(np.int64)
        digests = [hashlib.sha256(raw or b"").hexdigest() for raw in raws]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bits, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "fp", "digest"])


def first_of_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component of :func:`simhash_components`, with all columns of docs, whatever these are called.

    It is the row with the smallest doc_id, rows without an id last; of several such rows the one whose text has the smallest SHA-256.
    A row is known by its doc_id and that digest, so rows that repeat a doc_id with different texts are told apart, and so are rows
    without an id. Of rows alike in doc_id and text any one stays.

    Survivors are chosen on ids and digests alone. Texts move once, rows alike in doc_id and text are reduced to one before they do, and
    the join with the survivors uses the same distribution.
    """
    prepare(docs.sparkSession)
    fps = texts_of(docs, id_col, text_col).mapInArrow(_row_fingerprints, "doc_id long, fp long, digest string")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest"))
    labelled = _labelled(fps.groupBy("fp").agg(least.alias("least")), radius)
    first = labelled.groupBy("label").agg(F.min("least").alias("least"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    first = first.select("least.*").select(key, "digest")
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = whole.select("doc", key, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return rows.groupBy("key", "digest").agg(F.first("doc").alias("doc")).join(first, ["key", "digest"], "left_semi").select("doc.*")
