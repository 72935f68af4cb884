import random
import re

import numpy as np
import xxhash

from sheafwork.llm import simhash as S

from .helpers import AWKWARD, clusters, documents


def plain_fingerprint(text):
    """The contract word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(spark):
    texts = [t for _, t, _ in AWKWARD] + ["A b", "ÀB c D", "x " * 5, "a b c d e", "\x1ca b"]
    assert [S.fingerprint(None if t is None else t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_hash_is_that_of_spark(spark):
    one = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert one % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_components_equal_brute_force(spark):
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, k = list(AWKWARD), 100
    for _ in range(25):
        words = [random.choice(vocabulary) for _ in range(random.choice([2, 30, 400]))]
        for _ in range(random.randint(1, 6)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((k, " ".join(words), "en"))
            k += 1
    found = S.simhash_components(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    root = clusters(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    want = []
    for a, (i, _, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root[b] == root[a] and rows[b][0] is not None]
        want.append((i, f"{prints[a]:016x}", min(ids) if ids else None))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in found)


def test_links_across_leaves_and_in_a_dense_group(spark):
    """Random fingerprints with neighbours at 0 to 4 bits, long chains, and one group in which almost all are linked."""
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = [p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))) for p in np.repeat(points[:150], 3)]
    chain = [points[0]]
    for _ in range(60):
        chain.append(chain[-1] ^ np.uint64(0b111 << int(rng.integers(0, 60))))
    dense = [points[1] ^ np.uint64((1 << int(a)) | (1 << int(b))) for a in range(40) for b in range(a)]
    bits = np.unique(np.concatenate([points, np.array(near + chain + dense, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "fp long")
    label = {r["node"]: r["label"] for r in S.components(S.link_fingerprints(nodes)).collect()}
    ours = [label.get(int(x), int(x)) for x in bits.view(np.int64)]
    far = np.bitwise_count(bits[:, None] ^ bits[None, :])
    root = S._smallest(len(bits), *np.nonzero(far <= 3))
    groups, theirs = {}, {}
    for k in range(len(bits)):
        groups.setdefault(ours[k], set()).add(k)
        theirs.setdefault(int(root[k]), set()).add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in theirs.values()}


def test_full_leaves_are_split_by_their_own_rows(spark):
    """Tiny bounds of leaves and samples, fingerprints crowded in one corner, and some that agree in all bits of a half."""
    rng = np.random.default_rng(13)
    far = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    crowd = np.uint64(0x0123456789ABCDEF) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 6, replace=False)) for _ in range(500)], np.uint64)
    same_half = np.uint64(0xFFFF0000) | (rng.integers(0, 1 << 31, 300, dtype=np.uint64) << np.uint64(32))
    bits = np.unique(np.concatenate([far, far[:50] ^ np.uint64(7), crowd, same_half, same_half[:150] ^ np.uint64(1 << 40)]))
    nodes = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "fp long").repartition(3)
    label = {r["node"]: r["label"] for r in S.components(S.link_fingerprints(nodes, leaf_rows=16, sample_bound=256)).collect()}
    ours = [label.get(int(x), int(x)) for x in bits.view(np.int64)]
    root = S._smallest(len(bits), *np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3))
    groups, theirs = {}, {}
    for k in range(len(bits)):
        groups.setdefault(ours[k], set()).add(k)
        theirs.setdefault(int(root[k]), set()).add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in theirs.values()}
    assert 1 < max(len(g) for g in groups.values()) < len(bits)


def test_splitting_bounds_the_leaves(spark):
    rng = np.random.default_rng(14)
    bits = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    masks, settled = S.tree_masks(3), set()
    rows = spark.createDataFrame([(k, int(x), True) for x in bits.view(np.int64) for k in (0, 1)], "leaf long, fp long, home boolean").repartition(2)
    next_leaf, rounds = 1, 0
    while made := S._split_leaves(rows, masks, next_leaf, 100, 512, settled):
        rows, next_leaf = made
        rounds += 1
    sizes = [r["count"] for r in rows.where("home").groupBy("leaf").count().collect()]
    assert rounds > 1 and not settled and max(sizes) <= 200 and sum(sizes) == 2 * len(bits)


def test_routing_reaches_every_link():
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    points = np.unique(np.concatenate([points, points[:1500] ^ np.uint64(5), points[:700] ^ np.uint64(7 << 20)]))
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3, 1))
    assert len(a) > 1000
    met = np.zeros(len(a), bool)
    for mask, reach in S.tree_masks(3):
        tree = S.plan_tree(points[::7] & np.uint64(mask), 5)
        home, seen = {}, {}
        for leaf, own, at_home in S._route(tree, points, mask, reach):
            for p in own.tolist():
                (home if at_home else seen).setdefault(p, set()).add(leaf)
        assert all(len(v) == 1 for v in home.values()) and len(home) == len(points)
        for k, (x, y) in enumerate(zip(points[a].tolist(), points[b].tolist(), strict=True)):
            (hx,), (hy,) = home[x], home[y]
            met[k] |= hx == hy or hy in seen.get(x, ()) or hx in seen.get(y, ())
    assert met.all()


def test_dense_blocks_yield_the_same_groups():
    rng = np.random.default_rng(9)
    centre = np.uint64(1 << 40)
    bits = np.unique(np.array([centre ^ np.uint64((1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c))) for a, b, c in rng.integers(0, 64, (3000, 3))], dtype=np.uint64))
    member, root = S.leaf_stars(bits, np.zeros(0, np.uint64))
    far = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    want = S._smallest(len(bits), *np.nonzero(far))
    got = dict(zip(member.tolist(), root.tolist(), strict=True))
    assert len({got.get(x, x) for x in bits.tolist()}) == len(set(want.tolist()))


def test_empty(spark):
    empty = S.simhash_components(documents(spark, []))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0
