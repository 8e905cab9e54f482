import random
from collections import defaultdict

import xxhash

from millrace.llm import simhash
from millrace.llm.components import components


def plain_fp(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def expected(rows):
    fps = [(d, plain_fp(t)) for d, t in rows]
    root = roots({f for _, f in fps}, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = defaultdict(list)
    for d, f in fps:
        if d is not None:
            least[root[f]].append(d)
    return sorted(((d, f"{f:016x}", min(least[root[f]], default=None)) for d, f in fps), key=str)


def test_majority_counts_beyond_lanes():
    rng = random.Random(1)
    import numpy as np

    for n in (1, 2, 254, 255, 256, 16321, 40000):
        h = np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        assert simhash.majority(h) == sum(1 << b for b in range(64) if 2 * bits[b] > n)


def test_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.near_dup_components(docs).collect()), key=str)
    assert got == expected(rows)


def test_odd_rows(odd, none):
    got = sorted((tuple(r) for r in simhash.near_dup_components(odd).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_dup_components(none).count() == 0


def test_all_pairs_within_radius_meet(spark):
    """Planted fingerprints around a few centres, by the pairwise way and by the way for dense buckets."""
    rng = random.Random(7)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 7)):
                f ^= 1 << b
            fps.add(f - (1 << 64) if f >> 63 else f)
    want = roots(fps, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for dense in (simhash.DENSE, 1):
        edges = [tuple(r) for r in simhash.links(table, dense).collect()]
        assert all(1 <= bin((a ^ b) & (2**64 - 1)).count("1") for a, b in edges)
        found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert {f: found.get(f, f) for f in fps} == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 160)}} | {}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and ids.count(None) == 1
    assert simhash.keep_one(none).count() == 0


def plain_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_keep_one_finds_edited_copies_beyond_the_radius(spark):
    """Each text has a copy with edited words: at 0.8 or more in 5-word shingles and over 3 bits apart it goes, below both it stays."""
    rng = random.Random(3)
    rows, gone = [], set()
    far = lambda a, b: bin(plain_fp(a) ^ plain_fp(b)).count("1") > 3
    while len(rows) < 160:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        edited = list(words)
        for i in rng.sample(range(len(words)), max(1, len(words) // rng.choice((12, 60)))):
            edited[i] = f"v{rng.randrange(5000)}"
        a, b, k = " ".join(words), " ".join(edited), len(rows)
        if far(a, b):
            rows += [(k, a), (k + 1, b)]
            if plain_jaccard(a, b) >= 0.8:
                gone.add(k + 1)
    assert 15 < len(gone) < 70
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - gone


def test_keep_one_of_a_crowd(spark):
    """A group of near copies larger than ``CROWD`` is found as by brute force."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(3 * simhash.CROWD):
        copy = list(base)
        for i in rng.sample(range(300), 3):
            copy[i] = f"v{rng.randrange(5000)}"
        rows.append((k, " ".join(copy)))
    sets = [frozenset(simhash.shingles(t.encode(), 5).tolist()) for _, t in rows]
    fps = [plain_fp(t) for _, t in rows]
    alike = lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = set(roots(range(len(rows)), alike).values())
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_keep_one_finds_the_only_partner_in_a_crowd(spark):
    """Texts that share most words, so that bands are crowds, each with one similar text among them: every pair is found."""
    rng = random.Random(6)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(220)], []
    for k in range(0, 400, 2):
        both = [f"p{rng.randrange(10**6)}" for _ in range(60)]
        for j in (k, k + 1):
            rows.append((j, " ".join(base + both + [f"q{rng.randrange(10**6)}" for _ in range(20)])))
    assert plain_jaccard(rows[0][1], rows[1][1]) >= 0.8 and plain_jaccard(rows[0][1], rows[2][1]) < 0.7
    sets = [frozenset(simhash.shingles(t.encode(), 5).tolist()) for _, t in rows]
    fps = [plain_fp(t) for _, t in rows]
    alike = lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = set(roots(range(len(rows)), alike).values())
    assert len(want) > 120
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want
