from __future__ import annotations

import numpy as np
import pytest
import xxhash

from sparkloom.llm import simhash
from sparkloom.llm.graph import components
from sparkloom.llm.queries import op3_simhash, table


def brute(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    prints = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([prints[i] for i in ids], np.uint64)
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(values[a] ^ values[a + 1 :]) <= 4) + a + 1:
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, sf).collect()} == brute(rows)


@pytest.mark.parametrize("blocks", [1, 3, 5])
def test_links_are_exact_at_every_radius(spark, blocks, monkeypatch):
    """Random fingerprints in clusters; fewer blocks make leaves overlap, small leaves are dealt in chunks."""
    monkeypatch.setattr(simhash, "LEAF_ROWS", 60)
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    points = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(8)}
    values = np.array(sorted(points), np.uint64)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "node long, f0 long")
    found = simhash.near_links(df, 4, simhash.blocks_of(64, blocks), 4 // blocks, leaf_aim=40)
    got = {r.node: r.component for r in components(found).collect()}
    root = list(range(len(values)))
    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values[a] ^ values) <= 4):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    assert {i: got.get(i, i) for i in range(len(values))} == dict(enumerate(root))


def test_edges(documents):
    long = "lorem ipsum dolor sit amet " * 3000
    rows = [(5, None), (3, ""), (9, " \n"), (7, "one two"), (8, "ONE two"), (2, long), (6, long + "x"), (4, "something else here now")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    assert got[5] == got[9] == 3 and got[8] == 7 and got[6] == 2


def test_repeats_nulls_and_empty_table(documents):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(documents([(1, "a b"), (1, "a b"), (None, "a b"), (None, "z")])).collect()), key=str)
    assert got == [(1, 1), (1, 1), (None, 1), (None, None)]
    assert simhash.near_duplicates(documents([])).collect() == []


def test_stage_keeps_one_of_each_group(documents):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(300)]
    near = base.copy()
    near[150] = "changed"
    rows = [(10, " ".join(base)), (4, " ".join(near)), (11, " ".join(base)), (12, " ".join(word() for _ in range(300))), (None, " ".join(base))]
    kept = simhash.kept_of_near_duplicates(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [12, 4, None]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_stage_goes_by_exact_jaccard(documents):
    """Planted pairs just above and below 0.8, and repeated lines, in more rows than a leaf holds."""
    rng = np.random.default_rng(41)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, likeness = [], {}
    for i in range(150):
        base = [word() for _ in range(400)]
        # A prefix of k of n shingles has Jaccard k / n.
        near = base[: 4 + int(396 * (0.81, 0.85, 0.75)[i % 3])]
        a, b = shingles(base), shingles(near)
        likeness[1000 + i] = len(a & b) / len(a | b)
        rows += [(i, " ".join(base)), (1000 + i, " ".join(near))]
    line = [word() for _ in range(10)]
    text = [word() for _ in range(100)]
    rows += [(900, " ".join(text + line * 3)), (1900, " ".join(text + line * 40))]
    gone = {i for i, _ in rows} - {r.doc_id for r in simhash.kept_of_near_duplicates(documents(rows)).select("doc_id").collect()}
    assert 1900 in gone  # equal sets of shingles
    assert all(likeness[i] >= 0.8 for i in gone - {1900})
    for low, high, share in ((0.8, 0.83, 0.9), (0.83, 0.9, 0.95)):
        there = [i for i, v in likeness.items() if low <= v < high]
        assert len(there) >= 40 and sum(i in gone for i in there) >= share * len(there)


def test_all_candidates_in_other_components_are_asked_for(spark):
    """The components are those of all candidates that hold; nodes with all candidates told aren't asked again."""
    all_links = [(i, j, abs(i - j)) for i in range(60) for j in range(i)]
    asked_for = []

    def search(most, asked, parts):
        nodes = {r.node for r in asked.collect()} if asked is not None else set(range(60))
        of = {r.node: r.component for r in parts.collect()} if parts is not None else {}
        asked_for.append((most, nodes))
        rows = [(i, j) for i in nodes for _, j in sorted((d, j) for k, j, d in all_links if k == i and (not of or of.get(i, i) != of.get(j, j)))[:most]]
        return spark.createDataFrame(rows, "a long, b long")

    held = simhash.verified_links(lambda links: links.where("(a + b) % 3 = 0 or b = 7"), 4, search)
    tied = {r.node: r.component for r in simhash.components(held).collect()}
    root = list(range(60))
    for i, j, _ in all_links:
        if (i + j) % 3 == 0 or j == 7:
            x, y = root[i], root[j]
            root = [min(x, y) if r in (x, y) else r for r in root]
    assert all(tied.get(i, i) == root[i] for i in range(60))
    assert [m for m, _ in asked_for] == [4, simhash.ALL] and asked_for[1][1] == set(range(4, 60))


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def stage_components(rows, least=0.8):
    """Smallest ids of the groups that all links of a brute force tie."""
    root = {i: i for i, _ in rows}
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if jaccard(a, b) >= least:
                x, y = root[i], root[j]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("copies", [2, 10])
def test_a_bridge_beside_many_close_copies(documents, copies):
    """A document tied to one other and to a group of closer copies brings both together, however large the group is."""
    words = [f"v{i}" for i in range(400)]
    hub = " ".join(words)
    one = " ".join(words[:200] + [f"a{i}" for i in range(26)] + words[226:])
    group = [" ".join([f"b{i}" for i in range(26)] + words[26:395] + [f"c{k}{i}" for i in range(2)]) for k in range(copies)]
    rows = [(1, one), *((10 + k, t) for k, t in enumerate(group)), (100, hub)]
    assert jaccard(one, hub) > 0.85 and all(0.8 < jaccard(t, hub) and jaccard(t, one) < 0.78 for t in group)
    assert [r.doc_id for r in simhash.kept_of_near_duplicates(documents(rows)).select("doc_id").collect()] == [1]


def test_kept_documents_equal_all_links_of_a_brute_force(documents):
    """A few hundred rows in families of edited copies, chains and strangers; likenesses near the limit, which trees may miss, are left out."""
    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    rows = []
    for family in range(24):
        base = [word() for _ in range(150)]
        for _ in range(10):
            if rng.random() < 0.3:
                base = base.copy()
                base[int(rng.integers(150))] = word()  # the family drifts
            text = base.copy()
            for at in rng.choice(150, int(rng.integers(3)), replace=False):
                text[at] = word()
            rows.append((len(rows), " ".join(text)))
    order = rng.permutation(len(rows))
    rows = [(n, rows[i][1]) for n, i in enumerate(order)]
    strict = stage_components(rows, 0.87)
    loose = stage_components(rows, 0.8)
    kept = {r.doc_id for r in simhash.kept_of_near_duplicates(documents(rows)).select("doc_id").collect()}
    assert {r for i, r in loose.items()} <= kept <= {r for i, r in strict.items()}


@pytest.mark.parametrize("words", [1, 8])
def test_parity_bits_never_lose_a_pair_that_holds(words):
    """Against the exact Jaccard of random sets, small and large, exact equality with the limit included."""
    rng = np.random.default_rng(words)
    sets = [np.zeros(0, np.uint64), np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)]  # the last two: 8 of 10
    for size in (3, 9, 10, 90, 146, 600, 5000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.4):
            new = base.copy()
            new[: int(size * share)] = rng.integers(0, 1 << 63, int(size * share), dtype=np.uint64)
            sets.append(np.unique(new))
    bits = np.array([simhash.parity_bits(x, words) for x in sets])
    sizes = np.array([len(x) for x in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    left = {(int(i), int(j)) for x, y in simhash.possible(iter([(a, b)]), bits, sizes, 0.8) for i, j in zip(x, y)}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            union = len(x) + len(y) - both
            assert (i, j) in left or (union and both < 0.8 * union)
    assert (1, 2) in left and len(left) < len(a) * (0.7 if words == 1 else 0.5)


def test_search_with_parity_bits_loses_no_link(documents):
    """A group of copies far below and near 0.8: the same verified links as without the bits, from fewer candidates."""
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base, rows = [word() for _ in range(150)], []
    for i in range(120):
        text = base.copy()
        for at in rng.choice(150, 1 + i % 6, replace=False):
            text[at] = word()
        rows.append((i, " ".join(text)))
    docs = documents(rows)
    points = simhash.fingerprints(docs, shingle=5, words=4, distinct=True, parity=8).withColumnRenamed("doc_id", "node")
    points = simhash.materialize(points, "points")
    masks = simhash.trees_sampled(256, 48, 16)
    asked = points.select("node")
    found = [simhash.near_links(points, simhash.candidate_bits(0.8, 4), masks, 0, 4, 128, simhash.ALL, asked, None, parity, 0.8) for parity in (0, 8)]
    found = [simhash.materialize(f, "found") for f in found]
    held = [{tuple(r) for r in simhash.verified(f, docs, "doc_id", "text", 5, 0.8).collect()} for f in found]
    assert held[0] == held[1] and len(held[0]) > 100
    assert found[1].count() < found[0].count() / 2


def test_pairs_told_by_an_earlier_tree_are_not_told_again(documents, monkeypatch):
    """The links are those that every tree's pairs would give."""
    rng = np.random.default_rng(23)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(80):
        text = base.copy()
        for at in rng.choice(120, i % 5, replace=False):
            text[at] = f"x{i}"
        rows.append((i, " ".join(text)))
    points = simhash.materialize(simhash.fingerprints(documents(rows), shingle=5, words=4, distinct=True).groupBy("f0", "f1", "f2", "f3").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "node"), "points")

    def links(most):
        found = simhash.near_links(points, simhash.candidate_bits(0.8, 4), simhash.trees_sampled(256, 24, 16), 0, 4, 16, most)
        return {tuple(r) for r in found.collect()}

    got = {most: links(most) for most in (3, simhash.ALL)}
    monkeypatch.setattr(simhash, "met_before", lambda differing, masks: np.zeros(len(differing), bool))
    assert got == {most: links(most) for most in (3, simhash.ALL)} and len(got[simhash.ALL]) > len(got[3]) > 50


def test_no_folder_of_the_machine_on_a_cluster(spark):
    from sparkloom.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    import pytest

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    common.materialize(spark.range(3), "x")
    path = common.WRITTEN[-1]
    common.forget(spark)
    assert not common.WRITTEN and not list(__import__("glob").glob(path.removeprefix("file:") + "/*"))
