"""Near duplicates of the pipeline by the overlap of five-word shingles."""

from itertools import combinations

from wayfield.llm import neardup

DATA = "/root/testdata/sf0.01"


def overlapping(rows):
    """Pairs of ids whose sets of shingles have a similarity of 0.8 or more: exact, by an index of all shingles."""
    sets = {i: frozenset(neardup.shingles_of(t).tolist()) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for h in s:
            holders.setdefault(h, []).append(i)
    shared = {}
    for ids in holders.values():
        for pair in combinations(ids, 2):
            shared[pair] = shared.get(pair, 0) + 1
    return {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}


def test_all_pairs_are_grouped(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = overlapping(rows)
    assert any(dict(rows)[a] != dict(rows)[b] for a, b in pairs)
    root = {r.id: r.root for r in neardup.groups(docs).collect()}
    assert all(root[a] == root[b] for a, b in pairs)
    # The groups are those of the pairs, and nothing more (texts without words are one group).
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in [*pairs, *combinations([i for i, t in rows if not (t or "").split()], 2)]:
        up[max(find(a), find(b))] = min(find(a), find(b))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()}
    assert kept == {i for i in up if find(i) == i}


def test_large_group(spark):
    """More near copies than a bucket may pair, each with another word changed."""
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join([*base[: 7 * i], f"x{i}", *base[7 * i + 1 :]])) for i in range(50)] + [(99, "another text of a few words that stands alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in neardup.deduplicate(df).collect()} == {0, 99}


def components_of(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in up}


def test_no_link_is_lost_near_the_threshold(spark):
    """Texts of which few pairs are similar enough, all in large buckets: the groups are those of all pairs."""
    import random

    draw = random.Random(3)
    rows = []
    for t in range(2):
        base = [f"t{t}w{k}" for k in range(300)]
        for i in range(400):
            words = list(base)
            for at in draw.sample(range(300), 4 + t):
                words[at] = f"x{t}n{i}at{at}"
            rows.append((1000 * t + i, " ".join(words)))
    want = components_of([i for i, _ in rows], overlapping(rows))
    assert len(set(want.values())) > 2
    got = {r.id: r.root for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for i, root in got.items():
        least[root] = min(i, least.get(root, i))
    assert {i: least[root] for i, root in got.items()} == want


def test_blocks_meet(spark):
    """Any two members of a bucket with different roots share a cell."""
    rows = [(b, 10_000 * b + k, (0 if k < 150 else k) if b else k % 3, 50) for b in range(2) for k in range(230)]
    live = spark.createDataFrame(rows, "bucket long, key long, root long, size long")
    held = {}
    for r in neardup.block_cells(live).collect():
        held.setdefault(r.key, set()).add(r.cell)
    for b, k, root, _ in rows:
        assert all(held[k] & held[other] for b2, other, root2, _ in rows if b2 == b and root2 != root)


def test_similar_sets():
    import numpy as np

    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 9], [], [])]
    assert neardup.similar(sets, [7, 3, 5, 8, 9]) == {(3, 7)}
    assert neardup.similar(sets[:2], [4, 4]) == set() and neardup.similar(sets[3:], [1, 2]) == set()


def test_similar_sets_send_no_more_edges_than_groups():
    import numpy as np

    sets = [np.array([*range(1, 60), 100 + k], np.uint64) for k in range(40)]
    assert neardup.similar(sets, list(range(5, 45))) == {(5, g) for g in range(6, 45)}
