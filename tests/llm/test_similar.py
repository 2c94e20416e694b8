from collections import defaultdict

import numpy as np

import corpus_pipeline as pipe
from recallgrid.llm import jaccard, simhash
from tests.llm import edge

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def slow_similar(rows, least=0.8):
    """rows: (id, text); the least id of each row's component under links of that similarity."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            lo, hi = sorted((len(sets[i]), len(sets[j])))
            if lo >= least * hi:
                both = len(sets[i] & sets[j])
                if both / (lo + hi - both) >= least:
                    parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[find(i)].append(d)
    return out.values()


def test_near_dedup_takes_near_copies_from_similarity_08(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = slow_similar(edge.texts(spark, SF))
    got = sorted(r["doc_id"] for r in pipe.near_dedup(spark, docs, SF).select("doc_id").collect())
    assert got == sorted(min(g) for g in groups)
    narrow = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    assert narrow - set(got)  # copies that 3 bits of 3-word shingles leave


def test_near_dedup_follows_chains_and_leaves_texts_below(spark):
    words = [f"w{i}" for i in range(400)]
    slide = [" ".join(words[12 * i : 12 * i + 200]) for i in range(12)]  # neighbours 0.88, from two steps on below 0.8
    far = [" ".join(words[:200]) + " " + " ".join(f"x{i}" for i in range(60))]
    rows = [(i, t, "a") for i, t in enumerate(slide + far + slide[:1])]
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(edge.table(spark, rows), shingle=5, similarity=0.8).collect())
    assert got == sorted(min(g) for g in slow_similar([(i, t) for i, t, _ in rows])) == [0, 12]


def test_near_dedup_links_by_bk_trees_what_no_band_holds(spark):
    # The repeated words weigh in SimHash, not in the sets of 8 and 10: similarity 0.8, 1 bit apart, no band in common.
    said = " ".join([" ".join(f"{c}56484" for c in "abcdefgh")] * 30)
    rows = [(1, said, "a"), (2, said + " z56484 y56484", "a"), (3, " ".join(f"v{i}" for i in range(60)), "a")]
    marked = jaccard.with_signature(edge.table(spark, rows).select("doc_id", "text"), "text", "fp", 5).collect()
    one, two, _ = sorted(marked, key=lambda r: r["doc_id"])
    assert not set(one["bands"]) & set(two["bands"]) and (one["sim"] ^ two["sim"]).bit_count() <= simhash.RADIUS
    assert all(r["sim"] % (1 << 64) == simhash.fingerprint(r["text"].encode(), 5) for r in marked)
    got = sorted(r["doc_id"] for r in pipe.near_dedup(spark, edge.table(spark, rows), SF).collect())
    assert got == sorted(min(g) for g in slow_similar([(i, t) for i, t, _ in rows])) == [1, 3]


def test_direct_links_span_and_lie_within_the_radius():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 12, (40, 60)).astype(np.uint64)))
    fps = np.unique(np.r_[fps, fps ^ np.uint64(1 << 5), fps ^ np.uint64(7 << 20)])
    for walk in (16, 4096):
        forest = simhash.BKForest(fps, np.arange(len(fps)) % 3)
        label = forest.components(3, walk, used := [])
        a, b = (np.concatenate(x) for x in zip(*used))
        assert (np.bitwise_count(forest.fp[a] ^ forest.fp[b]) <= 3).all()
        assert len(a) == (label != np.arange(len(label))).sum()
        assert (simhash.join(np.arange(len(label)), a, b) == label).all() and (label == forest.components(3)).all()


def test_near_dedup_on_awkward_rows(spark):
    df = edge.table(spark)
    ids = [r["doc_id"] for r in pipe.near_dedup(spark, df, SF).collect()]
    groups = slow_similar([(i, t) for i, t, _ in edge.ROWS])
    named = [[d for d in g if d is not None] for g in groups]
    assert sorted(i for i in ids if i is not None) == sorted(min(g) for g in named if g)
    assert ids.count(None) == sum(not g for g in named)
    assert pipe.near_dedup(spark, df.limit(0), SF).count() == 0


def test_rows_sharing_an_id_stay_by_their_own_component(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, texts[0], "a"), (2, texts[0], "a"), (2, texts[1], "a"), (2, texts[1], "b"), (3, texts[1], "a"), (3, texts[2], "a")]
    want = [(1, texts[0]), (2, texts[1]), (3, texts[2])]
    for given in ({}, {"shingle": 5, "similarity": 0.8}):
        for order in (rows, rows[::-1]):
            got = simhash.drop_near_duplicates(edge.table(spark, order).coalesce(1), **given)
            assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == want
    both = [(1, texts[0], "a"), (1, texts[1], "a"), (1, texts[1], "b")]
    got = simhash.drop_near_duplicates(edge.table(spark, both), shingle=5, similarity=0.8)
    assert sorted(r["text"] for r in got.collect()) == sorted(texts[:2])
