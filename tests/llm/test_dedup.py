import hashlib
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.llm import linededup, simhash, substring
from tests.llm import edge

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    """prints: list of (id, fingerprint); the least id reachable for each row."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f, least.get(find(i))) for i, (d, f) in enumerate(prints)]


def key(rows):
    return sorted(rows, key=repr)


def test_fingerprints_and_components_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = key((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    want = slow_components([(i, slow_fingerprint(t)) for i, t in edge.texts(spark, SF)])
    assert got == key((i, f"{f:016x}", c) for i, f, c in want)


def test_simhash_edge_rows(spark):
    df = edge.table(spark)
    got = key((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    want = slow_components([(i, slow_fingerprint(t)) for i, t, _ in edge.ROWS])
    assert got == key((i, f"{f:016x}", c) for i, f, c in want)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want if c is not None})
    assert ids.count(None) == len({f for i, f, c in want if c is None})
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_bk_forest_finds_every_link_for_any_number_of_blocks(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)])
    far = np.concatenate([near, near ^ np.uint64(7 << 20), near ^ np.uint64(1 << 63)])
    fps = np.unique(np.concatenate([base, far, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    forest = simhash.BKForest(fps, np.zeros(len(fps), np.int64))
    for walk in (7, 100_000):
        label = forest.components(3, walk)
        d = np.bitwise_count(forest.fp[:, None] ^ forest.fp[None, :])
        want = np.arange(len(fps))
        while True:
            new = np.where(d <= 3, want[None, :], len(fps)).min(1)
            if (new == want).all():
                break
            want = new
        assert (label == want).all()
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    from recallgrid.llm.common import Scratch
    from recallgrid.llm.components import connected_components

    counts = set()
    for blocks in (4, 5, 6):
        c = connected_components(simhash.shard_links(df, "fp", len(fps), blocks=blocks), Scratch(spark))
        groups = defaultdict(set)
        for r in c.collect():
            groups[r["root"]].add(r["node"])
        counts.add(frozenset(map(frozenset, groups.values())))
    assert len(counts) == 1
    want_groups = defaultdict(set)
    for f, w in zip(forest.fp.view(np.int64).tolist(), want.tolist()):
        want_groups[w].add(f)
    assert counts.pop() == frozenset(frozenset(g) for g in want_groups.values() if len(g) > 1)


def test_hot_shards_are_cut_finer_and_then_broadcast(spark, monkeypatch):
    from recallgrid.llm.common import Scratch
    from recallgrid.llm.components import connected_components

    rng = np.random.default_rng(0)
    far = np.unique((rng.integers(0, 1 << 62, 400, dtype=np.uint64) & ~np.uint64(0xFFFF)) | np.uint64(0xBEEF))
    fps = np.unique(np.r_[far, far[:60] ^ np.uint64(7 << 40), far[:60] ^ np.uint64(1 << 20), far[60:90] ^ np.uint64(3 << 30)])
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")

    def groups():
        out = defaultdict(set)
        for r in connected_components(simhash.shard_links(df, "fp", len(fps)), Scratch(spark)).collect():
            out[r["root"]].add(r["node"])
        return frozenset(map(frozenset, out.values()))

    want = groups()
    assert sum(map(len, want)) == 60 * 3 + 30 * 2
    for hot, levels, nodes in ((50, 2, 1 << 20), (50, 0, 100), (4, 1, 1 << 20)):
        monkeypatch.setattr(simhash, "HOT_SHARD", hot)
        monkeypatch.setattr(simhash, "LEVELS", levels)
        monkeypatch.setattr(simhash, "TREE_NODES", nodes)
        assert groups() == want


def test_components_of_a_long_chain_and_a_star(spark):
    from recallgrid.llm.common import Scratch
    from recallgrid.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[1000 + i] for i in range(200)} == {1000}


def slow_lines(rows, least=20, docs=3):
    def norm(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(norm(line)) >= least:
                holders[norm(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(norm(x), ())) >= docs and i != max((h for h in holders[norm(x)] if h is not None), default=i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return key(out)


def test_line_dedup_matches_brute_force(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_lines(edge.texts(spark, SF))
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", -1)
    assert key((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df).collect()) == want
    monkeypatch.setattr(linededup, "FULL", -1)
    monkeypatch.setattr(linededup, "SEGMENT_HASHES", 1)
    assert key((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df).collect()) == want
    monkeypatch.undo()
    got = key((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df).collect())
    assert got == slow_lines(edge.texts(spark, SF))


def test_line_dedup_edge_rows_and_a_full_filter(spark, monkeypatch):
    df = edge.table(spark)
    want = slow_lines([(i, t) for i, t, _ in edge.ROWS])
    run = lambda: key((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df).collect())
    assert run() == want
    assert sum(x[3] for x in want) > 0
    monkeypatch.setattr(linededup, "TWICE_BITS", 64)
    assert run() == want
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", -1)
    assert run() == want
    monkeypatch.setattr(linededup, "FULL", -1)  # filters stay with their segments
    assert run() == want
    out = linededup.dedup_lines(df)
    assert out.columns == [*(c for c in df.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped"]
    assert linededup.dedup_lines(df, n_lines="a", n_dropped="b").columns == [*df.columns, "a", "b"]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_blooms_never_miss():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = linededup.Blooms(1, 4096)
    zero = np.zeros(500, np.int64)
    b.set(zero, h)
    assert b.test(zero, h).all()
    other = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    assert linededup.Blooms(1, 4096).test(np.zeros(2000, np.int64), other).sum() == 0
    assert b.test(np.zeros(2000, np.int64), other).mean() < 0.2


def slow_cuts(text, least=substring.LEAST, most=substring.MOST):
    h, hs = 0, []
    for b in text:
        h = ((h << 1) + int(substring.GEAR[b])) & 0xFFFF
        hs.append(h)
    ends, last = [], 0
    while len(text) - last > 0:
        span = range(last + least, min(last + most, len(text)) + 1)
        end = next((e for e in span if hs[e - 1] & substring.MASK == 0), None)
        if end is None:
            if len(text) - last <= most:
                end = len(text)
            else:
                end = min(reversed(span), key=lambda e: hs[e - 1])
        ends.append(end)
        last = end
    if len(ends) > 1 and ends[-1] - ends[-2] < least:  # a short tail belongs to the chunk before it
        del ends[-2]
    return ends


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1500) | st.text("ab ", max_size=800).map(str.encode))
def test_chunks_match_the_plain_rolling_form(text):
    assert substring.cuts(text) == slow_cuts(text)


def test_cuts_resist_insertions():
    rng = np.random.default_rng(0)
    passage = bytes(rng.integers(97, 123, 400).astype(np.uint8))
    chunk = lambda t: {t[a:b] for a, b in zip([0, *substring.cuts(t)], substring.cuts(t))}
    one, two = chunk(b"x" * 57 + passage + b"tail"), chunk(bytes(rng.integers(97, 123, 301).astype(np.uint8)) + passage)
    assert sum(len(c) for c in one & two) > 200


def slow_report(rows):
    """``{id: (n_shared, n_dropped, spans, dropped spans, first ids)}`` from runs of adjoining repeated chunks."""
    size, seen = {i: len((t or "").encode()) for i, t in rows}, defaultdict(list)
    for i, t in rows:
        b, at = (t or "").encode(), 0
        for end in substring.cuts(b):
            seen[i].append((at, b[at:end]))
            at = end
    holders, first = defaultdict(set), {}
    for i in sorted(seen):
        for at, c in seen[i]:
            holders[c].add(i)
            first.setdefault(c, (i, at))
    out = {}
    for i in size:
        found = []
        for flag in (lambda at, c: len(holders[c]) > 1, lambda at, c: (i, at) != first[c]):
            runs, on = [], False
            for at, c in seen[i]:
                if flag(at, c):
                    runs = runs if on else [*runs, []]
                    runs[-1].append((at, c))
                on = flag(at, c)
            runs = [(r[0][0], sum(len(c) for _, c in r), r) for r in runs]
            found.append([r for r in runs if r[1] >= substring.PASSAGE or r[1] == size[i]])
        out[i] = (
            *(sum(len(r[2]) for r in runs) for runs in found), *([r[:2] for r in runs] for runs in found),
            sorted({first[c][0] for r in found[0] for _, c in r[2]}),
        )
    return out


def test_substring_report_matches_brute_force(spark):
    rows = edge.texts(spark, SF)
    got = substring.substring_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(got) == len(rows)
    places = lambda spans: [(s["start"], s["length"]) for s in spans]
    have = {r["doc_id"]: (r["n_shared"], r["n_dropped"], places(r["spans"]), places(r["dropped_spans"]), r["first_doc_ids"]) for r in got}
    assert have == slow_report(rows)
    for r in got:
        spans = places(r["spans"])
        assert bool(spans) == r["repeats"] and r["n_passages"] == len(spans)
        assert sum(n for _, n in spans) == r["shared_bytes"] and max([n for _, n in spans], default=0) == r["longest_passage"]
        assert sum(n for _, n in places(r["dropped_spans"])) == r["dropped_bytes"]


def test_shared_passages_are_caught_and_others_left(spark):
    rows = edge.texts(spark, SF)
    grams = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            grams[tuple(w[j : j + 50])].add(i)
    shared = {i for g in grams.values() if len(g) > 1 for i in g}
    short = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 9):
            short[tuple(w[j : j + 10])].add(i)
    for i, t in rows:
        short[t].add(i)  # a whole text, however short
    any_shared = {i for g in short.values() if len(g) > 1 for i in g}
    flagged = {r["doc_id"] for r in substring.substring_report(spark.read.parquet(f"{SF}/documents.parquet")).where("repeats").collect()}
    assert len(shared - flagged) <= 0.02 * len(shared)
    assert len(flagged - any_shared) <= 2


def test_substring_edge_rows(spark):
    df = edge.table(spark)
    got = {r["doc_id"]: r for r in substring.substring_report(df).collect()}
    assert len(got) == len({i for i, _, _ in edge.ROWS})
    # A whole text that another document holds is a passage however short.
    assert got[9]["n_shared"] and got[10]["n_shared"] and got[9]["n_dropped"] == 0 and got[10]["n_dropped"] > 0
    assert got[9]["first_doc_ids"] == [9] and got[10]["first_doc_ids"] == [9] and got[7]["first_doc_ids"] == []
    assert got[2]["n_bytes"] == 0 and got[7]["dropped_bytes"] > 500_000 and not got[7]["repeats"]
    assert substring.substring_report(df.limit(0)).count() == 0


def test_short_equal_texts_repeat(spark):
    got = substring.substring_report(edge.table(spark, [(1, "ok", "a"), (2, "ok", "a"), (3, "no", "a"), (4, "ok or not", "a")])).collect()
    assert {r["doc_id"]: (r["repeats"], r["n_dropped"], r["first_doc_ids"]) for r in got} == {1: (True, 0, [1]), 2: (True, 1, [1]), 3: (False, 0, []), 4: (False, 0, [])}


def test_long_texts_are_merged_in_a_line(spark):
    rng = np.random.default_rng(0)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(20_000)])
    long = " ".join(words[rng.integers(0, len(words), 400_000)])
    got = {r["doc_id"]: r for r in substring.substring_report(edge.table(spark, [(1, long, "a"), (2, "front " + long[1000:], "a")])).drop("source").collect()}
    assert got[2]["dropped_bytes"] > 0.99 * len(long) and got[1]["n_passages"] == 1


def test_digest_of_kept_lines(spark):
    from recallgrid.llm.queries import op5_line_dedup

    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in slow_lines(edge.texts(spark))}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in op5_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
