from collections import Counter, defaultdict

import corpus_pipeline as pipe
from recallgrid.llm import packing, rules, simhash
from tests.llm import edge
from tests.llm.test_dedup import slow_lines
from tests.llm.test_other import WORD, check_packed, library_ids, slow_measure, slow_targets
from tests.llm.test_similar import slow_similar

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in df.collect()), key=repr)


def slow_kept(text):
    n, chars, symbols, dup, repeat, lines, upper, letters, run = slow_measure(text or "")
    return not (
        n < 10 or 100 * repeat > 20 * n or 10 * symbols > 3 * n or chars < 2 * n or chars > 20 * n or 2 * dup > lines or (2 * upper > letters and letters >= 40) or run >= 8
    )


def slow_stages(docs):
    """docs: (doc_id, text, source, n_chars); what each of the first three stages keeps."""
    a = [d for d in docs if slow_kept(d[1])]
    by = {i: d for d in a for i in [d[0]]}
    b = []
    for i, text, _, dropped in slow_lines([(d[0], d[1]) for d in a]):
        if dropped and not text.strip(" "):
            continue
        b.append((i, text, by[i][2], len(text)))
    least = {min(g) for g in slow_similar([(d[0], d[1]) for d in b])}  # five words, similarity 0.8
    return a, b, [d for d in b if d[0] in least]


def key(x):
    return sorted(x, key=repr)


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_stages(rows(docs))
    now = docs
    for (name, stage), expect in zip(pipe.STAGES, want):
        out = stage(spark, now, SF)
        assert out.columns == docs.columns, name
        assert rows(out) == key(expect), name
        now = out
    mixed = pipe.STAGES[3][1](spark, now, SF)
    assert mixed.columns == docs.columns
    size = defaultdict(int)
    for _, t, s, _ in want[2]:
        size[s] += len(WORD.findall(t))
    names = sorted(size)
    target = dict(zip(names, slow_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    got, texts = Counter(), {d[0]: d[1] for d in want[2]}
    for i, t, s, n in rows(mixed):
        got[s] += len(WORD.findall(t))
        assert texts[i].startswith(t) and n == len(t)
    assert {s: got[s] for s in names} == {s: round(target[s]) for s in names}
    final = pipe.STAGES[4][1](spark, mixed, SF).collect()
    ids = library_ids([(i, t) for i, t, _, _ in rows(mixed)])
    check_packed(final, ids)
    assert sum(r["length"] for r in final) == sum(len(x) for v in ids.values() for x in v)


def test_run_is_the_stages_in_order(spark):
    got = pipe.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipe.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    ids = library_ids([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r["length"] for r in got.collect()) == sum(len(x) for v in ids.values() for x in v)
    assert [n for n, _ in pipe.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_windows"] and pipe.ORACLE_SQL is None


def test_stages_on_awkward_and_empty_tables(spark):
    for now in (edge.table(spark), edge.table(spark).limit(0), edge.table(spark, [(1, None, None)])):
        first = now
        for name, stage in pipe.STAGES:
            out = stage(spark, first, SF)
            out.count()
            if name != "pack_windows":
                assert out.columns == now.columns
        for _, stage in pipe.STAGES[:-1]:
            now = stage(spark, now, SF)
        packing.pack(now).count()


def test_clean_documents_survive_the_filter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    clean = docs.where("quality = 1")
    long = rules.ledger(clean).where("__rg_n_words >= 10").count()
    assert rules.keep_good(clean).count() >= 0.98 * long
    assert simhash.RADIUS == 3
