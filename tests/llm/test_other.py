import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recallgrid.llm import mixing, packing, quality, rules, tiff, tokens, toxicity
from tests.llm import edge

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality rules.
def slow_measure(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs, run, before = 0, 0, None
    for w in words:
        run = run + 1 if w == before else 1
        runs, before = max(runs, run), w
    return [
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines),
        sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text), runs,
    ]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "Cé", "#", "\n", " ", "\t", "x*", " ", "ß "]), max_size=80).map("".join))
def test_measurements_match_the_plain_form(text):
    assert rules.measure(text.encode()) == slow_measure(text)


def test_repeated_words_with_many_distinct_words():
    words = [str(i).encode() for i in range(9000)]
    assert rules.repeated_words(words) == 0
    assert rules.repeated_words(words + words[:5]) == 10


def test_ledger_policies_and_ablations(spark):
    df = edge.table(spark)
    led = rules.ledger(df)
    assert led.count() == len(edge.ROWS)
    got = {(r["doc_id"], r["text"]): [r["__rg_" + m] for m in rules.MEASURES] for r in led.collect()}
    assert got == {(i, t): slow_measure(t or "") for i, t, _ in edge.ROWS}
    for name, m in rules.POLICIES.items():
        kept = [r["__rg_failures"] for r in led.collect() if not r["__rg_failures"] & m]
        rows = {r["rule"]: r for r in rules.ablations(led, policy=name).collect()}
        assert len(rows) == bin(m).count("1")
        for i, rule in enumerate(rules.RULES):
            if m >> i & 1:
                bits = [r["__rg_failures"] & m for r in led.collect()]
                assert rows[rule.name]["kept"] == len(kept)
                assert rows[rule.name]["failed"] == sum(b >> i & 1 for b in bits)
                assert rows[rule.name]["kept_without"] == sum(not b & ~(1 << i) for b in bits)
    good = rules.keep_good(df)
    assert good.columns == df.columns
    assert rules.keep_good(df.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    led = rules.ledger(docs).withColumn("bad", rules.failed("__rg_failures", rules.CURRENT)).withColumn("base", rules.failed("__rg_failures", "base"))
    assert led.where("quality = 1 AND bad AND NOT base").count() <= 2
    assert led.where("quality = 0 AND NOT bad").count() <= 2


# Mixing.
def slow_targets(sizes, weights, share=1.5, cap=2):
    want, out, open_ = share * sum(sizes), [None] * len(sizes), set(range(len(sizes)))
    while open_:
        level = want / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > cap * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            want -= cap * sizes[i]
        open_ -= over
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_water_level_is_the_fixed_point(spark, sizes):
    rows = [(i, s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "n int, total long").withColumn("weight", mixing.cyclic_weights())
    got = {r["n"]: r["target"] for r in mixing.water_fill(df).collect()}
    want = slow_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[i] for i in range(len(sizes))] == pytest.approx(want, abs=1e-6)


def test_mix_meets_its_targets(spark):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), edge.table(spark)):
        rows = mixing.mix_report(df).collect()
        src = {}
        for r in df.collect():
            src.setdefault(r["doc_id"], []).append(r)
        assert len(rows) == df.count()
        sizes, targets = defaultdict(int), {}
        names = sorted({r["source"] for r in df.collect()}, key=lambda s: (s is None, s or ""))
        for r in df.collect():
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        for s, t in zip(names, slow_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])):
            targets[s] = t
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        by_target = defaultdict(int)
        for r in rows:
            by_target[r["source_size"], r["target"]] += r["taken"]
        want = defaultdict(float)
        for s in names:
            want[sizes[s], round(targets[s], 3)] += round(targets[s])
        assert {k: v for k, v in by_target.items() if v} == {k: v for k, v in want.items() if v}
        assert sorted(rows, key=repr) == sorted(mixing.mix_report(df.repartition(5)).collect(), key=repr)


def test_mixed_documents_follow_the_report(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(df).collect()}
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = defaultdict(int)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"])
    assert dict(got) == {k: v for k, v in taken.items() if v}
    clash = edge.table(spark)
    assert mixing.mix_documents(clash).columns == clash.columns
    assert mixing.mix_documents(clash.limit(0)).count() == 0 and mixing.mix_report(clash.limit(0)).count() == 0


# Packing.
def check_packed(rows, ids_of):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= packing.WINDOW
    for doc, pieces in by_doc.items():
        options = ids_of[doc]
        n_docs = len(options)
        if n_docs == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(options[0])
                part = np.array(options[0][at : at + r["length"]], "<u4").tobytes()
                assert zlib.crc32(part) == r["ids_crc32"]
                at += r["length"]
            assert at == len(options[0])
        else:
            assert sum(r["length"] for r in pieces) == sum(map(len, options))
    return len(by_seq)


def library_ids(rows):
    tok = tokens.library_tokenizer(tokens.default_vocabulary())
    out = defaultdict(list)
    for i, t in rows:
        out[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    return out


def test_packing_round_trip_and_padding(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(2)
    rows = packing.pack(df, with_ids=True).collect()
    ids = library_ids(edge.texts(spark, SF))
    used = check_packed(rows, ids)
    total = sum(len(x) for v in ids.values() for x in v)
    assert 1 - total / (used * packing.WINDOW) < 0.015
    assert all(r["ids"] == ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]] for r in rows)


def test_packing_edge_rows(spark):
    df = edge.table(spark)
    check_packed(packing.pack(df).collect(), library_ids([(i, t) for i, t, _ in edge.ROWS]))
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_places_every_piece(sizes, k):
    at = packing.differencing(sizes, k)
    assert len(at) == len(sizes) and at.min() >= 0 and at.max() < k
    windows, n = packing.pack_block(sizes, 512)
    seen = defaultdict(int)
    for w in windows:
        assert sum(p[2] for p in w) <= 512
        for i, start, length in w:
            seen[i] += length
    assert dict(seen) == dict(enumerate(sizes)) and n >= -(-sum(sizes) // 512)


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 200, 400).tolist()
    sums = np.bincount(packing.differencing(sizes, 8), weights=sizes, minlength=8)
    assert sums.max() - sums.min() <= 2
    assert packing.differencing([8, 7, 6, 5, 4], 2).tolist() in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 1, 0, 1, 0], [1, 0, 1, 0, 1], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0])


# Token counts.
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "don't", "123", "\n\n", "é", "🎉", "the"]), max_size=20).map("".join))
def test_the_fast_encoder_gives_the_library_ids(text):
    path = tokens.default_vocabulary()
    assert tokens.fast_encoder(path)(text) == tokens.library_tokenizer(path).encode(text, add_special_tokens=False).ids


def test_long_runs_go_to_the_library():
    path = tokens.default_vocabulary()
    for t in (" " * 300_000, "a" * 9000, "x" + "\n" * 5000 + "7" * 5000, "#" * 9000, "é" * 7999, "ab " * 3000 + " " * 3999):
        assert tokens.fast_encoder(path)(t) == tokens.library_tokenizer(path).encode(t, add_special_tokens=False).ids


def test_texts_move_only_where_too_many_digests_say_so(spark, tmp_path, monkeypatch):
    df = edge.table(spark)
    run = lambda d, c: sorted((tuple(r) for r in tokens.token_counts(d, cache=f"file://{tmp_path}/{c}").collect()), key=repr)
    want = run(df, "a")
    monkeypatch.setattr(tokens, "SMALL_BYTES", -1)  # texts stay where they lie
    assert run(df, "e") == want and run(df, "e") == want
    monkeypatch.setattr(tokens, "BROADCAST_DIGESTS", -1)
    assert run(df, "b") == want and run(df, "b") == want
    monkeypatch.setattr(tokens, "BROADCAST_DIGESTS", 3)
    run(df.where("doc_id < 8"), "c")
    assert run(df, "c") == want
    run(df.where("doc_id = 8"), "d")  # one hit, many misses
    assert run(df, "d") == want


def test_counts_and_cache(spark, tmp_path, monkeypatch):
    df = edge.table(spark)
    tok = tokens.library_tokenizer(tokens.default_vocabulary())
    want = sorted(((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in edge.ROWS), key=repr)
    cache = f"file://{tmp_path}/cache"
    run = lambda d: sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(d, cache=cache).collect()), key=repr)
    stored = lambda: spark.read.parquet(f"{cache}/*").count()
    first = df.where("doc_id <= 4 OR doc_id IS NULL")
    assert run(first) == [w for w in want if w[0] is None or w[0] <= 4]
    few = stored()
    assert few == first.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert run(df) == want
    whole = stored()
    assert whole == df.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert run(df) == want and stored() == whole
    assert tokens.token_counts(df.limit(0)).count() == 0
    spark.read.parquet(f"{cache}/{tokens.tokenizer_version(tokens.default_vocabulary())}").write.mode("append").parquet(f"{cache}/{tokens.tokenizer_version(tokens.default_vocabulary())}")
    assert run(df) == want


def test_sentence_model_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    df = edge.table(spark, [(1, "a plain sentence", "a"), (2, None, "a")])
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, vocabulary=path).collect()}
    assert got == {1: len(m.encode("a plain sentence")), 2: 0}
    assert tokens.tokenizer_version(path) != tokens.tokenizer_version(tokens.default_vocabulary())


# TIFF.
@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"\0", b"ab", b"\xff" * 200, b"xyz"]), max_size=60).map(b"".join))
def test_codings_round_trip(data):
    assert tiff.unpack_packbits(tiff.pack_packbits(data), len(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


def test_lzw_beyond_its_table():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


@pytest.mark.parametrize("coding", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_pages_round_trip(coding, order, tile, dtype):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 9, (37, 50)).astype(dtype), rng.integers(0, 200, (5, 7, 3)).astype(dtype)]
    for predictor in (1, 2):
        got = list(tiff.pages(tiff.write_tiff(images, coding, predictor, 10, tile, order)))
        assert (got[0][:, :, 0] == images[0]).all() and (got[1] == images[1]).all()


def test_planar_and_big_files():
    plane = np.arange(12, dtype=np.uint8).reshape(3, 4)
    body = plane.tobytes() + (plane + 100).tobytes()
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 2, 8 | 8 << 16), (259, 3, 1, 1), (277, 3, 1, 2), (284, 3, 1, 2)]
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + len(body))
    entries = b"".join(struct.pack("<HHQQ", t, k, n, v) for t, k, n, v in tags)
    entries += struct.pack("<HHQII", 273, 4, 2, 16, 28) + struct.pack("<HHQII", 279, 4, 2, 12, 12)
    data = head + body + struct.pack("<Q", 8) + entries + struct.pack("<Q", 0)
    page = next(tiff.pages(data))
    assert (page[:, :, 0] == plane).all() and (page[:, :, 1] == plane + 100).all()


@pytest.mark.parametrize("dtype", [np.float32, np.float64, np.int64, np.uint32])
@pytest.mark.parametrize("order", ["<", ">"])
def test_wide_samples_and_their_predictors(dtype, order):
    rng = np.random.default_rng(2)
    images = [(rng.normal(size=(37, 50)) * 1000).astype(dtype), (rng.normal(size=(9, 8, 3)) * 9).astype(dtype)]
    for predictor in (1, 3) if np.dtype(dtype).kind == "f" else (1, 2):
        for tile in (None, (16, 32)):
            got = list(tiff.pages(tiff.write_tiff(images, tiff.DEFLATE, predictor, 10, tile, order)))
            assert (got[0][:, :, 0] == images[0]).all() and (got[1] == images[1]).all()


def bare_tiff(tags, body):
    """A little-endian file of one directory: (tag, type, count, value) and what follows the header."""
    entries = b"".join(struct.pack("<HHI", t, k, n) + struct.pack("<i" if k == 9 else "<I", v) for t, k, n, v in tags)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def test_one_bit_samples_are_the_default():
    body = bytes([0b10110000, 0b01000000])
    page = next(tiff.pages(bare_tiff([(256, 4, 1, 3), (257, 4, 1, 2), (273, 4, 1, 8), (279, 4, 1, 2)], body)))
    assert page[:, :, 0].tolist() == [[1, 0, 1], [0, 1, 0]]


HOSTILE = [
    [(256, 9, 1, -5), (257, 4, 1, 2), (258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 2)],
    [(256, 4, 1, 9), (257, 4, 1, 9), (258, 3, 1, 8), (259, 3, 1, 8), (322, 4, 1, 2**32 - 1), (323, 4, 1, 2**32 - 1), (324, 4, 1, 8), (325, 4, 1, 2)],
    [(256, 4, 1, 2**31), (257, 4, 1, 2**31), (258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 2)],
    [(256, 4, 1, 30_000), (257, 4, 1, 30_000), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 2)],
    [(256, 4, 1, 2), (257, 4, 1, 2), (258, 3, 1, 8), (273, 4, 1, 2**32 - 9), (279, 4, 1, 4)],
    [(256, 4, 1, 2), (257, 4, 1, 2), (258, 3, 1, 8), (277, 3, 1, 0), (273, 4, 1, 8), (279, 4, 1, 4)],
]


@pytest.mark.parametrize("tags", HOSTILE)
def test_hostile_tags_are_errors(tags):
    with pytest.raises(tiff.TiffError):
        list(tiff.pages(bare_tiff(tags, b"abcd")))


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([(c, t) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for t in (None, (16, 32))]), st.lists(st.tuples(st.integers(0, 160), st.integers(0, 255)), min_size=1, max_size=8))
def test_damaged_files_raise_nothing_else(how, damage):
    data = bytearray(tiff.write_tiff([np.arange(37 * 50, dtype=np.uint8).reshape(37, 50)], how[0], 2, 10, how[1]))
    for back, value in damage:
        data[-1 - back] = value
    try:
        for page in tiff.pages(bytes(data)):
            assert page.nbytes <= tiff.MAX_PAGE
    except (tiff.TiffError, zlib.error):
        pass


def test_page_rows(spark):
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8), np.full((2, 3), 7, np.uint8)], tiff.LZW)
    loop = bytearray(good)
    files = [(1, good), (2, None), (3, b""), (4, b"GIF89a.."), (5, good[: len(good) // 2]), (6, bytes(loop)), (6, good)]
    df = spark.createDataFrame(files, "id long, media binary").withColumn("page", F.lit("clash"))
    rows = sorted(tiff.tiff_pages(df, "id", "media").collect(), key=lambda r: (r["id"], -1 if r["page"] is None else r["page"]))
    assert [(r["id"], r["page"]) for r in rows if r["id"] in (1, 6)] == [(1, 0), (1, 1), (6, 0), (6, 0), (6, 1), (6, 1)]
    assert bytes(next(r for r in rows if r["id"] == 1 and r["page"] == 1)["pixels"]) == b"\7" * 6
    assert all(r["error"] for r in rows if r["id"] in (2, 3, 4)) and any(r["error"] for r in rows if r["id"] == 5)
    assert tiff.tiff_pages(df.limit(0), "id", "media").count() == 0
    bad = spark.createDataFrame([(i, bytearray(bare_tiff(t, b"abcd"))) for i, t in enumerate(HOSTILE)] + [(9, bytearray(good))], "id long, media binary")
    rows = tiff.tiff_pages(bad, "id", "media").collect()
    assert all(r["error"] for r in rows if r["id"] < 9) and not any(r["error"] for r in rows if r["id"] == 9)
    assert all(r["error"] for r in tiff.tiff_pages(bad, "id", "media", max_page=10).collect() if r["page"] == 0)


def test_texts_through_tiff(spark):
    df = edge.table(spark)
    got = sorted(tiff.media_digest(df).collect(), key=repr)
    assert len(got) == len(edge.ROWS)
    want = {}
    for i, t, _ in edge.ROWS:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want.setdefault(i, []).append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    same = [r for r in got if r["doc_id"] in (9, 10)]
    assert same[0]["media_sha256"] == same[1]["media_sha256"] and same[0]["feature"] == same[1]["feature"]
    for coding in (tiff.PACKBITS, tiff.LZW):
        assert b"".join(p.tobytes() for p in tiff.pages(tiff.payload_tiff(edge.LONG.encode()[:100_000], coding)))[:100_000] == edge.LONG.encode()[:100_000]
    assert tiff.media_digest(df.limit(0)).count() == 0


# Toxicity.
def test_grammar_reads_clauses():
    g = toxicity.Grammar()
    total = lambda t: sum(s for _, s in g.clauses(t))
    plain = total("what an idiot")
    assert plain > 0 and total("you are an idiot") > plain
    assert 0 < total("he is not an idiot") < plain
    assert 0 < total("they said he called someone an idiot") < plain * toxicity.TARGET_FACTOR
    assert total("i will kill you") > 0 and total("kill the process") == 0 and total("we never kill you") < total("i will kill you")
    assert total("not today. an idiot") == plain
    assert [c for c, _ in g.clauses("fine, an idiot. ok, trash")] == [1, 3]
    assert total("") == 0 and total("a calm clean sentence, nothing else") == 0


def test_reports_negations_and_threats():
    g = toxicity.Grammar()
    total = lambda t: sum(s for _, s in g.clauses(t))
    said = total("you are an idiot")
    for t in ("he said you are an idiot", "he said, you are an idiot", 'he said: "you are an idiot"'):
        assert total(t) == pytest.approx(said * toxicity.REPORTED_FACTOR)
    assert total("he said hello. you are an idiot") == said and total("no, you are an idiot") == said
    assert total('you are not an "idiot"') < said
    assert total("you will be killed") == total("i will kill you") > 0 and total("the lights will be killed") == 0
    assert total("i will kill or hurt you") == 2 * total("i will kill you") and total("kill it, you know") == 0


def naive_clauses(g, text):
    """The five machines read side by side, each with its own state, without any table."""
    out, clause, score = [], 0, 0.0
    held, waits, seen, ready, target, negation, report = [], 0, 0, 0, 0, 0, False
    for word in toxicity.TOKEN.findall(text.lower()):
        s, weight = g.symbol(word)
        if s in (toxicity.PAUSE, toxicity.STOP):
            if score:
                out.append((clause, score))
            clause, score, held, waits, seen, ready, target, negation = clause + 1, 0.0, [], 0, 0, 0, 0, 0
            report = report and s == toxicity.PAUSE
            continue
        scale = (toxicity.NEGATED_FACTOR if negation else 1.0) * (toxicity.REPORTED_FACTOR if report else 1.0)
        if s == toxicity.INSULT:
            score += weight * scale * (toxicity.TARGET_FACTOR if target else 1.0)
        passive = ready and s in (toxicity.THREAT, toxicity.HARMED)
        if passive:
            score += weight * scale
        if s == toxicity.TARGET:
            score += sum(held) * scale
        auxiliary = s == toxicity.AUXILIARY and (seen or ready)
        waits, seen, ready = max(0, waits - 1), max(0, seen - 1), max(0, ready - 1)
        target, negation = max(0, target - 1), max(0, negation - 1)
        if passive:
            waits = seen = ready = 0
        elif s == toxicity.TARGET:
            waits, seen, ready, held, target = 0, toxicity.REACH, 0, [], toxicity.REACH
        elif s == toxicity.THREAT:
            waits, seen, ready, held = toxicity.REACH, 0, 0, [*held, weight]
        elif auxiliary:
            waits, seen, ready = 0, 0, toxicity.REACH
        if not waits:
            held = []
        if s == toxicity.NEGATION:
            negation = toxicity.REACH
        report = report or s == toxicity.REPORT
    return [*out, (clause, score)] if score else out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["you", "idiot", "kill", "hurt", "be", "killed", "not", "said", "word", "a", ",", ".", ": ", "moron"]), max_size=40).map(" ".join))
def test_the_composed_table_reads_as_the_machines_do(text):
    g = toxicity.Grammar({"word": 2.5})
    got, want = g.clauses(text), naive_clauses(g, text)
    assert [c for c, _ in got] == [c for c, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_composition_is_total():
    machines = toxicity.transducers()
    whole = toxicity.compose(machines)
    assert [m.name for m in machines] == ["insult", "threat", "target", "negation", "report"]
    assert all(0 <= to < len(whole.step) for row in whole.step for to in row) and all(f > 0 for row in whole.factor for f in row)
    assert all(not row[a] for row in whole.emit for a in (toxicity.OTHER, toxicity.NEGATION, toxicity.REPORT, toxicity.AUXILIARY, toxicity.PAUSE, toxicity.STOP))
    assert all(row[toxicity.STOP] == 0 for row in whole.step)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    g = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, g).join(labels, "doc_id").where(toxicity.held_out("doc_id"))
    assert got.where("(score >= 0.5) = (toxic = 1)").count() / got.count() > 0.97
    assert got.where("toxic = 1 AND score >= 0.5").count() / got.where("toxic = 1").count() > 0.9


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn(
        "quality", F.when(toxicity.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.words, a.stems, a.coef) == (b.words, b.stems, b.coef)
    x, y = (sorted(r["score"] for r in quality.score_quality(docs, v).collect()) for v in (labels, flipped))
    assert x == y


def test_toxicity_edge_rows(spark):
    df = edge.table(spark)
    none = edge.labels(spark, [])
    g = toxicity.fit(df, none)
    rows = toxicity.score_toxicity(df, g).collect()
    assert len(rows) == len(edge.ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    some = edge.labels(spark, [(1, 1, 0), (1, 1, 0), (None, 0, 1), (7, None, None), (9, 0, 1), (8, 1, 0)])
    assert len(toxicity.score_toxicity(df, toxicity.fit(df, some)).collect()) == len(edge.ROWS)
    assert toxicity.score_toxicity(df.limit(0), g).count() == 0
    assert toxicity.fit(df.limit(0), some).coef == toxicity.Grammar().coef


# Quality.
def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where(toxicity.held_out("doc_id"))
    assert got.where("(score >= 0.3) = (quality = 1)").count() / got.count() > 0.97


def test_quality_edge_rows(spark):
    df = edge.table(spark)
    rows = quality.score_quality(df, edge.labels(spark, [])).collect()
    assert len(rows) == len(edge.ROWS) and {r["score"] for r in rows} == {0.5}
    some = edge.labels(spark, [(1, 1, 0), (1, 1, 0), (None, 1, 1), (7, None, None), (9, 0, 1), (8, 1, 0)])
    rows = quality.score_quality(df, some).collect()
    assert len(rows) == len(edge.ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(df.limit(0), some).count() == 0


def one_hot(patterns):
    """Indicator columns of the bins of pattern numbers, and a constant."""
    out = np.zeros((len(patterns), sum(quality.BINS) + 1))
    rest, offset = patterns.copy(), sum(quality.BINS)
    for n in reversed(quality.BINS):
        rest, b = np.divmod(rest, n)
        offset -= n
        out[np.arange(len(out)), offset + b] = 1
    out[:, -1] = 1
    return out


def slow_risk_fit(x, positive, prior, steps):
    """The non-negative risk row by row: ``x`` one row a document, ``positive`` which of them are trusted."""
    n, n_p = len(x), positive.sum()
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        z = x @ w
        s = 1 / (1 + np.exp(-z))
        plus = x[positive].T @ (s[positive] - 1) / n_p * prior
        minus = x.T @ s / n - prior * x[positive].T @ s[positive] / n_p
        risk = np.log1p(np.exp(z)).mean() - prior * np.log1p(np.exp(z[positive])).mean()
        grad = (plus + minus if risk >= 0 else -minus) + quality.RIDGE * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - quality.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def slow_pattern(text):
    """A text's bin pattern from plain measurements."""
    n, chars, symbols, dup, repeat, lines, upper, letters, run = slow_measure(text)
    words = WORD.findall(text)
    value = [n, symbols / max(n, 1), repeat / max(n, 1), dup / max(lines, 1), upper / max(letters, 1), run, chars / max(n, 1), sum(c in "!?" for c in text) / max(n, 1), n / max(lines, 1), len(set(words)) / max(n, 1)]
    code = 0
    for (_, _, edges), x in zip(quality.FEATURES, value):
        code = code * (len(edges) + 1) + sum(x > e for e in edges)
    return code


def test_quality_matches_the_risk_computed_row_by_row(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = edge.texts(spark, SF)
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    patterns, positive = np.array([slow_pattern(t or "") for _, t in rows]), np.array([i in trusted for i, _ in rows])
    x, prior = one_hot(patterns), 0.5
    for _ in range(3):
        w = slow_risk_fit(x, positive, prior, quality.STEPS)
        prior = quality.estimate_prior(x @ w, positive.astype(float), np.ones(len(rows)))
    w = slow_risk_fit(x, positive, prior, quality.STEPS)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(quality.sigmoid(x @ w).tolist(), abs=1e-4)


def test_scores_in_the_engine_equal_those_of_the_fit(spark):
    rng = np.random.default_rng(0)
    patterns = rng.integers(0, int(np.prod(quality.BINS)), 50)
    w = rng.normal(size=sum(quality.BINS) + 1)
    model = quality.QualityModel(tuple(w.tolist()), 0.5)
    df = spark.createDataFrame([(int(p),) for p in patterns], "pattern long")
    got = [r["s"] for r in df.select(model.score("pattern").alias("s")).collect()]
    assert got == pytest.approx(quality.sigmoid(one_hot(patterns) @ w).tolist(), abs=1e-9)


def test_prior_and_risk_recover_a_known_mixture():
    rng = np.random.default_rng(0)
    n = 20_000
    y = rng.random(n) < 0.7
    bins = [np.where(y, rng.integers(0, b, n), rng.integers(0, b, n) * 0 + b - 1) for b in quality.BINS]
    code = np.zeros(n, np.int64)
    for b, x in zip(quality.BINS, bins):
        code = code * b + x
    labelled = y & (rng.random(n) < 0.3)
    pats, back = np.unique(code, return_inverse=True)
    model = quality.fit_patterns(pats, np.bincount(back, labelled), np.bincount(back))
    assert model.prior == pytest.approx(0.7, abs=0.05)
    score = quality.sigmoid(one_hot(pats) @ np.array(model.weights))[back]
    assert ((score >= 0.5) == y).mean() > 0.99
