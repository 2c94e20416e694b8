"""Sources, chunking, the surrogate model, projections and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import nll, raw_bytes, signature
from ..operators.stats import worst_flag
from ..session import scratch_root
from ..schema import draw, lcg_sql
from ..sources import ingest
from .base_sql import with_base
from .catalog import n, query, r
from .workspace import Workspace

LENGTH = 128

_TOK = """tk AS MATERIALIZED (
  SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id, i) - 1 AS g, t FROM (
    SELECT doc_id, split, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (
      SELECT doc_id, split, list_append(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''), '<eos>') AS ts FROM src)))"""
_CHUNK = """ch AS MATERIALIZED (
  SELECT split, g // 128 AS chunk_id, count(*) AS n, arg_max(doc_id, g) AS doc_id, list(t ORDER BY g) AS tokens FROM tk GROUP BY split, g // 128 HAVING count(*) = 128)"""
_LCG = lcg_sql("{0}")


def _lcg2(x: str, salt: int = 0) -> str:
    return _LCG.format(_LCG.format(f"{x} + {salt}") + " + 1")


@query(with_base("SELECT split, count(*) AS n, count(DISTINCT chunk_id) AS chunks, min(pos_id) AS first_id, max(pos_id) AS last_id FROM pos GROUP BY split"))
def split_counts(w: Workspace) -> DataFrame:
    return w.pos.groupBy("split").agg(n(F.count(F.lit(1)), "n"), F.countDistinct("chunk_id").alias("chunks"), F.min("pos_id").alias("first_id"), F.max("pos_id").alias("last_id"))


@query("""SELECT corpus, count(*) AS n, count(DISTINCT text) AS texts FROM (
  SELECT 'benchmark' AS corpus, text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'documents', text FROM documents) GROUP BY corpus""")
def corpora(w: Workspace) -> DataFrame:
    out = None
    for name, reader in sorted(ingest.CORPORA.items()):
        one = reader(w.spark, w.dir).select(F.lit(name).alias("corpus"), "text")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts"))


@query(f"WITH src AS (SELECT doc_id, text, 'all' AS split FROM documents), {_TOK}, {_CHUNK} SELECT chunk_id, doc_id, n AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM ch")
def chunk_documents(w: Workspace) -> DataFrame:
    got = ingest.chunks(w.table("documents"), LENGTH)
    return got.select("chunk_id", "doc_id", n(F.size("tokens"), "n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"""WITH src AS (SELECT doc_id, text, CASE WHEN u < 0.7 THEN 'ds' WHEN u < 0.85 THEN 'ct' ELSE 'val' END AS split
  FROM (SELECT doc_id, text, {_lcg2('doc_id')} / 2147483648.0::DOUBLE AS u FROM documents)), {_TOK}, {_CHUNK}
SELECT split, chunk_id, doc_id, md5(array_to_string(tokens, ' ')) AS digest FROM ch""")
def chunk_by_split(w: Workspace) -> DataFrame:
    got = ingest.chunks_by_split(w.table("documents"), LENGTH)
    return got.select("split", "chunk_id", "doc_id", F.md5(F.array_join("tokens", " ")).alias("digest"))


_TITLED = "CASE WHEN doc_id % 7 = 0 THEN ' = ' || source || ' = ' ELSE text END"


@query(f"""WITH t AS (SELECT doc_id, {_TITLED} AS text FROM documents),
a AS (SELECT doc_id, text, sum(CASE WHEN regexp_matches(text, '^ = [^=].* = \\n?$') THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) AS article FROM t),
src AS (SELECT doc_id, text, CASE WHEN u < 0.7 THEN 'ds' WHEN u < 0.85 THEN 'ct' ELSE 'val' END AS split FROM (SELECT *, {_lcg2('article')} / 2147483648.0::DOUBLE AS u FROM a)),
{_TOK}, {_CHUNK} SELECT split, chunk_id, doc_id, md5(array_to_string(tokens, ' ')) AS digest FROM ch""")
def chunk_by_article(w: Workspace) -> DataFrame:
    docs = w.table("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" = "), "source", F.lit(" = "))).otherwise(F.col("text")).alias("text"))
    got = ingest.chunks_by_split(docs, LENGTH, articles=True)
    return got.select("split", "chunk_id", "doc_id", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"SELECT title, count(*) AS n FROM (SELECT regexp_matches({_TITLED}, '^ = [^=].* = \\n?$') AS title FROM documents) GROUP BY title")
def title_filter(w: Workspace) -> DataFrame:
    docs = w.table("documents").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" = "), "source", F.lit(" = "))).otherwise(F.col("text")).alias("text"))
    return docs.select(ingest.is_title("text").alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH src AS (SELECT doc_id, text, 'all' AS split FROM documents), {_TOK}, {_CHUNK},
e AS (SELECT chunk_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM ch),
p AS (SELECT token, lead(token) OVER (PARTITION BY chunk_id ORDER BY i) AS target FROM e)
SELECT token, target, count(*) AS n FROM p WHERE target IS NOT NULL GROUP BY token, target HAVING count(*) >= 5""")
def next_token_pairs(w: Workspace) -> DataFrame:
    pairs = ingest.next_tokens(ingest.chunks(w.table("documents"), LENGTH))
    return pairs.groupBy("token", "target").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(f"""WITH src AS (SELECT doc_id, text, 'all' AS split FROM documents), {_TOK}, {_CHUNK},
e AS (SELECT chunk_id, unnest(tokens) AS token FROM ch),
u AS (SELECT token, count(*) / sum(count(*)) OVER () AS p FROM e GROUP BY token)
SELECT chunk_id, round(avg(-ln(p + 1e-12)), 6) AS mean_nll FROM e JOIN u USING (token) GROUP BY chunk_id""")
def chunk_nll_mean(w: Workspace) -> DataFrame:
    e = ingest.chunks(w.table("documents"), LENGTH).select("chunk_id", F.explode("tokens").alias("token"))
    u = e.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    total = u.agg(F.sum("c").alias("t"))
    u = u.crossJoin(F.broadcast(total)).select("token", nll(F.col("c") / F.col("t")).alias("loss"))
    return e.join(u, "token").groupBy("chunk_id").agg(F.avg("loss").alias("m")).select("chunk_id", r(F.col("m")).alias("mean_nll"))


@query(with_base("SELECT token, round(p, 6) AS p FROM uni"))
def unigram(w: Workspace) -> DataFrame:
    return w.unigram.select("token", r("p"))


@query(with_base("SELECT pos_id, token, round(p, 6) AS p FROM lm"))
def proto_lm(w: Workspace) -> DataFrame:
    return w.lm.select("pos_id", n("token"), r("p"))


@query(with_base("SELECT query_id, round(p_lm, 6) AS p_lm, round(entropy, 6) AS entropy, round(-ln(p_lm + 1e-12), 6) AS nll_add, round(-ln(greatest(p_lm, 1e-12)), 6) AS nll_clamp FROM q"))
def lm_nll(w: Workspace) -> DataFrame:
    p = F.col("p_lm")
    return w.truth.select("query_id", r("p_lm"), r("entropy"), r(nll(p)).alias("nll_add"), r(nll(p, "clamp")).alias("nll_clamp"))


@query(with_base("SELECT split, count(*) AS n, sum(y) AS sum_y, round(sum(x[1]), 6) AS sum_x FROM pos WHERE split = 'val' GROUP BY split"))
def cache_roundtrip(w: Workspace) -> DataFrame:
    import uuid

    path = f"{scratch(w)}/cache-{uuid.uuid4().hex}"
    ingest.save_cache(w.pos, path)
    return ingest.load_cache(w.spark, path, "val").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"), F.round(F.sum(F.col("x")[0]), 6).alias("sum_x")
    )


def scratch(w: Workspace) -> str:
    return scratch_root(w.spark)


@query(with_base("""SELECT kind, count(*) AS n, count(k) AS with_k, round(sum(value), 4) AS total FROM (
  SELECT 'csv' AS kind, NULL AS k, round(nll_lm, 6) AS value FROM val UNION ALL SELECT 'csv', 20, round(nll_raw, 6) FROM val
  UNION ALL SELECT 'json', NULL, round(nll_lm, 6) FROM val UNION ALL SELECT 'json', 20, round(nll_raw, 6) FROM val) GROUP BY kind"""))
def sinks(w: Workspace) -> DataFrame:
    import uuid

    a = w.val.select("query_id", r(F.col("nll_lm")).alias("value"))
    b = w.val.select("query_id", r(F.col("nll_raw")).alias("value"), F.lit(20).alias("k"))
    out = None
    for kind in ("csv", "json"):
        path = f"{scratch(w)}/rows-{uuid.uuid4().hex}"
        ingest.save_rows([a, b], path, kind)
        reader = w.spark.read.schema("query_id long, value double, k int")
        got = (reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)).select(F.lit(kind).alias("kind"), "k", "value")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.round(F.sum("value"), 4).alias("total"))


@query(with_base("SELECT query_id, sha256(array_to_string(list(entry_id ORDER BY entry_id), ',')) AS digest FROM nbr WHERE rank <= 20 GROUP BY query_id"))
def neighbour_signature(w: Workspace) -> DataFrame:
    return w.nbr.where("rank <= 20").groupBy("query_id").agg(F.collect_list("entry_id").alias("ids")).select("query_id", signature(F.col("ids")).alias("digest"))


@query(with_base("SELECT query_id, chunk_id, round(delta_d, 6) AS delta_d, round(delta_l, 6) AS delta_l, round(nll_lm - nll_raw, 6) AS gain_raw, round(nll_lm - nll_state, 6) AS gain_state FROM val"))
def delta_columns(w: Workspace) -> DataFrame:
    return w.val.select("query_id", "chunk_id", r("delta_d"), r("delta_l"), r(F.col("nll_lm") - F.col("nll_raw")).alias("gain_raw"), r(F.col("nll_lm") - F.col("nll_state")).alias("gain_state"))


@query(with_base("""SELECT g, count(*) AS n, round(avg(delta_l), 6) AS mean_delta_l FROM (
  SELECT delta_l, CASE WHEN delta_d < -tol THEN 'closer' WHEN delta_d > tol THEN 'farther' ELSE 'equal' END AS g FROM val, (SELECT 0.01 * quantile_cont(d_raw, 0.5) AS tol FROM val)) GROUP BY g"""))
def distance_groups(w: Workspace) -> DataFrame:
    tol = w.val.agg((0.01 * F.percentile("d_raw", F.lit(0.5))).alias("tol"))
    g = F.when(F.col("delta_d") < -F.col("tol"), "closer").when(F.col("delta_d") > F.col("tol"), "farther").otherwise("equal")
    return w.val.crossJoin(F.broadcast(tol)).groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg("delta_l").alias("m")).select("g", "n", r(F.col("m")).alias("mean_delta_l"))


_CATS = {
    "preserved": "nll_lm - nll_raw > 0 AND nll_lm - nll_state >= 0.9 * (nll_lm - nll_raw)",
    "worse_than_raw": "nll_state > nll_raw",
    "worse_than_lm": "nll_state > nll_lm",
    "beats_raw": "nll_state < nll_raw",
    "neither": "nll_state >= nll_lm AND nll_raw >= nll_lm",
}


@query(with_base(" UNION ALL ".join(f"SELECT '{k}' AS category, count(*) FILTER ({c}) AS n, round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS share FROM val" for k, c in _CATS.items())))
def gain_categories(w: Workspace) -> DataFrame:
    """Overlapping outcome categories."""
    flags = F.array(*(F.struct(F.lit(k).alias("category"), F.expr(c).cast("int").alias("hit")) for k, c in _CATS.items()))
    rows = w.val.select(F.explode(flags).alias("f")).select("f.category", "f.hit")
    return rows.groupBy("category").agg(n(F.sum("hit"), "n"), F.avg("hit").alias("m")).select("category", "n", r(F.col("m")).alias("share"))


@query(with_base("""SELECT query_id, array_to_string(list(entry_id ORDER BY rank), ',') AS ids, array_to_string(list(printf('%.4f', dist) ORDER BY rank), ',') AS dists
  FROM nbr WHERE rank <= 5 GROUP BY query_id"""))
def top5_records(w: Workspace) -> DataFrame:
    rows = w.nbr.where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_id", "dist"))).alias("t"))
    join = lambda f: F.array_join(F.transform("t", f), ",")
    return rows.select("query_id", join(lambda e: e["entry_id"].cast("string")).alias("ids"), join(lambda e: F.format_string("%.4f", e["dist"])).alias("dists"))


@query(with_base("""SELECT chunk_id, round(max(abs(cached - fresh)), 9) AS worst, max(abs(cached - fresh)) < 0.000001 AS aligned, count(*) AS n
  FROM (SELECT chunk_id, CAST(CAST(p_lm AS FLOAT) AS DOUBLE) AS cached, p_lm AS fresh FROM q) GROUP BY chunk_id"""))
def alignment_audit(w: Workspace) -> DataFrame:
    """What a saved cache holds, in single precision, against values computed anew, position by position; a position missing on either side isn't aligned."""
    import uuid

    path = f"{scratch(w)}/audit-{uuid.uuid4().hex}"
    w.truth.select("query_id", F.col("p_lm").cast("float").alias("cached")).write.parquet(path)
    cached = w.spark.read.schema("query_id long, cached float").parquet(path)
    model = ingest.surrogate_model(w.pos).withColumnRenamed("token", "y")
    fresh = w.pos.where("split <> 'ds'").join(model, ["pos_id", "y"]).select(F.col("pos_id").alias("query_id"), F.col("p").alias("p_lm"))
    rows = cached.join(fresh, "query_id", "full").join(w.truth.select("query_id", "chunk_id"), "query_id")
    gap = F.abs(F.col("cached").cast("double") - F.col("p_lm"))
    got = rows.groupBy("chunk_id").agg(F.max(gap).alias("g"), F.count(F.when(gap.isNull(), 1)).alias("missing"), F.count(F.lit(1)).alias("n"))
    return got.select("chunk_id", r(F.col("g"), 9).alias("worst"), ((F.col("g") < 0.000001) & (F.col("missing") == 0)).alias("aligned"), "n")


@query(with_base("""SELECT rule, count(*) FILTER (worst) AS n FROM (
  SELECT 'round' AS rule, row_number() OVER (ORDER BY delta_l DESC, query_id) <= round_even(count(*) OVER () * 10 / 100.0, 0) AS worst FROM val
  UNION ALL SELECT 'int', row_number() OVER (ORDER BY delta_l DESC, query_id) <= count(*) OVER () * 10 // 100 FROM val) GROUP BY rule"""))
def worst_sizes(w: Workspace) -> DataFrame:
    parts = [worst_flag(w.val.select("query_id", "delta_l"), "delta_l", 10, k).select(F.lit(k).alias("rule"), "worst") for k in ("round", "int")]
    return parts[0].unionByName(parts[1]).groupBy("rule").agg(n(F.sum(F.col("worst").cast("int")), "n"))


@query(with_base("SELECT count(*) AS n, count(*) * (4 * 64 + 8) AS bytes FROM ds"))
def raw_store_bytes(w: Workspace) -> DataFrame:
    return w.ds.agg(F.count(F.lit(1)).alias("n")).select("n", n(raw_bytes(F.col("n"), 64), "bytes"))


@query(with_base(f"SELECT pos_id, CAST({_LCG.format('pos_id')} AS BIGINT) AS u FROM pos"))
def portable_draw(w: Workspace) -> DataFrame:
    return w.pos.select("pos_id", draw(F.col("pos_id")).alias("u"))
