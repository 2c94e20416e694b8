"""The shared definitions of the oracle SQL, written independently of the DataFrame code."""

from __future__ import annotations

from .workspace import CLUSTERS, K_MAX, RAW_ALPHA, RAW_K, RAW_TAU, STATE_ALPHA, STATE_K, STATE_TAU, STEPS


def lloyd_sql(name: str, points: str, clusters: int, steps: int) -> list[tuple[str, str]]:
    out = [(f"{name}0", f"SELECT row_number() OVER (ORDER BY pos_id) - 1 AS cluster_id, x FROM {points} ORDER BY pos_id LIMIT {clusters}")]
    for i in range(steps):
        out += [
            (f"{name}a{i}", f"SELECT pos_id, x, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM (SELECT p.pos_id, p.x, c.cluster_id, list_distance(p.x, c.x) AS d FROM {points} p, {name}{i} c) GROUP BY pos_id, x"),
            (f"{name}m{i}", f"SELECT cluster_id, list(v ORDER BY i) AS x FROM (SELECT cluster_id, i, avg(v) AS v FROM (SELECT cluster_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {name}a{i}) GROUP BY cluster_id, i) GROUP BY cluster_id"),
            (f"{name}{i + 1}", f"SELECT c.cluster_id, coalesce(m.x, c.x) AS x FROM {name}{i} c LEFT JOIN {name}m{i} m USING (cluster_id)"),
        ]
    return out


def knn_sql(queries: str, points: str, k: int, point_id: str = "pos_id", out: str = "entry_id", extra: str = "") -> str:
    return f"""SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, e) AS rank, e AS {out}, d AS dist{extra}
      FROM (SELECT a.query_id, b.{point_id} AS e, list_distance(a.x, b.x) AS d{', b.y AS token' if extra else ''} FROM {queries} a, {points} b)) WHERE rank <= {k}"""


def softmax_sql(nbr: str, k: int, tau: float) -> str:
    return f"SELECT *, exp(-(dist - dmin) / {tau}) / sum(exp(-(dist - dmin) / {tau})) OVER (PARTITION BY query_id) AS w FROM (SELECT *, min(dist) OVER (PARTITION BY query_id) AS dmin FROM {nbr} WHERE rank <= {k})"


def state_p_sql(weights: str, dist: str = "dist", proto: str = "proto", queries: str = "q") -> str:
    return f"""SELECT a.query_id, sum(a.w * CASE WHEN p.total > 0 THEN coalesce(d.cnt, 0) / p.total ELSE 0 END) AS p
      FROM {weights} a JOIN {queries} q USING (query_id) JOIN {proto} p USING (cluster_id) LEFT JOIN {dist} d ON d.cluster_id = a.cluster_id AND d.token = q.y GROUP BY a.query_id"""


BASE: list[tuple[str, str]] = [
    ("pos", "SELECT vec_id AS pos_id, CAST(embedding AS DOUBLE[]) AS x, label AS y, CASE WHEN vec_id % 20 < 14 THEN 'ds' WHEN vec_id % 20 < 17 THEN 'ct' ELSE 'val' END AS split, vec_id // 10 AS chunk_id FROM embeddings"),
    ("ds", "SELECT * FROM pos WHERE split = 'ds'"),
    ("mu", "SELECT y AS token, list(v ORDER BY i) AS x FROM (SELECT y, i, avg(v) AS v FROM (SELECT y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ds) GROUP BY y, i) GROUP BY y"),
    ("lmd", "SELECT p.pos_id, m.token, list_distance(p.x, m.x) AS d FROM pos p, mu m"),
    ("lm", "SELECT pos_id, token, exp(-(d - dmin) / 0.25) / sum(exp(-(d - dmin) / 0.25)) OVER (PARTITION BY pos_id) AS p FROM (SELECT *, min(d) OVER (PARTITION BY pos_id) AS dmin FROM lmd)"),
    ("plm", "SELECT pos_id, sum(CASE WHEN token = y THEN p ELSE 0 END) AS p_lm, -sum(p * ln(p + 1e-12)) AS entropy FROM lm JOIN pos USING (pos_id) GROUP BY pos_id"),
    ("q", "SELECT pos_id AS query_id, split, chunk_id, x, y, p_lm, entropy FROM pos JOIN plm USING (pos_id) WHERE split <> 'ds'"),
    ("nbr", knn_sql("q", "ds", K_MAX, extra=", token")),
    *lloyd_sql("c", "ds", CLUSTERS, STEPS),
    ("asg", f"SELECT pos_id, y, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, min(d) AS dist FROM (SELECT p.pos_id, p.y, c.cluster_id, list_distance(p.x, c.x) AS d FROM ds p, c{STEPS} c) GROUP BY pos_id, y"),
    ("dist", "SELECT cluster_id, y AS token, CAST(count(*) AS DOUBLE) AS cnt FROM asg GROUP BY cluster_id, y"),
    ("proto", f"SELECT c.cluster_id, c.x, coalesce(t.total, 0) AS total FROM c{STEPS} c LEFT JOIN (SELECT cluster_id, sum(cnt) AS total FROM dist GROUP BY cluster_id) t USING (cluster_id)"),
    ("snbr", knn_sql("q", "proto", CLUSTERS, "cluster_id", "cluster_id")),
    ("uni", "SELECT y AS token, count(*) / sum(count(*)) OVER () AS p FROM ds GROUP BY y"),
    ("rw", softmax_sql("nbr", RAW_K, RAW_TAU)),
    ("sw", softmax_sql("snbr", STATE_K, STATE_TAU)),
    ("pr", "SELECT query_id, sum(CASE WHEN token = y THEN w ELSE 0 END) AS p FROM rw JOIN q USING (query_id) GROUP BY query_id"),
    ("ps", state_p_sql("sw")),
    ("perq", f"""SELECT q.query_id, q.split, q.chunk_id, q.y, q.p_lm, q.entropy, pr.p AS p_raw, ps.p AS p_state, n.dist AS d_raw, s.dist AS d_state, s.cluster_id AS top1,
      -ln(q.p_lm + 1e-12) AS nll_lm, -ln({RAW_ALPHA} * pr.p + (1 - {RAW_ALPHA}) * q.p_lm + 1e-12) AS nll_raw,
      -ln({STATE_ALPHA} * ps.p + (1 - {STATE_ALPHA}) * q.p_lm + 1e-12) AS nll_state, s.dist - n.dist AS delta_d,
      round(-ln({STATE_ALPHA} * ps.p + (1 - {STATE_ALPHA}) * q.p_lm + 1e-12) + ln({RAW_ALPHA} * pr.p + (1 - {RAW_ALPHA}) * q.p_lm + 1e-12), 9) AS delta_l
      FROM q JOIN pr USING (query_id) JOIN ps USING (query_id) JOIN (SELECT * FROM nbr WHERE rank = 1) n USING (query_id) JOIN (SELECT * FROM snbr WHERE rank = 1) s USING (query_id)"""),
    ("val", "SELECT * FROM perq WHERE split = 'val'"),
]


def with_base(body: str, *extra: tuple[str, str]) -> str:
    """A query over the shared definitions and its own."""
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in needed(body, [*BASE, *extra]))
    return f"WITH {ctes}\n{body}"


def needed(body: str, ctes: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The definitions that the body reaches, in order."""
    import re

    words = set(re.findall(r"\w+", body))
    out = []
    for name, sql in reversed(ctes):
        if name in words:
            out.append((name, sql))
            words |= set(re.findall(r"\w+", sql))
    return out[::-1]
