"""SQL text of the rating-domain views, used as CTEs by the DuckDB oracle.

Each entry is ``name -> (sql, dependencies)``.  The Spark side builds the
same tables with DataFrame code in ``recspark.sources.testdata``.
"""

VIEWS = {
    "ratings": ("""ratings AS (
  SELECT userId, movieId, rating, "timestamp" FROM (
    SELECT o.o_custkey AS userId, l.l_partkey AS movieId,
           ceil(l.l_quantity / 5) * 0.5e0 AS rating,
           cast(epoch(o.o_orderdate) AS BIGINT) AS "timestamp",
           row_number() OVER (PARTITION BY o.o_custkey, l.l_partkey
             ORDER BY o.o_orderdate DESC, l.l_orderkey DESC, l.l_linenumber DESC,
                      l.l_suppkey DESC, l.l_quantity DESC, l.l_extendedprice DESC) AS rn
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) t
  WHERE rn = 1)""", []),
    "raw_interactions": ("""raw_interactions AS (
  SELECT o.o_custkey AS userId, l.l_partkey AS movieId,
         ceil(l.l_quantity / 5) * 0.5e0 AS rating,
         cast(epoch(o.o_orderdate) AS BIGINT) AS "timestamp"
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""", []),
    "movies": ("""movies AS (
  SELECT p_partkey AS movieId, p_name AS title,
         concat_ws('|', replace(p_name, ' ', '|'), p_type, p_brand) AS genres
  FROM part)""", []),
    "item_factors": ("""item_factors AS (
  SELECT vec_id AS movieId, (label - 4.5e0) / 10e0 AS bias,
         cast(embedding AS DOUBLE[]) AS features
  FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part))""", []),
    "user_factors": ("""user_factors AS (
  SELECT a.userId, (e.label - 4.5e0) / 20e0 AS bias, cast(e.embedding AS DOUBLE[]) AS features
  FROM (SELECT userId, (userId * 7 + 3) % (SELECT count(*) FROM embeddings) AS vec_id
        FROM ratings GROUP BY userId HAVING count(*) >= 20) a
  JOIN embeddings e ON e.vec_id = a.vec_id)""", ["ratings"]),
    "mu": ("""mu AS (SELECT avg(rating) AS mu FROM ratings)""", ["ratings"]),
    "prediction_log": ("""prediction_log AS (
  SELECT r.movieId % 4 AS model_id, make_timestamp(r."timestamp" * 1000000) AS ts,
         r.userId AS user_id, r.movieId AS movie_id, u.predicted, r.rating AS actual
  FROM ratings r JOIN (SELECT userId, avg(rating) AS predicted FROM ratings GROUP BY userId) u
    ON r.userId = u.userId)""", ["ratings"]),
    "request_log": ("""request_log AS (
  SELECT event_id, ts, user_id, 10::BIGINT AS n,
         CASE WHEN ('0x' || right(md5(cast(user_id AS VARCHAR) || '_default'), 1))::INT % 2 = 0
              THEN 'treatment' ELSE 'control' END AS experiment_group,
         event_type = 'error' AS is_error, value AS latency_ms
  FROM events)""", []),
    "temporal_split": ("""temporal_split AS (
  SELECT userId, movieId, rating, "timestamp",
         CASE WHEN pos < (SELECT cast(floor(cast(floor(count(*) * 0.8e0) AS BIGINT) * 0.9e0) AS BIGINT) FROM ratings) THEN 'train'
              WHEN pos < (SELECT cast(floor(count(*) * 0.8e0) AS BIGINT) FROM ratings) THEN 'val'
              ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", userId, movieId) - 1 AS pos FROM ratings) t)""",
        ["ratings"]),
}


def with_views(body: str, names) -> str:
    """Prefix ``body`` with the CTEs ``names`` need, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][1]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(VIEWS[n][0] for n in ordered) + "\n" + body
