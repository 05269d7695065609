"""The catalogue's results as SQL for a single-node engine.

Written from the definitions: global windows, anti joins and plain sorts stand where the
operators use cells, gaps and prefix sums. Seeded hashes, the permutation of the sampler
and the run length of batches are parts of the definitions and stated again here.
"""

from __future__ import annotations

from rankloom import config as C
from rankloom.catalog import parameters as P
from rankloom.functions import hashing as H
from rankloom.operators.batches import COPY_RUN

USER_COLUMNS = (
    "user_avg_rating, user_rating_count, user_rating_stddev, user_genre_diversity, "
    "user_avg_timestamp, user_positive_ratio"
)
ITEM_COLUMNS = (
    "item_avg_rating, item_rating_count, item_rating_stddev, item_genre_count, "
    "item_recency_score, item_popularity_rank"
)
RAW = 'r."userId", r."movieId", r.rating, r."timestamp", r.order_key, r.line_no'
HISTORY = '"timestamp", "movieId", order_key, line_no'


def hashed(seed: int, *cols: str) -> str:
    """The seeded hash; linear fold, then two quadratic rounds."""
    x = f"{seed % H.PRIME_A}::BIGINT"
    for c in cols:
        x = f"(({x} * {H.FOLD} + ({c})::BIGINT) % {H.PRIME_A})"
    x = f"({x} * ({x} + {H.SHIFT_A}) % {H.PRIME_B})"
    return f"({x} * ({x} + {H.SHIFT_B}) % {H.PRIME_A})"


def r6(*names: str) -> str:
    """Columns rounded like the queries do: six digits, three for mean epoch seconds."""
    return ", ".join(f"round({n}, {3 if n == 'user_avg_timestamp' else 6}) AS {n}" for n in names)


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, needs)


def sql(select: str, *needs: str) -> str:
    """Prefix ``select`` with the common table expressions it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dependency in CTES[name][1]:
            visit(dependency)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        visit(n)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in ordered) + "\n" + select


# --- binding -------------------------------------------------------------------

cte(
    "ratings",
    """SELECT o_custkey::INTEGER AS "userId", l_partkey::INTEGER AS "movieId",
       (ceil(l_quantity / 5) * 0.5)::FLOAT AS rating, epoch(l_shipdate)::BIGINT AS "timestamp",
       l_orderkey AS order_key, l_linenumber AS line_no
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
cte(
    "items",
    """SELECT p_partkey::INTEGER AS "movieId", p_name AS title,
       concat_ws('|', replace(p_name, ' ', '|'), p_type) AS genres FROM part""",
)
cte(
    "kept",
    f"""SELECT {RAW} FROM ratings r
        WHERE "userId" IN (SELECT "userId" FROM ratings GROUP BY 1 HAVING count(*) >= {P.MIN_USER})
        AND "movieId" IN (SELECT "movieId" FROM ratings GROUP BY 1 HAVING count(*) >= {P.MIN_ITEM})""",
    "ratings",
)
cte("early", f'SELECT * FROM ratings WHERE "timestamp" < {P.DRIFT_EPOCH}', "ratings")
cte("late", f'SELECT * FROM ratings WHERE "timestamp" >= {P.DRIFT_EPOCH}', "ratings")
cte(
    "runlog",
    """SELECT user_id::VARCHAR AS run_id, CASE WHEN user_id % 2 = 0 THEN 'mf' ELSE 'ncf' END AS model_type,
       CASE event_type WHEN 'view' THEN 'NDCG@10' WHEN 'click' THEN 'HR@10' WHEN 'signup' THEN 'Coverage@10'
       WHEN 'purchase' THEN 'epoch_val_loss' ELSE 'epoch_loss' END AS metric, value, event_id AS step FROM events""",
)
cte(
    "versions",
    """SELECT event_id AS version, user_id::VARCHAR AS run_id,
       CASE event_type WHEN 'purchase' THEN 'Production' WHEN 'error' THEN 'Archived' ELSE 'None' END AS stage
       FROM events""",
)


# --- features ------------------------------------------------------------------


def user_features_of(source: str) -> str:
    return f"""SELECT a."userId", user_avg_rating, user_rating_count, user_rating_stddev, user_active_days,
        coalesce(d.n, 0)::INTEGER AS user_genre_diversity, user_avg_timestamp, user_positive_ratio
        FROM (SELECT "userId", avg(rating::DOUBLE) AS user_avg_rating,
                count(*)::INTEGER AS user_rating_count,
                coalesce(stddev_samp(rating::DOUBLE), 0) AS user_rating_stddev,
                date_diff('day', to_timestamp(min("timestamp"))::TIMESTAMP::DATE,
                          to_timestamp(max("timestamp"))::TIMESTAMP::DATE)::INTEGER AS user_active_days,
                avg("timestamp") AS user_avg_timestamp,
                sum(CASE WHEN rating >= {C.POSITIVE_RATING} THEN 1 ELSE 0 END) / count(*)::DOUBLE
                  AS user_positive_ratio
              FROM {source} GROUP BY 1) a
        LEFT JOIN (SELECT "userId", count(DISTINCT genre) AS n
              FROM (SELECT "userId", unnest(string_split(genres, '|')) AS genre
                    FROM {source} JOIN items USING ("movieId")) GROUP BY 1) d
        ON a."userId" = d."userId" """


def item_features_of(source: str) -> str:
    return f"""SELECT a."movieId", item_avg_rating, item_rating_count, item_rating_stddev,
        coalesce(len(string_split(genres, '|')), 0)::INTEGER AS item_genre_count,
        exp(-1e-7::DOUBLE * ((SELECT max("timestamp") FROM {source}) - newest)) AS item_recency_score,
        dense_rank() OVER (ORDER BY item_rating_count DESC)::INTEGER AS item_popularity_rank
        FROM (SELECT "movieId", avg(rating::DOUBLE) AS item_avg_rating, count(*)::INTEGER AS item_rating_count,
                coalesce(stddev_samp(rating::DOUBLE), 0) AS item_rating_stddev, max("timestamp") AS newest
              FROM {source} GROUP BY 1) a
        LEFT JOIN items USING ("movieId")"""


def distributions_of(users: str, items: str) -> str:
    parts = [
        f"SELECT '{n}' AS feature, {n}::DOUBLE AS value FROM {t}"
        for t, names in ((users, C.MONITORED_USER_FEATURES), (items, C.MONITORED_ITEM_FEATURES))
        for n in names
    ]
    return " UNION ALL ".join(parts)


for _source, _tag in (("kept", ""), ("early", "_early"), ("late", "_late")):
    cte(f"users{_tag}", user_features_of(_source), _source, "items")
    cte(f"catalogue{_tag}", item_features_of(_source), _source, "items")
    cte(f"dist{_tag}", distributions_of(f"users{_tag}", f"catalogue{_tag}"), f"users{_tag}", f"catalogue{_tag}")

cte(
    "user_map",
    """SELECT "userId", (dense_rank() OVER (ORDER BY "userId") - 1)::INTEGER AS user_idx
       FROM (SELECT DISTINCT "userId" FROM kept)""",
    "kept",
)
cte(
    "item_map",
    """SELECT "movieId", (dense_rank() OVER (ORDER BY "movieId") - 1)::INTEGER AS item_idx
       FROM (SELECT DISTINCT "movieId" FROM kept)""",
    "kept",
)
cte(
    "split",
    f"""SELECT *, CASE WHEN place <= floor(total * 0.8::DOUBLE) THEN 'train'
                       WHEN place <= floor(total * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY "userId" ORDER BY {HISTORY}) AS place,
                     count(*) OVER (PARTITION BY "userId") AS total FROM kept)""",
    "kept",
)
cte("train_kept", "SELECT * FROM split WHERE split = 'train'", "split")
cte("users_train", user_features_of("train_kept"), "train_kept", "items")
cte(
    "interactions",
    """SELECT user_idx, item_idx, "timestamp", split
       FROM split JOIN user_map USING ("userId") JOIN item_map USING ("movieId")""",
    "split",
    "user_map",
    "item_map",
)
cte("bounds", "SELECT count(*) AS n_items FROM item_map", "item_map")


# --- sampling ------------------------------------------------------------------

def shape_sql() -> str:
    """The factor pair of a size from n_items to 24 above it whose smaller factor is largest."""
    return """SELECT a, size // a AS b, size, n_items FROM (
          SELECT n_items, n_items + spare AS size, unnest(range(1, sqrt(n_items + spare)::BIGINT + 2)) AS a
          FROM bounds, range(25) t(spare))
        WHERE size % a = 0 AND a * a <= size ORDER BY a DESC, size LIMIT 1"""


cte("walk_shape", shape_sql(), "bounds")


def walked(source: str, seed: int) -> str:
    """``source`` (user_idx, k, ...) with the place each step k leads to: six rounds, each
    adding a hash of the user and one half to the other half."""
    sql = f"SELECT q.*, w.a, w.b, w.n_items, k // w.b AS l, k % w.b AS r FROM {source} q, walk_shape w"
    for i in range(6):
        half, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        sql = f"SELECT * REPLACE (({half} + {hashed(seed + i, 'user_idx', other)}) % {size} AS {half}) FROM ({sql})"
    return f"SELECT *, l * b + r AS place FROM ({sql})"


def unseen(excluded: str, want: str, seed: int = C.SEED) -> str:
    """``want`` items per user, walking the user's permutation and skipping excluded ones."""
    steps = f"""(SELECT user_idx, unnest(range(np + least({want}, n_items - np) + size - n_items)) AS k,
                        least({want}, n_items - np) AS want
                 FROM (SELECT user_idx, count(*) AS np FROM {excluded} GROUP BY 1), walk_shape)"""
    return f"""SELECT user_idx, item_idx FROM (
          SELECT d.user_idx, d.item_idx, d.want,
                 row_number() OVER (PARTITION BY d.user_idx ORDER BY d.k) AS nth
          FROM (SELECT user_idx, want, k, place::INTEGER AS item_idx FROM ({walked(steps, seed)}) WHERE place < n_items) d
          ANTI JOIN {excluded} e ON e.user_idx = d.user_idx AND e.item_idx = d.item_idx)
        WHERE nth <= want"""


for _name, _where, _ratio in (
    ("all", "true", C.NEGATIVES_TRAIN),
    ("train", "split = 'train'", C.NEGATIVES_TRAIN),
    ("val", "split = 'val'", C.NEGATIVES_VAL),
):
    cte(f"pairs_{_name}", f"SELECT DISTINCT user_idx, item_idx FROM interactions WHERE {_where}", "interactions")
    cte(
        f"labelled_{_name}",
        f"""SELECT user_idx, item_idx, 1.0::FLOAT AS label FROM interactions WHERE {_where}
            UNION ALL SELECT user_idx, item_idx, 0.0::FLOAT FROM ({unseen(f"pairs_{_name}", f"np * {_ratio}")})""",
        "interactions",
        f"pairs_{_name}",
        "walk_shape",
    )
cte(
    "seen",
    "SELECT DISTINCT user_idx, item_idx FROM interactions WHERE split IN ('train', 'val')",
    "interactions",
)
cte(
    "held_out",
    """SELECT user_idx, item_idx FROM (
          SELECT user_idx, item_idx, row_number() OVER (PARTITION BY user_idx ORDER BY "timestamp", item_idx) AS nth
          FROM interactions WHERE split = 'test') WHERE nth = 1""",
    "interactions",
)
cte(
    "eval_excluded",
    """SELECT seen.user_idx, seen.item_idx FROM seen SEMI JOIN held_out USING (user_idx)
       UNION SELECT user_idx, item_idx FROM held_out""",
    "seen",
    "held_out",
)
cte(
    "candidates",
    f"""SELECT user_idx, item_idx, true AS is_positive FROM held_out
        UNION ALL SELECT user_idx, item_idx, false FROM ({unseen("eval_excluded", str(C.EVAL_NEGATIVES))})""",
    "held_out",
    "eval_excluded",
    "walk_shape",
)


# --- scoring -------------------------------------------------------------------


def component(side: str, column: str, d: int, dim: int) -> str:
    m, a, q = P.vector_terms(side, dim)[d]
    return f"((({column} * {m} + {a}) % {q} - {q // 2}) / {P.SCALE}::DOUBLE)"


def mf_logit(user: str = "user_idx", item: str = "item_idx") -> str:
    bias = " + ".join(f"(({c} % 7 - 3) / {P.SCALE}::DOUBLE)" for c in (user, item))
    products = " + ".join(
        f"{component('user', user, d, P.MF_DIM)} * {component('item', item, d, P.MF_DIM)}"
        for d in range(P.MF_DIM)
    )
    return f"({P.MF_INTERCEPT}::DOUBLE + {bias} + {products})"


MF_SCORE = f"1 / (1 + exp(-{mf_logit()}))"


def ncf_sql(pairs: str = "interactions") -> str:
    """Forward pass with one subquery per layer."""
    dim = P.NCF_DIM
    both = 2 * dim
    u = [component("user", "user_idx", d, both) for d in range(both)]
    v = [component("item", "item_idx", d, both) for d in range(both)]
    gmf = [f"{u[d]} * {v[d]} AS g{d}" for d in range(dim)]
    x = [f"{e} AS x{i}" for i, e in enumerate(u[dim:] + v[dim:])]
    source = f"(SELECT user_idx, item_idx, {', '.join(gmf + x)} FROM {pairs})"
    width, prefix = both, "x"
    carried = "user_idx, item_idx, " + ", ".join(f"g{d}" for d in range(dim))
    for depth, w in enumerate(P.dense_weights()):
        units = []
        for j in range(len(w["bias"])):
            affine = " + ".join(f"{prefix}{i} * {float(w['weights'][i, j])!r}::DOUBLE" for i in range(width))
            active = f"greatest({affine} + {float(w['bias'][j])!r}::DOUBLE, 0)"
            units.append(
                f"({active} - {float(w['mean'][j])!r}::DOUBLE)"
                f" / sqrt({float(w['variance'][j])!r}::DOUBLE + {P.NCF_EPSILON!r}::DOUBLE)"
                f" * {float(w['scale'][j])!r}::DOUBLE + {float(w['shift'][j])!r}::DOUBLE AS h{depth}_{j}"
            )
        source = f"(SELECT {carried}, {', '.join(units)} FROM {source})"
        width, prefix = len(w["bias"]), f"h{depth}_"
    fused = [f"g{d}" for d in range(dim)] + [f"{prefix}{j}" for j in range(width)]
    out = " + ".join(f"{n} * {float(w)!r}::DOUBLE" for n, w in zip(fused, P.output_weights(), strict=True))
    return f"SELECT user_idx, item_idx, round(1 / (1 + exp(-({out} + {P.OUTPUT_BIAS}::DOUBLE))), 6) AS score FROM {source}"


cte(
    "scored",
    f"SELECT user_idx, is_positive, {MF_SCORE} AS score FROM candidates",
    "candidates",
)
cte(
    "ranks",
    """SELECT p.user_idx, 1 + count(n.score) AS rank FROM scored p
       LEFT JOIN scored n ON n.user_idx = p.user_idx AND NOT n.is_positive AND n.score > p.score
       WHERE p.is_positive GROUP BY 1""",
    "scored",
)
cte(
    "at_k",
    f"""SELECT k::INTEGER AS k, avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate,
        avg(CASE WHEN rank <= k THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg, count(*) AS n_users
        FROM ranks, (SELECT unnest({list(C.RANK_CUTOFFS)}) AS k) GROUP BY 1""",
    "ranks",
)
cte(
    "chosen_pairs",
    f"""SELECT user_idx, item_idx FROM (SELECT user_idx FROM user_map
          ORDER BY {hashed(C.SEED, "user_idx")}, user_idx LIMIT {C.COVERAGE_USERS}), item_map""",
    "user_map",
    "item_map",
)
cte(
    "top_lists",
    f"""SELECT user_idx, item_idx, score, position FROM (
          SELECT user_idx, item_idx, score,
                 row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx)::INTEGER AS position
          FROM (SELECT user_idx, item_idx, {mf_logit()} - {P.MF_INTERCEPT}::DOUBLE AS score
                FROM (SELECT user_idx FROM user_map ORDER BY {hashed(C.SEED, "user_idx")}, user_idx
                      LIMIT {C.COVERAGE_USERS}), item_map))
        WHERE position <= {C.COVERAGE_K}""",
    "user_map",
    "item_map",
)
cte(
    "covered",
    "SELECT count(DISTINCT item_idx) / (SELECT n_items FROM bounds)::DOUBLE AS coverage FROM top_lists",
    "top_lists",
    "bounds",
)
cte(
    "damaged",
    """SELECT CASE WHEN line_no = 2 THEN 'number of fields' WHEN line_no = 3 THEN 'userId is no int'
             WHEN line_no = 4 THEN 'timestamp is no bigint' END AS reason,
         concat_ws(',', CASE WHEN line_no = 3 THEN 'x' ELSE '' END || "userId", "movieId",
           CASE WHEN line_no <> 2 THEN rating::VARCHAR END,
           CASE WHEN line_no = 4 THEN 'late' WHEN line_no <> 2 THEN "timestamp"::VARCHAR END) AS line
       FROM ratings""",
    "ratings",
)


def pass_ctes() -> None:
    """A pass of training as one table per stratum: all pairs of the stratum scored by the rows
    before it, then adaptive steps of the rows met. Rows are stored as FLOAT between strata."""
    d, b = range(P.PASS_DIM), P.PASS_BLOCKS
    for side, key in (("user", "user_idx"), ("item", "item_idx")):
        xs = ", ".join([f"{component(side, key, k, P.PASS_DIM)} AS x{k}" for k in d] + [f"({key} % 7 - 3) / 8.0::DOUBLE AS x{P.PASS_DIM}"])
        zeros = ", ".join(f"0::DOUBLE AS s{k}" for k in range(P.PASS_DIM + 1))
        cte(f"{side}_rows_0", f"SELECT {key}, {xs}, {zeros} FROM {side}_map", f"{side}_map")
    cte("shared_0", f"SELECT {P.MF_INTERCEPT}::DOUBLE AS x, 0::DOUBLE AS s")
    for n in range(b):
        dot = " + ".join(f"u.x{k} * v.x{k}" for k in d)
        last = P.PASS_DIM
        columns = ", ".join([f"u.x{k} AS u{k}, v.x{k} AS v{k}" for k in d])
        cte(
            f"cell_{n}",
            f"""SELECT user_idx, item_idx, label, {columns},
                  1 / (1 + exp(-((SELECT x FROM shared_{n}) + u.x{last} + v.x{last} + {dot}))) AS p
                FROM labelled_train JOIN user_rows_{n} u USING (user_idx) JOIN item_rows_{n} v USING (item_idx)
                WHERE ((item_idx - user_idx) % {b} + {b}) % {b} = {n}""",
            "labelled_train", f"user_rows_{n}", f"item_rows_{n}", f"shared_{n}",
        )
        for side, key, other in (("user", "user_idx", "v"), ("item", "item_idx", "u")):
            sums = ", ".join([f"sum((p - label) * {other}{k}) AS g{k}" for k in d] + [f"sum(p - label) AS g{last}"])
            total = [f"(g{k} + {P.PASS_L2} * x{k})" for k in range(last + 1)]
            steps = ", ".join(
                f"CASE WHEN g{k} IS NULL THEN x{k} ELSE (x{k} - {P.PASS_STEP} * {t} / sqrt(s{k} + {t} ** 2 + 1e-8))::FLOAT::DOUBLE END AS x{k}, "
                f"CASE WHEN g{k} IS NULL THEN s{k} ELSE (s{k} + {t} ** 2)::FLOAT::DOUBLE END AS s{k}"
                for k, t in enumerate(total)
            )
            cte(
                f"{side}_rows_{n + 1}",
                f"SELECT {key}, {steps} FROM {side}_rows_{n} LEFT JOIN (SELECT {key}, {sums} FROM cell_{n} GROUP BY {key}) USING ({key})",
                f"{side}_rows_{n}", f"cell_{n}",
            )
        cte(
            f"shared_{n + 1}",
            f"""SELECT sum(n * (x - {P.PASS_STEP} * m / sqrt(s + m ** 2 + 1e-8))) / sum(n) AS x, sum(n * (s + m ** 2)) / sum(n) AS s
                FROM (SELECT user_idx % {b} AS slot, count(*) AS n, avg(p - label) AS m FROM cell_{n} GROUP BY ALL), shared_{n}""",
            f"cell_{n}", f"shared_{n}",
        )


pass_ctes()
PASSED = " UNION ALL ".join(f"SELECT label, p FROM cell_{n}" for n in range(P.PASS_BLOCKS))

cte(
    "labelled_scored",
    f"""SELECT label, {MF_SCORE} AS score FROM
        (SELECT * FROM labelled_train UNION ALL SELECT * FROM labelled_val)""",
    "labelled_train",
    "labelled_val",
)


# --- drift ---------------------------------------------------------------------

_PROBABILITIES = [q / C.PSI_BINS for q in range(C.PSI_BINS + 1)]
cte(
    "edges",
    f"""SELECT feature, list_sort(list_distinct(quantile_cont(value, {_PROBABILITIES}))) AS edges
        FROM dist_early GROUP BY 1""",
    "dist_early",
)
cte(
    "bins",
    """SELECT feature, bin, edges[bin] AS low, edges[bin + 1] AS high, len(edges) - 1 AS k
       FROM (SELECT feature, edges, unnest(range(1, len(edges))) AS bin FROM edges)""",
    "edges",
)
for _side in ("early", "late"):
    cte(
        f"share_{_side}",
        f"""SELECT b.feature, b.bin,
              (count(d.value) + 1) / ((SELECT count(*) FROM dist_{_side} t WHERE t.feature = b.feature) + b.k)::DOUBLE
              AS share
            FROM bins b LEFT JOIN dist_{_side} d ON d.feature = b.feature AND d.value >= b.low
              AND (d.value < b.high OR (b.bin = b.k AND d.value = b.high))
            GROUP BY b.feature, b.bin, b.k""",
        "bins",
        f"dist_{_side}",
    )
cte(
    "psi",
    """SELECT e.feature, sum((a.share - e.share) * ln(a.share / e.share)) AS psi
       FROM share_early e JOIN share_late a USING (feature, bin) GROUP BY 1""",
    "share_early",
    "share_late",
)
cte(
    "drift",
    f"""SELECT feature, round(psi, 4) AS psi,
          CASE WHEN psi < {C.PSI_WARN} THEN 'PASS' WHEN psi < {C.PSI_FAIL} THEN 'WARNING' ELSE 'FAIL' END AS status,
          psi < {C.PSI_FAIL} AS passed,
          round(e.m, 4) AS expected_mean, round(a.m, 4) AS actual_mean,
          round(e.s, 4) AS expected_std, round(a.s, 4) AS actual_std, NULL::VARCHAR AS message
        FROM psi
        JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM dist_early GROUP BY 1) e USING (feature)
        JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM dist_late GROUP BY 1) a USING (feature)""",
    "psi",
)


# --- runs ----------------------------------------------------------------------

cte(
    "finals",
    "SELECT run_id, model_type, metric, arg_max(value, step) AS value FROM runlog GROUP BY ALL",
    "runlog",
)
cte(
    "production",
    """SELECT metric, value FROM finals
       WHERE run_id = (SELECT arg_max(run_id, version) FROM versions WHERE stage = 'Production')""",
    "finals",
    "versions",
)
cte(
    "newest",
    "SELECT metric, value FROM finals WHERE run_id = (SELECT arg_max(run_id, version) FROM versions)",
    "finals",
    "versions",
)
cte(
    "gate",
    f"""SELECT run_id, c AS candidate_value, p AS production_value, coalesce(c > p, false) AS promoted,
          CASE WHEN c IS NULL THEN 'metric missing' WHEN c > p THEN 'better than production'
               ELSE 'not better than production' END AS reason
        FROM (SELECT run_id, max(CASE WHEN metric = '{C.PROMOTION_METRIC}' THEN value END) AS c
              FROM finals GROUP BY 1),
             (SELECT coalesce((SELECT value FROM production WHERE metric = '{C.PROMOTION_METRIC}'), 0) AS p)""",
    "finals",
    "production",
)

_USER_SELECT = (
    '"userId", '
    + r6("user_avg_rating", "user_rating_stddev", "user_avg_timestamp", "user_positive_ratio")
    + ", user_rating_count, user_active_days, user_genre_diversity"
)
_ITEM_SELECT = (
    '"movieId", '
    + r6("item_avg_rating", "item_rating_stddev", "item_recency_score")
    + ", item_rating_count, item_genre_count, item_popularity_rank"
)
_CROSS = (
    r6("user_avg_rating", "user_rating_stddev", "user_avg_timestamp", "user_positive_ratio")
    + ", user_rating_count, user_genre_diversity, "
    + r6("item_avg_rating", "item_rating_stddev", "item_recency_score")
    + ", item_rating_count, item_genre_count, item_popularity_rank, "
    "round(r.rating - user_avg_rating, 6) AS rating_deviation, "
    "user_rating_count::BIGINT * item_rating_count AS popularity_alignment"
)
_GENERAL_JOINS = 'LEFT JOIN users USING ("userId") LEFT JOIN catalogue USING ("movieId")'

ORACLES: dict[str, str] = {
    "load_ratings": sql("SELECT * FROM ratings", "ratings"),
    "load_items": sql("SELECT * FROM items", "items"),
    "quality_summary": sql(
        f"""SELECT count(*) AS total_ratings,
              count(*) FILTER (WHERE "userId" IS NULL OR "movieId" IS NULL) AS ratings_null_count,
              count(*) FILTER (WHERE rating NOT BETWEEN {C.RATING_RANGE[0]} AND {C.RATING_RANGE[1]})
                AS ratings_out_of_range,
              min(rating) AS min_rating, max(rating) AS max_rating,
              count(DISTINCT "userId") AS total_users, count(DISTINCT "movieId") AS total_movies FROM ratings""",
        "ratings",
    ),
    "quality_duplicates": sql(
        """SELECT "userId", "movieId", "timestamp", count(*) AS copies FROM ratings
           GROUP BY ALL HAVING count(*) > 1""",
        "ratings",
    ),
    "quality_orphans": sql(
        """SELECT count(DISTINCT "movieId") AS orphan_movie_ids, count(*) AS orphan_ratings FROM ratings
           WHERE "movieId" NOT IN (SELECT "movieId" FROM items)""",
        "ratings",
        "items",
    ),
    "quality_year_range": sql(
        f"""SELECT year(to_timestamp("timestamp")::TIMESTAMP)::INTEGER AS rating_year, count(*) AS n_ratings,
              year(to_timestamp("timestamp")::TIMESTAMP) BETWEEN {C.YEAR_RANGE[0]} AND {C.YEAR_RANGE[1]} AS in_range
            FROM ratings GROUP BY ALL""",
        "ratings",
    ),
    "file_manifest": " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file_name, count(*) AS n_rows FROM {t}"
        for t in ("lineitem", "orders", "part", "events")
    ),
    "cold_start_filter": sql("SELECT * FROM kept", "kept"),
    "user_features": sql(f"SELECT {_USER_SELECT} FROM users", "users"),
    "item_features": sql(f"SELECT {_ITEM_SELECT} FROM catalogue", "catalogue"),
    "interaction_features": sql(
        f"SELECT {RAW}, {_CROSS} FROM kept r {_GENERAL_JOINS}", "kept", "users", "catalogue"
    ),
    "remap_ids": sql(
        f"""SELECT {RAW}, user_idx, item_idx FROM kept r
            JOIN user_map USING ("userId") JOIN item_map USING ("movieId")""",
        "kept",
        "user_map",
        "item_map",
    ),
    "temporal_split": sql(f"SELECT {RAW}, split FROM split r", "split"),
    "split_manifest": sql(
        """SELECT split, count(*) AS n_rows, count(DISTINCT "userId") AS n_users,
           count(DISTINCT "movieId") AS n_items FROM split GROUP BY 1""",
        "split",
    ),
    "feature_distributions": sql("SELECT feature, round(value, 6) AS value FROM dist", "dist"),
    "enriched_interactions": sql(
        f"""SELECT {RAW}, {_CROSS}, user_idx, item_idx, split FROM split r {_GENERAL_JOINS}
            JOIN user_map USING ("userId") JOIN item_map USING ("movieId")""",
        "split",
        "users",
        "catalogue",
        "user_map",
        "item_map",
    ),
    "enriched_interactions_bucketed": sql(
        f"""SELECT {RAW}, {_CROSS}, user_idx, item_idx, split FROM split r {_GENERAL_JOINS}
            JOIN user_map USING ("userId") JOIN item_map USING ("movieId")""",
        "split",
        "users",
        "catalogue",
        "user_map",
        "item_map",
    ),
    "written_interactions": sql(
        f"""SELECT user_idx, item_idx, "timestamp", split, user_avg_rating, item_rating_count FROM (
              SELECT {RAW}, {_CROSS}, user_idx, item_idx, split FROM split r {_GENERAL_JOINS}
              JOIN user_map USING ("userId") JOIN item_map USING ("movieId")) WHERE split = 'test'""",
        "split",
        "users",
        "catalogue",
        "user_map",
        "item_map",
    ),
    "written_baseline": sql("SELECT feature, round(value, 6) AS value FROM dist", "dist"),
    "train_scope_features": sql(
        f"SELECT {_USER_SELECT}, user_idx FROM users_train JOIN user_map USING (\"userId\")",
        "users_train",
        "user_map",
    ),
    "index_bounds": sql(
        """SELECT (SELECT count(*)::INTEGER FROM user_map) AS n_users,
           (SELECT count(*)::INTEGER FROM item_map) AS n_items""",
        "user_map",
        "item_map",
    ),
    "row_sample": sql(
        f"""SELECT *, CASE WHEN {hashed(P.SPLIT_SEED, "order_key", "line_no")} < {int(C.TRAIN_FRACTION * H.PRIME_A)}
              THEN 'train' ELSE 'val' END AS split
            FROM (SELECT * FROM ratings ORDER BY {hashed(C.SEED, "order_key", "line_no")}, order_key, line_no
                  LIMIT {P.SAMPLE_ROWS})""",
        "ratings",
    ),
    "seen_pairs": sql("SELECT * FROM seen", "seen"),
    "negative_samples": sql("SELECT * FROM labelled_all", "labelled_all"),
    "labelled_splits": sql(
        """SELECT *, 'train' AS split FROM labelled_train
           UNION ALL SELECT *, 'val' AS split FROM labelled_val""",
        "labelled_train",
        "labelled_val",
    ),
    "training_batches": sql(
        f"""SELECT user_idx, item_idx, label,
              ((row_number() OVER (ORDER BY key, user_idx, item_idx, label, run) - 1) // {C.BATCH_ROWS})::BIGINT
                AS batch_id
            FROM (SELECT *, {hashed(C.SEED, "user_idx", "item_idx", "label::INTEGER", "run")} AS key
                  FROM (SELECT *, (row_number() OVER (PARTITION BY user_idx, item_idx, label) - 1) // {COPY_RUN} AS run
                        FROM labelled_train))""",
        "labelled_train",
    ),
    "eval_candidates": sql("SELECT * FROM candidates", "candidates"),
    "eval_candidates_capped": sql(
        f"""SELECT * FROM candidates WHERE user_idx IN (
              SELECT user_idx FROM held_out ORDER BY {hashed(C.SEED, "user_idx")}, user_idx LIMIT {P.CAPPED_USERS})""",
        "candidates",
        "held_out",
    ),
    "mf_score": sql(f"SELECT user_idx, item_idx, round({MF_SCORE}, 6) AS score FROM interactions", "interactions"),
    "ncf_score": sql(ncf_sql(), "interactions"),
    "binary_metrics": sql(
        """SELECT n, round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc FROM
           (SELECT count(*) AS n,
              avg(-(label * ln(greatest(least(score, 1 - 1e-7), 1e-7))
                  + (1 - label) * ln(1 - greatest(least(score, 1 - 1e-7), 1e-7)))) AS log_loss,
              avg(CASE WHEN (score > 0.5) = (label > 0.5) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
            FROM labelled_scored),
           (SELECT (sum(CASE WHEN label = 1 THEN mid END) - np * (np + 1) / 2) / (np * nn) AS auc
            FROM (SELECT label, (rank() OVER (ORDER BY score)
                    + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) AS mid FROM labelled_scored),
                 (SELECT sum(label)::DOUBLE AS np, sum(1 - label)::DOUBLE AS nn FROM labelled_scored)
            GROUP BY np, nn)""",
        "labelled_scored",
    ),
    "mf_fit": sql(
        """SELECT (SELECT count(*) FROM user_map) AS n_users, (SELECT count(*) FROM item_map) AS n_items,
             (SELECT count(*) FROM labelled_val) AS n_scored, true AS in_range, true AS beats_constant""",
        "user_map",
        "item_map",
        "labelled_val",
    ),
    "ncf_fit": sql(
        "SELECT (SELECT count(*) FROM labelled_val) AS n_scored, true AS in_range, true AS beats_constant", "labelled_val"
    ),
    "als_fit": sql(
        f"SELECT (SELECT count(*) FROM held_out) AS n_users, {2 * len(C.RANK_CUTOFFS) + 1}::BIGINT AS n_metrics, true AS in_range",
        "held_out",
    ),
    "mf_pass": sql(
        f"""SELECT count(*) AS n,
              round(avg(-(label * ln(greatest(least(p, 1 - 1e-7), 1e-7)) + (1 - label) * ln(1 - greatest(least(p, 1 - 1e-7), 1e-7)))), 5) AS log_loss,
              round(avg(CASE WHEN (p > 0.5) = (label > 0.5) THEN 1.0::DOUBLE ELSE 0 END), 5) AS accuracy,
              (SELECT round(x, 5) FROM shared_{P.PASS_BLOCKS}) AS intercept
            FROM ({PASSED})""",
        *[f"cell_{n}" for n in range(P.PASS_BLOCKS)],
        f"shared_{P.PASS_BLOCKS}",
    ),
    "ncf_joint_fit": sql(
        "SELECT (SELECT count(*) FROM labelled_val) AS n_scored, true AS in_range, true AS beats_constant", "labelled_val"
    ),
    "fit_loop": f"""SELECT unnest(['step', 'train_log_loss', 'train_accuracy', 'val_log_loss', 'val_accuracy', 'val_auc']) AS metric,
        {P.LOOP_EPOCHS}::BIGINT AS n_steps""",
    "csv_ratings": sql('SELECT "userId", "movieId", rating, "timestamp" FROM ratings', "ratings"),
    "csv_items": sql("""SELECT "movieId", '"' || title || '", the one' AS title, genres FROM items""", "items"),
    "csv_inferred": sql(
        """SELECT * FROM (SELECT unnest(['userId', 'movieId', 'rating', 'timestamp']) AS "column",
             unnest(['int', 'int', 'double', 'int']) AS type), (SELECT count(*) AS n_rows FROM ratings)""",
        "ratings",
    ),
    "quarantine_report": sql("SELECT reason, count(*) AS n FROM damaged GROUP BY reason", "damaged"),
    "quarantined_lines": sql("SELECT line, reason FROM damaged WHERE reason IS NOT NULL", "damaged"),
    "written_manifest": sql(
        f"""SELECT count(*) FILTER (WHERE split = 'train') AS train_count, count(*) FILTER (WHERE split = 'val') AS val_count,
              count(*) FILTER (WHERE split = 'test') AS test_count, (SELECT count(*) FROM user_map) AS n_users,
              (SELECT count(*) FROM item_map) AS n_items, (SELECT count(*) FROM ratings) AS n_raw_ratings,
              (SELECT count(*) FROM damaged WHERE reason IS NOT NULL) AS n_quarantined,
              '{C.SPLIT_STRATEGY}' AS split_strategy, 1::BIGINT AS n_files FROM interactions""",
        "interactions",
        "user_map",
        "item_map",
        "ratings",
        "damaged",
    ),
    "saved_model_score": sql(f"SELECT user_idx, item_idx, round({MF_SCORE}, 6) AS score FROM interactions", "interactions"),
    "stored_run_log": sql(
        """SELECT 'counts' AS run_id, metric, 2::BIGINT AS n_steps, 2.0::DOUBLE * count(*) AS last_value,
             count(*)::DOUBLE AS min_value, 2.0::DOUBLE * count(*) AS max_value FROM runlog GROUP BY metric""",
        "runlog",
    ),
    "hit_rate_at_k": sql("SELECT k, round(hit_rate, 6) AS hit_rate FROM at_k WHERE k = 10", "at_k"),
    "ndcg_at_k": sql("SELECT k, round(ndcg, 6) AS ndcg FROM at_k WHERE k = 10", "at_k"),
    "rank_metrics": sql(f"SELECT k, {r6('hit_rate', 'ndcg')}, n_users FROM at_k", "at_k"),
    "top_items": sql("SELECT user_idx, item_idx, round(score, 6) AS score, position FROM top_lists", "top_lists"),
    "ncf_coverage": sql(
        f"""SELECT count(DISTINCT item_idx) / (SELECT n_items FROM bounds)::DOUBLE AS coverage FROM (
              SELECT item_idx, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) AS position
              FROM ({ncf_sql("chosen_pairs")})) WHERE position <= {C.COVERAGE_K}""",
        "chosen_pairs",
        "bounds",
    ),
    "coverage_at_k": sql("SELECT round(coverage, 6) AS coverage FROM covered", "covered"),
    "ranking_report": sql(
        """SELECT 'HR@' || k AS metric, round(hit_rate, 4) AS value FROM at_k
           UNION ALL SELECT 'NDCG@' || k, round(ndcg, 4) FROM at_k
           UNION ALL SELECT 'n_users', max(n_users)::DOUBLE FROM at_k
           UNION ALL SELECT 'Coverage@10', round(coverage, 4) FROM covered""",
        "at_k",
        "covered",
    ),
    "psi": sql("SELECT feature, round(psi, 6) AS psi FROM psi", "psi"),
    "drift_report": sql("SELECT * FROM drift", "drift"),
    "drift_gate": sql(
        """SELECT bool_and(passed) AS all_passed, count(*) FILTER (WHERE passed) AS n_passed,
             count(*) AS n_features,
             CASE WHEN bool_and(passed) THEN 'promote_model' ELSE 'block_and_alert' END AS next_step FROM drift""",
        "drift",
    ),
    "training_curves": sql(
        """SELECT run_id, metric, count(*) AS n_steps, arg_max(value, step) AS last_value,
           min(value) AS min_value, max(value) AS max_value FROM runlog GROUP BY ALL""",
        "runlog",
    ),
    "run_leaderboard": sql(
        """SELECT run_id, model_type, max(CASE WHEN metric = 'NDCG@10' THEN value END) AS "NDCG@10",
           max(CASE WHEN metric = 'HR@10' THEN value END) AS "HR@10" FROM finals GROUP BY ALL""",
        "finals",
    ),
    "latest_version": sql(
        "SELECT version, run_id, stage FROM versions ORDER BY version DESC LIMIT 1", "versions"
    ),
    "production_metrics": sql("SELECT * FROM production", "production"),
    "model_comparison": sql(
        """SELECT metric, b.value AS base_value, c.value AS candidate_value,
             round(c.value - b.value, 6) AS delta,
             round(CASE WHEN b.value > 0 THEN (c.value - b.value) * 100 / b.value
                        WHEN c.value - b.value IS NOT NULL THEN 0 END, 6) AS delta_percent
           FROM production b FULL JOIN newest c USING (metric)""",
        "production",
        "newest",
    ),
    "promotion_gate": sql("SELECT * FROM gate", "gate"),
    "promotion_decision": sql(
        """SELECT run_id, candidate_value, production_value, promoted AND ok AS promoted,
             CASE WHEN ok THEN reason ELSE 'feature drift' END AS reason, ok AS drift_passed
           FROM gate, (SELECT bool_and(passed) AS ok FROM drift)""",
        "gate",
        "drift",
    ),
}
