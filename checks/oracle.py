"""Plain SQL statements of the same results, built from named common table expressions."""

import re

ALPHA, K, R, P, TAIL, SEED = 0.05, 5, 10, 50, 100, 42
SLICES = 100
TRUST_K, TRUST_ALPHA, TRUST_BATCH = 10, 0.3, 1000

CTES: dict[str, str] = {}


def chain(p: str, src: str, alpha: float = ALPHA, k: int = K, popular: int = P) -> None:
    """Everything the bootstrap derives from a ratings relation."""
    CTES.update({
        f"{p}_clean": f"""
            SELECT user_id, item_id, rating, ts FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, rating DESC) AS o
              FROM {src}) WHERE o = 1""",
        f"{p}_prof": f"""
            SELECT user_id, item_id, rating,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS timestep
            FROM {p}_clean""",
        f"{p}_stats": f"""
            SELECT user_id, max(timestep) AS t, avg(rating) AS avg_rating,
                   avg(rating) - CASE WHEN count(*) = 1 THEN 0
                     ELSE (sum(rating) - arg_max(rating, timestep)) / (count(*) - 1) END AS e
            FROM {p}_prof GROUP BY user_id""",
        f"{p}_w": f"""
            SELECT a.user_id, item_id, exp(-{alpha} * (t - timestep)) * (rating - avg_rating) AS x,
                   exp(-{alpha} * (t - timestep)) * e AS we
            FROM {p}_prof a JOIN {p}_stats s ON a.user_id = s.user_id""",
        f"{p}_info": f"""
            SELECT item_id, sum(x * we) AS l, count(*) AS n, sum(x * x) AS q FROM {p}_w GROUP BY item_id""",
        f"{p}_sums": f"""
            SELECT a.item_id AS item_i, b.item_id AS item_j, sum(a.x * b.we) AS l_i, sum(b.x * a.we) AS l_j,
                   sum(a.x * b.x) AS p
            FROM {p}_w a JOIN {p}_w b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2""",
        f"{p}_sims": f"""
            SELECT item_i, item_j, {similarity('p', 'a.q', 'b.q')} AS sim
            FROM {p}_sums JOIN {p}_info a ON a.item_id = item_i JOIN {p}_info b ON b.item_id = item_j""",
        f"{p}_dirs": f"""
            SELECT item_i AS item_id, item_j AS neighbor_id, sim FROM {p}_sims
            UNION ALL SELECT item_j, item_i, sim FROM {p}_sims""",
        f"{p}_nb": top_neighbors(f"{p}_dirs", k),
        f"{p}_pop": f"SELECT item_id, n FROM {p}_info ORDER BY n DESC, item_id LIMIT {popular}",
        f"{p}_cand": candidates(f"{p}_prof", f"{p}_pop", f"{p}_nb"),
        f"{p}_scored": scored(f"{p}_cand", f"{p}_prof", f"{p}_nb"),
        f"{p}_recs": top_recs(f"{p}_scored", R),
    })


def similarity(p: str, q_i: str, q_j: str) -> str:
    norm = f"(sqrt({q_i}) * sqrt({q_j}))"
    return f"greatest(-1.0, least(1.0, round(CASE WHEN {norm} <> 0 THEN {p} / {norm} ELSE 0 END, 12)))"


def top_neighbors(src: str, k: int) -> str:
    return f"""
        SELECT * FROM (
          SELECT item_id, neighbor_id, sim,
                 row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, neighbor_id) AS rank
          FROM {src}) WHERE rank <= {k}"""


def candidates(prof: str, pop: str, nb: str) -> str:
    return f"""
        SELECT u.user_id, c.item_id
        FROM (SELECT DISTINCT user_id FROM {prof}) u CROSS JOIN {pop} c
        WHERE c.item_id IN (SELECT item_id FROM {nb})
          AND NOT EXISTS (SELECT 1 FROM {prof} s WHERE s.user_id = u.user_id AND s.item_id = c.item_id)"""


def scored(cand: str, prof: str, nb: str) -> str:
    return f"""
        SELECT c.user_id, c.item_id, any_value(m.mean) AS mean,
               any_value(m.mean) + CASE WHEN coalesce(sum(abs(e.sim)) FILTER (s.user_id IS NOT NULL), 0) > 0
                 THEN sum(e.sim * (s.rating - m.mean)) / sum(abs(e.sim)) FILTER (s.user_id IS NOT NULL)
                 ELSE 0 END AS pred
        FROM {cand} c
        JOIN (SELECT user_id, avg(rating) AS mean FROM {prof} GROUP BY user_id) m ON m.user_id = c.user_id
        LEFT JOIN {nb} e ON e.item_id = c.item_id
        LEFT JOIN {prof} s ON s.user_id = c.user_id AND s.item_id = e.neighbor_id
        GROUP BY c.user_id, c.item_id"""


def top_recs(src: str, r: int) -> str:
    return f"""
        SELECT * FROM (
          SELECT user_id, item_id, pred,
                 row_number() OVER (PARTITION BY user_id ORDER BY round(pred, 9) DESC, item_id) AS rank
          FROM {src}) WHERE rank <= {r}"""


def array_split(src: str, slices: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS arrival, ntile({slices}) OVER (ORDER BY {order}) AS batch FROM {src}"


CTES["r1"] = """
    SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
           CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS DOUBLE) AS rating, epoch_us(ts) AS ts FROM events"""
CTES["r2"] = """
    SELECT o_custkey AS user_id, l_partkey AS item_id,
           CAST(1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS DOUBLE) AS rating,
           CAST(epoch(o_orderdate) AS BIGINT) AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CTES["v1"] = """
    SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS electee_id, user_id AS voter_id,
           CASE event_type WHEN 'error' THEN -1.0 WHEN 'view' THEN 0.0 ELSE 1.0 END::DOUBLE AS vote,
           epoch_us(ts) AS ts FROM events"""
CTES["ordered"] = """
    SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id, rating) AS rn, count(*) OVER () AS total FROM r1"""
CTES["train"] = f"SELECT user_id, item_id, rating, ts FROM ordered WHERE rn <= total - {TAIL}"
CTES["test"] = f"""
    SELECT user_id, item_id, rating, ts, rn - greatest(total - {TAIL}, 0) AS arrival FROM ordered
    WHERE rn > total - {TAIL}"""

chain("f", "r1")
chain("z", "r1", alpha=0.0)
chain("b", "r2")
chain("t", "train")

# The first of many equal slices of the table against the rest: here new users and items exist.
CTES["slices"] = array_split(
    "r1", f"(SELECT greatest(1, count(*) // greatest(1, count(*) // {SLICES})) FROM r1)", "ts, user_id, item_id"
)
CTES["early"] = "SELECT user_id, item_id, rating, ts FROM slices WHERE batch = 1"
CTES["rest_rows"] = "SELECT user_id, item_id, rating, ts, arrival, batch FROM slices WHERE batch > 1"
CTES["new_items"] = "SELECT DISTINCT item_id FROM rest_rows WHERE item_id NOT IN (SELECT item_id FROM early)"
CTES["new_users"] = "SELECT DISTINCT user_id FROM rest_rows WHERE user_id NOT IN (SELECT user_id FROM early)"

# One micro-batch on top of the train state.
FADE = f"exp(-2 * {ALPHA})"
STEP = {
    "positioned": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival) AS position FROM test",
    "fresh": """
        SELECT user_id, item_id, rating, position FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY arrival DESC) AS o FROM positioned)
        WHERE o = 1""",
    "means": """
        SELECT n.user_id, coalesce(n_old, 0) AS n_old, coalesce(n_old, 0) + n_new AS t,
               (coalesce(s_old, 0) + s_new) / (coalesce(n_old, 0) + n_new) AS rubar,
               (coalesce(s_old, 0) + s_new) / (coalesce(n_old, 0) + n_new) - coalesce(s_old / n_old, 0) AS e
        FROM (SELECT user_id, sum(rating) AS s_new, count(*) AS n_new FROM fresh GROUP BY 1) n
        LEFT JOIN (SELECT user_id, sum(rating) AS s_old, count(*) AS n_old FROM t_prof GROUP BY 1) o
          ON o.user_id = n.user_id""",
    "clk": """
        SELECT f.user_id, item_id, rating, n_old + position AS timestep, t, rubar, e
        FROM fresh f JOIN means m ON m.user_id = f.user_id""",
    "listed_fresh": "SELECT DISTINCT item_id FROM clk WHERE item_id IN (SELECT item_id FROM t_nb)",
    "hop1": """
        SELECT item_id AS fresh_id, neighbor_id AS candidate_id FROM t_nb
        WHERE item_id IN (SELECT item_id FROM listed_fresh)""",
    "hop2": """
        SELECT DISTINCT fresh_id, neighbor_id AS candidate_id FROM hop1 JOIN t_nb ON item_id = candidate_id""",
    "draws": f"""
        SELECT item_id, row_number() OVER (ORDER BY md5('{SEED}:1:' || item_id), item_id) AS slot FROM (
          SELECT item_id FROM (SELECT item_id FROM t_info UNION SELECT item_id FROM clk) ORDER BY md5('{SEED}:1:' || item_id), item_id
          LIMIT {K} * (SELECT count(*) FROM listed_fresh))""",
    "rnd": f"""
        SELECT fresh_id, d.item_id AS candidate_id FROM (
          SELECT item_id AS fresh_id, (turn * {K} + step) % (SELECT count(*) FROM draws) + 1 AS slot
          FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS turn FROM listed_fresh)
          CROSS JOIN (SELECT unnest(range(least({K}, (SELECT count(*) FROM draws)))) AS step)) JOIN draws d USING (slot)""",
    "pool": "SELECT * FROM hop1 UNION SELECT * FROM hop2 UNION SELECT * FROM rnd",
    "touched": "SELECT candidate_id AS item_id FROM pool UNION SELECT item_id FROM clk",
    "wanted": """
        SELECT DISTINCT least(fresh_id, candidate_id) AS item_i, greatest(fresh_id, candidate_id) AS item_j
        FROM pool WHERE fresh_id <> candidate_id""",
    "n_info": f"""
        WITH d AS (
          SELECT c.item_id, count(*) AS dn, sum((c.rating - rubar) * (c.rating - rubar)) AS dq,
                 sum((c.rating - rubar) * e * (1 + CASE WHEN p.user_id IS NULL THEN 0
                       ELSE 2 * exp(-{ALPHA} * (t - c.timestep)) END)) AS dl
          FROM clk c LEFT JOIN t_prof p ON p.user_id = c.user_id AND p.item_id = c.item_id GROUP BY c.item_id),
        s AS (
          SELECT x.item_id, coalesce(i.l, 0) AS l, coalesce(i.n, 0) AS n, coalesce(i.q, 0) AS q,
                 coalesce(dl, 0) AS dl, coalesce(dn, 0) AS dn, coalesce(dq, 0) AS dq
          FROM touched x LEFT JOIN t_info i ON i.item_id = x.item_id LEFT JOIN d ON d.item_id = x.item_id)
        SELECT item_id,
               CASE WHEN dq + {FADE} * (q - 2 * l) < 0 THEN l ELSE dl + {FADE} * l END AS l,
               n + dn AS n,
               CASE WHEN dq + {FADE} * (q - 2 * l) < 0 THEN q ELSE dq + {FADE} * (q - 2 * l) END AS q
        FROM s""",
    "met": f"""
        SELECT c.user_id, c.item_id AS a, p.item_id AS b, c.rating - rubar AS da, p.rating - rubar AS db, e,
               exp(-{ALPHA} * (t - p.timestep)) AS factor
        FROM clk c JOIN t_prof p ON p.user_id = c.user_id AND p.item_id <> c.item_id
        UNION ALL
        SELECT c.user_id, c.item_id, o.item_id, c.rating - c.rubar, o.rating - c.rubar, c.e, 1
        FROM clk c JOIN clk o ON o.user_id = c.user_id AND c.item_id < o.item_id""",
    "met_pairs": """
        SELECT least(a, b) AS item_i, greatest(a, b) AS item_j, user_id,
               CASE WHEN a < b THEN da ELSE db END AS x_i, CASE WHEN a < b THEN db ELSE da END AS x_j, e, factor
        FROM met WHERE b IN (SELECT item_id FROM touched)""",
    "n_sums": f"""
        SELECT w.item_i, w.item_j,
               coalesce(dl_i, 0) + {FADE} * coalesce(l_i, 0) AS l_i,
               coalesce(dl_j, 0) + {FADE} * coalesce(l_j, 0) AS l_j,
               coalesce(dp, 0) + {FADE} * (coalesce(p, 0) - coalesce(l_i, 0) - coalesce(l_j, 0)) AS p
        FROM wanted w LEFT JOIN t_sums s ON s.item_i = w.item_i AND s.item_j = w.item_j
        LEFT JOIN (SELECT item_i, item_j, sum(factor * x_i * e) AS dl_i, sum(factor * x_j * e) AS dl_j,
                          sum(factor * x_i * x_j) AS dp FROM met_pairs GROUP BY 1, 2) d
          ON d.item_i = w.item_i AND d.item_j = w.item_j""",
    "n_scored": f"""
        SELECT item_i, item_j, {similarity('p', 'a.q', 'b.q')} AS sim
        FROM n_sums JOIN n_info a ON a.item_id = item_i AND a.q <> 0 JOIN n_info b ON b.item_id = item_j AND b.q <> 0""",
    "listed": "SELECT item_id FROM touched WHERE item_id IN (SELECT item_id FROM t_nb)",
    "explicit": """
        SELECT item_id, neighbor_id, max(old_sim) AS old_sim, max(new_sim) AS new_sim FROM (
          SELECT item_id, neighbor_id, sim AS old_sim, NULL AS new_sim FROM t_nb
          UNION ALL SELECT item_i, item_j, NULL, sim FROM n_scored
          UNION ALL SELECT item_j, item_i, NULL, sim FROM n_scored)
        WHERE item_id IN (SELECT item_id FROM listed) GROUP BY 1, 2""",
    "n_dirs": """
        SELECT l.item_id, t.item_id AS neighbor_id, coalesce(new_sim, old_sim, 0) AS sim
        FROM listed l JOIN touched t ON t.item_id <> l.item_id
        LEFT JOIN explicit e ON e.item_id = l.item_id AND e.neighbor_id = t.item_id
        UNION ALL
        SELECT item_id, neighbor_id, coalesce(new_sim, old_sim) FROM explicit
        WHERE neighbor_id NOT IN (SELECT item_id FROM touched)""",
    "n_nb": top_neighbors("n_dirs", K),
    "n_pop": f"""
        SELECT item_id, n FROM (
          SELECT item_id, n FROM n_info
          UNION ALL SELECT item_id, n FROM t_info WHERE item_id NOT IN (SELECT item_id FROM touched))
        ORDER BY n DESC, item_id LIMIT {P}""",
    "all_nb": """
        SELECT * FROM n_nb UNION ALL SELECT * FROM t_nb WHERE item_id NOT IN (SELECT item_id FROM n_nb)""",
    "n_prof": """
        SELECT user_id, item_id, rating FROM clk
        UNION ALL SELECT user_id, item_id, rating FROM t_prof p
        WHERE user_id IN (SELECT user_id FROM clk)
          AND NOT EXISTS (SELECT 1 FROM clk c WHERE c.user_id = p.user_id AND c.item_id = p.item_id)""",
    "n_cand": candidates("n_prof", "n_pop", "all_nb"),
    "n_score": scored("n_cand", "n_prof", "all_nb"),
    "n_recs": top_recs("n_score", R + TAIL),
    "predictions": f"""
        SELECT o.arrival, o.user_id, o.item_id, o.rating, s.mean, s.pred
        FROM test o JOIN ({scored('(SELECT DISTINCT user_id, item_id FROM test)', 't_prof', 't_nb')}) s
          ON s.user_id = o.user_id AND s.item_id = o.item_id""",
    "t_long_recs": top_recs("t_scored", R + TAIL),
    "served": f"""
        SELECT o.arrival, o.user_id, s.item_id, row_number() OVER (PARTITION BY o.arrival ORDER BY s.rank) AS rank
        FROM test o JOIN t_long_recs s ON s.user_id = o.user_id
        WHERE NOT EXISTS (SELECT 1 FROM test x WHERE x.user_id = o.user_id AND x.item_id = s.item_id
                          AND x.arrival <= o.arrival)""",
}
CTES.update(STEP)


def follow(p: str, base: str, src: str, batch: int, rows: int) -> None:
    """The same for another batch: ``src`` on top of the relations ``base``, which may lack its items.

    An item that is new starts with the most popular others. The relations after the
    batch are ``{p}m_prof``, ``_info``, ``_sums``, ``_nb`` and ``_recs``.
    """
    names = [name for name in STEP if name not in ("predictions", "t_long_recs", "served")]
    new = {name: f"{p}_{name}" for name in names} | {f"t_{x}": f"{base}_{x}" for x in ("prof", "info", "sums", "nb")}
    new["test"] = src
    for name in names:
        text = STEP[name].replace(f"'{SEED}:1:'", f"'{SEED}:{batch}:'").replace(f"rank <= {R + TAIL}", f"rank <= {R + rows}")
        own = dict(new)
        if name in ("listed", "explicit", "all_nb"):
            own["t_nb"] = f"{p}_lists"
        CTES[f"{p}_{name}"] = re.sub(r"\b\w+\b", lambda m, own=own: own.get(m[0], m[0]), text)
    CTES[f"{p}_lists"] = f"""
        SELECT item_id, neighbor_id, sim, rank FROM {base}_nb
        UNION ALL SELECT item_id, neighbor_id, 0, nth FROM (
          SELECT i.item_id, o.item_id AS neighbor_id, row_number() OVER (PARTITION BY i.item_id ORDER BY n DESC, o.item_id) AS nth
          FROM (SELECT DISTINCT item_id FROM {p}_clk WHERE item_id NOT IN (SELECT item_id FROM {base}_info)) i
          JOIN {p}_n_pop o ON o.item_id <> i.item_id) WHERE nth <= {K}"""
    CTES[f"{p}m_prof"] = f"""
        SELECT user_id, item_id, rating, timestep FROM {p}_clk
        UNION ALL SELECT user_id, item_id, rating, timestep FROM {base}_prof b
        WHERE NOT EXISTS (SELECT 1 FROM {p}_clk c WHERE c.user_id = b.user_id AND c.item_id = b.item_id)"""
    CTES[f"{p}m_info"] = f"""
        SELECT item_id, l, n, q FROM {p}_n_info
        UNION ALL SELECT item_id, l, n, q FROM {base}_info WHERE item_id NOT IN (SELECT item_id FROM {p}_touched)"""
    CTES[f"{p}m_sums"] = f"""
        SELECT item_i, item_j, l_i, l_j, p FROM {p}_n_sums
        UNION ALL SELECT item_i, item_j, l_i, l_j, p FROM {base}_sums b
        WHERE NOT EXISTS (SELECT 1 FROM {p}_wanted w WHERE w.item_i = b.item_i AND w.item_j = b.item_j)"""
    CTES[f"{p}m_nb"] = f"""
        SELECT item_id, neighbor_id, sim, rank FROM {p}_n_nb
        UNION ALL SELECT item_id, neighbor_id, sim, rank FROM {base}_nb WHERE item_id NOT IN (SELECT item_id FROM {p}_n_nb)"""
    CTES[f"{p}m_recs"] = f"""
        SELECT user_id, item_id, pred, rank FROM {p}_n_recs
        UNION ALL SELECT user_id, item_id, pred, rank FROM {base}_recs WHERE user_id NOT IN (SELECT user_id FROM {p}_clk)"""


# The last rows as two batches, one after the other.
HALF = TAIL // 2
CTES["test_a"] = f"SELECT * FROM test WHERE arrival <= {HALF}"
CTES["test_b"] = f"SELECT * FROM test WHERE arrival > {HALF}"
for name in ("prof", "info", "sums", "nb"):
    CTES[f"h_{name}"] = f"SELECT * FROM t_{name}"
CTES["h_recs"] = top_recs("t_scored", R + HALF)
follow("a", "h", "test_a", 1, HALF)
follow("b", "am", "test_b", 2, HALF)
# The first slice of the table and the rows after it, with their new users and items.
chain("y", "early")
CTES["test_y"] = f"""
    SELECT user_id, item_id, rating, ts, arrival FROM rest_rows
    QUALIFY row_number() OVER (ORDER BY arrival) <= {TAIL}"""
follow("u", "y", "test_y", 1, TAIL)
# The ratings of all users and items that the last rows do not hold, and then those rows.
CTES["early_n"] = """
    SELECT user_id, item_id, rating, ts FROM train
    WHERE user_id NOT IN (SELECT user_id FROM test) AND item_id NOT IN (SELECT item_id FROM test)"""
chain("k", "early_n")
follow("q", "k", "test", 1, TAIL)
# A state with few popular items.
FEW = 2
chain("w", "train", popular=FEW)
CTES["w_long"] = top_recs("w_scored", R)
CTES["raters_w"] = """
    SELECT DISTINCT user_id FROM train WHERE item_id = (SELECT item_id FROM w_pop ORDER BY n DESC, item_id LIMIT 1)"""
CTES["asked_w"] = "SELECT DISTINCT user_id FROM train WHERE user_id % 5 = 2"
# Trust on the votes but the last ones.
T_FADE = f"-2 * {TRUST_ALPHA}"
CTES.update({
    "v_ordered": """
        SELECT *, row_number() OVER (ORDER BY ts, electee_id, voter_id, vote) AS rn, count(*) OVER () AS total
        FROM v1""",
    "v_train": f"SELECT electee_id, voter_id, vote, ts, rn FROM v_ordered WHERE rn <= total - {TAIL}",
    "v_test": f"""
        SELECT electee_id, voter_id, vote, ts, rn - greatest(total - {TAIL}, 0) AS arrival FROM v_ordered
        WHERE rn > total - {TAIL}""",
    "v_batched": f"""
        SELECT * FROM (SELECT *, rn AS arrival, rn // {TRUST_BATCH} AS batch FROM v_train)
        WHERE batch < (SELECT count(*) FROM v_train) // {TRUST_BATCH}""",
    "deltas": "SELECT batch, voter_id, electee_id, arg_max(vote, arrival) AS vote FROM v_batched GROUP BY 1, 2, 3",
    "applied": "SELECT voter_id, electee_id, arg_max(vote, batch) AS vote FROM deltas GROUP BY 1, 2",
    "present": "SELECT DISTINCT voter_id, batch FROM deltas",
    "t_norms": f"""
        SELECT voter_id, sum(dq * exp({T_FADE} * later)) AS q FROM (
          SELECT voter_id, dq, row_number() OVER (PARTITION BY voter_id ORDER BY batch DESC) - 1 AS later
          FROM (SELECT voter_id, batch, sum(vote * vote) AS dq FROM deltas GROUP BY 1, 2)) GROUP BY 1""",
    "asof_rows": """
        SELECT d.batch, d.electee_id, d.voter_id, o.voter_id AS other_id, d.vote, o.vote AS other_vote
        FROM deltas d
        JOIN (SELECT *, lead(batch) OVER (PARTITION BY voter_id, electee_id ORDER BY batch) AS until FROM deltas) o
          ON o.electee_id = d.electee_id AND o.voter_id <> d.voter_id AND o.batch < d.batch
         AND (o.until IS NULL OR o.until >= d.batch)
        WHERE EXISTS (SELECT 1 FROM present p WHERE p.voter_id = o.voter_id AND p.batch = d.batch)""",
    "pair_dp": """
        SELECT voter_i, voter_j, batch, sum(dp) AS dp FROM (
          SELECT least(voter_id, other_id) AS voter_i, greatest(voter_id, other_id) AS voter_j, batch,
                 vote * other_vote AS dp FROM asof_rows
          UNION ALL
          SELECT a.voter_id, b.voter_id, a.batch, a.vote * b.vote FROM deltas a JOIN deltas b
            ON a.batch = b.batch AND a.electee_id = b.electee_id AND a.voter_id < b.voter_id) GROUP BY 1, 2, 3""",
    "t_products": f"""
        SELECT voter_i, voter_j, sum(coalesce(dp, 0) * exp({T_FADE} * later)) AS p FROM (
          SELECT a.voter_id AS voter_i, b.voter_id AS voter_j, a.batch,
                 row_number() OVER (PARTITION BY a.voter_id, b.voter_id ORDER BY a.batch DESC) - 1 AS later
          FROM present a JOIN present b ON a.batch = b.batch AND a.voter_id < b.voter_id) c
        LEFT JOIN pair_dp USING (voter_i, voter_j, batch) GROUP BY 1, 2""",
    "e_norms": "SELECT voter_id, sum(vote * vote) AS q FROM applied GROUP BY 1",
    "e_products": """
        SELECT a.voter_id AS voter_i, b.voter_id AS voter_j, sum(a.vote * b.vote) AS p FROM applied a
        JOIN applied b ON a.electee_id = b.electee_id AND a.voter_id < b.voter_id GROUP BY 1, 2""",
    "voters": "SELECT DISTINCT voter_id FROM v_train",
})


def trust_lists(products: str, norms: str) -> str:
    return f"""
        SELECT * FROM (
          SELECT a.voter_id, b.voter_id AS neighbor_id, coalesce(s.sim, 0) AS sim,
                 row_number() OVER (PARTITION BY a.voter_id
                                    ORDER BY round(coalesce(s.sim, 0), 9) DESC, b.voter_id) AS rank
          FROM voters a JOIN voters b ON a.voter_id <> b.voter_id
          LEFT JOIN (
            SELECT voter_i, voter_j, p / (sqrt(x.q) * sqrt(y.q)) AS sim FROM {products}
            JOIN {norms} x ON x.voter_id = voter_i AND x.q <> 0 JOIN {norms} y ON y.voter_id = voter_j AND y.q <> 0) s
            ON s.voter_i = least(a.voter_id, b.voter_id) AND s.voter_j = greatest(a.voter_id, b.voter_id))
        WHERE rank <= {TRUST_K - 1}"""


CTES["t_lists"] = trust_lists("t_products", "t_norms")
CTES["e_lists"] = trust_lists("e_products", "e_norms")
CTES["trusted"] = """
    SELECT t.arrival, t.electee_id, t.voter_id, t.vote, positive, negative,
           CASE WHEN positive IS NULL THEN NULL WHEN positive >= negative THEN 1 ELSE -1 END AS predicted
    FROM v_test t LEFT JOIN (
      SELECT t.arrival, count(*) FILTER (a.vote > 0) AS positive, count(*) FILTER (a.vote < 0) AS negative
      FROM v_test t LEFT JOIN t_lists l ON l.voter_id = t.voter_id
      LEFT JOIN applied a ON a.voter_id = l.neighbor_id AND a.electee_id = t.electee_id
      WHERE t.voter_id IN (SELECT voter_id FROM voters) AND t.electee_id IN (SELECT voter_id FROM voters)
      GROUP BY 1) c ON c.arrival = t.arrival"""

_CASTS = {"l": "CAST({0} AS BIGINT) AS {0}", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}"}


def statement(spec: str, body: str) -> str:
    """A full statement: the needed CTEs, the body, and the output columns of ``spec``."""
    wanted = _needed(body)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in wanted)
    columns = ", ".join(_CASTS[kind].format(name) for name, kind in (c.split(":") for c in spec.split()))
    head = f"WITH {ctes}\n" if ctes else ""
    return f"{head}SELECT {columns} FROM ({body}) AS result"


def _needed(body: str) -> list[tuple[str, str]]:
    """CTEs a text mentions, with those they mention first."""
    done: dict[str, str] = {}

    def visit(text: str, inside: frozenset = frozenset()) -> None:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
        for name, sql in CTES.items():
            if name in words and name not in done and name not in inside:
                visit(sql, inside | {name})
                done[name] = sql

    visit(body)
    return list(done.items())
