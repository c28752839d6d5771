"""The study queries as SQL, for comparison on the same tables."""

from __future__ import annotations

from aestudy.plans.study_queries import BASE_RATE, PATH_LENGTH, STOP_RATE, WIDE_ALPHAS, WIDE_INTERCEPT, WIDE_TERMS

BASE = """
base AS (
  SELECT c_mktsegment AS "Insurance_Plan", p_type AS "SOA_Post_Lvl_Ind",
         CAST(year(l_shipdate) AS INTEGER) AS "Observation_Year",
         CAST(year(o_orderdate) AS INTEGER) AS "Issue_Year",
         p_size AS "Issue_Age", p_size AS "Attained_Age",
         l_linestatus AS "Sex", o_orderstatus AS "Smoker_Status", o_orderpriority AS "Face_Amount_Band",
         CAST(l_returnflag = 'R' AS DOUBLE) AS "Death_Count", l_quantity AS "ExpDth_VBT2015wMI_Cnt"
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
)"""

STUDY = f"""{BASE},
study AS (
  SELECT *, CASE WHEN "Observation_Year" <= 1999 THEN 'TRAIN' ELSE 'TEST' END AS "DATASET"
  FROM base
  WHERE "Insurance_Plan" = 'BUILDING' AND "SOA_Post_Lvl_Ind" <> 'PROMO' AND "ExpDth_VBT2015wMI_Cnt" > 0
)"""

KEYS_7 = (
    '"Observation_Year", "Issue_Year", "Issue_Age", "Sex", "Smoker_Status", "Attained_Age", "Face_Amount_Band"'
)
KEYS_4 = '"Sex", "Smoker_Status", "Attained_Age", "Face_Amount_Band"'


def cells_cte(name: str, keys: str) -> str:
    return f"""{name} AS (
  SELECT "DATASET", {keys}, sum("Death_Count") AS "Death_Count",
         sum("ExpDth_VBT2015wMI_Cnt") AS "ExpDth_VBT2015wMI_Cnt"
  FROM study GROUP BY "DATASET", {keys}
)"""


def ratios(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {STUDY}, totals AS (
  SELECT {keys} count(*) AS n_rows, sum("Death_Count") AS actual,
         sum({BASE_RATE!r}::DOUBLE * "ExpDth_VBT2015wMI_Cnt") AS predicted
  FROM study {group}
)
SELECT {keys} n_rows, actual, round(predicted, 5) AS predicted,
       round(actual / predicted, 5) AS actual_over_predicted,
       round(predicted / actual, 5) AS predicted_over_actual
FROM totals"""


KNOTS = """
knots AS (
  SELECT 5.0::DOUBLE AS k1, quantile_cont(x, 1.0 / 3) AS k2, quantile_cont(x, 2.0 / 3) AS k3, 45.0::DOUBLE AS k4
  FROM (SELECT DISTINCT CAST("Attained_Age" AS DOUBLE) AS x FROM study WHERE "Attained_Age" BETWEEN 5 AND 45)
)"""

SPLINE = f"""WITH {STUDY}, {KNOTS},
steps AS (SELECT *, k2 - k1 AS h1, k3 - k2 AS h2, k4 - k3 AS h3 FROM knots),
band AS (SELECT *, (h1 + h2) / 3 AS a, h2 / 6 AS b, (h2 + h3) / 3 AS c FROM steps),
curve AS (
  SELECT *,
    [[0.0, 0.0, 0.0, 0.0],
     [c / h1 / det, (c * (-1 / h1 - 1 / h2) - b / h2) / det, (c / h2 - b * (-1 / h2 - 1 / h3)) / det, -b / h3 / det],
     [-b / h1 / det, (-b * (-1 / h1 - 1 / h2) + a / h2) / det, (-b / h2 + a * (-1 / h2 - 1 / h3)) / det, a / h3 / det],
     [0.0, 0.0, 0.0, 0.0]] AS f
  FROM (SELECT *, a * c - b * b AS det FROM band)
),
ages AS (SELECT "Attained_Age", CAST("Attained_Age" AS DOUBLE) AS x, count(*) AS n_rows FROM study GROUP BY 1),
placed AS (
  SELECT *, CASE WHEN x < k2 THEN 1 WHEN x < k3 THEN 2 ELSE 3 END AS j FROM ages, curve
),
local AS (
  SELECT *, [k1, k2, k3][j] AS lo, [k2, k3, k4][j] AS hi, [h1, h2, h3][j] AS h FROM placed
),
parts AS (
  SELECT *, (hi - x) / h AS am, (x - lo) / h AS ap,
    CASE WHEN x < k1 THEN (-3 * h + h) * (x - k1) / 6
         WHEN x > k4 THEN h * (x - k4) / 6
         ELSE ((hi - x) ** 3 / h - h * (hi - x)) / 6 END AS cm,
    CASE WHEN x < k1 THEN -h * (x - k1) / 6
         WHEN x > k4 THEN (3 * h - h) * (x - k4) / 6
         ELSE ((x - lo) ** 3 / h - h * (x - lo)) / 6 END AS cp
  FROM local
)
SELECT "Attained_Age", n_rows, {", ".join(
    f"round(am * (j = {i})::INT + ap * (j + 1 = {i})::INT + cm * f[j][{i}] + cp * f[j + 1][{i}], 9) AS cr_{i}"
    for i in (1, 2, 3, 4)
)}
FROM parts"""

# The fixed tree of the queries: per split its path, children's last conditions and routing.
FIXED_SPLITS = [
    (0, "Attained_Age", 25.5, '"Attained_Age" < 25.5', [], 10.0, 100.0),
    (1, "Smoker_Status_P", 0.5, "\"Smoker_Status\" <> 'P'", [(0, True)], 5.0, 50.0),
    (2, "Sex_O", 0.5, "\"Sex\" <> 'O'", [(0, False)], 4.0, 50.0),
    (5, "Issue_Year", 1998.0, '"Issue_Year" < 1998', [(0, False), (2, True)], 3.0, 25.0),
]


def _deviance(y: str, e: str, s: str) -> str:
    rate = f"greatest(({y}) / ({e}), 1e-15)"
    return f"2 * ({s} - ({y}) * ln({rate}) - (({y}) - ({e}) * {rate}))"


def _side_measures(source: str, side: str) -> str:
    y, e, s = f"{source}.y", f"{source}.e", f"{source}.s"
    return (
        f"{source}.n AS n_{side}, round({y}, 4) AS sum_y_{side}, round({e}, 4) AS sum_exp_{side}, "
        f"round({y} / {e}, 4) AS ae_{side}, round({_deviance(y, e, s)}, 4) AS dev_{side}"
    )


def fixed_tree_stats() -> str:
    tests = {nodeid: test for nodeid, _, _, test, *_ in FIXED_SPLITS}
    labels = {nodeid: (f"{name} < {cut}", f"{name} >= {cut}") for nodeid, name, cut, *_ in FIXED_SPLITS}
    parts = []
    for nodeid, name, cut, test, above, gain, cover in FIXED_SPLITS:
        here = " AND ".join(f"({'' if left else 'NOT '}({tests[n]}))" for n, left in above) or "true"
        path = [labels[n][0 if left else 1] for n, left in above]
        sums = "count(*) AS n, sum(y) AS y, sum(e) AS e, sum(CASE WHEN y > 0 THEN y * ln(y / e) ELSE 0 END) AS s"
        total = "p.y, p.e, p.s"
        children = " + ".join(_deviance(f"{t}.y", f"{t}.e", f"{t}.s") for t in ("l", "r"))
        parts.append(
            f"""SELECT {nodeid} AS nodeid, '{labels[nodeid][0]}' AS split_label,
  '{" AND ".join(path) or "ROOT"}' AS path_pretty,
  '{" AND ".join([*path, labels[nodeid][0]])}' AS left_path_pretty,
  '{" AND ".join([*path, labels[nodeid][1]])}' AS right_path_pretty,
  '{name}' AS feature, {cut}::DOUBLE AS threshold,
  {_side_measures("p", "parent")}, {_side_measures("l", "left")}, {_side_measures("r", "right")},
  round({children}, 4) AS dev_children,
  round({_deviance("p.y", "p.e", "p.s")} - ({children}), 4) AS dev_reduction,
  {gain}::DOUBLE AS xgb_gain, {cover}::DOUBLE AS xgb_cover
FROM (SELECT {sums} FROM tree_rows WHERE {here}) p,
     (SELECT {sums} FROM tree_rows WHERE {here} AND ({test})) l,
     (SELECT {sums} FROM tree_rows WHERE {here} AND NOT ({test})) r"""
        )
    rows = f"""tree_rows AS (
  SELECT *, "Death_Count" AS y, "ExpDth_VBT2015wMI_Cnt" * {BASE_RATE!r}::DOUBLE AS e FROM study
)"""
    return f"WITH {STUDY}, {rows}, stats AS (" + "\nUNION ALL\n".join(parts) + ")\n"


def fixed_tree_report() -> str:
    return (
        fixed_tree_stats()
        + """, nodes AS (
  SELECT [] AS steps, ae_parent AS ae, sum_y_parent AS y FROM stats WHERE path_pretty = 'ROOT'
  UNION ALL SELECT string_split(left_path_pretty, ' AND '), ae_left, sum_y_left FROM stats
  UNION ALL SELECT string_split(right_path_pretty, ' AND '), ae_right, sum_y_right FROM stats
)
SELECT CAST(row_number() OVER (ORDER BY steps) AS INTEGER) AS ord, CAST(len(steps) AS INTEGER) AS depth,
       CASE WHEN len(steps) = 0 THEN 'root' ELSE steps[-1] END AS label, ae, y
FROM nodes"""
    )


# Growing trees in SQL: every level is a chain of common table expressions.


def gain(g: str, h: str) -> str:
    return (
        f"(CASE WHEN abs({g}) <= 0.7 * ({h} + 1) THEN ({g}) * ({g}) / ({h} + 1) "
        f"ELSE 2 * abs({g}) * 0.7 - ({h} + 1) * 0.49 END)"
    )


def leaf(g: str, h: str, eta: float) -> str:
    return f"{eta} * greatest(-0.7, least(0.7, -({g}) / ({h} + 1)))"


def grow_ctes(p: str, rows: str, numbers: list[str], strings: list[str], depth: int) -> list[str]:
    """CTEs ``{p}r0..{p}r{depth}`` (rows with their node), ``{p}b{level}`` (splits) over ``rows``.

    ``rows`` has the features and the columns ``g`` and ``h``.
    """
    ctes = [f"{p}r0 AS MATERIALIZED (SELECT *, 0 AS nodeid, 1 AS n_nodes FROM {rows})"]
    for level in range(depth):
        here = f"(SELECT * FROM {p}r{level} WHERE nodeid IS NOT NULL)"
        entries = [
            f"SELECT nodeid, '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS v, NULL::VARCHAR AS lev, g, h FROM {here}"
            for c in numbers
        ] + [f"SELECT nodeid, '{c}' AS feature, NULL::DOUBLE AS v, \"{c}\" AS lev, g, h FROM {here}" for c in strings]
        ctes.append(
            f"{p}h{level} AS MATERIALIZED (SELECT nodeid, feature, v, lev, sum(g) AS g, sum(h) AS h FROM ("
            + " UNION ALL ".join(entries)
            + ") GROUP BY ALL)"
        )
        ctes.append(
            f"""{p}c{level} AS MATERIALIZED (
  SELECT nodeid, feature, lev,
    CASE WHEN lev IS NULL THEN (v + lead(v) OVER w) / 2 ELSE 0.5 END AS threshold,
    CASE WHEN lev IS NULL THEN sum(g) OVER (w ROWS UNBOUNDED PRECEDING) ELSE sum(g) OVER t - g END AS lg,
    CASE WHEN lev IS NULL THEN sum(h) OVER (w ROWS UNBOUNDED PRECEDING) ELSE sum(h) OVER t - h END AS lh,
    sum(g) OVER t AS tg, sum(h) OVER t AS th
  FROM {p}h{level}
  WINDOW w AS (PARTITION BY nodeid, feature ORDER BY v), t AS (PARTITION BY nodeid, feature)
)"""
        )
        first = " AND ".join(
            f"NOT (feature = '{c}' AND lev = (SELECT min(\"{c}\") FROM {rows}))" for c in strings
        )
        ctes.append(
            f"""{p}g{level} AS MATERIALIZED (
  SELECT *, {gain("lg", "lh")} + {gain("(tg - lg)", "(th - lh)")} - {gain("tg", "th")} AS gain
  FROM {p}c{level}
  WHERE threshold IS NOT NULL AND least(lh, th - lh) >= 1 AND (lev IS NULL OR ({first or "true"}))
)"""
        )
        ctes.append(
            f"""{p}b{level} AS MATERIALIZED (
  SELECT *, (SELECT max(n_nodes) FROM {p}r{level}) + 2 * (row_number() OVER (ORDER BY nodeid) - 1) AS yes
  FROM (
    SELECT *, row_number() OVER (PARTITION BY nodeid ORDER BY gain DESC, feature, lev, threshold) AS place
    FROM {p}g{level} WHERE gain > 1e-6
  ) WHERE place = 1
)"""
        )
        value = " ".join(f"WHEN '{c}' THEN CAST(\"{c}\" AS DOUBLE)" for c in numbers)
        value += " " + " ".join(f"WHEN '{c}' THEN CAST(\"{c}\" = b.lev AS DOUBLE)" for c in strings)
        ctes.append(
            f"""{p}r{level + 1} AS MATERIALIZED (
  SELECT r.* EXCLUDE (nodeid, n_nodes),
    CASE WHEN b.nodeid IS NULL THEN NULL
         WHEN (CASE b.feature {value} END) < b.threshold THEN b.yes ELSE b.yes + 1 END AS nodeid,
    n_nodes + 2 * (SELECT count(*) FROM {p}b{level}) AS n_nodes
  FROM {p}r{level} r LEFT JOIN {p}b{level} b ON r.nodeid = b.nodeid
)"""
        )
    return ctes


SPLIT_NAME = "feature || CASE WHEN lev IS NULL THEN '' ELSE '_' || lev END"


def nodes_cte(p: str, depth: int, eta: float) -> str:
    """All nodes of a grown tree, with the leaf value of those that were not split."""
    made = [f"SELECT 0 AS nodeid, 0 AS depth, (SELECT sum(g) FROM {p}r0) AS g, (SELECT sum(h) FROM {p}r0) AS h"]
    for level in range(depth):
        made.append(f"SELECT yes, {level + 1}, lg, lh FROM {p}b{level}")
        made.append(f"SELECT yes + 1, {level + 1}, tg - lg, th - lh FROM {p}b{level}")
    splits = " UNION ALL ".join(f"SELECT * FROM {p}b{level}" for level in range(depth))
    return f"""{p}nodes AS MATERIALIZED (
  SELECT n.nodeid, n.depth, {SPLIT_NAME} AS feature, s.threshold, s.yes, s.yes + 1 AS no, s.gain, n.h AS cover,
         CASE WHEN s.nodeid IS NULL THEN {leaf("n.g", "n.h", eta)} END AS leaf
  FROM ({" UNION ALL ".join(made)}) n LEFT JOIN ({splits}) s ON n.nodeid = s.nodeid
)"""


RESIDUAL_ROWS = """tree_rows AS (
  SELECT "Issue_Year", "Sex", "Smoker_Status", "Attained_Age", "Face_Amount_Band",
         "Death_Count" AS y, "ExpDth_VBT2015wMI_Cnt" / 64 AS e,
         "ExpDth_VBT2015wMI_Cnt" / 64 - "Death_Count" AS g, "ExpDth_VBT2015wMI_Cnt" / 64 * exp(0.7) AS h
  FROM study WHERE "DATASET" = 'TRAIN'
)"""


def residual_tree_nodes() -> str:
    grown = grow_ctes("", "tree_rows", ["Issue_Year", "Attained_Age"], ["Sex", "Smoker_Status", "Face_Amount_Band"], 3)
    return f"""WITH {STUDY}, {RESIDUAL_ROWS}, {", ".join(grown)}, {nodes_cte("", 3, 0.3)}
SELECT CAST(nodeid AS INTEGER) AS nodeid, CAST(depth AS INTEGER) AS depth, feature, threshold,
       CAST(yes AS INTEGER) AS yes, CAST(no AS INTEGER) AS no, CAST(yes AS INTEGER) AS missing,
       round(gain, 4) AS gain, round(cover, 4) AS cover, round(leaf, 6) AS leaf
FROM nodes"""


def residual_tree_fitted() -> str:
    """The trees of both data sets on the counts that the training rates expect."""
    ctes, parts = [], []
    for dataset, p in (("TRAIN", "a"), ("TEST", "z")):
        ctes.append(f"""{p}rows AS (
  SELECT "Issue_Year", "Sex", "Smoker_Status", "Attained_Age", "Face_Amount_Band", y, e, e - y AS g, e * exp(0.7) AS h
  FROM (
    SELECT "Issue_Year", "Sex", "Smoker_Status", "Attained_Age", "Face_Amount_Band", sum("Death_Count") AS y,
           any_value(rate) * sum("ExpDth_VBT2015wMI_Cnt") AS e
    FROM study JOIN rates ON x = "Sex" AND s = "Smoker_Status" WHERE "DATASET" = '{dataset}' GROUP BY 1, 2, 3, 4, 5
  )
)""")
        ctes += grow_ctes(p, f"{p}rows", ["Issue_Year", "Attained_Age"], ["Sex", "Smoker_Status", "Face_Amount_Band"], 3)
        ctes.append(nodes_cte(p, 3, 0.3))
        parts.append(f"""SELECT '{dataset}' AS "DATASET", CAST(nodeid AS INTEGER) AS nodeid, CAST(depth AS INTEGER) AS depth, feature, threshold,
       round(gain, 2) AS gain, round(leaf, 4) AS leaf FROM {p}nodes""")
    return f"WITH {STUDY}, {SATURATED}, {', '.join(ctes)} " + " UNION ALL ".join(parts)


def residual_tree() -> str:
    grown = grow_ctes("", "tree_rows", ["Issue_Year", "Attained_Age"], ["Sex", "Smoker_Status", "Face_Amount_Band"], 3)
    sums = []
    for level in range(3):
        s = "sum(CASE WHEN y > 0 THEN y * ln(y / e) ELSE 0 END)"
        above = "'ROOT'" if level == 0 else "u.path"
        sums.append(
            f"""p{level} AS MATERIALIZED (
  SELECT b.nodeid, {SPLIT_NAME} AS name, b.threshold, b.yes, b.gain, b.th, {above} AS path,
         CASE WHEN {above} = 'ROOT' THEN '' ELSE {above} || ' AND ' END AS prefix
  FROM b{level} b {"" if level == 0 else f"JOIN u{level} u ON u.nodeid = b.nodeid"}
)"""
        )
        sums.append(
            f"""u{level + 1} AS MATERIALIZED (
  SELECT yes AS nodeid, prefix || name || ' < ' || CAST(threshold AS VARCHAR) AS path FROM p{level}
  UNION ALL SELECT yes + 1, prefix || name || ' >= ' || CAST(threshold AS VARCHAR) FROM p{level}
)"""
        )
        sums.append(
            f"""t{level} AS MATERIALIZED (
  SELECT nodeid, count(*) AS n, sum(y) AS y, sum(e) AS e, {s} AS s FROM r{level} WHERE nodeid IS NOT NULL GROUP BY 1
)"""
        )
    sums.append(
        "t3 AS MATERIALIZED (SELECT nodeid, count(*) AS n, sum(y) AS y, sum(e) AS e, "
        "sum(CASE WHEN y > 0 THEN y * ln(y / e) ELSE 0 END) AS s FROM r3 WHERE nodeid IS NOT NULL GROUP BY 1)"
    )
    children = " + ".join(_deviance(f"{t}.y", f"{t}.e", f"{t}.s") for t in ("l", "r"))
    parts = [
        f"""SELECT CAST(b.nodeid AS INTEGER) AS nodeid, name || ' < ' || CAST(threshold AS VARCHAR) AS split_label,
  path AS path_pretty, lp.path AS left_path_pretty, rp.path AS right_path_pretty, name AS feature, threshold,
  {_side_measures("p", "parent")}, {_side_measures("l", "left")}, {_side_measures("r", "right")},
  round({children}, 4) AS dev_children,
  round({_deviance("p.y", "p.e", "p.s")} - ({children}), 4) AS dev_reduction,
  round(gain, 4) AS xgb_gain, round(th, 4) AS xgb_cover
FROM (SELECT nodeid, name, threshold, yes, gain, th, path FROM p{level}) b
JOIN t{level} p ON p.nodeid = b.nodeid
JOIN t{level + 1} l ON l.nodeid = b.yes JOIN t{level + 1} r ON r.nodeid = b.yes + 1
JOIN (SELECT nodeid, path FROM u{level + 1}) lp ON lp.nodeid = b.yes
JOIN (SELECT nodeid, path FROM u{level + 1}) rp ON rp.nodeid = b.yes + 1"""
        for level in range(3)
    ]
    parts = [x.replace("  path AS path_pretty", "  b.path AS path_pretty") for x in parts]
    return f"WITH {STUDY}, {RESIDUAL_ROWS}, {', '.join(grown + sums)}\n" + "\nUNION ALL\n".join(parts)


ENCODED = f"""{cells_cte("cells", KEYS_4)},
encoded AS MATERIALIZED (
  SELECT "DATASET", {KEYS_4.replace('"Face_Amount_Band"', '"Face_Amount_Band" AS band')}, 
         CAST("Sex" = 'F' AS DOUBLE) AS "Sex_F",
         CAST("Smoker_Status" = 'O' AS DOUBLE) AS "Smoker_Status_O",
         CAST("Smoker_Status" = 'P' AS DOUBLE) AS "Smoker_Status_P",
         CAST(CASE "Face_Amount_Band" WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
              WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE -1 END AS DOUBLE) AS "Face_Amount_Band",
         "Death_Count" AS y, "ExpDth_VBT2015wMI_Cnt" / 64 AS e
  FROM cells
)"""
ENCODED_FEATURES = ["Sex_F", "Smoker_Status_O", "Smoker_Status_P", "Face_Amount_Band", "Attained_Age"]


def boost_ctes(rounds: int, eta: float = 0.3, depth: int = 3) -> list[str]:
    """Encoded cells with the margin after every round, ``m0`` to ``m{rounds}``."""
    ctes = [ENCODED, "m0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS f FROM encoded)"]
    for k in range(rounds):
        p = f"t{k}"
        ctes.append(
            f"{p}x AS MATERIALIZED (SELECT *, e * exp(f) - y AS g, e * exp(f) * exp(0.7) AS h "
            f"FROM m{k} WHERE \"DATASET\" = 'TRAIN')"
        )
        ctes += grow_ctes(p, f"{p}x", ENCODED_FEATURES, [], depth)
        ctes.append(nodes_cte(p, depth, eta))
        ctes.append(f"{p}w0 AS MATERIALIZED (SELECT *, 0 AS place FROM m{k})")
        value = " ".join(f"WHEN '{c}' THEN CAST(w.\"{c}\" AS DOUBLE)" for c in ENCODED_FEATURES)
        for level in range(depth):
            ctes.append(
                f"""{p}w{level + 1} AS MATERIALIZED (
  SELECT w.* EXCLUDE (place), CASE WHEN n.feature IS NULL THEN w.place
    WHEN (CASE n.feature {value} END) < n.threshold THEN n.yes ELSE n.no END AS place
  FROM {p}w{level} w JOIN {p}nodes n ON n.nodeid = w.place
)"""
            )
        ctes.append(
            f"m{k + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (place, f), w.f + n.leaf AS f "
            f"FROM {p}w{depth} w JOIN {p}nodes n ON n.nodeid = w.place)"
        )
    return ctes


def boost_fit(rounds: int) -> str:
    losses = " UNION ALL ".join(
        f"SELECT {k} AS round, sum(e * exp(f) - y * f) / count(*) AS loss FROM m{k + 1} WHERE \"DATASET\" = 'TEST'"
        for k in range(rounds)
    )
    return f"""WITH {STUDY}, {", ".join(boost_ctes(rounds))}, losses AS ({losses})
SELECT CAST(round AS INTEGER) AS round, round(loss, 6) AS loss,
       round = (SELECT arg_min(round, loss) FROM losses) AS is_best
FROM losses"""


def boost_to_stop() -> str:
    """One indicator, depth 1: a round is a step of six numbers, so a recursion runs to the stop."""
    sums = ", ".join(
        f"""sum({c}) FILTER ("DATASET" = '{part}' AND "Sex" {test} 'F') AS {name}{group}"""
        for part, suffix in (("TRAIN", ""), ("TEST", "v"))
        for group, test in ((0, "<>"), (1, "="))
        for c, name in (('"Death_Count"', f"y{suffix}"), ('"ExpDth_VBT2015wMI_Cnt" / 64', f"e{suffix}"))
    )
    drop = f"{gain('g0', 'h0')} + {gain('g1', 'h1')} - {gain('(g0 + g1)', '(h0 + h1)')}"
    whole = leaf("(g0 + g1)", "(h0 + h1)", STOP_RATE)
    return f"""WITH RECURSIVE {STUDY}, {cells_cte("cells", KEYS_4)},
t AS (SELECT {sums}, count(*) FILTER ("DATASET" = 'TEST') AS nv FROM cells),
r(k, m0, m1, loss, best, best_k) AS (
  SELECT -1, 0::DOUBLE, 0::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE, 0
  UNION ALL
  SELECT k + 1, m0, m1, l, least(l, best), CASE WHEN l < best THEN k + 1 ELSE best_k END
  FROM (
    SELECT k, m0, m1, best, best_k, (ev0 * exp(m0) - yv0 * m0 + ev1 * exp(m1) - yv1 * m1) / nv AS l
    FROM (
      SELECT k, best, best_k,
             m0 + CASE WHEN split THEN {leaf("g0", "h0", STOP_RATE)} ELSE {whole} END AS m0,
             m1 + CASE WHEN split THEN {leaf("g1", "h1", STOP_RATE)} ELSE {whole} END AS m1
      FROM (
        SELECT *, least(h0, h1) >= 1 AND {drop} >= 1 AS split
        FROM (
          SELECT r.*, e0 * exp(m0) - y0 AS g0, e1 * exp(m1) - y1 AS g1,
                 e0 * exp(m0 + 0.7::DOUBLE) AS h0, e1 * exp(m1 + 0.7::DOUBLE) AS h1
          FROM r, t WHERE k < 999 AND k - best_k < 10
        )
      )
    ), t
  )
)
SELECT CAST(k AS INTEGER) AS round, round(loss, 6) AS loss, k = (SELECT arg_min(k, loss) FROM r) AS is_best
FROM r WHERE k >= 0"""


def boost_predict(rounds: int) -> str:
    return f"""WITH {STUDY}, {", ".join(boost_ctes(rounds))}
SELECT "DATASET", "Sex", "Smoker_Status", "Attained_Age", band AS "Face_Amount_Band", round(exp(f), 6) AS prediction
FROM m{rounds}"""


def boost_one_round() -> str:
    return f"""WITH {STUDY}, {", ".join(boost_ctes(1))}
SELECT CAST(nodeid AS INTEGER) AS nodeid, CAST(depth AS INTEGER) AS depth, feature, threshold,
       CAST(yes AS INTEGER) AS yes, CAST(no AS INTEGER) AS no,
       round(gain, 4) AS gain, round(cover, 4) AS cover, round(leaf, 6) AS leaf
FROM t0nodes"""


def candidates(features: list[str], strings: list[str]) -> str:
    keys = ", ".join(f'"{c}"' for c in features + strings)
    rate = f"{BASE_RATE!r}::DOUBLE"
    rows = f"""tree_rows AS (
  SELECT {keys}, sum("ExpDth_VBT2015wMI_Cnt") * {rate} - sum("Death_Count") AS g,
         sum("ExpDth_VBT2015wMI_Cnt") * {rate} * exp(0.7) AS h
  FROM study WHERE "DATASET" = 'TRAIN' GROUP BY {keys}
)"""
    return f"WITH {STUDY}, {rows}, {', '.join(grow_ctes('', 'tree_rows', features, strings, 1))}\n"


LEVEL_TERMS = f"""WITH {STUDY},
long AS (
  SELECT 'Sex' AS model_term, "Sex" AS level, "Death_Count" AS y, "ExpDth_VBT2015wMI_Cnt" AS e FROM study
  UNION ALL SELECT 'Smoker_Status', "Smoker_Status", "Death_Count", "ExpDth_VBT2015wMI_Cnt" FROM study
  UNION ALL SELECT 'Face_Amount_Band', "Face_Amount_Band", "Death_Count", "ExpDth_VBT2015wMI_Cnt" FROM study
),
terms AS (
  SELECT model_term || '[T.' || level || ']' AS term, round(ln(sum(y) / sum(e)), 6) AS term_value, model_term
  FROM long GROUP BY model_term, level
)"""

BAND_FACTORS = """band_factors AS (
  SELECT "Smoker_Status" AS s, "Face_Amount_Band" AS b,
         round(sum("Death_Count") / sum("ExpDth_VBT2015wMI_Cnt"), 6) AS factor
  FROM study WHERE "DATASET" = 'TRAIN' AND NOT ("Smoker_Status" = 'P' AND "Face_Amount_Band" = '5-LOW')
  GROUP BY 1, 2
)"""

SATURATED = """rates AS (
  SELECT "Sex" AS x, "Smoker_Status" AS s, sum("Death_Count") / sum("ExpDth_VBT2015wMI_Cnt") AS rate
  FROM study WHERE "DATASET" = 'TRAIN' GROUP BY 1, 2
)"""

MULTIPLIER = (
    f"{BASE_RATE!r}::DOUBLE * CASE WHEN \"Sex\" = 'F' THEN 1.25 ELSE 1 END "
    "* CASE \"Smoker_Status\" WHEN 'O' THEN 0.8 WHEN 'P' THEN 1.5 ELSE 1 END * exp(0.01 * \"Attained_Age\")"
)

SCORED = f"""WITH {STUDY}
SELECT "Observation_Year", "Issue_Year", "Sex", "Smoker_Status", "Attained_Age", "Face_Amount_Band",
       "ExpDth_VBT2015wMI_Cnt", round({MULTIPLIER}, 6) AS prediction
FROM study"""


def oracle_sql() -> dict[str, str]:
    levels = """levels AS (
  SELECT count(DISTINCT "Smoker_Status") AS s, count(DISTINCT "Sex") AS x, count(DISTINCT "Face_Amount_Band") AS b
  FROM study
)"""
    return {
        "study_filter": f"WITH {STUDY} SELECT * FROM study",
        "dataset_subset": f"""WITH {STUDY}
SELECT {KEYS_7}, "DATASET", "Death_Count" FROM study WHERE "DATASET" = 'TEST'""",
        "clean_strings": """
SELECT 'PART' AS origin, p_partkey AS id, upper(trim(p_name)) AS name, upper(trim(p_type)) AS kind FROM part
UNION ALL SELECT 'CUSTOMER', c_custkey, upper(trim(c_name)), upper(trim(c_mktsegment)) FROM customer""",
        "collapse_levels": """
SELECT p_partkey, CASE p_type WHEN 'MEDIUM' THEN NULL WHEN 'SMALL' THEN 'TINY' ELSE 'OTHER' END AS p_type FROM part""",
        "year_bands": """
WITH years AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS "Issue_Year" FROM orders)
SELECT o_orderkey, "Issue_Year",
       CASE WHEN "Issue_Year" <= 1996 THEN 'until 1996' WHEN "Issue_Year" <= 1998 THEN '1997 to 1998'
            WHEN "Issue_Year" = 2000 THEN '2000' ELSE 'Unknown' END AS "Year_Band",
       CASE WHEN "Issue_Year" <= 1980 THEN '≤1980' WHEN "Issue_Year" <= 1996 THEN '1981-1996'
            WHEN "Issue_Year" BETWEEN 1997 AND 2003 THEN '1997-2003'
            WHEN "Issue_Year" BETWEEN 2004 AND 2008 THEN '2004-2008'
            WHEN "Issue_Year" >= 2009 THEN '2009+' ELSE 'Unknown' END AS "Issue_Year_Group"
FROM years""",
        "schema_split": f"WITH {BASE} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{role}' AS role, count(\"{c}\") AS n_present FROM base"
            for c, role in [
                ("Insurance_Plan", "string"),
                ("SOA_Post_Lvl_Ind", "string"),
                ("Observation_Year", "number"),
                ("Issue_Year", "number"),
                ("Issue_Age", "number"),
                ("Attained_Age", "number"),
                ("Sex", "string"),
                ("Smoker_Status", "string"),
                ("Face_Amount_Band", "string"),
                ("Death_Count", "response"),
                ("ExpDth_VBT2015wMI_Cnt", "response"),
            ]
        ),
        "null_report": """
SELECT count(*) FILTER (WHERE p_type IS NULL OR p_type = 'PROMO') AS p_type,
       count(*) FILTER (WHERE p_size IS NULL) AS p_size FROM part""",
        "drop_rename": f"""WITH {STUDY}, {cells_cte("cells", KEYS_4)}
SELECT "DATASET", 'all' AS term_group, {KEYS_4}, "Death_Count",
       round("ExpDth_VBT2015wMI_Cnt" * {BASE_RATE!r}::DOUBLE, 6) AS model_pred_factor
FROM cells""",
        "cast_to_training": 'SELECT p_partkey, p_size AS "Attained_Age" FROM part WHERE p_size % 7 <> 0',
        "study_cells_7": f"WITH {STUDY}, {cells_cte('cells', KEYS_7)} SELECT * FROM cells",
        "study_cells_4": f"WITH {STUDY}, {cells_cte('cells', KEYS_4)} SELECT * FROM cells",
        "ae_by_dataset": ratios('"DATASET", "Smoker_Status"'),
        "ae_total": ratios(""),
        "poisson_deviance": f"""WITH {STUDY}, {cells_cte("cells", KEYS_7)},
fit AS (SELECT "DATASET", "Death_Count" AS y, "ExpDth_VBT2015wMI_Cnt" * {BASE_RATE!r}::DOUBLE AS mu FROM cells)
SELECT "DATASET", round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)), 4) AS deviance
FROM fit GROUP BY 1""",
        "d2_score": f"""WITH {STUDY}, {cells_cte("cells", KEYS_7)},
fit AS (
  SELECT "DATASET", "Death_Count" AS y, "ExpDth_VBT2015wMI_Cnt" * {BASE_RATE!r}::DOUBLE AS mu,
         avg("Death_Count") OVER (PARTITION BY "DATASET") AS mean
  FROM cells
)
SELECT "DATASET", round(1 - sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu))
                          / sum(CASE WHEN y > 0 THEN y * ln(y / mean) ELSE 0 END - (y - mean)), 6) AS d2
FROM fit GROUP BY 1""",
        "category_levels": f"""WITH {STUDY}, bands AS (SELECT DISTINCT "Face_Amount_Band" AS level FROM study)
SELECT level, CAST(row_number() OVER (ORDER BY level <> '3-MEDIUM', level) - 1 AS INTEGER) AS pos FROM bands""",
        "level_counts": f'WITH {BASE} SELECT "Insurance_Plan", count(*) AS n_rows FROM base GROUP BY 1',
        "value_range": f"""WITH {STUDY}
SELECT unnest(generate_series(min("Attained_Age")::BIGINT, max("Attained_Age")::BIGINT)) AS "Attained_Age"
FROM study WHERE "Attained_Age" % 3 <> 0""",
        "first_values": f"""WITH {STUDY}
SELECT min("Sex") AS "Sex", min("Smoker_Status") AS "Smoker_Status", min("Face_Amount_Band") AS "Face_Amount_Band",
       min("Attained_Age") AS "Attained_Age" FROM study""",
        "one_hot_fixed": f"""WITH {STUDY}, {cells_cte("cells", KEYS_4)}
SELECT "DATASET", {KEYS_4}, CAST("Sex" = 'F' AS DOUBLE) AS "Sex_F",
       CAST("Smoker_Status" = 'O' AS DOUBLE) AS "Smoker_Status_O" FROM cells""",
        "ordinal_fixed": """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority,
       CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 ELSE -1 END
            AS DOUBLE) AS priority_code
FROM orders""",
        "one_hot_learned": """
SELECT p_partkey, CASE WHEN p_type <> 'MEDIUM' THEN p_type END AS p_type,
       CAST(p_type = 'LARGE' AS DOUBLE) AS "p_type_LARGE", CAST(p_type = 'PROMO' AS DOUBLE) AS "p_type_PROMO",
       CAST(p_type = 'SMALL' AS DOUBLE) AS "p_type_SMALL", CAST(p_type = 'STANDARD' AS DOUBLE) AS "p_type_STANDARD",
       CAST(p_type = 'MEDIUM' AS DOUBLE) AS "p_type_None"
FROM part""",
        "spline_knots": f"""WITH {STUDY}, {KNOTS}
SELECT 1 AS knot, round(k1, 6) AS value FROM knots UNION ALL SELECT 2, round(k2, 6) FROM knots
UNION ALL SELECT 3, round(k3, 6) FROM knots UNION ALL SELECT 4, round(k4, 6) FROM knots""",
        "spline_basis": SPLINE,
        "glm_saturated": f"""WITH {STUDY}, {SATURATED}
SELECT x AS "Sex", s AS "Smoker_Status", round(rate, 6) AS prediction FROM rates""",
        "glm_path_totals": f"""WITH {STUDY}, totals AS (SELECT sum("Death_Count") AS y FROM study WHERE "DATASET" = 'TRAIN')
SELECT CAST(i AS INTEGER) AS alpha_index, round(y, 3) AS predicted, y AS actual
FROM totals, generate_series(0, {PATH_LENGTH - 1}) AS g(i)""",
        "glm_path_scores": f"""WITH {STUDY},
levels AS (
  SELECT count(DISTINCT "Smoker_Status") AS s, count(DISTINCT "Sex") - 1 AS x, count(DISTINCT "Face_Amount_Band") - 1 AS b
  FROM study WHERE "DATASET" = 'TRAIN'
), size AS (SELECT 4 + s + x + b + 4 * (s - 1) + 4 * x + 5 * (s - 1) * x AS p FROM levels)
SELECT CAST(i AS INTEGER) AS alpha_index, CAST(j AS INTEGER) AS pos, 0::DOUBLE AS score
FROM size, generate_series(0, {PATH_LENGTH - 1}) AS g(i), generate_series(0, 1000) AS h(j) WHERE j <= p""",
        "wide_dictionary": """WITH lines AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey) AS supply FROM lineitem
)
SELECT supply, row_number() OVER (ORDER BY supply) - 1 AS position, count(*) AS n_rows FROM lines GROUP BY supply""",
        "glm_wide_scores": f"""WITH size AS (
  SELECT 1 + count(DISTINCT l_linestatus) + 1 + count(DISTINCT l_orderkey) - 1 AS p FROM lineitem WHERE l_quantity > 0
)
SELECT CAST(i AS INTEGER) AS alpha_index, j AS pos, 0::DOUBLE AS score
FROM generate_series(0, {len(WIDE_ALPHAS) - 1}) AS g(i), (SELECT unnest(generate_series(0, p - 1)) AS j FROM size)""",
        "glm_wide_totals": f"""SELECT a.alpha, count(*) AS n_rows, sum(CAST(l_returnflag = 'R' AS DOUBLE)) AS actual,
  round(sum(CAST(l_returnflag = 'R' AS DOUBLE)), 3) AS predicted
FROM lineitem, (SELECT unnest({WIDE_ALPHAS!r}::DOUBLE[]) AS alpha) AS a WHERE l_quantity > 0 GROUP BY a.alpha""",
        "glm_path_binary": f"""WITH RECURSIVE {STUDY}, {cells_cte("cells", KEYS_7)},
c AS (SELECT "Sex" AS x, "Death_Count" AS y, "ExpDth_VBT2015wMI_Cnt" AS e FROM cells WHERE "DATASET" = 'TRAIN'),
t AS (
  SELECT count(*) AS n, sum(y) AS y, sum(e) FILTER (x = 'O') AS e0, sum(e) FILTER (x = 'F') AS e1,
         sum(y) FILTER (x = 'F') AS y1, sum(CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END) AS yly
  FROM c
),
a AS (SELECT i, 10 * pow(1e-6, i / {PATH_LENGTH - 1}.0) AS alpha FROM generate_series(0, {PATH_LENGTH - 1}) AS g(i)),
b(i, lo, hi, k) AS (
  SELECT i, -20::DOUBLE, 20::DOUBLE, 0 FROM a
  UNION ALL
  SELECT i, CASE WHEN f > 0 THEN mid ELSE lo END, CASE WHEN f > 0 THEN hi ELSE mid END, k + 1
  FROM (
    SELECT b.i, lo, hi, k, (lo + hi) / 2 AS mid,
           (y1 - e1 * exp((lo + hi) / 2) * y / (e0 + e1 * exp((lo + hi) / 2))) / n - alpha * (lo + hi) / 2 AS f
    FROM b JOIN a ON a.i = b.i, t WHERE k < 80
  )
),
fits AS (SELECT i, lo AS slope, ln(y / (e0 + e1 * exp(lo))) AS intercept FROM b, t WHERE k = 80),
scored AS (
  SELECT i, intercept, slope, y, e * exp(intercept + CASE WHEN x = 'F' THEN slope ELSE 0 END) AS mu FROM fits, c
),
devs AS (
  SELECT i, intercept, slope, 2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - y + mu) AS dev FROM scored GROUP BY ALL
)
SELECT CAST(i AS INTEGER) AS alpha_index, round(intercept, 6) AS intercept, round(slope, 6) AS slope,
       round(1 - dev / (2 * (t.yly - t.y * ln(t.y / t.n))), 6) AS d2
FROM devs, t""",
        "factor_uncovered": f"""WITH {STUDY}, {cells_cte("cells", KEYS_4)}
SELECT "DATASET", "Smoker_Status", "Attained_Age", "Sex", "Face_Amount_Band",
       round(exp(-4 + 0.03125 * "Attained_Age" + CASE "Smoker_Status" WHEN 'O' THEN 0.25 + 0.015625 * "Attained_Age"
                 WHEN 'P' THEN -0.5 - 0.0078125 * "Attained_Age" ELSE 0 END), 9) AS model_pred
FROM cells""",
        "node_summary": fixed_tree_stats()
        + " UNION ALL ".join(
            f"SELECT nodeid, '{side}' AS side, n_{side} AS n, sum_y_{side} AS sum_y, sum_exp_{side} AS sum_exp, ae_{side} AS ae, dev_{side} AS dev FROM stats"
            for side in ("parent", "left", "right")
        ),
        "boost_wide_feature": """WITH counted AS (SELECT l_orderkey::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1),
placed AS (
  SELECT v, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(n) OVER () AS total
  FROM counted
),
cuts AS (SELECT min(v) AS cut FROM placed GROUP BY floor(before * 256 / total::DOUBLE))
SELECT 'order' AS feature, CAST(row_number() OVER (ORDER BY cut) - 1 AS INTEGER) AS place, cut FROM cuts""",
        "boost_predict_long": f"""WITH {STUDY}, {cells_cte("cells", KEYS_4)},
counted AS (SELECT *, 50 - least(greatest("Attained_Age", 0), 50) AS below FROM cells)
SELECT "DATASET", "Sex", "Smoker_Status", "Attained_Age", "Face_Amount_Band",
       round(exp(4 * (below / 128.0::DOUBLE - (50 - below) / 256.0::DOUBLE)), 9) AS prediction
FROM counted""",
        "factor_map": f"""WITH {STUDY},
smoker AS (SELECT DISTINCT "Smoker_Status" AS v FROM study),
sex AS (SELECT DISTINCT "Sex" AS v FROM study WHERE "Sex" <> 'O'),
band AS (SELECT DISTINCT "Face_Amount_Band" AS v FROM study WHERE "Face_Amount_Band" <> '3-MEDIUM')
SELECT 'intercept' AS term, 0.5::DOUBLE AS term_value, 'intercept' AS model_term, 'intercept' AS term_group
UNION ALL SELECT 'Smoker_Status[' || v || ']', 0.25, 'Smoker_Status', 'Smoker_Status_x_Sex' FROM smoker
UNION ALL SELECT 'Sex[T.' || v || ']', 0.25, 'Sex', 'Smoker_Status_x_Sex' FROM sex
UNION ALL SELECT 'Face_Amount_Band[T.' || v || ']', 0.25, 'Face_Amount_Band', 'Band_Group' FROM band
UNION ALL SELECT 'Smoker_Status[T.' || smoker.v || ']:Sex[T.' || sex.v || ']', 0.25, 'Smoker_Status:Sex', 'Smoker_Status_x_Sex'
FROM smoker, sex WHERE smoker.v <> 'F'""",
        "factor_map_check": f"""{LEVEL_TERMS}
SELECT 'missing' AS problem, term, 1::BIGINT AS n_rows FROM terms WHERE model_term = 'Face_Amount_Band' AND contains(term, '[T.1')
UNION ALL SELECT 'unexpected', 'Issue_Year:' || term, 1 FROM terms
WHERE model_term = 'Face_Amount_Band' AND NOT contains(term, '[T.1')
UNION ALL SELECT 'duplicate', term, 2 FROM terms WHERE model_term = 'Smoker_Status'""",
        "factor_values_check": f"{LEVEL_TERMS} SELECT term, term_value AS fitted_value FROM terms WHERE model_term = 'Sex'",
        "factor_groups": f"""WITH {STUDY}, {levels}
SELECT 'intercept' AS term_group, 1::BIGINT AS n_terms, 'intercept' AS model_terms
UNION ALL SELECT 'Smoker_Status_x_Sex', s + (x - 1) + (s - 1) * (x - 1), 'Sex + Smoker_Status + Smoker_Status:Sex' FROM levels
UNION ALL SELECT 'Sex_x_Face_Amount_Band', (b - 1) * x, 'Face_Amount_Band + Face_Amount_Band:Sex' FROM levels
UNION ALL SELECT 'Smoker_Status_x_Face_Amount_Band', (b - 1) * (s - 1), 'Face_Amount_Band:Smoker_Status' FROM levels""",
        "prediction_grid": f"""WITH {STUDY},
ages AS (SELECT CAST(unnest(generate_series(min("Attained_Age"), max("Attained_Age"))) AS INTEGER) AS "Attained_Age" FROM study)
SELECT "Attained_Age", "Smoker_Status", "Sex"
FROM ages, (SELECT DISTINCT "Smoker_Status" FROM study), (SELECT DISTINCT "Sex" FROM study)""",
        "factor_wide_group": f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(exp({WIDE_INTERCEPT!r}::DOUBLE + """
        + " + ".join(f"{weight!r}::DOUBLE * {' * '.join(f'{v}::DOUBLE' for v in term)}" for term, weight in WIDE_TERMS.items())
        + "), 6) AS model_pred FROM lineitem",
        "factor_tables": f"""WITH {STUDY}, {SATURATED}
SELECT s AS "Smoker_Status", x AS "Sex", 'Smoker_Status_x_Sex' AS term_group, round(rate, 6) AS factor FROM rates""",
        "factor_join": f"""WITH {STUDY}, {cells_cte("cells", KEYS_4)}, {BAND_FACTORS}
SELECT "DATASET", {KEYS_4}, "ExpDth_VBT2015wMI_Cnt", factor AS "factor_Smoker_x_Band"
FROM cells LEFT JOIN band_factors ON s = "Smoker_Status" AND b = "Face_Amount_Band" """,
        "factor_product": f"""WITH {STUDY}, {cells_cte("cells", KEYS_4)}, {BAND_FACTORS},
overall AS (SELECT round(sum("Death_Count") / sum("ExpDth_VBT2015wMI_Cnt"), 6) AS f FROM study)
SELECT "DATASET", {KEYS_4}, f AS factor_intercept, factor AS "factor_Smoker_x_Band",
       round(f * coalesce(factor, 1), 8) AS model_pred
FROM cells CROSS JOIN overall LEFT JOIN band_factors ON s = "Smoker_Status" AND b = "Face_Amount_Band" """,
        "factor_reconstruct": f"""WITH {STUDY}, {cells_cte("cells", KEYS_7)}
SELECT "DATASET", count(*) AS n_rows, 0::BIGINT AS n_missing, true AS matches FROM cells GROUP BY 1""",
        "split_candidates": candidates(["Attained_Age"], ["Sex", "Smoker_Status"])
        + "SELECT feature, lev AS level, threshold, round(gain, 4) AS gain FROM g0 WHERE gain > 1e-6",
        "split_wide_feature": f"""WITH line_rows AS (
  SELECT l_orderkey AS "order", l_discount AS discount, l_quantity * {BASE_RATE!r}::DOUBLE - CAST(l_returnflag = 'R' AS DOUBLE) AS g,
         l_quantity * {BASE_RATE!r}::DOUBLE * exp(0.7) AS h
  FROM lineitem
),
{', '.join(grow_ctes('', 'line_rows', ['order', 'discount'], [], 1))}
SELECT feature, threshold, round(gain, 4) AS gain FROM g0 WHERE gain > 1e-6""",
        "tree_root_split": candidates(["Issue_Year", "Attained_Age"], ["Sex", "Smoker_Status", "Face_Amount_Band"])
        + """SELECT feature, lev AS level, threshold, round(gain, 4) AS gain, round(lh, 4) AS cover_left,
       round(th - lh, 4) AS cover_right FROM b0""",
        "tree_route": f"""WITH {STUDY},
aged AS (SELECT *, CASE WHEN "Attained_Age" <> 7 THEN "Attained_Age" END AS age FROM study)
SELECT CAST(CASE WHEN age IS NULL OR age < 25.5 THEN CASE WHEN "Smoker_Status" = 'P' THEN 4 ELSE 3 END
            WHEN "Sex" = 'O' THEN 6 WHEN "Issue_Year" < 1998 THEN 7 ELSE 8 END AS INTEGER) AS nodeid,
       count(*) AS n_rows, sum("Death_Count") AS sum_y
FROM aged GROUP BY 1""",
        "tree_split_stats": fixed_tree_stats() + "SELECT * FROM stats",
        "tree_report": fixed_tree_report(),
        "residual_tree": residual_tree(),
        "residual_tree_nodes": residual_tree_nodes(),
        "boost_one_round": boost_one_round(),
        "boost_fit": boost_fit(4),
        "boost_to_stop": boost_to_stop(),
        "boost_roundtrip": f"""WITH {STUDY}, {", ".join(boost_ctes(3))}
SELECT "DATASET", count(*) AS n_rows, sum(y) AS actual, round(sum(exp(f) * e * 64), 4) AS predicted,
       round(sum(exp(f) * e * 64), 4) AS predicted_mean
FROM m3 GROUP BY 1""",
        "scoring_schema": """SELECT * FROM (VALUES ('inputs', 'Sex', 'string'), ('inputs', 'Smoker_Status', 'string'),
  ('inputs', 'Face_Amount_Band', 'string'), ('outputs', 'prediction', 'double')) AS s(role, column_name, column_type), (SELECT 5::BIGINT AS sample_rows)
UNION ALL SELECT 'inputs', 'Attained_Age', CASE data_type WHEN 'BIGINT' THEN 'long' ELSE 'integer' END, 5::BIGINT
FROM information_schema.columns WHERE table_name = 'part' AND column_name = 'p_size'""",
        "residual_tree_fitted": residual_tree_fitted(),
        "boost_predict": boost_predict(3),
        "score_expr": SCORED,
        "score_udf": SCORED,
        "score_roundtrip": f"""WITH {STUDY}, {SATURATED},
scored AS (
  SELECT "Death_Count" AS y, rate * "ExpDth_VBT2015wMI_Cnt" AS p
  FROM study JOIN rates ON x = "Sex" AND s = "Smoker_Status"
)
SELECT count(*) AS n_rows, sum(y) AS actual, round(sum(p), 2) AS predicted,
       round(sum(y) / sum(p), 4) AS actual_over_predicted, round(sum(p) / sum(y), 4) AS predicted_over_actual
FROM scored""",
        "scored_view": f"""WITH {STUDY},
scored AS (
  SELECT "DATASET", sum({MULTIPLIER} * "ExpDth_VBT2015wMI_Cnt") AS p, sum("Death_Count") AS y FROM study GROUP BY 1
)
SELECT "DATASET", round(p, 4) AS model_pred_cnt, y AS "Death_Count", round(y / p, 4) AS "AE" FROM scored""",
        "run_metrics": f"""WITH {STUDY},
totals AS (
  SELECT CASE "DATASET" WHEN 'TRAIN' THEN 'first' ELSE 'second' END AS run_id,
         sum("Death_Count") AS y, sum("ExpDth_VBT2015wMI_Cnt") AS e FROM study GROUP BY 1
)
SELECT run_id, 'actual' AS metric, y AS value FROM totals
UNION ALL SELECT run_id, 'expected', e FROM totals
UNION ALL SELECT run_id, 'ae', round(y / e, 6) FROM totals""",
        "delimited_roundtrip": f"WITH {BASE} SELECT * FROM base",
        "read_ledger": """SELECT "column", (SELECT count(*) FROM lineitem) AS n_rows, 0::BIGINT AS n_malformed, n_unreadable
FROM (
  SELECT 'l_orderkey' AS "column", count(*) FILTER (l_orderkey % 11 = 0) AS n_unreadable FROM lineitem
  UNION ALL SELECT 'l_quantity', count(*) FILTER (l_orderkey % 7 = 0 AND l_quantity IS NOT NULL) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 0
)""",
        "known_levels": f"""WITH {STUDY},
bands AS (SELECT "DATASET", concat("Face_Amount_Band", ' ', "Observation_Year") AS band FROM study)
SELECT "DATASET", CASE WHEN band IN (SELECT band FROM bands WHERE "DATASET" = 'TRAIN') THEN band END AS band, count(*) AS n_rows
FROM bands GROUP BY 1, 2""",
    }
