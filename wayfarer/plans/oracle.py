"""SQL for the catalog's queries, as DuckDB runs it."""

from wayfarer.functions import geometry

BEAMS = """beams AS (SELECT vec_id, label / 10.0 AS v, i - 1 AS b, abs(embedding[i]::DOUBLE) * 20 AS r, -pi() + (i - 1) * (2 * pi() / 63) AS a FROM embeddings, unnest(range(1, 65)) t(i)),
valid AS (SELECT * FROM beams WHERE r > 0.1 AND r < 5.0)"""
CELLS = """raw AS (SELECT vec_id AS grid_id, i - 1 AS k, abs(embedding[i]::DOUBLE) * 20 AS r FROM embeddings, unnest(range(1, 65)) t(i)),
cells AS (SELECT grid_id, (k // 8)::INT AS "row", (k % 8)::INT AS col, (CASE WHEN r > 5.5 THEN 255 WHEN r > 5 THEN 254 WHEN r > 4.5 THEN 253 ELSE floor(r * 40) END)::INT AS cost FROM raw)"""
LOG = """log AS (SELECT event_id, user_id, event_type, value, ts, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)"""
PATH = LOG + """, poses AS (SELECT user_id AS path_id, ts, event_id, value / 100 AS x, k / 100 AS y FROM log),
d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lead(x) OVER w - x AS ex, lead(y) OVER w - y AS ey FROM poses WINDOW w AS (PARTITION BY path_id ORDER BY ts, event_id)),
s AS (SELECT *, coalesce(sqrt(dx * dx + dy * dy), 0.0) AS segment, sqrt(ex * ex + ey * ey) AS nxt FROM d),
measured AS (SELECT path_id, ts, event_id, x, y, segment, sum(segment) OVER (PARTITION BY path_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS distance, coalesce(atan2(dy, dx), 0.0) AS heading,
 CASE WHEN segment > 1e-6 AND nxt > 1e-6 THEN 2 * abs(dx * ey - dy * ex) / (segment * nxt) / ((segment + nxt) / 2) ELSE 0.0 END AS curvature FROM s)"""
TRIALS = """trials AS (SELECT o_orderkey AS trial_id, o_custkey AS campaign, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'COLLISION' ELSE 'TIMEOUT' END AS status, o_totalprice AS path_length FROM orders)"""
U = "cast('0x' || substr(md5(%s), 1, 8) AS BIGINT) / 4294967296.0"
FEATURES = f"""WITH {BEAMS},
near AS (SELECT DISTINCT vec_id, floor((a + pi()) / (2 * pi() / 36))::INT % 36 AS s FROM valid WHERE r < 3.0),
ring AS (SELECT e.vec_id, p, CASE WHEN n.s IS NULL THEN 0 ELSE 1 END AS blocked FROM embeddings e CROSS JOIN range(72) t(p) LEFT JOIN near n ON n.vec_id = e.vec_id AND n.s = p % 36),
isl AS (SELECT *, sum(blocked) OVER (PARTITION BY vec_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM ring),
runs AS (SELECT vec_id, max(n) AS n FROM (SELECT vec_id, g, count(*) FILTER (blocked = 0) AS n FROM isl GROUP BY ALL) GROUP BY vec_id),
one AS (SELECT b.vec_id, any_value(v) AS v, min(CASE WHEN r > 0.1 AND r < 5.0 THEN r END) AS r_min, min(CASE WHEN r > 0.1 AND r < 5.0 AND abs(a) < pi() / 3 THEN r END) AS ahead,
 avg(CASE WHEN abs(a) < pi() / 3 THEN CASE WHEN r >= 0.99 * 5.0 OR r <= 0.1 THEN 1.0 ELSE 0.0 END END) AS vis,
 min(CASE WHEN r > 0.1 AND r < 5.0 AND abs(a - pi() / 2) < pi() / 6 THEN r END) AS lft, min(CASE WHEN r > 0.1 AND r < 5.0 AND abs(a + pi() / 2) < pi() / 6 THEN r END) AS rgt FROM beams b GROUP BY b.vec_id)
"""

SQL = {
    "f_risk_vector": FEATURES + """SELECT one.vec_id, round(coalesce(r_min, 10), 6) AS r_min, round(CASE WHEN abs(v) < 0.01 OR v < 0 OR ahead IS NULL THEN 100 ELSE least(ahead / v, 100) END, 6) AS r_ttc, round(coalesce(vis, 0), 6) AS r_vis,
 round(coalesce(lft + rgt, 2 * lft, 2 * rgt, 10), 6) AS r_width, round(least(n, 36) * (2 * pi() / 36), 6) AS r_clear FROM one JOIN runs USING (vec_id)""",
    "p3_valid_beams": f"WITH {BEAMS} SELECT vec_id, b::INT AS beam, round(r, 6) AS r FROM valid",
    "f9_base_distance": f"WITH {BEAMS} SELECT e.vec_id, round(min(sqrt((r * cos(a) + 0.202) * (r * cos(a) + 0.202) + r * sin(a) * (r * sin(a)))), 6) AS distance FROM embeddings e LEFT JOIN valid USING (vec_id) GROUP BY 1",
    "s11_near_returns": f"WITH {BEAMS}, near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY b) AS n FROM beams WHERE r > 0.1 AND r < 0.15) SELECT vec_id, b::INT AS beam, round(r, 6) AS r, round(degrees(a), 6) AS degrees FROM near WHERE n <= 20",
    "t5_first_scans": f"WITH {BEAMS}, f AS (SELECT vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3), near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY b) AS n FROM beams JOIN f USING (vec_id) WHERE r > 0.1 AND r < 0.4) SELECT vec_id, b::INT AS beam, round(r, 6) AS r FROM near WHERE n <= 20",
    "t5_error_tail": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN right(repeat('é error ' || o_orderkey || '; ', (o_orderkey % 40)::INT), 200) ELSE '' END AS error FROM orders",
    "f4_density": f"WITH {CELLS} SELECT grid_id, round(avg(CASE WHEN cost = 254 THEN 1.0 ELSE 0.0 END), 6) AS r_dens FROM cells WHERE abs(\"row\" - 4) <= 2.0 // 0.5 AND abs(col - 4) <= 2.0 // 0.5 GROUP BY 1",
    "w7_gradient": f"""WITH {CELLS} SELECT grid_id, "row", col, round(sqrt(gx * gx + gy * gy) / 0.5, 6) AS gradient FROM (SELECT *, coalesce((lead(cost) OVER (PARTITION BY grid_id, "row" ORDER BY col) - lag(cost) OVER (PARTITION BY grid_id, "row" ORDER BY col)) / 2.0, 0.0) AS gx,
 coalesce((lead(cost) OVER (PARTITION BY grid_id, col ORDER BY "row") - lag(cost) OVER (PARTITION BY grid_id, col ORDER BY "row")) / 2.0, 0.0) AS gy FROM cells)""",
    "g1_distances": f"""WITH {CELLS} SELECT a.grid_id, a."row", a.col, round(coalesce(sqrt(min((a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col))) * 0.5, 1e9), 6) AS distance FROM cells a LEFT JOIN (SELECT * FROM cells WHERE cost > 253) b ON a.grid_id = b.grid_id GROUP BY 1, 2, 3""",
    "g2_valid_mask": f"""WITH {CELLS}, d AS (SELECT a.grid_id, a."row", a.col, any_value(a.cost) AS cost, min((a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col)) AS d2 FROM cells a LEFT JOIN (SELECT * FROM cells WHERE cost > 253) b ON a.grid_id = b.grid_id GROUP BY 1, 2, 3)
 SELECT grid_id, count(*) FILTER (cost <= 50 AND (d2 IS NULL OR sqrt(d2) * 0.5 >= 1.0)) AS n_valid, round(100.0 * count(*) FILTER (cost <= 50 AND (d2 IS NULL OR sqrt(d2) * 0.5 >= 1.0)) / count(*), 6) AS pct FROM d GROUP BY 1""",
    "s2_static_obstacles": f"""WITH {CELLS} SELECT grid_id, round(-2.0 + (col + 0.5) * 0.5, 6) AS x, round(-2.0 + (8 - 0.5 - "row") * 0.5, 6) AS y FROM cells WHERE cost / 255.0 >= 0.65""",
    "s9_populated_grids": f"WITH {CELLS} SELECT grid_id, bool_or(cost <> 255) AS populated, max(cost) AS worst, count(*) FILTER (cost >= 253) AS n_hit, count(*) FILTER (cost > 253) AS n_obstacle FROM cells GROUP BY 1",
    "j4_nearest_obstacle": f"""WITH {LOG}, p AS (SELECT event_id AS id, value / 100 AS x, k / 100 AS y FROM log WHERE event_type = 'click'), o AS (SELECT DISTINCT value / 100 AS ox, k / 100 AS oy FROM log WHERE event_type = 'error')
 SELECT id, round(min(sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy))), 6) AS distance FROM p, o GROUP BY id""",
    "j7_cell_lookup": f"""WITH {LOG}, {CELLS} SELECT l.event_id, coalesce(c.cost, 254)::INT AS cost FROM log l LEFT JOIN cells c ON c.grid_id = l.user_id AND value / 50 >= 0.5 AND l.k / 25 >= 0.5 AND c.col = trunc((value / 50 - 0.5) / 0.5)::INT AND c."row" = trunc((l.k / 25 - 0.5) / 0.5)::INT""",
    "j2_latest_values": f"WITH {LOG} SELECT event_id, " + ", ".join(f"round(last_value(CASE WHEN event_type = '{t}' THEN value END IGNORE NULLS) OVER w, 6) AS last_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "w1_confirmed_hits": f"""WITH {LOG}, a AS (SELECT *, value > 60 AS hit, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM log)
 SELECT event_id, coalesce(sum(hit::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS run, sum(hit::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 2 AS confirmed FROM a""",
    "w2_a3_detection_stats": f"""WITH {LOG} SELECT event_id, count(*) OVER w AS num_frames, round(avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS costmap_rate, round(avg(CASE WHEN k < 20 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS lidar_rate, round(avg(value) OVER w, 6) AS mean_cost, round(avg(k) OVER w, 6) AS mean_clearance, round(min(k) OVER w, 6) AS min_clearance FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "w8_throttle": f"""WITH RECURSIVE {LOG}, e AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM log), f AS (SELECT user_id, n, t, t AS last, true AS emit FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.t, CASE WHEN e.t - f.last >= 86400 THEN e.t ELSE f.last END, e.t - f.last >= 86400 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
 SELECT user_id, round(t, 6) AS t FROM f WHERE emit""",
    "x5_w9_degraded": f"""WITH {LOG}, a AS (SELECT *, k / 10 < 5.0 AS mid, k / 10 + value / 100 < 8.0 AS late FROM log) SELECT event_id, (3 + CASE WHEN mid THEN 3 ELSE 0 END + CASE WHEN late THEN 2 ELSE 0 END)::INT AS computed, """ + ", ".join(f"round(coalesce(last_value(CASE WHEN {due} THEN value + {i} * k END IGNORE NULLS) OVER w, 0), 6) AS {n}" for i, (n, due) in enumerate((("r_min", "true"), ("r_ttc", "true"), ("r_vis", "true"), ("r_dens", "mid"), ("r_width", "mid"), ("r_clear", "mid"), ("r_curve", "late"), ("r_grad", "late")))) + " FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "w10_last_pose": f"""WITH {LOG}, s AS (SELECT user_id, arg_max(value, (ts, event_id)) AS x, arg_max(k, (ts, event_id)) AS y, count(*) AS n FROM log WHERE event_type = 'signup' AND user_id % 3 > 0 GROUP BY 1), live AS (SELECT user_id, min(value) AS x, max(k) AS y FROM log GROUP BY 1)
 SELECT user_id, round(CASE WHEN n IS NULL THEN live.x ELSE s.x END, 6) AS x, round(CASE WHEN n IS NULL THEN live.y ELSE s.y END, 6) AS y, coalesce(n, 0) AS n_samples FROM live LEFT JOIN s USING (user_id)""",
    "x10_termination": f"""WITH {LOG}, e AS (SELECT *, (t - min(t) OVER (PARTITION BY user_id)) / 86400 AS elapsed FROM log), a AS (SELECT user_id, ts, event_id, elapsed, CASE WHEN elapsed >= 2 AND value / 40 <= 0.25 AND abs(atan2(sin(k / 20), cos(k / 20))) <= 0.25 THEN 'SUCCESS' WHEN event_type = 'error' AND value > 150 THEN 'COLLISION' WHEN elapsed > 20 THEN 'TIMEOUT' END AS reason FROM e)
 SELECT user_id, event_id, reason, round(elapsed, 6) AS elapsed FROM a WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "a2_timing": f"""WITH {LOG}, g AS (SELECT event_type, floor(t / 3600)::BIGINT AS w, count(*) AS cycles, count(*) FILTER (k >= 50) AS degraded, avg(value) AS mean, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS worst, arg_max(value, (ts, event_id)) AS last FROM log GROUP BY ALL),
 ws AS (SELECT event_type, unnest(range(min(w), max(w) + 1)) AS w FROM g GROUP BY 1), a AS (SELECT event_type, w, coalesce(cycles, 0) AS cycles, coalesce(degraded, 0) AS degraded, mean, p95, p99, worst, last, CASE WHEN cycles IS NULL THEN 'STALE' WHEN p99 < 75 THEN 'OK' WHEN p99 < 150 THEN 'WARN' ELSE 'ERROR' END AS level FROM ws LEFT JOIN g USING (event_type, w)),
 b AS (SELECT *, (sum(cycles) OVER o)::BIGINT AS cycles_total, (sum(degraded) OVER o)::BIGINT AS degraded_total FROM a WINDOW o AS (PARTITION BY event_type ORDER BY w ROWS UNBOUNDED PRECEDING))
 SELECT event_type, w, cycles, degraded, cycles_total, degraded_total, level, """ + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "p95", "p99", "worst", "last")) + ", round(100.0 * degraded_total / cycles_total, 6)::DOUBLE AS degraded_pct FROM b",
    "a1_outcomes": f"WITH {TRIALS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("SUCCESS", "COLLISION", "TIMEOUT", "CANCELED", "FAILED", "PLANNING_FAILED", "EXCEPTION")) + " FROM trials",
    "a11_failure_stop": f"""WITH {TRIALS}, a AS (SELECT *, status <> 'SUCCESS' AS bad, sum(CASE WHEN status <> 'SUCCESS' THEN 0 ELSE 1 END) OVER (PARTITION BY campaign ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS g FROM trials), b AS (SELECT campaign, trial_id, sum(bad::INT) OVER (PARTITION BY campaign, g ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
 SELECT campaign, min(trial_id) AS stopped_at FROM b WHERE run >= 4 GROUP BY 1""",
    "j11_resume": f"WITH {TRIALS} SELECT trial_id FROM trials WHERE trial_id NOT IN (SELECT trial_id FROM trials WHERE status = 'SUCCESS')",
    "a5_distance_summary": f"WITH {TRIALS} SELECT campaign, round(min(path_length), 6) AS least, round(max(path_length), 6) AS most, round(avg(path_length), 6) AS mean, round(stddev_pop(path_length), 4) AS spread FROM trials GROUP BY 1",
    "a7_running_minimum": f"WITH {LOG} SELECT event_id, round(min(value) OVER w, 6) AS least, round(min(CASE WHEN k >= 35 THEN value END) OVER w, 6) AS least_on_map FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "a10_collision_latch": f"WITH {LOG} SELECT user_id, bool_or(event_type = 'error' AND value > 200) AS collided, count(*) FILTER (event_type = 'view') AS plans, count(*) AS samples FROM log GROUP BY 1",
    "j10_replan_gate": f"""WITH {LOG}, nav AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM log WHERE event_type = 'signup' GROUP BY 1) SELECT event_id FROM log l WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM nav n WHERE n.user_id = l.user_id AND l.t BETWEEN n.t0 AND n.t1)""",
    "p5_window_trim": f"""WITH {LOG}, nav AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM log WHERE event_type = 'signup' GROUP BY 1) SELECT event_id, round(t - t0, 6) AS since FROM log JOIN nav USING (user_id) WHERE t BETWEEN t0 AND t1""",
    "path_metrics": f"WITH {PATH} SELECT event_id, round(segment, 6) AS segment, round(distance, 6) AS distance, round(heading, 6) AS heading, round(curvature, 4) AS curvature FROM measured",
    "o2_path_summary": f"WITH {PATH} SELECT path_id, count(*) AS n_poses, round(sum(segment), 6) AS length, round(coalesce(max(CASE WHEN distance <= 3.0 THEN curvature END), 0), 4) AS r_curve FROM measured GROUP BY 1",
    "p6_p7_angles": f"WITH {LOG} SELECT event_id, round(sin(t / 2), 6) AS qz, round(cos(t / 2), 6) AS qw, round(atan2(sin(t), cos(t)), 6) AS yaw, round(atan2(sin(value), cos(value)), 6) AS wrapped FROM log",
    "o3_terminal_error": f"WITH {LOG}, e AS (SELECT user_id, arg_max(value, (t, event_id)) - arg_min(value, (t, event_id)) AS dx, arg_max(k, (t, event_id)) - arg_min(k, (t, event_id)) AS dy FROM log GROUP BY 1) SELECT user_id, round(sqrt(dx * dx + dy * dy), 6) AS xy_error, round(atan2(sin(dy), cos(dy)), 6) AS yaw_error FROM e",
    "r1_uniform_draw": "SELECT o_orderkey AS id, round(0.2 + " + U % "'7|vx|' || o_orderkey" + " * 0.6, 9) AS vx, round(exp(ln(0.01) + " + U % "'7|w|' || o_orderkey" + " * (ln(10.0) - ln(0.01))), 6) AS weight, (30 + floor(" + U % "'7|n|' || o_orderkey" + " * 61))::BIGINT AS steps, ['tucked', 'carry'][1 + floor(" + U % "'7|c|' || o_orderkey" + " * 2)::INT] AS arm FROM orders",
    "r3_latin_hypercube": "WITH d AS (SELECT id, dim, row_number() OVER (PARTITION BY dim ORDER BY md5('5|' || dim || '|' || id), id) - 1 AS k, " + U % "'5|u|' || dim || '|' || id" + " AS u FROM range(3000) t(id), (VALUES ('vx'), ('steps'), ('arm')) v(dim))"
    " SELECT id, round(max(CASE WHEN dim = 'vx' THEN 0.2 + (k + u) / 3000 * 0.6 END), 9) AS vx, max(CASE WHEN dim = 'steps' THEN 30 + least(floor((k + u) / 3000 * 61), 60) END)::DOUBLE AS steps, max(CASE WHEN dim = 'arm' THEN ['tucked', 'carry'][1 + k % 2] END) AS arm FROM d GROUP BY id",
    "r5_unit_scale": "SELECT l_orderkey, l_linenumber, round((l_quantity - 1.0) / 49.0, 9) AS u_quantity, round((l_discount - 0.0) / 0.1, 9) AS u_discount, round((list_position(['A', 'N', 'R'], l_returnflag) - 1) / 2.0, 9) AS u_flag FROM lineitem",
    "j6_a4_distance_report": "WITH v AS (SELECT vec_id, embedding FROM embeddings), n AS (SELECT a.vec_id, min(sqrt(list_sum(list_transform(range(1, 7), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1)"
    " SELECT count(*) AS n, 6::BIGINT AS dims, round(min(d), 6) AS least, round(quantile_cont(d, 0.01), 6) AS p1, round(quantile_cont(d, 0.5), 6) AS median, count(*) FILTER (d < 0.05) AS close FROM n",
    "r7_pose_pairs": f"""WITH {CELLS}, m AS (SELECT grid_id // 500 * 8 + "row" AS "row", grid_id % 500 * 8 + col AS col, cost FROM cells), lethal AS (SELECT "row", col FROM m WHERE cost > 253),
 v AS (SELECT col * 0.05::DOUBLE AS x, (8 - "row") * 0.05::DOUBLE AS y, row_number() OVER (ORDER BY "row", col) - 1 AS rank FROM m WHERE cost <= 50 AND col * 0.05::DOUBLE >= 0.2 AND NOT EXISTS (SELECT 1 FROM lethal l WHERE l.col = m.col AND l."row" BETWEEN m."row" - 1 AND m."row" + 1)
  AND NOT EXISTS (SELECT 1 FROM lethal l WHERE l.col = m.col - 1 AND l."row" BETWEEN m."row" - 1 AND m."row" + 1) AND NOT EXISTS (SELECT 1 FROM lethal l WHERE l.col = m.col + 1 AND l."row" BETWEEN m."row" - 1 AND m."row" + 1)),
 a AS (SELECT pair, k, floor(""" + U % "'3|start|' || pair || '|' || k" + " * (SELECT count(*) FROM v)) AS s, floor(" + U % "'3|goal|' || pair || '|' || k" + """ * (SELECT count(*) FROM v)) AS g FROM range(300) p(pair), range(1, 1001) q(k)),
 ok AS (SELECT pair AS id, k AS attempt, s.x AS start_x, s.y AS start_y, g.x AS goal_x, g.y AS goal_y, sqrt((g.x - s.x) * (g.x - s.x) + (g.y - s.y) * (g.y - s.y)) AS distance FROM a JOIN v s ON s.rank = a.s JOIN v g ON g.rank = a.g WHERE distance BETWEEN 20 AND 22 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY k) = 1)
 SELECT id, attempt::INT AS attempt, """ + ", ".join(f"round({c}, 6) AS {c}" for c in ("start_x", "start_y", "goal_x", "goal_y")) + ", " + ", ".join(f"round(-pi() + 2 * pi() * " + U % f"'3|{p}_yaw|' || id || '|' || attempt" + f", 6) AS {p}_yaw" for p in ("start", "goal")) + ", round(distance, 3) AS distance FROM ok",
    "a12_quota": "WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), q AS (SELECT l_returnflag, 1000 // 3 + CASE WHEN row_number() OVER (ORDER BY l_returnflag) <= 1000 % 3 THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT l_returnflag FROM lineitem)) SELECT l_returnflag, count(*) AS n FROM r JOIN q USING (l_returnflag) WHERE n <= quota GROUP BY 1",
    "j1_trial_zip": "SELECT o.o_orderkey AS trial_id, c.c_custkey AS config_id, n.n_nationkey AS pose_id FROM orders o JOIN customer c ON o.o_orderkey - 1 = c.c_custkey JOIN nation n ON o.o_orderkey - 1 = n.n_nationkey",
    "p14_clamp": "SELECT least(3000, (SELECT count(*) FROM customer), (SELECT count(*) FROM supplier))::BIGINT AS n_trials",
    "p1_flat_config": "SELECT l_orderkey, l_linenumber, l_quantity AS param__controller_server__FollowPath_vx_max, l_discount AS param__local_costmap__inflation_radius FROM lineitem",
    "p8_read_back": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(abs(l_extendedprice * 1.005 - l_extendedprice) <= greatest(1e-3, 0.01 * abs(l_extendedprice)), false) AS continuous_ok, trunc(l_quantity + 0.7)::BIGINT = trunc(l_quantity)::BIGINT AS discrete_ok, lower(trim(' ' || l_returnflag || ' ')) = lower(l_linestatus) AS text_ok FROM lineitem",
    "p10_failed_params": "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS params_unverified_count, coalesce(string_agg(l_linenumber || '/' || l_partkey, ';' ORDER BY l_linenumber || '/' || l_partkey) FILTER (l_returnflag = 'R'), '') AS params_unverified, (count(*) FILTER (l_returnflag = 'R') = 0)::INT AS config_valid FROM lineitem GROUP BY 1",
    "p13_truthy": "SELECT l_orderkey, l_linenumber, lower(trim(CASE l_linenumber WHEN 1 THEN ' Yes ' WHEN 2 THEN 'ON' WHEN 3 THEN '0' ELSE l_returnflag END)) IN ('1', 'true', 'yes', 'on') AS flag FROM lineitem",
    "g9_g10_polygons": "SELECT * FROM (VALUES ('carry', 0.417573, 0.112241, -0.183593, 0.224221, 0.632346, 0.265619, 0.847115), ('extended', 0.6, 0.0, -0.38, 0.15, 0.932148, 0.180278, 1.308625), ('tucked', 0.252, 0.0, 0.0, 0.275744, 0.3, 0.275744, 0.3)) t(name, area, cx, cy, inscribed, circumscribed, inscribed_origin, circumscribed_origin)",
}
SQL["g9_g10_polygons"] = "SELECT name, area::DOUBLE AS area, cx::DOUBLE AS cx, cy::DOUBLE AS cy, inscribed::DOUBLE AS inscribed, circumscribed::DOUBLE AS circumscribed, inscribed_origin::DOUBLE AS inscribed_origin, circumscribed_origin::DOUBLE AS circumscribed_origin FROM (" + SQL["g9_g10_polygons"] + ")"

SQL |= {
    "g15_g17_constructors": "SELECT 'circle' AS name, k::INT AS i, round(0.27 * cos(k * (2 * pi() / 8)), 6) + 0.0 AS x, round(0.27 * sin(k * (2 * pi() / 8)), 6) + 0.0 AS y FROM range(8) t(k) UNION ALL SELECT 'line', k::INT, round(0.3 * k / 12, 6) + 0.0, round(0.4 * k / 12, 6) + 0.0 FROM range(13) t(k)"
    " UNION ALL SELECT 'rectangle', i::INT, x::DOUBLE, y::DOUBLE FROM (VALUES (0, 0.5, 0.25), (1, -0.3, 0.25), (2, -0.3, -0.25), (3, 0.5, -0.25)) t(i, x, y)",
    "o1_footprint_cost": f"""WITH {LOG}, {CELLS}, v AS (SELECT event_id AS id, user_id AS grid_id, i, value / 50 + dx AS x, k / 25 + dy AS y FROM log, (VALUES (0, 0.4, 0.4), (1, -0.4, 0.4), (2, -0.4, -0.4), (3, 0.4, -0.4)) p(i, dx, dy)),
 m AS (SELECT id, grid_id, i, trunc(x / 0.5)::INT AS mx, trunc(y / 0.5)::INT AS my, min(CASE WHEN x >= 0 AND y >= 0 AND trunc(x / 0.5) < 8 AND trunc(y / 0.5) < 8 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS inside FROM v),
 e AS (SELECT a.id, a.grid_id, a.i, a.mx AS x0, a.my AS y0, (b.mx - a.mx)::DOUBLE AS dx, (b.my - a.my)::DOUBLE AS dy FROM m a JOIN m b ON a.id = b.id AND b.i = (a.i + 1) % 4 WHERE a.inside = 1),
 w AS (SELECT *, sqrt(dx * dx + dy * dy) AS size FROM e), s AS (SELECT id, grid_id, i, CASE WHEN size = 0 THEN x0 ELSE trunc(x0 + t * 0.1::DOUBLE * (dx / size))::INT END AS col, CASE WHEN size = 0 THEN y0 ELSE trunc(y0 + t * 0.1::DOUBLE * (dy / size))::INT END AS "row" FROM w, LATERAL unnest(range(floor(size / 0.1::DOUBLE)::INT + 1)) u(t)),
 l AS (SELECT s.id, i, CASE WHEN bool_or(c.cost = 254) THEN 254 ELSE max(c.cost) END AS cost FROM s JOIN cells c USING (grid_id, "row", col) GROUP BY ALL),
 r AS (SELECT id, max(cost) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS so_far FROM l), f AS (SELECT id, CASE WHEN bool_or(so_far = 254) THEN 254 ELSE max(so_far) END AS cost FROM r GROUP BY 1)
 SELECT event_id AS id, coalesce(f.cost, 254)::INT AS cost FROM log LEFT JOIN f ON f.id = event_id""",
    "g14_fused_detection": "WITH " + LOG + ", h AS (SELECT *, value * 4 >= 253 OR k < 40 AS either_hit, value * 4 >= 253 AND k < 40 AS both_hit FROM log), a AS (SELECT *, sum(CASE WHEN either_hit THEN 0 ELSE 1 END) OVER w AS g, sum(CASE WHEN both_hit THEN 0 ELSE 1 END) OVER w AS h FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"
    " SELECT event_id, either_hit, sum(either_hit::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 2 AS either_confirmed, both_hit, sum(both_hit::INT) OVER (PARTITION BY user_id, h ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 2 AS both_confirmed FROM a",
    "j3_state_on_samples": f"WITH {LOG} SELECT v.event_id, round(c.value, 6) AS r_min FROM (SELECT * FROM log WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM log WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.ts >= c.ts",
    "x11_outcome": "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'COLLISION' WHEN o_orderpriority = '5-LOW' THEN 'TIMEOUT' WHEN o_orderstatus = 'F' THEN 'SUCCESS' WHEN o_orderstatus = 'O' THEN 'FAILED' ELSE 'UNKNOWN' END AS status FROM orders",
    "p9_read_back_text": "SELECT l_orderkey, l_linenumber, l_partkey, trim(split_part('Double value is:  ' || trunc(l_quantity)::INT || ' ', 'value is:', 2)) AS got FROM lineitem",
    "p15_arm_moves": """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderstatus END AS label, o_orderpriority <> '1-URGENT' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
 f AS (SELECT o_custkey, o_orderkey, n, label IS NOT NULL AS move, CASE WHEN ok THEN label END AS at FROM o WHERE n = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.n, f.at IS DISTINCT FROM o.label, CASE WHEN f.at IS DISTINCT FROM o.label THEN CASE WHEN o.ok THEN o.label END ELSE f.at END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1)
 SELECT o_orderkey, move FROM f""",
    "o4_collision_threshold": "SELECT n_nationkey, round(CASE WHEN n_regionkey > 0 THEN n_regionkey / 10.0 + 0.05 ELSE 0.15 END, 6)::DOUBLE AS threshold FROM nation",
    "o5_isolated_errors": f"WITH {LOG} SELECT event_id AS trial_id, CASE WHEN k::INT % 7 <> 0 THEN 'SUCCESS' ELSE 'EXCEPTION' END AS status, CASE WHEN k::INT % 7 <> 0 THEN round(value, 6) END AS travel_time, CASE WHEN k::INT % 7 = 0 THEN 'bad k ' || k::INT END AS error FROM log",
}

_SHAPES = ", ".join(f"('{name}', {i}, {x}::DOUBLE, {y}::DOUBLE)" for name, poly in (("carry", geometry.CARRY), ("extended", geometry.EXTENDED), ("tucked", geometry.TUCKED)) for i, (x, y) in enumerate(poly))
SURFACES = f"""v AS (SELECT * FROM (VALUES {_SHAPES}) t(name, i, x, y)),
edge AS (SELECT a.name, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy, b.x AS bx, b.y AS yb FROM v a JOIN v b ON a.name = b.name AND b.i = (a.i + 1) % (SELECT count(*) FROM v c WHERE c.name = a.name)),
mid AS (SELECT name, sum((ax + bx) * (ax * yb - bx * ay)) / (3 * sum(ax * yb - bx * ay)) AS cx, sum((ay + yb) * (ax * yb - bx * ay)) / (3 * sum(ax * yb - bx * ay)) AS cy FROM edge GROUP BY 1),
rel AS (SELECT name, ax - cx AS ax, ay - cy AS ay, dx, dy, greatest(0, least(1, ((cx - ax) * dx + (cy - ay) * dy) / (dx * dx + dy * dy))) AS f FROM edge JOIN mid USING (name)),
inside AS (SELECT name, min(sqrt((ax + f * dx) * (ax + f * dx) + (ay + f * dy) * (ay + f * dy))) AS r FROM rel GROUP BY 1),
ray AS (SELECT k, cos(k * (2 * pi() / 360)) AS c, sin(k * (2 * pi() / 360)) AS s FROM range(360) t(k)),
met AS (SELECT name, k, (dx * ay - dy * ax) / (dx * s - dy * c) AS far FROM rel, ray WHERE abs(dx * s - dy * c) > 1e-10 AND (dx * ay - dy * ax) / (dx * s - dy * c) >= 0 AND (c * ay - s * ax) / (dx * s - dy * c) BETWEEN 0 AND 1),
surface AS (SELECT i.name, ray.k, coalesce(min(far), any_value(i.r)) AS far FROM inside i CROSS JOIN ray LEFT JOIN met ON met.name = i.name AND met.k = ray.k GROUP BY ALL)"""
_SQUARE = "(VALUES (0, 0.4::DOUBLE, 0.4::DOUBLE), (1, -0.4, 0.4), (2, -0.4, -0.4), (3, 0.4, -0.4)) p(i, qx, qy)"
ANALYZED = f"""{LOG}, {CELLS}, pose AS (SELECT event_id AS id, user_id AS grid_id, ts, value / 50 AS x, k / 25 AS y FROM log),
step AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS segment, coalesce(atan2(y - lag(y) OVER w, x - lag(x) OVER w), 0.0) AS heading FROM pose WINDOW w AS (PARTITION BY grid_id ORDER BY ts, id)),
corner AS (SELECT id, grid_id, i, x + qx * cos(heading) - qy * sin(heading) AS x, y + qx * sin(heading) + qy * cos(heading) AS y FROM step, {_SQUARE}),
m AS (SELECT id, grid_id, i, trunc(x / 0.5)::INT AS mx, trunc(y / 0.5)::INT AS my, min(CASE WHEN x >= 0 AND y >= 0 AND trunc(x / 0.5) < 8 AND trunc(y / 0.5) < 8 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS inside FROM corner),
e AS (SELECT a.id, a.grid_id, a.i, a.mx AS x0, a.my AS y0, (b.mx - a.mx)::DOUBLE AS dx, (b.my - a.my)::DOUBLE AS dy FROM m a JOIN m b ON a.id = b.id AND b.i = (a.i + 1) % 4 WHERE a.inside = 1),
w AS (SELECT *, sqrt(dx * dx + dy * dy) AS size FROM e), s AS (SELECT id, grid_id, i, CASE WHEN size = 0 THEN x0 ELSE trunc(x0 + t * 0.1::DOUBLE * (dx / size))::INT END AS col, CASE WHEN size = 0 THEN y0 ELSE trunc(y0 + t * 0.1::DOUBLE * (dy / size))::INT END AS "row" FROM w, LATERAL unnest(range(floor(size / 0.1::DOUBLE)::INT + 1)) u(t)),
l AS (SELECT s.id, i, CASE WHEN bool_or(c.cost = 254) THEN 254 ELSE max(c.cost) END AS cost FROM s JOIN cells c USING (grid_id, "row", col) GROUP BY ALL),
r AS (SELECT id, max(cost) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS so_far FROM l), f AS (SELECT id, CASE WHEN bool_or(so_far = 254) THEN 254 ELSE max(so_far) END AS cost FROM r GROUP BY 1),
seen AS (SELECT id, floor(x / 0.5) AS col, floor(y / 0.5) AS "row", grid_id FROM pose WHERE x >= 0 AND y >= 0 AND x < 4 AND y < 4),
near AS (SELECT id, min(sqrt(pow(seen."row" - c."row", 2) + pow(seen.col - c.col, 2))) * 0.5 AS obstacle FROM seen JOIN cells c ON c.grid_id = seen.grid_id AND c.cost > 253 GROUP BY 1),
analyzed AS (SELECT step.*, coalesce(f.cost, 254)::INT AS cost, coalesce(near.obstacle, 1e9) AS obstacle FROM step LEFT JOIN f USING (id) LEFT JOIN near USING (id))"""

SQL |= {
    "g12_surfaces": f"WITH {SURFACES} SELECT name, k::INT AS k, round(far, 6) AS surface FROM surface",
    "g13_lidar_clearance": f"""WITH {BEAMS}, {SURFACES}, good AS (SELECT vec_id, a, r - far AS c FROM beams JOIN surface ON name = 'carry' AND surface.k = trunc(CASE WHEN a < 0 THEN (a % (2 * pi()) + 2 * pi()) % (2 * pi()) ELSE a % (2 * pi()) END / (2 * pi()) * 360)::INT % 360 WHERE r > 0.01 AND r < 30.0)
 SELECT e.vec_id, round(coalesce(min(c), 'inf'::DOUBLE), 6) AS clearance, round(coalesce(arg_min(a, (c, a)), 0), 6) AS angle, coalesce(min(c) < 0.05, false) AS collision FROM embeddings e LEFT JOIN good USING (vec_id) GROUP BY 1""",
    "p4_lidar_band": f"WITH {BEAMS} SELECT vec_id, count(*) FILTER (r > 0.01 AND r < 30.0) AS n_good, round(min(r) FILTER (r > 0.01 AND r < 30.0), 6) AS least FROM beams GROUP BY 1",
    "f8_gradient_at": f"""WITH {LOG}, {CELLS}, g AS (SELECT grid_id, "row", col, sqrt(gx * gx + gy * gy) / 0.5 AS gradient FROM (SELECT *, coalesce((lead(cost) OVER (PARTITION BY grid_id, "row" ORDER BY col) - lag(cost) OVER (PARTITION BY grid_id, "row" ORDER BY col)) / 2.0, 0.0) AS gx,
 coalesce((lead(cost) OVER (PARTITION BY grid_id, col ORDER BY "row") - lag(cost) OVER (PARTITION BY grid_id, col ORDER BY "row")) / 2.0, 0.0) AS gy FROM cells))
 SELECT event_id, round(coalesce(gradient, 0), 6) AS r_grad FROM log LEFT JOIN g ON g.grid_id = user_id AND col = trunc((value / 50 - 0.5) / 0.5)::INT AND "row" = trunc((log.k / 25 - 0.5) / 0.5)::INT""",
    "o1_path_analysis": f"WITH {ANALYZED} SELECT id AS event_id, round(heading, 6) AS heading, cost AS footprint_cost, round(obstacle, 6) AS min_dist_to_obstacle FROM analyzed",
    "o2_replan_analysis": f"WITH {ANALYZED} SELECT grid_id AS path_id, count(*) AS num_poses, round(sum(segment), 6) AS path_length_m, round(min(obstacle), 6) AS min_obstacle_distance, max(cost) AS worst_cost FROM analyzed GROUP BY 1",
    "p11_apply_targets": """WITH t AS (SELECT l_orderkey AS trial_id, l_linenumber AS n, l_linestatus AS extra, CASE WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN '[[0.3, 0.0]]' WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN '[[0.5, 0.0]]' ELSE l_returnflag END AS target_value FROM lineitem),
 u AS (SELECT trial_id, 'controller' AS ros_node, n::VARCHAR AS name, target_value FROM t UNION ALL SELECT trial_id, 'local_costmap', extra, target_value FROM t WHERE n % 2 = 0) SELECT trial_id, ros_node, name, target_value, count(*) AS n FROM u GROUP BY ALL""",
    "p12_footprint_of": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 8 END::INT AS n, CASE n_nationkey % 3 WHEN 0 THEN 0.18 WHEN 1 THEN 0.625 ELSE round(4 * 0.09 * sin(pi() / 4), 6) END::DOUBLE AS area FROM nation",
    "j8_preset_lookup": "SELECT o_orderkey, label, mode, n_vertices FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'tucked' WHEN 'O' THEN 'carry' END AS label FROM orders) LEFT JOIN (VALUES ('tucked', 'fold', 8), ('carry', 'reach', 12)) p(label, mode, n_vertices) USING (label)",
    "j9_joints_present": f"WITH {LOG}, j AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM log GROUP BY ALL) SELECT user_id, count(*) = 5 AS complete, " + ", ".join(f"round(max(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM j GROUP BY 1",
    "s10_link_frames": "SELECT DISTINCT event_type || '_' || (user_id % 7) || '_link' AS frame FROM events WHERE event_type IN ('click', 'view') AND user_id % 7 BETWEEN 0 AND 3",
    "s6_checkpoint": f"WITH {TRIALS} SELECT coalesce(max(trial_id), 0) AS completed_trials FROM trials WHERE status = 'SUCCESS'",
    "k3_summary": f"WITH {TRIALS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{t}') AS {t.lower()}" for t in ("SUCCESS", "COLLISION", "TIMEOUT", "CANCELED", "FAILED", "PLANNING_FAILED", "UNKNOWN", "EXCEPTION")) + ", 0::BIGINT AS other FROM trials",
    "k5_export_rows": "SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_name) - 1 AS id FROM nation",
    "p2_flat_result": 'SELECT o_orderkey AS trial_id, o_orderstatus AS status, o_totalprice AS "param__FollowPath_vx_max", o_orderpriority AS param__footprint FROM orders',
    "r2_edited_space": "SELECT n_regionkey::VARCHAR AS node, n_name AS name, 0.0::DOUBLE AS low, n_nationkey / 10.0 AS high FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT '2', 'vx_max', 0.2, 0.8",
    "x2_tick_merge": f"""WITH {LOG}, span AS (SELECT user_id, min(t) FILTER (event_type = 'click') AS lo, max(t) AS hi FROM log GROUP BY 1), tick AS (SELECT user_id, d * 86400 AS t FROM span, LATERAL unnest(range(ceil(lo / 86400)::BIGINT, floor(hi / 86400)::BIGINT + 1)) u(d)),
 c AS (SELECT user_id, t, arg_max(value, event_id) AS value FROM log WHERE event_type = 'click' GROUP BY ALL), v AS (SELECT user_id, t, arg_max(value, event_id) AS value FROM log WHERE event_type = 'view' GROUP BY ALL)
 SELECT tick.user_id, tick.t, round(c.value, 6) AS click, round(v.value, 6) AS "view" FROM tick ASOF LEFT JOIN c ON c.user_id = tick.user_id AND tick.t >= c.t ASOF LEFT JOIN v ON v.user_id = tick.user_id AND tick.t >= v.t""",
    "x1_latest_of_batch": "SELECT event_id // 100 AS batch, event_type, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1, 2",
    "x13_well_formed": "SELECT vec_id, " + ", ".join(f"round(embedding[{k}]::DOUBLE, 6) AS {n}" for k, n in enumerate(("r_min", "r_width", "r_ttc", "r_dens", "r_clear", "r_curve", "r_grad", "r_vis"), 1)) + " FROM embeddings WHERE vec_id % 4 + 6 = 8",
    "x13_rejected": "SELECT (CASE WHEN vec_id % 9 = 0 THEN -1 ELSE vec_id % 4 + 6 END)::INT AS arity, count(*) AS rejected FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 4 <> 2 GROUP BY 1",
    "s9_first_populated": f"WITH {CELLS}, s AS (SELECT grid_id % 50 AS grid_id, grid_id AS taken, CASE WHEN grid_id % 150 < 50 OR grid_id % 50 = 7 THEN 255 ELSE cost END AS cost FROM cells), f AS (SELECT grid_id, coalesce(min(taken) FILTER (cost <> 255), max(taken)) AS taken FROM s GROUP BY 1) SELECT grid_id, taken, sum(cost)::BIGINT AS total FROM s JOIN f USING (grid_id, taken) GROUP BY ALL",
    "g3_pixel_world": f'WITH {CELLS} SELECT grid_id, "row", col, round(-3.0 + col * 0.05, 6)::DOUBLE AS x, round(2.0 + (8 - "row") * 0.05, 6)::DOUBLE AS y, col AS px, "row" AS py FROM cells',
    "s2_negated_map": f"""WITH {CELLS}, m AS (SELECT *, unnest([0, 1]) AS negate FROM cells) SELECT grid_id AS map_id, negate::INT AS negate, round(-2.0 + (col + 0.5) * 0.5, 6)::DOUBLE AS x, round(-2.0 + (8 - 0.5 - "row") * 0.5, 6)::DOUBLE AS y FROM m WHERE CASE negate WHEN 1 THEN cost ELSE 255 - cost END / 255.0 >= 0.65""",
    "g17_drop_collinear": "SELECT i::INT AS i, x::DOUBLE AS x, y::DOUBLE AS y FROM (VALUES (0, 0.5, 0.5), (1, -0.5, 0.5), (2, -0.5, -0.5), (3, 0.5, -0.5)) t(i, x, y)",
}

# of points p (key, x, y), the corners v of each key's hull, numbered from 1 counter-clockwise (n of size); collinear points go
HULL = """e AS (SELECT a.key, a.x, a.y FROM p a JOIN p b ON a.key = b.key AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON a.key = c.key GROUP BY a.key, a.x, a.y, b.x, b.y
  HAVING bool_and((b.x - a.x) * (c.y - a.y) >= (b.y - a.y) * (c.x - a.x)) AND bool_and((b.x - a.x) * (c.y - a.y) <> (b.y - a.y) * (c.x - a.x) OR (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) BETWEEN 0 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))),
 m AS (SELECT key, avg(x) AS cx, avg(y) AS cy, count(*) AS size FROM (SELECT DISTINCT * FROM e) GROUP BY 1),
 v AS (SELECT key, x, y, size, row_number() OVER (PARTITION BY key ORDER BY atan2(y - cy, x - cx)) AS n FROM (SELECT DISTINCT * FROM e) JOIN m USING (key))"""
SQL["g16_convex_hull"] = f"""WITH {LOG}, p AS (SELECT DISTINCT user_id AS key, round(value / 100, 6) AS x, round(k / 100, 6) AS y FROM log), {HULL},
 s AS (SELECT *, first_value(n) OVER (PARTITION BY key ORDER BY x, y) AS n0 FROM v) SELECT key AS path_id, (n - n0 + size) % size AS i, x, y FROM s"""
SQL["g19_measured_footprint"] = f"""WITH {LOG}, j AS (SELECT user_id AS key, value / 200 AS x, k / 200 AS y FROM log WHERE event_type = 'signup'),
 q AS (SELECT key, x + 0.05 * cos(i * (2 * pi() / 6)) AS x, y + 0.05 * sin(i * (2 * pi() / 6)) AS y FROM j, range(6) t(i) UNION ALL SELECT DISTINCT key, 0.27 * cos(i * (2 * pi() / 12)), 0.27 * sin(i * (2 * pi() / 12)) FROM j, range(12) t(i)),
 p AS (SELECT DISTINCT key, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y FROM q WHERE x * x + y * y > 0.26 * 0.26), {HULL},
 kept AS (SELECT b.key, b.x, b.y, b.n FROM v b JOIN v a ON a.key = b.key AND a.n = (b.n + b.size - 2) % b.size + 1 JOIN v c ON c.key = b.key AND c.n = b.n % b.size + 1 WHERE abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) > 1e-3),
 f AS (SELECT key, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) - x AS dx, coalesce(lead(y) OVER w, first_value(y) OVER w) - y AS dy FROM kept WINDOW w AS (PARTITION BY key ORDER BY n)),
 t AS (SELECT *, CASE WHEN dx * dx + dy * dy < 1e-10 THEN 0.0 ELSE greatest(0.0, least(1.0, -(x * dx + y * dy) / (dx * dx + dy * dy))) END AS t FROM f)
 SELECT key AS robot, count(*)::INT AS n, round(min(sqrt((x + t * dx) * (x + t * dx) + (y + t * dy) * (y + t * dy))), 6) AS inscribed, round(max(sqrt(x * x + y * y)), 6) AS circumscribed FROM t GROUP BY 1"""
SQL["r4_maximin"] = """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_mktsegment AS arm, (c_acctbal + 1000) / 11000 AS a, c_nationkey / 24 AS b FROM customer), q AS (SELECT arm, 100 // (SELECT count(DISTINCT arm) FROM p) + CASE WHEN row_number() OVER (ORDER BY arm) <= 100 % (SELECT count(DISTINCT arm) FROM p) THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT arm FROM p)),
 m AS (SELECT *, avg(a) OVER (PARTITION BY arm) AS ma, avg(b) OVER (PARTITION BY arm) AS mb FROM p JOIN q USING (arm)),
 z AS (SELECT *, first_value(struct_pack(id := id, a := a, b := b)) OVER (PARTITION BY arm ORDER BY (a - ma) * (a - ma) + (b - mb) * (b - mb), id) AS c FROM m),
 r AS (SELECT arm, quota, 1 AS step, id, a, b, c.id AS chosen, (a - c.a) * (a - c.a) + (b - c.b) * (b - c.b) AS gap FROM z UNION ALL
  SELECT arm, quota, step + 1, id, a, b, c.id, least(gap, (a - c.a) * (a - c.a) + (b - c.b) * (b - c.b)) FROM (SELECT *, first_value(struct_pack(id := id, a := a, b := b)) OVER (PARTITION BY arm ORDER BY gap DESC, id) AS c FROM r WHERE step < quota))
 SELECT p.id, p.arm, round(a, 9) AS u_vx, round(b, 9) AS u_steps FROM p WHERE id IN (SELECT chosen FROM r)"""

_TIERED = {"r_min": "true", "r_ttc": "true", "r_vis": "true", "r_dens": "mid", "r_width": "mid", "r_clear": "mid", "r_curve": "fine", "r_grad": "fine"}
SQL["x_risk_node"] = FEATURES + f""", {CELLS}, {LOG},
grad AS (SELECT grid_id, "row", col, sqrt(gx * gx + gy * gy) / 0.5 AS g FROM (SELECT *, coalesce((lead(cost) OVER (PARTITION BY grid_id, "row" ORDER BY col) - lag(cost) OVER (PARTITION BY grid_id, "row" ORDER BY col)) / 2.0, 0.0) AS gx,
 coalesce((lead(cost) OVER (PARTITION BY grid_id, col ORDER BY "row") - lag(cost) OVER (PARTITION BY grid_id, col ORDER BY "row")) / 2.0, 0.0) AS gy FROM cells)),
pt AS (SELECT event_id AS plan, i, i * 0.5 AS x, ((i * i * k::BIGINT + event_id) % 7) / 10.0 AS y FROM log, LATERAL unnest(range(CASE WHEN event_id % 11 = 0 THEN 2 ELSE 5 END)) u(i) WHERE event_type = 'view'),
pd AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lead(x) OVER w - x AS ex, lead(y) OVER w - y AS ey FROM pt WINDOW w AS (PARTITION BY plan ORDER BY i)),
ps AS (SELECT *, coalesce(sqrt(dx * dx + dy * dy), 0.0) AS segment, sqrt(ex * ex + ey * ey) AS nxt FROM pd),
pc AS (SELECT *, sum(segment) OVER (PARTITION BY plan ORDER BY i ROWS UNBOUNDED PRECEDING) AS distance, CASE WHEN segment > 1e-6 AND nxt > 1e-6 THEN 2 * abs(dx * ey - dy * ex) / (segment * nxt) / ((segment + nxt) / 2) ELSE 0.0 END AS curvature FROM ps),
curve AS (SELECT plan, coalesce(max(curvature) FILTER (distance <= 3.0), 0.0) AS r_curve FROM pc GROUP BY 1),
m AS (SELECT user_id || '-' || floor(t / 604800)::BIGINT AS trial, t, event_id, user_id, event_type, value, k FROM log),
span AS (SELECT trial, min(t) FILTER (event_type = 'click') AS lo, max(t) AS hi FROM m GROUP BY 1),
tick AS (SELECT trial, d * 21600 AS t FROM span, LATERAL unnest(range(ceil(lo / 21600)::BIGINT, floor(hi / 21600)::BIGINT + 1)) u(d)),
every AS (SELECT trial, t::DOUBLE AS t, 0 AS is_tick, event_id, user_id, event_type, value, k FROM m UNION ALL SELECT trial, t::DOUBLE, 1, NULL, NULL, NULL, NULL, NULL FROM tick),
seen AS (SELECT trial, t, is_tick, last_value(CASE WHEN event_type = 'click' THEN event_id % 500 END IGNORE NULLS) OVER w AS scan, last_value(CASE WHEN event_type = 'signup' THEN (event_id * 3 + user_id) % 500 END IGNORE NULLS) OVER w AS costmap,
 last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS plan, last_value(CASE WHEN event_type = 'error' THEN value / 50 - 1 END IGNORE NULLS) OVER w AS speed, last_value(CASE WHEN event_type = 'purchase' THEN value / 60 - 1 END IGNORE NULLS) OVER w AS x,
 last_value(CASE WHEN event_type = 'purchase' THEN k / 25 - 0.5 END IGNORE NULLS) OVER w AS y, last_value(k / 10 IGNORE NULLS) OVER w AS early, last_value(k / 10 + value / 100 IGNORE NULLS) OVER w AS late FROM every WINDOW w AS (PARTITION BY trial ORDER BY t, is_tick, event_id ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT *, trunc((coalesce(x, 0) + 1) / 0.5)::INT AS mx, trunc((coalesce(y, 0) + 0.5) / 0.5)::INT AS my FROM seen WHERE is_tick = 1),
dens AS (SELECT costmap, mx, my, avg(CASE WHEN cost = 254 THEN 1.0 ELSE 0.0 END) AS r_dens FROM (SELECT DISTINCT costmap, mx, my FROM placed) JOIN cells ON grid_id = costmap AND abs("row" - my) <= 4 AND abs(col - mx) <= 4 GROUP BY ALL),
f AS (SELECT trial, t, early < 5.0 AS mid, late < 8.0 AS fine, coalesce(o.r_min, 10) AS r_min, CASE WHEN abs(coalesce(speed, 0)) < 0.01 OR speed < 0 OR o.ahead IS NULL THEN 100 ELSE least(o.ahead / speed, 100) END AS r_ttc, coalesce(vis, 0) AS r_vis, coalesce(lft + rgt, 2 * lft, 2 * rgt, 10) AS r_width,
 least(n, 36) * (2 * pi() / 36) AS r_clear, coalesce(dens.r_dens, 0) AS r_dens, coalesce(r_curve, 0) AS r_curve, coalesce(g, 0) AS r_grad
 FROM placed p JOIN one o ON o.vec_id = scan JOIN runs USING (vec_id) LEFT JOIN curve USING (plan) LEFT JOIN dens USING (costmap, mx, my) LEFT JOIN grad ON grad.grid_id = p.costmap AND grad.col = p.mx AND grad."row" = p.my)
SELECT trial, t::BIGINT AS t, (3 + CASE WHEN mid THEN 3 ELSE 0 END + CASE WHEN fine THEN 2 ELSE 0 END)::INT AS computed, """ + ", ".join(f"round(coalesce(last_value(CASE WHEN {due} THEN {c} END IGNORE NULLS) OVER w, 0), 5) AS {c}" for c, due in _TIERED.items()) + """
FROM f WINDOW w AS (PARTITION BY trial ORDER BY t ROWS UNBOUNDED PRECEDING)"""

SQL["g7_tiled_costs"] = f"""WITH {LOG}, {CELLS}, one AS (SELECT (grid_id // 25 * 8 + "row")::INT AS r, (grid_id % 25 * 8 + col)::INT AS c, cost FROM cells WHERE grid_id < 500),
 big AS (SELECT 0 AS grid_id, r AS "row", c AS col, cost FROM one UNION ALL SELECT 1, c, r, cost FROM one), size AS (SELECT grid_id, max(col) + 1 AS w, max("row") + 1 AS h FROM big GROUP BY 1),
 v AS (SELECT event_id AS id, user_id % 2 AS grid_id, i, value / 6 - 21 + px * cos(k / 10) - py * sin(k / 10) AS x, k / 2.5 - 7.5 + px * sin(k / 10) + py * cos(k / 10) AS y FROM log, (VALUES (0, 0.6::DOUBLE, 0.3::DOUBLE), (1, -0.4, 0.3), (2, -0.4, -0.3), (3, 0.2, -0.3), (4, 0.5, -0.9)) p(i, px, py)),
 m AS (SELECT id, grid_id, i, trunc((x + 20.5) / 0.25)::INT AS mx, trunc((y + 7.25) / 0.25)::INT AS my, min(CASE WHEN x >= -20.5 AND y >= -7.25 AND trunc((x + 20.5) / 0.25) < w AND trunc((y + 7.25) / 0.25) < h THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS inside FROM v JOIN size USING (grid_id)),
 e AS (SELECT a.id, a.grid_id, a.i, a.mx AS x0, a.my AS y0, (b.mx - a.mx)::DOUBLE AS dx, (b.my - a.my)::DOUBLE AS dy FROM m a JOIN m b ON a.id = b.id AND b.i = (a.i + 1) % 5 WHERE a.inside = 1), w AS (SELECT *, sqrt(dx * dx + dy * dy) AS size FROM e),
 s AS (SELECT id, grid_id, i, CASE WHEN size = 0 THEN x0 ELSE trunc(x0 + t * 0.1::DOUBLE * (dx / size))::INT END AS col, CASE WHEN size = 0 THEN y0 ELSE trunc(y0 + t * 0.1::DOUBLE * (dy / size))::INT END AS "row" FROM w, LATERAL unnest(range(floor(size / 0.1::DOUBLE)::INT + 1)) u(t)),
 l AS (SELECT s.id, i, CASE WHEN bool_or(c.cost = 254) THEN 254 ELSE max(c.cost) END AS cost FROM s JOIN big c USING (grid_id, "row", col) GROUP BY ALL),
 r AS (SELECT id, max(cost) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS so_far FROM l), f AS (SELECT id, CASE WHEN bool_or(so_far = 254) THEN 254 ELSE max(so_far) END AS cost FROM r GROUP BY 1)
 SELECT event_id AS id, coalesce(f.cost, 254)::INT AS cost FROM log LEFT JOIN f ON f.id = event_id"""

_DRAW = "cast('0x' || substr(md5(seed || '|' || dim || '|{}|' || {}), 1, 8) AS BIGINT)"
_ROUNDS = "(SELECT *, (l + {}) % a AS l1 FROM (SELECT *, y % a AS l, y // a AS r FROM walk WHERE step = 0 OR y >= n))".format(_DRAW.format(0, "r"))
for _k, _new, _own, _other, _size in ((1, "r1", "r", "l1", "b"), (2, "l2", "l1", "r1", "a"), (3, "r2", "r1", "l2", "b")):
    _ROUNDS = f"(SELECT *, ({_own} + {_DRAW.format(_k, _other)}) % {_size} AS {_new} FROM {_ROUNDS})"
SQL["r3_latin_hypercube"] = f"""WITH RECURSIVE d AS (SELECT *, ceil(n / a)::BIGINT AS b FROM (SELECT r_regionkey AS design, (r_regionkey * 137 + 500)::BIGINT AS n, r_regionkey + 5 AS seed, ceil(sqrt(r_regionkey * 137 + 500))::BIGINT AS a FROM region)),
 walk AS (SELECT design, n, seed, a, b, dim, id, 0 AS step, id AS y FROM d, LATERAL unnest(range(n)) t(id), (VALUES ('vx'), ('steps'), ('arm')) v(dim) UNION ALL SELECT design, n, seed, a, b, dim, id, step + 1, l2 + a * r2 FROM {_ROUNDS}),
 f AS (SELECT *, {U % "seed || '|u|' || dim || '|' || id"} AS u FROM walk WHERE step > 0 AND y < n)
 SELECT design, id, round(max(CASE WHEN dim = 'vx' THEN 0.2 + (y + u) / n * 0.6 END), 9) AS vx, max(CASE WHEN dim = 'steps' THEN 30 + least(floor((y + u) / n * 61), 60) END)::DOUBLE AS steps, max(CASE WHEN dim = 'arm' THEN ['tucked', 'carry'][1 + y % 2] END) AS arm FROM f GROUP BY ALL"""

_NATIONS = f"""s AS (SELECT * FROM (VALUES {_SHAPES}) t(name, i, x, y)), v AS (SELECT n_nationkey AS name, i, x * (1 + n_nationkey / 50) AS x, y FROM nation JOIN s ON s.name = ['carry', 'extended', 'tucked'][1 + n_nationkey % 3])"""
_ROBOTS = _NATIONS + SURFACES[SURFACES.index(",\nedge AS") :]
SQL["g12_surfaces"] = f"WITH {_ROBOTS} SELECT name AS n_nationkey, k::INT AS k, round(far, 6) AS surface FROM surface"
_NEAR = "greatest(0, least(1, (({0} - ax) * dx + ({1} - ay) * dy) / (dx * dx + dy * dy)))"
SQL["g9_g10_polygons"] = f"""WITH {_ROBOTS}, spot AS (SELECT e.*, cx, cy, {_NEAR.format("cx", "cy")} AS f, {_NEAR.format("0", "0")} AS g FROM edge e JOIN mid USING (name))
 SELECT name AS n_nationkey, round(abs(sum(ax * yb - bx * ay)) / 2, 6) AS area, round(any_value(cx), 6) + 0.0 AS cx, round(any_value(cy), 6) + 0.0 AS cy, round(min(sqrt((ax + f * dx - cx) * (ax + f * dx - cx) + (ay + f * dy - cy) * (ay + f * dy - cy))), 6) AS inscribed,
 round(max(sqrt((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy))), 6) AS circumscribed, round(min(sqrt((ax + g * dx) * (ax + g * dx) + (ay + g * dy) * (ay + g * dy))), 6) AS inscribed_origin, round(max(sqrt(ax * ax + ay * ay)), 6) AS circumscribed_origin FROM spot GROUP BY name"""
SQL["g15_g17_constructors"] = """WITH n AS (SELECT n_nationkey, n_nationkey / 40 AS bx, greatest(1, floor(sqrt(n_nationkey / 40 * (n_nationkey / 40) + 0.4::DOUBLE * 0.4::DOUBLE) / 0.04::DOUBLE))::INT AS m FROM nation)
 SELECT n_nationkey, 'circle' AS name, k::INT AS i, round((0.2 + n_nationkey / 100) * cos(k * (2 * pi() / 8)), 6) + 0.0 AS x, round((0.2 + n_nationkey / 100) * sin(k * (2 * pi() / 8)), 6) + 0.0 AS y FROM nation, range(8) t(k)
 UNION ALL SELECT n_nationkey, 'line', k::INT, round(bx * k / m, 6) + 0.0, round(0.4 * k / m, 6) + 0.0 FROM n, LATERAL unnest(range(m + 1)) u(k)
 UNION ALL SELECT n_nationkey, 'rectangle', i::INT, round(0.1 + p * (0.5 + n_nationkey / 50) / 2, 6) + 0.0, round(q * 0.25, 6) + 0.0::DOUBLE FROM nation, (VALUES (0, 1, 1), (1, -1, 1), (2, -1, -1), (3, 1, -1)) t(i, p, q)"""
SQL["g17_drop_collinear"] = """WITH v AS (SELECT n_nationkey, i, sx * (0.5 + n_nationkey / 100) AS x, y - CASE WHEN i = 4 THEN n_nationkey / 10000 ELSE 0 END AS y FROM nation, (VALUES (0, 1, 0.5::DOUBLE), (1, 0, 0.5), (2, -1, 0.5), (3, -1, -0.5), (4, 0, -0.5), (5, 1, -0.5)) t(i, sx, y)),
 k AS (SELECT b.* FROM v b JOIN v a ON a.n_nationkey = b.n_nationkey AND a.i = (b.i + 5) % 6 JOIN v c ON c.n_nationkey = b.n_nationkey AND c.i = (b.i + 1) % 6 WHERE abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) > 1e-3)
 SELECT n_nationkey, (row_number() OVER (PARTITION BY n_nationkey ORDER BY i) - 1)::INT AS i, round(x, 6) AS x, round(y, 6) AS y FROM k"""

SQL["o3_goal_error"] = f"""WITH {LOG}, s AS (SELECT user_id, arg_max(value, (ts, event_id)) AS x, arg_max(k, (ts, event_id)) AS y FROM log WHERE event_type = 'signup' AND user_id % 3 > 0 GROUP BY 1), live AS (SELECT user_id, min(value) AS x, max(k) AS y FROM log GROUP BY 1),
 g AS (SELECT user_id, arg_min(value, (ts, event_id)) AS x, arg_min(k, (ts, event_id)) AS y FROM log WHERE event_type = 'purchase' GROUP BY 1), e AS (SELECT user_id, coalesce(s.x, live.x) AS x, coalesce(s.y, live.y) AS y, CASE WHEN s.x IS NULL THEN 0.5::DOUBLE ELSE s.x / 30 END AS yaw FROM live LEFT JOIN s USING (user_id))
 SELECT user_id, round(sqrt((g.x - e.x) * (g.x - e.x) + (g.y - e.y) * (g.y - e.y)), 6) AS xy_error, round(atan2(sin(g.x / 30 - yaw), cos(g.x / 30 - yaw)), 6) AS yaw_error FROM e JOIN g USING (user_id)"""
