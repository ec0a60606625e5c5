"""Queries over as-of baselines, attribution, state space, projection and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield import views as v
from tallyfield.functions import normal
from tallyfield.operators import asof, attribution, evaluation, ingest, projection, statespace
from tallyfield.operators.asof import AsOf
from tallyfield.registry import query
from tallyfield.views import with_

AT = AsOf(2023, 7)
MAY = "(season < 2023 OR (season = 2023 AND week <= 6))"
R = lambda c, name=None: F.round(c, 8).alias(name or c)


def states(spark, d):
    return v.states(spark, d)


def valued(spark, d):
    s = states(spark, d)
    return attribution.play_values(s, attribution.cell_values(s))


def gram_of_states(spark, d, by=None):
    """Gram blocks of the whole log, each play valued by the means of the cells."""
    return attribution.state_gram(states(spark, d), v.players(spark, d), by)[0]


def system(spark, d):
    """Gram sums of the whole log with the market rows of the teams."""
    s = states(spark, d)
    values, strength = attribution.cell_and_team_values(s)
    g = attribution.play_gram(attribution.play_values(s, values), v.players(spark, d), [])
    return g.unionByName(attribution.market_rows(strength.withColumn("strength", F.col("strength") / 10)))


# --- baselines ---------------------------------------------------------------------------


@query(with_("history", "SELECT player_id, round(max_by(points, week), 8) AS forecast FROM history WHERE season = 2023 AND week < 7 GROUP BY player_id"))
def j17_persistence(spark, d):
    return asof.persistence(v.history(spark, d), AT).select("player_id", R("forecast"))


@query(with_("history", """SELECT player_id, round(m, 8) AS forecast, round(CASE WHEN s > 0 THEN s ELSE p END, 8) AS sd FROM
(SELECT player_id, avg(points) AS m, stddev_samp(points) AS s FROM history WHERE season = 2023 AND week < 7 GROUP BY player_id),
(SELECT stddev_samp(m) AS p FROM (SELECT avg(points) AS m FROM history WHERE season = 2023 AND week < 7 GROUP BY player_id))"""))
def a11_season_to_date(spark, d):
    return asof.season_to_date(v.history(spark, d), AT).select("player_id", R("forecast"), R("sd"))


@query(with_("history", "SELECT player_id, round(avg(points), 8) AS forecast FROM history WHERE season = 2022 GROUP BY player_id"))
def a12_last_season(spark, d):
    return asof.last_season(v.history(spark, d), AT).select("player_id", R("forecast"))


@query(with_("history", "SELECT player_id, round(avg(points), 8) AS realised FROM history WHERE season = 2023 AND week >= 7 GROUP BY player_id"))
def a13_rest_of_season(spark, d):
    return v.history(spark, d).where("season = 2023 and week >= 7").groupBy("player_id").agg(R(F.avg("points"), "realised"))


@query(with_("history", "SELECT player_id, season, week, round(avg(points) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 8) AS rolling FROM history"))
def w11_rolling_average(spark, d):
    return asof.rolling_mean(v.history(spark, d)).select("player_id", "season", "week", R("rolling"))


@query(with_("history", f"""SELECT player_id, round(sum(w * points) / sum(w), 8) AS forecast FROM (
SELECT *, pow(0.9::DOUBLE, (2023 - season) * 18 + 7 - week) AS w FROM history WHERE {MAY}) GROUP BY player_id"""))
def w12_recency_mean(spark, d):
    return asof.recency_mean(v.history(spark, d), AT).select("player_id", R("forecast"))


@query(with_("history", """SELECT p.player_id, s.season, s.week, round(h.points, 8) AS points, h.points IS NOT NULL AS played
FROM (SELECT DISTINCT player_id FROM history) p CROSS JOIN (SELECT DISTINCT season, week FROM history) s LEFT JOIN history h USING (player_id, season, week)"""))
def j18_timeline(spark, d):
    return asof.densify(v.history(spark, d)).select("player_id", "season", "week", R("points"), "played")


@query(with_("history", "SELECT position, round(median(points), 8) AS median FROM history WHERE season = 2022 GROUP BY position"))
def q6_position_median(spark, d):
    return v.history(spark, d).where("season = 2022").groupBy("position").agg(R(F.expr("percentile(points, 0.5)"), "median"))


@query(with_("history", """SELECT DISTINCT player_id FROM (
SELECT player_id, rank() OVER (ORDER BY last_p DESC) AS a, rank() OVER (ORDER BY mean_p DESC) AS b FROM (SELECT player_id, max_by(points, week) AS last_p, round(avg(points), 8) AS mean_p FROM history WHERE season = 2023 AND week < 7 GROUP BY player_id)) WHERE a <= 20 OR b <= 20"""))
def t5_union_pool(spark, d):
    """Everyone in the top 20 of any source, ties included."""
    h = v.history(spark, d)
    top = lambda f: evaluation.top_with_ties(f.withColumn("forecast", F.round("forecast", 8)), "forecast", 20).select("player_id")
    at = AsOf(2023, 7)
    return top(asof.persistence(h, at)).union(top(asof.season_to_date(h, at).select("player_id", "forecast"))).distinct()


# --- attribution -------------------------------------------------------------------------

BUCKET = lambda p: f"CAST({p}down * 10000 + least(floor({p}ydstogo / 5.0), 9) * 100 + floor({p}yardline_100 / 10.0) AS BIGINT)"
CELLS = f"cells AS (SELECT {BUCKET('')} AS bucket, avg(drive_points) AS value, count(*) AS n FROM states GROUP BY 1)"
DV = f"""vals AS (SELECT s.*, a.value AS v0, CASE WHEN terminal THEN terminal_value ELSE coalesce(b.value, a.value) END AS v1 FROM states s
  LEFT JOIN cells a ON a.bucket = {BUCKET('')} LEFT JOIN cells b ON b.bucket = {BUCKET('n_')}),
dv AS (SELECT *, v1 - v0 AS dv FROM vals)"""
TRIPLETS = """tri AS (SELECT drive_id, play_id, season, week, col, sum(val) AS val FROM (
  SELECT drive_id, play_id, season, week, 'p:' || unnest(off_players) AS col, 1.0::DOUBLE AS val FROM plays
  UNION ALL SELECT drive_id, play_id, season, week, 'p:' || unnest(def_players), -1.0 FROM plays
  UNION ALL SELECT drive_id, play_id, season, week, 'o:' || off_team, 1.0 FROM plays
  UNION ALL SELECT drive_id, play_id, season, week, 'd:' || def_team, -1.0 FROM plays) GROUP BY ALL)"""
GRAM = """gram AS (SELECT a.season, a.week, a.col AS i, b.col AS j, sum(a.val * b.val) AS v FROM tri a JOIN tri b USING (drive_id, play_id) WHERE a.col <= b.col GROUP BY ALL
  UNION ALL SELECT t.season, t.week, t.col, NULL, sum(t.val * d.dv) FROM tri t JOIN dv d USING (drive_id, play_id) GROUP BY ALL)"""


@query(with_("states", "SELECT bucket, round(value, 8) AS value, n FROM cells", CELLS))
def m1_cell_values(spark, d):
    return attribution.cell_values(states(spark, d)).select("bucket", R("value"), "n")


@query()
def m1_boosted_values(spark, d):
    """Boosted value surface: mean prediction by down."""
    s = states(spark, d)
    model = attribution.fit_boosted_value(s, rounds=300)
    return model.transform(s).groupBy("down").agg(F.avg("prediction").alias("value"), F.count("*").alias("n"))


@query(with_("states", "SELECT drive_id, play_id, round(dv, 8) AS dv FROM dv", CELLS, DV))
def m2_play_values(spark, d):
    return valued(spark, d).select("drive_id", "play_id", R("dv"))


@query(with_("plays", "SELECT drive_id, play_id, col, val FROM tri", TRIPLETS))
def m3_design(spark, d):
    return attribution.design(v.plays(spark, d), v.players(spark, d)).select("drive_id", "play_id", "col", "val")


@query(with_("plays players", """SELECT a.player_id AS a, b.player_id AS b, count(*) AS n FROM
(SELECT DISTINCT drive_id, play_id, player_id FROM (SELECT drive_id, play_id, unnest(off_players) AS player_id FROM plays) JOIN players USING (player_id) WHERE position = 'WR') a JOIN
(SELECT DISTINCT drive_id, play_id, player_id FROM (SELECT drive_id, play_id, unnest(def_players) AS player_id FROM plays) JOIN players USING (player_id) WHERE position = 'DEF') b USING (drive_id, play_id)
GROUP BY ALL HAVING count(*) >= 5"""))
def m4_pair_support(spark, d):
    return attribution.pair_support(v.plays(spark, d), v.players(spark, d), least=5)


@query(with_("states", "SELECT i, j, round(sum(v), 7) AS v FROM gram GROUP BY i, j", CELLS, DV, TRIPLETS, GRAM))
def j14_gram(spark, d):
    g = gram_of_states(spark, d, [])
    return g.select("i", "j", F.round("v", 7).alias("v"))


@query(with_("states", "SELECT season, week, count(*) AS n, round(sum(v), 6) AS total FROM gram GROUP BY ALL", CELLS, DV, TRIPLETS, GRAM))
def m9_weekly_blocks(spark, d):
    g = gram_of_states(spark, d)
    return g.groupBy("season", "week").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(with_("states", """SELECT season, week, i, j, round(v, 7) AS v FROM (SELECT season, week, i, j, sum(v) OVER (PARTITION BY i, j ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM gram WHERE i LIKE 'o:%') WHERE v IS NOT NULL""", CELLS, DV, TRIPLETS, GRAM))
def e12_cumulative_blocks(spark, d):
    g = gram_of_states(spark, d).where(F.col("i").startswith("o:"))
    return evaluation.cumulative_blocks(g).select("season", "week", "i", "j", F.round("v", 7).alias("v"))


@query()
def e12_all_cumulative_blocks(spark, d):
    """Sums before each slot over all (i, j): players, both sides' teams and X'y."""
    g = gram_of_states(spark, d)
    return evaluation.cumulative_blocks(g).select("season", "week", "i", "j", F.round("v", 7).alias("v"))


@query(with_("plays", """SELECT i, j, round(v, 8) AS v FROM (SELECT off_team AS team, avg(drive_points) AS s FROM plays GROUP BY 1),
  LATERAL (VALUES ('o:' || team, 'o:' || team, 40.0::DOUBLE), ('d:' || team, 'd:' || team, 40.0), ('d:' || team, 'o:' || team, 40.0), ('o:' || team, NULL, 40 * s), ('d:' || team, NULL, 40 * s)) e(i, j, v)"""))
def m8_market_rows(spark, d):
    s = v.plays(spark, d).groupBy(F.col("off_team").alias("team")).agg(F.avg("drive_points").alias("strength"))
    return attribution.market_rows(s).select("i", "j", R("v"))


@query()
def m6_ratings(spark, d):
    """Ridge ratings of players and teams from the whole log, anchored by the market rows."""
    both = system(spark, d)
    position = {f"p:{r.player_id}": 2.0 if r.position == "DEF" else 1.0 for r in v.players(spark, d).collect()}
    return spark.createDataFrame(sorted(attribution.solve_ridge(both, scale=position).items()), "col string, rating double")


@query()
def m7_situation_ratings(spark, d):
    """One system a situation, those under 200 plays left out."""
    s = ingest.situations(valued(spark, d))
    big = ingest.situations(v.plays(spark, d)).groupBy("situation").count().where("count >= 200").select("situation")
    s = s.join(F.broadcast(big), "situation")  # at most as many rows as situations
    sums: dict[str, dict] = {}
    for r in attribution.play_gram(s, v.players(spark, d), ["situation"]).collect():  # sums, not plays
        sums.setdefault(r.situation, {})[r.i, r.j] = r.v
    out = [(name, k, b) for name in sorted(sums) for k, b in sorted(attribution.solve_system(sums[name]).items())]
    return spark.createDataFrame(out, "situation string, col string, rating double")


@query(with_("plays players", """SELECT drive_id, play_id, round(sum(CASE WHEN side = 'o' THEN r ELSE 0 END), 8) AS off_sum, round(sum(CASE WHEN side = 'd' THEN r ELSE 0 END), 8) AS def_sum FROM (
 SELECT drive_id, play_id, side, coalesce(CAST(substr(player_id, 2) AS BIGINT) % 7 / 10.0::DOUBLE, 0) AS r FROM (
  SELECT drive_id, play_id, 'o' AS side, unnest(off_players) AS player_id FROM plays UNION ALL SELECT drive_id, play_id, 'd', unnest(def_players) FROM plays)) GROUP BY ALL"""))
def j15_onfield_sums(spark, d):
    r = v.players(spark, d).withColumn("rating", F.substring("player_id", 2, 9).cast("long") % 7 / 10)
    o = attribution.onfield_sums(v.plays(spark, d), r)
    return o.select("drive_id", "play_id", R("off_sum"), R("def_sum"))


_RESID = f"""fold AS (SELECT *, {BUCKET('')} AS cell, CAST('0x' || substr(md5(season || '|' || week), 1, 8) AS BIGINT) % 5 AS fold FROM dv),
part AS (SELECT cell, fold, sum(dv) AS s, count(dv) AS n FROM fold GROUP BY ALL),
rest AS (SELECT p.cell, p.fold, CASE WHEN c.n > p.n THEN (c.s - p.s) / (c.n - p.n) ELSE 0 END AS g FROM part p JOIN (SELECT cell, sum(s) AS s, sum(n) AS n FROM part GROUP BY cell) c USING (cell)),
resid AS (SELECT f.*, dv - g AS resid FROM fold f JOIN rest USING (cell, fold))"""


@query(with_("states", "SELECT drive_id, play_id, CAST(fold AS INTEGER) AS fold, round(resid, 8) AS resid FROM resid", CELLS, DV, _RESID))
def m10_context_residual(spark, d):
    return attribution.context_residual(valued(spark, d)).select("drive_id", "play_id", "fold", R("resid"))


@query(with_("states", """SELECT player_id, season, week, round(avg(resid), 8) AS credit, count(*) AS snaps FROM (SELECT season, week, resid, unnest(list_distinct(off_players)) AS player_id FROM resid)
WHERE player_id IN (SELECT p FROM (SELECT unnest(list_distinct(off_players)) AS p FROM resid) GROUP BY p HAVING count(*) >= 20) GROUP BY ALL""", CELLS, DV, _RESID))
def a7_weekly_credit(spark, d):
    return attribution.weekly_credit(attribution.context_residual(valued(spark, d))).select("player_id", "season", "week", R("credit"), "snaps")


@query(with_("plays", """SELECT season, role, player_id, count(*) AS n, round(avg(yards), 8) AS credit FROM (
 SELECT season, yards, 'carry' AS role, off_players[1] AS player_id FROM plays WHERE play_type = 'run' UNION ALL SELECT season, yards, 'dropback', off_players[1] FROM plays WHERE play_type = 'pass'
 UNION ALL SELECT season, yards, 'target', off_players[2] FROM plays WHERE play_type = 'pass') GROUP BY ALL"""))
def q1_role_credit(spark, d):
    """Credit by role without participation: who dropped back, carried or was thrown to."""
    p = v.plays(spark, d)
    role = lambda r, i: F.struct(F.lit(r).alias("role"), F.get("off_players", F.lit(i)).alias("player_id"))
    roles = F.when(F.col("play_type") == "run", F.array(role("carry", 0))).otherwise(F.array(role("dropback", 0), role("target", 1)))
    return p.select("season", "yards", F.explode(roles).alias("r")).groupBy("season", "r.role", "r.player_id").agg(F.count("*").alias("n"), R(F.avg("yards"), "credit"))


# --- state space -------------------------------------------------------------------------


def series(spark, d):
    """Weekly observations: points over 20, snaps from targets, an event in week 5 of 2023."""
    h = asof.densify(v.history(spark, d))


    s = v.player_stats(spark, d).select("player_id", "season", "week", (F.col("targets") + F.col("pass_attempts")).alias("snaps"))
    j = h.join(s, ["player_id", "season", "week"], "left")
    position = F.expr("element_at(array('QB', 'RB', 'WR', 'TE'), cast(cast(substring(player_id, 2) as bigint) % 4 as int) + 1)")
    return j.select("player_id", position.alias("position"), "season", "week", (F.col("points") / 20).alias("y"), F.coalesce("snaps", F.lit(0)).alias("snaps"), "played", ((F.col("season") == 2023) & (F.col("week") == 5)).alias("event"))


_FILTER = """obs AS (SELECT p.player_id, CAST(substr(p.player_id, 2) AS BIGINT) % 4 AS pos, s.season, s.week, h.points / 20 AS y, greatest(coalesce(ps.targets + ps.pass_attempts, 0), 1)::DOUBLE AS snaps,
   s.season = 2023 AND s.week = 5 AS ev, row_number() OVER (PARTITION BY p.player_id ORDER BY s.season, s.week) AS k
  FROM (SELECT DISTINCT player_id FROM history) p CROSS JOIN (SELECT DISTINCT season, week FROM history) s
  LEFT JOIN history h USING (player_id, season, week) LEFT JOIN player_stats ps USING (player_id, season, week)),
par AS (SELECT o.*, [0.95, 0.85, 0.9, 0.9][CAST(pos + 1 AS INTEGER)]::DOUBLE AS dst, [0.55, 0.45, 0.4, 0.4][CAST(pos + 1 AS INTEGER)]::DOUBLE AS rs FROM obs o),
st AS (SELECT player_id, coalesce(avg(y) FILTER (k <= 3), 0)::DOUBLE AS x0 FROM par GROUP BY player_id),
run AS (
  SELECT player_id, 0::BIGINT AS k, x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.05::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, 0.02::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.01::DOUBLE AS p22, 99 AS games, 0.0::DOUBLE AS pred, 0.0::DOUBLE AS var FROM st
  UNION ALL
  SELECT player_id, k, CASE WHEN seen THEN m0 + h0 / s * e ELSE m0 END, CASE WHEN seen THEN m1 + h1 / s * e ELSE m1 END, CASE WHEN seen THEN m2 + h2 / s * e ELSE m2 END,
    CASE WHEN seen THEN c00 - h0 * h0 / s ELSE c00 END, CASE WHEN seen THEN c01 - h0 * h1 / s ELSE c01 END, CASE WHEN seen THEN c02 - h0 * h2 / s ELSE c02 END,
    CASE WHEN seen THEN c11 - h1 * h1 / s ELSE c11 END, CASE WHEN seen THEN c12 - h1 * h2 / s ELSE c12 END, CASE WHEN seen THEN c22 - h2 * h2 / s ELSE c22 END,
    CASE WHEN seen THEN g + 1 ELSE g END, m0 + m1 + m2, s
  FROM (SELECT *, h0 + h1 + h2 + (CASE WHEN g < 2 THEN 2.0::DOUBLE ELSE 1.0 END) * rs / snaps AS s, y - (m0 + m1 + m2) AS e, y IS NOT NULL AS seen
   FROM (SELECT *, c00 + c01 + c02 AS h0, c01 + c11 + c12 AS h1, c02 + c12 + c22 AS h2
    FROM (SELECT r.player_id, o.k, o.y, o.snaps, o.rs, r.x0 AS m0, r.x1 * 0.5::DOUBLE AS m1, r.x2 * 0.985::DOUBLE AS m2, CASE WHEN o.ev THEN 0 ELSE r.games END AS g,
      r.p00 / (CASE WHEN o.ev THEN 0.7::DOUBLE ELSE o.dst END) AS c00, r.p01 * 0.5::DOUBLE AS c01, r.p02 * 0.985::DOUBLE AS c02,
      r.p11 * 0.25::DOUBLE + 0.0008::DOUBLE + (CASE WHEN o.ev THEN 0.004::DOUBLE ELSE 0 END) AS c11, r.p12 * 0.5::DOUBLE * 0.985::DOUBLE AS c12,
      r.p22 * 0.985::DOUBLE * 0.985::DOUBLE + 0.0002::DOUBLE + (CASE WHEN o.ev THEN 0.04::DOUBLE ELSE 0 END) AS c22
     FROM run r JOIN par o ON o.player_id = r.player_id AND o.k = r.k + 1))))"""


@query("WITH RECURSIVE " + with_("history", "SELECT r.player_id, o.season, o.week, round(x0, 5) AS talent, round(x0 + x1 + x2, 5) AS total, round(pred, 5) AS pred, round(var, 5) AS var FROM run r JOIN par o USING (player_id, k)", _FILTER)[5:])
def m12_filter(spark, d):
    f = statespace.filtered(series(spark, d))
    r5 = lambda c, n: F.round(c, 5).alias(n)
    return f.select("player_id", "season", "week", r5("x0", "talent"), r5(F.col("x0") + F.col("x1") + F.col("x2"), "total"), r5("pred", "pred"), r5("var", "var"))


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_F3 = ["1.0::DOUBLE", "0.5::DOUBLE", "0.985::DOUBLE"]


def back_sql(name: str, first: str, keys: str = "", stop: str = "b.k > 1") -> str:
    """The backward pass as a recursive CTE: smoothed state (s, q) of week k from that of
    week k + 1, with matrices written out; ``first`` gives the last weeks to start from."""
    y = lambda n, i, j: f"{n}{min(i, j)}{max(i, j)}"
    add = " + ".join
    extra = {(0, 0): "", (1, 1): " + 0.0008::DOUBLE + (CASE WHEN o.ev THEN 0.004::DOUBLE ELSE 0 END)", (2, 2): " + 0.0002::DOUBLE + (CASE WHEN o.ev THEN 0.04::DOUBLE ELSE 0 END)"}
    aged = {(i, j): f"r.p{i}{j} * {_F3[i]} * {_F3[j]}" + extra.get((i, j), "") for i, j in _PAIRS}
    aged[0, 0] = "r.p00 / (CASE WHEN o.ev THEN 0.7::DOUBLE ELSE o.dst END)"
    n = ", ".join(f"{e}{' + 1e-10::DOUBLE' if i == j else ''} AS n{i}{j}" for (i, j), e in aged.items())
    d = ", ".join(f"b.s{i} - r.x{i} * {_F3[i]} AS d{i}" for i in range(3))
    keep = ", ".join([*(f"r.x{i}" for i in range(3)), *(f"r.p{i}{j}" for i, j in _PAIRS), *(f"b.q{i}{j}" for i, j in _PAIRS)])
    up, down = lambda i: (i + 1) % 3, lambda i: (i + 2) % 3
    cof = ", ".join(f"{y('n', up(i), up(j))} * {y('n', down(i), down(j))} - {y('n', up(i), down(j))} * {y('n', down(i), up(j))} AS k{i}{j}" for i, j in _PAIRS)
    every = [(i, j) for i in range(3) for j in range(3)]
    gain = ", ".join("(" + add(f"{y('p', i, m)} * {_F3[m]} * {y('k', m, j)}" for m in range(3)) + f") / (n00 * k00 + n01 * k01 + n02 * k02) AS g{i}{j}" for i, j in every)
    moved = ", ".join(add(f"g{i}{m} * ({y('q', m, j)} - {y('n', m, j)})" for m in range(3)) + f" AS t{i}{j}" for i, j in every)
    out = ", ".join([*(f"x{i} + " + add(f"g{i}{m} * d{m}" for m in range(3)) for i in range(3)), *(f"p{i}{j} + " + add(f"t{i}{m} * g{j}{m}" for m in range(3)) for i, j in _PAIRS)])
    names = ", ".join([*(f"x{i} AS s{i}" for i in range(3)), *(f"p{i}{j} AS q{i}{j}" for i, j in _PAIRS)])
    return f"""{name} AS (SELECT {names}, * EXCLUDE ({', '.join([*(f'x{i}' for i in range(3)), *(f'p{i}{j}' for i, j in _PAIRS)])}) FROM ({first}) UNION ALL
 SELECT {out}, player_id, k{keys} FROM (SELECT *, {moved} FROM (SELECT *, {gain} FROM (SELECT *, {cof} FROM (
  SELECT r.player_id, r.k{keys}, {n}, {d}, {keep} FROM {name} b JOIN run r ON r.player_id = b.player_id AND r.k = b.k - 1 JOIN par o ON o.player_id = b.player_id AND o.k = b.k WHERE {stop})))))"""


_STATES9 = ", ".join([*(f"x{i}" for i in range(3)), *(f"p{i}{j}" for i, j in _PAIRS)])
_SMOOTH = "round(s0, 6) AS talent, round(s0 + s1 + s2, 6) AS total, round(q00, 8) AS var_talent"


def _rounded(df):
    return df.select("player_id", "season", "week", F.round("talent", 6).alias("talent"), F.round("total", 6).alias("total"), F.round("var_talent", 8).alias("var_talent"))


@query("WITH RECURSIVE " + with_("history", f"SELECT b.player_id, o.season, o.week, {_SMOOTH} FROM back b JOIN par o USING (player_id, k)", _FILTER,
       back_sql("back", f"SELECT {_STATES9}, player_id, k FROM run WHERE k > 0 QUALIFY k = max(k) OVER (PARTITION BY player_id)"))[5:])
def m12_smoother(spark, d):
    return _rounded(statespace.smoothed(series(spark, d)))


def last_state(spark, d):
    f = statespace.filtered(series(spark, d).where(AT.outcome))
    last = F.max_by(F.struct("position", *statespace.STATE), F.struct("season", "week"))
    return f.groupBy("player_id").agg(last.alias("s")).select("player_id", "s.*")


@query()
def m13_step(spark, d):
    """The week after the filtered past, as one step."""
    obs = series(spark, d).where("season = 2023 and week = 7").select("player_id", "y", "snaps", F.lit(False).alias("event"), (F.col("position") == "QB").alias("reset"))
    return statespace.step(last_state(spark, d), obs)


@query()
def m14_changepoints(spark, d):
    obs = series(spark, d).where("season = 2023 and week = 7").select("player_id", "y", "snaps")
    return statespace.changepoints(last_state(spark, d), obs, threshold=1.5)


# --- projection --------------------------------------------------------------------------


def usage(spark, d):
    """Active weeks and usage before the origin: the season to date and the two before."""
    known = v.player_stats(spark, d).where(AT.outcome & (F.col("season") >= AT.season - 2))
    return known.groupBy("player_id", "position").agg(F.count_distinct("season", "week").alias("games"), *(F.sum(c).alias(c) for c in projection.VOLUME))


FEEDER = """feeder AS (SELECT player_id, position, CAST(substr(player_id, 2) AS BIGINT) % 5 = 0 AS is_rookie, sum(targets) / 100.0::DOUBLE AS feeder_sv, CAST(20 + CAST(substr(player_id, 2) AS BIGINT) % 15 AS INTEGER) AS age, CAST(CAST(substr(player_id, 2) AS BIGINT) % 8 AS INTEGER) AS draft FROM player_stats WHERE season = 2022 GROUP BY ALL),
rat AS (SELECT player_id, avg(points) AS rating FROM history WHERE season = 2023 GROUP BY player_id)"""


def feeder(spark, d):
    n = F.substring("player_id", 2, 9).cast("long")
    f = v.player_stats(spark, d).where("season = 2022").groupBy("player_id", "position").agg((F.sum("targets") / 100).alias("feeder_sv"))
    return f.select("player_id", "position", (n % 5 == 0).alias("is_rookie"), "feeder_sv", (20 + n % 15).cast("int").alias("age"), (n % 8).cast("int").alias("draft"))


def ratings(spark, d):
    return v.history(spark, d).where("season = 2023").groupBy("player_id").agg(F.avg("points").alias("rating"))


_EQ = """sh AS (SELECT f.*, rating, CAST('0x' || substr(md5(player_id), 1, 4) AS BIGINT) % 10 >= 7 AS out FROM feeder f JOIN rat USING (player_id) WHERE NOT is_rookie),
eq AS (SELECT regr_slope(rating, feeder_sv) AS slope, regr_intercept(rating, feeder_sv) AS intercept, count(*) AS n_shared FROM sh),
tr AS (SELECT regr_slope(rating, feeder_sv) AS s, regr_intercept(rating, feeder_sv) AS i FROM sh WHERE NOT out),
r2 AS (SELECT 1 - sum(pow(rating - i - s * feeder_sv, 2)) / sum(pow(rating - m, 2)) AS oos_r2 FROM sh, tr, (SELECT avg(rating) AS m FROM sh WHERE out) WHERE out)"""


@query(with_("history", "SELECT round(slope, 8) AS slope, round(intercept, 8) AS intercept, round(oos_r2, 8) AS oos_r2, n_shared FROM eq, r2", FEEDER, _EQ))
def m16_equivalency(spark, d):
    return projection.equivalency(feeder(spark, d), ratings(spark, d)).select(R("slope"), R("intercept"), R("oos_r2"), "n_shared")


@query(with_("history", """SELECT player_id, position, round(0.5::DOUBLE + 0.25::DOUBLE * feeder_sv + CASE WHEN age < 24 THEN 0.05 WHEN age > 30 THEN -0.05 ELSE 0 END
+ CASE WHEN draft = 0 THEN -0.03 WHEN draft = 1 THEN 0.08 WHEN draft <= 3 THEN 0.03 ELSE 0 END, 8) AS prior_mean,
CASE position WHEN 'QB' THEN 0.16 WHEN 'RB' THEN 0.07 WHEN 'WR' THEN 0.08 ELSE 0.06 END::DOUBLE AS prior_sd FROM feeder""", FEEDER))
def m17_priors(spark, d):
    return projection.priors(feeder(spark, d), 0.25, 0.5, "age", "draft").select("player_id", "position", R("prior_mean"), "prior_sd")


@query(with_("history", """SELECT position, g AS games, round((1 / (sd * sd)) / (1 / (sd * sd) + g / r), 8) AS weight FROM (SELECT position, CASE position WHEN 'QB' THEN 0.16::DOUBLE WHEN 'RB' THEN 0.07 WHEN 'WR' THEN 0.08 ELSE 0.06 END AS sd, var_samp(points / 20) AS r
FROM history WHERE season = 2022 GROUP BY position), (VALUES (1), (2), (4), (6), (8), (12)) q(g)"""))
def m18_washout(spark, d):
    """How fast a prior gives way, with the noise of a game as the season before shows it."""
    noise = v.history(spark, d).where("season = 2022").groupBy("position").agg(F.var_samp(F.col("points") / 20).alias("obs_var"))
    return projection.washout(noise).select("position", "games", R("weight"))


_VOL = f"""agg AS (SELECT player_id, position, season, count(DISTINCT week) AS games, {', '.join(f'sum({c}) / count(DISTINCT week)::DOUBLE AS {c}' for c in projection.VOLUME)} FROM player_stats WHERE {MAY} AND season < 2023 GROUP BY ALL),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS r FROM agg) WHERE r = 1),
mn AS (SELECT position, {', '.join(f'avg({c}) AS m_{c}' for c in projection.VOLUME)} FROM lst GROUP BY position)"""


@query(with_("player_stats", "SELECT player_id, position, games, " + ", ".join(f"round(games / (games + 8.0::DOUBLE) * {c} + (1 - games / (games + 8.0::DOUBLE)) * m_{c}, 8) AS {c}" for c in projection.VOLUME) + " FROM lst JOIN mn USING (position)", _VOL))
def m19_volume(spark, d):
    return projection.volume(v.player_stats(spark, d), AT).select("player_id", "position", "games", *(R(c) for c in projection.VOLUME))


_Q4 = f"""us AS (SELECT player_id, position, count(DISTINCT (season, week))::DOUBLE AS g, {', '.join(f'sum({c})::DOUBLE AS {c}' for c in projection.VOLUME)} FROM player_stats WHERE {MAY} AND season >= 2021 GROUP BY ALL),
lg AS (SELECT player_id, position, g, driver, y FROM us UNPIVOT (y FOR driver IN ({', '.join(projection.VOLUME)}))),
pl AS (SELECT position, driver, count(*) AS n, sum(y) / sum(g) AS mean, (sum(y * y / g) - sum(y) * sum(y) / sum(g)) / sum(g) - sum(y) / sum(g) * count(*) / sum(g) AS between_ FROM lg GROUP BY ALL)"""


@query(with_("player_stats", "SELECT position, driver, n, round(mean, 8) AS mean, round(between_, 8) AS \"between\", CASE WHEN between_ > 0 THEN round(mean / between_, 6) END AS k FROM pl", _Q4))
def q4_volume_pools(spark, d):
    """Strength of the shrinkage of each position and driver, in games."""
    p = projection.volume_pools(usage(spark, d))
    return p.select("position", "driver", "n", R("mean"), R("between"), F.round("k", 6).alias("k"))


@query(with_("player_stats", "SELECT l.player_id, l.position, l.driver, round(CASE WHEN between_ > 0 THEN (y + mean / between_ * mean) / (g + mean / between_) ELSE mean END, 8) AS expected FROM lg l JOIN pl USING (position, driver)", _Q4))
def q4_expected_volume(spark, d):
    """Posterior usage a game of every player with exposure; pools without spread give their mean."""
    u = usage(spark, d)
    e = projection.expected_volume(u, projection.volume_pools(u), degenerate="mean")
    return e.unpivot(["player_id", "position"], projection.VOLUME, "driver", "expected").withColumn("expected", F.round("expected", 8))


@query(with_("history", "SELECT position, count(*) AS n, round(regr_slope(points, rating), 8) AS slope, round(regr_intercept(points, rating), 8) AS intercept FROM history JOIN rat USING (player_id) WHERE season = 2022 GROUP BY position HAVING count(*) >= 10 AND max(rating) > min(rating)", FEEDER))
def m23_points_map(spark, d):
    f = v.history(spark, d).where("season = 2022").join(ratings(spark, d), "player_id")
    return projection.points_map(f).select("position", "n", R("slope"), R("intercept"))


def rate_frame(spark, d):
    """Season sums with talent features, before the origin."""
    from tallyfield.schemas import STATS

    s = v.player_stats(spark, d).where("season = 2022").groupBy("player_id", "position").agg(*(F.sum(c).alias(c) for c in STATS))
    t = projection.talent_features(ratings(spark, d), feeder(spark, d).select("player_id", F.col("feeder_sv").alias("talent")), projection.priors(feeder(spark, d), 0.25, 0.5))
    return s.join(t, "player_id")


@query()
def m20_rate_models(spark, d):
    """Weights of the rate ridges from one aggregation of sums."""
    m = projection.fit_rates(rate_frame(spark, d))
    rows = [(p, dr, s, float(b), *map(float, w)) for (p, dr, s), (w, b) in sorted(m.items())]
    return spark.createDataFrame(rows, "position string, driver string, stat string, intercept double, w_rating double, w_talent double, w_prior double")


@query()
def m21_stat_lines(spark, d):
    f = rate_frame(spark, d)
    vol = projection.volume(v.player_stats(spark, d), AT).drop("games")
    return projection.season_line(projection.stat_line(vol, f.select("player_id", *projection.FEATURES), projection.fit_rates(f)))


# --- evaluation --------------------------------------------------------------------------

CELL = """c AS (SELECT h.player_id, h.position, h.season, h.week, h.points AS actual, f.forecast, f.sd, b.baseline FROM history h
 JOIN (SELECT player_id, avg(points) AS forecast, stddev_samp(points) AS sd FROM history WHERE season = 2022 GROUP BY 1) f USING (player_id)
 JOIN (SELECT player_id, max_by(points, week) AS baseline FROM history WHERE season = 2022 GROUP BY 1) b USING (player_id) WHERE h.season = 2023 AND f.sd > 0)"""


def cells(spark, d):
    """Forecast (last season's mean and spread), baseline (its last week) and outcome."""
    h = v.history(spark, d)
    f = h.where("season = 2022").groupBy("player_id").agg(F.avg("points").alias("forecast"), F.stddev_samp("points").alias("sd"), F.max_by("points", "week").alias("baseline"))
    return h.where("season = 2023").withColumnRenamed("points", "actual").join(f.where("sd > 0"), "player_id")


def A():  # columns can be made only once a session exists
    return F.col("actual")


def P():
    return F.col("forecast")


def S():
    return F.col("sd")


@query(with_("history", """SELECT coalesce(position, 'ALL') AS position, count(*) AS n, round(avg(abs(forecast - actual)), 8) AS mae, round(sqrt(avg(pow(forecast - actual, 2))), 8) AS rmse, round(avg(forecast - actual), 8) AS bias,
round(avg(abs(baseline - actual) - abs(forecast - actual)), 8) AS margin, round(1 - avg(abs(forecast - actual)) / avg(abs(baseline - actual)), 8) AS skill FROM c GROUP BY GROUPING SETS ((position), ())""", CELL))
def e16_skill_report(spark, d):
    r = evaluation.skill_report(cells(spark, d))
    return r.select("position", "n", *(R(c) for c in ("mae", "rmse", "bias", "margin", "skill")))


@query(with_("history", f"""SELECT position, round(avg(pow((actual - forecast) / sd, 2)), 8) AS nis, round(avg(CASE WHEN actual BETWEEN forecast - {normal.ppf(0.9)!r}::DOUBLE * sd AND forecast + {normal.ppf(0.9)!r}::DOUBLE * sd THEN 1.0::DOUBLE ELSE 0 END), 8) AS picp,
round(2 * {normal.ppf(0.9)!r}::DOUBLE * avg(sd) / (max(actual) - min(actual)), 8) AS pinaw, round(avg(greatest(0.9::DOUBLE * (actual - forecast), -0.1::DOUBLE * (actual - forecast))), 8) AS pinball FROM c GROUP BY position""", CELL))
def e5_calibration(spark, d):
    return cells(spark, d).groupBy("position").agg(R(evaluation.nis(A(), P(), S() * S()), "nis"), R(evaluation.picp(A(), P(), S()), "picp"), R(evaluation.pinaw(A(), S()), "pinaw"), R(evaluation.pinball(A(), P(), 0.9), "pinball"))


@query(with_("history", f"SELECT player_id, week, round({normal.cdf_sql('((actual - forecast) / sd)')}, 5) AS pit FROM c", CELL))
def e3_pit(spark, d):
    return cells(spark, d).select("player_id", "week", F.round(evaluation.pit(A(), P(), S()), 5).alias("pit"))


@query(with_("history", f"""SELECT position, round(avg(sd * (z * (2 * u - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 5) AS crps FROM (SELECT *, {normal.cdf_sql('z')} AS u FROM (SELECT *, (actual - forecast) / sd AS z FROM c)) GROUP BY position""", CELL))
def e4_crps(spark, d):
    return cells(spark, d).groupBy("position").agg(F.round(F.avg(evaluation.crps(A(), P(), S())), 5).alias("crps"))


@query(with_("history", f"SELECT player_id, season, week, round({normal.ppf_sql('p')}, 8) AS z FROM (SELECT *, (row_number() OVER (PARTITION BY position, season ORDER BY points, player_id, week) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY position, season) AS p FROM history)"))
def f_normal_quantile(spark, d):
    """Normal scores of points within position and season."""
    w = Window.partitionBy("position", "season")
    p = (F.row_number().over(w.orderBy("points", "player_id", "week")) - 0.5) / F.count("*").over(w)
    return v.history(spark, d).withColumn("p", p).select("player_id", "season", "week", R(normal.ppf_column(F.col("p")), "z"))


def ranked_cells(spark, d):
    """Cells whose forecasts are rounded, so that ties don't hang on the order of a sum."""
    return cells(spark, d).withColumn("forecast", F.round("forecast", 6))


_RANK = "rk AS (SELECT *, rank() OVER (PARTITION BY week ORDER BY forecast) + (count(*) OVER (PARTITION BY week, forecast) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY week ORDER BY actual) + (count(*) OVER (PARTITION BY week, actual) - 1) / 2.0 AS ra FROM (SELECT * REPLACE (round(forecast, 6) AS forecast) FROM c))"


@query(with_("history", "SELECT week, count(*) AS n, round(coalesce(corr(rp, ra), 0), 8) AS spearman FROM rk GROUP BY week", CELL, _RANK))
def e7_spearman(spark, d):
    return evaluation.spearman(ranked_cells(spark, d), "forecast", "actual", ["week"]).select("week", "n", R("spearman"))


_TOP = "tp AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY forecast DESC, player_id) AS rp, row_number() OVER (PARTITION BY week ORDER BY actual DESC, player_id) AS ra FROM (SELECT * REPLACE (round(forecast, 6) AS forecast) FROM c))"


@query(with_("history", "SELECT week, round(count(*) FILTER (rp <= 10 AND ra <= 10) / least(10, count(*))::DOUBLE, 8) AS hit_rate FROM tp GROUP BY week", CELL, _TOP))
def t3_top_n(spark, d):
    return evaluation.top_n_hits(ranked_cells(spark, d), "forecast", "actual", 10, ["week"], "player_id").select("week", R("hit_rate"))


@query(with_("history", "SELECT week, round(sum(CASE WHEN rp <= 10 THEN actual / log2(rp + 1) ELSE 0 END) / sum(CASE WHEN ra <= 10 THEN actual / log2(ra + 1) ELSE 0 END), 8) AS ndcg FROM tp GROUP BY week", CELL, _TOP))
def t4_ndcg(spark, d):
    return evaluation.ndcg(ranked_cells(spark, d), "forecast", "actual", 10, ["week"], "player_id").select("week", R("ndcg"))


@query(with_("history", "SELECT player_id, week, round(CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(forecast - actual) OVER w END, 8) AS prior_sd FROM c WINDOW w AS (PARTITION BY position ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", CELL))
def w8_earlier_spread(spark, d):
    e = cells(spark, d).withColumn("err", P() - A())
    return evaluation.strictly_earlier_sd(e, "err", "week", ["position"]).select("player_id", "week", R("prior_sd"))


_BOOT = """cl AS (SELECT *, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () AS size FROM (SELECT week, sum(m) AS s, count(m) AS n FROM (SELECT week, abs(baseline - actual) - abs(forecast - actual) AS m FROM c) GROUP BY week)),
dr AS (SELECT rep, CAST('0x' || substr(md5('boot|' || rep || '|' || i), 1, 12) AS BIGINT) % size AS i FROM cl, range(200) r(rep)),
mm AS (SELECT rep, sum(s) / sum(n) AS mean FROM dr JOIN cl USING (i) GROUP BY rep)"""


@query(with_("history", """SELECT round(point, 8) AS point, clusters, round(lower, 8) AS lower, round(upper, 8) AS upper, lower > 0 OR upper < 0 AS excludes_zero FROM
(SELECT sum(s) / sum(n) AS point, count(*) AS clusters FROM cl), (SELECT quantile_cont(mean, 0.025) AS lower, quantile_cont(mean, 0.975) AS upper FROM mm)""", CELL, _BOOT))
def e10_cluster_bootstrap(spark, d):
    u = cells(spark, d).withColumn("m", F.abs(F.col("baseline") - A()) - F.abs(P() - A()))
    return evaluation.cluster_bootstrap(u, "m", ["week"]).select(R("point"), "clusters", R("lower"), R("upper"), "excludes_zero")


@query()
def e10_cluster_bootstrap_10000(spark, d):
    """The same interval from 10,000 replicates."""
    u = cells(spark, d).withColumn("m", F.abs(F.col("baseline") - A()) - F.abs(P() - A()))
    return evaluation.cluster_bootstrap(u, "m", ["week"], n=10_000).select(R("point"), "clusters", R("lower"), R("upper"), "excludes_zero")


@query(with_("history", "SELECT count(m) AS n, round(avg(m), 8) AS mean, round(avg(m) + 1.96::DOUBLE * stddev_samp(m) / sqrt(count(m)), 8) AS threshold FROM (SELECT (CASE WHEN CAST('0x' || substr(md5(player_id || '|' || week), 1, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) * (abs(baseline - actual) - abs(forecast - actual)) AS m FROM c)", CELL))
def e18_sign_flip_gate(spark, d):
    sign = F.when(F.conv(F.substring(F.md5(F.concat_ws("|", "player_id", F.col("week").cast("string"))), 1, 2), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)
    u = cells(spark, d).withColumn("m", sign * (F.abs(F.col("baseline") - A()) - F.abs(P() - A())))
    return evaluation.gate(u, "m").select("n", R("mean"), R("threshold"))


@query()
def e12_walk_forward(spark, d):
    """Ratings at every slot after the warm-up, each from earlier blocks alone."""
    return evaluation.walk_forward_ratings(states(spark, d), v.players(spark, d))


# --- read-only views ---------------------------------------------------------------------


@query(with_("history", "SELECT position, player_id, round(points, 8) AS points FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player_id) AS r FROM history WHERE season = 2023 AND week = 6) WHERE r BETWEEN 3 AND 7"))
def qy1_week_board(spark, d):
    w = Window.partitionBy("position").orderBy(F.col("points").desc(), "player_id")
    return v.history(spark, d).where("season = 2023 and week = 6").withColumn("r", F.row_number().over(w)).where("r between 3 and 7").select("position", "player_id", R("points"))


@query(with_("history", "SELECT player_id, season, week, round(points, 8) AS points FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, week DESC) AS r FROM history WHERE season <= 2023) WHERE r <= 4"))
def qy2_recent_usage(spark, d):
    w = Window.partitionBy("player_id").orderBy(F.col("season").desc(), F.col("week").desc())
    return v.history(spark, d).where("season <= 2023").withColumn("r", F.row_number().over(w)).where("r <= 4").select("player_id", "season", "week", R("points"))


@query(with_("history", "SELECT player_id, round(quantile_cont(points, 0.1), 8) AS q10, round(quantile_cont(points, 0.5), 8) AS q50, round(quantile_cont(points, 0.9), 8) AS q90, round(avg(CASE WHEN points > 25 THEN 1.0::DOUBLE ELSE 0 END), 8) AS boom FROM history GROUP BY player_id"))
def qy3_distribution(spark, d):
    q = lambda p, n: R(F.expr(f"percentile(points, {p})"), n)
    return v.history(spark, d).groupBy("player_id").agg(q(0.1, "q10"), q(0.5, "q50"), q(0.9, "q90"), R(F.avg((F.col("points") > 25).cast("double")), "boom"))


@query(with_("history", "SELECT player_id, round(a.p, 8) AS before, round(b.p, 8) AS after, round(coalesce(b.p, 0) - coalesce(a.p, 0), 8) AS change FROM (SELECT player_id, avg(points) AS p FROM history WHERE season = 2022 GROUP BY 1) a FULL JOIN (SELECT player_id, avg(points) AS p FROM history WHERE season = 2023 GROUP BY 1) b USING (player_id)"))
def qy4_change_log(spark, d):
    m = lambda s, n: v.history(spark, d).where(f"season = {s}").groupBy("player_id").agg(F.avg("points").alias(n))
    j = m(2022, "before").join(m(2023, "after"), "player_id", "full")
    return j.select("player_id", R("before"), R("after"), R(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), "change"))


@query(with_("history", """SELECT CASE WHEN grouping(week) = 1 THEN -1 ELSE week END AS week, CASE WHEN grouping(position) = 1 THEN 'ALL' ELSE position END AS position, count(*) AS n, round(avg(abs(forecast - actual)), 8) AS mae, round(sqrt(avg(pow(forecast - actual, 2))), 8) AS rmse FROM c GROUP BY GROUPING SETS ((week, position), (position), ())""", CELL))
def qy9_scorecard(spark, d):
    g = cells(spark, d).groupingSets([["week", "position"], ["position"], []], "week", "position").agg(F.grouping("week").alias("gw"), F.grouping("position").alias("gp"), F.count("*").alias("n"), R(evaluation.mae(P(), A()), "mae"), R(evaluation.rmse(P(), A()), "rmse"))
    return g.select(F.when(F.col("gw") == 1, -1).otherwise(F.col("week")).alias("week"), F.when(F.col("gp") == 1, "ALL").otherwise(F.col("position")).alias("position"), "n", "mae", "rmse")


@query(with_("history", f"SELECT player_id, week, round(forecast - {normal.ppf(0.9)!r}::DOUBLE * sd, 8) AS low, round(forecast + {normal.ppf(0.9)!r}::DOUBLE * sd, 8) AS high FROM c", CELL))
def qy13_bands(spark, d):
    z = normal.ppf(0.9)
    return cells(spark, d).select("player_id", "week", R(P() - S() * z, "low"), R(P() + S() * z, "high"))
