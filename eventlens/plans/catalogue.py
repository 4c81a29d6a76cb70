"""The registered queries, one per operator group, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.functions import intervals, scoring, vectors
from eventlens.operators import joins, matching, metrics, refine, sampling, sessions, submission, sweep, synth, windows
from eventlens.plans import adapters as A
from eventlens.plans.adapters import SQL, table
from eventlens.streaming import hysteresis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)


# --- sessions ---------------------------------------------------------------------------------------------------------

_SPANS = """cand AS (SELECT DISTINCT video_id, class_name AS cls FROM verdicts WHERE class_name <> 'normal'),
st AS (SELECT v.video_id, c.cls AS class_name, v.seq, v."start", v."end", CASE WHEN v.class_name = c.cls THEN v.score ELSE 0 END AS x FROM verdicts v JOIN cand c USING (video_id)),
a AS (SELECT *, max("end") OVER (PARTITION BY video_id, class_name ORDER BY "start", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM st),
b AS (SELECT *, sum(CASE WHEN "start" - pe > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, class_name ORDER BY "start", seq) AS seg,
  CASE WHEN x >= 0.5 THEN 1 WHEN x < 0.35 THEN 0 END AS sig FROM a),
c AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY video_id, class_name, seg ORDER BY "start", seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st_on FROM b),
d AS (SELECT *, CASE WHEN st_on = 1 AND coalesce(lag(st_on) OVER (PARTITION BY video_id, class_name, seg ORDER BY "start", seq), 0) = 0 THEN 1 ELSE 0 END AS rise FROM c),
e AS (SELECT *, sum(rise) OVER (PARTITION BY video_id, class_name ORDER BY "start", seq) AS sid FROM d),
spans AS (SELECT video_id, class_name, sid, min("start") AS "start", max("end") AS "end", max(x) AS score FROM e WHERE st_on = 1 GROUP BY ALL)"""
_EVENTS = _SPANS + """,
f AS (SELECT *, max("end") OVER (PARTITION BY video_id, class_name ORDER BY "start", sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM spans),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR "start" - pm > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, class_name ORDER BY "start", sid) AS isl FROM f),
found AS (SELECT video_id, class_name, min("start") AS "start", max("end") AS "end", max(score) AS score FROM g GROUP BY video_id, class_name, isl)"""
_OUT = 'SELECT video_id, class_name, ' + q6("start", "end", "score")


def _ruled(hi: str, lo: str, gap: str, least: str) -> str:
    """Events with thresholds that are expressions over the class (cls) and the level."""
    first = _EVENTS.replace("v.score ELSE 0 END AS x FROM", f"v.score ELSE 0 END AS x, {hi} AS hi, {lo} AS lo, {gap} AS mg, {least} AS ml FROM").replace("FROM verdicts v JOIN", "FROM (SELECT *, video_id % 3 + 1 AS level FROM verdicts) v JOIN")
    second = first.replace("WHEN x >= 0.5 THEN 1 WHEN x < 0.35 THEN 0", "WHEN x >= hi THEN 1 WHEN x < lo THEN 0").replace("max(x) AS score FROM e", "max(x) AS score, max(mg) AS mg, max(ml) AS ml FROM e")
    return second.replace('"start" - pm > 5', '"start" - pm > mg').replace("FROM g GROUP BY video_id, class_name, isl)", 'FROM g GROUP BY video_id, class_name, isl HAVING max("end") - min("start") >= max(ml))')


def _spans(spark: SparkSession, d: str) -> DataFrame:
    streams = sessions.with_policy(sessions.candidate_streams(A.verdicts(spark, d)), S.policies(spark), ["theta_high", "theta_low", "max_window_gap_sec"])
    return streams


@query(f"WITH {SQL['verdicts']}, {_SPANS} {_OUT} FROM spans")
def hysteresis_spans(spark, d):
    return sessions.spans(_spans(spark, d), ["video_id", "class_name"]).select("video_id", "class_name", *r6("start", "end", "score"))


@query(f"WITH {SQL['verdicts']}, {_SPANS} {_OUT} FROM spans")
def hysteresis_spans_hot(spark, d):
    return sessions.hot_spans(_spans(spark, d), ["video_id", "class_name"], 100.0).select("video_id", "class_name", *r6("start", "end", "score"))


@query(f"WITH {SQL['verdicts']}, {_ruled('0.5', '0.35', '12', '6')} {_OUT} FROM found")
def gap_merge_events(spark, d):
    """Holes of up to 12 are closed, and what is shorter than 6 is left out."""
    return sessions.aggregate_one(A.verdicts(spark, d), merge_gap_sec=12, min_duration_sec=6).select("video_id", "class_name", *r6("start", "end", "score"))


@query(f"WITH {SQL['verdicts']}, {_EVENTS} {_OUT} FROM found")
def multi_class_aggregate(spark, d):
    return sessions.aggregate_one(A.verdicts(spark, d)).select("video_id", "class_name", *r6("start", "end", "score"))


_SCALED = """scaled AS (SELECT p_partkey AS clip, CASE WHEN p_partkey % 3 = 0 THEN 'long' ELSE 'short' END AS scale,
  CASE p_partkey % 5 WHEN 0 THEN 'fighting_or_violence' WHEN 1 THEN 'fire' WHEN 2 THEN 'normal' WHEN 3 THEN 'wrong_way_driving' ELSE 'smoke' END AS class_name, p_size AS duration FROM part)"""


@query(f"""WITH {_SCALED} SELECT * FROM scaled WHERE (scale = 'short' AND class_name NOT IN ('fighting_or_violence', 'wrong_way_driving'))
OR (scale = 'long' AND class_name IN ('fighting_or_violence', 'wrong_way_driving', 'normal') AND duration >= 16)""")
def multi_scale_route(spark, d):
    k = F.col("p_partkey")
    cls = F.when(k % 5 == 0, "fighting_or_violence").when(k % 5 == 1, "fire").when(k % 5 == 2, "normal").when(k % 5 == 3, "wrong_way_driving").otherwise("smoke")
    rows = table(spark, d, "part").select(k.alias("clip"), F.when(k % 3 == 0, "long").otherwise("short").alias("scale"), cls.alias("class_name"), F.col("p_size").alias("duration"))
    return windows.routed(rows)


@query(f"""WITH {SQL['verdicts']}, a AS (SELECT * FROM verdicts), b AS (SELECT video_id, "start", "end", max(least(1.0::DOUBLE, score * 1.5 + (seq % 2) * 0.2)) AS s2 FROM verdicts GROUP BY ALL)
SELECT a.video_id, a.seq, CASE WHEN class_name = 'normal' OR s2 >= 0.95 THEN class_name ELSE 'normal' END AS class_name, {q6('score').replace('"score", 6', "CASE WHEN class_name = 'normal' OR s2 >= 0.95 THEN score ELSE 0 END, 6")}
FROM a JOIN b USING (video_id, "start", "end")""")
def gate_join(spark, d):
    v = A.verdicts(spark, d).drop("ts")
    second = v.groupBy("video_id", "start", "end").agg(F.max(F.least(F.lit(1.0), F.col("score") * 1.5 + (F.col("seq") % 2) * 0.2)).alias("score"))
    return sessions.gate(v, second).select("video_id", "seq", "class_name", *r6("score"))


# --- windows and labels -----------------------------------------------------------------------------------------------

_GRID = """SELECT video_id, k::INT AS win_ord, (k * {s})::DOUBLE AS win_start, least(k * {s} + {w}, duration)::DOUBLE AS win_end, * EXCLUDE (video_id, k)
  FROM clips, range(0, 100) t(k) WHERE k * {s} < duration AND (k = 0 OR (k - 1) * {s} + {w} < duration)"""


@query(f"WITH {SQL['clips']}, g AS ({_GRID.format(s=4, w=4)}) SELECT video_id, win_ord, win_start, win_end FROM g")
def sliding_windows(spark, d):
    return windows.sliding_windows(A.clips(spark, d), "duration").select("video_id", "win_ord", "win_start", "win_end")


def _labels(w: int, s: int, where: str, scale: str) -> str:
    return f"""SELECT video_id, '{scale}' AS scale, win_ord, win_start, win_end, CASE WHEN es IS NULL OR ee IS NULL THEN 'normal' WHEN least(win_end, ee) - greatest(win_start, es) <= 0 THEN 'normal'
  WHEN least(win_end, ee) - greatest(win_start, es) < 1 THEN NULL
  WHEN (CASE WHEN win_end > win_start THEN (least(win_end, ee) - greatest(win_start, es)) / (win_end - win_start) ELSE 0 END) >= 0.5
    OR (CASE WHEN ee > es THEN (least(win_end, ee) - greatest(win_start, es)) / (ee - es) ELSE 1 END) >= 0.5 THEN class_name END AS label
  FROM (SELECT *, CASE WHEN "end" - "start" <= 0 THEN 0.0 ELSE "start" END AS es, CASE WHEN "end" - "start" <= 0 THEN duration ELSE "end" END AS ee FROM ({_GRID.format(s=s, w=w)}) WHERE {where})"""


_DWELL = "class_name IN ('" + "', '".join(S.DWELL) + "')"


@query(f"WITH {SQL['clips']}, l AS ({_labels(4, 2, 'true', 'short')} UNION ALL {_labels(32, 8, _DWELL, 'long')}) SELECT * FROM l WHERE label IS NOT NULL")
def label_windows(spark, d):
    return windows.all_scales(A.clips(spark, d)).select("video_id", "scale", "win_ord", "win_start", "win_end", "label")


@query(f"""WITH {SQL['clips']}, g AS ({_GRID.format(s=4, w=4)}), t AS (SELECT video_id AS v, 2 AS ord, class_name AS c, coalesce("start", 0) AS s, coalesce("end", duration) AS e FROM clips WHERE class_name <> 'normal'
  UNION ALL SELECT video_id, k % 2 * 2 + 1, CASE k WHEN 0 THEN 'waterlogging_or_flood' ELSE 'loitering_or_suspicious_presence' END, k * 9 + video_id % 5, k * 9 + video_id % 5 + 6 FROM clips, range(0, 3) r(k)),
h AS (SELECT g.video_id, win_ord, win_start, win_end, arg_min(c, ord * 10 + (c = 'waterlogging_or_flood')::INT) AS c FROM g LEFT JOIN t ON v = video_id AND least(win_end, e) - greatest(win_start, s) > 0 GROUP BY ALL)
SELECT video_id, win_ord, win_start, win_end, coalesce(c, 'normal') AS class_name, CASE WHEN c IS NULL THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS score FROM h""")
def oracle_verdicts(spark, d):
    """Up to four events a clip, whose first one (by ord) decides."""
    clips = A.clips(spark, d)
    truth = clips.where("class_name <> 'normal'").select("video_id", "class_name", F.lit(2).alias("ord"), "start", "end")
    k, s = F.col("k"), (F.col("k") * 9 + F.col("video_id") % 5).cast("double")
    more = clips.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    more = more.select("video_id", F.when(k == 0, "waterlogging_or_flood").otherwise("loitering_or_suspicious_presence").alias("class_name"), (k % 2 * 2 + 1).cast("int").alias("ord"), s.alias("start"), (s + 6).alias("end"))
    w = windows.sliding_windows(clips, "duration").select("video_id", "win_ord", "win_start", "win_end", "duration")
    return windows.oracle_verdicts(w, truth.unionByName(more))


@query("""SELECT p_partkey AS id, list_transform(range(0, 8), lambda i: CASE WHEN i = 7 THEN b ELSE floor(a + i * (b - a) / 7.0::DOUBLE) END::INT)::VARCHAR AS frames
FROM (SELECT p_partkey, greatest(0, least(floor((p_partkey % 3) * 15.0), p_size * 15 - 1)) AS a, p_size * 15 - 1 AS b FROM part)""")
def frame_indices(spark, d):
    p = table(spark, d, "part")
    at = windows.frame_indices(F.col("p_size") * 15, F.lit(15.0), 8, start=(F.col("p_partkey") % 3).cast("double"))
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("["), F.array_join(at, ", "), F.lit("]")).alias("frames"))


@query("""SELECT id, CASE WHEN b <= 1 THEN w ELSE greatest(28, floor(w / b / 28) * 28)::INT END AS width, CASE WHEN b <= 1 THEN h ELSE greatest(28, floor(h / b / 28) * 28)::INT END AS height
FROM (SELECT *, sqrt(w * h / (256 * 784)::DOUBLE) AS b FROM (SELECT p_partkey AS id, (p_size * 37 + 11)::INT AS w, (p_partkey % 900 + 101)::INT AS h FROM part))""")
def token_budget_resize(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 37 + 11).cast("int").alias("w"), (F.col("p_partkey") % 900 + 101).cast("int").alias("h"))
    size = windows.resized(F.col("w"), F.col("h"), 256)
    return p.select("id", size["width"].alias("width"), size["height"].alias("height"))


@query("""SELECT p_partkey AS id, list_filter(range(0, p_size), lambda i: i % greatest(1, p_size // 4) = 0)[1:4]::VARCHAR AS picked, p_size // 2 AS mid FROM part""")
def strided_pick(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sequence(F.lit(0), F.col("p_size") - 1).alias("f"))
    return p.select("id", F.concat(F.lit("["), F.array_join(windows.strided(F.col("f"), 4), ", "), F.lit("]")).alias("picked"), windows.middle(F.col("f")).alias("mid"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size <= 4 THEN range(0, p_size)::VARCHAR ELSE list_distinct(list_transform(range(0, 4), lambda i: round_even(i * (p_size - 1) / 3.0::DOUBLE, 0)::INT)).list_sort()::VARCHAR END AS picked FROM part""")
def frame_subsample(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sequence(F.lit(0), F.col("p_size") - 1).alias("f"))
    return p.select("id", F.concat(F.lit("["), F.array_join(windows.subsample(F.col("f"), 4), ", "), F.lit("]")).alias("picked"))


# --- interval joins ---------------------------------------------------------------------------------------------------

_IOU = """CASE WHEN p."start" IS NULL OR p."end" IS NULL OR g."start" IS NULL OR g."end" IS NULL THEN 0.0::DOUBLE
  WHEN greatest(p."end", g."end") - least(p."start", g."start") > 0 THEN greatest(0.0::DOUBLE, least(p."end", g."end") - greatest(p."start", g."start")) / (greatest(p."end", g."end") - least(p."start", g."start")) ELSE 0.0::DOUBLE END"""


@query(f"WITH {SQL['truth']}, {SQL['preds']} SELECT p.ord AS pred_ord, g.ord AS gt_ord, round({_IOU}, 6) AS iou FROM preds p JOIN truth g USING (video_id, class_name)")
def temporal_iou_pairs(spark, d):
    p, g = A.predictions(spark, d).alias("p"), A.truth(spark, d).alias("g")
    size = intervals.iou(F.col("p.start"), F.col("p.end"), F.col("g.start"), F.col("g.end"))
    return p.join(g, ["video_id", "class_name"]).select(F.col("p.ord").alias("pred_ord"), F.col("g.ord").alias("gt_ord"), F.round(size, 6).alias("iou"))


_OVERLAP = f"""WITH {SQL['truth']}, {SQL['preds']} SELECT p.video_id, p.ord AS pred_ord, g.ord AS gt_ord FROM preds p LEFT JOIN truth g
ON p.video_id = g.video_id AND g."start" IS NOT NULL AND least(p."end", g."end") - greatest(p."start", g."start") > 0"""


def _overlaps(spark, d, **how):
    p = A.predictions(spark, d).select("video_id", F.col("ord").alias("pred_ord"), "start", "end")
    g = A.truth(spark, d).where("start is not null").select("video_id", F.col("ord").alias("gt_ord"), F.col("start").alias("s"), F.col("end").alias("e"))
    return joins.overlap_join(p, g, "video_id", ("start", "end"), ("s", "e"), **how).select("video_id", "pred_ord", "gt_ord")


@query(_OVERLAP)
def overlap_join(spark, d):
    return _overlaps(spark, d)


@query(_OVERLAP)
def overlap_join_binned(spark, d):
    return _overlaps(spark, d, bin_sec=48.0)


@query(f"""WITH {SQL['verdicts']}, seg AS (SELECT user_id AS video_id, 'c' || event_id AS path, h - 1 AS s, h + 2 AS e, (event_id % 10)::DOUBLE AS off
  FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS h FROM events)),
hit AS (SELECT video_id, seq, "start", arg_min(struct_pack(path := path, at := "start" - s + off), struct_pack(a := s, b := e)) AS b FROM verdicts LEFT JOIN seg USING (video_id)
  WHERE s <= "start" AND "start" < e GROUP BY ALL)
SELECT v.video_id, v.seq, b.path AS seg_path, round(b.at, 6) AS seg_offset FROM verdicts v LEFT JOIN hit USING (video_id, seq)""")
def point_in_interval(spark, d):
    v = A.verdicts(spark, d)
    seg = v.select("video_id", (F.col("start") - 1).alias("start"), (F.col("start") + 2).alias("end"), F.concat(F.lit("c"), F.col("seq")).alias("source_path"), (F.col("seq") % 10).cast("double").alias("source_start"))
    out = joins.point_in_interval(v.select("video_id", "seq", F.col("start").alias("t")), seg, "video_id", "t")
    return out.select("video_id", "seq", "seg_path", *r6("seg_offset"))


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_left_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey")
    return joins.enrich(o, c, "k").select("o_orderkey", F.col("k").alias("o_custkey"), "c_name", "c_nationkey")


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 + 1 IN (2, 3)")
def level_semi_join(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("video_id"))
    return joins.in_levels(e, A.meta(spark, d), [2, 3]).select("event_id", F.col("video_id").alias("user_id"))


@query("SELECT event_id, 'short' AS scale FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, 'long' AS scale FROM events WHERE event_type IN ('click', 'view')")
def verdict_union(spark, d):
    e = table(spark, d, "events")
    short = e.where("event_type <> 'view'").select("event_id", F.lit("short").alias("scale"))
    return short.unionByName(e.where("event_type in ('click', 'view')").select("event_id", F.lit("long").alias("scale")))


@query(f"""WITH {SQL['meta']}, {SQL['truth']}, {SQL['preds']}, g AS (SELECT video_id, list(DISTINCT class_name) AS l FROM truth GROUP BY 1), p AS (SELECT video_id, list(DISTINCT class_name) AS l FROM preds GROUP BY 1)
SELECT video_id, array_to_string(list_sort(list_intersect(coalesce(g.l, []), coalesce(p.l, []))), ',') AS both_sides, array_to_string(list_sort(list_filter(coalesce(g.l, []), lambda x: NOT list_contains(coalesce(p.l, []), x))), ',') AS missed
FROM meta LEFT JOIN g USING (video_id) LEFT JOIN p USING (video_id)""")
def class_set_ops(spark, d):
    s = metrics.class_sets(A.meta(spark, d), A.truth(spark, d), A.predictions(spark, d))
    return s.select("video_id", F.array_join(F.array_sort(F.array_intersect("gt", "pred")), ",").alias("both_sides"), F.array_join(F.array_sort(F.array_except("gt", "pred")), ",").alias("missed"))


# --- matching and scores ----------------------------------------------------------------------------------------------


def _match(tau: float, official: bool, name: str = "pairs") -> str:
    timed = 'p."start" IS NOT NULL AND p."end" IS NOT NULL AND g."start" IS NOT NULL AND g."end" IS NOT NULL'
    ok = f"({timed} AND {_IOU} >= {tau} AND {_IOU} > 0)" if official else f"(({timed} AND {_IOU} >= {tau}) OR NOT ({timed}))"
    return f"""{name}_p AS (SELECT *, row_number() OVER (PARTITION BY video_id, class_name ORDER BY score DESC, ord) AS k FROM preds),
{name}_c AS (SELECT p.video_id, p.class_name, p.k, p.ord AS pid, list(struct_pack(iou := -({_IOU}), gid := g.ord) ORDER BY -({_IOU}), g.ord) AS cands
  FROM {name}_p p JOIN truth g USING (video_id, class_name) WHERE {ok} GROUP BY ALL),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY video_id, class_name ORDER BY k) AS n FROM {name}_c),
{name}_m AS (SELECT DISTINCT video_id, class_name, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS pid, NULL::BIGINT AS gid, NULL::DOUBLE AS iou FROM {name}_o
  UNION ALL SELECT video_id, class_name, n, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.gid) END, pid, b.gid, -(b.iou)
  FROM (SELECT m.video_id, m.class_name, o.n, m.used, o.pid, list_filter(o.cands, lambda x: NOT list_contains(m.used, x.gid))[1] AS b
        FROM {name}_m m JOIN {name}_o o ON o.video_id = m.video_id AND o.class_name = m.class_name AND o.n = m.n + 1)),
{name} AS (SELECT video_id, class_name, pid AS pred_ord, gid AS gt_ord, iou + 0 AS iou FROM {name}_m WHERE gid IS NOT NULL)"""


def _rec(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


_PAIRS = "SELECT video_id, class_name, pred_ord, gt_ord, round(iou, 6) AS iou FROM pairs"


@query(_rec(SQL["truth"], SQL["preds"], _match(0.1, False)) + _PAIRS)
def greedy_match_general(spark, d):
    return matching.match(A.truth(spark, d), A.predictions(spark, d), 0.1).withColumn("iou", F.round("iou", 6))


@query(_rec(SQL["truth"], SQL["preds"], _match(0.5, True)) + _PAIRS)
def greedy_match_official(spark, d):
    return matching.match(A.truth(spark, d), A.predictions(spark, d), 0.5, official=True).withColumn("iou", F.round("iou", 6))


@query(_rec(SQL["truth"], SQL["preds"], _match(0.5, True)) + """SELECT 'fp' AS outcome, video_id, class_name, ord AS pred_ord, NULL::BIGINT AS gt_ord FROM preds WHERE ord NOT IN (SELECT pred_ord FROM pairs)
UNION ALL SELECT 'fn', video_id, class_name, NULL, ord FROM truth WHERE ord NOT IN (SELECT gt_ord FROM pairs)""")
def anti_unmatched(spark, d):
    """Events of either side that the official matching leaves without a partner."""
    t, p = A.truth(spark, d), A.predictions(spark, d)
    return matching.outcomes(t, p, matching.match(t, p, 0.5, official=True)).where("outcome <> 'tp'").select("outcome", "video_id", "class_name", "pred_ord", "gt_ord")


_PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def _levels(tau: float) -> str:
    n = f"m{int(tau * 10)}"
    return f"""SELECT {tau}::DOUBLE AS tau, level, (count(*) FILTER (k = 'tp')) AS tp, (count(*) FILTER (k = 'fp')) AS fp, (count(*) FILTER (k = 'fn')) AS fn, avg(iou) FILTER (k = 'tp' AND timed) AS mean_iou FROM (
  SELECT 'tp' AS k, p.video_id, p.iou, t."start" IS NOT NULL AS timed FROM {n} p JOIN truth t ON t.ord = p.gt_ord UNION ALL
  SELECT 'fp', video_id, NULL, false FROM preds WHERE ord NOT IN (SELECT pred_ord FROM {n}) UNION ALL SELECT 'fn', video_id, NULL, false FROM truth WHERE ord NOT IN (SELECT gt_ord FROM {n})
) JOIN meta USING (video_id) GROUP BY GROUPING SETS ((), (level))"""


@query(_rec(SQL["meta"], SQL["truth"], SQL["preds"], *(_match(t, False, f"m{int(t * 10)}") for t in S.GENERAL_TAUS), "u AS (" + " UNION ALL ".join(_levels(t) for t in S.GENERAL_TAUS) + ")")
       + f"SELECT tau, level, tp, fp, fn, {_PRF}, round(mean_iou, 6) AS mean_iou FROM u")
def prf_by_tau_level(spark, d):
    out = metrics.by_tau_and_level(A.truth(spark, d), A.predictions(spark, d), A.meta(spark, d), S.GENERAL_TAUS)
    return out.select("tau", "level", "tp", "fp", "fn", *r6("precision", "recall", "f1", "mean_iou"))


_SOME = "preds AS (SELECT user_id AS video_id FROM events WHERE event_type = 'signup' AND value > 120)"


@query(f"""WITH {SQL['meta']}, {_SOME}, j AS (SELECT has_anomaly AS h, video_id IN (SELECT video_id FROM preds) AS s FROM meta),
c AS (SELECT (count(*) FILTER (h AND s)) AS tp, (count(*) FILTER (NOT h AND s)) AS fp, (count(*) FILTER (h AND NOT s)) AS fn, (count(*) FILTER (NOT h AND NOT s)) AS tn FROM j)
SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS false_alarm_rate, fp + tn AS n_normal FROM c""")
def video_confusion(spark, d):
    p = table(spark, d, "events").where("event_type = 'signup' and value > 120").select(F.col("user_id").alias("video_id"))
    return metrics.confusion(A.meta(spark, d), p).select("tp", "fp", "fn", "tn", *r6("precision", "recall", "false_alarm_rate"), "n_normal")


@query(_rec(SQL["truth"], SQL["preds"], _match(0.1, False)) + "SELECT class_name, count(pred_ord) AS hits, count(*) AS total FROM truth t LEFT JOIN pairs p ON p.gt_ord = t.ord GROUP BY ALL".replace("class_name", "t.class_name"))
def per_class_recall(spark, d):
    t = A.truth(spark, d)
    return metrics.class_recall(t, matching.match(t, A.predictions(spark, d), 0.1))


_LEVEL1 = """l1 AS (SELECT count(*) AS n_videos, avg(((g > 0) = (p > 0))::INT) AS b, coalesce(avg(hit::INT) FILTER (g > 0), 0) AS c FROM (
  SELECT video_id, (SELECT count(*) FROM truth t WHERE t.video_id = m.video_id) AS g, (SELECT count(*) FROM preds t WHERE t.video_id = m.video_id) AS p,
    EXISTS (SELECT 1 FROM truth a JOIN preds b USING (video_id, class_name) WHERE a.video_id = m.video_id) AS hit FROM meta m WHERE level = 1))"""


@query(f"WITH {SQL['meta']}, {SQL['truth']}, {SQL['preds']}, {_LEVEL1} SELECT n_videos, round(b, 6) AS acc_binary, round(c, 6) AS acc_class, round(0.5 * b + 0.5 * c, 6) AS score FROM l1")
def level1_pooled(spark, d):
    return metrics.level1(A.meta(spark, d), A.truth(spark, d), A.predictions(spark, d)).select("n_videos", *r6("acc_binary", "acc_class", "score"))


_L23 = """n23 AS (SELECT m.video_id, level, (SELECT count(*) FROM truth t WHERE t.video_id = m.video_id) AS g, (SELECT count(*) FROM preds t WHERE t.video_id = m.video_id) AS p,
  (SELECT count(*) FROM pairs t WHERE t.video_id = m.video_id) AS tp, (SELECT sum(iou) FROM pairs t WHERE t.video_id = m.video_id) AS s FROM meta m WHERE level > 1),
l23 AS (SELECT video_id, level, g = 0 AS is_normal, CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS alert, CASE WHEN tp > 0 THEN 2 * tp / (p + g) ELSE 0.0 END::DOUBLE AS match_f1,
  CASE WHEN tp > 0 THEN s / tp ELSE 0.0 END::DOUBLE AS timing, tp, p - tp AS fp, g - tp AS fn FROM n23),
s23 AS (SELECT *, CASE WHEN is_normal THEN 1 - alert WHEN level = 2 THEN 0.2 * alert + 0.5 * match_f1 + 0.3 * timing ELSE 0.2 * alert + 0.4 * match_f1 + 0.4 * timing END::DOUBLE AS score FROM l23)"""


@query(_rec(SQL["meta"], SQL["truth"], SQL["preds"], _match(0.5, True), _L23) + f"SELECT video_id, level, is_normal, {q6('alert', 'match_f1', 'timing')}, tp, fp, fn, {q6('score')} FROM s23")
def level23_scores(spark, d):
    out = metrics.level23(A.meta(spark, d), A.truth(spark, d), A.predictions(spark, d))
    return out.select("video_id", "level", "is_normal", *r6("alert", "match_f1", "timing"), "tp", "fp", "fn", *r6("score"))


@query(_rec(SQL["meta"], SQL["truth"], SQL["preds"], _match(0.5, True), _L23, _LEVEL1, """lv AS (SELECT 1 AS level, n_videos, 0.5 * b + 0.5 * c AS score, NULL::BIGINT AS z FROM l1 WHERE n_videos > 0
  UNION ALL SELECT level, count(*), avg(score), count(*) FILTER (is_normal AND score = 0) FROM s23 GROUP BY level)""")
       + "SELECT level, n_videos, round(score, 6) AS score, z AS n_normal_zeroed FROM lv UNION ALL SELECT NULL, sum(n_videos)::BIGINT, round(avg(score), 6), sum(z)::BIGINT FROM lv")
def overall_score(spark, d):
    return metrics.overall(A.meta(spark, d), A.truth(spark, d), A.predictions(spark, d)).select("level", "n_videos", *r6("score"), "n_normal_zeroed")


@query(_rec(SQL["meta"], SQL["truth"], SQL["preds"], _match(0.5, True), _L23) + f"SELECT level, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('alert', 'match_f1', 'timing'))} FROM s23 WHERE NOT is_normal GROUP BY level")
def mean_components(spark, d):
    v = metrics.level23(A.meta(spark, d), A.truth(spark, d), A.predictions(spark, d))
    return metrics.mean_components(v).select("level", *r6("alert", "match_f1", "timing"))


# --- refinement and sweep ---------------------------------------------------------------------------------------------


@query(f"""WITH {SQL['truth']} SELECT ord, CASE WHEN "start" IS NULL THEN NULL WHEN "end" - 2 <= "start" + 2 THEN round(("start" + "end") / 2 - 0.25, 3) ELSE round("start" + 2, 3) END AS "start",
CASE WHEN "start" IS NULL THEN NULL WHEN "end" - 2 <= "start" + 2 THEN round(("start" + "end") / 2 + 0.25, 3) ELSE round("end" - 2, 3) END AS "end" FROM truth""")
def midpoint_refine(spark, d):
    return refine.refine(A.truth(spark, d), A.verdicts(spark, d), "midpoint", 4.0).select("ord", "start", "end")


@query(f"""WITH {SQL['verdicts']}, {_EVENTS}, q AS (SELECT v.video_id, c.cls AS class_name, (v."start" + v."end") / 2 AS t, CASE WHEN v.class_name = c.cls THEN v.score ELSE 0 END AS x FROM verdicts v JOIN cand c USING (video_id)),
l AS (SELECT *, lead(t) OVER w AS t2, lead(x) OVER w AS x2 FROM q WINDOW w AS (PARTITION BY video_id, class_name ORDER BY t, x)),
up AS (SELECT *, t + (0.5 - x) / (x2 - x) * (t2 - t) AS c FROM l WHERE x < 0.5 AND x2 >= 0.5), dn AS (SELECT *, t2 + (0.5 - x2) / (x - x2) * (t - t2) AS c FROM l WHERE x2 < 0.5 AND x >= 0.5),
m AS (SELECT f.*, (SELECT arg_min(c, struct_pack(a := t2, b := t)) FROM up u WHERE u.video_id = f.video_id AND u.class_name = f.class_name AND u.t2 >= f."start") AS ns,
  (SELECT arg_max(c, struct_pack(a := t, b := t2)) FROM dn u WHERE u.video_id = f.video_id AND u.class_name = f.class_name AND u.t <= f."end") AS ne FROM found f)
SELECT video_id, class_name, round(CASE WHEN coalesce(ne, "end") > coalesce(ns, "start") THEN coalesce(ns, "start") ELSE "start" END, 6) AS "start",
round(CASE WHEN coalesce(ne, "end") > coalesce(ns, "start") THEN coalesce(ne, "end") ELSE "end" END, 6) AS "end" FROM m""")
def crossing_refine(spark, d):
    v = A.verdicts(spark, d)
    e = sessions.aggregate_one(v).withColumn("ord", F.struct("start", "end"))
    return refine.interpolate(e, v).select("video_id", "class_name", *r6("start", "end"))


@query(None)
def policy_sweep_topk(spark, d):
    """All 120 policies by F1; the recursive SQL is too slow on them, so tests compare a small table with plain Python."""
    return sweep.sweep(A.verdicts(spark, d), A.truth(spark, d), sweep.grid(spark)).select("policy_id", "theta_high", "theta_low", "merge_gap_sec", "min_duration_sec", "n_events", "tp", *r6("precision", "recall", "f1"))


@query(None)
def sweep_overall_topk(spark, d):
    """All 120 policies by overall score of refined events; compared with plain Python in the tests."""
    out = sweep.sweep_overall(A.verdicts(spark, d), A.truth(spark, d), A.meta(spark, d), sweep.grid(spark))
    return out.select("policy_id", "theta_high", "theta_low", "merge_gap_sec", "min_duration_sec", *r6("level1", "level2", "level3", "overall"))


# --- model scores -----------------------------------------------------------------------------------------------------


_REPLY = """r AS (SELECT event_id, event_type, value, CASE event_type
  WHEN 'click' THEN 'Answer: {"is_anomaly": ' || (value >= 50)::VARCHAR || ', "class_name": "fire", "more": ' || props || '} (' || event_id || ')'
  WHEN 'error' THEN '{"class_name":"smoke","is_anomaly":' || (value > 20)::INT || '}'
  WHEN 'purchase' THEN '{"class_name": "volcano_' || event_id || '", "is_anomaly": true}'
  WHEN 'signup' THEN '{"is_anomaly": "' || CASE WHEN value > 60 THEN 'yes' ELSE '' END || '", "class_name": "waterlogging_or_flood"}'
  ELSE '{ not json, ' || props END AS reply FROM events)"""


@query(f"""WITH {_REPLY}, j AS (SELECT event_id, regexp_extract(reply, '\\{{[\\s\\S]*\\}}') AS body FROM r),
k AS (SELECT event_id, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.class_name') END AS c, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.is_anomaly') END AS a FROM j),
l AS (SELECT event_id, c, c IN ({", ".join(f"'{x}'" for x in S.CLASSES)}) AND a NOT IN ('false', '0', '') AS yes FROM k)
SELECT event_id, CASE WHEN yes THEN c ELSE 'normal' END AS class_name, coalesce(yes, false) AS is_anomaly FROM l""")
def parse_class_json(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    text = (
        F.when(kind == "click", F.concat(F.lit('Answer: {"is_anomaly": '), (value >= 50).cast("string"), F.lit(', "class_name": "fire", "more": '), "props", F.lit("} ("), "event_id", F.lit(")")))
        .when(kind == "error", F.concat(F.lit('{"class_name":"smoke","is_anomaly":'), (value > 20).cast("int"), F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"class_name": "volcano_'), "event_id", F.lit('", "is_anomaly": true}')))
        .when(kind == "signup", F.concat(F.lit('{"is_anomaly": "'), F.when(value > 60, "yes").otherwise(""), F.lit('", "class_name": "waterlogging_or_flood"}')))
        .otherwise(F.concat(F.lit("{ not json, "), "props"))
    )
    r = scoring.parse_reply(text)
    return table(spark, d, "events").select("event_id", r["class_name"].alias("class_name"), r["is_anomaly"].alias("is_anomaly"))


@query("""SELECT event_id, round(1 / (1 + exp(f - t)), 6) AS p FROM (SELECT event_id, value / 50 AS t, (event_id % 7)::DOUBLE AS f FROM events)""")
def softmax_pair_prob(spark, d):
    logits = F.array(F.lit(-10.0), F.col("value") / 50, (F.col("event_id") % 7).cast("double"), F.lit(-10.0))
    steps = F.array(F.struct(F.lit("{").alias("piece"), logits.alias("logits")), F.struct(F.lit(" true").alias("piece"), logits.alias("logits")))
    return table(spark, d, "events").select("event_id", F.round(scoring.boolean_probability(steps, [1], [2]), 6).alias("p"))


_PROTO = """means AS (SELECT class_name, i, avg(v[i]) AS m FROM emb, range(1, 65) t(i) GROUP BY ALL), proto AS (SELECT class_name AS k, list(m ORDER BY i) AS p FROM means GROUP BY ALL)"""


@query(f"""WITH {SQL['emb']}, {_PROTO}, z AS (SELECT vec_id, k, 10 * list_dot_product(v, p) / sqrt(list_dot_product(p, p)) AS l FROM emb, proto),
s AS (SELECT vec_id, k, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM z), p AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s)
SELECT vec_id, arg_max(k, p) AS best, round(1 - sum(p) FILTER (k = 'normal'), 6) AS p_anomaly, array_to_string(list(k ORDER BY p DESC, k)[1:3], ',') AS top FROM p GROUP BY vec_id""")
def embedding_classify_top3(spark, d):
    e = A.embeddings(spark, d)
    protos = vectors.mean_pool(e, ["class_name"], "v").select("class_name", F.col("mean").alias("proto"))
    return vectors.classify(e, protos, "vec_id", "v").select("vec_id", "best", *r6("p_anomaly"), F.array_join("top", ",").alias("top"))


@query(f"""WITH {SQL['emb']}, {_PROTO} SELECT k AS class_name, i - 1 AS dim, round(p[i] / sqrt(list_dot_product(p, p)), 6) AS x, round(sqrt(list_dot_product(p, p)), 6) AS norm FROM proto, range(1, 65) t(i)""")
def mean_pool_embeddings(spark, d):
    m = vectors.mean_pool(A.embeddings(spark, d), ["class_name"], "v")
    each = m.select("class_name", F.posexplode(vectors.unit(F.col("mean"))).alias("dim", "x"), F.round(vectors.norm(F.col("mean")), 6).alias("norm"))
    return each.select("class_name", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"), "norm")


@query(f"""WITH {SQL['emb']}, {_PROTO} SELECT vec_id, round(1 - list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))), 6) AS novelty FROM emb JOIN proto ON k = class_name""")
def novelty_distance(spark, d):
    return vectors.novelty(A.embeddings(spark, d), ["class_name"], "vec_id", "v").select("vec_id", *r6("novelty"))


@query("""WITH s AS (SELECT value AS x, event_type = 'error' AS y FROM events), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM s)
SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r""")
def auc_rank_sum(spark, d):
    e = table(spark, d, "events").select(F.col("value").alias("x"), (F.col("event_type") == "error").alias("y"))
    return vectors.auc(e, "y", "x").select(*r6("auc"))


# --- sampling ---------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL['strata']} SELECT class_name, count(*) AS n FROM strata GROUP BY ALL")
def class_counts(spark, d):
    return metrics.class_counts(A.strata(spark, d))


@query(f"WITH {SQL['strata']}, c AS (SELECT count(*) AS n FROM strata WHERE class_name <> 'normal' GROUP BY class_name) SELECT list(n ORDER BY n)[count(*) // 2 + 1] AS cap FROM c")
def upper_median_cap(spark, d):
    return sampling.upper_median(metrics.class_counts(A.strata(spark, d).where("class_name <> 'normal'")))


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5('7:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY class_name) AS n FROM strata)"


@query(f"""WITH {SQL['strata']}, {_RANKED}, c AS (SELECT count(*) AS n FROM strata WHERE class_name <> 'normal' GROUP BY class_name), cap AS (SELECT list(n ORDER BY n)[count(*) // 2 + 1] AS k FROM c),
q AS (SELECT floor(sum(least(n, k)) * 1.5) AS m FROM c, cap) SELECT doc_id, class_name FROM ranked, cap, q WHERE (class_name <> 'normal' AND r <= k) OR (class_name = 'normal' AND r <= m)""")
def balanced_sample(spark, d):
    return sampling.balance(A.strata(spark, d), "doc_id", seed=7).select("doc_id", "class_name")


@query(f"""WITH {SQL['strata']}, {_RANKED}, k AS (SELECT * FROM ranked WHERE r <= greatest(1, round_even(120.0::DOUBLE * n / (SELECT count(*) FROM strata), 0)))
SELECT doc_id, class_name FROM k ORDER BY md5('7:' || doc_id), doc_id LIMIT 120""")
def stratified_trim(spark, d):
    return sampling.stratified(A.strata(spark, d), "doc_id", 120, seed=7).select("doc_id", "class_name")


@query("""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.3::DOUBLE) AS held_out FROM documents""")
def holdout_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.holdout(docs, "doc_id", 0.3, seed=7, by=[F.col("lang")])


@query(None)
def synth_timeline(spark, d):
    clips = A.clips(spark, d)
    ids = table(spark, d, "customer").select(F.format_string("SYN%04d", "c_custkey").alias("video_id"))
    videos = sampling.quota_flags(ids, "video_id", 0.2, seed=7)
    normals = clips.where("class_name = 'normal'").select(F.concat_ws("-", "path", "video_id").alias("path"), "duration")
    bad = clips.where("class_name <> 'normal'").select(F.concat_ws("-", "path", "video_id").alias("path"), "class_name", "start", "end", "duration")
    return synth.timelines(videos, normals, bad, seed=7)


# --- documents and statistics -----------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_suppkey AS k, l_extendedprice AS x FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM r)
SELECT k AS l_suppkey, count(*) AS call_count, round_even(sum(x), 2) AS total_time_ms, round_even(sum(x) / count(*), 2) AS average_time_ms, max(x) AS max_time_ms, max(x) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50_time_ms, max(x) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95_time_ms FROM o GROUP BY k""")
def latency_summary(spark, d):
    return metrics.latency(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", digits=2).select("l_suppkey", "call_count", "total_time_ms", "average_time_ms", "max_time_ms", "p50_time_ms", "p95_time_ms")


@query("""SELECT l_suppkey, round(median(l_quantity), 6) AS median, min(l_quantity) AS "min", max(l_quantity) AS "max", round(coalesce(stddev_samp(l_quantity), 0), 6) AS stdev FROM lineitem GROUP BY ALL""")
def timing_spread(spark, d):
    return metrics.spread(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity").select("l_suppkey", *r6("median"), "min", "max", *r6("stdev"))


@query("""WITH m AS (SELECT l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(m, 6) AS median, m <= 25 AS keeps_up, round(greatest(0.0::DOUBLE, 1 - 25 / m), 6) AS "drop" FROM m""")
def realtime_budget(spark, d):
    return metrics.realtime(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 25.0).select("l_suppkey", *r6("median"), "keeps_up", *r6("drop"))


@query("""WITH r AS (SELECT l_suppkey % 10 AS config, l_linenumber % 3 AS p, median(l_quantity) AS m FROM lineitem GROUP BY ALL),
w AS (SELECT config, max(m) FILTER (p = 0) AS a1, max(m) FILTER (p = 1) AS b, max(m) FILTER (p = 2) AS a2 FROM r GROUP BY ALL)
SELECT config, round(a1, 6) AS a1, round(b, 6) AS b, round(a2, 6) AS a2, round(100 * abs(a2 - a1) / a1, 6) AS drift_pct,
CASE WHEN 100 * abs(a2 - a1) / a1 > 5 THEN 'unstable' WHEN b < least(a1, a2) THEN 'b faster' WHEN b > greatest(a1, a2) THEN 'b slower' ELSE 'within noise' END AS verdict FROM w""")
def aba_pivot(spark, d):
    run = F.element_at(F.array(F.lit("A1"), F.lit("B"), F.lit("A2")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("config"), run.alias("run"), "l_quantity")
    return metrics.aba(rows, "config", "run", "l_quantity").select("config", *r6("a1", "b", "a2", "drift_pct"), "verdict")


@query(f"WITH {SQL['verdicts']} SELECT count(*) AS n_windows, count(*) FILTER (class_name <> 'normal') AS n_anomalous, round((count(*) FILTER (class_name <> 'normal')) / count(*), 6) AS rate FROM verdicts")
def anomaly_rate(spark, d):
    return metrics.anomaly_rate(A.verdicts(spark, d)).select("n_windows", "n_anomalous", *r6("rate"))


def _entries(spark, d):
    preds = A.predictions(spark, d).withColumn("class_name", F.when(F.col("class_name") == "click", "fire").when(F.col("class_name") == "error", "smoke").otherwise(F.col("class_name")))
    return A.meta(spark, d), submission.entries(A.meta(spark, d), preds)


_CLEAN = """p AS (SELECT video_id, CASE class_name WHEN 'click' THEN 'fire' ELSE 'smoke' END AS class_name, ord, "start", "end", score, level FROM preds JOIN meta USING (video_id) WHERE class_name IN ('click', 'error')),
k AS (SELECT video_id, arg_max(class_name, struct_pack(s := score, o := -ord)) AS class_name, NULL::DOUBLE AS s, NULL::DOUBLE AS e FROM p WHERE level = 1 GROUP BY ALL
  UNION ALL SELECT video_id, class_name, round("start", 3), round("end", 3) FROM p WHERE level > 1 AND "end" > "start" AND "start" >= 0)"""


@query(f"""WITH {SQL['meta']}, {SQL['preds']}, {_CLEAN} SELECT m.video_id, (row_number() OVER (PARTITION BY m.video_id ORDER BY s, e, k.class_name) - 1)::INT AS place, k.class_name, s AS "start", e AS "end" FROM meta m LEFT JOIN k USING (video_id)""")
def submission_entries(spark, d):
    """Every event of every entry; videos without one have a row of nulls."""
    _, e = _entries(spark, d)
    rows = e.select("video_id", F.explode_outer("events").alias("x")).select("video_id", F.col("x.class_name").alias("class_name"), F.col("x.start_time_sec").alias("start"), F.col("x.end_time_sec").alias("end"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"), F.asc_nulls_last("class_name"))) - 1
    return rows.withColumn("place", place)


@query(f"""WITH {SQL['meta']}, {SQL['preds']}, p AS (SELECT video_id, level, CASE WHEN ord % 11 = 0 THEN 'normal' WHEN ord % 7 = 0 THEN 'odd' ELSE 'fire' END AS c, CASE WHEN ord % 3 > 0 THEN "start" END AS s, CASE WHEN ord % 3 > 0 THEN "start" + ord % 5 - 1 END AS e, ord FROM preds JOIN meta USING (video_id)),
w AS (SELECT DISTINCT video_id FROM preds),
r AS (SELECT video_id, 'class normal' AS rule, count(*) AS n FROM p WHERE c = 'normal' GROUP BY ALL UNION ALL SELECT video_id, 'unknown class', count(*) FROM p WHERE c = 'odd' GROUP BY ALL
 UNION ALL SELECT video_id, 'level 1 with times', count(*) FROM p WHERE level = 1 AND s IS NOT NULL GROUP BY ALL UNION ALL SELECT video_id, 'upper level without times', count(*) FROM p WHERE level > 1 AND s IS NULL GROUP BY ALL
 UNION ALL SELECT video_id, 'bad interval', count(*) FROM p WHERE level > 1 AND (s < 0 OR e <= s) GROUP BY ALL UNION ALL SELECT video_id, 'level 1 with several events', 1 FROM p WHERE level = 1 GROUP BY video_id HAVING count(*) > 1
 UNION ALL SELECT video_id, 'explanation length', count(*) FROM p WHERE ord % 4 = 0 AND ord % 50 < 20 GROUP BY ALL UNION ALL SELECT video_id, 'runtime missing', 1 FROM w WHERE video_id % 5 = 0 UNION ALL SELECT NULL, 'runtime missing', 1
 UNION ALL SELECT video_id, 'average off', 1 FROM w WHERE video_id % 5 <> 0 AND video_id % 3 = 0 UNION ALL SELECT video_id, 'call times', 1 FROM w WHERE video_id % 5 <> 0 AND video_id % 4 = 0
 UNION ALL SELECT NULL, 'no video_id', 1 UNION ALL SELECT video_id, 'repeated video_id', 1 FROM w WHERE video_id % 13 = 0 UNION ALL SELECT video_id, 'runtime missing', 1 FROM w WHERE video_id % 13 = 0)
SELECT video_id, rule, sum(n)::BIGINT AS n FROM r GROUP BY video_id, rule""")
def submission_validate(spark, d):
    """Every rule is broken by some entry: classes, levels, intervals, explanations, runtimes, missing and repeated ids."""
    o, v = F.col("ord"), F.col("video_id")
    cls = F.when(o % 11 == 0, "normal").when(o % 7 == 0, "odd").otherwise("fire")
    s = F.when(o % 3 > 0, F.col("start"))
    event = F.struct(cls.alias("class_name"), s.alias("start_time_sec"), (s + o % 5 - 1).alias("end_time_sec"), F.when(o % 4 == 0, F.repeat(F.lit("x"), (o % 50).cast("int"))).alias("explanation"))
    e = A.predictions(spark, d).select("video_id", event.alias("e")).groupBy("video_id").agg(F.collect_list("e").alias("events"))
    mean = F.when(v % 3 == 0, 5.2).otherwise(5.0)
    times = F.when(v % 4 == 0, F.array(F.lit(10.0))).when(v % 4 == 1, F.array(F.lit(4.0), F.lit(6.0)))
    run = F.struct(F.array(F.struct(F.lit("m").alias("model_name"), F.lit(2).alias("call_count"), F.lit(10.0).alias("total_time_ms"), mean.alias("average_time_ms"), times.alias("call_times_ms"))).alias("model_runtimes"))
    e = e.withColumn("runtime_metadata", F.when(v % 5 != 0, run))
    no = F.lit(None)
    again = e.where(v % 13 == 0).select("video_id", F.slice("events", 1, 0).alias("events"), no.cast(e.schema["runtime_metadata"].dataType).alias("runtime_metadata"))
    lost = e.groupBy().agg(F.max("video_id").alias("m")).select(no.cast("bigint").alias("video_id"), no.cast(e.schema["events"].dataType).alias("events"), no.cast(e.schema["runtime_metadata"].dataType).alias("runtime_metadata"))
    lost = lost.withColumn("events", F.array().cast(e.schema["events"].dataType))
    return submission.validate(e.unionByName(again).unionByName(lost), A.meta(spark, d))


@query("""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id""")
def chat_jsonl(spark, d):
    c = table(spark, d, "conversations")
    spine = c.select("conv_id").distinct()
    packed = joins.with_members(spine, c, "conv_id", ["role", "text"], ["turn"], "turns")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return packed.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("digest"))


@query(f"""WITH {SQL['clips']}, g AS ({_GRID.format(s=4, w=4)}) SELECT video_id, win_ord, '{{"is_anomaly":' || (class_name <> 'normal')::VARCHAR || ',"class_name":"' || class_name || '"}}' AS target FROM g""")
def chat_targets(spark, d):
    w = windows.sliding_windows(A.clips(spark, d), "duration")
    chats = submission.chat_examples(w.withColumn("path", F.to_json(F.struct("video_id", "win_ord"))), "system", "prompt")
    key = F.from_json("video", "video_id bigint, win_ord int")
    return chats.select(key["video_id"].alias("video_id"), key["win_ord"].alias("win_ord"), F.get("messages", F.lit(2))["content"].alias("target"))


@query(f"WITH {SQL['verdicts']}, {_EVENTS} {_OUT.replace('SELECT video_id', 'SELECT video_id::VARCHAR AS video_id')} FROM found")
def stream_hysteresis(spark, d):
    """The stream's events over the whole events table, whose rows come out of order: those emitted and those that its state holds at the end."""
    at = A.scratch(spark, "stream")
    v = A.verdicts(spark, d).select("video_id", F.col("ts").cast("timestamp").alias("at"), "start", "end", "class_name", "score")
    streams = hysteresis.explode_classes(A.arrivals(v, "verdicts"), ["click", "error", "purchase", "signup"])
    hysteresis.run_available(hysteresis.stream_events(streams, watermark="7 hours", unit=3600.0), f"{at}/out", f"{at}/state")
    found = spark.read.schema(hysteresis.EVENT).parquet(f"{at}/out").unionByName(hysteresis.remaining_events(spark, f"{at}/state"))
    return found.select("video_id", "class_name", *r6("start", "end", "score"))


@query("""WITH v AS (SELECT user_id AS video_id, epoch_us(ts) // 1000000 AS s, event_type FROM events), w AS (SELECT *, (s // 28800 - k) * 28800 AS b FROM v, range(0, 3) t(k)) -- 24 hours, every 8
SELECT video_id, b AS window_start, count(*) AS n, count(*) FILTER (event_type <> 'view') AS anomalous FROM w GROUP BY ALL""")
def hopping_counts(spark, d):
    v = A.verdicts(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    out = hysteresis.windowed_counts(v, "24 hours", "8 hours", "1 hour")
    return out.select("video_id", F.unix_seconds("window.start").alias("window_start"), "n", "anomalous")


@query("""WITH v AS (SELECT user_id AS video_id, event_type AS class_name, epoch_us(ts) AS t, value FROM events WHERE event_type <> 'view'),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 28800000000 THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY video_id, class_name ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY video_id, class_name ORDER BY t) AS isl FROM g)
SELECT video_id, class_name, min(t) AS first_us, count(*) AS n, round(max(least(1.0::DOUBLE, value / 100)), 6) AS score FROM i GROUP BY video_id, class_name, isl""")
def session_counts(spark, d):
    v = A.verdicts(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    out = hysteresis.session_counts(v, "8 hours", "1 hour")
    return out.select("video_id", "class_name", F.unix_micros("session_window.start").alias("first_us"), "n", *r6("score"))


from eventlens.plans import more, streams  # noqa: E402, F401  (register further queries)
