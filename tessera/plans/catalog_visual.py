"""Visual queries: pixel functions, routing, selectors, caps and evaluation, over the adapters' stand-ins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators import evaluate, routing, selectors, sequences
from ..sources import media
from . import adapters, reports, visual
from .adapters import sql
from .catalog import query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("sample_index")
    own = adapters.pixels(spark, sf_dir)
    return own.select("label", "vec_id", "sample_index", "gray", F.lag("gray").over(w).alias("before"), "embedding", F.lag("embedding").over(w).alias("embedding_before")).where("before is not null")


PAIRS = ", p AS (SELECT label, vec_id, gray AS g, lag(gray) OVER w AS b, embedding AS e, lag(embedding) OVER w AS eb FROM pixels WINDOW w AS (PARTITION BY label ORDER BY sample_index))"
MOMENTS = ", m AS (SELECT vec_id, list_sum(list_transform(g, lambda x: x)) AS sa, list_sum(list_transform(b, lambda x: x)) AS sb, list_dot_product(CAST(g AS DOUBLE[]), CAST(g AS DOUBLE[])) AS aa, list_dot_product(CAST(b AS DOUBLE[]), CAST(b AS DOUBLE[])) AS bb, list_dot_product(CAST(g AS DOUBLE[]), CAST(b AS DOUBLE[])) AS ab, len(g) * 1.0 AS n FROM p WHERE b IS NOT NULL)"


@query(sql("pixels", "").rstrip() + PAIRS + " SELECT vec_id, round(list_sum(list_transform(list_zip(g, b), lambda z: abs(z[1] - z[2]))) / (255.0 * len(g)), 6) AS pixel_delta FROM p WHERE b IS NOT NULL")
def pixel_delta(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(px.pixel_delta(F.col("gray"), F.col("before")), 6).alias("pixel_delta"))


@query(sql("pixels", "").rstrip() + PAIRS + MOMENTS + " SELECT vec_id, round(((2 * sa * sb / n / n + 6.5025) * (2 * (ab / n - sa * sb / n / n) + 58.5225)) / ((sa * sa / n / n + sb * sb / n / n + 6.5025) * (aa / n - sa * sa / n / n + bb / n - sb * sb / n / n + 58.5225)), 6) AS ssim FROM m")
def ssim_previous(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(px.global_ssim(F.col("gray"), F.col("before")), 6).alias("ssim"))


@query(sql("pixels", "").rstrip() + PAIRS + " SELECT vec_id, CAST(list_sum(list_transform(list_zip(e, eb), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM p WHERE b IS NOT NULL")
def phash_distance(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", px.hash_distance(px.sign_hash(F.col("embedding")), px.sign_hash(F.col("embedding_before"))).alias("distance"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 x 8 pixels as analysis frames, a source for each label."""
    own = adapters.pixels(spark, sf_dir)
    return own.select(F.format_string("label-%04d", "label").alias("video_id"), "vec_id", F.col("sample_index").alias("frame_index"), (F.col("sample_index") / 2.0).alias("t"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(F.transform("gray", lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("gray"))


@query(sql("pixels", "").rstrip() + PAIRS + " SELECT vec_id, round(list_max(list_transform(list_zip(g, b), lambda z: abs(z[1] - z[2]))) / 255.0, 6) AS block_change FROM p WHERE b IS NOT NULL")
def block_change(spark, sf_dir):
    """Images of 8 x 8 pixels have one pixel in each block."""

    @F.pandas_udf("double")
    def change(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([px.block_change(np.array(x, np.uint8).reshape(8, 8), np.array(y, np.uint8).reshape(8, 8)) for x, y in zip(a, b)])

    return _pairs(spark, sf_dir).select("vec_id", F.round(change("gray", "before"), 6).alias("block_change"))


@query(
    sql("pixels", "").rstrip() + PAIRS + MOMENTS
    + """ SELECT p.label, p.vec_id, round(CASE WHEN p.b IS NULL THEN 0.0 ELSE list_sum(list_transform(list_zip(p.g, p.b), lambda z: abs(z[1] - z[2]))) / (255.0 * len(p.g)) END, 6) AS pixel_delta,
 round(CASE WHEN p.b IS NULL THEN 1.0 ELSE ((2 * sa * sb / n / n + 6.5025) * (2 * (ab / n - sa * sb / n / n) + 58.5225)) / ((sa * sa / n / n + sb * sb / n / n + 6.5025) * (aa / n - sa * sa / n / n + bb / n - sb * sb / n / n + 58.5225)) END, 6) AS ssim_previous FROM p LEFT JOIN m USING (vec_id)"""
)
def visual_signals(spark, sf_dir):
    """The visual stage's signals; hash and edge differences have no twin in SQL."""
    own = _frames(spark, sf_dir)
    made = visual.build_samples(own.drop("vec_id"))
    named = made.join(own.select("video_id", "frame_index", "vec_id"), ["video_id", "frame_index"])
    return named.select(F.substring("video_id", 7, 9).cast("int").alias("label"), "vec_id", F.round("pixel_delta", 6).alias("pixel_delta"), F.round("ssim_previous", 6).alias("ssim_previous"))


@query(
    sql("signal", """, e AS (SELECT user_id, (max(t_us) - min(t_us)) / 1000000.0 / 43200 AS length FROM signal GROUP BY 1 HAVING max(t_us) > min(t_us)),
 g AS (SELECT user_id, length, unnest(list_transform(range(0, CAST(ceil(length - 0.000001) AS BIGINT)), lambda k: CAST(k AS DOUBLE))) AS t FROM e),
 l AS (SELECT user_id, length, max(t) AS last FROM g GROUP BY 1, 2), a AS (SELECT user_id, 0 AS tail, t FROM g UNION ALL SELECT user_id, 1, greatest(0, length - 0.5) FROM l WHERE last < length - 0.25)
 SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tail, t) - 1 AS INTEGER) AS position, round(t, 6) AS t FROM a""").replace(") , e", "), e")
)
def scan_grid(spark, sf_dir):
    """Coarse scans of sources as long as each user's events, half a day to a second, two frames a second."""
    ends = adapters.signal(spark, sf_dir).groupBy("user_id").agg(((F.max("t_us") - F.min("t_us")) / 1e6 / 43200).alias("length")).where("length > 0")
    meta = ends.select(F.col("user_id").alias("video_id"), F.lit(2.0).alias("fps"), (F.col("length") * 2).alias("frame_count"))
    return media.coarse_grid(meta, 1.0, 100_000).select(F.col("video_id").alias("user_id"), "position", F.round("t", 6).alias("t"))


UNIFORM = """, e AS (SELECT user_id, min(t_us) AS a, max(t_us) AS b FROM signal GROUP BY 1), g AS (SELECT user_id, b, unnest(range(a, b + 1, 86400000000)) AS probe FROM e),
 l AS (SELECT user_id, b, max(probe) AS last FROM g GROUP BY 1, 2), q AS (SELECT user_id, probe FROM g UNION ALL SELECT user_id, b FROM l WHERE last < b - 21600000000),
 n AS (SELECT q.user_id, s.t_us, s.sample_index, row_number() OVER (PARTITION BY q.user_id, probe ORDER BY abs(s.t_us - probe), s.t_us, s.sample_index DESC) AS k FROM q JOIN signal s USING (user_id))"""


@query(sql("signal", "").rstrip() + UNIFORM + " SELECT DISTINCT user_id, sample_index, t_us, 0.10::DOUBLE AS score FROM n WHERE k = 1")
def uniform_grid(spark, sf_dir):
    return selectors.uniform(_latest(spark, sf_dir), ["user_id"], 86_400_000_000).select("user_id", "sample_index", "t_us", "score")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with one for each time, the later one."""
    own = adapters.signal(spark, sf_dir)
    return own.groupBy("user_id", "t_us").agg(F.max_by(F.struct("sample_index", "change_score", "label"), "sample_index").alias("x")).select("user_id", "t_us", "x.*")


@query(
    sql("signal", """, o AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t_us ORDER BY sample_index DESC) AS k FROM signal) WHERE k = 1),
 c AS (SELECT user_id, t_us + CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY t_us) = 1 THEN 0 ELSE 600000 END AS probe FROM o WHERE label = 'click'),
 n AS (SELECT c.user_id, o.t_us, o.sample_index, o.change_score, row_number() OVER (PARTITION BY c.user_id, probe ORDER BY abs(o.t_us - probe), o.t_us) AS k FROM c JOIN o USING (user_id))
 SELECT user_id, sample_index, t_us, greatest(0.30, change_score) AS score FROM n WHERE k = 1""").replace(") , o", "), o")
)
def content_select(spark, sf_dir):
    own = _latest(spark, sf_dir)
    cuts = own.where("label = 'click'").select("user_id", F.col("t_us").alias("cut_us"))
    return selectors.content(own, cuts, ["user_id"]).select("user_id", "sample_index", "t_us", "score")


@query(
    sql("signal", """, s AS (SELECT *, CASE WHEN sample_index > 0 THEN change_score END AS x FROM signal),
 r AS (SELECT *, coalesce(median(x) OVER w, 0) AS baseline, change_score >= coalesce(lag(change_score) OVER o, change_score) AND change_score >= coalesce(lead(change_score) OVER o, change_score) AS peak,
  min(CASE WHEN change_score <= 0.1 THEN sample_index END) OVER (PARTITION BY user_id ORDER BY sample_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS calm FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY sample_index ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING EXCLUDE CURRENT ROW), o AS (PARTITION BY user_id ORDER BY sample_index)),
 p AS (SELECT r.user_id, r.t_us, r.change_score / greatest(0.002, r.baseline) AS ratio, z.sample_index AS settled, z.t_us AS until FROM r JOIN signal z ON z.user_id = r.user_id AND z.sample_index = coalesce(r.calm, r.sample_index)
  WHERE r.sample_index > 0 AND r.change_score >= 0.3 AND r.change_score / greatest(0.002, r.baseline) >= 1.5 AND r.peak),
 q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, until, settled, ratio) AS k FROM p),
 f AS (SELECT user_id, k, until, settled, ratio FROM q WHERE k = 1 UNION ALL SELECT n.user_id, n.k, n.until, n.settled, n.ratio FROM f, LATERAL (SELECT * FROM q WHERE q.user_id = f.user_id AND q.k > f.k AND q.t_us >= f.until + 7200000000 ORDER BY q.k LIMIT 1) n)
 SELECT user_id, settled AS sample_index, until AS t_us, round(ratio, 6) AS score FROM f""", True).replace(") , s", "), s")
)
def adaptive_select(spark, sf_dir):
    return selectors.adaptive(adapters.signal(spark, sf_dir), ["user_id"], radius=6, k=1, least_us=7_200_000_000, change=0.3, ratio=1.5, quiet=0.1).select("user_id", "sample_index", "t_us", F.round("score", 6).alias("score"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three selectors whose reasons have different ranks."""
    own = adapters.signal(spark, sf_dir)
    one = lambda where, score, reason: own.where(where).select("user_id", "sample_index", "t_us", score.alias("score"), F.array(F.lit(reason)).alias("reasons"))
    a = one("label = 'click'", F.col("change_score"), "scenedetect_content")
    b = one("change_score >= 0.2", F.col("change_score") / 2, "adaptive_change_settled")
    c = one("label = 'purchase'", F.col("change_score") / 4, "settled_after_change")
    return a.unionByName(b).unionByName(c).unionByName(one("label = 'view'", F.col("change_score"), "density_floor"))


CANDIDATES = """, c AS (SELECT user_id, sample_index, t_us, change_score AS score, 'scenedetect_content' AS reason FROM signal WHERE label = 'click' UNION ALL SELECT user_id, sample_index, t_us, change_score / 2, 'adaptive_change_settled' FROM signal WHERE change_score >= 0.2
 UNION ALL SELECT user_id, sample_index, t_us, change_score / 4, 'settled_after_change' FROM signal WHERE label = 'purchase' UNION ALL SELECT user_id, sample_index, t_us, change_score, 'density_floor' FROM signal WHERE label = 'view'),
 g AS (SELECT user_id, sample_index, min(t_us) AS t_us, max(score) AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, max(CASE reason WHEN 'settled_after_change' THEN 4 WHEN 'scenedetect_content' THEN 3 WHEN 'adaptive_change_settled' THEN 2 ELSE 1 END) AS rank FROM c GROUP BY 1, 2)"""


@query(sql("signal", "").rstrip() + CANDIDATES + " SELECT user_id, sample_index, t_us, score, reasons FROM g")
def merge_candidates(spark, sf_dir):
    return selectors.merge(_candidates(spark, sf_dir), ["user_id"]).select("user_id", "sample_index", "t_us", "score", F.array_join("reasons", ",").alias("reasons"))


RANKED = CANDIDATES + """, k AS (SELECT *, min(t_us) OVER u AS a, max(t_us) OVER u AS b, count(*) OVER u AS n FROM g WINDOW u AS (PARTITION BY user_id)),
 f AS (SELECT *, row_number() OVER (PARTITION BY user_id, least(9, ((t_us - a) * 10) // greatest(1, b - a)) ORDER BY rank DESC, score DESC, t_us DESC, sample_index) = 1 AS first FROM k),
 z AS (SELECT *, n <= 10 OR row_number() OVER (PARTITION BY user_id ORDER BY first DESC, rank DESC, score DESC, t_us DESC, sample_index) <= 10 AS kept FROM f)"""


@query(sql("signal", "").rstrip() + RANKED + " SELECT user_id, sample_index, kept FROM z")
def temporal_cap(spark, sf_dir):
    return selectors.cap(selectors.merge(_candidates(spark, sf_dir), ["user_id"]), ["user_id"], 10).select("user_id", "sample_index", "kept")


@query(sql("signal", "").rstrip() + CANDIDATES + " SELECT user_id, arg_max(sample_index, (rank, score, t_us)) AS sample_index FROM g GROUP BY 1")
def priority_top1(spark, sf_dir):
    own = selectors.merge(_candidates(spark, sf_dir), ["user_id"])
    return own.groupBy("user_id").agg(F.max_by("sample_index", selectors.priority()).alias("sample_index"))


@query(
    sql("signal", "").rstrip() + RANKED
    + """ SELECT z.user_id, count(*) AS raw_candidates, count(*) FILTER (kept) AS selected_frames, round(count(*) FILTER (kept) / greatest((any_value(e) - any_value(s)) / 60, 1e-9), 6) AS candidate_frames_per_minute, 0.0::DOUBLE AS duplicate_drop_ratio, count(*) FILTER (NOT kept) AS capped_frames
 FROM z JOIN (SELECT user_id, min(t_us) / 1000000.0 AS s, max(t_us) / 1000000.0 AS e FROM signal GROUP BY 1) USING (user_id) GROUP BY 1"""
)
def strategy_metrics(spark, sf_dir):
    """Merge, cap and count, without pixels: finalize() of a strategy whose states are distinct."""
    own = adapters.signal(spark, sf_dir)
    named = _candidates(spark, sf_dir).withColumnRenamed("user_id", "video_id")
    ledger = selectors.finalize(named, named, ["video_id"], 10, unique=False).withColumn("strategy", F.lit("merged"))
    ranges = own.groupBy(F.col("user_id").alias("video_id")).agg((F.min("t_us") / 1e6).alias("range_start"), (F.max("t_us") / 1e6).alias("range_end"))
    return visual.metrics(ledger, ranges).select(F.col("video_id").alias("user_id"), "raw_candidates", "selected_frames", F.round("candidate_frames_per_minute", 6).alias("candidate_frames_per_minute"), "duplicate_drop_ratio", "capped_frames")


@query(
    sql("signal", """, r AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM label AND sample_index > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY sample_index) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY sample_index) AS p FROM signal)),
 s AS (SELECT user_id, printf('route-%03d', CAST(run AS BIGINT)) AS segment_id, label AS kind, min(t_us) AS a, max(change_score) >= 0.5 AS held FROM r GROUP BY user_id, run, label),
 e AS (SELECT user_id, min(t_us) AS x, max(t_us) AS y FROM signal GROUP BY 1), u AS (SELECT s.*, x, greatest(1, y - x) AS span, least(coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), y), y) AS b FROM s JOIN e USING (user_id))
 SELECT user_id, segment_id, kind, round(100.0 * (a - x) / span, 4) AS "left", round(100.0 * greatest(0, b - a) / span, 4) AS width, NOT held AS empty FROM u""").replace(") , r", "), r")
)
def route_bars(spark, sf_dir):
    """The time line of runs of a label, and which of them have no sample of at least half the greatest change."""
    own = adapters.signal(spark, sf_dir).withColumn("kind", F.col("label"))
    runs = sequences.runs(own, ["user_id"], ["sample_index"], "kind", F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.max("change_score").alias("most"))
    segments = runs.withColumn("segment_id", F.format_string("route-%03d", "run_id"))
    ranges = own.groupBy("user_id").agg(F.min("t_us").alias("range_start_us"), F.max("t_us").alias("range_end_us"))
    return reports.route_bars(segments, ranges, segments.where("most >= 0.5"), ["user_id"]).select("user_id", "segment_id", "kind", "left", "width", "empty")


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("gray")
    share = lambda f: F.size(F.filter("gray", f)) / n
    return adapters.pixels(spark, sf_dir).select(
        "label", "vec_id", "sample_index", (F.aggregate("gray", F.lit(0), lambda s, x: s + x) / n + 40).alias("mean_luma"), share(lambda x: x < 110).alias("dark_ratio"), share(lambda x: x > 140).alias("bright_ratio"),
        (share(lambda x: x > 150)).alias("edge_density"), (share(lambda x: x > 160) / 4).alias("horizontal_line_ratio"), (share(lambda x: x < 90) / 4).alias("vertical_line_ratio"),
    )


@query(
    sql("pixels", """, f AS (SELECT vec_id, list_sum(gray) / len(gray) + 40 AS luma, len(list_filter(gray, lambda x: x < 110)) / len(gray) AS dark, len(list_filter(gray, lambda x: x > 140)) / len(gray) AS bright, len(list_filter(gray, lambda x: x > 150)) / len(gray) AS edge, len(list_filter(gray, lambda x: x > 160)) / len(gray) / 4 AS h, len(list_filter(gray, lambda x: x < 90)) / len(gray) / 4 AS v FROM pixels)
 SELECT vec_id, CASE WHEN dark >= 0.72 AND luma <= 100 THEN 'chart' WHEN luma >= 185 AND bright >= 0.30 AND h >= 0.008 AND edge >= 0.07 THEN 'table' WHEN luma >= 105 AND dark <= 0.60 AND h <= 0.012 AND edge <= 0.25 AND (bright <= 0.25 OR (h < 0.010 AND v < 0.008 AND edge <= 0.12 AND luma <= 235)) THEN 'presentation' ELSE 'unknown' END AS kind FROM f""").replace(") , f", "), f")
)
def route_classify(spark, sf_dir):
    return routing.classify(_layout(spark, sf_dir)).select("vec_id", F.col("raw_kind").alias("kind"))


def _up(x: str, limit: float) -> str:
    return f"least(1.0, greatest(0.0, {x} / {limit}))"


def _down(x: str, limit: float) -> str:
    return f"(CASE WHEN {x} <= {limit} THEN 1.0 ELSE greatest(0.0, 1 - ({x} - {limit}) / {limit}) END)"


#: Kinds and confidences of the 8 x 8 images in SQL.
ROUTED = (
    sql("pixels", """, f AS (SELECT label, sample_index, vec_id, list_sum(gray) / len(gray) + 40 AS luma, len(list_filter(gray, lambda x: x < 110)) / len(gray) AS dark, len(list_filter(gray, lambda x: x > 140)) / len(gray) AS bright, len(list_filter(gray, lambda x: x > 150)) / len(gray) AS edge, len(list_filter(gray, lambda x: x > 160)) / len(gray) / 4 AS h, len(list_filter(gray, lambda x: x < 90)) / len(gray) / 4 AS v FROM pixels)""", True).replace(") , f", "), f")
    + f""", w AS (SELECT *, 0.60 * {_up('dark', 0.72)} + 0.40 * {_down('luma', 100.0)} AS c, 0.25 * {_up('luma', 185.0)} + 0.20 * {_up('bright', 0.30)} + 0.25 * {_up('h', 0.008)} + 0.30 * {_up('edge', 0.07)} AS t,
 0.24 * {_up('luma', 105.0)} + 0.20 * {_down('dark', 0.60)} + 0.20 * {_down('h', 0.012)} + 0.16 * {_down('edge', 0.25)} + 0.20 * greatest({_down('bright', 0.25)}, least({_down('h', 0.010)}, {_down('v', 0.008)}, {_down('edge', 0.12)}, {_down('luma', 235.0)})) AS p,
 CASE WHEN dark >= 0.72 AND luma <= 100 THEN 'chart' WHEN luma >= 185 AND bright >= 0.30 AND h >= 0.008 AND edge >= 0.07 THEN 'table' WHEN luma >= 105 AND dark <= 0.60 AND h <= 0.012 AND edge <= 0.25 AND (bright <= 0.25 OR (h < 0.010 AND v < 0.008 AND edge <= 0.12 AND luma <= 235)) THEN 'presentation' ELSE 'unknown' END AS kind FROM f),
 k AS (SELECT label, sample_index, vec_id, kind, CASE kind WHEN 'chart' THEN c WHEN 'table' THEN t WHEN 'presentation' THEN p ELSE greatest(0.0, least(1.0, 1 - greatest(c, t, p))) END AS confidence FROM w)"""
)


@query(ROUTED + " SELECT vec_id, kind, round(confidence, 6) AS confidence FROM k")
def route_confidence(spark, sf_dir):
    return routing.classify(_layout(spark, sf_dir)).select("vec_id", F.col("raw_kind").alias("kind"), F.round("confidence", 6).alias("confidence"))


#: The first run of up to three rows between equal neighbours, of lists of kinds l and lengths n.
FIRST_BRIDGE = "list_min(list_filter(range(2, len(l)), lambda i: n[i] <= 3 AND l[i - 1] = l[i + 1]))"


def _runs(name: str, column: str, source: str) -> str:
    return f"{name} AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM {column} AND sample_index > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY sample_index) AS run FROM (SELECT *, lag({column}) OVER (PARTITION BY label ORDER BY sample_index) AS p FROM {source}))"


@query(
    ROUTED
    + f""", {_runs('r', 'kind', 'k')}, z AS (SELECT label, list(kind ORDER BY run) AS l, list(m ORDER BY run) AS n FROM (SELECT label, run, kind, count(*) AS m FROM r GROUP BY 1, 2, 3) GROUP BY 1),
 b AS (SELECT label, l, n, {FIRST_BRIDGE} AS i FROM z UNION ALL SELECT label, l, n, {FIRST_BRIDGE} FROM (SELECT label, l[1:i - 1] || l[i + 2:] AS l, n[1:i - 2] || [n[i - 1] + n[i] + n[i + 1]] || n[i + 2:] AS n FROM b WHERE i IS NOT NULL)),
 q AS (SELECT label, flatten(list_transform(range(1, len(l) + 1), lambda j: list_transform(range(n[j]), lambda x: l[j]))) AS g FROM b WHERE i IS NULL),
 d AS (SELECT k.* EXCLUDE kind, kind AS raw, g[sample_index + 1] AS bridged FROM k JOIN q USING (label)), {_runs('e', 'bridged', 'd')},
 s AS (SELECT label, sample_index, raw, CASE WHEN bridged <> 'unknown' AND count(*) OVER (PARTITION BY label, run) < 8 THEN 'unknown' ELSE bridged END AS kind, confidence FROM e), {_runs('u', 'kind', 's')}
 SELECT label, printf('route-%03d', CAST(run AS BIGINT)) AS segment_id, kind, min(sample_index) AS start_index, max(sample_index) + 1 AS stop_index, min(sample_index) * 500000 AS start_us, max(sample_index) * 500000 AS end_us,
  round(avg(CASE WHEN kind <> raw THEN 0.0 ELSE confidence END), 6) AS confidence FROM u GROUP BY label, run, kind"""
)
def content_segments(spark, sf_dir):
    own = routing.classify(_layout(spark, sf_dir)).withColumn("t_us", F.col("sample_index") * 500_000)
    return routing.content_segments(routing.smooth(own, ["label"], ["sample_index"], 2.0), ["label"], "sample_index", "t_us").select("label", "segment_id", "kind", "start_index", "stop_index", "start_us", "end_us", F.round("confidence", 6).alias("confidence"))


#: What each selector watches: slides, worksheets or boards.
SCREENS = {"settled": "slide", "boundary_terminal": "board", "table_viewport": "sheet", "table_focus": "sheet", "presentation_states": "slide"}


def _selected(name: str):
    def run(spark, sf_dir):
        own = adapters.screens(spark, sf_dir, SCREENS[name]).withColumnRenamed("frame_index", "sample_index")
        return selectors.select_clips(own, ["video_id"], name, 1.0).select("video_id", "sample_index", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))

    run.__name__ = f"select_{name}"
    return query()(run)


for _name in selectors.STRATEGIES:
    _selected(_name)


@query()
def dedup_window6(spark, sf_dir):
    """Every frame of the slides as a candidate, against the last six that were kept."""
    own = adapters.screens(spark, sf_dir, "slide").withColumns({"sample_index": F.col("frame_index"), "t_us": F.rint(F.col("t") * 1e6).cast("long")})
    found = selectors.merge(own.select("video_id", "sample_index", "t_us", F.lit(0.1).alias("score"), F.array(F.lit("sampled")).alias("reasons")), ["video_id"])
    return selectors.deduplicate(found, own, ["video_id"]).select("video_id", "sample_index", "status", "duplicate_of_us", "phash_distance", F.round("ssim", 6).alias("ssim"), F.round("block_change", 6).alias("block_change"))


@query()
def visual_stage(spark, sf_dir):
    """The whole visual stage over the slides: signals, five strategies, de-duplication, cap and statuses."""
    samples = visual.build_samples(adapters.screens(spark, sf_dir, "slide")).persist()  # every strategy reads them
    ranges = samples.groupBy("video_id").agg(F.min("t").alias("range_start"), F.max("t").alias("range_end"))
    p = visual.Parameters(strategies=("uniform", "content", "adaptive", "settled", "hybrid"), rate=1.0)
    return visual.run_visual(samples, visual.scene_cuts(samples, p), ranges, p)["ledger"].select("video_id", "strategy", "sample_index", "t_us", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"), "status")


@query()
def match_points(spark, sf_dir):
    own = adapters.signal(spark, sf_dir).withColumn("t", F.col("t_us") / 1e6)
    points = own.where("label = 'purchase'").select("user_id", F.col("event_id").alias("point_id"), "t", (F.col("t") - 1800).alias("low"), (F.col("t") + 1800).alias("high"))
    return evaluate.match(points, own.where("label = 'click'").select("user_id", "t"), ["user_id"])


@query()
def selection_quality(spark, sf_dir):
    own = adapters.signal(spark, sf_dir).withColumn("t", F.col("t_us") / 1e6)
    found = own.where("label = 'click'").select("user_id", "t")
    return evaluate.selection_quality(match_points(spark, sf_dir), found, ["user_id"])


@query(sql("signal", "SELECT a.user_id, a.event_id AS window_id, count(b.event_id) AS selected, count(b.event_id) <= 1 AS ok FROM signal a LEFT JOIN signal b ON b.user_id = a.user_id AND b.label = 'click' AND b.t_us BETWEEN a.t_us AND a.t_us + 3600000000 WHERE a.label = 'purchase' GROUP BY 1, 2"))
def duplicate_windows(spark, sf_dir):
    own = adapters.signal(spark, sf_dir)
    windows = own.where("label = 'purchase'").select("user_id", F.col("event_id").alias("window_id"), F.col("t_us").alias("start_us"), (F.col("t_us") + 3_600_000_000).alias("end_us"), F.lit(1).alias("most"))
    return evaluate.duplicate_windows(windows, own.where("label = 'click'"), ["user_id"]).select("user_id", "window_id", "selected", "ok")
