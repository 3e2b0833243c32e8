"""All queries of the evidence engine by name, each over whole tables, with their SQL twins.

The supplied tables stand in for ledgers as plans.adapters says. A query is a thin application
of an operator; queries without a twin are sequential programmes, tested against fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, textual
from ..functions import time as clock
from ..operators import chapters, evaluate, joins, routing, sequences, speech
from ..session import table
from . import adapters
from .adapters import sql

QUERIES: dict = {}
SQL: dict = {}


def query(twin: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


# ---- alignment ---------------------------------------------------------------------------

STATUS = """, linked AS (SELECT f.conv_id, f.frame_id, f.t_us, s.speech_id, CASE WHEN r.range_end_us IS NULL OR f.t_us < r.range_start_us OR f.t_us >= r.range_end_us THEN 'outside_asr_range'
 WHEN s.speech_id IS NULL THEN 'inside_asr_range_no_segment' ELSE 'segment_at_timestamp' END AS status
 FROM frames f LEFT JOIN speech s ON s.conv_id = f.conv_id AND f.t_us >= s.start_us AND f.t_us < s.end_us LEFT JOIN ranges r ON r.conv_id = f.conv_id)"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.align_points(adapters.frames(spark, sf_dir), adapters.speech(spark, sf_dir).drop("text"), ["conv_id"], adapters.speech_ranges(spark, sf_dir))


@query(sql("speech ranges frames", "").rstrip() + STATUS + " SELECT status, count(DISTINCT frame_id) AS frames, count(speech_id) AS links FROM linked GROUP BY 1")
def align_point_in_segment(spark, sf_dir):
    return _aligned(spark, sf_dir).groupBy("status").agg(F.count_distinct("frame_id").alias("frames"), F.count("speech_id").alias("links"))


@query(sql("speech ranges frames", "").rstrip() + STATUS + " SELECT conv_id, frame_id, speech_id, 'segment_contains_frame' AS relation FROM linked WHERE speech_id IS NOT NULL")
def align_links(spark, sf_dir):
    return _aligned(spark, sf_dir).where("speech_id is not null").select("conv_id", "frame_id", "speech_id", F.lit("segment_contains_frame").alias("relation"))


@query(
    sql("speech ranges frames", ", w AS (SELECT f.*, greatest(t_us - 20000000, range_start_us) AS ws, least(t_us + 20000000, range_end_us) AS we FROM frames f JOIN ranges USING (conv_id))").replace(") , w", "), w")
    + """ SELECT conv_id, relation, count(*) AS n, CAST(sum(gap_us) AS BIGINT) AS gap_us FROM (SELECT w.conv_id, CASE WHEN end_us <= t_us THEN 'before' WHEN start_us > t_us THEN 'after' ELSE 'overlaps' END AS relation,
 CASE WHEN end_us <= t_us THEN t_us - end_us WHEN start_us > t_us THEN start_us - t_us ELSE 0 END AS gap_us FROM w JOIN speech s ON s.conv_id = w.conv_id AND end_us > ws AND start_us < we WHERE we > ws) GROUP BY 1, 2"""
)
def align_nearby_window(spark, sf_dir):
    near = joins.nearby_speech(adapters.frames(spark, sf_dir), adapters.speech(spark, sf_dir).drop("text"), ["conv_id"], adapters.speech_ranges(spark, sf_dir))
    return near.groupBy("conv_id", "relation").agg(F.count("*").alias("n"), F.sum("gap_us").alias("gap_us"))


@query(
    sql("speech frames", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t_us, k, event_id) AS BIGINT) AS position, event_id, kind, t_us FROM (
 SELECT conv_id, 0 AS k, 'visual' AS kind, printf('visual-%04d', row_number() OVER (PARTITION BY conv_id ORDER BY t_us, frame_id)) AS event_id, t_us FROM frames UNION ALL
 SELECT conv_id, 1, 'speech', printf('speech-%04d', row_number() OVER (PARTITION BY conv_id ORDER BY start_us, speech_id)), start_us FROM speech)""")
)
def align_timeline_union(spark, sf_dir):
    own = joins.timeline(adapters.frames(spark, sf_dir).withColumnRenamed("frame_id", "sample_index"), adapters.speech(spark, sf_dir), ["conv_id"])
    w = Window.partitionBy("conv_id").orderBy("t_us", "k", "event_id")
    return own.select("conv_id", F.row_number().over(w).cast("long").alias("position"), "event_id", "kind", "t_us")


@query(
    sql("speech", """, a AS (SELECT conv_id, speech_id AS anchor_id, start_us, end_us, text AS expected_span, lag(text) OVER (PARTITION BY conv_id ORDER BY speech_id) AS baseline_span FROM speech),
 p AS (SELECT a.conv_id, a.anchor_id, contains(s.text, expected_span) AS e, contains(s.text, baseline_span) AS b, s.end_us >= a.start_us - 750000 AND s.start_us <= a.end_us + 750000 AS near FROM a JOIN speech s USING (conv_id))
 SELECT conv_id, anchor_id, CASE WHEN bool_or(e AND near) THEN 'expected_exact' WHEN bool_or(b AND near) THEN 'baseline_error_persists' ELSE 'other_output' END AS outcome, count(*) FILTER (near) AS near, count(*) FILTER (e AND NOT near) AS off_anchor FROM p GROUP BY 1, 2""").replace(") , a AS", "), a AS")
)
def anchor_closed_window(spark, sf_dir):
    own = adapters.speech(spark, sf_dir)
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("speech_id"))
    anchors = own.select("conv_id", F.col("speech_id").alias("anchor_id"), "start_us", "end_us", F.col("text").alias("expected_span"), before.alias("baseline_span"))
    return evaluate.anchor_scores(anchors, own, ["conv_id"]).select("conv_id", "anchor_id", "outcome", "near", "off_anchor")


@query(
    sql("speech", """SELECT a.conv_id, a.speech_id, coalesce(string_agg(b.text, ' ' ORDER BY b.start_us, b.speech_id), '') AS window_text FROM speech a LEFT JOIN speech b ON b.conv_id = a.conv_id AND b.end_us > a.start_us - 5000000 AND b.start_us < a.start_us GROUP BY 1, 2""")
)
def window_text_overlap(spark, sf_dir):
    own = adapters.speech(spark, sf_dir)
    windows = own.select("conv_id", "speech_id", (F.col("start_us") - 5_000_000).alias("ws"), F.col("start_us").alias("we"))
    return joins.window_text(windows, own.withColumnsRenamed({"speech_id": "sid"}), ["conv_id"], ["speech_id"], ["start_us", "sid"]).select("conv_id", "speech_id", "window_text")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = adapters.signal(spark, sf_dir).groupBy("user_id").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    return ends.select("user_id", F.explode(F.sequence("a", "b", F.lit(86_400_000_000))).alias("probe_us"))


GRID = ", g AS (SELECT user_id, unnest(range(a, b + 1, 86400000000)) AS probe_us FROM (SELECT user_id, min(t_us) AS a, max(t_us) AS b FROM signal GROUP BY 1))"


@query(sql("signal", "").rstrip() + GRID + " SELECT g.user_id, probe_us, max(t_us) AS t_us, max_by(sample_index, (t_us, sample_index)) AS sample_index FROM g JOIN signal s ON s.user_id = g.user_id AND s.t_us <= probe_us GROUP BY 1, 2")
def asof_sample(spark, sf_dir):
    last = adapters.signal(spark, sf_dir).groupBy("user_id", "t_us").agg(F.max("sample_index").alias("sample_index"))
    return joins.as_of(_grid(spark, sf_dir), last, ["user_id"], "probe_us", "t_us", ["sample_index"])


@query(sql("signal", "").rstrip() + GRID + " SELECT user_id, probe_us, t_us, sample_index FROM (SELECT g.user_id, probe_us, t_us, sample_index, row_number() OVER (PARTITION BY g.user_id, probe_us ORDER BY abs(t_us - probe_us), t_us, sample_index DESC) AS k FROM g JOIN signal s ON s.user_id = g.user_id) WHERE k = 1")
def nearest_sample(spark, sf_dir):
    last = adapters.signal(spark, sf_dir).groupBy("user_id", "t_us").agg(F.max("sample_index").alias("sample_index"))
    return joins.nearest(_grid(spark, sf_dir), last, ["user_id"], "probe_us", "t_us", ["sample_index"])


@query(sql("speech ranges frames", "").rstrip() + STATUS + """, x AS (SELECT DISTINCT conv_id, speech_id FROM linked WHERE speech_id IS NOT NULL)
 SELECT CASE WHEN x.speech_id IS NULL THEN 'missing_left' WHEN s.speech_id IS NULL THEN 'missing_right' ELSE 'matched' END AS status, count(*) AS n FROM x FULL JOIN speech s ON x.conv_id = s.conv_id AND x.speech_id = s.speech_id GROUP BY 1""")
def one_to_one_status(spark, sf_dir):
    """Speech that a frame links to, against all speech."""
    key = F.concat_ws(":", "conv_id", "speech_id").alias("key")
    seen = _aligned(spark, sf_dir).where("speech_id is not null").select(key).distinct()
    return joins.one_to_one(seen, adapters.speech(spark, sf_dir).select(key), "key").groupBy("status").agg(F.count("*").alias("n"))


# ---- sequences ---------------------------------------------------------------------------

RUNS = ", r AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM label AND sample_index > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY sample_index) AS run_id FROM (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY sample_index) AS p FROM signal))"


@query(sql("signal", "").rstrip() + RUNS + " SELECT user_id, CAST(run_id AS BIGINT) AS run_id, label, count(*) AS length, min(sample_index) AS first_index, max(sample_index) + 1 AS stop_index FROM r GROUP BY 1, 2, 3")
def label_runs(spark, sf_dir):
    return sequences.runs(adapters.signal(spark, sf_dir), ["user_id"], ["sample_index"], "label", F.min("sample_index").alias("first_index"), (F.max("sample_index") + 1).alias("stop_index"))


@query(sql("signal", "").rstrip() + RUNS + " SELECT user_id, sample_index, CASE WHEN count(*) OVER (PARTITION BY user_id, run_id) < 2 THEN 'unknown' ELSE label END AS label FROM r")
def short_known(spark, sf_dir):
    return sequences.short_known(adapters.signal(spark, sf_dir), ["user_id"], ["sample_index"], "label", 2).select("user_id", "sample_index", "label")


#: The first run of one row between equal neighbours, of lists of labels l and lengths n.
FIRST_BRIDGE = "list_min(list_filter(range(2, len(l)), lambda i: n[i] <= 1 AND l[i - 1] = l[i + 1]))"


@query(
    (sql("signal", "", True).rstrip() + RUNS)
    + f""", z AS (SELECT user_id, list(label ORDER BY run_id) AS l, list(k ORDER BY run_id) AS n FROM (SELECT user_id, run_id, label, count(*) AS k FROM r GROUP BY 1, 2, 3) GROUP BY 1),
 f AS (SELECT user_id, l, n, {FIRST_BRIDGE} AS i FROM z UNION ALL
  SELECT user_id, l, n, {FIRST_BRIDGE} FROM (SELECT user_id, l[1:i - 1] || l[i + 2:] AS l, n[1:i - 2] || [n[i - 1] + n[i] + n[i + 1]] || n[i + 2:] AS n FROM f WHERE i IS NOT NULL)),
 q AS (SELECT user_id, flatten(list_transform(range(1, len(l) + 1), lambda k: list_transform(range(n[k]), lambda x: l[k]))) AS b FROM f WHERE i IS NULL)
 SELECT s.user_id, s.sample_index, s.label, b[s.sample_index + 1] AS bridged FROM signal s JOIN q USING (user_id)"""
)
def bridge_runs(spark, sf_dir):
    return sequences.bridge(adapters.signal(spark, sf_dir), ["user_id"], ["sample_index"], "label", 1).select("user_id", "sample_index", "label", "bridged")


@query(sql("signal", "").rstrip() + RUNS + " SELECT user_id, label AS kind, CAST(sum(until - start_us) AS BIGINT) AS duration_us FROM (SELECT *, coalesce(lead(start_us) OVER (PARTITION BY user_id ORDER BY start_us, first), end_us) AS until FROM (SELECT user_id, run_id, label, min(t_us) AS start_us, max(t_us) AS end_us, min(sample_index) AS first FROM r GROUP BY 1, 2, 3)) GROUP BY 1, 2")
def content_segment_durations(spark, sf_dir):
    runs = sequences.runs(adapters.signal(spark, sf_dir).withColumn("kind", F.col("label")), ["user_id"], ["sample_index"], "kind", F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"))
    return routing.duration_by_kind(runs, ["user_id"], F.col("end_us"))


@query(sql("signal", "SELECT user_id, sample_index, round(coalesce(median(s) OVER w, 0), 6) AS baseline, change_score >= coalesce(lag(change_score) OVER o, change_score) AND change_score >= coalesce(lead(change_score) OVER o, change_score) AS local_peak FROM (SELECT *, CASE WHEN sample_index > 0 THEN change_score END AS s FROM signal) WINDOW w AS (PARTITION BY user_id ORDER BY sample_index ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING EXCLUDE CURRENT ROW), o AS (PARTITION BY user_id ORDER BY sample_index)"))
def adaptive_ratio(spark, sf_dir):
    return sequences.adaptive_ratio(adapters.signal(spark, sf_dir), ["user_id"], ["sample_index"], "change_score", 6).select("user_id", "sample_index", F.round("baseline", 6).alias("baseline"), "local_peak")


@query(sql("signal", ", e AS (SELECT *, sum(CASE WHEN change_score <= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sample_index ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS calm FROM signal) SELECT user_id, sample_index, coalesce(min(CASE WHEN calm THEN sample_index END) OVER (PARTITION BY user_id ORDER BY sample_index ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING), sample_index) AS settled_index FROM e").replace(") , e", "), e"))
def settled_index(spark, sf_dir):
    return sequences.first_stable(adapters.signal(spark, sf_dir), ["user_id"], ["sample_index"], "change_score", "sample_index", 2, 0.1).select("user_id", "sample_index", "settled_index")


@query(sql("signal", "SELECT user_id, cluster_id, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM (SELECT user_id, t_us, CAST(sum(CASE WHEN t_us - p <= 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY sample_index) AS BIGINT) AS cluster_id FROM (SELECT *, lag(t_us) OVER (PARTITION BY user_id ORDER BY sample_index) AS p FROM signal)) GROUP BY 1, 2"))
def gap_clusters(spark, sf_dir):
    own = sequences.gap_clusters(adapters.signal(spark, sf_dir), ["user_id"], "t_us", ["sample_index"], 3_600_000_000)
    return own.groupBy("user_id", "cluster_id").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query(sql("signal", ", f AS (SELECT user_id, t_us, sample_index FROM signal WHERE sample_index = 0 UNION ALL SELECT n.user_id, n.t_us, n.sample_index FROM f, LATERAL (SELECT s.user_id, s.t_us, s.sample_index FROM signal s WHERE s.user_id = f.user_id AND s.t_us >= f.t_us + 21600000000 ORDER BY s.sample_index LIMIT 1) n) SELECT user_id, t_us, sample_index FROM f", True).replace(") , f", "), f"))
def greedy_min_gap(spark, sf_dir):
    return sequences.greedy_gap(adapters.signal(spark, sf_dir), ["user_id"], "t_us", 21_600_000_000, "sample_index")


@query(
    sql("signal", """, f AS (SELECT user_id, sample_index, t_us, change_score, sample_index AS shown, t_us AS shown_us, change_score AS shown_score, false AS closed, 0 AS closed_index FROM signal WHERE sample_index = 0
  UNION ALL SELECT s.user_id, s.sample_index, s.t_us, s.change_score, CASE WHEN s.t_us - f.shown_us >= 43200000000 OR s.change_score > f.shown_score THEN s.sample_index ELSE f.shown END,
  CASE WHEN s.t_us - f.shown_us >= 43200000000 OR s.change_score > f.shown_score THEN s.t_us ELSE f.shown_us END, CASE WHEN s.t_us - f.shown_us >= 43200000000 OR s.change_score > f.shown_score THEN s.change_score ELSE f.shown_score END,
  s.t_us - f.shown_us >= 43200000000, f.shown FROM f JOIN signal s ON s.user_id = f.user_id AND s.sample_index = f.sample_index + 1),
 k AS (SELECT user_id, closed_index AS i FROM f WHERE closed UNION ALL SELECT user_id, arg_max(shown, sample_index) FROM f GROUP BY 1)
 SELECT s.user_id, s.t_us, s.change_score FROM k JOIN signal s ON s.user_id = k.user_id AND s.sample_index = k.i""", True).replace(") , f", "), f")
)
def collapse_candidates(spark, sf_dir):
    return sequences.collapse(adapters.signal(spark, sf_dir), ["user_id"], "t_us", "change_score", 43_200_000_000)


# ---- speech and text ---------------------------------------------------------------------

@query(sql("speech", "SELECT conv_id, speech_id, CAST(start_us AS DOUBLE) / 1000000 AS absolute_start_seconds, least(CAST(end_us AS DOUBLE) / 1000000, CAST(m AS DOUBLE) / 1000000) AS absolute_end_seconds, CAST(CAST(end_us AS DOUBLE) / 1000000 > CAST(m AS DOUBLE) / 1000000 AS INTEGER) AS clamp_count FROM (SELECT *, max(end_us) OVER (PARTITION BY conv_id) - 500000 AS m FROM speech)"))
def asr_normalise(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    own = adapters.speech(spark, sf_dir).select("conv_id", "speech_id", "text", (F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"), ((F.max("end_us").over(w) - 500_000) / 1e6).alias("audio_seconds"), F.lit(0.0).alias("range_start"), F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>").alias("words"))
    return speech.normalise(own).select("conv_id", "speech_id", "absolute_start_seconds", "absolute_end_seconds", "clamp_count")


@query(
    """WITH d AS (SELECT source, doc_id, text, regexp_replace(text, '[\\s\\x0b\\x85\\p{Z}]+', '', 'g') AS t, trim(regexp_replace(text, '[\\s\\x0b\\x85\\p{Z}]+', ' ', 'g')) AS c FROM documents),
 g AS (SELECT source, doc_id, substr(t, p, 32) AS gram, min(p) AS first, max(p) AS last FROM (SELECT source, doc_id, t, unnest(range(1, length(t) - 30)) AS p FROM d WHERE length(t) >= 64) GROUP BY 1, 2, 3),
 h AS (SELECT source, count(DISTINCT doc_id) AS n FROM g WHERE last - first >= 32 GROUP BY 1),
 r AS (SELECT source, c, sum(CASE WHEN p = c THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM (SELECT source, doc_id, c, lag(c) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM d)),
 i AS (SELECT source, count(*) AS n FROM (SELECT source, run, c FROM r WHERE length(c) > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1)
 SELECT d.source, count(*) AS segments, CAST(sum(length(text) - length(replace(text, chr(65533), ''))) AS BIGINT) AS replacement_marks, any_value(coalesce(i.n, 0)) AS identical_runs, any_value(coalesce(h.n, 0)) AS repeated_grams,
 sum(length(text) - length(replace(text, chr(65533), ''))) = 0 AND any_value(coalesce(i.n, 0)) = 0 AND any_value(coalesce(h.n, 0)) = 0 AS passed FROM d LEFT JOIN i USING (source) LEFT JOIN h USING (source) GROUP BY 1"""
)
def quality_gate(spark, sf_dir):
    return speech.quality_gate(table(spark, sf_dir, "documents"), ["source"], ["doc_id"]).select("source", "segments", "replacement_marks", "identical_runs", "repeated_grams", "passed")


@query(sql("lines", "SELECT doc_id, line, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS norm FROM lines"))
def normalise_text(spark, sf_dir):
    return adapters.lines(spark, sf_dir).select("doc_id", "line", textual.normalise(F.col("text")).alias("norm"))


COSINE = """, n AS (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM documents),
b AS (SELECT doc_id, k, sum(w) AS w FROM (SELECT doc_id, '2:' || substr(t, p, 2) AS k, 100 AS w FROM (SELECT doc_id, t, unnest(range(1, length(t))) AS p FROM n) UNION ALL SELECT doc_id, '3:' || substr(t, p, 3), 135 FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS p FROM n) UNION ALL
 SELECT doc_id, 'word:' || x, 150 FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]{2,}')) AS x FROM n)) GROUP BY 1, 2),
m AS (SELECT doc_id, sum(w * w) AS s FROM b GROUP BY 1)"""


@query("WITH p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS q FROM documents)" + COSINE + " SELECT p.doc_id, round(CASE WHEN any_value(x.s) IS NULL OR any_value(y.s) IS NULL THEN 0 ELSE least(1, coalesce(sum(a.w * c.w), 0) / (sqrt(any_value(x.s)) * sqrt(any_value(y.s)))) END, 6) AS similarity FROM p LEFT JOIN m x ON x.doc_id = p.doc_id LEFT JOIN m y ON y.doc_id = p.q LEFT JOIN b a ON a.doc_id = p.doc_id LEFT JOIN b c ON c.doc_id = p.q AND c.k = a.k WHERE q IS NOT NULL GROUP BY 1")
def cosine_adjacent(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    own = table(spark, sf_dir, "documents").withColumn("_n", textual.normalise(F.col("text"))).select("doc_id", F.col("_n").alias("b"), F.lag("_n").over(w).alias("a")).where("a is not null")
    return chapters.cosine(own, "a", "b").select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, CASE WHEN t ~ '^the.*' THEN 0.9 WHEN regexp_matches(t, '^(in|of|and)') THEN 0.84 WHEN contains(t, 'tion') THEN 0.6 ELSE 0.0 END::DOUBLE AS score, concat_ws(',', CASE WHEN starts_with(t, 'the') THEN 'opens_with_article' END, CASE WHEN contains(t, 'tion') THEN 'abstract_noun' END, CASE WHEN regexp_matches(t, '^(in|of|and)') THEN 'continues' END) AS names FROM (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM documents)")
def discourse_cues(spark, sf_dir):
    cue = textual.cues(textual.normalise(F.col("text")), lexicon.LATIN_CUES)
    return table(spark, sf_dir, "documents").select("doc_id", cue["score"].alias("score"), F.array_join(cue["names"], ",").alias("names"))


@query("SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'c': -(length(text) - length(replace(text, '{t}', ''))) // {len(t)}, 'i': {i}, 't': '{t}'}}" for i, t in enumerate(lexicon.LATIN_TERMS)) + "], lambda x: x.c < 0)), lambda x: x.t), ',') AS terms FROM documents")
def keyword_rank(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", textual.keywords(F.col("text"), lexicon.LATIN_TERMS, len(lexicon.LATIN_TERMS)).alias("k"))
    return own.select("doc_id", F.array_join(F.filter("k", lambda x: x.isin(*lexicon.LATIN_TERMS)), ",").alias("terms"))


@query()
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textual.keywords(F.col("text"), lexicon.LATIN_TERMS, 8).alias("keywords"))


@query(sql("lines", """, o AS (SELECT doc_id, trim(text) AS text, y, width, confidence, length(lower(regexp_replace(trim(text), '[^\\p{L}\\p{N}]', '', 'g'))) AS n FROM lines)
 SELECT doc_id, text AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -(0.20 * confidence + 0.55 * greatest(0.0, 1.0 - y) + 0.25 * least(1.0, width)), y, -width, -n, text) AS k FROM o WHERE n BETWEEN 4 AND 80 AND y <= 0.36 AND width >= 0.1 AND confidence >= 0.25) WHERE k = 1""").replace(") , o", "), o"))
def title_top1(spark, sf_dir):
    return chapters.title_lines(adapters.lines(spark, sf_dir), ["doc_id"]).select("doc_id", "title")


@query()
def changed_titles(spark, sf_dir):
    titles = chapters.title_lines(adapters.lines(spark, sf_dir), ["doc_id"]).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return chapters.changed_titles(titles, ["source"], ["doc_id"]).select("source", "doc_id", "title")


@query("SELECT sha256(text) AS text_sha256, count(*) AS n, count(*) > 1 AS repeated FROM documents GROUP BY 1")
def content_hash_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("n"), (F.count("*") > 1).alias("repeated"))


@query(sql("speech", "SELECT conv_id, speech_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS timecode FROM (SELECT conv_id, speech_id, CAST(round_even(start_us / 1000.0, 0) AS BIGINT) AS ms FROM speech)"))
def timecode_format(spark, sf_dir):
    return adapters.speech(spark, sf_dir).select("conv_id", "speech_id", clock.timecode(F.col("start_us")).alias("timecode"))


# ---- chapters ----------------------------------------------------------------------------

def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.scored(chapters.boundary_features(adapters.speech(spark, sf_dir), ["conv_id"], patterns=lexicon.LATIN_CUES))


#: Novelty, discourse and pause of each speech event but the first, in SQL.
FEATURES = (
    sql("speech ranges", """, n AS (SELECT *, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS t, lag(end_us) OVER w AS before, lead(text) OVER w AS next, row_number() OVER w AS k FROM speech WINDOW w AS (PARTITION BY conv_id ORDER BY start_us, speech_id)),
 c AS (SELECT *, lower(regexp_replace(concat_ws(' ', text, next), '[^\\p{L}\\p{N}]', '', 'g')) AS two FROM n WHERE k > 1),
 s AS (SELECT c.conv_id, c.speech_id, 0 AS side, string_agg(n.text, ' ' ORDER BY n.start_us, n.speech_id) AS t FROM c JOIN n ON n.conv_id = c.conv_id AND n.end_us > c.start_us - 45000000 AND n.start_us < c.start_us GROUP BY 1, 2 UNION ALL
  SELECT c.conv_id, c.speech_id, 1, string_agg(n.text, ' ' ORDER BY n.start_us, n.speech_id) FROM c JOIN n ON n.conv_id = c.conv_id AND n.end_us > c.start_us AND n.start_us < c.start_us + 45000000 GROUP BY 1, 2),
 q AS (SELECT conv_id, speech_id, side, lower(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM s),
 b AS (SELECT conv_id, speech_id, side, k, sum(w) AS w FROM (SELECT conv_id, speech_id, side, '2:' || substr(t, p, 2) AS k, 100 AS w FROM (SELECT *, unnest(range(1, length(t))) AS p FROM q) UNION ALL SELECT conv_id, speech_id, side, '3:' || substr(t, p, 3), 135 FROM (SELECT *, unnest(range(1, length(t) - 1)) AS p FROM q) UNION ALL
  SELECT conv_id, speech_id, side, 'word:' || x, 150 FROM (SELECT conv_id, speech_id, side, unnest(regexp_extract_all(t, '[a-z0-9]{2,}')) AS x FROM q)) GROUP BY 1, 2, 3, 4),
 e AS (SELECT conv_id, speech_id, k, sum(CASE WHEN side = 0 THEN w ELSE 0 END) AS l, sum(CASE WHEN side = 1 THEN w ELSE 0 END) AS r FROM b GROUP BY 1, 2, 3),
 d AS (SELECT conv_id, speech_id, sum(l * r) AS dot, sum(l * l) AS ll, sum(r * r) AS rr FROM e GROUP BY 1, 2)
,
 x AS (SELECT c.conv_id, c.speech_id, c.start_us, round(1 - CASE WHEN coalesce(ll, 0) = 0 OR coalesce(rr, 0) = 0 THEN 0 ELSE least(1, dot / (sqrt(ll) * sqrt(rr))) END, 6) AS novelty,
 CASE WHEN starts_with(two, 'the') THEN 0.9 WHEN regexp_matches(two, '^(in|of|and)') THEN 0.84 WHEN contains(two, 'tion') THEN 0.6 ELSE 0 END::DOUBLE AS discourse, round(least(1.0, greatest(0, start_us - before) / 1500000.0), 6)::DOUBLE AS pause FROM c LEFT JOIN d USING (conv_id, speech_id))""", True).replace(") , n AS", "), n AS")
)


@query(FEATURES + " SELECT conv_id, speech_id, novelty, discourse, pause FROM x")
def boundary_features(spark, sf_dir):
    return _candidates(spark, sf_dir).select("conv_id", "speech_id", "novelty", "discourse", "pause")


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = adapters.speech_ranges(spark, sf_dir)
    marks = chapters.boundaries(_candidates(spark, sf_dir), ranges, ["conv_id"], least=30.0, target=120.0, most=300.0)
    return chapters.chapters(marks, ranges, ["conv_id"])


#: Lists of (time, score) folded as the operator does: what is within 18 s of the last is one with it, the rest is 30 s apart.
FOLD = "list_reduce(list_transform({0}, lambda q: [q]), lambda a, q: CASE WHEN q[1].t - a[-1].t >= {1} THEN a || q WHEN q[1].s > a[-1].s THEN a[1:len(a) - 1] || q ELSE a END)"
#: The first stretch between two boundaries that is longer than 300 s.
GAP = "list_min(list_filter(range(1, len(m)), lambda j: m[j + 1] - m[j] > 300.000001))"


#: The chosen boundaries: rows o(conv_id, forced, t).
BOUNDARIES = (
    FEATURES
    + f""", y AS (SELECT x.conv_id, start_us, start_us / 1000000.0 AS t, round(0.44 * novelty + 0.25 * discourse + 0.11 * pause, 6) AS s, range_end_us / 1000000.0 AS e, start_us / 1000000.0 BETWEEN 30 AND range_end_us / 1000000.0 - 30 AND (discourse >= 0.90 OR (novelty >= 0.97 AND pause >= 0.45)) AS fits FROM x JOIN ranges USING (conv_id)),
 l AS (SELECT conv_id, e, list({{'t': t, 's': s}} ORDER BY t) FILTER (fits) AS v FROM y GROUP BY 1, 2),
 g AS (SELECT conv_id, e, {FOLD.format('v', 18)} AS v FROM l WHERE len(v) > 0), h AS (SELECT conv_id, e, {FOLD.format('v', 30)} AS v FROM g),
 k AS (SELECT l.conv_id, l.e, [0.0] || coalesce(list_transform(h.v, lambda q: q.t), []) || [l.e] AS m FROM l LEFT JOIN h USING (conv_id)),
 f AS (SELECT conv_id, e, m, []::DOUBLE[] AS forced, {GAP} AS i FROM k UNION ALL SELECT conv_id, e, m, forced, {GAP} FROM (
  SELECT f.conv_id, f.e, list_sort(f.m || [b.t]) AS m, f.forced || [b.t] AS forced FROM f, LATERAL (SELECT y.t FROM y WHERE y.conv_id = f.conv_id AND y.t BETWEEN f.m[f.i] + 30 AND f.m[f.i + 1] - 30
   ORDER BY y.s - abs(y.t - least(f.m[f.i] + 120, f.m[f.i + 1] - 30)) / 300 DESC, abs(y.t - least(f.m[f.i] + 120, f.m[f.i + 1] - 30)), y.t LIMIT 1) b WHERE f.i IS NOT NULL)),
 o AS (SELECT conv_id, forced, unnest(m[2:len(m) - 1]) AS t FROM f WHERE i IS NULL)"""
)


@query(BOUNDARIES + " SELECT conv_id, CAST(round(t * 1000000) AS BIGINT) AS start_us, list_contains(forced, t) AS forced FROM o")
def boundary_select(spark, sf_dir):
    return chapters.boundaries(_candidates(spark, sf_dir), adapters.speech_ranges(spark, sf_dir), ["conv_id"], least=30.0, target=120.0, most=300.0)


@query(
    BOUNDARIES
    + """, st AS (SELECT conv_id, 0 AS start_us, false AS forced FROM ranges UNION ALL SELECT conv_id, CAST(round(t * 1000000) AS BIGINT), list_contains(forced, t) FROM o),
 ch AS (SELECT st.*, printf('chapter-%03d', row_number() OVER w) AS chapter_id, coalesce(lead(start_us) OVER w, range_end_us) AS end_us FROM st JOIN ranges USING (conv_id) WINDOW w AS (PARTITION BY st.conv_id ORDER BY start_us))
 SELECT ch.conv_id, chapter_id, ch.start_us, ch.end_us, forced, string_agg(sp.speech_id, ',' ORDER BY sp.start_us, sp.speech_id) AS speech_ids FROM ch LEFT JOIN speech sp ON sp.conv_id = ch.conv_id AND sp.start_us >= ch.start_us AND sp.start_us < ch.end_us GROUP BY 1, 2, 3, 4, 5"""
)
def chapter_spans(spark, sf_dir):
    parts = _chapters(spark, sf_dir)
    held = chapters.assign(adapters.speech(spark, sf_dir), parts, ["conv_id"], t="start_us")
    ids = held.groupBy("conv_id", "chapter_id").agg(F.array_sort(F.collect_list(F.struct("start_us", "speech_id"))).alias("x"))
    own = parts.join(ids, ["conv_id", "chapter_id"], "left")
    return own.select("conv_id", "chapter_id", "start_us", "end_us", "forced", F.array_join(F.transform("x", lambda x: x["speech_id"].cast("string")), ",").alias("speech_ids"))


@query()
def chapter_ledger(spark, sf_dir):
    own = chapters.chapter_texts(adapters.speech(spark, sf_dir), _chapters(spark, sf_dir), ["conv_id"], lexicon.LATIN_TERMS, (), lexicon.LATIN_CUES)
    return own.select("conv_id", "chapter_id", "start_us", "end_us", "forced", "title", "title_speech_id", "keywords", "speech_ids")


@query(sql("speech", "SELECT 0::BIGINT AS missing, 0::BIGINT AS unexpected, 0::BIGINT AS duplicates, count(DISTINCT conv_id) AS sources FROM speech"))
def chapter_coverage(spark, sf_dir):
    own = adapters.speech(spark, sf_dir)
    held = chapters.assign(own, _chapters(spark, sf_dir), ["conv_id"], t="start_us")
    key = F.concat_ws(":", "conv_id", "speech_id").alias("key")
    n = own.agg(F.count_distinct("conv_id").alias("sources"))
    return joins.coverage(own.select(key), held.select(key), "key").crossJoin(F.broadcast(n))  # one row each


# ---- ledgers -----------------------------------------------------------------------------

@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def ledger_roundtrip(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"}).alias("p"))
    return own.select("event_id", F.from_json(F.to_json("p"), "k long", {"mode": "FAILFAST"}).alias("q")).select("event_id", "q.k")


from . import catalog_ledgers, catalog_visual  # noqa: E402, F401
