"""Queries of small operators over whole tables: clocks, text checks, transcript checks, joins of segments, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textual
from ..functions import time as clock
from ..operators import evaluate, joins, routing, selectors, sequences, speech
from ..session import table
from ..sources import ledgers
from . import adapters
from .adapters import sql
from .catalog import query


@query(sql("speech", "SELECT conv_id, speech_id, CAST(round_even(start_us / 1000.0, 0) AS BIGINT) / 1000.0 AS seconds FROM speech"))
def timecode_parse(spark, sf_dir):
    """Timecodes as they are written, read back."""
    return adapters.speech(spark, sf_dir).select("conv_id", "speech_id", F.round(clock.parse_timecode(clock.timecode(F.col("start_us"))), 3).alias("seconds"))


@query(sql("speech", "SELECT conv_id, speech_id, printf('%02d:%02d:%06.3f', start_us // 3600000000, start_us // 60000000 % 60, CAST(start_us % 60000000 AS DOUBLE) / 1000000) AS shown FROM speech"))
def plain_durations(spark, sf_dir):
    return adapters.speech(spark, sf_dir).select("conv_id", "speech_id", clock.plain_duration(F.col("start_us") / 1e6).alias("shown"))


@query("SELECT doc_id, NOT regexp_matches(text, '\\p{Cc}') AND length(trim(text)) BETWEEN 1 AND 1000 AS ok FROM documents")
def prompt_checks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textual.prompt_ok(F.col("text")).alias("ok"))


@query("SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS lines FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)")
def clean_lists(spark, sf_dir):
    """The different lines of each text, trimmed, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(textual.clean_list(F.split("text", "\n")), "|").alias("lines"))


@query(
    """WITH t AS (SELECT doc_id, regexp_replace(text, '[\\s\\x0b\\x85\\p{Z}]+', '', 'g') AS t FROM documents),
 g AS (SELECT doc_id, p, substr(t, p + 1, 32) AS gram FROM (SELECT doc_id, t, unnest(range(0, length(t) - 31)) AS p FROM t WHERE length(t) >= 64)),
 f AS (SELECT doc_id, p, min(p) OVER (PARTITION BY doc_id, gram) AS first FROM g), a AS (SELECT doc_id, min(p) AS again FROM f WHERE p - first >= 32 GROUP BY 1)
 SELECT a.doc_id, CAST(f.first AS INTEGER) AS first, CAST(a.again AS INTEGER) AS again FROM a JOIN f ON f.doc_id = a.doc_id AND f.p = a.again"""
)
def repeated_ngram(spark, sf_dir):
    return speech.repeated_grams(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "first", "again")


@query(
    sql("signal", """, r AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM label AND sample_index > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY sample_index) AS run_id FROM (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY sample_index) AS p FROM signal))
 SELECT user_id, CAST(run_id AS BIGINT) AS run_id, label, count(*) AS length FROM r WHERE length(label) > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 2""").replace(") , r", "), r")
)
def identical_runs(spark, sf_dir):
    return sequences.identical_runs(adapters.signal(spark, sf_dir), ["user_id"], ["sample_index"], "label", 2)


@query("SELECT conv_id, count(*) AS segments, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY 1")
def speech_totals(spark, sf_dir):
    own = adapters.speech(spark, sf_dir).withColumn("words", F.split("text", " "))
    return speech.totals(own, ["conv_id"])


@query(sql("signal", "SELECT user_id, max(change_score) AS max_ratio, coalesce(string_agg(event_id, ',' ORDER BY event_id) FILTER (change_score > 0.2), '') AS offenders FROM signal GROUP BY 1"))
def worst_ratios(spark, sf_dir):
    own = speech.worst_ratios(adapters.signal(spark, sf_dir), ["user_id"], "event_id", "change_score", 0.2)
    return own.select("user_id", "max_ratio", F.array_join(F.transform("offenders", lambda x: x["id"].cast("string")), ",").alias("offenders"))


@query(
    sql("speech", """SELECT CAST(coalesce(sum(CAST(end_us < start_us AS INT)), 0) AS BIGINT) AS inverted, CAST(coalesce(sum(CAST(ps > start_us AS INT)), 0) AS BIGINT) AS disordered, CAST(coalesce(sum(CAST(pe > start_us AS INT)), 0) AS BIGINT) AS overlapping
 FROM (SELECT *, lag(start_us) OVER w AS ps, lag(end_us) OVER w AS pe FROM speech WINDOW w AS (PARTITION BY conv_id ORDER BY length(text), speech_id))""")
)
def chronology(spark, sf_dir):
    """Speech by length of text, an order that time does not follow."""
    return sequences.chronology(adapters.speech(spark, sf_dir).withColumn("n", F.length("text")), ["conv_id"], ["n", "speech_id"])


@query(sql("speech", "SELECT conv_id, speech_id FROM (SELECT *, lag(end_us) OVER (PARTITION BY conv_id ORDER BY start_us, speech_id) AS before FROM speech) WHERE abs(before - start_us) > 1"))
def speech_gaps(spark, sf_dir):
    return sequences.contiguous(adapters.speech(spark, sf_dir), ["conv_id"], ["start_us", "speech_id"], "start_us", "end_us").select("conv_id", "speech_id")


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'reviewed_exhaustive' WHEN quality = 1 THEN 'reviewed_partial' ELSE 'unreviewed' END AS status FROM labels")
def ground_truth(spark, sf_dir):
    own = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "reviewed").otherwise("draft").alias("review_status"), F.when(F.col("toxic") == 0, "exhaustive").otherwise("positive_only").alias("coverage"))
    return own.select("doc_id", evaluate.ground_truth_status().alias("status"))


@query("SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda x: replace(url_encode(x), '+', '%20')), '/') AS link FROM pages")
def encoded_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ledgers.relative_link(F.col("url")).alias("link"))


@query(
    sql("frames", """SELECT conv_id, string_agg('![' || printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) || '](frames/' || frame_id || '.png)', chr(10) || chr(10) ORDER BY t_us, id) || chr(10) AS markdown
 FROM (SELECT *, CAST(round_even(t_us / 1000.0, 0) AS BIGINT) AS ms, printf('visual-%04d', row_number() OVER (PARTITION BY conv_id ORDER BY t_us, frame_id)) AS id FROM frames) GROUP BY 1""")
)
def markdown_report(spark, sf_dir):
    own = joins.numbered(adapters.frames(spark, sf_dir), ["conv_id"], ["t_us", "frame_id"], "visual-%04d")
    events = own.select("conv_id", "t_us", "event_id", clock.timecode(F.col("t_us")).alias("timecode"), F.concat(F.lit("frames/"), "frame_id", F.lit(".png")).alias("image_path"))
    return ledgers.markdown(events, ["conv_id"])


@query(
    """WITH s AS (SELECT DISTINCT source AS segment_id, lang AS kind FROM documents WHERE lang = 'en'), m AS (SELECT source AS segment_id, min(lang) AS kind FROM documents GROUP BY 1)
 SELECT doc_id, coalesce(s.kind, m.kind, 'unknown') AS route_kind FROM documents d LEFT JOIN s ON s.segment_id = d.source LEFT JOIN m ON m.segment_id = d.source"""
)
def segment_kinds(spark, sf_dir):
    """A kind from the first table that has the segment."""
    own = table(spark, sf_dir, "documents").select(F.lit("v").alias("video_id"), "doc_id", F.col("source").alias("segment_id"), "lang")
    strategy = own.where("lang = 'en'").select("video_id", "segment_id", F.col("lang").alias("kind")).distinct()
    manifest = own.groupBy("video_id", "segment_id").agg(F.min("lang").alias("kind"))
    return joins.source_kind(own, strategy, manifest, ["video_id"]).select("doc_id", "route_kind")


@query(
    sql("signal", """, s AS (SELECT *, CASE label WHEN 'click' THEN 'chart' WHEN 'view' THEN 'table' ELSE 'unknown' END AS kind FROM signal),
 r AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM kind AND sample_index > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY sample_index) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY sample_index) AS p FROM s)),
 g AS (SELECT user_id, run, kind, min(t_us) AS a, max(t_us) AS b FROM r WHERE kind <> 'unknown' GROUP BY 1, 2, 3)
 SELECT g.user_id, printf('route-%03d', CAST(g.run AS BIGINT)) AS segment_id, CASE kind WHEN 'chart' THEN 'boundary_terminal' ELSE 'table_viewport' END AS selector, count(*) AS samples, count(*) FILTER (x.t_us > g.b) AS ahead
 FROM g JOIN signal x ON x.user_id = g.user_id AND x.t_us BETWEEN g.a AND g.b + CASE kind WHEN 'chart' THEN 15000000000 ELSE 8000000000 END GROUP BY 1, 2, 3""").replace(") , s", "), s")
)
def route_dispatch(spark, sf_dir):
    """Samples of each segment with its look-ahead, thousand times as long as for video."""
    kind = F.when(F.col("label") == "click", "chart").when(F.col("label") == "view", "table").otherwise("unknown")
    own = adapters.signal(spark, sf_dir).withColumns({"kind": kind, "confidence": F.lit(1.0), "reasons": F.array().cast("array<string>")})
    segments = routing.content_segments(own, ["user_id"], "sample_index", "t_us").select("user_id", "segment_id", "kind", "start_us", "end_us")
    ahead = {k: (s, round(x * 1e9)) for k, (s, x) in routing.SELECTORS.items()}
    got = joins.dispatch(segments, own.select("user_id", "sample_index", "t_us"), ["user_id"], ahead)
    return got.groupBy("user_id", "segment_id", "selector").agg(F.count("*").alias("samples"), F.count_if("lookahead").alias("ahead"))


@query(
    sql("signal", """, u AS (SELECT user_id, sample_index, t_us, 0.1 AS score, 'density_floor' AS reason FROM signal WHERE label = 'view' UNION ALL SELECT user_id, sample_index, t_us, change_score, 'scenedetect_content' FROM signal WHERE label = 'click' UNION ALL SELECT user_id, sample_index, t_us, change_score * 2, 'adaptive_change_settled' FROM signal WHERE change_score >= 0.3)
 SELECT user_id, sample_index, max(score) AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY 1, 2""").replace(") , u", "), u")
)
def hybrid_union(spark, sf_dir):
    own = adapters.signal(spark, sf_dir)
    part = lambda where, score, reason: own.where(where).select("user_id", "sample_index", "t_us", score.alias("score"), F.array(F.lit(reason)).alias("reasons"))
    parts = [part("label = 'view'", F.lit(0.1), "density_floor"), part("label = 'click'", F.col("change_score"), "scenedetect_content"), part("change_score >= 0.3", F.col("change_score") * 2, "adaptive_change_settled")]
    return selectors.hybrid(parts, ["user_id"]).select("user_id", "sample_index", "score", F.array_join("reasons", ",").alias("reasons"))
