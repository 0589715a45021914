"""All queries of the engine's own operators: name -> (spark, sf_dir) -> DataFrame. Their SQL is in datelode.oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelode import oracles
from datelode.functions.patterns import BUILT_IN
from datelode.functions.vectors import sign_hash
from datelode import stages
from datelode.functions import values
from datelode.operators import char_tagger, compare, dataset, dedup, evidence, labels, mine, ordered, profile, resolve, similar, tagger, timeline
from datelode.operators.components import saved
from datelode.plans import export
from datelode.sources import checkpoint, logs
from datelode.sources.album import album, with_screenshot

HAMMING_LIMIT, COSINE, LEND_COSINE = 16, 0.35, 0.3


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _resolved(spark, sf_dir) -> DataFrame:
    return resolve.resolve(evidence.all_evidence(album(spark, sf_dir)))


def _flat(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("source_summary", F.array_join("source_summary", ","))


def album_items(spark, sf_dir):
    return with_screenshot(album(spark, sf_dir)).select("item_id", "relpath", "stem", "ext", "filesize", "format_real", "is_screenshot")


def _evidence(emit: Callable) -> Callable:
    return lambda spark, sf_dir: emit(album(spark, sf_dir)).select("item_id", "ev_seq", "source", "dt", "precision", "confidence", "is_direct")


def evidence_union(spark, sf_dir):
    return evidence.all_evidence(album(spark, sf_dir)).groupBy("source", "precision", "is_direct").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def resolve_time(spark, sf_dir):
    return _flat(_resolved(spark, sf_dir))


def time_interval(spark, sf_dir):
    return _resolved(spark, sf_dir).select("item_id", "precision", "range_start", "range_end")


def resolve_mined(spark, sf_dir):
    """Resolution with the patterns that the album's own names have, behind the built-in ones."""
    items = saved(album(spark, sf_dir))
    return _flat(resolve.resolve(evidence.all_evidence(items, [*BUILT_IN, *mine.mined_patterns(items)])))


def conflict_report(spark, sf_dir):
    return _resolved(spark, sf_dir).where("n_conflicts > 0").groupBy("primary_source", "n_conflicts").agg(F.count("*").alias("items"))


def resolve_orders(spark, sf_dir):
    rows = resolve.order_evidence(_read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem"))
    return _flat(resolve.resolve(rows)).select("item_id", "final_datetime", "primary_source", "source_summary", "n_conflicts")


def exact_dups(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.sha1(F.col("text").cast("binary")).alias("sha1"), F.col("doc_id").alias("item_id"))
    return dedup.exact_groups(docs)


def _scored(spark, sf_dir, resolved: DataFrame) -> DataFrame:
    items = with_screenshot(album(spark, sf_dir))
    found = resolved.select("item_id", "confidence")
    score = dedup.quality_score(F.col("confidence"), F.col("exif_original").isNotNull(), F.col("has_gps"), F.col("ext"), F.col("format_real"), F.col("is_screenshot"), F.lit(False))
    return items.join(found, "item_id", "left").withColumn("score", score)


def _dups(spark, sf_dir, resolved: DataFrame) -> DataFrame:
    return dedup.ranked_groups(_scored(spark, sf_dir, resolved).select("item_id", "sha1", "score", "filesize", "relpath"))


def dup_rank(spark, sf_dir):
    return _dups(spark, sf_dir, _resolved(spark, sf_dir))


def group_kinds(spark, sf_dir):
    items = album(spark, sf_dir).select(F.concat(F.col("ext"), F.pmod("event_id", F.lit(50)).cast("string")).alias("group_id"), "sha1")
    return dedup.group_kind(items)


def _hashes(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_hash(F.col("embedding")).alias("h"))


def hamming_pairs(spark, sf_dir):
    return dedup.hamming_pairs(_hashes(spark, sf_dir), HAMMING_LIMIT)


def near_dup_groups(spark, sf_dir):
    return dedup.near_groups(_hashes(spark, sf_dir), HAMMING_LIMIT)


def _vectors(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def cosine_pairs(spark, sf_dir):
    return similar.cosine_pairs(_vectors(spark, sf_dir), COSINE)


def knn_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return similar.nearest(v, v, 5, LEND_COSINE)


def similar_lend(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    known = v.select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 365 as int))")).alias("final_datetime"), F.when(F.col("id") % 3 != 0, F.lit(0.5) + (F.col("id") % 5) / 10).alias("confidence"))
    return similar.lend(similar.nearest(v, v, 5, LEND_COSINE), known)


def sessions_by_user(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return timeline.sessionize(rows, "ts", ["user_id"], "event_id").groupBy("user_id", "session_idx").agg(F.count("*").alias("n"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end"))


def _dated(spark, sf_dir) -> DataFrame:
    """Items with their resolved time, written once: sessions read it several times."""
    return saved(album(spark, sf_dir).join(_resolved(spark, sf_dir).select("item_id", "final_datetime", "confidence"), "item_id", "left"))


KEY = ["user_id"]


def _stats(dated: DataFrame) -> DataFrame:
    return timeline.session_stats(timeline.sessionize(timeline.anchors(dated), "final_datetime", KEY, "item_id"), KEY)


def session_stats(spark, sf_dir):
    return _stats(_dated(spark, sf_dir)).withColumn("year_candidates", F.array_join(F.transform("year_candidates", lambda y: y.cast("string")), ","))


def session_assign(spark, sf_dir):
    return timeline.build_sessions(_dated(spark, sf_dir), KEY)


def folder_prefix(spark, sf_dir):
    dated = _dated(spark, sf_dir)
    return timeline.session_folders(timeline.build_sessions(dated, KEY).join(dated.select("item_id", "relpath"), "item_id"), KEY)


def _tokens(spark, sf_dir) -> DataFrame:
    items = album(spark, sf_dir)
    return timeline.folder_tokens(items, evidence.foldername_evidence(items))


def struct_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("item_id", "folder_text", "depth", F.size("candidates").alias("n_candidates"), F.array_join(F.transform("candidates", lambda d: F.date_format(d, "yyyy-MM-dd")), ",").alias("dates"))


def struct_resolve(spark, sf_dir):
    dated = _dated(spark, sf_dir)
    sessions = timeline.build_sessions(dated, KEY)
    rows = _tokens(spark, sf_dir).where(F.size("candidates") > 1).join(sessions.select("item_id", *KEY, "session_idx"), "item_id")
    rows = rows.join(_stats(dated).select(*KEY, "session_idx", "year_candidates", "time_start", "time_end", "n_anchors"), [*KEY, "session_idx"], "left")
    return timeline.disambiguate(rows).select("item_id", "folder_text", "dt", "precision", F.col("struct_confidence").alias("confidence"))


def interpolate(spark, sf_dir):
    dated = _dated(spark, sf_dir)
    members = timeline.build_sessions(dated, KEY).join(dated.select("item_id", "relpath", "stem", "final_datetime", "confidence", "mtime"), "item_id")
    return timeline.interpolate(members, KEY)


def interpolate_wide(spark, sf_dir):
    """The sessions of users again, each dealt over ranges."""
    dated = _dated(spark, sf_dir)
    members = timeline.build_sessions(dated, KEY).join(dated.select("item_id", "relpath", "stem", "final_datetime", "confidence", "mtime"), "item_id")
    return timeline.interpolate_wide(members, KEY)


def sessions_global(spark, sf_dir):
    """Sessions of all events together, whoever they are of."""
    rows = ordered.sessions(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "ts", [], "event_id", gap_hours=0.125)
    return rows.groupBy("session_idx").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end"))


def session_album(spark, sf_dir):
    """Sessions of the whole album, without a key."""
    return timeline.build_sessions(_dated(spark, sf_dir), [])


def interpolate_album(spark, sf_dir):
    """Times between the anchors of the whole album's sessions; one of them holds nearly all items."""
    dated = _dated(spark, sf_dir)
    members = timeline.build_sessions(dated, []).join(dated.select("item_id", "relpath", "stem", "final_datetime", "confidence", "mtime"), "item_id")
    return timeline.interpolate_wide(members, [])


def digit_signatures(spark, sf_dir):
    return mine.signatures(mine.name_parts(album(spark, sf_dir))).select("sig", "total", "n", "group_total")


def mined_patterns(spark, sf_dir):
    found = mine.mined_patterns(album(spark, sf_dir))
    return spark.createDataFrame([(p.name, p.core, p.precision, p.confidence) for p in found], "name string, core string, precision string, confidence double")


def _plan(spark, sf_dir) -> DataFrame:
    resolved = saved(_resolved(spark, sf_dir))
    near = _dups(spark, sf_dir, resolved).withColumn("needs_review", F.lit(False))
    return export.plan(album(spark, sf_dir), resolved, near)


def _alike(spark, sf_dir, resolved: DataFrame) -> DataFrame:
    """Items with score, and with hash and vector of the embedding of the same number."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), sign_hash(F.col("embedding")).alias("h"), "embedding")
    return saved(_scored(spark, sf_dir, resolved).join(rows, "event_id", "left").select(F.col("event_id").alias("id"), "item_id", "sha1", "h", "embedding", "score", "filesize", "relpath"))


def _plan_by(spark, sf_dir, mode: str) -> DataFrame:
    resolved = saved(_resolved(spark, sf_dir))  # for the scores and for the plan
    items = _alike(spark, sf_dir, resolved)
    alike = lambda grouped: similar.cosine_pairs(items.where("embedding IS NOT NULL").select("id", "embedding").join(grouped, "id", "left_anti"), COSINE)
    dups = dedup.ranked(items.drop("embedding"), mode, HAMMING_LIMIT, alike).join(items.select("id", "item_id"), "id").drop("id")
    return export.plan(album(spark, sf_dir), resolved, dups)


def export_plan_phash(spark, sf_dir):
    return _plan_by(spark, sf_dir, "phash")


def export_plan_clip(spark, sf_dir):
    return _plan_by(spark, sf_dir, "clip")


def export_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


def bucket_counts(spark, sf_dir):
    return export.bucket_counts(_plan(spark, sf_dir))


def kept_backfill(spark, sf_dir):
    return export.with_kept(_plan(spark, sf_dir)).where("duplicate_rank > 0").select("item_id", "duplicate_group_id", "duplicate_rank", "duplicate_kept_relpath")


def review_notes(spark, sf_dir):
    return export.notes(export.with_kept(_plan(spark, sf_dir)))


def latest_status(spark, sf_dir):
    log = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return export.latest(log, "o_custkey", "o_orderkey")


def incremental_scan(spark, sf_dir):
    files = album(spark, sf_dir).select("item_id", "relpath", "filesize", "mtime", "event_id")
    cache = files.where("event_id % 3 <> 0").select("relpath", "filesize", "mtime")
    return logs.cached_and_new(files, cache, ["relpath", "filesize", "mtime"])[1].select("item_id", "relpath")


def profile_depth(spark, sf_dir):
    depth = F.size(F.split(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/")) - 1
    return profile.histogram(_read(spark, sf_dir, "pages"), depth, "depth")


def profile_conf_hist(spark, sf_dir):
    return profile.histogram(_resolved(spark, sf_dir), profile.confidence_bucket(F.col("confidence")), "bucket")


def profile_charclass(spark, sf_dir):
    return profile.char_histogram(album(spark, sf_dir), "stem")


def profile_coverage(spark, sf_dir):
    items = album(spark, sf_dir)
    return profile.coverage(items, evidence.all_evidence(items))


def profile_percentiles(spark, sf_dir):
    items = album(spark, sf_dir)
    return profile.percentile_at(items, "filesize", 95).unionByName(profile.percentile_at(items, "filesize", 50))


def profile_ext(spark, sf_dir):
    return profile.histogram(album(spark, sf_dir), F.col("ext"), "ext")


def profile_length(spark, sf_dir):
    return profile.histogram(album(spark, sf_dir), profile.length_bucket(F.length("stem")), "bucket")


def light_dates(spark, sf_dir):
    return profile.histogram(album(spark, sf_dir), profile.has_light_date(F.col("stem")), "has_date")


def top_folders(spark, sf_dir):
    return profile.histogram(album(spark, sf_dir), F.element_at(F.split("relpath", "/"), -2), "folder").orderBy(F.desc("n"), "folder").limit(20)


def run_summary(spark, sf_dir):
    return profile.run_summary(album(spark, sf_dir), _resolved(spark, sf_dir))


def _labelled(spark, sf_dir) -> DataFrame:
    items = album(spark, sf_dir)
    asked = [p for p in BUILT_IN if p.name in ("DATETIME8_6", "DATE8")]
    best = evidence.filename_evidence(items, asked).groupBy("item_id").agg(F.max_by(F.struct("pattern_name", "matched_text"), F.length("matched_text")).alias("m"))
    rows = items.join(best, "item_id", "left").select("item_id", "stem", F.coalesce("m.pattern_name", F.lit("")).alias("p"), (F.coalesce(F.expr("locate(m.matched_text, stem)"), F.lit(1)) - 1).alias("start"))
    return rows.select(F.col("item_id").alias("id"), "stem", labels.bio_labels(F.col("stem"), F.col("p"), F.col("start")).alias("labels"))


def bio_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", F.array_join("labels", " ").alias("labels"))


def bio_spans(spark, sf_dir):
    return labels.spans(_labelled(spark, sf_dir))


def span_prf(spark, sf_dir):
    gold = labels.spans(_labelled(spark, sf_dir))
    return labels.span_metrics(gold.where("field <> 'SECOND'").withColumn("end", F.when(F.col("id") < "4", F.col("end") + 1).otherwise(F.col("end"))), gold)


def char_vocab(spark, sf_dir):
    return labels.vocabulary(album(spark, sf_dir), "stem")


def label_weights(spark, sf_dir):
    return labels.label_weights(_labelled(spark, sf_dir))


def _tagged(spark, sf_dir) -> DataFrame:
    """Spans as a tagger would give them, with a rule for how sure it is."""
    rows = _labelled(spark, sf_dir)
    spans = rows.select("id", "stem", F.explode(labels.span_array(F.col("labels"))).alias("s")).select("id", "stem", "s.*")
    return spans.select("id", "field", F.substring("stem", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("value"), (0.5 + (F.col("begin") % 5) / 10).alias("confidence"), F.lit(0.9).alias("clf"))


def tagger_dates(spark, sf_dir):
    return tagger.dates(_tagged(spark, sf_dir)).select("id", F.size("fields").alias("n_fields"), "precision", "dt", "confidence")


def _fitted(spark, sf_dir) -> DataFrame:
    """Spans that a tagger, fitted on the names of the train share, finds in the names of all supported files."""
    live = album(spark, sf_dir).where("NOT unsupported").select(F.col("item_id").alias("id"))
    rows = saved(_labelled(spark, sf_dir).join(live, "id"))
    model, _ = char_tagger.fit(rows.select("id", F.filter(F.split("stem", ""), lambda c: c != "").alias("chars"), "labels"))
    models = char_tagger.Models(spark)
    models.put("tagger", model)
    return char_tagger.found(char_tagger.tagged(rows.select("id", "stem"), "stem", models), "stem")


def tagger_fitted(spark, sf_dir):
    """Dates of the fitted tagger's own predictions."""
    return tagger.dates(_fitted(spark, sf_dir)).select("id", F.size("fields").alias("n_fields"), "precision", "dt")


def tagger_evidence(spark, sf_dir):
    rows = tagger.dates(_tagged(spark, sf_dir))
    depth = F.when(F.col("id") < "8", -1).when(F.col("id") < "a", 0).when(F.col("id") < "c", 1).otherwise(4)
    return tagger.evidence(rows.withColumn("depth", depth).withColumn("source", F.when(depth < 0, F.lit("stem")).otherwise(F.lit("folder"))))


def char_ids(spark, sf_dir):
    items = album(spark, sf_dir)
    return tagger.encode(items.select("item_id", "stem"), "stem", labels.vocabulary(items, "stem", min_freq=500)).select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def tag_errors(spark, sf_dir):
    gold = labels.spans(_labelled(spark, sf_dir))
    guess = gold.where("field <> 'SECOND' AND id < 'f'").withColumn("end", F.when(F.col("id") < "4", F.col("end") + 1).otherwise(F.col("end")))
    return tagger.error_counts(tagger.error_types(guess, gold))


def label_shares(spark, sf_dir):
    """Softmax and arg max over the first four numbers of each vector, taken for logits."""
    shares = tagger.softmax(F.transform(F.slice("embedding", 1, 4), lambda x: 4.0 * x.cast("double")))
    rows = _read(spark, sf_dir, "embeddings").where("vec_id < 200").select("vec_id", shares.alias("p"))
    return rows.select("vec_id", tagger.argmax(F.col("p")).cast("int").alias("best"), F.round(F.array_max("p"), 6).alias("share"))


def _segments(spark, sf_dir) -> DataFrame:
    items = album(spark, sf_dir).select("item_id", "relpath", "stem", "exif_original")
    return dataset.segments(items.join(_resolved(spark, sf_dir).select("item_id", "confidence"), "item_id", "left"))


def segment_samples(spark, sf_dir):
    return dataset.verdicts(_segments(spark, sf_dir), max_length=24).groupBy("source", "status").agg(F.count("*").alias("n"))


def segment_counts(spark, sf_dir):
    return dataset.segment_counts(_segments(spark, sf_dir))


def select_intervals(spark, sf_dir):
    """Greedy choice of ship intervals of each order that do not overlap: n_kept, days and the lines kept."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    one = F.struct((F.col("l_linenumber") % 3).alias("rank"), day.alias("begin"), (day + F.col("l_quantity").cast("int")).alias("end"), F.col("l_linenumber").alias("line"))
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("x"))  # the lines of one order
    kept = rows.select("l_orderkey", dataset.select_intervals(F.col("x")).alias("k"))
    return kept.select("l_orderkey", F.size("k").alias("n_kept"), F.array_join(F.array_sort(F.transform("k", lambda x: x["line"].cast("string"))), ",").alias("lines"))


def checkpoint_restore(spark, sf_dir):
    flags, sup = F.array().cast("array<string>"), F.array(F.lit("UNSUPPORTED"))
    items = album(spark, sf_dir).withColumns({"flags": F.when(F.col("unsupported"), sup).otherwise(flags), "completed_stages": flags})
    known = items.where("event_id % 3 = 0").select("item_id", "event_id")
    first = known.select("item_id", F.lit(1).alias("seq"), F.array(F.lit("OLD")).alias("flags"), F.array(F.lit("scan")).alias("completed_stages"), F.lit("stale").alias("sha1"), F.lit(1).alias("width"))
    second = known.where("event_id % 2 = 0").select("item_id", F.lit(2).alias("seq"), F.when(F.col("event_id") % 4 == 0, F.array(F.lit("NO_EXIF"))).alias("flags"), F.array(F.lit("scan"), F.lit("exif")).alias("completed_stages"), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("sha1"), (F.col("event_id") % 7).cast("int").alias("width"))
    items = items.select("item_id", "flags", "completed_stages", "sha1", F.col("width").cast("int").alias("width"))
    return checkpoint.restore(items, first.unionByName(second)).select("item_id", F.array_join("flags", ",").alias("flags"), F.array_join("completed_stages", ",").alias("stages"), "sha1", "width")


def snapshot_stats(spark, sf_dir):
    items = album(spark, sf_dir).join(_resolved(spark, sf_dir).select("item_id", "final_datetime", "n_conflicts"), "item_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("unsupported"), "UNSUPPORTED"), F.when(F.col("exif_original").isNull(), "NO_EXIF"), F.when(F.col("n_conflicts") > 0, "CONFLICT_TIME")))
    stage = F.array_compact(F.array(F.lit("scan"), F.when(~F.col("unsupported"), "exif")))
    return checkpoint.snapshot_stats(items.withColumns({"flags": flags, "completed_stages": stage, "embedding": F.when(F.col("event_id") % 4 == 0, F.lit(1))}))


def json_rows(spark, sf_dir):
    return checkpoint.json_rows(album(spark, sf_dir), "item_id", "relpath", "filesize")


def before_after(spark, sf_dir):
    return compare.improved(_dated(spark, sf_dir).select("item_id", "final_datetime", "confidence"), interpolate(spark, sf_dir))


def timeline_spread(spark, sf_dir):
    return compare.spread(interpolate(spark, sf_dir))


def confidence_bins(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy(compare.bins(F.col("confidence"), (0.9, 0.7, 0.5)).alias("bin")).agg(F.count("*").alias("n"))


def reresolve(spark, sf_dir):
    """Vectors of which two thirds have a time lend to their neighbours; everything is resolved again."""
    v = _vectors(spark, sf_dir)
    dt = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 365 as int))")
    known = v.where("id % 3 <> 0").select(F.col("id").alias("item_id"), F.lit(0).alias("ev_seq"), F.lit("known").alias("source"), dt.alias("dt"), F.lit("second").alias("precision"), (F.lit(0.5) + (F.col("id") % 5) / 10).alias("confidence"), F.lit(True).alias("is_direct"))
    return _flat(similar.improve(known, similar.nearest(v, v, 5, LEND_COSINE))).select("item_id", "final_datetime", "confidence", "primary_source", "source_summary", "n_conflicts")


def lend_in_order(spark, sf_dir):
    """As reresolve, but one vector after the other: what took a time lends it to those behind it."""
    v = _vectors(spark, sf_dir)
    dt = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 365 as int))")
    precision = F.when(F.col("id") % 2 == 0, F.lit("second")).otherwise(F.lit("day"))
    known = v.where("id % 5 = 0").select(F.col("id").alias("item_id"), F.lit(0).alias("ev_seq"), F.lit("known").alias("source"), dt.alias("dt"), precision.alias("precision"), (F.lit(0.3) + (F.col("id") % 4) / 10).alias("confidence"), (F.col("id") % 3 > 0).alias("is_direct"))
    return _flat(similar.improve_in_order(known, similar.nearest(v, v, 5, LEND_COSINE), 0.4))


def best_evidence(spark, sf_dir):
    return resolve.best_evidence(evidence.all_evidence(album(spark, sf_dir))).select("item_id", "ev_seq", "source", "dt", "confidence")


def direct_evidence(spark, sf_dir):
    every = evidence.all_evidence(album(spark, sf_dir))
    return resolve.evidence_by(every, source="filename", direct=True).groupBy("precision").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


def _hashed(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", sign_hash(F.col("embedding")).alias("h"))
    return rows.withColumn("sha1", F.expr("CASE WHEN id % 9 = 0 THEN '' WHEN id % 4 = 0 THEN sha1('c' || CAST(id - id % 20 AS STRING)) ELSE sha1('e' || CAST(id AS STRING)) END"))


def dedup_sha1(spark, sf_dir):
    return dedup.grouped(_hashed(spark, sf_dir), "sha1")


def dedup_phash(spark, sf_dir):
    return dedup.grouped(_hashed(spark, sf_dir), "phash", HAMMING_LIMIT)


def dedup_clip(spark, sf_dir):
    groups = saved(dedup.grouped(_hashed(spark, sf_dir), "phash", HAMMING_LIMIT))
    return dedup.review_flags(groups, similar.cosine_pairs(_vectors(spark, sf_dir).join(groups, "id", "left_anti"), COSINE))  # what is in a group needs no flag


def hash_search(spark, sf_dir):
    hashes = _hashes(spark, sf_dir)
    return dedup.hamming_matches(hashes.where("id % 100 = 0"), hashes, 20).where("rk <= 5")


def digit_parse(spark, sf_dir):
    texts = mine.name_parts(album(spark, sf_dir)).select("text").distinct()
    return texts.select("text", mine.parse_digits(F.col("text")).alias("p")).where("p IS NOT NULL").select("text", "p.precision", "p.dt")


def path_order(spark, sf_dir):
    """The first 50 paths, compared part by part."""
    return album(spark, sf_dir).select("relpath").orderBy(F.split("relpath", "/")).limit(50)


def stage_gate(spark, sf_dir):
    """Two row stages, one gated by the other's flag: how many rows each leaves in which state."""
    none = F.array().cast("array<string>")
    items = album(spark, sf_dir).withColumns({"flags": F.when(F.col("unsupported"), F.array(F.lit("UNSUPPORTED"))).otherwise(none), "completed_stages": none})
    exif = stages.Stage("exif", lambda df: {"flags": F.when(F.col("exif_original").isNull(), stages.add_flag("NO_EXIF")).otherwise(F.col("flags"))}, F.col("ext") != "mp4")
    name = stages.Stage("filename", lambda df: {"flags": stages.remove_flag("NO_EXIF")}, stages.has_flag("NO_EXIF") & F.col("stem").startswith("IMG"))
    rows = stages.run_stages(items, exif, name, exif)
    return rows.groupBy(F.array_join("completed_stages", ",").alias("stages"), F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"))


def time_values(spark, sf_dir):
    """ISO text, its reading, the days of the month and a time from an epoch, for each event."""
    rows = _read(spark, sf_dir, "events").select("event_id", "ts")
    iso = values.iso(F.col("ts"))
    return rows.select("event_id", iso.alias("iso"), (values.from_iso(iso) == F.col("ts")).alias("same"), values.month_days(F.col("ts")).alias("days"), values.from_epoch(F.col("event_id") * F.lit(86400.5)).alias("epoch"))


def bytes_text(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("FF00"))).when(F.col("event_id") % 3 == 1, F.concat(F.encode("stem", "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.encode(F.concat(F.lit("a"), F.char(F.lit(7)), "stem"), "UTF-8"))
    return album(spark, sf_dir).select("item_id", values.bytes_text(raw).alias("text"))


def session_summary(spark, sf_dir):
    dated = _dated(spark, sf_dir)
    return timeline.session_summary(timeline.build_sessions(dated, KEY).join(dated.select("item_id", "final_datetime", "confidence"), "item_id"), KEY)


def path_profile(spark, sf_dir):
    return profile.path_profile(album(spark, sf_dir))


def exif_quality(spark, sf_dir):
    return profile.exif_quality(album(spark, sf_dir), _resolved(spark, sf_dir))


def date_coverage(spark, sf_dir):
    return profile.date_coverage(album(spark, sf_dir))


def overall_scores(spark, sf_dir):
    rows = saved(_labelled(spark, sf_dir))  # read for the texts and for the spans, and these as guess and as gold
    gold = saved(labels.spans(rows))
    return labels.overall_scores(gold.where("field <> 'SECOND' AND id < 'f'").withColumn("end", F.when(F.col("id") < "4", F.col("end") + 1).otherwise(F.col("end"))), gold, rows)


def exact_dates(spark, sf_dir):
    gold = labels.spans(_labelled(spark, sf_dir))
    return labels.exact_dates(gold.where("field <> 'DAY' OR id < 'e'").withColumn("end", F.when(F.col("id") < "4", F.col("end") + 1).otherwise(F.col("end"))), gold)


def livephoto_entry(spark, sf_dir):
    entries = album(spark, sf_dir).select(F.concat(F.lit("a"), F.pmod("event_id", F.lit(40)).cast("string")).alias("archive"), F.concat(F.when(F.col("event_id") % 3 == 0, "__").otherwise(""), "filename").alias("name"))
    return logs.first_photo(entries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        album_items, evidence_union, resolve_time, resolve_mined, time_interval, conflict_report, resolve_orders, exact_dups, dup_rank, group_kinds, hamming_pairs, near_dup_groups, cosine_pairs, knn_topk, similar_lend, sessions_by_user, session_stats, session_assign, folder_prefix, struct_tokens, struct_resolve, interpolate, interpolate_wide, sessions_global, session_album, interpolate_album,
        digit_signatures, mined_patterns, export_plan, export_plan_phash, export_plan_clip, bucket_counts, kept_backfill, review_notes, latest_status, incremental_scan, profile_depth, profile_conf_hist, profile_charclass, profile_coverage, profile_percentiles, profile_ext, profile_length, light_dates, top_folders, run_summary, bio_labels, bio_spans, span_prf, char_vocab, label_weights, livephoto_entry,
        tagger_dates, tagger_fitted, tagger_evidence, char_ids, tag_errors, label_shares, segment_samples, segment_counts, select_intervals, checkpoint_restore, snapshot_stats, json_rows, before_after, timeline_spread, confidence_bins,
        reresolve, lend_in_order, best_evidence, direct_evidence, dedup_sha1, dedup_phash, dedup_clip, hash_search, digit_parse, path_order, session_summary, path_profile, exif_quality, date_coverage, overall_scores, exact_dates, stage_gate, time_values, bytes_text,
    ]
    found = {f.__name__: f for f in plain}
    return found | {f.__name__: _evidence(f) for f in (evidence.exif_evidence, evidence.filesystem_evidence, evidence.filename_evidence, evidence.foldername_evidence)}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()



