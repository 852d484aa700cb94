"""Registered queries of lists, sections, queues, streams, releases and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.adapters import face_vectors, library, tables
from shoebox.functions import routes
from shoebox.functions.binary import as_doubles
from shoebox.operators import display, jobs, pivots, queue
from shoebox.operators import relational as R
from shoebox.plans.registry import _DISTINCT_NAMES, _FOUND, _MATCHING_INSIDE, _NAMED, _SUMMARIES, FOLDER, register, sql_of
from shoebox.sources import releases
from shoebox.streaming import live

PICKED = ("NATION_7", "NATION_21", "Gone")


@register("person_picker", sql_of(f"SELECT name, name IN {PICKED} AS selected FROM (SELECT DISTINCT person_name AS name FROM named WHERE review_status = 'active' AND person_name IS NOT NULL UNION SELECT unnest({list(PICKED)})) ORDER BY selected DESC, lower(name), name LIMIT 12", _NAMED))
def person_picker(spark, sf_dir):
    return R.person_picker(library(spark, sf_dir), PICKED)


@register("person_search", sql_of("SELECT DISTINCT person_name AS name, person_name = 'NATION_7' AS selected FROM named WHERE review_status = 'active' AND lower(person_name) LIKE '%n_1%'", _NAMED).replace("'%n_1%'", "'%n!_1%' ESCAPE '!'"))
def person_search(spark, sf_dir):
    return R.person_picker(library(spark, sf_dir), ["NATION_7"], " N_1 ")


@register("archive_sections", sql_of("""SELECT row_number() OVER (ORDER BY cluster_id IS NULL, n DESC, least) - 1 AS place, CASE WHEN cluster_id IS NULL THEN 'ungrouped' ELSE 'cluster-' || cluster_id END AS key,
  CASE WHEN cluster_id IS NULL THEN 'Einzelne Gesichter' WHEN coalesce(trim(cluster_label), '') <> '' THEN trim(cluster_label) ELSE 'Gruppe ' || cluster_id END AS label, cluster_id, n AS face_count
  FROM (SELECT cluster_id, count(*) AS n, min(id) AS least FROM face WHERE review_status = 'not_face' GROUP BY cluster_id) LEFT JOIN summaries USING (cluster_id)""", _SUMMARIES))  # fmt: skip
def archive_sections(spark, sf_dir):
    return R.archive_sections(library(spark, sf_dir), "not_face")


@register("archive_section_faces", sql_of("""SELECT place, f.id AS face_id, image_id FROM face f JOIN (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id IS NULL, count(*) DESC, min(id)) - 1 AS place
  FROM face WHERE review_status = 'unknown_person' GROUP BY cluster_id) s ON s.cluster_id IS NOT DISTINCT FROM f.cluster_id WHERE review_status = 'unknown_person'"""))  # fmt: skip
def archive_section_faces(spark, sf_dir):
    return R.archive_section_faces(library(spark, sf_dir), "unknown_person")


_ORDER = "face_count DESC, CASE WHEN coalesce(trim(person_name), '') = '' THEN 1 ELSE 0 END, lower(coalesce(person_name, 'Unbekannt')), cluster_id"


@register("overview", sql_of(f"""SELECT 'cluster' AS part, row_number() OVER (ORDER BY {_ORDER}) - 1 AS place, cluster_id AS id, cluster_label AS label, person_name, face_count FROM summaries
  UNION ALL SELECT 'group', g.place, NULL, g.label, NULL, (SELECT count(*) FROM face WHERE CASE WHEN review_status <> 'active' THEN review_status WHEN cluster_id IS NULL THEN 'unassigned' END = g.k)
    FROM (VALUES (0, 'unassigned', 'Nicht zugewiesen'), (1, 'unknown_person', 'Unbekannte Personen'), (2, 'not_face', 'Keine Gesichter')) g(place, k, label)
  UNION ALL SELECT 'face', row_number() OVER (ORDER BY id) - 1, id, NULL, NULL, NULL FROM face WHERE review_status = 'active' AND cluster_id = (SELECT cluster_id FROM summaries ORDER BY {_ORDER} LIMIT 1)""", _SUMMARIES))  # fmt: skip
def overview(spark, sf_dir):
    return R.overview(library(spark, sf_dir))


_RENAMES = "renames AS (SELECT l.id AS location_id, l.image_id, l.path, regexp_replace(l.filename, '[.]jpg$', '') || ' ' || n.names || '.jpg' AS proposed_filename FROM image_location l JOIN joined n ON n.image_id = l.image_id WHERE l.image_id IN (SELECT image_id FROM matching))"


@register("rename_total", sql_of("SELECT count(*) AS locations, count(DISTINCT image_id) AS images FROM renames", _NAMED, _MATCHING_INSIDE, _DISTINCT_NAMES, _RENAMES))
def rename_total(spark, sf_dir):
    return R.rename_total(R.rename_candidates(library(spark, sf_dir), [FOLDER]))


@register("rename_by_paths", sql_of("SELECT location_id, proposed_filename FROM renames WHERE path IN (SELECT path FROM image_location WHERE id % 3 = 0)", _NAMED, _MATCHING_INSIDE, _DISTINCT_NAMES, _RENAMES))
def rename_by_paths(spark, sf_dir):
    lib = library(spark, sf_dir)
    return R.rename_by_paths(R.rename_candidates(lib, [FOLDER]), lib.image_location.where("id % 3 = 0").select("path"), "folder", "asc").select("location_id", "proposed_filename")


_BADGES = """badges AS (SELECT image_id, id, bbox_x / w * 100 AS s, bbox_x / w * 100 + least(62.0, (length(CASE WHEN coalesce(person_name, '') = '' THEN 'Nicht zugewiesen' ELSE person_name END) * 6.2 + 34) / 420 * 100) AS e,
   row_number() OVER (PARTITION BY image_id ORDER BY bbox_x, id) AS r FROM (SELECT *, CASE WHEN image_id % 5 > 0 THEN (40 + image_id % 7 * 20)::DOUBLE END AS w FROM named)),
 chosen AS (SELECT image_id, id, r, 0 AS lane, greatest(0.0, e)::DOUBLE AS e0, NULL::DOUBLE AS e1, NULL::DOUBLE AS e2 FROM badges WHERE r = 1
  UNION ALL SELECT image_id, id, r, lane, CASE WHEN lane = 0 THEN greatest(e0, e) ELSE e0 END, CASE WHEN lane = 1 THEN greatest(coalesce(e1, 0), e) ELSE e1 END, CASE WHEN lane = 2 THEN greatest(coalesce(e2, 0), e) ELSE e2 END
  FROM (SELECT b.image_id, b.id, b.r, b.e, c.e0, c.e1, c.e2, CASE WHEN b.s IS NULL OR e0 <= s THEN 0 WHEN e1 <= s THEN 1 WHEN e2 <= s THEN 2 WHEN e1 IS NULL THEN 1 WHEN e2 IS NULL THEN 2
    WHEN e0 <= least(e1, e2) THEN 0 WHEN e1 <= e2 THEN 1 ELSE 2 END AS lane FROM badges b JOIN chosen c ON c.image_id = b.image_id AND b.r = c.r + 1))"""


@register("label_lanes", sql_of("SELECT image_id, id, lane FROM chosen", _NAMED, _BADGES).replace("WITH ", "WITH RECURSIVE ", 1))
def label_lanes(spark, sf_dir):
    faces = R.named_faces(library(spark, sf_dir)).select("image_id", "id", F.col("bbox_x").cast("double").alias("bbox_x"), "person_name")
    return display.label_lanes(faces.withColumn("natural_width", F.expr("if(image_id % 5 > 0, double(40 + image_id % 7 * 20), 0d)")))


@register("merged_list", "SELECT o_orderkey AS id, o_orderkey % 3 > 0 AS known, row_number() OVER (ORDER BY o_orderkey % 3 = 0, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey * 100000 + o_orderkey END, o_totalprice, o_orderkey) - 1 AS n FROM orders WHERE o_orderkey % 4 > 0")
def merged_list(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"]
    current = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.expr("o_custkey * 100000 + o_orderkey").alias("place"))
    return display.merged_list(current, o.where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("place"))).select("id", "known", "n")


@register("topic_runs", "WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS topic FROM events), f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR topic IS NOT DISTINCT FROM lag(topic) OVER w THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (ORDER BY event_id)), r AS (SELECT *, sum(fresh) OVER (ORDER BY event_id) AS run FROM f) SELECT run::BIGINT AS run, topic, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY run, topic")
def topic_runs(spark, sf_dir):
    e = tables(spark, sf_dir, "events")["events"].select("event_id", F.expr("if(event_id % 50 = 0, null, event_type)").alias("topic"))
    return display.runs(e, "topic", "event_id").groupBy("run", "topic").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@register("bytes_to_doubles", "SELECT doc_id, unhex(array_to_string([h[15 - 2 * i : 16 - 2 * i] for i in range(8)], ''))::BIT::DOUBLE AS x FROM (SELECT doc_id, sha256(text)[1:16] AS h FROM documents WHERE text IS NOT NULL)")
def bytes_to_doubles(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")["documents"].where("text is not null")
    return as_doubles(docs.select("doc_id", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16)).alias("x")), "x")


_QUEUE = "SELECT o_custkey AS queue, o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'running' WHEN o_orderkey % 7 = 1 AND o_custkey % 5 = 0 THEN 'paused' WHEN o_orderkey % 7 = 2 THEN 'completed' ELSE 'queued' END AS status, o_orderdate AS started_at, o_orderkey % 13 AS place, CASE WHEN o_orderkey % 77 <> 0 THEN o_orderkey % 97 + 1 END AS seconds FROM orders"
_WALK = """active AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY started_at, id) AS n FROM jobs WHERE status IN ('running', 'paused')),
 held AS (SELECT queue, bool_or(status = 'paused' OR seconds IS NULL) AS blind, coalesce(max(seconds) FILTER (n = 1), 0)::DOUBLE AS a, coalesce(arg_max(seconds, n) FILTER (n >= 2), 0)::DOUBLE AS b FROM active GROUP BY queue),
 waiting AS (SELECT queue, id, seconds, row_number() OVER (PARTITION BY queue ORDER BY place, id) AS n FROM jobs WHERE status = 'queued'),
 walk AS (SELECT q.queue, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::DOUBLE AS eta, CASE WHEN NOT coalesce(blind, false) THEN coalesce(a, 0) END AS a, CASE WHEN NOT coalesce(blind, false) THEN coalesce(b, 0) END AS b FROM (SELECT DISTINCT queue FROM jobs) q LEFT JOIN held USING (queue)
  UNION ALL SELECT w.queue, j.n, j.id, least(a, b) + j.seconds, CASE WHEN a <= b THEN a + j.seconds ELSE a END, CASE WHEN a <= b THEN b ELSE b + j.seconds END FROM walk w JOIN waiting j ON j.queue = w.queue AND j.n = w.n + 1),
 etas AS (SELECT queue, id, eta FROM walk WHERE id IS NOT NULL UNION ALL SELECT queue, id, CASE WHEN NOT blind THEN seconds END FROM active JOIN held USING (queue))"""


def _queues(spark, sf_dir):
    return spark.sql(_QUEUE.replace("FROM orders", "FROM {orders}"), **tables(spark, sf_dir, "orders"))


@register("queue_snapshot", f"""WITH RECURSIVE jobs AS ({_QUEUE}), {_WALK}
 SELECT j.queue, j.id, j.status, CASE WHEN j.status = 'queued' THEN row_number() OVER (PARTITION BY j.queue, j.status ORDER BY j.place, j.id) END::INTEGER AS position, e.eta, round(max(e.eta) OVER (PARTITION BY j.queue))::BIGINT AS overall_eta FROM jobs j LEFT JOIN etas e USING (queue, id)""")
def queue_snapshot(spark, sf_dir):
    return queue.snapshot(_queues(spark, sf_dir), 2)


@register("queue_counts", f"""WITH jobs AS ({_QUEUE}) SELECT queue, count(*) FILTER (status IN ('running', 'paused')) AS running_count, count(*) FILTER (status = 'queued') AS queued_count, count(*) FILTER (status = 'paused') AS paused_count,
 count(*) FILTER (status = 'completed') AS ended_count, (list(id ORDER BY started_at, id) FILTER (status IN ('running', 'paused')))[1] AS active_job FROM jobs GROUP BY queue""")
def queue_counts(spark, sf_dir):
    return queue.counts(_queues(spark, sf_dir))


@register("makespan_eta", f"""WITH RECURSIVE jobs AS (SELECT o_custkey AS queue, o_orderkey AS id, 'queued' AS status, NULL::TIMESTAMP AS started_at, o_orderkey AS place, o_orderkey % 97 + 1 AS seconds FROM orders), {_WALK}
 SELECT queue, id, eta FROM etas""")
def makespan_eta(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"]
    return jobs.makespan(o.select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("place"), F.expr("double(o_orderkey % 97 + 1)").alias("seconds")), 2)


@register("family_totals", "SELECT family, count(*) AS jobs, sum(s)::BIGINT AS seconds, max(s)::BIGINT AS longest FROM (SELECT o_orderpriority AS family, o_custkey AS job, sum(o_orderkey % 97 + 1) AS s FROM orders GROUP BY ALL) GROUP BY family")
def family_totals(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"]
    return queue.family_totals(o.select(F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("job"), F.expr("o_orderkey % 97 + 1").alias("seconds")))


def _events(spark, sf_dir):
    return tables(spark, sf_dir, "events")["events"].select("ts", F.col("event_type").alias("topic"), F.col("event_id").alias("payload"))


_NEWEST = "arg_max(event_id, epoch_us(ts)::HUGEINT * 1000000000 + event_id)"


@register("latest_per_topic", f"SELECT event_type AS topic, {_NEWEST} AS payload, max(ts) AS at FROM events GROUP BY event_type")
def latest_per_topic(spark, sf_dir):
    return live.latest_per_topic(_events(spark, sf_dir))


@register("throttle_windows", f"SELECT event_type AS topic, time_bucket(INTERVAL 2 SECOND, ts) AS at, {_NEWEST} AS payload FROM events GROUP BY ALL")
def throttle_windows(spark, sf_dir):
    return live.throttled(_events(spark, sf_dir), "2 seconds").select("topic", F.col("window.start").alias("at"), "payload")


@register("debounce_sessions", f"WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 90 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM gaps) SELECT user_id AS topic, max(ts) + INTERVAL 90 SECOND AS fires_at, {_NEWEST} AS reason, count(*) AS n FROM runs GROUP BY user_id, run")
def debounce_sessions(spark, sf_dir):
    e = tables(spark, sf_dir, "events")["events"]
    return live.debounced(e.select("ts", F.col("user_id").alias("topic"), F.col("event_id").alias("payload")))


_KNN_SQL = _FOUND["knn_topk"][1]


@register("knn_pivots", _KNN_SQL)
def knn_pivots(spark, sf_dir):
    v = face_vectors(spark, sf_dir)
    return pivots.knn(v, v, 8)[0]


_PAYLOAD = """SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 0 THEN '{oops' ELSE '{"tag_name":"' || CASE WHEN p_partkey % 29 = 0 THEN 'next' ELSE 'v' || v END || '","draft":' || CASE WHEN p_partkey % 10 = 0 THEN 'true' ELSE 'false' END || ',"published_at":"d' || p_size
  || '","assets":[{"name":"Tool-' || v || '.exe","browser_download_url":"u/' || p_partkey || '","digest":"sha256:ab"}' || CASE WHEN p_partkey % 4 > 0 THEN ',{"name":"Tool-' || v || '.exe.sha256","browser_download_url":"s/' || p_partkey || '"}' ELSE '' END || ']}' END AS payload, v
  FROM (SELECT p_partkey, p_size, p_size || '.' || (p_partkey % 13) || '.' || (p_partkey % 7) AS v FROM part) AS versions"""


@register("release_candidates", f"""WITH p AS ({_PAYLOAD}), r AS (SELECT *, CASE WHEN id % 31 = 0 THEN 'unreadable' WHEN id % 10 = 0 THEN 'unreleased' WHEN id % 29 = 0 THEN 'version' WHEN len(json_extract(payload, '$.assets')::JSON[]) < 2 THEN 'no installer' END AS problem FROM p)
 SELECT id, CASE WHEN coalesce(problem, 'no installer') = 'no installer' THEN v END AS version, CASE WHEN coalesce(problem, 'no installer') = 'no installer' THEN string_split(v, '.')::INT[] > [20, 5, 1] END AS update_available, CASE WHEN problem IS NULL THEN json_extract_string(payload, '$.assets[0].name') END AS installer_name,
  CASE WHEN problem IS NULL THEN json_extract_string(payload, '$.assets[0].browser_download_url') END AS installer_url, CASE WHEN problem IS NULL THEN 'sha256:ab' END AS digest, CASE WHEN problem IS NULL THEN json_extract_string(payload, '$.assets[1].browser_download_url') END AS checksum_url,
  CASE WHEN id % 31 > 0 THEN json_extract_string(CASE WHEN id % 31 > 0 THEN payload ELSE '{{}}' END, '$.published_at') END AS published_at, problem FROM r""")
def release_candidates(spark, sf_dir):
    held = spark.sql(_PAYLOAD.replace("'{", "'{{").replace("[{", "[{{").replace(",{", ",{{").replace('"}', '"}}').replace("]}", "]}}").replace("FROM part", "FROM {part}"), **tables(spark, sf_dir, "part"))
    return releases.release_candidates(held, "20.5.1", "Tool")


_DIGESTS = "SELECT doc_id::VARCHAR AS name, sha256(text) AS sha, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN upper(sha256(text)) || '  ' || doc_id WHEN 2 THEN sha256(text || '!') || '  ' || doc_id WHEN 3 THEN sha256(text) ELSE sha256(text) || ' ' || doc_id END AS line, CASE WHEN doc_id % 15 = 4 THEN 'sha256:00' END AS digest FROM documents WHERE text IS NOT NULL"


@register("verified_digests", f"WITH d AS ({_DIGESTS}) SELECT name, sha AS sha256, CASE name::BIGINT % 5 WHEN 0 THEN 'unpublished' WHEN 1 THEN NULL WHEN 2 THEN 'wrong checksum' WHEN 3 THEN CASE WHEN NOT contains(line, name) THEN 'invalid checksum' END ELSE CASE WHEN digest IS NOT NULL THEN 'contradiction' END END AS problem FROM d")
def verified_digests(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")["documents"].where("text is not null").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"), "doc_id", "text")
    own = F.sha2("content", 256)
    line = F.when(F.expr("doc_id % 5 = 1"), F.concat_ws("  ", F.upper(own), "name")).when(F.expr("doc_id % 5 = 2"), F.concat_ws("  ", F.sha2(F.concat("text", F.lit("!")).cast("binary"), 256), "name")).when(F.expr("doc_id % 5 = 3"), own).otherwise(F.concat_ws(" ", own, "name"))
    published = docs.where("doc_id % 5 > 0").select("name", line.alias("text"), F.expr("if(doc_id % 15 = 4, 'sha256:00', null)").alias("digest"))
    return releases.verified(docs.select("name", "content"), published)


@register("face_crops", sql_of("SELECT f.id AS face_id, l.path, trunc(bbox_x)::INTEGER AS x, trunc(bbox_y)::INTEGER AS y, trunc(bbox_w)::INTEGER AS w, trunc(bbox_h)::INTEGER AS h FROM face f JOIN (SELECT image_id, min(path) AS path FROM image_location WHERE id % 3 <> 0 GROUP BY image_id) l USING (image_id)"))
def face_crops(spark, sf_dir):
    lib = library(spark, sf_dir)
    return R.face_crops(lib.face, lib.image_location.withColumn("exists", F.col("id") % 3 != 0))


_PARTS = "CASE WHEN id % 7 = 0 THEN '9007199254740992' WHEN id % 7 = 1 THEN ' +' || id || 'x' ELSE id::VARCHAR END"


@register("view_routes", sql_of(f"""SELECT id, route, CASE id % 4 WHEN 0 THEN 'people' WHEN 1 THEN 'renaming' WHEN 2 THEN 'review' ELSE 'settings' END AS page,
  CASE WHEN id % 8 = 2 AND id % 7 > 0 THEN id END AS cluster_id, CASE WHEN id % 8 = 6 AND k IN ('unassigned', 'unknown_person', 'not_face') THEN k END AS group_key,
  CASE WHEN id % 4 = 3 AND id % 5 < 4 THEN ['erkennung', 'dateinamen', 'updates', 'daten'][id % 5 + 1] END AS section
  FROM (SELECT id, k, CASE id % 4 WHEN 0 THEN '#/bilder' WHEN 1 THEN '#/dateinamen' WHEN 2 THEN '#/gesichter-pruefen' || CASE WHEN id % 8 = 2 THEN '/gruppe/' || n ELSE '/kategorie/' || k END
    ELSE '#/einstellungen/' || ['erkennung', 'dateinamen', 'updates', 'daten', 'mehr'][id % 5 + 1] END AS route
    FROM (SELECT id, {_PARTS} AS n, CASE WHEN id % 3 = 0 THEN 'not_face' WHEN id % 3 = 1 THEN 'unassigned' ELSE lower(label) END AS k FROM cluster))"""))  # fmt: skip
def view_routes(spark, sf_dir):
    entries = library(spark, sf_dir).cluster.select(
        "id", F.element_at(F.array(*map(F.lit, routes.PAGES)), (F.col("id") % 4 + 1).cast("int")).alias("page"),
        F.expr(f"CASE WHEN id % 8 = 2 THEN {_PARTS.replace('id::VARCHAR', 'string(id)')} END").alias("number"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'not_face' WHEN id % 3 = 1 THEN 'unassigned' ELSE lower(label) END").alias("group_key"),
        F.element_at(F.array(*map(F.lit, ("erkennung", "dateinamen", "updates", "daten", "mehr"))), (F.col("id") % 5 + 1).cast("int")).alias("section"),
    )
    built = entries.select("id", routes.route(*(F.col(c) for c in ("page", "number", "group_key", "section"))).alias("route"))
    return built.withColumn("view", routes.view_of(F.col("route"))).select("id", "route", "view.*")
