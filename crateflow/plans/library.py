"""Library queries: filters, joins, aggregates, orders, lookups, merges and queues."""

from __future__ import annotations

from .sqlplan import shared

# --- filters and projections --------------------------------------------------------------
shared("bpm_window_keep_unknown", "SELECT id, bpm, bpm IS NULL AS unknown_bpm FROM tracks WHERE bpm BETWEEN 130 AND 145 OR bpm IS NULL")
shared("quality_admission", """
SELECT id FROM tracks WHERE coalesce(status, '') <> 'rejected' AND coalesce(quality_status, '') NOT IN ('fake_transcode', 'clipped', 'corrupt')""")
shared("duration_window", "SELECT id, duration FROM tracks WHERE duration BETWEEN 200 - 20 AND 200 + 20")
shared("labelled_tracks", """
SELECT t.id FROM tracks t WHERE t.feedback IN ('like', 'dislike') OR t.adopted IS NOT NULL OR t.rb_rating >= 1
  OR EXISTS (SELECT 1 FROM votes v WHERE v.sc_id = t.sc_id AND v.value <> 'later')""")

# --- joins ------------------------------------------------------------------------------
shared("liked_store_items", "SELECT s.sc_id, s.profile_id, s.last_seen FROM store_items s JOIN votes v ON v.sc_id = s.sc_id WHERE v.value = 'like'")
shared("store_items_unvoted", "SELECT s.sc_id, s.profile_id FROM store_items s LEFT JOIN votes v ON v.sc_id = s.sc_id WHERE v.value IS NULL")
shared("embedded_tracks", "SELECT t.id, t.title, label FROM tracks t JOIN embeddings e ON e.vec_id = t.id")
shared("latest_snapshot", """
SELECT sc_id, id, likes, recorded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY sc_id ORDER BY recorded_at DESC, id DESC) AS k FROM snapshots) x WHERE k = 1""")
shared("watched_tracks", """
SELECT w.sc_id, w.profile_id, coalesce(nullif(trim(s.title), ''), t.title) AS title
FROM store_items w LEFT JOIN (SELECT sc_id, max_by(title, id) AS title FROM snapshots GROUP BY sc_id) s ON s.sc_id = w.sc_id
LEFT JOIN tracks t ON t.id = w.sc_id""")
shared("votes_by_path_id", """
SELECT t.id, t.path, v.value FROM (SELECT id, path, CASE WHEN regexp_extract(path, '^/music/\\[([0-9]+)\\]', 1) <> '' THEN CAST(regexp_extract(path, '^/music/\\[([0-9]+)\\]', 1) AS BIGINT) END AS path_id FROM tracks) t
LEFT JOIN votes v ON v.sc_id = t.path_id""",
       """
SELECT t.id, t.path, v.value FROM (SELECT id, path, try_cast(regexp_extract(path, r'^/music/\\[([0-9]+)\\]', 1) AS BIGINT) AS path_id FROM tracks) t
LEFT JOIN votes v ON v.sc_id = t.path_id""")
shared("not_seen", "SELECT i.id FROM items i LEFT ANTI JOIN (SELECT id FROM seen WHERE id % 2 = 0) s ON s.id = i.id".replace("LEFT ANTI", "ANTI"),
       "SELECT i.id FROM items i LEFT ANTI JOIN (SELECT id FROM seen WHERE id % 2 = 0) s ON s.id = i.id")
shared("without_embedding", "SELECT t.id FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = t.id)")
shared("watch_count", "SELECT count(*) AS n FROM store_items s WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.sc_id = s.sc_id)")
shared("backfill_artists", """
SELECT s.id, coalesce(nullif(trim(t.artist), ''), nullif(trim(u.artist), ''), s.artist) AS artist
FROM seen s LEFT JOIN (SELECT sc_id, max(artist) AS artist FROM tracks WHERE sc_id IS NOT NULL GROUP BY sc_id) t ON t.sc_id = s.id
LEFT JOIN (SELECT id, max(artist) AS artist FROM items GROUP BY id) u ON u.id = s.id""")
shared("known_status", """
SELECT i.id, CASE WHEN t.id IS NOT NULL THEN 'library' WHEN s.id IS NOT NULL THEN 'seen' ELSE 'new' END AS known
FROM items i LEFT JOIN (SELECT sc_id AS id FROM tracks WHERE sc_id IS NOT NULL) t ON t.id = i.id LEFT JOIN (SELECT id FROM seen WHERE reason IS NOT NULL) s ON s.id = i.id""")
shared("track_timeline", """
SELECT s.id, 1 AS step, 'seen' AS what FROM seen s
UNION ALL SELECT sc_id, 2, 'vote ' || value FROM votes UNION ALL SELECT sc_id, 3, 'store' FROM store_items
UNION ALL SELECT id, 4, 'library' FROM tracks UNION ALL SELECT track_id, 5, 'job ' || status FROM jobs""")

# --- aggregates --------------------------------------------------------------------------
shared("collection_overview", """
SELECT 'status' AS facet, status AS value, count(*) AS n FROM tracks WHERE coalesce(status, '') <> '' GROUP BY status
UNION ALL SELECT 'quality', quality_status, count(*) FROM tracks WHERE coalesce(quality_status, '') <> '' GROUP BY quality_status
UNION ALL SELECT 'format', regexp_extract(path, '([a-z0-9]+)$', 1), count(*) FROM tracks GROUP BY 2""")
shared("tag_counts", "SELECT tag, count(DISTINCT sc_id) AS n FROM snapshots GROUP BY tag")
shared("top_collection_artists", """
SELECT artist_key, max(CASE WHEN place = 1 THEN artist END) AS artist, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY artist_key ORDER BY n DESC, artist) AS place FROM (
    SELECT lower(artist) AS artist_key, artist, count(*) AS n FROM tracks WHERE status = 'archive' OR adopted IS NOT NULL GROUP BY 1, 2) x) y
GROUP BY artist_key HAVING sum(n) >= 3 ORDER BY n DESC, artist LIMIT 20""")
shared("curator_overview", """
SELECT artist, count(*) AS n, CAST(count(*) FILTER (WHERE rb_rating >= 4) AS DOUBLE) / count(*) AS liked_share, round(avg(bpm), 6) AS mean_bpm FROM tracks
WHERE status IN ('archive', 'inbox') GROUP BY artist HAVING count(*) >= 3""")
shared("job_summary", """
SELECT job_type, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running,
  count(*) FILTER (WHERE status = 'completed') AS completed, max(updated_at) FILTER (WHERE status IN ('running', 'completed')) AS heartbeat FROM jobs GROUP BY job_type""")
shared("exploration_counters", """
SELECT tag, count(*) AS uses, count(*) FILTER (WHERE likes > 50) AS successes, max(CASE WHEN likes > 50 THEN recorded_at END) AS last_success FROM snapshots GROUP BY tag""")
shared("curator_mining", """
SELECT e.user_id, count(DISTINCT e.track_id) AS hits FROM edges e JOIN tracks t ON t.id = e.track_id AND t.feedback = 'like'
WHERE e.user_id % 50 <> 0 GROUP BY e.user_id HAVING count(DISTINCT e.track_id) >= 3""")
shared("set_report", """
SELECT count(*) AS n, round(100 * CAST(count(bpm) AS DOUBLE) / count(*), 4) AS bpm_coverage, count(*) FILTER (WHERE bpm_confidence >= 0.5) AS reliable,
  min(bpm) AS min_bpm, max(bpm) AS max_bpm, median(bpm) AS median_bpm FROM tracks""")
shared("today_list", """
SELECT * FROM (SELECT 1 AS pos, 'inbox' AS what, count(*) AS n FROM tracks WHERE status = 'inbox' UNION ALL SELECT 2, 'pending jobs', count(*) FROM jobs WHERE status = 'pending'
  UNION ALL SELECT 3, 'later', count(*) FROM votes WHERE value = 'later') x WHERE n > 0""")
shared("import_summary", """
SELECT count(*) FILTER (WHERE id % 2 = 0) AS by_path, count(*) FILTER (WHERE rb_rating > 0) AS rated, count(*) FILTER (WHERE rb_play_count > 0) AS played,
  count(*) FILTER (WHERE feedback IS NULL AND (rb_rating >= 4 OR rb_play_count >= 2)) AS auto_liked FROM tracks""")
shared("dominant_label", "SELECT label FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) x ORDER BY n DESC, CAST(label AS STRING) LIMIT 1")
shared("audit_summary", "SELECT coalesce(quality_status, 'unknown') AS verdict, count(*) AS n, count(*) FILTER (WHERE id % 4 = 0) AS cached FROM tracks GROUP BY 1")

# --- windows -----------------------------------------------------------------------------
shared("keep_first", "SELECT id, sc_id FROM (SELECT *, row_number() OVER (PARTITION BY sc_id ORDER BY id) AS k FROM snapshots) x WHERE k = 1")
shared("sessions", """
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM r GROUP BY user_id, run HAVING count(*) >= 3""")
shared("last_run_per_mode", "SELECT mode, max(id) AS id, max_by(finished_at, id) AS finished_at, max_by(ok, id) AS ok FROM runs GROUP BY mode")
shared("period_change", """
SELECT day, n, CASE WHEN before > 0 THEN round(100 * CAST(n - before AS DOUBLE) / before, 4) END AS change FROM (
  SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) d) x""")
shared("second_drop", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase') x WHERE k = 2""")
# --- orders ------------------------------------------------------------------------------
shared("camelot_order", """
SELECT id, key_camelot, bpm FROM tracks ORDER BY bpm NULLS LAST, CASE WHEN key_camelot IS NULL THEN 2 ELSE 1 END,
  CAST(regexp_extract(coalesce(key_camelot, '0A'), '^([0-9]+)', 1) AS BIGINT), key_camelot, id""")
shared("labelled_first", "SELECT id, feedback FROM tracks ORDER BY CASE WHEN feedback IS NOT NULL THEN 0 ELSE 1 END, id")
shared("watch_order", "SELECT sc_id, profile_id, last_seen FROM store_items ORDER BY CASE WHEN profile_id = 'p0' THEN 0 ELSE 1 END, last_seen DESC, sc_id")

# --- lookups and rules -------------------------------------------------------------------
shared("backlog_energy", "SELECT id FROM tracks WHERE energy IS NULL ORDER BY id LIMIT 100")
shared("active_job", "SELECT track_id, job_type, min(id) AS id FROM jobs WHERE status IN ('pending', 'running') GROUP BY 1, 2")
shared("stuck_work", """
SELECT id, 'stale' AS rule FROM jobs WHERE status = 'running' AND updated_at < (SELECT max(updated_at) FROM jobs) - INTERVAL 2 DAY
UNION ALL SELECT track_id, 'conflict' FROM jobs WHERE status = 'pending' GROUP BY track_id HAVING count(DISTINCT job_type) >= 2""")

# --- merges and queues -------------------------------------------------------------------
shared("override_fold", """
SELECT sc_id, kind FROM (SELECT sc_id, max_by(kind, k) AS kind FROM (SELECT sc_id, 'not_duplicate' AS kind, 1 AS k FROM votes
  UNION ALL SELECT sc_id, CASE WHEN sc_id % 2 = 0 THEN 'clear' ELSE 'already_in_collection' END, 2 FROM votes WHERE sc_id % 3 = 0) x GROUP BY sc_id) y WHERE kind <> 'clear'""")
shared("auto_like", "SELECT id, CASE WHEN feedback IS NULL AND (rb_rating >= 4 OR rb_play_count >= 2) THEN 'like' ELSE feedback END AS feedback FROM tracks")
shared("activity_ttl", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
shared("tag_add_remove", """
SELECT DISTINCT sc_id, tag FROM snapshots WHERE NOT (tag = 'error' AND sc_id % 2 = 0)""")
shared("daily_snapshot", """
SELECT sc_id, CAST(recorded_at AS DATE) AS day, min(id) AS id FROM snapshots GROUP BY 1, 2""")
shared("claim_jobs", "SELECT id, job_type FROM (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY id) AS k FROM jobs WHERE status = 'pending') x WHERE k <= 4")
shared("alarm_transitions", """
SELECT id, mode, CASE WHEN bad AND NOT was THEN 'alarm' ELSE 'recovery' END AS message FROM (
  SELECT id, mode, bad, coalesce(lag(bad) OVER (PARTITION BY mode ORDER BY id), FALSE) AS was FROM (SELECT id, mode, NOT ok AS bad FROM runs) r) x WHERE bad <> was""")
shared("enqueue_backlog", """
SELECT t.id FROM tracks t WHERE t.energy IS NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.track_id = t.id AND j.status IN ('pending', 'running')) ORDER BY t.id LIMIT 50""")
shared("dead_man", "SELECT mode, max(finished_at) AS last_at, (SELECT max(finished_at) FROM runs) - INTERVAL 1 DAY > max(finished_at) AS overdue FROM runs GROUP BY mode")

# --- scalar functions --------------------------------------------------------------------
shared("bpm_bucket", "SELECT id, CAST(floor(bpm / 5) * 5 AS BIGINT) AS low, CAST(CAST(floor(bpm / 5) * 5 AS BIGINT) AS STRING) || '-' || CAST(CAST(floor(bpm / 5) * 5 AS BIGINT) + 5 AS STRING) AS label FROM tracks WHERE bpm IS NOT NULL")
# --- similarity --------------------------------------------------------------------------
shared("camelot_distance", """
SELECT id, CASE WHEN key_camelot IS NULL THEN NULL ELSE least(abs(n - 8), 12 - abs(n - 8)) + CASE WHEN l = 'A' THEN 0 ELSE 1 END END AS distance FROM (
  SELECT id, key_camelot, CAST(regexp_extract(coalesce(key_camelot, '0A'), '^([0-9]+)', 1) AS BIGINT) AS n, substr(coalesce(key_camelot, 'A'), length(coalesce(key_camelot, 'A')), 1) AS l FROM tracks) x""")
shared("energy_level", """
SELECT id, greatest(1, least(5, CASE WHEN bpm IS NULL THEN 3 WHEN bpm < 138 THEN 1 WHEN bpm < 145 THEN 2 WHEN bpm < 152 THEN 3 WHEN bpm < 160 THEN 4 ELSE 5 END
  + CASE WHEN lufs > -6 THEN 1 ELSE 0 END + CASE WHEN centroid > 3500 THEN 1 WHEN centroid < 1800 THEN -1 ELSE 0 END)) AS energy FROM tracks""")
shared("rating_step", "SELECT id, CASE WHEN rb_rating IS NULL THEN NULL ELSE least(5, greatest(0, CAST(floor((rb_rating * 51 + 25) / 51.0E0) AS INT))) END AS stars FROM tracks")
shared("url_host", "SELECT page_id, regexp_extract(lower(url), '^https?://(?:www\\.)?([^/:?#]+)', 1) AS host FROM pages".replace("\\\\", "\\"),
       "SELECT page_id, regexp_extract(lower(url), r'^https?://(?:www\\.)?([^/:?#]+)', 1) AS host FROM pages")
