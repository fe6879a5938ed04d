"""Adapter views: the roles of a media library over the driver's tables, in SQL that Spark and
DuckDB both run. A query names the views it needs; they are put in front as common table
expressions."""

from __future__ import annotations

import re

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "tracks": """
SELECT p_partkey AS id, p_brand AS artist, p_name AS title,
  '/music/' || CASE WHEN p_partkey % 3 = 0 THEN '[' || CAST(p_partkey AS STRING) || '] ' ELSE '' END || p_name || CASE WHEN p_partkey % 4 = 0 THEN '.wav' ELSE '.mp3' END AS path,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(120 + p_size AS DOUBLE) END AS bpm,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 100 AS DOUBLE) / 100 END AS bpm_confidence,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 12 + 1 AS STRING) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END END AS key_camelot,
  p_retailprice / 5 AS duration, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 41 AS DOUBLE) / 41 END AS breakdown_ratio,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey % 101 AS DOUBLE) / 101 END AS taste_score,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size % 5 + 1 END AS energy,
  CAST(p_partkey % 6 AS INT) AS rb_rating, CAST(p_partkey % 4 AS INT) AS rb_play_count,
  CASE WHEN p_partkey % 10 < 5 THEN 'archive' WHEN p_partkey % 10 < 8 THEN 'inbox' WHEN p_partkey % 10 = 8 THEN 'rejected' ELSE NULL END AS status,
  CASE WHEN p_partkey % 11 < 7 THEN 'ok' WHEN p_partkey % 11 = 7 THEN 'fake_transcode' WHEN p_partkey % 11 = 8 THEN 'clipped' WHEN p_partkey % 11 = 9 THEN 'corrupt' ELSE NULL END AS quality_status,
  CASE WHEN p_partkey % 8 = 0 THEN 'like' WHEN p_partkey % 8 = 1 THEN 'dislike' ELSE NULL END AS feedback,
  CASE WHEN p_partkey % 10 = 3 THEN p_partkey ELSE NULL END AS sc_id,
  CASE WHEN p_partkey % 15 = 0 THEN 'adopted' ELSE NULL END AS adopted,
  'p' || CAST(p_partkey % 2 AS STRING) AS profile_id, p_partkey * 1000 + p_size AS size,
  CAST(p_size AS DOUBLE) * 100 AS centroid, -4.0E0 - p_size % 5 AS lufs, p_type AS genre
FROM part""",
    "snapshots": """
SELECT event_id AS id, user_id AS sc_id, 'artist ' || CAST(user_id % 20 AS STRING) AS artist, 'title ' || CAST(user_id AS STRING) AS title,
  CAST(floor(coalesce(value, 0)) AS BIGINT) AS likes, event_id % 7 AS reposts, event_id % 5 AS comments, event_type AS tag, ts AS recorded_at
FROM events""",
    "votes": """
SELECT doc_id AS sc_id, 'https://host/' || CAST(doc_id AS STRING) AS url,
  CASE WHEN toxic = 1 THEN 'dislike' WHEN quality = 1 THEN 'like' ELSE 'later' END AS value FROM labels""",
    "store_items": """
SELECT l_partkey AS sc_id, 'p' || CAST(l_suppkey % 2 AS STRING) AS profile_id, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, min(l_orderkey) AS id
FROM lineitem GROUP BY 1, 2""",
    "jobs": """
SELECT o_orderkey AS id, o_custkey AS track_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'cues' WHEN 1 THEN 'embedding' ELSE 'energy' END AS job_type,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, o_orderdate AS updated_at
FROM orders""",
    "runs": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'discover' ELSE 'scout' END AS mode, o_orderdate AS finished_at,
  o_orderstatus <> 'P' AS ok, o_custkey % 50 AS found FROM orders""",
    "edges": """
SELECT DISTINCT o_custkey AS user_id, l_partkey AS track_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "items": """
SELECT user_id AS id, 'artist ' || CAST(user_id % 20 AS STRING) AS artist,
  100 * count(*) FILTER (WHERE event_type = 'view') AS plays, count(*) FILTER (WHERE event_type = 'click') AS likes,
  count(*) FILTER (WHERE event_type = 'purchase') AS reposts, count(*) FILTER (WHERE event_type = 'signup') AS comments,
  min(ts) AS created_at, max(ts) AS last_at FROM events GROUP BY user_id""",
    "seen": """
SELECT doc_id AS id, 'https://www.host.example/' || source || '/' || CAST(doc_id AS STRING) AS url, text AS title, source AS artist,
  CASE WHEN doc_id % 3 = 0 THEN 'cutoff too low' ELSE NULL END AS reason FROM documents""",
    "names": """
SELECT p_partkey AS id, 'B' || substr(p_brand, 7) AS artist,
  p_name || ' N' || CAST(p_partkey % 499 AS STRING) || ' M' || CAST(p_partkey % 211 AS STRING) || CASE p_partkey % 5 WHEN 0 THEN ' (Free Download)' WHEN 1 THEN ' [K' || CAST(p_partkey % 3 AS STRING) || ' Edit]' ELSE '' END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 200000 + 1000 * (p_partkey % 9) END AS duration_ms,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 200.0E0 + p_partkey % 9 END AS seconds,
  CASE WHEN p_partkey % 2 = 0 THEN 'asked' ELSE 'held' END AS side
FROM part""",
    "offers": """
SELECT page_id AS id, url, page_id % 11 = 0 AS downloadable, page_id % 22 = 0 AS has_downloads_left,
  CASE page_id % 6 WHEN 0 THEN 'https://www.hypeddit.com/t/' || CAST(page_id AS STRING) WHEN 1 THEN 'https://label.bandcamp.com/a' WHEN 2 THEN 'http://notbandcamp.com/a' WHEN 3 THEN '' ELSE NULL END AS purchase_url,
  'get it https://' || CASE page_id % 7 WHEN 0 THEN 'we.tl/x' WHEN 1 THEN 'mega.nz/x' WHEN 2 THEN 'drive.google.com/x' WHEN 3 THEN 'beatport.com/x' WHEN 4 THEN 'sub.toneden.io/x' ELSE 'example.org/x' END || ' (or http://dropbox.com.evil.tld/y)' AS description
FROM pages""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it names in front, those they name themselves first."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    front = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    sql = sql.strip()
    return f"WITH {front},\n{sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {front}\n{sql}"
