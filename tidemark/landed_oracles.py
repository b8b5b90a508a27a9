"""What landed_queries.py returns, as SQL over the driver's tables."""

from __future__ import annotations

from tidemark.oracles import ARTICLES, DAY, LOG, START, URLS
from tidemark.oracles import SQL as CORE

NOW = START + 3650 * DAY


def _day(n: str) -> str:
    return f"strftime(make_timestamp(({START} + ({n}) * {DAY}) * 1000), '%Y-%m-%d')"


def _docs(each: int) -> str:
    return f"d AS (SELECT doc_id, lang, source, 's' || (doc_id // {each}) AS source_id FROM documents)"


# A site's sitemaps, of which the newest five are read; their entries; and those that a run visits.
MAPPED = f"""{_docs(80)},
  c0 AS (SELECT DISTINCT source_id, doc_id % 7 AS child FROM d),
  c AS (SELECT source_id, child, row_number() OVER (PARTITION BY source_id ORDER BY child * 3 % 7 DESC, child) AS r FROM c0),
  e AS (SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id % 31 DESC, r, doc_id) AS rank FROM d JOIN c USING (source_id)
        WHERE child = doc_id % 7 AND r <= 5 AND doc_id % 9 <> 0 AND NOT starts_with(CAST(doc_id AS VARCHAR), '5')),
  n AS (SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY rank) AS place, doc_id % 11 <> 0 AS readable, doc_id % 3 = 0 AS weak FROM e WHERE doc_id % 5 <> 0),
  v AS (SELECT *, coalesce(sum(CASE WHEN readable AND weak THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS undated FROM n WHERE place <= 9),
  visited AS (SELECT * FROM v WHERE undated < 2)"""

ANSWERS = f"""{_docs(50)},
  r AS (SELECT source_id, doc_id, lang, source, doc_id % 50 // 10 AS page, '/d/' || (doc_id - doc_id % 4 % 3) AS url, 'Headline ' || doc_id AS title, CASE WHEN doc_id % 3 <> 0 THEN {START} + doc_id % 997 * {DAY} END AS ms, doc_id % 6 <> 5 AND doc_id % 8 <> 0 AS good FROM d),
  f AS (SELECT *, good AND row_number() OVER (PARTITION BY source_id, url, good ORDER BY doc_id) = 1 AS use FROM r),
  p AS (SELECT source_id, page, count(*) AS size, count(*) FILTER (WHERE use) AS usable FROM f GROUP BY ALL),
  o AS (SELECT source_id, page, coalesce(max(CASE WHEN usable = 0 OR size < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM p),
  j AS (SELECT f.*, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) - 1 AS source_pos FROM f JOIN o USING (source_id, page) WHERE use AND over = 0)"""

CALLS = r"""c AS (SELECT CAST(conv_id AS VARCHAR) AS call, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS record FROM conversations),
  k AS (SELECT *, trim(text) AS t, coalesce(regexp_matches(trim(text), '^(https?://|/[^/\s])') AND NOT contains(text, ' '), false) AS u FROM c WHERE n >= 2 AND record < 50),
  s AS (SELECT *, coalesce(length(t) BETWEEN 12 AND 300 AND regexp_matches(t, '\s') AND NOT u AND NOT regexp_matches(t, '^[{\[<]'), false) AS titled FROM k)"""

# Feeds of 40 documents, their outcome by number, and what of them is not known yet.
FED = f"""{_docs(40)},
  i AS (SELECT source_id, doc_id // 40 AS k, doc_id, lang, source, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS source_pos, {START} + doc_id % 1000 * {DAY} AS published_at FROM d WHERE doc_id % 4 <> 2),
  s AS (SELECT source_id, k, k % 4 * 4 + 3 AS take, CASE k % 6 WHEN 2 THEN 'not-modified' WHEN 4 THEN 'error' ELSE 'ok' END AS status, CASE WHEN k % 6 IN (1, 3, 4) THEN 1 ELSE 0 END AS attempt FROM (SELECT DISTINCT source_id, doc_id // 40 AS k FROM d)),
  g AS (SELECT i.*, take, doc_id % 10 IN (3, 5) AS known FROM i JOIN s USING (source_id) WHERE status = 'ok'),
  f AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS fresh, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, source_pos) AS rank FROM g WHERE NOT known)"""
# The same documents by every kind of adapter; interfaces and sitemaps take the newest 25 of a run.
KINDS = f"""{_docs(40)},
  i AS (SELECT source_id, doc_id, lang, source, ['rss', 'json', 'sitemap', 'html'][CAST(doc_id // 40 % 4 + 1 AS INT)] AS kind, doc_id // 160 % 4 * 8 + 3 AS take, {START} + doc_id % 1000 * {DAY} AS published_at FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, doc_id) AS rank FROM i),
  f AS (SELECT * FROM r WHERE rank <= 25 OR kind IN ('rss', 'html'))"""
TAGS = "CASE WHEN lang IN ('en', 'fr', 'de') THEN 'region:' || lang || ',' ELSE '' END || 'scope:macro'"
HOST = r"regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#:@]+)', 1)), '^(www|m)\.', '')"

SQL = {
    "feed_scan": f"""WITH {_docs(20)} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) - 1 AS source_pos, 'https://www.' || source || '.example/' || lang || '/' || doc_id || '/?utm_source=feed&b=1' AS url,
        'Report & review ' || doc_id AS title, 'On ' || lang || ' & more' AS summary, {_day('doc_id % 1000')} AS published_raw, lang || ',' || source AS categories FROM d WHERE doc_id % 4 <> 2""",
    "sitemap_parse": f"SELECT CAST(page_id // 20 AS VARCHAR) AS source_id, false AS is_index, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS source_pos, trim(url) AS loc, {_day('page_id')} AS lastmod FROM pages",
    "sitemap_scan": f"""WITH {MAPPED} SELECT source_id, place - 1 AS source_pos, 'https://' || source_id || '.example/en/' || doc_id || '.html' AS url, 'Page ' || doc_id AS title,
        CASE WHEN weak THEN {_day('doc_id % 31')} ELSE {_day('doc_id % 500')} END AS published_raw, weak AS date_is_weak FROM visited WHERE readable""",
    "sitemap_visited": f"WITH {MAPPED} SELECT source_id, count(*) AS visited FROM visited GROUP BY source_id",
    "sitemap_children": f"WITH {MAPPED} SELECT source_id, child AS source_pos, r AS rank FROM c WHERE r <= 5",
    "html_listing": f"""WITH {_docs(20)} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) - 1 AS source_pos, 'https://' || source_id || '.example/a/' || doc_id || '?x=1' AS url, 'Card ' || doc_id || ' & more' AS title,
        'On ' || lang AS summary, {_day('doc_id % 900')} AS published_raw FROM d WHERE doc_id % 5 <> 4 AND doc_id % 7 <> 6""",
    "article_meta": f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Open & ' WHEN 1 THEN 'Tweet ' WHEN 2 THEN 'Linked ' ELSE 'Tag ' END || doc_id AS title, {_day('doc_id % 700')} AS published_raw,
        CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang || ',' || source WHEN 2 THEN 'a,b,' || source ELSE '' END AS categories FROM documents""",
    "json_scan": f"WITH {ANSWERS} SELECT source_id, source_pos, url, title, CAST(ms AS VARCHAR) AS published_raw, lang || ',' || source AS categories FROM j",
    "json_newest": f"""WITH {ANSWERS}, x AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(ms, 0) DESC, source_pos) - 1 AS place FROM j)
        SELECT source_id, CASE WHEN n > 12 THEN place ELSE source_pos END AS source_pos, title FROM x WHERE place < 12""",
    "json_problems": "SELECT CASE event_id % 3 WHEN 0 THEN 'not JSON' ELSE 'items_path k is not an array' END AS error, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY 1",
    "render_template": "SELECT c_custkey, 'https://x/' || (c_custkey % 7) || '?o=' || (c_custkey % 4 * 25) || '&t={{token}}&n=' || c_name AS address FROM customer",
    "token_auth": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 3 = 1 THEN 'one' ELSE 'failed' END WHEN c_custkey % 4 = 0 THEN 'failed' ELSE CAST(c_custkey AS VARCHAR) END AS token FROM customer",
    "robots_rules": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path, length(regexp_extract(url, '(?i)^https?://[^/?#@]+')) % 10 AS n FROM pages),
        b AS (SELECT page_id, greatest(CASE WHEN starts_with(path, '/en/') THEN 4 ELSE -1 END, CASE WHEN starts_with(path, '/') AND ends_with(path, '.html') THEN 8 ELSE -1 END) AS deny, CASE WHEN starts_with(path, '/en/' || n) THEN 5 ELSE -1 END AS allow FROM p)
        SELECT page_id, deny < 0 OR allow >= deny AS allowed FROM b""",
    "proxy_rules": "SELECT c_custkey, CASE c_custkey // 2 % 4 WHEN 3 THEN true WHEN 0 THEN c_custkey % 2 = 1 AND c_custkey % 256 >= CASE c_custkey % 3 WHEN 0 THEN 128 WHEN 1 THEN 64 ELSE 32 END ELSE false END AS proxied FROM customer",
    "failure_texts": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Blocked by the network proxy (HTTP 403) before reaching the site' WHEN 1 THEN 'Timed out waiting for a response' WHEN 2 THEN 'Connection refused' ELSE 'site ' || c_custkey || ' closed' END AS said FROM customer",
    "absolute_urls": r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '(?i)^https?://[^/?#@]+')) AS o, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) AS path FROM pages)
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN o || CASE WHEN path = '' THEN '/one/two/three' ELSE path END WHEN 1 THEN o || '/one/up/' || page_id ELSE 'mailto:a@b.c' END AS address FROM p""",
    "sort_keys": f"SELECT event_id, CAST(CASE event_id % 4 WHEN 2 THEN epoch_us(ts) // 1000 // {DAY} * {DAY} WHEN 3 THEN epoch_us(ts) // 1000 ELSE 0 END AS BIGINT) AS sort_ms FROM events",
    "literal_patterns": r"SELECT page_id, contains(lower(html), '<p>(') AS bracket, contains(lower(url), '*.html') AS star, regexp_matches(url, 'page=\d', 'i') AS pattern FROM pages",
    "suggested_names": rf"""WITH h AS (SELECT page_id, string_split({HOST}, '.') AS l, list_filter(string_split(regexp_extract(url, '^(?i:https?)://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')[-1] AS slug FROM pages),
        n AS (SELECT page_id, CASE WHEN len(l) > 1 THEN l[-2] ELSE l[1] END AS site, slug FROM h)
        SELECT page_id, trim(regexp_replace(lower(concat_ws('-', site, slug)), '[^a-z0-9]+', '-', 'g'), '-') AS id, array_to_string(list_transform(string_split(regexp_replace(site, '[-_]+', ' ', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS institution FROM n""",
    "query_parameters": """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 50 ELSE greatest(1, least(200, event_id)) END AS BIGINT) AS "limit", 'a:' || (event_id % 3) || '|b|' || event_type AS tags,
        CASE event_id % 3 WHEN 0 THEN '24h' WHEN 1 THEN 'all' ELSE '7d' END AS since, CASE WHEN event_id % 2 = 0 THEN 'oldest' ELSE 'newest' END AS sort, event_type AS q FROM events""",
    "normalised_items": f"""SELECT lang AS source_id, doc_id AS source_pos, 'https://www.' || lang || '.example/a/' || doc_id AS url, sha256('https://' || lang || '.example/a/' || doc_id) AS canonical_hash, 'Title of ' || doc_id AS title, 'title of ' || doc_id AS title_key,
        CAST({START} + doc_id % 900 * {DAY} AS BIGINT) AS published_at, doc_id % 3 = 0 AS date_estimated, lang AS categories, {TAGS} AS tags FROM documents WHERE doc_id % 13 > 1 AND doc_id % 17 <> 0""",
    "normalise_rejects": "SELECT lang AS source_id, doc_id AS source_pos, CASE WHEN doc_id % 13 <= 1 THEN 'unusable url' ELSE 'empty title' END AS reason FROM documents WHERE doc_id % 13 <= 1 OR doc_id % 17 = 0",
    "surrogate_ids": "SELECT doc_id, 1000 + row_number() OVER (ORDER BY lang || '-' || lpad(CAST(doc_id AS VARCHAR), 20, '0')) AS item_id FROM documents",
    "mark_seen": f"WITH {URLS} SELECT 's' AS source_id, canonical_hash, CAST(CASE WHEN bool_or(page_id % 3 = 0) THEN 1 ELSE 2 END AS BIGINT) AS seen_at FROM uh GROUP BY canonical_hash",
    "record_fetch": f"""WITH {LOG} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 2 = 1 THEN last_status WHEN id % 3 = 0 THEN 'ok' WHEN id % 3 = 1 THEN 'empty' ELSE 'not-modified' END AS last_status, CASE WHEN id % 2 = 1 THEN 'old' WHEN id % 3 = 1 THEN 'none' END AS last_error,
        CAST(CASE WHEN id % 2 = 1 THEN 9 ELSE id % 5 END AS INT) AS last_item_count, CAST(CASE WHEN id % 2 = 1 THEN last_fetch_at ELSE 7 END AS BIGINT) AS last_fetch_at, CASE WHEN id % 6 = 0 THEN 'new' ELSE 'e' || id END AS etag, 'm' AS last_modified,
        CASE WHEN id % 2 = 1 THEN consecutive_failures WHEN id % 3 = 1 THEN consecutive_failures + 1 ELSE 0 END AS consecutive_failures FROM reg""",
    "sweep_tags": f"WITH {ARTICLES} SELECT item_id, unnest(list_distinct(tags)) AS tag FROM a WHERE item_id % 4 <> 0",
    "swept_count": f"WITH {ARTICLES} SELECT CAST(coalesce(sum(len(list_distinct(tags))), 0) AS BIGINT) AS orphans FROM a WHERE item_id % 4 = 0",
    "run_summary": "SELECT CAST(sum(event_id % 4) AS BIGINT) AS inserted, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS broken, count(*) AS sources FROM events",
    "adapter_chain": """WITH t AS (SELECT user_id || '-' || strftime(ts, '%d') AS source_id, event_id, event_type = 'error' AS failed, event_id % 23 = 0 AS nm, event_id % 3 % 2 AS n, event_id % 29 = 0 AS he FROM events),
        a AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY event_id) - 1 AS attempt, NOT failed AND (nm OR n > 0 OR he) AS good FROM t),
        u AS (SELECT source_id, coalesce(min(attempt) FILTER (WHERE good), max(attempt)) AS attempt FROM a GROUP BY source_id)
        SELECT source_id, attempt, CASE WHEN failed THEN 'error' WHEN nm THEN 'not-modified' WHEN n = 0 AND NOT he THEN 'empty' ELSE 'ok' END AS status FROM u JOIN a USING (source_id, attempt)""",
    "config_errors": """WITH c AS (SELECT c_custkey, c_custkey AS k, CASE WHEN c_custkey % 250 BETWEEN 1 AND 200 THEN c_custkey % 250 ELSE 5 END AS take FROM customer)
        SELECT c_custkey, CAST(2 + (k % 250 NOT BETWEEN 1 AND 200)::INT + (k % 2000 NOT BETWEEN 5 AND 1440)::INT + (k % 3 = 1 AND k % 40 + 1 > take)::INT + (k % 3 = 2)::INT + (k % 2 = 0)::INT AS BIGINT) AS errors FROM c""",
    "config_rows": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 1 THEN 45 ELSE 30 END AS BIGINT) AS poll, c_custkey % 50 + 1 AS take, c_custkey % 3 = 0 AS enabled, CAST(1 AS BIGINT) AS unknown FROM customer",
    "undeclared_tags": "SELECT c_custkey, CAST((c_custkey % 5 > 2)::INT + (c_custkey % 4 = 3)::INT AS BIGINT) AS errors FROM customer",
    "record_arrays": f"WITH {CALLS} SELECT call, 'page.hits' AS path, unnest(['a.headline', 'a.b.c', 'a.b.link', 'tags']) AS key, count(*) AS records, max(n) AS size FROM k GROUP BY call",
    "field_match_rates": f"""WITH {CALLS}, m AS (SELECT call, count(*) AS n, sum(u::INT) AS u, sum(titled::INT) AS t, sum((length(t) > 60)::INT) AS l FROM s GROUP BY call)
        SELECT call, 'page.hits' AS path, 'a.headline' AS key, round(u / n, 9) AS url, round(t / n + 0.6::DOUBLE, 9) AS title, round(l / n, 9) AS summary, 0.0::DOUBLE AS categories FROM m
        UNION ALL SELECT call, 'page.hits', 'a.b.c', 0, 0, 0, 0 FROM m UNION ALL SELECT call, 'page.hits', 'a.b.link', 1.6, 0, 0, 0 FROM m UNION ALL SELECT call, 'page.hits', 'tags', 0, 0, 0, 1.6 FROM m""",
    "field_guesses": f"WITH {CALLS} SELECT DISTINCT call, 'page.hits' AS path, 'a.b.link' AS best_url, 'a.headline' AS best_title, CAST(NULL AS VARCHAR) AS best_summary, 'tags' AS best_categories FROM k",
    "network_candidates": f"""WITH {CALLS}, m AS (SELECT call, max(n) AS n, sum(titled::INT) AS t FROM s WHERE record < 20 AND CAST(call AS BIGINT) % 10 <> 0 GROUP BY call)
        SELECT call, 'page.hits' AS path, round(3.0 + 3.0 * t / least(n, 20) + least(n / 20, 1.0), 6)::DOUBLE AS score, 'a.b.link' AS best_url, 'a.headline' AS best_title FROM m WHERE t > 0 ORDER BY score DESC, call LIMIT 5""",
    "field_samples": f"WITH {CALLS}, f AS (SELECT call, role AS text, row_number() OVER (PARTITION BY call ORDER BY min(record)) AS r FROM k GROUP BY call, role) SELECT call, text FROM f WHERE r <= 2",
    "listing_classes": f"""WITH {_docs(20)}, l AS (SELECT 'https://' || source_id || '.example/en/insights' AS url, doc_id % 5 = 1 AS hinted, unnest(CASE WHEN doc_id % 2 = 0 THEN ['head', 'card', 'even'] ELSE ['head', 'card'] END) AS name FROM d WHERE doc_id % 5 <> 0),
        g AS (SELECT url, name, count(*) AS nodes, bool_or(hinted) AS hinted FROM l GROUP BY ALL HAVING count(*) >= 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY hinted DESC, nodes DESC, length(name) DESC, name) AS rank FROM g) SELECT * FROM r WHERE rank <= 5""",
    "embedded_payloads": "SELECT DISTINCT 'https://s' || (doc_id // 20) || '.example/en/insights' AS url, unnest(['{\"a\": 1}', '[2]']) AS body FROM documents",
    "feed_probes": f"WITH {_docs(20)} SELECT source_id AS url, count(*) AS entries FROM d WHERE doc_id % 4 <> 2 AND NOT ends_with(source_id, '3') GROUP BY source_id",
    "feed_addresses": """WITH p AS (SELECT DISTINCT 'https://s' || (doc_id // 20) || '.example' AS home FROM documents),
        a AS (SELECT home, unnest(['/rss', '/feed', '/rss.xml', '/feed.xml', '/atom.xml', '/index.xml', '/feeds/all.xml', '/rss/all.xml', '/en/rss']) AS path, unnest(range(1, 10)) AS place FROM p)
        SELECT home || '/en/insights' AS url, 0::BIGINT AS place, home || '/my/feed declared' AS address FROM p UNION ALL SELECT home || '/en/insights', place, home || path || ' probed' FROM a""",
    "sitemap_probes": f"WITH {_docs(80)} SELECT 'https://' || source_id || '.example/map' || (doc_id % 7) || '.xml' AS url, count(*) AS locs, count(*) FILTER (WHERE doc_id % 9 <> 0) AS matching FROM d GROUP BY 1",
    "sitemap_addresses": "SELECT c_custkey, least(8, 2 + c_custkey % 12) AS n, 'https://h.example/' || CASE WHEN c_custkey % 12 = 0 THEN 'sitemap_index' ELSE CAST(least(c_custkey % 12, 6) - 1 AS VARCHAR) END || '.xml' AS last FROM customer",
    "redacted_headers": "SELECT c_custkey, c_name AS accept, CASE WHEN c_custkey % 2 = 0 THEN 'Bearer ' ELSE '' END || '{{token}}' AS auth, '{{token}}' AS api_key, 3::BIGINT AS kept FROM customer",
    "suggestions": r"""WITH k AS (SELECT c_custkey, c_custkey % 5 AS r, CASE WHEN c_custkey % 7 = 0 THEN 'browser' ELSE 'html' END AS page FROM customer)
        SELECT c_custkey, CASE WHEN r = 0 THEN 'json' WHEN r = 1 THEN 'rss' WHEN r = 2 AND c_custkey % 2 = 1 THEN 'sitemap' WHEN r < 4 THEN page END AS kind,
            CASE WHEN r = 0 THEN 'p' WHEN r = 1 THEN 'f' WHEN r = 2 AND c_custkey % 2 = 1 THEN '/part' || (c_custkey % 3) || '/' WHEN r < 4 THEN '.a\:b' END AS what, CAST(CASE WHEN r < 4 THEN 1 ELSE 0 END AS BIGINT) AS name FROM k""",
    "ingest_outcomes": f"""WITH {FED}, n AS (SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE known) AS known FROM g GROUP BY source_id)
        SELECT source_id, status, CAST(attempt AS BIGINT) AS attempt, coalesce(fetched, 0) AS fetched, CAST(CASE WHEN fetched IS NULL THEN 0 ELSE least(fetched - known, take) END AS BIGINT) AS inserted, coalesce(known, 0) AS duplicate_url, CAST(0 AS BIGINT) AS duplicate_title,
            CAST(CASE WHEN fetched IS NULL THEN 0 ELSE greatest(fetched - known - take, 0) END AS BIGINT) AS held, CASE WHEN status = 'error' THEN 'rss: returned no items | rss: HTTP 503' END AS error FROM s LEFT JOIN n USING (source_id)""",
    "ingest_items": f"""WITH {FED} SELECT source_id, 'Report & review ' || doc_id AS title, 'https://www.' || source || '.example/' || lang || '/' || doc_id || '/?utm_source=feed&b=1' AS url, CAST(published_at AS BIGINT) AS published_at, {TAGS} AS tags FROM f WHERE rank <= take""",
    "ingest_fetches": f"""WITH {FED}, n AS (SELECT source_id, count(*) AS fetched FROM g GROUP BY source_id)
        SELECT source_id, status, coalesce(fetched, 0) AS item_count, CASE WHEN status = 'ok' AND attempt = 0 THEN 'e' || k END AS etag FROM s LEFT JOIN n USING (source_id)""",
    "ingest_notes": f"""WITH {FED}, n AS (SELECT 's' || (doc_id // 40) AS source_id, count(*) AS n FROM documents WHERE doc_id % 4 IN (0, 3) AND source = 'src1' GROUP BY 1)
        SELECT source_id, least(n, 5) AS n, 'unusable url' AS notes FROM n JOIN s USING (source_id) WHERE status = 'ok'""",
    "due_outcomes": f"""WITH {FED}, n AS (SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE known) AS known FROM g GROUP BY source_id)
        SELECT source_id, status, coalesce(fetched, 0) AS fetched, CAST(CASE WHEN fetched IS NULL THEN 0 ELSE least(fetched - known, take) END AS BIGINT) AS inserted, coalesce(known, 0) AS duplicate_url,
            CAST(CASE WHEN fetched IS NULL THEN 0 ELSE greatest(fetched - known - take, 0) END AS BIGINT) AS held FROM s LEFT JOIN n USING (source_id) WHERE k % 3 <> 0""",
    "ingest_kinds": f"""WITH {KINDS} SELECT source_id, 'ok' AS status, kind AS adapter_kind, count(*) AS fetched, CAST(least(count(*), any_value(take)) AS BIGINT) AS inserted, CAST(greatest(count(*) - any_value(take), 0) AS BIGINT) AS held FROM f GROUP BY source_id, kind""",
    "ingest_kind_items": f"""WITH {KINDS} SELECT source_id, 'Report number ' || doc_id AS title, 'https://' || source || '.example/' || lang || '/report-number-' || doc_id AS url, CAST(published_at AS BIGINT) AS published_at, kind = 'sitemap' AS date_estimated FROM f WHERE rank <= take""",
    "ingest_drains": f"""WITH {FED}, r AS (SELECT source_id, published_at, (row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, source_pos) - 1) // take AS run FROM g)
        SELECT source_id, run, count(*) AS n, CAST(min(published_at) AS BIGINT) AS oldest FROM r WHERE run < 3 GROUP BY ALL""",
    "registry_health": f"""WITH {LOG}, {ARTICLES} SELECT (SELECT count(*) FROM reg WHERE enabled AND in_config) AS sources, (SELECT count(*) FROM a) AS total_items, (SELECT max(first_seen_at) FROM a) AS last_ingest_at,
        (SELECT count(*) FROM reg WHERE enabled AND in_config AND last_status IN ('error', 'empty')) AS broken""",
    "declared_facets": f"""WITH {ARTICLES}, n AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT item_id, split_part(tag, ':', 1) AS id FROM (SELECT item_id, unnest(tags) AS tag FROM a)) GROUP BY id)
        SELECT id, label, place, vals, coalesce(n, 0) AS n FROM (VALUES ('type', 'Type', 0::BIGINT, 'short|long|none'), ('region', 'Region', 1, 'en|fr|de|es|it'), ('theme', 'Theme', 2, 'article|license|contact|plain'), ('scope', 'Scope', 3, 'macro|micro')) t(id, label, place, vals) LEFT JOIN n USING (id)""",
    "streamed_fold": CORE["near_duplicate_greedy"],
}
