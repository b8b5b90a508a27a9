"""What queries.py returns, as SQL over the driver's tables."""

from __future__ import annotations

START, HOUR, DAY = 1704067200000, 3600000, 86400000

RULES = r"""list_filter([
    CASE WHEN regexp_matches(hay, '\bthe\b|\bles?\b|\bder\b', 'i') THEN 'theme:article' END,
    CASE WHEN regexp_matches(hay, 'licen[cs]e', 'i') AND regexp_matches(hay, '\bmit\b|\bgnu\b|public', 'i') THEN 'theme:license' END,
    CASE WHEN regexp_matches(hay, '\+\d|@\w', 'i') THEN 'theme:contact' END,
    CASE WHEN NOT regexp_matches(hay, '\d|[#|*]', 'i') THEN 'theme:plain' END], lambda x: x IS NOT NULL)"""

_BARE = r"regexp_replace(regexp_replace(regexp_replace({col}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "''")):
    _BARE = f"regexp_replace({_BARE}, '(?i){_entity}', '{_char}', 'g')"
_FLAT = rf"trim(regexp_replace({_BARE}, '[\s\x{{{{00a0}}}}\x{{{{0b}}}}]+', ' ', 'g'))"
EXCERPT = f"list_transform([{_FLAT}], lambda t: CASE WHEN t = '' THEN NULL WHEN length(t) > 400 THEN rtrim(substr(t, 1, 399)) || '…' ELSE t END)[1]"

ARTICLES = f"""a0 AS (
    SELECT doc_id AS item_id, source || '-' || lang AS source_id, source AS institution, lang,
           trim(split_part(text, chr(10), 1)) AS title, {EXCERPT.format(col="text")} AS summary,
           CAST({START} + doc_id * {HOUR} AS BIGINT) AS published_at, doc_id % 5 < 2 AS date_estimated,
           CAST({START} + doc_id * {HOUR} + {DAY} AS BIGINT) AS first_seen_at, n_chars FROM documents),
  a1 AS (SELECT *, title || chr(10) || coalesce(summary, '') AS hay FROM a0),
  a2 AS (SELECT *, {RULES} AS themes FROM a1),
  a AS (SELECT *, list_sort(list_concat([CASE WHEN n_chars > 2000 THEN 'type:long' ELSE 'type:short' END, 'region:' || lang], themes)) AS tags FROM a2),
  now AS (SELECT max(published_at) + 1 AS ms FROM a)"""

ROW = "item_id, institution, title, published_at, date_estimated, array_to_string(tags, ',') AS tags"
REGION = "list_has_any(tags, ['region:fr', 'region:de'])"
LONG = "list_contains(tags, 'type:long')"
SINCE = f"published_at >= (SELECT ms FROM now) - {30 * DAY}"


def _page(where: str, limit: int, way: str = "DESC") -> str:
    return f"WITH {ARTICLES} SELECT {ROW} FROM a WHERE {where} ORDER BY date_estimated, published_at {way}, item_id {way} LIMIT {limit}"


COUNTS = f"""ex AS (SELECT item_id, unnest(tags) AS tag FROM a WHERE {SINCE}),
  n AS (SELECT tag, count(*) AS n FROM ex JOIN a USING (item_id)
        WHERE (tag LIKE 'region:%' OR {REGION}) AND (tag LIKE 'type:%' OR {LONG}) GROUP BY tag)"""

# Fixed values, as in functions/urls.py.
TRACKED = "^(utm_.*|gclid|fbclid|msclkid|igshid|mc_cid|mc_eid|yclid|dclid|_ga|_gl|ref|referrer|sc_camp|sc_channel|trk|trkinfo|linkid|cmpid|campaignid|sfmc_id)$"
URLS = f"""u0 AS (SELECT page_id, url, regexp_extract(trim(url), '(?i)^https?://([^/?#:@]+)([^?#]*)(?:\\?([^#]*))?', ['host', 'path', 'query']) AS p FROM pages),
  u AS (SELECT page_id, url, 'https://' || regexp_replace(lower(p.host), '^www\\.', '')
          || CASE WHEN p.path = '' THEN '/' WHEN length(p.path) > 1 THEN regexp_replace(p.path, '/+$', '') ELSE p.path END
          || coalesce('?' || nullif(array_to_string(list_sort(list_transform(list_filter(string_split(p.query, '&'),
               lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '{TRACKED}')), lambda x: CASE WHEN x LIKE '%=%' THEN x ELSE x || '=' END)), '&'), ''), '') AS canonical FROM u0),
  uh AS (SELECT *, sha256(canonical) AS canonical_hash, lower(regexp_extract(url, '(?i)^https?://[^/?#@]+')) AS source_id FROM u)"""

TITLED = f"t AS (SELECT doc_id AS pos, lang AS institution, split_part(text, chr(10), 1) AS title_key, CAST({START} + doc_id * {HOUR} AS BIGINT) AS published_at FROM documents)"
FOLD = f"list_reduce(list_sort(list({{'pos': pos, 'at': published_at}})), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y.at - x.at) <= {7 * DAY})) = 0 THEN list_append(acc, x) ELSE acc END, CAST([] AS STRUCT(pos BIGINT, \"at\" BIGINT)[]))"
LOG = """l AS (SELECT user_id AS source_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r,
    sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS good_after FROM events),
  s AS (SELECT source_id, count(*) FILTER (WHERE good_after = 0) AS consecutive_failures, count(*) AS fetches FROM l GROUP BY source_id),
  reg AS (SELECT source_id AS id, 'inst' || (source_id % 7) AS institution, 'name' || source_id AS name, source_id % 11 <> 0 AS enabled, source_id % 13 <> 0 AS in_config,
            epoch_us(ts) // 1000 AS last_fetch_at, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'empty' ELSE 'ok' END AS last_status, consecutive_failures
          FROM l JOIN s USING (source_id) WHERE r = 1)"""
CUT = "c AS (SELECT (max(published_at) + min(published_at)) // 2 AS ms FROM a)"
OLD = "CASE WHEN date_estimated THEN first_seen_at < (SELECT ms FROM c) ELSE published_at < (SELECT ms FROM c) END"

SQL = {
    "panel_page_newest": _page(f"{SINCE} AND {REGION} AND {LONG}", 20),
    "panel_page_oldest": _page(f"{SINCE} AND {REGION} AND {LONG}", 20, "ASC"),
    "panel_cursor_page2": _page(f"date_estimated OR published_at < {START + 500 * HOUR} OR (published_at = {START + 500 * HOUR} AND item_id < 500)", 20),
    "panel_since_7d": _page(f"published_at >= (SELECT ms FROM now) - {7 * DAY}", 50),
    "panel_search_literal": _page("contains(title, '%') OR contains(summary, '%')", 50),
    "panel_search": _page("contains(lower(title), 'license') OR contains(lower(summary), 'license')", 50),
    "panel_institution_in": _page("institution IN ('src1', 'src2')", 50),
    "panel_tags_or_within_and_across": _page("list_has_any(tags, ['region:fr', 'region:es']) AND list_contains(tags, 'theme:plain')", 50),
    "panel_facetless_tag_ignored": _page("true", 50),
    "panel_total": f"WITH {ARTICLES} SELECT count(*) AS total FROM a WHERE {SINCE} AND {REGION} AND {LONG}",
    "panel_page_store": _page(f"{SINCE} AND {REGION} AND {LONG}", 20),
    "facet_tags_store": f"WITH {ARTICLES}, {COUNTS} SELECT tag, n FROM n",
    "facet_tags_from_bitmaps": f"WITH {ARTICLES}, {COUNTS} SELECT tag, n FROM n",
    "facet_institution_from_bitmaps": f"WITH {ARTICLES} SELECT institution, count(*) AS n FROM a WHERE {SINCE} AND {REGION} AND {LONG} GROUP BY institution",
    "panel_search_by_trigrams": f"WITH {ARTICLES} SELECT item_id, institution, title, published_at FROM a WHERE contains(lower(title), 'license') OR contains(lower(summary), 'license')",
    "facet_institution": f"WITH {ARTICLES} SELECT institution, count(*) AS n FROM a WHERE {SINCE} AND {REGION} AND {LONG} GROUP BY institution",
    "facet_tags_self_excluded": f"WITH {ARTICLES}, {COUNTS} SELECT tag, n FROM n",
    "facet_zero_fill": f"""WITH {ARTICLES}, {COUNTS},
        f(facet, label, facet_pos, "values") AS (VALUES ('type', 'Type', 0, ['short', 'long', 'none']), ('region', 'Region', 1, ['en', 'fr', 'de', 'es', 'it']),
            ('theme', 'Theme', 2, ['article', 'license', 'contact', 'plain']), ('scope', 'Scope', 3, ['macro', 'micro'])),
        v AS (SELECT facet, label, facet_pos, unnest("values") AS value, CAST(generate_subscripts("values", 1) - 1 AS INT) AS value_pos FROM f)
        SELECT facet, label, facet_pos, value, value_pos, coalesce(n, 0) AS n FROM v LEFT JOIN n ON tag = facet || ':' || value""",
    "corpus_totals": f"WITH {ARTICLES} SELECT count(*) AS total_items, max(first_seen_at) AS last_ingest_at FROM a",
    "items_with_source_name": "SELECT o_orderkey AS item_id, CAST(o_custkey AS VARCHAR) AS source_id, c_name AS source_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "item_tags_exploded": f"WITH {ARTICLES} SELECT item_id, unnest(list_distinct(tags)) AS tag FROM a",
    "item_tags_joined": f"WITH {ARTICLES} SELECT item_id, institution, CASE WHEN item_id % 7 = 0 THEN '' ELSE array_to_string(tags, ',') END AS tags FROM a",
    "tags_semi_join": f"WITH {ARTICLES} SELECT item_id FROM a WHERE {REGION} AND {LONG}",
    "url_canonical": f"WITH {URLS} SELECT page_id, canonical FROM u",
    "url_canonical_exact": f"WITH {URLS} SELECT page_id, canonical FROM u",
    "url_canonical_hash": f"WITH {URLS} SELECT page_id, canonical_hash FROM uh",
    "url_exact_dedupe": f"WITH {URLS} SELECT min(page_id) AS page_id, canonical_hash FROM uh GROUP BY canonical_hash",
    "title_key": rf"""WITH {ARTICLES}, k AS (SELECT item_id, trim(regexp_replace(lower(strip_accents(regexp_replace(title, '\s+[|•·]\s+(\S+\s+){{0,3}}\S+$', ''))), '[^a-z0-9]+', ' ', 'g')) AS k FROM a)
        SELECT item_id, CASE WHEN length(k) >= 8 THEN k ELSE '' END AS title_key FROM k""",
    "display_title": f"""WITH {ARTICLES}, d AS (SELECT item_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS clean FROM a)
        SELECT item_id, CASE WHEN clean = '' THEN '| ' || CASE WHEN item_id % 3 = 0 THEN upper(substr(institution, 1, 1)) || substr(institution, 2) ELSE 'another' END
            WHEN item_id % 3 = 0 THEN clean ELSE clean || ' | another' END AS title FROM d JOIN a USING (item_id)""",
    "excerpt": r"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
        y AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'),
            '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '(?i)&#39;|&apos;', '''', 'g'), '[\s\x{00a0}]+', ' ', 'g')) AS t FROM x)
        SELECT page_id, CASE WHEN t = '' THEN NULL WHEN length(t) > 400 THEN rtrim(substr(t, 1, 399)) || '…' ELSE t END AS excerpt FROM y""",
    "title_from_url": r"""WITH s AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^(?i:https?)://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')[-1] AS slug FROM pages),
        c AS (SELECT page_id, url, coalesce(trim(regexp_replace(regexp_replace(slug, '\.(html?|aspx|php)$', '', 'i'), '[-_]+', ' ', 'g')), '') AS c FROM s)
        SELECT page_id, CASE WHEN c = '' THEN url ELSE upper(substr(c, 1, 1)) || substr(c, 2) END AS title FROM c""",
    "url_origin": f"WITH {URLS} SELECT page_id, source_id AS origin FROM uh",
    "json_path_props": "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1",
    "date_parse_classes": f"""WITH e AS (SELECT event_id, event_id % 6 AS k, epoch_us(ts) // 1000 AS ms FROM events)
        SELECT event_id, CAST(CASE WHEN k = 5 THEN {START + 60 * DAY} WHEN k = 2 THEN ms WHEN k = 4 THEN ms // {DAY} * {DAY} ELSE ms // 1000 * 1000 END AS BIGINT) AS ms, k = 5 AS estimated FROM e""",
    "age_labels": f"""WITH {ARTICLES}, m AS (SELECT item_id, published_at, greatest(({START + 800 * HOUR} - published_at) // 60000, 0) AS m FROM a)
        SELECT item_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 43200 THEN (m // 1440) || 'd ago' ELSE strftime(make_timestamp(published_at * 1000), '%Y-%m-%d') END AS label FROM m""",
    "robots_allowed": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
        b AS (SELECT page_id, greatest(CASE WHEN starts_with(path, '/en/1') THEN 6 ELSE -1 END, CASE WHEN starts_with(path, '/fr/') THEN 4 ELSE -1 END) AS allow,
            greatest(CASE WHEN starts_with(path, '/en/') THEN 4 ELSE -1 END, CASE WHEN starts_with(path, '/') AND ends_with(path, '.html') THEN 8 ELSE -1 END, CASE WHEN starts_with(path, '/fr/') THEN 4 ELSE -1 END) AS deny FROM p)
        SELECT page_id, deny < 0 OR allow >= deny AS allowed FROM b""",
    "newest_n_per_source": f"""WITH {ARTICLES}, r AS (SELECT source_id, item_id, row_number() OVER (PARTITION BY source_id ORDER BY date_estimated, published_at DESC, item_id) AS rank FROM a) SELECT * FROM r WHERE rank <= 5""",
    "ration_held": f"WITH {ARTICLES} SELECT source_id, least(count(*), 5) AS taken, greatest(count(*) - 5, 0) AS held FROM a GROUP BY source_id",
    "known_hash_store": f"WITH {URLS} SELECT page_id, canonical_hash FROM uh WHERE page_id % 3 = 2 AND canonical_hash NOT IN (SELECT canonical_hash FROM uh WHERE page_id % 3 <> 2)",
    "known_hash_anti": f"WITH {URLS} SELECT page_id, canonical_hash FROM uh WHERE page_id % 3 = 2 AND canonical_hash NOT IN (SELECT canonical_hash FROM uh WHERE page_id % 3 <> 2)",
    "unseen_per_source": f"WITH {URLS} SELECT page_id, source_id FROM uh x WHERE NOT EXISTS (SELECT 1 FROM uh y WHERE y.page_id % 2 = 0 AND y.source_id = x.source_id AND y.canonical_hash = x.canonical_hash)",
    "near_duplicate_band_join": f"""WITH {TITLED} SELECT pos FROM t x WHERE pos % 2 = 1 AND NOT EXISTS (SELECT 1 FROM t y WHERE y.pos % 2 = 0 AND y.title_key <> '' AND y.institution = x.institution AND y.title_key = x.title_key
        AND abs(y.published_at - x.published_at) <= {7 * DAY})""",
    "near_duplicate_greedy": f"""WITH {TITLED}, g AS (SELECT institution, title_key, {FOLD} AS k FROM t WHERE title_key <> '' GROUP BY 1, 2), kept AS (SELECT unnest(k).pos AS pos FROM g)
        SELECT pos, title_key = '' OR pos IN (SELECT pos FROM kept) AS kept FROM t""",
    "undated_ration": """WITH r AS (SELECT event_id, user_id AS source_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events)
        SELECT event_id, source_id FROM r WHERE b < 3""",
    "sitemap_include_exclude": r"SELECT page_id FROM pages WHERE regexp_matches(url, '/EN/\d|\.example\.net/', 'i') AND NOT regexp_matches(url, 'spam|\?page=', 'i')",
    "sitemap_newest": f"""WITH {URLS}, r AS (SELECT page_id AS source_pos, canonical_hash, row_number() OVER (ORDER BY (page_id * 37) % 101 DESC, page_id) AS rank FROM uh WHERE regexp_matches(url, '/en/', 'i'))
        SELECT source_pos, rank FROM r x WHERE rank <= 5000 AND NOT EXISTS (SELECT 1 FROM r y WHERE y.canonical_hash = x.canonical_hash AND y.rank < x.rank)""",
    "insert_decisions": f"""WITH {TITLED}, x AS (SELECT pos, institution, title_key, published_at AS ms, sha256(concat_ws('|', institution, title_key, CAST(pos % 2 AS VARCHAR))) AS h, CASE pos % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS o FROM t),
        g AS (SELECT institution, title_key, list_sort(list({{'o': o, 'pos': pos, 'ms': ms, 'h': h, 'named': title_key <> ''}})) AS l FROM x GROUP BY ALL),
        f AS (SELECT list_reduce(l, lambda acc, r: list_append(acc, {{'pos': r.pos, 'ms': r.ms, 'h': r.h, 'd': CASE WHEN r.o = 0 THEN 'stored' WHEN r.o = 1 THEN 'pruned'
            WHEN len(list_filter(acc, lambda y: y.h = r.h AND y.d IN ('stored', 'pruned', 'inserted'))) > 0 THEN 'duplicate_url'
            WHEN r.named AND len(list_filter(acc, lambda y: y.d IN ('stored', 'inserted') AND abs(y.ms - r.ms) <= {7 * DAY})) > 0 THEN 'duplicate_title' ELSE 'inserted' END}}),
            CAST([] AS STRUCT(pos BIGINT, ms BIGINT, h VARCHAR, d VARCHAR)[])) AS l FROM g),
        u AS (SELECT unnest(l) AS r FROM f) SELECT r.pos AS pos, r.d AS decision FROM u WHERE r.d NOT IN ('stored', 'pruned')""",
    "tag_rules": f"WITH {ARTICLES} SELECT item_id, array_to_string(list_sort(themes), ',') AS tags FROM a",
    "tag_native_map": f"WITH {ARTICLES} SELECT item_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN 'region:' || lang ELSE '' END AS tags FROM a",
    "tag_union_sorted": f"WITH {ARTICLES} SELECT item_id, array_to_string(list_sort(list_concat(['scope:macro'], CASE WHEN lang IN ('en', 'fr', 'de') THEN ['region:' || lang] ELSE [] END, themes)), ',') AS tags FROM a",
    "retag_by_source": f"""WITH {ARTICLES} SELECT item_id, array_to_string(list_sort(list_concat(CASE WHEN lang <> 'es' THEN ['scope:micro'] ELSE [] END, CASE WHEN lang IN ('en', 'fr', 'de') THEN ['region:' || lang] ELSE [] END, themes)), ',') AS tags FROM a""",
    "unmapped_top25": "SELECT c AS category, count(*) AS n FROM (SELECT unnest([lang, source]) AS c FROM documents) WHERE lower(trim(c)) NOT IN ('en', 'fr', 'de') GROUP BY c ORDER BY n DESC, c LIMIT 25",
    "untagged_items": "SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "due_sources": f"""WITH {LOG} SELECT id, last_fetch_at, consecutive_failures FROM reg WHERE enabled AND in_config AND last_fetch_at + 1800000 * CAST(pow(2, least(consecutive_failures, 4)) AS BIGINT) <= {START + 30 * DAY}""",
    "fetch_schedule": f"""WITH {LOG}, d AS (SELECT id, last_fetch_at, 'host' || (id % 37) AS host, greatest(id % 4, 1) * 1000 AS takes FROM reg WHERE enabled AND in_config),
        h AS (SELECT host, sum(takes) AS total, count(*) AS k FROM d GROUP BY host), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, host) AS rank FROM h),
        n AS (SELECT *, (rank - 1) % 4 AS lane, coalesce(sum(total) OVER w, 0) AS since, coalesce(sum(k) OVER w, 0) AS done FROM r WINDOW w AS (PARTITION BY (rank - 1) % 4 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT id, host, lane, CAST(done + row_number() OVER (PARTITION BY host ORDER BY coalesce(last_fetch_at, 0), id) AS BIGINT) AS place,
               CAST(since + coalesce(sum(takes) OVER (PARTITION BY host ORDER BY coalesce(last_fetch_at, 0), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM d JOIN n USING (host)""",
    "health_rows": f"WITH {LOG} SELECT id, institution, name, last_status, last_status IN ('error', 'empty') AS broken FROM reg WHERE enabled AND in_config",
    "broken_count": f"WITH {LOG} SELECT count(*) FILTER (WHERE last_status IN ('error', 'empty')) AS broken FROM reg WHERE enabled AND in_config",
    "failure_streak": f"WITH {LOG} SELECT source_id, consecutive_failures, fetches FROM s",
    "prune_preview": f"""WITH {ARTICLES}, {CUT} SELECT count(*) FILTER (WHERE {OLD}) AS total, count(*) FILTER (WHERE {OLD} AND NOT date_estimated) AS stated, count(*) FILTER (WHERE {OLD} AND date_estimated) AS estimated,
        count(*) FILTER (WHERE NOT ({OLD})) AS keeping FROM a""",
    "prune_by_institution": f"WITH {ARTICLES}, {CUT} SELECT institution, count(*) AS n FROM a WHERE {OLD} GROUP BY institution",
    "prune_kept": f"WITH {ARTICLES}, {CUT} SELECT item_id FROM a WHERE NOT ({OLD})",
    "prune_tombstones": f"WITH {ARTICLES}, {CUT} SELECT DISTINCT sha256(title) AS canonical_hash, CAST(1 AS BIGINT) AS pruned_at FROM a WHERE {OLD}",
    "orphan_tags": f"WITH {ARTICLES} SELECT item_id, unnest(list_distinct(tags)) AS tag FROM a WHERE item_id % 4 = 0",
    "source_upsert": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS institution, CASE WHEN c_custkey % 3 <> 1 THEN c_name || '!' ELSE c_name END AS name, c_custkey % 3 <> 1 AS in_config,
        CASE WHEN c_custkey % 3 <> 0 THEN 'ok' END AS last_status, CAST(CASE WHEN c_custkey % 3 <> 0 THEN 2 ELSE 0 END AS INT) AS consecutive_failures FROM customer""",
    "record_score": r"""WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, trim(text) AS t FROM conversations WHERE true),
        k AS (SELECT conv_id, n, turn, (regexp_matches(t, '^(https?://|/[^/\s])') AND NOT contains(t, ' ')) AS u, t FROM c WHERE turn < 20),
        s AS (SELECT conv_id, max(n) AS n, count(DISTINCT turn) AS urls, count(DISTINCT CASE WHEN length(t) BETWEEN 12 AND 300 AND regexp_matches(t, '\s') AND NOT u AND NOT regexp_matches(t, '^[{\[<]') THEN turn END) AS titles FROM k GROUP BY conv_id)
        SELECT CAST(conv_id AS VARCHAR) AS call, round(CASE WHEN titles = 0 THEN 0.0 ELSE 3.0 * urls / least(n, 20) + 3.0 * titles / least(n, 20) + least(n / 20.0, 1.0) END, 6) AS score FROM s""",
}


def oracle_sql() -> dict[str, str]:
    from tidemark import landed_oracles

    return SQL | landed_oracles.SQL
