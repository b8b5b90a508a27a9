"""The queries opN_<name> and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, audio, exact_dedup, filter_audit, hmm_lm, language_id, mixing, near_dedup, packing, sharding, simhash, token_counts, url_filter
from .common import bucket_of, save, table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 5) == 0)
    model = language_id.fit(docs.filter("not held_out").select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def op3_token_counts(spark, sf_dir):
    """Every document counted and kept with its tree; then edited twice, words put in at one place, others taken out at another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    state = save(token_counts.count(docs), "token-trees")
    n = (F.col("n_chars") + 1).cast("long")
    i = F.coalesce(F.col("doc_id").try_cast("long"), F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))

    def change(times, taken, put):
        start = F.pmod(F.pmod(i, n) * times, n)
        return F.struct(start.cast("int").alias("start"), (start + taken).cast("int").alias("stop"), F.lit(put).alias("put"))

    edits = F.array(change(7919, 0, " put in 'll 42 "), change(104729, 40, ""))
    before = {"was_chars": F.col("n_chars"), "was_tokens": F.col("n_tokens"), "n_leaves": F.size("leaf_chars").cast("long")}
    edited = token_counts.update(state.withColumns({**before, "edits": edits}), keep=[*before])
    return edited.select("doc_id", F.col("was_chars").alias("n_chars"), F.col("was_tokens").alias("n_tokens"), "n_leaves", F.col("n_chars").alias("edited_chars"), F.col("n_tokens").alias("edited_tokens"), "encoded_chars")


def op4_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket_of("doc_id", 10) == 0)
    return hmm_lm.score(docs, "held_out")


def op8_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_audio_fingerprints(spark, sf_dir):
    """The tables hold no sound, so each vector of embeddings is played as a melody."""
    return audio.align(audio.tunes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id")


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op11_simhash(spark, sf_dir):
    return simhash.near_simhash(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    rows = filter_audit.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(rows, list("ABCDE"), ["good", "toxic"])


def op13_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "op4_url_filter": r"""
        WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        cut AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1) AS t FROM rest),
        p AS (SELECT row_number() OVER () AS n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(t, '^[^?#]*') AS path FROM cut),
        hit AS (SELECT n, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
                FROM p, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (n)""",
    "op6_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM d),
        x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter
                   FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL),
        pairs AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * inter >= 75 * (na + nb - inter)),
        links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 8) AS BIGINT) AS u FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT source, source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
        r AS (SELECT source, source_size, w, cap, cap / w AS ratio, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
              FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
        g AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM r WHERE level <= ratio) * w) AS target FROM r),
        g2 AS (SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM g),
        x AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS more,
                     sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN g2 ON d.source IS NOT DISTINCT FROM g2.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(size * least(3, whole + CASE WHEN more > 0 AND upto - size / 2.0 <= more THEN 1 ELSE 0 END) AS BIGINT) AS taken,
               CAST(least(3, whole + CASE WHEN more > 0 AND upto - size / 2.0 <= more THEN 1 ELSE 0 END) AS BIGINT) AS repeats
        FROM x""",
    "op12_filter_audit": r"""
        WITH RECURSIVE l(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o(filter_order, mask) AS (SELECT f, bit FROM l UNION ALL SELECT filter_order || f, mask | bit FROM o, l WHERE mask & bit = 0),
        steps AS (SELECT filter_order, CAST(s AS INT) AS step, substr(filter_order, CAST(s AS INT), 1) AS f FROM o, range(1, 6) r(s) WHERE length(filter_order) = 5),
        cut AS (SELECT filter_order, step, f, bit, CAST(coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS before FROM steps JOIN l USING (f)),
        t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
        d AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS INT)
                     + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > low, false) AS INT) AS m,
                     doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM t),
        v AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, m),
        x AS (SELECT part, filter_order, step, f, sum(n) FILTER (m & (before | bit) = 0) AS kept, sum(n) FILTER (m & bit > 0 AND m & before = 0) AS removed, sum(n) FILTER (m & bit > 0 AND m & before > 0) AS redundant,
                     sum(n) FILTER (m = bit) AS unique_fails, sum(good) FILTER (m & bit > 0 AND m & before = 0) AS good_lost, sum(toxic) FILTER (m & bit > 0 AND m & before = 0) AS toxic_lost
              FROM v, cut GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, f AS filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
               CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM x""",
}


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return dict(SQL)
