"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat_format, exact_dedup, language_id, lexical_search, lm_score, media, mixing, near_dedup, secret_scan, spelling, token_count, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the installed package of public tokenizers keeps the vocabulary (the same place on every node)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sniff(media.store(table(spark, sf_dir, "documents"))).drop("carved")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.conversations(table(spark, sf_dir, "conversations"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_count": op1_token_count,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_media": op5_media,
    "op6_mix": op6_mix,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_chat_format": op9_chat_format,
    "op10_lm_score": op10_lm_score,
    "op11_spelling": op11_spelling,
    "op12_lexical_search": op12_lexical_search,
    "op13_secret_scan": op13_secret_scan,
}

#: The words before an assigned value, each ASCII letter in either case (RE2 would fold further letters).
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))

ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, count(*) AS group_size, max(points) AS most FROM n GROUP BY norm),
        k AS (SELECT n.norm, min(n.doc_id) AS keep_id FROM n JOIN g ON n.norm = g.norm AND n.points = g.most GROUP BY n.norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g USING (norm) JOIN k USING (norm)
    """,
    "op6_mix": """
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM d GROUP BY source),
        r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total,
              coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left
              FROM s WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min((total - cap_before) / weight_left, ratio) AS level FROM r WHERE ratio > (total - cap_before) / weight_left),
        t AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM r, l),
        b AS (SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS passes, round(target)::BIGINT % greatest(source_size, 1) AS rest FROM t),
        c AS (SELECT d.*, source_size, target, passes, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS same FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target, (size * passes + CASE WHEN upto <= rest THEN size WHEN upto - same < rest THEN floor(size * (rest - (upto - same))::DOUBLE / same) ELSE 0 END)::BIGINT AS taken FROM c
    """,
    "op10_lm_score": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        t AS (SELECT doc_id, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
        u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
        b AS (SELECT p, w, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY p, w HAVING count(*) >= 2),
        s AS (SELECT t.doc_id, CASE WHEN b.c IS NOT NULL THEN ln(b.c / up.c::DOUBLE) ELSE ln(u.c / (SELECT count(*) FROM t)::DOUBLE) + CASE WHEN t.p IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END END AS x, b.c IS NULL AND t.p IS NOT NULL AS backed
              FROM t JOIN u ON t.w = u.w LEFT JOIN u up ON t.p = up.w LEFT JOIN b ON b.p = t.p AND b.w = t.w)
        SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, count_if(s.backed)::BIGINT AS n_backoff, round(coalesce(sum(s.x), 0), 3) AS log_score, round(sum(s.x) / len(d.ws), 6) AS mean_log
        FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id, len(d.ws)
    """,
    "op9_chat_format": r"""
        WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        l AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM m),
        h AS (SELECT conv_id, turn, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level,
              trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '\s+', ' ', 'g')) AS norm FROM l),
        f AS (SELECT q.conv_id, q.turn, q.norm, q.level, q.n, (SELECT max(s.turn) FROM h s WHERE s.conv_id = q.conv_id AND s.level = q.level - 1 AND s.norm = q.norm AND s.turn < q.turn) AS source
              FROM (SELECT conv_id, turn, norm, level, count(*) AS n FROM h WHERE level > 0 AND norm <> '' GROUP BY ALL) q),
        v AS (SELECT conv_id, turn, source, sum(n) AS votes FROM f WHERE source IS NOT NULL GROUP BY ALL),
        k AS (SELECT conv_id, turn, arg_max(source, votes * 1000000 + source) AS link FROM v GROUP BY ALL),
        t AS (SELECT d.conv_id, d.turn, lag(d.turn) OVER (PARTITION BY d.conv_id ORDER BY d.turn) AS previous, k.link FROM (SELECT DISTINCT conv_id, turn FROM m) d LEFT JOIN k ON k.conv_id = d.conv_id AND k.turn = d.turn),
        o AS (SELECT *, CASE WHEN link IS NOT NULL AND link <> previous THEN turn END AS opens FROM t),
        b AS (SELECT conv_id, turn, coalesce(link, previous) AS reply_to, coalesce(max(opens) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS branch, opens IS NOT NULL AS first FROM o),
        e AS (SELECT x.conv_id, x.turn AS branch, x.reply_to AS spot, p.branch AS under FROM b x JOIN b p ON p.conv_id = x.conv_id AND p.turn = x.reply_to WHERE x.first),
        r AS (SELECT conv_id, branch, lpad(spot::VARCHAR, 19, '0') AS prefix, 1 AS depth FROM e WHERE under = -1
              UNION ALL SELECT e.conv_id, e.branch, r.prefix || '.' || lpad(e.spot::VARCHAR, 19, '0'), r.depth + 1 FROM e JOIN r ON r.conv_id = e.conv_id AND r.branch = e.under),
        c AS (SELECT m.conv_id, m.turn, m.role, b.reply_to, coalesce(r.depth, 0) AS depth, concat_ws('.', r.prefix, lpad(m.turn::VARCHAR, 19, '0')) AS reply_path,
              trim(array_to_string(list_filter(regexp_split_to_array(m.text, '\r?\n'), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), ' ') AS text
              FROM m JOIN b ON b.conv_id = m.conv_id AND b.turn = m.turn LEFT JOIN r ON r.conv_id = b.conv_id AND r.branch = b.branch)
        SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' AS formatted FROM c
    """,
    "op11_spelling": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') AS ws FROM documents),
        r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS run FROM d) WHERE length(run) >= 7 GROUP BY ALL),
        h AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
        b AS (SELECT run, n, list_transform(range(8 * (length(x) // 2)), lambda i: (('0x' || substr(x, 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)::BIGINT) & 1) AS bits FROM h),
        c AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bits), lambda v, bit: xor(v >> 1, 3988292384 * (xor(v, bit) & 1)))) AS crc FROM b),
        w AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM c),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        k AS (SELECT word, n, word AS whole, i, substr(word, 1, i - 1) || '$' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        p AS (SELECT a.word, b.word AS near, b.n FROM k a JOIN k b ON a.hole = b.hole AND a.word <> b.word
              UNION SELECT k.word, v.word, v.n FROM k JOIN v ON k.short = v.word
              UNION SELECT v.word, k.word, k.n FROM k JOIN v ON k.short = v.word),
        o AS (SELECT word, near, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p),
        f AS (SELECT v.word, v.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN o.n >= 10 * v.n THEN o.near END AS form, CASE WHEN o.n >= 10 * v.n THEN o.n END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND o.place = 1),
        t AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM f JOIN t ON f.form = t.word)
        SELECT f.word, f.n, f.n_near, f.form, f.form_n, t.root FROM f JOIN t ON f.word = t.word
    """,
    "op12_lexical_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
        m AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM n, g),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), g),
        s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM f JOIN i USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
    """,
    "op13_secret_scan": r"""
        WITH k AS (SELECT * FROM (VALUES (0, 'assign', '({EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6), (1, 'access', '(AKIA[A-Z0-9]+)()', 20), (2, 'hex', '([0-9a-f]{24,})()', 24), (3, 'live', '([A-Za-z0-9+/_-]{16,})()', 16)) x(kind, name, pattern, least)),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
        m AS (SELECT r, kind, unnest(list_slice(regexp_split_to_array(t, pattern), 1, -2)) AS gap, unnest(regexp_extract_all(t, pattern, 0)) AS hit, unnest(regexp_extract_all(t, pattern, CASE kind WHEN 0 THEN 2 ELSE 0 END)) AS value,
              generate_subscripts(regexp_extract_all(t, pattern, 0), 1) AS no FROM d, k WHERE regexp_matches(t, pattern)),
        p AS (SELECT r, kind, value, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY no)::BIGINT AS e, length(hit) AS size FROM m),
        q AS (SELECT r, kind, value, e - size AS s, e, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AS random FROM p JOIN k USING (kind) WHERE length(value) >= least),
        c AS (SELECT q.*, owner, doc_id FROM q JOIN d USING (r) WHERE kind < 3 OR random AND NOT EXISTS (SELECT 1 FROM q b WHERE b.r = q.r AND b.kind < 3 AND b.s < q.e AND b.e > q.s)),
        o AS (SELECT value, count(DISTINCT owner) <= 2 AND count(DISTINCT (owner, coalesce(doc_id::VARCHAR, ''))) <= 10 AS few FROM c GROUP BY value),
        z AS (SELECT c.*, few, name || ':' || s || ':' || e AS span FROM c JOIN o USING (value) JOIN k USING (kind) WHERE kind < 3 OR few),
        a AS (SELECT r, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans, count_if(random AND few) AS n_live, count_if(NOT few) AS n_copied FROM z GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied FROM d LEFT JOIN a USING (r)
    """.replace("{EITHER}", _EITHER),
}
