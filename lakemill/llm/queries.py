"""The registered queries of the text operators, and their SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lakemill.llm import (
    bpe,
    decontaminate,
    fertility,
    line_dedup,
    ngram_join,
    passages,
    pii,
    resample,
    revisits,
    spelling,
    token_store,
    url_templates,
    weighted_samples,
)
from lakemill.session import load, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op10_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i,
               unnest(string_split(coalesce(text, ''), chr(10))) AS line
        FROM documents
    ), keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
    ), hot AS (
        SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k
        HAVING count(DISTINCT doc_id) >= 3
    ), flagged AS (
        SELECT doc_id, i, line, hot.k IS NOT NULL AND doc_id < last AS gone
        FROM keyed LEFT JOIN hot USING (k)
    )
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), ''))
               AS kept_sha256
    FROM flagged GROUP BY doc_id
    """,
)
def op10_line_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return line_dedup.line_digests(docs, line_dedup.keep_bitmaps(docs))


@query(
    "op3_ngram_jaccard_join",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ')
               || CASE WHEN len(w) < 5 THEN ' ' ELSE '' END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i
              FROM words WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * c >= 75 * (p.n + q.n - c)
    ), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
    ), reach AS (
        SELECT a AS doc_id, b AS other FROM both_ways
        UNION
        SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
    ), least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
    """,
)
def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_documents(load(spark, sf_dir, "documents"))


@query("op5_tokeniser_fertility")
def op5_tokeniser_fertility(spark, sf_dir):
    return fertility.measure_quality(load(spark, sf_dir, "documents"))


@query(
    "op7_benchmark_decontamination",
    r"""
    WITH doc_words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), item_words AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS run
        FROM (SELECT item_id, w, least(len(w), 10) AS size,
                     unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
              FROM item_words WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT size FROM windows
    ), places AS (
        SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS run
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM doc_words, sizes WHERE len(w) >= size)
    ), matches AS (
        SELECT doc_id, size, i, item_id FROM places JOIN windows USING (run, size)
    ), hit AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM matches) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           n_hit IS NOT NULL AS contaminated
    FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leak_report(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    )


@query("op9_bpe_backtracking")
def op9_bpe_backtracking(spark, sf_dir):
    return bpe.text_digests(load(spark, sf_dir, "documents"))


@query("op4_repair_token_files")
def op4_repair_token_files(spark, sf_dir):
    path = work_folder(spark, "token_files")
    token_store.write_tokens(load(spark, sf_dir, "documents"), path)
    return token_store.token_digests(spark, path)


URL_RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}


@query("op1_url_templates")
def op1_url_templates(spark, sf_dir):
    """A page's label is that of the document whose number ends its path: bad is quality 0."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    labels = load(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("bad")
    )
    number = F.regexp_extract(url_templates.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    numbered = pages.select("page_id", F.nullif(number, F.lit("")).cast("long").alias("doc_id"))
    marked = numbered.join(labels, "doc_id").select("page_id", "bad")
    return url_templates.judge_urls(pages, marked, URL_RULES)


@query("op2_information_pii")
def op2_information_pii(spark, sf_dir):
    return pii.private_report(load(spark, sf_dir, "documents"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures made from pages by their number: each page's response; a revisit of it an hour
    later under another form of the url; for every third page one with another entity tag; for
    every fourth a second response with another body and a revisit of that; for every fifth a
    revisit before the first response."""
    body = F.coalesce("html", F.lit(""))
    at = F.lit(1_700_000_000) + F.col("page_id") % 86_400
    headers = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"),
        F.lit("Content-Length"), F.length(body).cast("string"),
        F.lit("Date"), at.cast("string"),
        F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    fresh = F.create_map(
        F.lit("content-length"), F.lit("0"), F.lit("date"), (at + 3600).cast("string"),
        F.lit("X-Served"), F.lit("cache"),
    )

    def one(i, when, url, kind, delay, tag, digest, head):
        return F.when(
            when,
            F.struct(
                (F.col("page_id") * 8 + i).alias("record_id"),
                url.alias("url"),
                (at + delay).alias("ts"),
                F.lit(kind).alias("kind"),
                tag.alias("etag"),
                F.lit(None).cast("string").alias("last_modified"),
                digest.alias("digest"),
                head.alias("headers"),
            ),
        )

    tag, other = F.md5(body), F.md5(F.concat(body, F.lit("x")))
    none = F.lit(None).cast("string")
    url, page = F.col("url"), F.col("page_id")
    variant = F.concat(F.regexp_replace("url", "^https?:", "http:"), F.lit("#again"))
    every = F.array(
        one(0, page >= 0, url, "response", 0, tag, F.sha1(body), headers),
        one(1, page >= 0, variant, "revisit", 3600, F.concat(F.lit("W/"), tag), none, fresh),
        one(2, page % 3 == 0, url, "revisit", 5000, other, none, fresh),
        one(3, page % 4 == 0, url, "response", 7200, other, F.sha1(F.concat(body, F.lit("x"))), headers),
        one(4, page % 4 == 0, url, "revisit", 9000, none, F.sha1(F.concat(body, F.lit("x"))), fresh),
        one(5, page % 5 == 0, url, "revisit", -100, tag, none, fresh),
    )
    return pages.select(F.explode(every).alias("c")).where("c IS NOT NULL").select("c.*")


_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(bare, '^.*?://(?:[^/?@]*@)?([^/?]*)', 1, 's')), ':(80|443)$', ''), '^www\.', '')"


@query(
    "op8_warc_revisits",
    rf"""
    WITH p AS (
        SELECT page_id AS g, url, coalesce(html, '') AS body,
               1700000000 + page_id % 86400 AS t FROM pages
    ), captures AS (
        SELECT g * 8 AS record_id, url, t AS ts, 'response' AS kind, md5(body) AS etag,
               sha1(body) AS digest, body, t AS own FROM p
        UNION ALL SELECT g * 8 + 1, regexp_replace(url, '^https?:', 'http:') || '#again', t + 3600,
               'revisit', md5(body), NULL, body, t FROM p
        UNION ALL SELECT g * 8 + 2, url, t + 5000, 'revisit', md5(body || 'x'), NULL, body, t
               FROM p WHERE g % 3 = 0
        UNION ALL SELECT g * 8 + 3, url, t + 7200, 'response', md5(body || 'x'),
               sha1(body || 'x'), body, t FROM p WHERE g % 4 = 0
        UNION ALL SELECT g * 8 + 4, url, t + 9000, 'revisit', NULL, sha1(body || 'x'), body, t
               FROM p WHERE g % 4 = 0
        UNION ALL SELECT g * 8 + 5, url, t - 100, 'revisit', md5(body), NULL, body, t
               FROM p WHERE g % 5 = 0
    ), bared AS (
        SELECT *, regexp_replace(coalesce(url, ''), '#.*$', '', 's') AS bare FROM captures
    ), named AS (
        SELECT *, {_HOST} || regexp_replace(regexp_extract(bare, '^.*?://[^/?]*([^?]*)', 1, 's'), '/+$', '')
               || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical
        FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(
                     regexp_extract(bare, '^[^?]*\?(.*)$', 1, 's'), '&'), lambda x: x <> '' AND NOT
                     regexp_matches(lower(x), '{revisits.TRACKING}'))), '&') AS q FROM bared)
    ), best AS (
        SELECT canonical, ts, max(record_id) AS record_id FROM named
        WHERE kind = 'response' GROUP BY canonical, ts
    ), full_ones AS (
        SELECT n.canonical, n.ts, n.record_id, n.etag, n.digest, length(n.body) AS size, n.own
        FROM named n JOIN best USING (canonical, ts, record_id)
    ), joined AS (
        SELECT v.record_id, v.canonical, v.ts, v.etag, v.digest, v.own + 3600 AS fresh,
               r.record_id AS response_id, r.etag AS r_etag, r.digest AS r_digest, r.size
        FROM (SELECT * FROM named WHERE kind = 'revisit') v
        ASOF LEFT JOIN full_ones r ON v.canonical = r.canonical AND v.ts > r.ts
    ), judged AS (
        SELECT *, CASE WHEN response_id IS NULL THEN 'orphan'
               WHEN digest IS NOT NULL THEN CASE WHEN digest = r_digest THEN 'resolved' ELSE 'changed' END
               WHEN etag = r_etag THEN 'resolved' ELSE 'changed' END AS status FROM joined
    )
    SELECT record_id, canonical, ts, status, response_id,
           CASE WHEN status = 'resolved' THEN 'cache-control=max-age=60;content-length=' || size
                || ';content-type=text/html;date=' || fresh || ';x-served=cache'
           ELSE 'content-length=0;date=' || fresh || ';x-served=cache' END AS headers
    FROM judged
    """,
)
def op8_warc_revisits(spark, sf_dir):
    captures = page_captures(load(spark, sf_dir, "pages"))
    listed = F.transform("headers", lambda e: F.concat_ws("=", e["key"], e["value"]))
    return revisits.resolve_revisits(captures).withColumn("headers", F.array_join(listed, ";"))


@query("op6_collinear_passages")
def op6_collinear_passages(spark, sf_dir):
    return passages.shared_passages(load(spark, sf_dir, "documents"))


# The 16 steps of CRC-32 by half bytes; fixed values.
_CRC = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,"
    " 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896,"
    " 3183342108]"
)


def _crc32_sql(text: str) -> str:
    half = f"xor(xor(c, b) >> 4, {_CRC}[(xor(c, b) & 15) + 1])"
    return (
        f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'),"
        f" lambda h: ('0x' || h)::BIGINT), lambda c, b: xor({half} >> 4,"
        f" {_CRC}[({half} & 15) + 1]), 4294967295), 4294967295)"
    )


_LOWER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op11_spelling_variants",
    rf"""
    WITH RECURSIVE raw_runs AS (
        SELECT doc_id, run, count(*) AS k FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                   {_LOWER_SQL}) AS run FROM documents)
        WHERE length(run) >= 7 GROUP BY doc_id, run
    ), hashed AS (
        SELECT run, k, {_crc32_sql("doc_id || ':' || run")} AS h FROM raw_runs
    ), words AS (
        SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:]
                   ELSE run END AS word, k FROM hashed)
        WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
    ), cuts AS (
        SELECT word, n, i, word[:i] || word[i + 2:] AS cut
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
    ), near AS (
        SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y
               ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word
        UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.cut = y.word
        UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.cut = y.word
    ), best AS (
        SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS top
        FROM near GROUP BY word
    ), formed AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN other END AS form,
               CASE WHEN top >= 10 * n THEN top END AS form_n
        FROM words LEFT JOIN best USING (word)
    ), ways AS (
        SELECT word, word AS root, 0 AS steps FROM formed
        UNION ALL
        SELECT w.word, f.form, steps + 1 FROM ways w JOIN formed f ON f.word = w.root
        WHERE f.form IS NOT NULL
    ), ends AS (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
    """,
)
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(load(spark, sf_dir, "documents"))


@query("op12_weighted_fingerprints")
def op12_weighted_fingerprints(spark, sf_dir):
    return weighted_samples.edit_report(load(spark, sf_dir, "documents"))


@query(
    "op13_target_resampling",
    rf"""
    WITH words AS (
        SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER_SQL}),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        UNION ALL
        SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER_SQL}),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
    ), counted AS (
        SELECT side, doc_id, f, count(*) AS k FROM (
            SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
                   lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words)
        GROUP BY side, doc_id, f
    ), coded AS (
        SELECT f, {_crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted)
    ), held AS (
        SELECT bucket, coalesce(sum(k) FILTER (side = 0), 0) AS s,
               coalesce(sum(k) FILTER (side = 1), 0) AS t
        FROM counted JOIN coded USING (f) GROUP BY bucket
    ), gains AS (
        SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
               / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM held, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM held)
    ), weighed AS (
        SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_features,
               CAST(floor(sum(k * gain)::DOUBLE / sum(k)::DOUBLE) AS BIGINT) AS weight
        FROM counted JOIN coded USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
    ), scored AS (
        SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features,
               coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
               (('0x' || sha256('7:' || w.doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))
               AS BIGINT) AS score
        FROM words w LEFT JOIN weighed USING (doc_id) WHERE w.side = 0
    ), placed AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
               count(*) OVER () AS able FROM scored WHERE n_words >= 20
    )
    SELECT doc_id, n_features, weight, score,
           CASE WHEN place <= 25 * able // 100 THEN place END AS rank
    FROM scored LEFT JOIN placed USING (doc_id)
    """,
)
def op13_target_resampling(spark, sf_dir):
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
