"""Queries of the text, vector and JSON functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import text as t
from terrace.functions import vectors as v
from terrace.plans.catalogue import AS_OF, as_of, sql_strip
from terrace.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_DENSE = r"[\p{Han}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
_SIZE = "octet_length(encode({0}))"


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sql_prefix(x: str, limit: int) -> str:
    """SQL for the longest prefix of at most ``limit`` bytes: characters are counted off one by one."""
    return f"array_to_string(list_transform(list_filter(range(1, least(len({x}), {limit}) + 1), lambda k: octet_length(encode(left({x}, k))) <= {limit}), lambda k: substring({x}, k, 1)), '')"


@query(f"SELECT doc_id, (h + ceil((len(text) - h) / 4.0))::INT AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '{_DENSE}')) AS h FROM documents WHERE text IS NOT NULL)")
def estimate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", t.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, (w + (octet_length(encode(text)) - w) // 4)::INT AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[^\\x{00}-\\x{7F}]')) AS w FROM documents WHERE text IS NOT NULL)")
def estimate_llm_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", t.estimate_llm_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT id, CASE WHEN p = '' THEN 'body' ELSE p END AS part FROM (SELECT id, {sql_prefix('s', 120)} AS p FROM (SELECT id, translate({sql_strip('title')}, '/\\', '--') AS s FROM documents WHERE title IS NOT NULL))")
def sanitize_path_part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("title IS NOT NULL").select("id", t.sanitize_path_part(F.col("title")).alias("part"))


@query(f"SELECT id, {sql_prefix('s', 20)} AS part FROM (SELECT id, translate({sql_strip('title')}, '/\\', '--') AS s FROM documents WHERE title IS NOT NULL)")
def sanitize_path(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("title IS NOT NULL").select("id", t.sanitize_path(F.col("title"), 20).alias("part"))


@query(
    f"""
WITH b AS (SELECT id, CASE WHEN starts_with(path, document_id || '/') THEN substr(path, len(document_id) + 2) ELSE path END AS p FROM chapters WHERE path IS NOT NULL AND document_id IS NOT NULL),
s AS (SELECT id, {sql_strip(f"replace({sql_strip('p')}, '/', ' · ')")} AS shown FROM b)
SELECT id, CASE WHEN shown = '' THEN 'Document' ELSE shown END AS shown FROM s"""
)
def chapter_display_title(spark: SparkSession, folder: str) -> DataFrame:
    chapters = table(spark, folder, "chapters").filter("path IS NOT NULL AND document_id IS NOT NULL")
    return chapters.select("id", t.chapter_display_title(F.col("path"), F.col("document_id")).alias("shown"))


@query("SELECT id, CASE WHEN s IS NULL OR s = document_id THEN title ELSE s END AS shown FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '')[-1] AS s FROM chapters)")
def project_query_item(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chapters").select("id", t.path_title(F.col("path"), F.col("title"), F.col("document_id")).alias("shown"))


_LISTED = f"list_filter(list_transform(list_filter(coalesce(tags, []), lambda x: x IS NOT NULL), lambda x: {sql_strip('x')}), lambda x: x <> '')"


@query(
    f"""
WITH m AS (SELECT id, {_LISTED} AS l FROM documents), u AS (SELECT id, unnest(l) AS tag, unnest(range(1, len(l) + 1)) AS k FROM m),
f AS (SELECT id, tag, k FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(tag) ORDER BY k) AS n FROM u) WHERE n = 1)
SELECT id, string_agg(tag, '|' ORDER BY k) AS tags FROM f GROUP BY id"""
)
def tag_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = table(spark, folder, "documents").select("id", t.merge_tags(F.col("tags")).alias("tags"))
    return merged.filter("size(tags) > 0").select("id", F.array_join("tags", "|").alias("tags"))


@query(f"SELECT id, len(l)::INT AS n, coalesce(l[1], '') AS first_part FROM (SELECT id, list_filter(list_transform(string_split(title, ','), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM documents WHERE title IS NOT NULL)")
def parse_csv_list(spark: SparkSession, folder: str) -> DataFrame:
    parts = t.parse_csv_list(F.col("title"))
    return table(spark, folder, "documents").filter("title IS NOT NULL").select("id", F.size(parts).alias("n"), F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("first_part"))


@query("SELECT id, array_to_string(list_filter(tags, lambda x: x IS NOT NULL AND trim(x) <> ''), '|') AS tags FROM documents WHERE tags IS NOT NULL")
def array_literal_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Tags written as literals and read again are the same tags."""
    kept = F.filter("tags", lambda x: x.isNotNull() & (F.trim(x) != ""))
    return table(spark, folder, "documents").filter("tags IS NOT NULL").select("id", F.array_join(t.parse_array(t.format_array(kept)), "|").alias("tags"))


@query("SELECT id, len(content) AS characters, md5(regexp_replace(content, '\\r\\n?', chr(10), 'g')) AS md5 FROM documents WHERE content IS NOT NULL")
def normalize_eol(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("content IS NOT NULL").select("id", F.char_length("content").cast("bigint").alias("characters"), F.md5(F.encode(t.normalize_eol(F.col("content")), "UTF-8")).alias("md5"))


@query(f"SELECT id, CASE WHEN octet_length(encode(title)) <= 24 THEN title ELSE {sql_prefix('title', 24)} || '…' END AS short FROM documents WHERE title IS NOT NULL")
def utf8_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("title IS NOT NULL").select("id", t.utf8_prefix(F.col("title"), 24).alias("short"))


@query(f"SELECT id, CASE WHEN octet_length(encode(summary)) <= 60 THEN summary ELSE {sql_prefix('summary', 60)} || '...' END AS short FROM documents WHERE summary IS NOT NULL")
def truncate_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("summary IS NOT NULL").select("id", t.truncate_text(F.col("summary"), 60).alias("short"))


@query(f"SELECT id, {sql_strip("coalesce(content, '') || '<reasoning>kept</reasoning> '")} AS answer FROM documents")
def strip_thinking(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries put between tags of thinking around the contents are gone again; other tags stay."""
    summary = F.coalesce("summary", F.lit(""))
    told = F.concat(F.lit("< think >"), summary, F.lit("</THINK><thinking>a\nb</thinking>"), F.coalesce("content", F.lit("")), F.lit("<reasoning>kept</reasoning> <REDACTED_reasoning>\nmore\n</redacted_reasoning\n><redacted_thinking>"), summary, F.lit("</redacted_thinking>"))
    return table(spark, folder, "documents").select("id", t.strip_thinking(told).alias("answer"))


@query(f"SELECT id, {sql_strip('coalesce(title, chr(32))')} AS answer, {sql_strip('coalesce(summary, chr(32))')} AS knowledge FROM documents")
def split_dual_answer(spark: SparkSession, folder: str) -> DataFrame:
    both = F.concat(F.coalesce("title", F.lit("")), F.lit("\n---PART:KNOWLEDGE---\n"), F.coalesce("summary", F.lit("")))
    return table(spark, folder, "documents").select("id", t.split_answer(both).alias("a")).select("id", "a.answer", "a.knowledge")


@query("SELECT id, CASE WHEN coalesce(n_chars, 0) <= 0 THEN -1 ELSE CASE id[1] WHEN '0' THEN n_chars WHEN '1' THEN n_chars * 1024 WHEN '2' THEN n_chars * 1048576 WHEN '3' THEN n_chars * 1024 + 512 WHEN '4' THEN n_chars * 1073741824 WHEN '5' THEN n_chars * 1073741824 ELSE -1 END END AS bytes FROM documents")
def parse_human_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths written with units, then read; other units, no number and zero give the default of -1."""
    unit = F.expr("CASE substring(id, 1, 1) WHEN '0' THEN ' ' WHEN '1' THEN ' KiB' WHEN '2' THEN 'mb' WHEN '3' THEN '.5 kb ' WHEN '4' THEN 'G B' WHEN '5' THEN ' gib' WHEN '6' THEN ' G' WHEN '7' THEN 'TB' WHEN '8' THEN 'B' ELSE ' bytes' END")
    return table(spark, folder, "documents").select("id", t.parse_bytes(F.concat(F.lit(" "), F.coalesce("n_chars", F.lit(0)).cast("string"), unit), -1).alias("bytes"))


@query("SELECT id, least(CASE WHEN query_count >= 1 THEN query_count ELSE 15 END, 100)::INT AS asked FROM documents")
def limit_parse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("id", t.limit_or(F.concat(F.lit(" "), F.col("query_count").cast("string")), 15, 100).alias("asked"))


@query("SELECT id, least(greatest(greatest(query_count, 1) * 2, 20), 200)::INT AS recall FROM documents")
def branch_recall(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("id", t.branch_recall(F.col("query_count")).alias("recall"))


@query("SELECT t.id, x.tag, 0.5 + 0.5 * (x.k % 2) AS relevance FROM topics t, LATERAL (SELECT unnest(tag_names) AS tag, unnest(range(0, len(tag_names))) AS k) x WHERE x.tag IS NOT NULL")
def json_extract_array(spark: SparkSession, folder: str) -> DataFrame:
    """Tags with relevances written as JSON inside prose, then read."""
    entry = F.transform("tag_names", lambda x, k: F.struct(x.alias("tag"), (0.5 + 0.5 * (k % 2)).alias("relevance")))
    told = F.concat(F.lit("Sure, here they are: "), F.to_json(entry), F.lit(" (end)"))
    read = t.json_relevances(told, "tag")
    return table(spark, folder, "topics").select("id", F.explode(read).alias("r")).select("id", "r.tag", "r.relevance").filter("tag IS NOT NULL")


_LEAF = """
CASE WHEN contains(trim(v), 'BEGIN') AND contains(trim(v), 'PRIVATE') THEN '[redacted]:pem-private-block'
     WHEN regexp_full_match(trim(v), '[A-Za-z0-9_=-]{10,}\\.[A-Za-z0-9_=-]{10,}\\.[A-Za-z0-9_=-]{10,}') AND len(trim(v)) >= 40
          AND len(list_filter(string_split(trim(v), '.'), lambda p: len(regexp_replace(p, '[-_=]', '', 'g')) < len(p) // 2 OR regexp_full_match(p, '[0-9]+'))) = 0 THEN '[redacted]:jwt'
     WHEN regexp_matches(lower(trim(v)), '^(sk-|sk_live|sk_test|sk_proj|pk_live|pk_test|rk_live|rk_test|ts_u_|tsk_live|tsk_admin)') AND octet_length(encode(trim(v))) >= 12 THEN '[redacted]:credential-prefix'
     WHEN regexp_full_match(trim(v), '(AKIA|ASIA)[A-Z0-9]{16}') THEN '[redacted]:aws-access-key-id'
     WHEN regexp_matches(trim(v), '(?i)([a-z][a-z0-9+.-]*://)([^/?#:]+):([^@/?#]*)@') THEN regexp_replace(trim(v), '(?i)([a-z][a-z0-9+.-]*://)([^/?#:]+):([^@/?#]*)@', '\\1*:*@', 'g')
     ELSE v END"""
_LEAVES = """CASE id[1] WHEN '0' THEN 'sk-' || id WHEN '1' THEN ' Sk_Live' || left(id, 3) WHEN '2' THEN replace(id, '-', '') || '.' || left(id, 13) || '.' || id WHEN '3' THEN '12345678901.' || left(id, 13) || '.' || id
     WHEN '4' THEN 'AKIA' || upper(replace(left(id, 18), '-', '')) WHEN '5' THEN 'ASIA' || upper(left(replace(id, '-', ''), 15)) WHEN '6' THEN 'see HTTPS://' || left(id, 8) || ':' || left(id, 4) || '@host/x and db://a@b' WHEN '7' THEN '-----BEGIN RSA PRIVATE KEY-----' || id
     WHEN '8' THEN 'my sk-' || id ELSE coalesce(summary, '') END"""


@query(f"SELECT id, {_LEAF} AS clean FROM (SELECT id, {_LEAVES} AS v FROM documents)")
def redact_value(spark: SparkSession, folder: str) -> DataFrame:
    """Values of each kind made from ids, the others summaries, masked."""
    made = F.expr(_LEAVES.replace("id[1]", "substring(id, 1, 1)"))
    return table(spark, folder, "documents").select("id", t.redact(made).alias("clean"))


@query(
    """
SELECT id, CASE WHEN trim(coalesce(span_id, '')) = '' THEN '[redacted]' ELSE '[redacted] (scalar was ' || octet_length(encode(span_id)) || ' chars)' END AS token,
       CASE WHEN trim(coalesce(status_message, '')) = '' THEN '[redacted]' ELSE '[redacted] (scalar was ' || octet_length(encode(status_message)) || ' chars)' END AS license, name AS shown, kind AS tokens FROM otel_spans"""
)
def redact_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Spans as maps of settings under names that are masked and names that aren't."""
    names = {" Trace_Token": "span_id", "license_key": "status_message", "name": "name", "max_tokens": "kind"}
    made = t.redact_map(F.create_map(*[x for name, c in names.items() for x in (F.lit(name), F.col(c))]))
    at = lambda name: F.try_element_at(made, F.lit(name))
    return table(spark, folder, "otel_spans").select("id", at(" Trace_Token").alias("token"), at("license_key").alias("license"), at("name").alias("shown"), at("max_tokens").alias("tokens"))


@query("SELECT event_id, sha256(lower('Agent/' || event_type) || '|' || (user_id % 250) || '.10.20' || '|UTC|' || props) AS fingerprint FROM events")
def fingerprint_hash(spark: SparkSession, folder: str) -> DataFrame:
    ip = F.concat((F.col("user_id") % 250).cast("string"), F.lit(".10.20."), (F.col("event_id") % 250).cast("string"))
    agent = F.concat(F.lit(" Agent/"), "event_type")
    return table(spark, folder, "events").select("event_id", t.fingerprint(agent, ip, F.lit("UTC"), F.col("props")).alias("fingerprint"))


@query(f"SELECT id, CASE WHEN coalesce(query_count, 0) = 0 THEN 0 ELSE floor(query_count / (1 + ln(1 + greatest(0, coalesce((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(last_query_at)) / 3.6e9::DOUBLE, 168)))) * 100 + 0.5) / 100 END AS score FROM documents")
def hot_score(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("id", t.hot_score(F.col("query_count"), F.col("last_query_at"), as_of()).alias("score"))


@query("SELECT id, CASE WHEN json_valid(attributes_json) THEN coalesce(json_extract_string(attributes_json, '$.\"service.name\"'), json_extract_string(attributes_json, '$.\"rows\"')) END AS service FROM otel_spans")
def span_attr(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "otel_spans").select("id", t.span_attribute(F.col("attributes_json"), "service.name", "rows").alias("service"))


@query("SELECT id, coalesce(CASE WHEN end_time_unix_nano >= start_time_unix_nano THEN (end_time_unix_nano - start_time_unix_nano) / 1e6::DOUBLE END, -1) AS ms FROM otel_spans")
def span_duration_ms(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "otel_spans")
    return spans.select("id", F.coalesce(t.span_duration_ms(F.col("start_time_unix_nano"), F.col("end_time_unix_nano")), F.lit(-1.0)).alias("ms"))


@query("SELECT doc_id, len(w)::INT AS terms, array_to_string(w, ' ') AS joined FROM (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(title, '')), '([\\x{4E00}-\\x{9FFF}])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS w FROM documents)")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    words = t.terms(F.col("title"))
    return table(spark, folder, "documents").select("doc_id", F.size(words).alias("terms"), F.array_join(words, " ").alias("joined"))


_BYTES = """
WITH h AS (SELECT id, hex(encode(coalesce(title, ''))) AS x FROM documents),
b AS (SELECT id, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::INT) AS b FROM h),
s AS (SELECT id, unnest(list_transform(range(1, greatest(least(len(b) - 3, 10000), 0) + 1), lambda i: (((b[i] * 31 + b[i + 1]) * 31 + b[i + 2]) * 31 + b[i + 3]) % 384)) AS bucket FROM b),
c AS (SELECT id, bucket, count(*) AS n FROM s GROUP BY ALL)
"""


@query(_BYTES + "SELECT id, bucket::INT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 5) AS weight FROM c")
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed embeddings of titles, as their values that aren't 0."""
    each = table(spark, folder, "documents").select("id", F.posexplode(v.hash_embedding(F.coalesce("title", F.lit("")))).alias("bucket", "weight"))
    return each.filter("weight <> 0").select("id", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))


_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(
    f"""
WITH c AS (SELECT max(embedding) AS e FROM (SELECT embedding FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE {_USABLE})))
SELECT doc_id, CASE WHEN coalesce(len(embedding), 0) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM c)::DOUBLE[]), 5) ELSE 0 END AS cosine
FROM documents WHERE embedding IS NULL OR len(embedding) <> 384 OR {_USABLE}"""
)
def cosine_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each document's embedding to that of the first usable one."""
    usable = (F.size("embedding") == 384) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    documents = table(spark, folder, "documents").select("doc_id", "embedding")
    first = documents.filter(usable).agg(F.min_by("embedding", "doc_id").alias("e"))
    kept = documents.filter(F.col("embedding").isNull() | (F.size("embedding") != 384) | usable).join(F.broadcast(first))  # one row
    return kept.select("doc_id", F.round(F.coalesce(v.cosine(F.col("embedding"), F.col("e")), F.lit(0.0)), 5).alias("cosine"))


@query("SELECT label, round(sqrt(sum(m * m)), 9) AS length, len(list(m)) AS width FROM (SELECT label, k, avg(x) / max(norm) AS m FROM (SELECT label, k, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings) GROUP BY ALL) JOIN (SELECT label AS l2, sqrt(sum(y * y)) AS norm FROM (SELECT label, k, avg(x::DOUBLE) AS y FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings) GROUP BY ALL) GROUP BY label) ON l2 = label GROUP BY label, k) GROUP BY label")
def mean_pool_l2(spark: SparkSession, folder: str) -> DataFrame:
    """Each label's vectors averaged, and the average pooled with a copy that the mask hides; the result has length one."""
    each = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    mean = each.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("v")).select("label", F.transform("v", lambda p: p["m"]).alias("v"))
    pooled = rows.select("label", v.mean_pool(F.array("v", "v"), F.array(F.lit(1), F.lit(0))).alias("p"))
    return pooled.select("label", F.round(F.sqrt(v.dot(F.col("p"), F.col("p"))), 9).alias("length"), F.size("p").cast("bigint").alias("width"))


@query("SELECT id, sha256(id || ':' || coalesce(title, '')) AS hash FROM documents")
def sha256_hex(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("id", F.sha2(F.concat_ws(":", "id", F.coalesce("title", F.lit(""))), 256).alias("hash"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.' || (user_id % 250) || '.7' ELSE 'fd00:' || user_id || ':0:1' END AS network FROM events")
def ip_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of both kinds cut to their networks."""
    four = F.concat(F.lit("10."), (F.col("user_id") % 250).cast("string"), F.lit(".7."), (F.col("event_id") % 250).cast("string"))
    six = F.concat(F.lit("fd00:"), F.col("user_id").cast("string"), F.lit(":0:1:2:3:4:5"))
    return table(spark, folder, "events").select("event_id", t.ip_prefix(F.when(F.col("event_id") % 2 == 0, four).otherwise(six)).alias("network"))


@query(f"SELECT id, {sql_prefix(f'lower({sql_strip("title")})', 512)} AS agent FROM documents WHERE title IS NOT NULL")
def ua_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("title IS NOT NULL").select("id", t.byte_prefix(F.lower(t.strip_text(F.col("title"))), 512).alias("agent"))


@query("SELECT a.vec_id, round(greatest(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) b")
def clamp_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each vector to the first, 0 for negative ones."""
    vectors = table(spark, folder, "embeddings")
    first = vectors.agg(F.min_by("embedding", "vec_id").alias("e"))
    return vectors.join(F.broadcast(first)).select("vec_id", F.round(F.greatest(v.cosine(F.col("embedding"), F.col("e")), F.lit(0.0)), 6).alias("cosine"))  # one row
