"""Text, array, JSON and number functions as column expressions.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space, as a class of regular expressions.
SPACE = r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"
#: Fixed value: characters of the East Asian scripts and their punctuation, as a class without brackets.
DENSE = r"\p{IsHan}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"


def strip_text(text: Column) -> Column:
    """Text without white space around it."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def estimate_tokens(text: Column) -> Column:
    """Size of a text for budgets: one for each East Asian character, one for every four others."""
    dense = F.regexp_count(text, F.lit(f"[{DENSE}]"))
    return (dense + F.ceil((F.char_length(text) - dense) / F.lit(4))).cast("int")


def estimate_llm_tokens(text: Column) -> Column:
    """Size of a prompt: one for each character beyond ASCII, one for every four of the remaining bytes, rounded down."""
    wide = F.regexp_count(text, F.lit(r"[^\x{00}-\x{7F}]"))
    return (wide + F.floor((F.octet_length(text) - wide) / F.lit(4))).cast("int")


def normalize_eol(text: Column) -> Column:
    """All line ends as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def byte_prefix(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters that takes at most ``limit`` bytes."""
    raw = F.encode(text, "UTF-8")
    # a byte 10xxxxxx after the cut belongs to the character before it
    back = F.coalesce(
        *[F.when((F.octet_length(raw) <= limit - k) | ~F.hex(F.substring(raw, limit - k + 1, 1)).rlike("^[89AB]"), F.lit(limit - k)) for k in range(4)],
        F.lit(0),
    )
    return F.when(F.octet_length(raw) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), back), "UTF-8"))


def utf8_prefix(text: Column, limit: int, more: str = "…") -> Column:
    """``byte_prefix``, with ``more`` after a text that was cut."""
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(byte_prefix(text, limit), F.lit(more)))


def truncate_text(text: Column, limit: int) -> Column:
    """``byte_prefix``, with three dots after a text that was cut."""
    return utf8_prefix(text, limit, "...")


def sanitize_path(text: Column, limit: int = 100) -> Column:
    """A title as one segment of a path: trimmed, slashes as hyphens, at most ``limit`` bytes of whole characters."""
    return byte_prefix(F.translate(strip_text(text), "/\\", "--"), limit)


def sanitize_path_part(text: Column) -> Column:
    """``sanitize_path`` of 120 bytes; ``body`` for a blank title."""
    part = sanitize_path(text, 120)
    return F.when(part == "", "body").otherwise(part)


def chapter_display_title(path: Column, document_id: Column) -> Column:
    """A chapter's path for reading: without its document, segments parted by dots; ``Document`` if nothing remains."""
    below = F.when(F.startswith(path, F.concat(document_id, F.lit("/"))), F.substring(path, F.char_length(document_id) + 2, F.char_length(path))).otherwise(path)
    shown = strip_text(F.replace(strip_text(below), F.lit("/"), F.lit(" · ")))
    return F.when(shown == "", "Document").otherwise(shown)


def path_title(path: Column, fallback: Column, document_id: Column) -> Column:
    """The last segment of a path that isn't empty; ``fallback`` where that is the document's id or missing."""
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1))
    return F.when(last.isNull() | (last == document_id), fallback).otherwise(last)


def merge_tags(*lists: Column) -> Column:
    """Tags of several lists in order: trimmed, without blanks, of spellings that differ in case only the first. Null lists are empty."""
    joined = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    clean = F.filter(F.transform(F.filter(joined, lambda t: t.isNotNull()), strip_text), lambda t: t != "")
    lower = F.transform(clean, F.lower)
    return F.filter(clean, lambda t, k: F.array_position(lower, F.lower(t)) == k + 1)


def parse_csv_list(text: Column) -> Column:
    """The trimmed parts between commas that aren't empty."""
    return F.filter(F.transform(F.split(text, ","), strip_text), lambda s: s != "")


def format_array(items: Column) -> Column:
    """An array as a literal: braces around items in quotes, quotes and backslashes inside them escaped."""
    quoted = F.transform(items, lambda s: F.concat(F.lit('"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def parse_array(text: Column) -> Column:
    """The items of a literal made by ``format_array``; bare items may stand without quotes."""
    found = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"|([^{},"\s][^{},"]*)'), F.lit(0))
    return F.transform(found, lambda s: F.when(F.startswith(s, F.lit('"')), F.regexp_replace(F.substring(s, F.lit(2), F.char_length(s) - 2), r"\\(.)", "$1")).otherwise(s))


#: The tags between which models put their reasoning.
THINKING = ("think", "thinking", "redacted_thinking", "redacted_reasoning")


def strip_thinking(text: Column) -> Column:
    """An answer without what a model wrote between tags of thinking, trimmed; white space may stand inside the brackets."""
    for tag in THINKING:
        text = F.regexp_replace(text, rf"(?is)<\s*{tag}\s*>.*?</\s*{tag}\s*>", "")
    return strip_text(text)


def split_answer(text: Column, mark: str = "---PART:KNOWLEDGE---") -> Column:
    """``answer`` before the first mark and ``knowledge`` after it, both trimmed; without a mark all is answer."""
    cut = F.locate(mark, text)
    before = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    after = F.when(cut > 0, F.substring(text, cut + len(mark), F.char_length(text))).otherwise(F.lit(""))
    return F.struct(strip_text(before).alias("answer"), strip_text(after).alias("knowledge"))


def parse_bytes(text: Column, default: int) -> Column:
    """A size such as ``10 MB`` or ``1.5GiB`` in bytes, with KB, MB, GB, KiB, MiB or GiB (units of 1,024) or none; ``default`` for anything else, null and what is not above zero included."""
    bare = F.upper(F.replace(strip_text(text), F.lit(" "), F.lit("")))
    form = r"^(\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:E[+-]?[0-9]+)?)(?:([KMG])I?B)?$"
    unit, number = F.regexp_extract(bare, form, 2), F.regexp_extract(bare, form, 1)
    scale = F.pow(F.lit(1024.0), F.locate("K", unit) + 2 * F.locate("M", unit) + 3 * F.locate("G", unit))
    size = F.when(number != "", number).try_cast("double") * scale
    return F.coalesce(F.when(size >= 1, size.try_cast("bigint")), F.lit(default).cast("bigint"))


def limit_or(text: Column, default: int, most: int) -> Column:
    """A requested limit: ``default`` for null, blank, unreadable or below one; ``most`` at most."""
    asked = F.expr("1") * F.try_to_number(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d{1,9})\s*$", 1), F.lit("999999999"))
    return F.least(F.when(asked >= 1, asked.cast("int")).otherwise(F.lit(default)), F.lit(most))


def json_array_text(text: Column) -> Column:
    """What stands from the first ``[`` to the last ``]``; null without both."""
    start, end = F.locate("[", text), F.char_length(text) - F.locate("]", F.reverse(text)) + 1
    return F.when((start > 0) & F.contains(text, F.lit("]")) & (end > start), F.substring(text, start, end - start + 1))


def json_relevances(text: Column, key: str = "id") -> Column:
    """The entries ``key, relevance`` of a JSON array inside a text; an empty array where there is none to be read."""
    kind = f"array<struct<{key}: string, relevance: double>>"
    return F.coalesce(F.from_json(json_array_text(text), kind), F.array().cast(kind))


#: What a secret's text begins with, and what takes the place of a masked one.
SECRET_PREFIXES = ("sk-", "sk_live", "sk_test", "sk_proj", "pk_live", "pk_test", "rk_live", "rk_test", "ts_u_", "tsk_live", "tsk_admin")
MASK = "[redacted]"


def redact(text: Column) -> Column:
    """A text whose trimmed whole looks like a credential as a mask with its kind; in other texts, name and password of addresses are masked.

    Kinds: blocks of private keys, signed tokens (three parts of ten characters or more), keys of a known prefix and at
    least twelve bytes, access key ids of twenty characters.
    """
    bare, part = strip_text(text), r"[A-Za-z0-9_=-]{10,}"
    pieces = F.split(bare, r"\.")
    telling = F.forall(pieces, lambda p: (F.char_length(F.regexp_replace(p, "[-_=]", "")) >= F.floor(F.char_length(p) / F.lit(2))) & ~p.rlike("^[0-9]+$"))
    token = bare.rlike(rf"^{part}\.{part}\.{part}$") & (F.char_length(bare) >= 40) & telling
    known = bare.rlike("(?i)^(?:" + "|".join(SECRET_PREFIXES) + ")") & (F.octet_length(bare) >= 12)
    address = F.regexp_replace(bare, r"(?i)([a-z][a-z0-9+.-]*://)([^/?#:]+):([^@/?#]*)@", "$1*:*@")
    kinds = ((F.contains(bare, F.lit("BEGIN")) & F.contains(bare, F.lit("PRIVATE")), "pem-private-block"), (token, "jwt"), (known, "credential-prefix"), (bare.rlike("^A[KS]IA[A-Z0-9]{16}$"), "aws-access-key-id"))
    masked = F.when(F.lit(False), text)
    for test, kind in kinds:
        masked = masked.when(test, F.lit(f"{MASK}:{kind}"))
    return masked.when(address != bare, address).otherwise(text)


def ip_prefix(ip: Column) -> Column:
    """The first three numbers of an IPv4 address, the first four groups of an IPv6 address."""
    return F.when(F.contains(ip, F.lit(":")), F.substring_index(ip, ":", 4)).otherwise(F.substring_index(ip, ".", 3))


#: Names of settings that are never masked, that always are, and endings of such that are.
OPEN_KEYS = (
    "max_tokens", "min_tokens", "temperature", "top_p", "sample_ratio", "progressive_answer_max_tokens", "progressive_answer_max_references",
    "progressive_answer_excerpt_max_bytes", "force_sample_query_param", "force_sample_header", "token_expiry_mode", "disable_think", "num_cpu", "gomaxprocs", "compiler",
    "span_count", "max_size", "max_chunk_size", "chapter_max_tokens", "sliding_stride_tokens", "branch_recall_multiplier", "branch_recall_floor", "branch_recall_ceiling",
    "hnsw_m", "hnsw_ef_search", "vector_dim", "cold_doc_count",
)
SECRET_KEYS = (
    "password", "passwd", "pwd", "passphrase", "api_key", "apikey", "apisecret", "apisecretkey", "secret", "client_secret", "clientsecret",
    "private_key", "privatekey", "privkey", "access_token", "refresh_token", "id_token", "session_token", "authorization", "cookie", "set_cookie", "set-cookie",
    "dsn", "database_url", "databaseurl", "connection_string", "connectionstring", "jdbc_url", "jdbcurl", "conn_string",
    "webhook_secret", "signing_secret", "signing_key", "encryption_key", "encrypted_password", "otp_secret", "totp_secret", "mfa_secret", "ssh_key", "tls_key", "tlskey",
)
SECRET_ENDINGS = (
    "_password", "_passwd", "_pwd", "_passphrase", "_secret", "_api_key", "_apikey", "_private_key", "_client_secret", "_access_token", "_refresh_token", "_id_token", "_session_token",
    "_dsn", "_webhook_secret", "_signing_secret", "_signing_key", "_encryption_key", "_otp_secret", "_totp_secret", "_mfa_secret", "_bearer", "_credential", "_credentials", "_token",
)
SECRET_KINDS = ("api", "secret", "private", "encrypt", "signing", "webhook", "license")  # of what ends in _key


def secret_key(key: Column) -> Column:
    """Whether a setting's value is masked whatever it is, by its name; false for null and blank names."""
    name = F.lower(strip_text(F.coalesce(key, F.lit(""))))
    kind = F.endswith(name, F.lit("_key")) & name.rlike("|".join(SECRET_KINDS))
    told = name.isin(*SECRET_KEYS) | name.rlike("(?:" + "|".join(SECRET_ENDINGS) + ")$") | F.startswith(name, F.lit("secret_")) | kind
    return told & ~name.isin(*OPEN_KEYS)


def redact_map(settings: Column) -> Column:
    """A map of settings with values masked by their names, with their length in bytes, and the others by ``redact``; null values of other names stay null."""

    def masked(key: Column, value: Column) -> Column:
        whole = F.when(strip_text(F.coalesce(value, F.lit(""))) == "", F.lit(MASK)).otherwise(F.concat(F.lit(f"{MASK} (scalar was "), F.octet_length(value).cast("string"), F.lit(" chars)")))
        return F.when(secret_key(key), whole).otherwise(redact(value))

    return F.transform_values(settings, masked)


def reference_entry(number: Column, title: Column, document_id: Column, path: Column, status: Column, relevance: Column, content: Column, most: int = 3500) -> Column:
    """One entry of a prompt's list of references; its excerpt takes at most ``most`` bytes. Nulls are empty, an empty status is left out."""
    of = lambda c: F.coalesce(c, F.lit(""))
    told = F.when(of(status) != "", F.concat(F.lit("Document status: "), status, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("\n### Reference [^"), number.cast("string"), F.lit("^]\nTitle: "), of(title), F.lit("\nDocument ID: "), of(document_id), F.lit("\nPath: "), of(path), F.lit("\n"), told,
        F.lit("Relevance (0-1): "), F.format_string("%.4f", relevance), F.lit("\nExcerpt:\n"), utf8_prefix(of(content), most, "\n…(truncated)"), F.lit("\n"),
    )


def fingerprint(agent: Column, ip: Column, zone: Column, signal: Column) -> Column:
    """A hash of a caller's agent (in lower case, at most 512 bytes), network, time zone and signal; nulls count as empty."""
    of = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("|", byte_prefix(F.lower(strip_text(of(agent))), 512), ip_prefix(of(ip)), of(zone), of(signal)), 256)


def hot_score(count: Column, last: Column, as_of: Column) -> Column:
    """Queries of a document, damped by the hours since the last one (168 if unknown, 0 at least), to two places."""
    hours = F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(as_of) - F.unix_micros(last)) / F.lit(3.6e9), F.lit(168.0)))
    score = F.coalesce(count, F.lit(0)) / (1 + F.log1p(hours))
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.floor(score * 100 + 0.5) / 100)


def span_attribute(attributes: Column, *keys: str) -> Column:
    """The first of the keys that a span's JSON attributes hold; null for broken JSON."""
    return F.coalesce(*[F.get_json_object(attributes, f"$['{k}']") for k in keys])


def span_duration_ms(start: Column, end: Column) -> Column:
    """A span's duration in milliseconds; null where it ends before it starts."""
    return F.when(end >= start, (end - start) / F.lit(1e6))


def branch_recall(top: Column, *, multiplier: int = 2, floor: int = 20, ceiling: int = 200) -> Column:
    """How many hits each branch of a search is asked for; settings of zero or less fall back to 2, 20 and 200."""
    multiplier, floor, ceiling = multiplier if multiplier > 0 else 2, floor if floor > 0 else 20, ceiling if ceiling > 0 else 200
    return F.least(F.greatest(F.greatest(top, F.lit(1)) * multiplier, F.lit(floor)), F.lit(max(ceiling, floor)))


def terms(text: Column) -> Column:
    """Terms of a text: runs of letters and digits in lower case, Chinese characters one by one; none for null."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([\x{4E00}-\x{9FFF}])", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
