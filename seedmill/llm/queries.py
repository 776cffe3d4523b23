"""One query for each operator of this subpackage, over whole tables and with production parameters."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedmill.llm import (
    collocations,
    fill_in_middle,
    hidden_markov,
    near_duplicates,
    packing,
    personal_data,
    posting_lists,
    quality_rules,
    revisits,
    secret_ledger,
    sharding,
    token_counts,
    tree_bpe,
)
from seedmill.llm.registry import QUERIES, SQL, query, table

BYTE_BPE = "byte_bpe_50k.json"

__all__ = ["QUERIES", "SQL"]

CRC32_SQL = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda a, k:
               CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_sql(hexed: str, size: str) -> str:
    """CRC-32 of the bytes that ``hexed`` spells, with ``crc_table`` in scope."""
    byte = f"('0x' || substr({hexed}, (2 * k + 1)::INT, 2))::BIGINT"
    step = "xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    bytes_ = f"list_transform(range({size}), lambda k: {byte})"
    return f"xor(list_reduce([4294967295::BIGINT] || {bytes_}, lambda a, b: {step}), 4294967295)"


@query(
    f"""
WITH {CRC32_SQL},
known AS (
  SELECT doc_id, size, {crc32_sql("hexed", "size - 16")} AS text_crc32
  FROM (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS hexed
        FROM documents), crc_table),
scored AS (
  SELECT k.*, s.shard, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#' || (shard // 4)),
                                              (1 + 8 * (shard % 4))::INT, 8))::BIGINT + 0.5) / 4294967296.0) AS score
  FROM known k, (SELECT unnest(range(41))::INT AS shard) s),
placed AS (
  SELECT doc_id, size, text_crc32, 'key' AS law,
         arg_min(shard, score) FILTER (shard < 40) AS shard, arg_min(shard, score) AS grown_shard
  FROM scored GROUP BY doc_id, size, text_crc32)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), size,
         text_crc32, law, shard, grown_shard))) - 1 AS slot
FROM placed
"""
)
def op5_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), [1.0] * 40, grown_weight=1.0)


@query()
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality_rules.rate_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


_ASSIGN_SQL = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)


def _matches_sql(number: int, rule: secret_ledger.SecretRule) -> str:
    pattern = _ASSIGN_SQL if rule.kind == "assign" else rule.pattern
    size = f"length(regexp_extract(found, '{pattern}', 1))" if rule.group else "length(found)"
    return f"""
  SELECT row_no, {number} AS kind_no, '{rule.kind}' AS kind, {size} >= {rule.least} AS good, length(found) AS size,
         sum(length(gap) + length(found)) OVER (PARTITION BY row_no ORDER BY place) AS ends
  FROM (SELECT row_no, unnest(regexp_extract_all(text, '{pattern}')) AS found,
               unnest(string_split_regex(text, '{pattern}')) AS gap,
               unnest(range(len(string_split_regex(text, '{pattern}')))) AS place
        FROM texts WHERE regexp_matches(text, '{pattern}'))
  WHERE found IS NOT NULL"""


_SECRETS_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_matches_sql(i, r) for i, r in enumerate(secret_ledger.RULES))}),
named AS (
  SELECT row_no, kind_no, kind, ends - size AS starts, kind || ':' || (ends - size)::BIGINT || ':' || ends::BIGINT AS span
  FROM spans WHERE good),
found AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY starts, kind_no) FILTER (kind_no < {len(secret_ledger.BASE_RULES)}) AS base,
         string_agg(span, ',' ORDER BY starts, kind_no) AS spans
  FROM named GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (row_no)
"""


@query(_SECRETS_SQL)
def op3_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return secret_ledger.document_secrets(table(spark, folder, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of the pages: a full response each, a later revisit and an earlier one.

    Some revisits have a changed tag, some only a date, some no validator.
    """
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    tagless, changed, bare = page % 7 == 3, page % 5 == 0, page % 11 == 4
    modified = F.concat(F.lit("day "), (page % 400).cast("string"))

    def fields(**values) -> Column:
        pairs = [F.struct(F.lit(k.replace("_", "-")).alias("k"), v.alias("v")) for k, v in values.items()]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))

    def record(number: int, seconds, url, full: bool, headers) -> Column:
        return F.struct(
            (page * 3 + number).alias("record_id"),
            url.alias("url"),
            (page * 60 + seconds).cast("long").alias("ts"),
            F.lit(full).alias("full"),
            headers.alias("headers"),
            F.md5("html").alias("digest"),
        )

    response = fields(
        Content_Type=F.lit("text/html"),
        Content_Length=F.octet_length("html").cast("string"),
        Date=F.concat(F.lit("t"), page.cast("string")),
        ETag=F.when(~tagless, tag),
        Last_Modified=modified,
    )

    def not_modified(fresh_tag) -> Column:
        return fields(
            Cache_Control=F.lit("max-age=60"),
            Connection=F.lit("close"),
            Content_Length=F.lit("0"),
            Date=F.concat(F.lit("again "), page.cast("string")),
            ETag=F.when(~tagless & ~bare, fresh_tag),
            Last_Modified=F.when(tagless, modified),
        )

    later_url = F.concat(F.regexp_replace("url", "^https://", "http://www."), F.lit("#again"))
    later_tag = F.when(changed, F.lit('"changed"')).otherwise(tag)
    return pages.select(
        F.inline(
            F.array(
                record(0, F.lit(0), F.col("url"), True, response),
                record(1, (page % 97) * 3600 + 30, later_url, False, not_modified(later_tag)),
                record(2, F.lit(-45), F.col("url"), False, not_modified(F.concat(F.lit("W/"), tag))),
            )
        )
    )


_BARE_SQL = r"regexp_replace(regexp_replace({url}, '(?s)#.*$', ''), '^(?i:https?)://', '')"


def canonical_sql(url: str) -> str:
    bare = _BARE_SQL.format(url=url)
    host = rf"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')"
    path = rf"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    parts = (
        rf"list_filter(string_split(regexp_extract({bare}, '(?s)\?(.*)$', 1), '&'), "
        rf"lambda p: p <> '' AND NOT regexp_matches(lower(p), '{revisits.TRACKING}'))"
    )
    joined = f"array_to_string(list_sort({parts}), '&')"
    return f"{host} || {path} || CASE WHEN {joined} = '' THEN '' ELSE '?' || {joined} END"


_HEADERS_SQL = ", ".join(
    f"'{name}=' || CASE WHEN outcome = 'resolved' THEN {merged} ELSE {own} END"
    for name, own, merged in (
        ("cache-control", "'max-age=60'", "'max-age=60'"),
        ("connection", "'close'", "NULL"),
        ("content-length", "'0'", "p_length::VARCHAR"),
        ("content-type", "NULL", "'text/html'"),
        ("date", "'again ' || page_id", "'again ' || page_id"),
        ("etag", "etag", "coalesce(etag, p_etag)"),
        ("last-modified", "modified", "coalesce(modified, p_modified)"),
    )
)


@query(
    f"""
WITH tagged AS (
  SELECT *, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || page_id % 400 AS day FROM pages),
responses AS (
  SELECT page_id * 3 AS p_id, page_id * 60 AS p_ts, {canonical_sql("url")} AS canonical_url, md5(html) AS p_digest,
         strlen(html) AS p_length, CASE WHEN page_id % 7 <> 3 THEN tag END AS p_etag, day AS p_modified
  FROM tagged),
revisits AS (
  SELECT page_id, page_id * 3 + 1 AS record_id, page_id * 60 + 30 + page_id % 97 * 3600 AS ts,
         regexp_replace(url, '^https://', 'http://www.') || '#again' AS url,
         CASE WHEN page_id % 7 <> 3 AND page_id % 11 <> 4
              THEN CASE WHEN page_id % 5 = 0 THEN '"changed"' ELSE tag END END AS etag,
         CASE WHEN page_id % 7 = 3 THEN day END AS modified FROM tagged
  UNION ALL
  SELECT page_id, page_id * 3 + 2, page_id * 60 - 45, url,
         CASE WHEN page_id % 7 <> 3 AND page_id % 11 <> 4 THEN 'W/' || tag END,
         CASE WHEN page_id % 7 = 3 THEN day END FROM tagged),
named AS (SELECT *, {canonical_sql("url")} AS canonical_url FROM revisits),
matched AS (
  SELECT r.*, p_id, p_digest, p_length, p_etag, p_modified,
         coalesce(regexp_replace(p_etag, '^W/', '') = regexp_replace(etag, '^W/', ''), p_modified = modified) AS agree
  FROM named r ASOF LEFT JOIN responses p ON r.canonical_url = p.canonical_url AND r.ts > p.p_ts),
judged AS (
  SELECT *, CASE WHEN p_id IS NULL THEN 'no_response' WHEN agree IS NULL THEN 'unverified'
                 WHEN agree THEN 'resolved' ELSE 'mismatch' END AS outcome FROM matched)
SELECT record_id, canonical_url, ts, outcome, p_id AS refers_to,
       CASE WHEN outcome = 'resolved' THEN p_digest END AS digest, concat_ws(';', {_HEADERS_SQL}) AS headers
FROM judged
"""
)
def op10_resolve_revisits(spark: SparkSession, folder: str) -> DataFrame:
    resolved = revisits.resolve_revisits(captures(table(spark, folder, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return resolved.select(
        "record_id",
        "canonical_url",
        "ts",
        "outcome",
        "refers_to",
        "digest",
        F.array_join(F.sort_array(lines), ";").alias("headers"),
    )


@query()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


@query()
def op4_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


@query()
def op7_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return tree_bpe.encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


@query()
def op8_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_markov.score_documents(table(spark, folder, "documents"))


@query()
def op1_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return posting_lists.nearest(table(spark, folder, "embeddings"))


@query()
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.duplicate_classes(table(spark, folder, "documents"))


_FIM_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@query(
    rf"""
WITH cut AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_FIM_UNIT}') AS units,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS a,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS c
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b
              ELSE '<P>' || a || '<S>' || c || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


def _proposed_sql(number: int, kind: personal_data.PiiKind) -> str:
    return rf"""
  SELECT row_no, {number} AS kind_no, '{kind.kind}' AS kind, found, right(gap, 40) AS before, left(after, 40) AS after,
         length(found) AS found_chars,
         sum(length(gap) + length(found)) OVER (PARTITION BY row_no ORDER BY place) - length(found) AS starts
  FROM (SELECT row_no, unnest(regexp_extract_all(text, '{kind.pattern}')) AS found, unnest(parts[1:-2]) AS gap,
               unnest(parts[2:]) AS after, unnest(range(len(parts) - 1)) AS place
        FROM (SELECT row_no, text, string_split_regex(text, '{kind.pattern}') AS parts FROM texts
              WHERE regexp_matches(text, '{kind.pattern}')))"""


def _points_sql() -> str:
    cases = "".join(
        f" WHEN {number} THEN {kind.score}"
        f" + CASE WHEN regexp_matches(context, '{personal_data.near_words(kind.near)}') THEN 30 ELSE 0 END"
        f" - CASE WHEN regexp_matches(context, '{personal_data.near_words(kind.against)}') THEN 40 ELSE 0 END"
        for number, kind in enumerate(personal_data.KINDS)
    )
    return f"least(100, greatest(0, CASE kind_no{cases} END))"


_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_COUNTRIES = ", ".join(f"'{code}': {size}" for code, size in personal_data.IBAN_CHARS.items())
_PII_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
proposed AS ({" UNION ALL ".join(_proposed_sql(i, k) for i, k in enumerate(personal_data.KINDS))}),
sized AS (
  SELECT *, lower(before || ' ' || after) AS context, regexp_replace(found, '[^0-9]', '', 'g') AS digits,
         MAP {{{_COUNTRIES}}}[substr(found, 1, 2)] AS country_chars,
         CASE WHEN kind <> 'iban' THEN found_chars WHEN substr(found, 5, 1) = ' '
              THEN country_chars + (country_chars - 1) // 4 ELSE country_chars END AS size
  FROM proposed WHERE found IS NOT NULL),
spelled AS (
  SELECT *, replace(substr(found, 1, size::BIGINT), ' ', '') AS account,
         substr(found, size::BIGINT + 1) || after AS following FROM sized),
checked AS (
  SELECT *, CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_matches(found, '^{_PART}\.{_PART}\.{_PART}\.{_PART}$')
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
         CASE WHEN i % 2 = 0 THEN substr(digits, length(digits) - i, 1)::INT
              ELSE (2 * substr(digits, length(digits) - i, 1)::INT) // 10
                 + (2 * substr(digits, length(digits) - i, 1)::INT) % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(account) = country_chars AND NOT regexp_matches(before, '[A-Za-z0-9]$')
         AND NOT regexp_matches(following, '^[A-Za-z0-9]')
         AND list_reduce([0::BIGINT] || list_transform(string_split(substr(account, 5) || substr(account, 1, 4), ''),
               lambda c: CASE WHEN regexp_matches(c, '[A-Z]') THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT),
               lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1
    ELSE NOT regexp_matches(before, '[0-9A-Za-z-]$') AND NOT regexp_matches(after, '^[0-9A-Za-z-]')
         AND NOT regexp_matches(found, '^(000|666|9)|-00-|-0000$') END
    AND (kind_no < {len(personal_data.BASE_KINDS)} OR {_points_sql()} >= {personal_data.THRESHOLD}) AS good
  FROM spelled),
named AS (
  SELECT *, kind || ':' || starts::BIGINT || ':' || (starts + size)::BIGINT AS span FROM checked WHERE good),
found AS (
  SELECT row_no, {", ".join(f"count(*) FILTER (kind = '{k.kind}') AS n_{k.kind}" for k in personal_data.BASE_KINDS)},
         string_agg(span, ',' ORDER BY starts, kind_no) FILTER (kind_no < {len(personal_data.BASE_KINDS)}) AS base,
         string_agg(span, ',' ORDER BY starts, kind_no) AS spans
  FROM named GROUP BY row_no)
SELECT doc_id, {", ".join(f"coalesce(n_{k.kind}, 0) AS n_{k.kind}" for k in personal_data.BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (row_no)
"""


@query(_PII_SQL)
def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.document_personal_data(table(spark, folder, "documents"))


@query(
    r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?
-]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' ')))
         AS phrase
  FROM words, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size),
counts AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = tail),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
spots AS (
  SELECT lang, array_to_string(w[s:s + z - 1], ' ') AS phrase, f
  FROM candidates, (SELECT unnest(range(2, 4)) AS z), (SELECT unnest(range(1, 4)) AS s) WHERE z < size AND s + z - 1 <= size),
inner_ AS (SELECT lang, phrase, max(f) AS longest FROM spots GROUP BY lang, phrase),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE place = 1 AND NOT coalesce(100::HUGEINT * longest >= 80::HUGEINT * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
