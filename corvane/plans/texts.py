"""Plans of text functions, intent, models and serials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, intent, serials, texts
from .base import ASKS_SQL, CHUNKS_SQL, asks, chunks, sql
from .registry import plan, table

FOLD_SQL = "lower(translate(ask, '‘’`´', ''''''''''))"
for _short, _long in intent.CONTRACTIONS.items():
    FOLD_SQL = f"regexp_replace({FOLD_SQL}, '\\b{_short.replace(chr(39), chr(39) * 2)}\\b', '{_long}', 'g')"
FOLD_SQL = f"replace({FOLD_SQL}, '''', '')"
for _short, _long in intent.CONTRACTIONS.items():
    FOLD_SQL = f"regexp_replace({FOLD_SQL}, '\\b{_short.replace(chr(39) + '?', '')}\\b', '{_long}', 'g')"
FOLD_SQL = f"trim(regexp_replace({FOLD_SQL}, '\\s+', ' ', 'g'))"


@plan("content_hash", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS content_hash FROM documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", texts.content_hash(F.col("text")).alias("content_hash"))


@plan("chunk_id", sql("SELECT chunk_no, 'p' || page || '-' || kind || '-' || substr(sha256(page || ':' || kind || ':' || text), 1, 12) AS chunk_id FROM chunks", CHUNKS_SQL))
def chunk_id(spark, folder):
    return chunks(spark, folder).select("chunk_no", texts.chunk_id(F.col("page"), F.col("kind"), F.col("text")).alias("chunk_id"))


@plan("extract_error_codes", sql(r"SELECT chunk_no, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bF\s*[0-9]\s*E\s*[0-9]\b', 0), lambda x: upper(regexp_replace(x, '\s+', '', 'g'))))), ',') AS codes FROM chunks", CHUNKS_SQL))
def extract_error_codes(spark, folder):
    return chunks(spark, folder).select("chunk_no", F.array_join(codes.error_codes(F.col("text")), ",").alias("codes"))


@plan("extract_connector_ids", sql(r"SELECT chunk_no, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bJ([0-9]{1,3})\b', 1), lambda x: 'J' || x))), ',') AS connectors FROM chunks", CHUNKS_SQL))
def extract_connector_ids(spark, folder):
    return chunks(spark, folder).select("chunk_no", F.array_join(codes.connector_ids(F.col("text")), ",").alias("connectors"))


@plan("code_spaced_regex", r"""SELECT p_partkey, code, CASE WHEN regexp_full_match(upper(trim(code)), 'F[0-9]E[0-9]') THEN 'F\s*' || substr(upper(trim(code)), 2, 1) || '\s*E\s*' || substr(upper(trim(code)), 4, 1) END AS pattern
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'f' || p_partkey % 10 || 'e' || p_size % 10 WHEN 1 THEN ' F' || p_partkey % 10 || 'E' || p_size % 10 || ' ' ELSE 'F' || p_partkey END AS code FROM part)""")
def code_spaced_regex(spark, folder):
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, F.concat(F.lit("f"), k % 10, F.lit("e"), F.col("p_size") % 10)).when(k % 3 == 1, F.concat(F.lit(" F"), k % 10, F.lit("E"), F.col("p_size") % 10, F.lit(" "))).otherwise(F.concat(F.lit("F"), k))
    return table(spark, folder, "part").select("p_partkey", code.alias("code")).withColumn("pattern", codes.code_regex(F.col("code")))


@plan("query_literals", """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]{3,}', 0) AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
m AS (SELECT doc_id, upper(x) AS x, min(i) AS i FROM u WHERE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(x, ',' ORDER BY i), '') AS literals FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1""")
def query_literals(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(codes.query_literals(F.col("text")), ",").alias("literals"))


@plan("queried_publications", sql(r"""SELECT query_id, CASE WHEN regexp_matches(ask, '(?i)\bpart\s*(number|#|no\.?)\b') THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(ask, '(?i)\b(W[0-9]{8})\b', 1), lambda x: upper(x)))), ',') END AS publications,
nullif(upper(regexp_extract(ask, '(?i)\brevision\s+([A-Z])\b', 1)), '') AS revision FROM asks""", ASKS_SQL))
def queried_publications(spark, folder):
    return asks(spark).select("query_id", F.array_join(codes.queried_publications(F.col("ask")), ",").alias("publications"), codes.requested_revision(F.col("ask")).alias("revision"))


@plan("requested_revision", sql(r"SELECT query_id, nullif(upper(regexp_extract(ask, '(?i)\brevision\s+([A-Z])\b', 1)), '') AS revision FROM asks", ASKS_SQL))
def requested_revision(spark, folder):
    return asks(spark).select("query_id", codes.requested_revision(F.col("ask")).alias("revision"))


BIBLIOGRAPHIC = r"(?i)\b(service manual|which manual|what manual|manual covers|covers a\b)\b"
INSTALLATION = r"(?i)\b(new washer|newly installed|just installed|shipping bolt|leveling|shakes?|shaking|violently)\b"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


@plan("intent_flags", sql(f"SELECT query_id, regexp_matches(ask, '{_quoted(BIBLIOGRAPHIC)}') AS is_bibliographic, regexp_matches(ask, '{_quoted(INSTALLATION)}') AS is_installation, regexp_matches(ask, '{_quoted(intent.LED)}') AS is_acu_led, regexp_matches(ask, '{_quoted(intent.TECHNICIAN)}') AS is_technician_depth FROM asks", ASKS_SQL))
def intent_flags(spark, folder):
    a = F.col("ask")
    return asks(spark).select("query_id", a.rlike(BIBLIOGRAPHIC).alias("is_bibliographic"), a.rlike(INSTALLATION).alias("is_installation"), intent.is_led_query(a).alias("is_acu_led"), intent.is_technician_query(a).alias("is_technician_depth"))


@plan("needs_service_literature", sql(f"""SELECT query_id, (regexp_matches(ask, '{_quoted(BIBLIOGRAPHIC)}') OR regexp_matches(ask, '{_quoted(intent.TECHNICIAN)}') OR regexp_matches(ask, '(?i)\\bF\\s*[0-9]\\s*E\\s*[0-9]\\b') OR regexp_matches(ask, '(?i)\\bJ[0-9]{{1,3}}\\b') OR regexp_matches(ask, '{intent.PART_OR_TEST}')) AS needed FROM asks""", ASKS_SQL))
def needs_service_literature(spark, folder):
    return asks(spark).select("query_id", intent.needs_service_literature(F.col("ask"), F.col("ask").rlike(BIBLIOGRAPHIC)).alias("needed"))


@plan("fold_query", sql(f"SELECT query_id, {FOLD_SQL} AS folded FROM asks", ASKS_SQL))
def fold_query(spark, folder):
    return asks(spark).select("query_id", intent.fold_query(F.col("ask")).alias("folded"))


@plan("door_polarity", sql(f"""SELECT query_id, CASE WHEN u AND NOT l THEN 'unlock' WHEN l AND NOT u THEN 'lock' END AS polarity FROM (SELECT query_id, regexp_matches(q, '{intent.UNLOCK}') AS u, regexp_matches(q, '{intent.LOCK}') AS l FROM (SELECT query_id, {FOLD_SQL} AS q FROM asks))""", ASKS_SQL))
def door_polarity(spark, folder):
    return asks(spark).select("query_id", intent.door_polarity(F.col("ask")).alias("polarity"))


@plan("content_tokens", f"""WITH s AS (SELECT {texts.STOP_WORDS!r} AS stop), t AS (SELECT conv_id, turn, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}', 0)), lambda x: NOT list_contains(stop, x))) AS w FROM conversations, s)
SELECT conv_id, turn, len(w) AS n, array_to_string(w, ' ') AS tokens FROM t""")
def content_tokens(spark, folder):
    c = table(spark, folder, "conversations").withColumn("w", texts.content_tokens(F.col("text")))
    return c.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("tokens"))


@plan("html_to_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS visible FROM pages""")
def html_to_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", texts.html_to_text(F.col("html")).alias("visible"))


@plan("slugify", "SELECT page_id, coalesce(nullif(rtrim(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-'), ''), 'unit') AS slug FROM pages")
def slugify(spark, folder):
    return table(spark, folder, "pages").select("page_id", texts.slugify(F.col("url")).alias("slug"))


SERIAL = "CASE o_orderkey % 20 WHEN 0 THEN 'bad' WHEN 1 THEN 'CF' || substr('{c}', CAST(o_orderkey % 30 + 1 AS INTEGER), 1) || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') ELSE chr(CAST(65 + o_orderkey % 4 AS INTEGER)) || substr('{c}', CAST(o_orderkey % 30 + 1 AS INTEGER), 1) || lpad(CAST(o_custkey % 56 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END".replace("{c}", serials.YEAR_CODES)
#: Serials made of orders' keys, and their parts.
SERIALS_SQL = rf"""serials AS (SELECT o_orderkey, o_custkey, {SERIAL} AS serial FROM orders),
a AS (SELECT *, '^([A-Z])([0-9A-Z])([0-9]{{2}})([0-9X]{{1,6}})$' AS p1, '^([A-Z]{{2}})([0-9A-Z])([0-9]{{2}})([0-9X]{{1,6}})$' AS p2 FROM serials),
b AS (SELECT *, try_cast(regexp_extract(serial, p1, 3) AS INTEGER) BETWEEN 1 AND 53 AS one, try_cast(regexp_extract(serial, p2, 3) AS INTEGER) BETWEEN 1 AND 53 AS two FROM a),
parsed AS (SELECT o_orderkey, o_custkey, serial, CASE WHEN one THEN regexp_extract(serial, p1, 1) WHEN two THEN regexp_extract(serial, p2, 1) END AS division, CASE WHEN one THEN regexp_extract(serial, p1, 2) WHEN two THEN regexp_extract(serial, p2, 2) END AS year_code,
  CASE WHEN one THEN CAST(regexp_extract(serial, p1, 3) AS INTEGER) WHEN two THEN CAST(regexp_extract(serial, p2, 3) AS INTEGER) END AS week, CASE WHEN one THEN regexp_extract(serial, p1, 4) WHEN two THEN regexp_extract(serial, p2, 4) END AS sequence FROM b)"""


def order_serials(spark, folder):
    o, c = table(spark, folder, "orders"), F.lit(serials.YEAR_CODES)
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    year = F.substr(c, (k % 30 + 1).cast("int"), F.lit(1))
    two = F.concat(F.lit("CF"), year, F.lpad((n % 60).cast("string"), 2, "0"), F.lpad((k % 100000).cast("string"), 5, "0"))
    one = F.concat(F.char((k % 4 + 65).cast("int")), year, F.lpad((n % 56).cast("string"), 2, "0"), F.lpad((k % 10000).cast("string"), 4, "0"))
    o = o.select(k, n, F.when(k % 20 == 0, "bad").when(k % 20 == 1, two).otherwise(one).alias("serial"))
    return o.withColumn("parts", serials.serial_parts(F.col("serial")))


@plan("serial_parse", sql("SELECT o_orderkey, serial, division, year_code, coalesce(week, -1) AS week, sequence FROM parsed", SERIALS_SQL))
def serial_parse(spark, folder):
    return order_serials(spark, folder).select("o_orderkey", "serial", "parts.*").withColumn("week", F.coalesce("week", F.lit(-1)))


YEARS_SQL = f"list_filter(generate_series(1990 + strpos('{serials.YEAR_CODES}', year_code) - 1, 2049, 30), lambda y: y >= 1990 + o_custkey % 40)"


@plan("serial_resolve_year", sql(f"SELECT o_orderkey, CAST(coalesce(list_min({YEARS_SQL}), list_max(generate_series(1990 + strpos('{serials.YEAR_CODES}', year_code) - 1, 2049, 30))) AS INTEGER) AS year FROM parsed WHERE division IS NOT NULL", SERIALS_SQL))
def serial_resolve_year(spark, folder):
    s = order_serials(spark, folder).where("parts is not null")
    return s.select("o_orderkey", serials.resolve_year(F.col("parts")["year_code"], F.lit(1990) + F.col("o_custkey") % 40).cast("int").alias("year"))


@plan("serial_in_range", sql(f"""SELECT o_orderkey, division = 'C' AND (year, week, seq) >= (2020, 10, 0) AND (year, week, seq) <= (2020, 27, 9999) AS inside FROM (
SELECT o_orderkey, division, week, CAST(replace(sequence, 'X', '0') AS INTEGER) AS seq, coalesce(list_min(list_filter(generate_series(1990 + strpos('{serials.YEAR_CODES}', year_code) - 1, 2049, 30), lambda y: y >= 2018)), list_max(generate_series(1990 + strpos('{serials.YEAR_CODES}', year_code) - 1, 2049, 30))) AS year FROM parsed WHERE division IS NOT NULL)""", SERIALS_SQL))
def serial_in_range(spark, folder):
    s = order_serials(spark, folder).where("parts is not null")
    low, high = serials.serial_parts(F.lit("CX10xxxx")), serials.serial_parts(F.lit("CX27xxxx"))
    return s.select("o_orderkey", serials.serial_in_range(F.col("parts"), low, high, F.lit(2018)).alias("inside"))


@plan("year_code_for", f"SELECT DISTINCT year(o_orderdate) AS year, substr('{serials.YEAR_CODES}', CAST((year(o_orderdate) - 1990) % 30 + 1 AS INTEGER), 1) AS code FROM orders WHERE year(o_orderdate) >= 1990")
def year_code_for(spark, folder):
    return table(spark, folder, "orders").select(F.year("o_orderdate").cast("long").alias("year")).where("year >= 1990").distinct().withColumn("code", serials.year_code(F.col("year")))


@plan("years_for_code", sql(f"SELECT o_orderkey, array_to_string(generate_series(1990 + strpos('{serials.YEAR_CODES}', year_code) - 1, 2049, 30), ',') AS years FROM parsed WHERE division IS NOT NULL", SERIALS_SQL))
def years_for_code(spark, folder):
    s = order_serials(spark, folder).where("parts is not null")
    return s.select("o_orderkey", F.array_join(serials.years_for_code(F.col("parts")["year_code"]).cast("array<string>"), ",").alias("years"))


@plan("model_matches", """SELECT p_partkey, pattern, model, CASE WHEN regexp_full_match(pattern, '[0-9A-Z]+\\*?') THEN CASE WHEN pattern LIKE '%*' THEN CAST(starts_with(model, rtrim(pattern, '*')) AS VARCHAR) ELSE CAST(pattern = model AS VARCHAR) END ELSE 'malformed' END AS matches
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'WFW' || p_size || '*' WHEN 1 THEN 'WFW' || p_size || 'HW' || p_partkey % 10 ELSE 'W-' || p_size END AS pattern, 'WFW' || p_size || 'HW' || p_partkey % 7 AS model FROM part)""")
def model_matches(spark, folder):
    k, n = F.col("p_partkey"), F.col("p_size")
    pattern = F.when(k % 3 == 0, F.concat(F.lit("WFW"), n, F.lit("*"))).when(k % 3 == 1, F.concat(F.lit("WFW"), n, F.lit("HW"), k % 10)).otherwise(F.concat(F.lit("W-"), n))
    p = table(spark, folder, "part").select("p_partkey", pattern.alias("pattern"), F.concat(F.lit("WFW"), n, F.lit("HW"), k % 7).alias("model"))
    return p.withColumn("matches", F.coalesce(serials.model_matches(F.col("pattern"), F.col("model")).cast("string"), F.lit("malformed")))


@plan("base_model", """SELECT p_partkey, regexp_replace(m, '[0-9]$', '') AS base_model, nullif(regexp_extract(m, '([0-9])$', 1), '') AS engineering_digit FROM (SELECT p_partkey, upper(trim(CASE p_partkey % 2 WHEN 0 THEN ' wfw' || p_size || 'hw' || p_partkey % 10 ELSE p_brand || 'W' END)) AS m FROM part)""")
def base_model(spark, folder):
    k = F.col("p_partkey")
    m = F.when(k % 2 == 0, F.concat(F.lit(" wfw"), "p_size", F.lit("hw"), k % 10)).otherwise(F.concat("p_brand", F.lit("W")))
    return table(spark, folder, "part").select("p_partkey", serials.base_model(m).alias("base_model"), serials.engineering_digit(m).alias("engineering_digit"))


@plan("redact", sql(r"SELECT query_id, regexp_replace(ask || ' serial ' || coalesce(serial, 'none') || ' ok', '\b[A-Z]{1,2}[0-9A-Z][0-9]{2}[0-9]{4,6}\b', '[SERIAL]', 'g') AS redacted FROM asks", ASKS_SQL))
def redact(spark, folder):
    line = F.concat("ask", F.lit(" serial "), F.coalesce("serial", F.lit("none")), F.lit(" ok"))
    return asks(spark).select("query_id", texts.redact(line).alias("redacted"))


@plan("trace_fingerprint", r"SELECT event_id, event_type || '|' || lower(trim(regexp_replace('Why  ' || props || '  ' || event_type, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS fingerprint FROM events")
def trace_fingerprint(spark, folder):
    return table(spark, folder, "events").select("event_id", texts.trace_fingerprint(F.col("event_type"), F.concat(F.lit("Why  "), "props", F.lit("  "), "event_type")).alias("fingerprint"))
