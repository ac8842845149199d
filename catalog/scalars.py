"""Scalar functions over addresses, timestamps, URLs and whole page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORACLES, query, with_parts
from flowscope.functions import net as N
from flowscope.functions import patterns as P
from flowscope.functions import text as X
from flowscope.operators.patterns import pattern_hits

TOKEN_SQL = P.ATTACK_TOKEN.replace("'", "''")
WORDS_SQL = "|".join(P.SUSPICIOUS_WORDS)
WORD_LIST_SQL = ", ".join(f"'{w}'" for w in P.SUSPICIOUS_WORDS)
TRAVERSAL_SQL = " OR ".join(f"contains(params, '{w}')" for w in P.TRAVERSAL_WORDS)
TRAVERSAL_LIST_SQL = ", ".join(f"'{w}'" for w in P.TRAVERSAL_WORDS)
IP_TO_INT = "(split_part({0}, '.', 1)::BIGINT * 16777216 + split_part({0}, '.', 2)::BIGINT * 65536 + split_part({0}, '.', 3)::BIGINT * 256 + split_part({0}, '.', 4)::BIGINT)"


@query("ipv4_to_int", "H1", with_parts("FLOWS", f"""
SELECT seq, {IP_TO_INT.format('src_ip')} AS src_int, {IP_TO_INT.format('dest_ip')} AS dest_int FROM flows"""))
def _(t):
    return t.flows.select("seq", N.ipv4_to_long("src_ip").alias("src_int"), N.ipv4_to_long("dest_ip").alias("dest_int"))


@query("int_to_ipv4", "H2", """
SELECT l_orderkey, l_linenumber, (n // 16777216)::VARCHAR || '.' || (n // 65536 % 256)::VARCHAR || '.'
  || (n // 256 % 256)::VARCHAR || '.' || (n % 256)::VARCHAR AS ip
FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 104729 + l_partkey * 7919) % 4294967296 AS n FROM lineitem)""")
def _(t):
    n = (F.col("l_orderkey").cast("bigint") * 104729 + F.col("l_partkey") * 7919) % F.lit(4294967296)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", N.long_to_ipv4(n).alias("ip"))


@query("address_class", "H3", """
SELECT l_orderkey, l_linenumber, CASE WHEN n > 16777217 AND n <= 2130706432 THEN 1
  WHEN n > 2130706432 AND n <= 3221225214 THEN 2 WHEN n > 3221225729 AND n <= 3758096126 THEN 3
  WHEN n > 3758096385 AND n <= 4026531838 THEN 4 ELSE 0 END AS class
FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 104729 + l_partkey * 7919) * 6151 % 4294967296 AS n FROM lineitem)""")
def _(t):
    n = (F.col("l_orderkey").cast("bigint") * 104729 + F.col("l_partkey") * 7919) * 6151 % F.lit(4294967296)
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", N.address_class(N.long_to_ipv4(n)).alias("class")
    )


@query("ipv4_validity", "B4", with_parts("FLOWS", """
SELECT seq, regexp_full_match(host, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') AS is_ipv4
FROM flows"""))
def _(t):
    from flowscope.operators.clean import require_ipv4

    return require_ipv4(t.flows, "host", "flag").select("seq", "is_ipv4")


@query("flow_timestamp", "H4", with_parts("FLOWS", """
SELECT seq, epoch_us(strptime(timestamp, '%m/%d/%y-%H:%M:%S.%f')) // 1000000 AS second,
  epoch_us(strptime(timestamp, '%m/%d/%y-%H:%M:%S.%f')) AS micros FROM flows"""))
def _(t):
    return t.flows.select("seq", N.epoch_second("timestamp").alias("second"), N.epoch_micros("timestamp").alias("micros"))


@query("percent_decode", "H5", with_parts("FLOWS", """
SELECT seq, url_decode(params) AS decoded FROM flows"""))
def _(t):
    return t.flows.select("seq", X.percent_decode("params").alias("decoded"))


@query("query_string", "H6", with_parts("FLOWS", """
SELECT seq, CASE WHEN contains(params, '?') THEN replace(params[instr(params, '?') + 1:], '?', '') ELSE '' END AS query
FROM flows"""))
def _(t):
    return t.flows.select("seq", X.query_string("params").alias("query"))


@query("expand_base64_calls", "H7", """
SELECT page_id, 'a=base64_decode(' || url || ')&b=base64_decode(' || CASE WHEN length(page_id::VARCHAR) % 4 = 1
  THEN page_id::VARCHAR ELSE 'k' || page_id::VARCHAR END || ')' AS text FROM pages""")
def _(t):
    """Payloads are encoded first, so expanding must give back the URLs; the second call holds plain text."""
    bare = F.rtrim(F.base64(F.encode("url", "utf-8")), F.lit("="))
    number = F.col("page_id").cast("string")
    second = F.when(F.length(number) % 4 == 1, number).otherwise(
        F.base64(F.encode(F.concat(F.lit("k"), number), "utf-8"))
    )
    text = F.concat(F.lit("a=base64_decode("), bare, F.lit(")&b=base64_decode("), second, F.lit(")"))
    return t.read("pages").select("page_id", X.expand_base64_calls(text).alias("text"))


@query("strip_cjk", "H8", "SELECT page_id, regexp_replace(html || '路径', '[一-龥]+', '', 'g') AS text FROM pages")
def _(t):
    return t.read("pages").select("page_id", X.strip_cjk(F.concat("html", F.lit("路径"))).alias("text"))


@query("collapse_digits", "H9", "SELECT page_id, regexp_replace(html, '\\p{Nd}+', '0', 'g') AS text FROM pages")
def _(t):
    return t.read("pages").select("page_id", X.collapse_digits("html").alias("text"))


@query("collapse_embedded_url", "H10", """
SELECT page_id, regexp_replace('go=' || url || ' ' || html, 'https?://[a-zA-Z0-9.@&#!?]+', 'http://u', 'g') AS text FROM pages""")
def _(t):
    text = F.concat(F.lit("go="), "url", F.lit(" "), "html")
    return t.read("pages").select("page_id", X.collapse_embedded_url(text).alias("text"))


@query("lower_and_trim", "H11", """
SELECT page_id, lower(html) AS lowered, h AS host FROM (
  SELECT page_id, html, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages)""")
def _(t):
    host = F.concat(F.lit(" "), F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit(" \r\n"))
    wrapped = F.concat(F.lit("\n"), "html", F.lit("\n\n"))
    return t.read("pages").select("page_id", X.lower_trimmed(wrapped).alias("lowered"), X.trim_host(host).alias("host"))


NORMAL_SQL = """lower(regexp_replace(regexp_replace(regexp_replace(url_decode({0}), '[一-龥]+', '', 'g'),
  '\\p{{Nd}}+', '0', 'g'), 'https?://[a-zA-Z0-9.@&#!?]+', 'http://u', 'g'))"""
QUERY_SQL = "CASE WHEN contains({0}, '?') THEN replace({0}[instr({0}, '?') + 1:], '?', '') ELSE '' END"


@query("normalise_url", "H12", with_parts("FLOWS", f"""
SELECT seq, {NORMAL_SQL.format('params')} AS whole, {NORMAL_SQL.format('(' + QUERY_SQL.format('params') + ')')} AS query
FROM flows"""))
def _(t):
    return t.flows.select("seq", X.normalise_url("params").alias("whole"), X.normalise_query("params").alias("query"))


@query("char_bigrams", "H13", """
SELECT page_id, [substr(url, i, 2) for i in range(1, length(url) - 1)] AS grams,
  md5(array_to_string([substr(html, i, 2) for i in range(1, length(html) - 1)], chr(9))) AS html_grams FROM pages""")
def _(t):
    return t.read("pages").select(
        "page_id", X.char_ngrams("url").alias("grams"),
        F.md5(F.array_join(X.char_ngrams("html"), "\t").cast("binary")).alias("html_grams"),
    )


@query("attack_tokens", "H14", f"SELECT page_id, regexp_extract_all(html, '{TOKEN_SQL}') AS tokens FROM pages")
def _(t):
    return t.read("pages").select("page_id", X.attack_tokens("html").alias("tokens"))


@query("word_ngrams", "H15", f"""
SELECT page_id, tokens || [tokens[i] || ' ' || tokens[i + 1] for i in range(1, len(tokens))] AS grams
FROM (SELECT page_id, regexp_extract_all(html, '{TOKEN_SQL}') AS tokens FROM pages)""")
def _(t):
    return t.read("pages").select("page_id", X.attack_tokens("html").alias("tok")).select(
        "page_id", X.word_ngrams("tok").alias("grams")
    )


@query("url_statistics", "H16 H17 H18 H19 H21", f"""
SELECT page_id, length(text) AS n_chars, regexp_matches(text, '(?i)https?://')::INTEGER AS has_url,
  len(regexp_extract_all(text, '[<>,/]')) AS evil_chars, len(regexp_extract_all(text, '(?i){WORDS_SQL}')) AS evil_words,
  (text[-1:] = '/')::INTEGER AS ends_slash
FROM (SELECT page_id, html || url AS text FROM pages)""")
def _(t):
    text = F.concat("html", "url")
    return t.read("pages").select(
        "page_id", F.length(text).cast("bigint").alias("n_chars"), X.has_embedded_url(text).alias("has_url"),
        X.suspicious_char_count(text).cast("bigint").alias("evil_chars"),
        X.suspicious_word_count(text).cast("bigint").alias("evil_words"), X.ends_with_slash(text).alias("ends_slash"),
    )


@query("suspicious_word_vector", "H20", f"""
SELECT page_id, [((length(html) - length(replace(html, w, ''))) // length(w))::INTEGER for w in [{WORD_LIST_SQL}]] AS counts
FROM pages""")
def _(t):
    return t.read("pages").select("page_id", X.suspicious_word_vector("html").alias("counts"))


ENTROPY_SQL = """SELECT {0}, round(entropy(ch), 6) AS entropy FROM (
  SELECT {0}, unnest(regexp_extract_all({1}, '(?s).')) AS ch FROM {2}) GROUP BY {0}"""


@query("char_entropy", "H22", ENTROPY_SQL.format("page_id", "html", "pages"))
def _(t):
    return t.read("pages").select("page_id", X.char_entropy("html").alias("entropy"))


@query("statistic_vector", "H23", f"""
WITH ent AS ({ENTROPY_SQL.format('page_id', 'url', 'pages')})
SELECT page_id, [len(regexp_extract_all(url, '(?i){WORDS_SQL}'))::DOUBLE, (url[-1:] = '/')::DOUBLE, entropy] AS features
FROM pages JOIN ent USING (page_id)""")
def _(t):
    return t.read("pages").select("page_id", X.statistic_vector("url").alias("features"))


@query("edit_distance", "H24", with_parts("FLOWS", "SELECT seq, levenshtein(params, host)::INTEGER AS distance FROM flows"))
def _(t):
    return t.flows.select("seq", F.levenshtein("params", "host").alias("distance"))


@query("traversal_predicate", "B11", with_parts("FLOWS", f"""
SELECT seq, params FROM flows WHERE {TRAVERSAL_SQL}"""))
def _(t):
    return t.flows.filter(X.has_traversal("params")).select("seq", "params")


@query("pattern_positions", "B12", with_parts("FLOWS", f"""
, words AS (SELECT unnest([{TRAVERSAL_LIST_SQL}]) AS word, unnest(range(0, {len(P.TRAVERSAL_WORDS)})) AS word_index)
SELECT seq, (i + length(word) - 2)::INTEGER AS end_index, word_index::INTEGER AS word_index, word FROM (
  SELECT seq, params, word, word_index, unnest(range(1, length(params) + 1)) AS i
  FROM flows JOIN words ON contains(params, word))
WHERE substr(params, i, length(word)) = word"""))
def _(t):
    hits = t.flows.filter(X.has_traversal("params")).select("seq", F.explode(X.word_hits("params")).alias("h"))
    return hits.select("seq", "h.end_index", "h.word_index", "h.word")


@query("pattern_positions_of_table", "B12", ORACLES["pattern_positions"])
def _(t):
    """The same from a table of patterns, in one pass for all of them."""
    words = t.spark.createDataFrame(list(enumerate(P.TRAVERSAL_WORDS)), "pattern int, word string")
    hits = pattern_hits(t.flows, "seq", "params", words)
    return hits.select(F.col("id").alias("seq"), "end_index", F.col("pattern").alias("word_index"), "word")


@query("pattern_positions_text", "B12", """
WITH words AS (SELECT unnest(['the', 'ththth', 'e']) AS word, unnest([0, 1, 2]) AS word_index)
SELECT doc_id, word_index::INTEGER AS word_index, count(*) AS hits, sum(i + length(word) - 2)::BIGINT AS end_sum FROM (
  SELECT doc_id, text, word, word_index, unnest(range(1, length(text) + 1)) AS i
  FROM (SELECT vec.page_id AS doc_id, vec.html AS text FROM pages vec) JOIN words ON contains(text, word))
WHERE substr(text, i, length(word)) = word GROUP BY ALL""")
def _(t):
    hits = t.read("pages").select(
        F.col("page_id").alias("doc_id"), F.explode(X.word_hits("html", ("the", "ththth", "e"))).alias("h")
    )
    return hits.groupBy("doc_id", "h.word_index").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("h.end_index").alias("end_sum")
    )


@query("host_in_url", "B13", with_parts("FLOWS", "SELECT seq, contains(params, host) AS inside FROM flows"))
def _(t):
    return t.flows.select("seq", F.contains(F.col("params"), F.col("host")).alias("inside"))
