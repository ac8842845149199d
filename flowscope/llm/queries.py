"""The registered queries of the operators, over their whole tables, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm import entropy, fertility, grades, minmax, mixing, phrases, prefixes, quotes, repair, repeats, sharding, simhash, tokens
from flowscope.llm.scale import ID_ROWS, checked_broadcast

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document: 0 toxic, 1 of low quality, 2 good; selected are the probably good ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    model = grades.train(docs, labels.select("doc_id", grade.alias("grade")), 3)
    scored = grades.graded(docs, model, tail=2)
    return scored.select(
        F.col("id").alias("doc_id"), F.round("expected_grade", 6).alias("expected_grade"),
        F.round("tail_probability", 6).alias("tail_probability"), "selected")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; texts of more than 65,536 characters are spliced from chunks."""
    counted = tokens.token_counts(table(spark, sf_dir, "documents"))
    return counted.withColumnRenamed("id", "doc_id")


def quoting(messages: DataFrame) -> DataFrame:
    """Messages as in a mail exchange, in three styles which change with conversation and turn.

    In the first a message quotes the one before it whole, and in that the one before; in the second it leaves out the
    first line of the one before; in the third it stands between that line and the others. Messages of one line are
    always quoted whole.
    """

    def marked(text, mark: str):
        return F.regexp_replace(F.concat(F.lit(mark), text), "\n", f"\n{mark}")

    def earlier(n: int, name: str) -> DataFrame:
        text = F.coalesce("text", F.lit("")).alias(name)
        return messages.select("conv_id", (F.col("turn") + n).alias("turn"), text)

    joined = messages.join(earlier(1, "one"), ["conv_id", "turn"], "left").join(earlier(2, "two"), ["conv_id", "turn"], "left")
    one, two = F.concat(marked(F.col("one"), "> "), F.lit("\n")), F.concat(marked(F.col("two"), ">> "), F.lit("\n"))
    whole = F.when(F.col("one").isNull(), "").when(F.col("two").isNull(), one).otherwise(F.concat(two, one))
    own = F.coalesce("text", F.lit(""))
    lines = F.split("one", "\n", -1)
    first = marked(F.element_at(lines, 1), "> ")
    others = marked(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"), "> ")
    style = F.when(F.size(lines) > 1, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))).otherwise(0)
    mail = F.when(style == 1, F.concat(others, F.lit("\n"), own)).when(
        style == 2, F.concat(first, F.lit("\n"), own, F.lit("\n"), others)).otherwise(F.concat(whole, own))
    return joined.select("conv_id", "turn", "role", mail.alias("text"))


OP3_SQL = """WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, string_split(text, '\n') AS raw,
    trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS norm,
    list_filter(list_transform(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\n'),
      lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines
  FROM conversations
), first_of AS (
  SELECT conv_id, norm, min(turn) AS turn FROM m WHERE norm <> '' GROUP BY conv_id, norm
), q AS (
  SELECT m.conv_id, m.turn, m.text, a.turn AS one, b.turn AS two,
    CASE WHEN len(a.raw) > 1 THEN (m.conv_id + m.turn) % 3 ELSE 0 END AS style, a.norm AS whole,
    array_to_string(list_filter(list_transform(a.raw[2:], lambda x: trim(regexp_replace(
      translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\f\v]+', ' ', 'g'), ' ')), lambda x: x <> ''), '\n') AS cut
  FROM m LEFT JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1
  LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2 AND a.turn IS NOT NULL
), asked AS (
  SELECT *, CASE WHEN one IS NULL THEN NULL WHEN style = 0 THEN whole ELSE replace(cut, '\n', ' ') END AS norm FROM q
), inside AS (
  SELECT asked.conv_id, asked.turn, f.turn AS parent FROM asked JOIN first_of f USING (conv_id, norm) WHERE f.turn < asked.turn
), outside AS (
  SELECT asked.conv_id, asked.turn, arg_min(f.conv_id, (f.conv_id, f.turn)) AS parent_conv, min((f.conv_id, f.turn))[2] AS parent
  FROM asked JOIN first_of f ON f.norm = asked.norm AND f.conv_id <> asked.conv_id GROUP BY ALL
), stretch AS (
  SELECT asked.conv_id, asked.turn, min(m.turn) AS parent FROM asked JOIN m ON m.conv_id = asked.conv_id AND m.turn < asked.turn
    AND asked.style > 0 AND contains('\n' || array_to_string(m.lines, '\n') || '\n', '\n' || asked.cut || '\n') GROUP BY ALL
), linked AS (
  SELECT asked.*, CASE WHEN i.parent IS NOT NULL THEN asked.conv_id WHEN o.parent IS NOT NULL THEN o.parent_conv
      WHEN s.parent IS NOT NULL THEN asked.conv_id END AS parent_conv, coalesce(i.parent, o.parent, s.parent) AS parent
  FROM asked LEFT JOIN inside i USING (conv_id, turn) LEFT JOIN outside o USING (conv_id, turn) LEFT JOIN stretch s USING (conv_id, turn)
), t AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM linked WHERE parent_conv IS DISTINCT FROM conv_id
  UNION ALL
  SELECT q.conv_id, q.turn, t.root, t.depth + 1 FROM linked q JOIN t ON t.conv_id = q.conv_id AND t.turn = q.parent AND q.parent_conv = q.conv_id
)
SELECT q.conv_id, q.turn, parent_conv, parent AS parent_turn, t.root, t.depth,
  (CASE WHEN style > 0 THEN style ELSE (one IS NOT NULL)::INTEGER + (two IS NOT NULL)::INTEGER END)::INTEGER AS n_quotes,
  (CASE WHEN style > 0 THEN 1 ELSE (one IS NOT NULL)::INTEGER + (two IS NOT NULL)::INTEGER END)::INTEGER AS max_level, md5(q.text) AS own_md5
FROM linked q JOIN t ON t.conv_id = q.conv_id AND t.turn = q.turn"""


@query(OP3_SQL)
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply order of all conversations, sent as messages which quote earlier ones whole, trimmed or in two parts."""
    ordered = quotes.reply_order(quoting(table(spark, sf_dir, "conversations")))
    return ordered.select(
        F.col("conv").alias("conv_id"), "turn", "parent_conv", "parent_turn", "root", "depth", "n_quotes", "max_level",
        F.md5(F.col("own_text").cast("binary")).alias("own_md5"))


OP4_SQL = """WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS phrase, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), m AS (
  SELECT dw.doc_id, i, dw.size, item_id FROM dw JOIN bw ON bw.phrase = dw.phrase AND bw.size = dw.size
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN held ON held.doc_id = d.doc_id"""


@query(OP4_SQL)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside an occurrence of a benchmark window, and the items they belong to."""
    found = phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints which differ in three bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def _round_of_bisection(i: int) -> str:
    return f"""r{i + 1} AS (
  SELECT low + greatest(0.0::DOUBLE, best - 1.0::DOUBLE / 16) * (high - low) AS low, low + best * (high - low) AS high FROM (
    SELECT any_value(low) AS low, any_value(high) AS high, min(g) AS best FROM (
      SELECT low, high, n / 16::DOUBLE AS g, low + n / 16::DOUBLE * (high - low) AS a, least, most
      FROM r{i}, (SELECT min(tokens / total) AS least, max(tokens / total) AS most FROM p), unnest(range(0, 17)) AS u(n))
    WHERE pow(least, a - 1.0::DOUBLE) / pow(most, a - 1.0::DOUBLE) <= 2.0)
)"""


OP6_SQL = (
    """WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
    substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 16) AS h FROM documents
), p AS (
  SELECT source, tokens, sum(tokens) OVER () AS total, max(tokens) OVER () AS most, greatest(1, ceil(tokens / 1048576.0))::BIGINT AS n_blocks
  FROM (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source)
), r0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high),
"""
    + ",\n".join(_round_of_bisection(i) for i in range(6))
    + """, q AS (
  SELECT *, quota // tokens AS passes, quota - quota // tokens * tokens AS rest FROM (
    SELECT p.*, floor(tokens * pow(tokens / most, high - 1.0::DOUBLE))::BIGINT AS quota FROM p, r6)
), placed AS (
  SELECT d.*, q.passes, q.rest, q.quota, q.tokens AS everything, ('0x' || substr(h, 1, 8))::BIGINT % n_blocks AS block FROM d JOIN q USING (source)
), turns AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT *, substr(md5(source || ':' || block || ':' || pass || ':7'), 1, 16) AS o
    FROM (SELECT source, block, passes, rest, quota, everything, sum(tokens) AS tokens, unnest(range(0, passes + 1)) AS pass
      FROM placed GROUP BY source, block, passes, rest, quota, everything))
), copies AS (
  SELECT placed.doc_id, placed.source, placed.block, t.pass, t.start, t.rest, t.quota, t.everything, placed.tokens,
    t.pass < t.passes OR (t.rest > 0 AND t.start + t.tokens <= t.rest) AS whole, substr(md5(h || ':' || t.pass), 1, 16) AS turn
  FROM placed JOIN turns t ON t.source = placed.source AND t.block = placed.block
  WHERE t.pass < t.passes OR t.start < t.rest
), taken AS (
  SELECT * FROM copies WHERE whole
  UNION ALL BY NAME
  SELECT * EXCLUDE (used) FROM (SELECT *, sum(tokens) OVER (PARTITION BY source, pass ORDER BY turn) AS used FROM copies WHERE NOT whole)
  WHERE used <= rest - start
)
SELECT doc_id, source, pass::BIGINT AS pass, block::BIGINT AS block, round((pass * everything + start) / greatest(quota, 1), 6) AS progress FROM taken"""
)


@query(OP6_SQL)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mix of the sources in which none is passed over more than twice and no document is lost."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.Mix(docs).realise(docs, carry=["doc_id", "source"])
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "pass", "block", F.round("progress", 6).alias("progress"))


@query()
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every document under a model of the good documents, minus that under a model of the corpus."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = labels.filter("quality = 1 and toxic = 0").select("doc_id", F.lit(True).alias("good")).distinct()
    marked = docs.select("doc_id", "text").join(checked_broadcast(good, good.count(), ID_ROWS), "doc_id", "left")
    scored = entropy.cross_entropy_difference(marked, F.col("good"), background="all")
    return scored.select(
        F.col("id").alias("doc_id"), "n_words", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "difference")])


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, measures of tokeniser fertility and the verdict of every document."""
    judged = fertility.judged(table(spark, sf_dir, "documents"), carry=["doc_id", "lang"])
    m = "fertility"
    return judged.select(
        "doc_id", f"{m}.n_words", f"{m}.word_chars", f"{m}.n_symbols", f"{m}.n_dup_lines", f"{m}.n_repeat_words",
        "base_failed", "kept",
        *[F.round(f"{m}.{c}", 6).alias(c) for c in ("chars_per_token_a", "chars_per_token_b", "byte_share", "entropy")],
    )


OP9_SQL = """WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS k FROM documents
), up AS (
  SELECT depth, k >> (32 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM (SELECT *, unnest(range(0, 33))::INTEGER AS depth FROM d) GROUP BY ALL
), leaf AS (
  SELECT d.doc_id, min({'depth': depth, 'prefix': prefix, 'shard_bytes': shard_bytes, 'shard_rows': shard_rows}) AS l
  FROM d JOIN up ON up.prefix = d.k >> (32 - up.depth) WHERE shard_bytes <= 67108864 OR shard_rows = 1 GROUP BY d.doc_id
)
SELECT d.doc_id, n_bytes, 'p' || CASE WHEN l.depth = 0 THEN '' ELSE right(lpad(bin(l.prefix), 64, '0'), l.depth) END AS shard,
  l.depth AS depth, l.shard_bytes AS shard_bytes, l.shard_rows AS shard_rows, l.shard_bytes > 67108864 AS oversize
FROM d JOIN leaf ON leaf.doc_id = d.doc_id"""


@query(OP9_SQL)
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, with at most 64 MiB of text each."""
    return sharding.shards(table(spark, sf_dir, "documents"), carry=["doc_id"])


OP10_SQL = """WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), low AS (
  SELECT p, min(doc_id) AS first_doc FROM win GROUP BY p
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN low USING (p) WHERE first_doc < doc_id
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d
), kept AS (
  SELECT placed.doc_id, string_agg(word, ' ' ORDER BY placed.k) AS t, count(*) AS n
  FROM placed LEFT JOIN gone ON gone.doc_id = placed.doc_id AND gone.k = placed.k WHERE gone.k IS NULL GROUP BY placed.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


@query(OP10_SQL)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left without 13-word windows of earlier documents."""
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"), with_texts=False)
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


CRC_SQL = """bits AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text, given ``tab``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), "
            "4294967295::BIGINT)")


OP11_SQL = f"""WITH RECURSIVE {CRC_SQL}, t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, list({{'k': md5(strlen(r) || ':' || r || x), 'w': len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))}}
    ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS p FROM t GROUP BY c
), h AS (SELECT c, {_crc32("c::VARCHAR")} % 4 AS h FROM o, crc), b AS (
  SELECT o.c, list_concat(coalesce(s.p[1 : h], []), o.p[h + 1 :]) AS p FROM o JOIN h ON h.c = o.c LEFT JOIN o s ON s.c = o.c - o.c % 20
), m AS (
  SELECT c, len(p) AS n, d, CASE WHEN d = 0 THEN '' ELSE list_aggregate(list_transform(p[1 : d], lambda e: e.k), 'string_agg', ',') END AS node,
    CASE WHEN d = 0 THEN '' ELSE p[d].k END AS k, CASE WHEN d = 0 THEN 0 ELSE p[d].w END AS w FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM b)
), g AS (
  SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends,
    left(node, greatest(d - 1, 0) * 33 - (d > 1)::INTEGER) AS up FROM m GROUP BY d, node
), kids AS (SELECT d - 1 AS d, up, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2), below AS (
  SELECT a.d, a.node, sum((u.n_convs - 1) * u.w) AS saved, count(*) FILTER (u.n_convs = u.n_ends) AS leaves
  FROM (SELECT g.*, (SELECT count(*) FROM m WHERE m.node = g.node AND m.d = g.d AND m.n = m.d) AS n_ends FROM g) u
  JOIN m path ON path.c = u.conv_id AND path.d <= u.d JOIN g a ON a.node = path.node AND a.d = path.d GROUP BY 1, 2
)
SELECT g.conv_id, g.d::BIGINT AS depth, up.conv_id AS parent_conv_id, g.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN below ON below.d = g.d AND below.node = g.node LEFT JOIN g up ON up.d = g.d - 1 AND up.node = g.up
LEFT JOIN kids ON kids.d = g.d AND kids.up = g.node"""


@query(OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt on common openings."""
    rows, convs = prefixes.placed(table(spark, sf_dir, "conversations"))
    nodes = prefixes.with_ends(*prefixes.prefix_trie(*prefixes.branched(rows, convs)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = f"""WITH RECURSIVE {CRC_SQL}, k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), copy) AS i FROM d
), f AS (
  SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'ok' END AS fault FROM o
), ins(f, t, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)
), act(letter, r, f, t, price) AS (
  SELECT 'D', NULL::VARCHAR, f, f, 4 FROM (SELECT unnest(range(0, 4)) AS f)
  UNION ALL VALUES ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
    ('R', NULL, 0, 2, 3), ('R', NULL, 1, 2, 3), ('R', NULL, 3, 2, 3), ('R', NULL, 2, 3, 3)
), dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM conversations
  UNION ALL
  SELECT f.conv_id, f.i, act.t, min({{'cost': best.cost + 3 * ins.n + price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
    'audit': best.audit || repeat('I', ins.n) || letter}})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.f = state
  JOIN act ON act.f = ins.t AND (act.r IS NULL OR act.r = f.r) AND (letter = 'D' OR fault IN ('ok', 'truncated')) GROUP BY f.conv_id, f.i, act.t
), tally AS (
  SELECT c.conv_id, count(f.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY 1
), final AS (
  SELECT tally.*, (SELECT min({{'cost': best.cost + 3 * ins.n, 'audit': best.audit || repeat('I', ins.n)}}) FROM dp JOIN ins ON ins.f = state
    WHERE dp.conv_id IS NOT DISTINCT FROM tally.conv_id AND dp.i = tally.n AND ins.t IN (0, 3)) AS best FROM tally
), letters AS (
  SELECT conv_id, substr(audit, j, 1) AS letter, len(replace(substr(audit, 1, j), 'I', '')) AS i, len(replace(substr(audit, 1, j), 'D', '')) AS p
  FROM (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS j FROM final)
), lines AS (
  SELECT l.conv_id, l.letter, l.p, f.role, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text,
    max(CASE WHEN letter = 'K' AND p = 1 AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM letters l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE letter <> 'D'
), joined AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text
  FROM lines GROUP BY 1
)
SELECT final.conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal,
  best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(joined.text, '')) AS repaired_sha256
FROM final LEFT JOIN joined ON joined.conv_id IS NOT DISTINCT FROM final.conv_id"""


@query(OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all conversations after damage, and their cheapest repair."""
    return repair.repaired_digests(repair.damaged(table(spark, sf_dir, "conversations")))


OP13_SQL = """WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), link AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * common >= 80 * (nu.n + nv.n - common)
), reach AS (
  SELECT doc_id, doc_id AS low FROM d UNION SELECT v, low FROM reach JOIN link ON u = doc_id
), c AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query(OP13_SQL)
def op13_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a similarity of 0.8 or more."""
    return minmax.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
