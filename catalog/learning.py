"""TF-IDF, classifiers, web-scan detection and their evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.base import query, with_parts
from catalog.features import HOST_SQL, _webscan_sql, attack_rule
from catalog.scalars import NORMAL_SQL, QUERY_SQL, TOKEN_SQL, WORDS_SQL
from flowscope.functions.text import attack_tokens, char_ngrams, percent_decode, word_ngrams
from flowscope.operators import aggregate as A
from flowscope.operators import forest as R
from flowscope.operators import kernel as K
from flowscope.operators import learning as L
from flowscope.operators import tfidf as T
from flowscope.operators.scale import cut_lineage, scratch_path
from flowscope.plans import detection
from flowscope.plans import webscan as W
from flowscope.plans.domain import domain_features
from flowscope.sources import sinks

GRAM_SQL = f"""toks AS (SELECT page_id, regexp_extract_all(html, '{TOKEN_SQL}') AS t FROM pages),
  terms AS (SELECT page_id AS doc_id, unnest(t || [t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) AS term FROM toks),
  counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)"""


def _tfidf_sql(n_docs, limit=""):
    return f""", vocab AS (SELECT term, ln((1 + ({n_docs})) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term {limit}),
  w AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN vocab USING (term)),
  tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


BIGRAM_SQL = """gr AS (SELECT doc_id, unnest([substr(text, i, 2) for i in range(1, length(text) - 1)]) AS term
    FROM (SELECT page_id AS doc_id, lower(url_decode(url)) AS text FROM pages)),
  counts AS (SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY ALL)"""
PAGES = "SELECT count(*) FROM pages"


def token_terms():
    return word_ngrams(attack_tokens("html"))


def page_docs(t):
    return t.read("pages").withColumnRenamed("page_id", "doc_id")


def bigram_weights(t):
    return T.tfidf(page_docs(t), char_ngrams(F.lower(percent_decode("url"))))


@query("token_tfidf_top50", "J1", f"WITH {GRAM_SQL}"
       + _tfidf_sql(PAGES, "ORDER BY sum(tf) DESC, term LIMIT 50")
       + " SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def _(t):
    return T.tfidf(page_docs(t), token_terms(), max_terms=50)


@query("token_tfidf", "J1", f"WITH {GRAM_SQL}" + _tfidf_sql(PAGES) + " SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def _(t):
    return T.tfidf(page_docs(t), token_terms())


@query("bigram_tfidf", "J2", f"WITH {BIGRAM_SQL}" + _tfidf_sql(PAGES) + " SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def _(t):
    return bigram_weights(t)


@query("collapsed_term_weights", "C12", f"WITH {BIGRAM_SQL}" + _tfidf_sql(PAGES) + """
SELECT doc_id, cluster::INTEGER AS cluster, round(sum(weight), 6) AS weight FROM (
  SELECT doc_id, weight, (unicode(term[1:1]) + 31 * unicode(term[2:2])) % 80 AS cluster FROM tfidf) GROUP BY ALL""")
def _(t):
    """Collapsed with a fixed map, as a stored term-to-cluster file would give it."""
    weights = cut_lineage(bigram_weights(t))
    code = (F.ascii(F.substring("term", 1, 1)) + 31 * F.ascii(F.substring("term", 2, 1))) % 80
    return T.collapse_terms(weights, weights.select("term").distinct().withColumn("cluster", code))


@query("term_clusters", "J4 A15")
def _(t):
    """Term clusters are fitted once, stored, and read back."""
    path = scratch_path(t.spark, "term-clusters")
    return sinks.load_or_build(t.spark, path, lambda: T.term_clusters(cut_lineage(bigram_weights(t)), k=80))


CENTRE_WEIGHT = 0.05


@query("term_assignment_of_given_centres", "J4", f"WITH {BIGRAM_SQL}" + _tfidf_sql(PAGES) + f"""
, n AS (SELECT c, count(d.doc_id) * {CENTRE_WEIGHT ** 2}::DOUBLE AS n FROM (SELECT unnest(range(0, 6)) AS c) LEFT JOIN (SELECT DISTINCT doc_id FROM tfidf) d ON d.doc_id % 6 = c GROUP BY c),
  own AS (SELECT term, sum(weight * weight) AS own FROM tfidf GROUP BY term),
  dot AS (SELECT term, doc_id % 6 AS c, sum(weight) * {CENTRE_WEIGHT}::DOUBLE AS d FROM tfidf GROUP BY ALL)
SELECT term, arg_min(c, (r, c))::INTEGER AS cluster, round(greatest(min(r), 0), 6) AS distance FROM (
  SELECT own.term, n.c, round(own + n - 2 * coalesce(d, 0), 10) AS r FROM own CROSS JOIN n LEFT JOIN dot ON dot.term = own.term AND dot.c = n.c) GROUP BY term""")
def _(t):
    """One assignment step: every term at the nearest of six given centres, each over a sixth of the documents."""
    weights = cut_lineage(bigram_weights(t))
    docs = weights.select("doc_id").distinct()
    place = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.when(F.col("doc_id") % 6 == c, CENTRE_WEIGHT).otherwise(0.0))
    sizes = dict(docs.groupBy((F.col("doc_id") % 6).alias("c")).count().collect())
    return T.nearest_profile(weights, docs.withColumn("v", place), [sizes.get(c, 0) * CENTRE_WEIGHT**2 for c in range(6)])


@query("standardised_columns", "J10", """
SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value_scaled,
  round((user_id - avg(user_id) OVER ()) / stddev_pop(user_id) OVER (), 6) AS user_id_scaled FROM events""")
def _(t):
    events = t.read("events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    return L.standardise(events, ["value", "user_id"]).select("event_id", "value_scaled", "user_id_scaled")


@query("seeded_split", "J9", """
SELECT count(*) AS n, 0::BIGINT AS shared, true AS balanced, sum(event_id)::BIGINT AS ids FROM events""")
def _(t):
    """No row is lost or in both parts, and the smaller part has about a fifth."""
    train, test = (part.select("event_id", F.lit(i).alias("part")) for i, part in enumerate(L.split(t.read("events"), 0.2, "event_id")))
    per = train.unionByName(test).groupBy("event_id").agg(F.sum("part").alias("test"), F.count(F.lit(1)).alias("parts"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parts") > 1).alias("shared"),
                   F.avg("test").between(0.18, 0.22).alias("balanced"), F.sum("event_id").alias("ids"))


def labelled_documents(t):
    """Texts with their toxicity label; whole texts."""
    return t.read("documents").join(t.read("labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))


def _classified(t, kind):
    ready = cut_lineage(L.bigram_features(labelled_documents(t)).drop("text"))
    train, test = L.split(ready, 0.2, "doc_id")
    return L.fit_url_classifier(train, kind).transform(test).select("doc_id", "label", "prediction")


@query("bigram_logistic_regression", "J5 D26 J9")
def _(t):
    return A.accuracy(_classified(t, "logistic"))


@query("bigram_linear_svm", "J5 D21")
def _(t):
    return A.prediction_counts(_classified(t, "svm"))


@query("bigram_kernel_svm", "J5 D21")
def _(t):
    """SVM with an RBF kernel over the whole texts' bigrams."""
    return A.prediction_counts(_classified(t, "kernel"))


@query("linear_decision_of_given_weights", "J5", f"WITH {BIGRAM_SQL}" + _tfidf_sql(PAGES) + """
SELECT doc_id, round(sum(weight * (((unicode(term[1:1]) + 31 * unicode(term[2:2])) % 17 - 8) / 8.0::DOUBLE)) - 0.05::DOUBLE, 6) AS decision FROM tfidf GROUP BY doc_id""")
def _(t):
    """Decisions of a linear model with a weight for every bigram, as a fitted one takes them."""
    weights = cut_lineage(bigram_weights(t))
    code = (F.ascii(F.substring("term", 1, 1)) + 31 * F.ascii(F.substring("term", 2, 1))) % 17
    coefficients = weights.select("term").distinct().withColumn("coefficient", (code - 8) / F.lit(8.0))
    return K.linear_decision(weights, coefficients, "doc_id", "term", -0.05)


SUPPORT = [(i, term, 0.5) for i, terms in enumerate((("ht", "tt", "tp", ":/"), ("ex", "xa", "am", "mp"), ("/a", "/b", "=1", "og"))) for term in terms]
ALPHAS = (1.0, -0.8, 0.6)


@query("kernel_decision_of_given_support", "J5", f"WITH {BIGRAM_SQL}" + _tfidf_sql(PAGES) + f"""
, s(i, term, v) AS (VALUES {", ".join(f"({i}, '{term}', {v}::DOUBLE)" for i, term, v in SUPPORT)}), a(i, alpha) AS (VALUES {", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(ALPHAS))}),
  own AS (SELECT doc_id, sum(weight * weight) AS own FROM tfidf GROUP BY doc_id),
  dot AS (SELECT doc_id, i, sum(weight * v) AS d FROM tfidf JOIN s USING (term) GROUP BY ALL)
SELECT own.doc_id, round(sum(alpha * exp(-1.5::DOUBLE * (own + 1 - 2 * coalesce(d, 0)))) - 0.1::DOUBLE, 6) AS decision
FROM own CROSS JOIN a LEFT JOIN dot ON dot.doc_id = own.doc_id AND dot.i = a.i GROUP BY own.doc_id""")
def _(t):
    """Decisions of an RBF model with given support vectors, as exact kernels."""
    support = t.spark.createDataFrame(SUPPORT, "number int, term string, weight double")
    return K.kernel_decision(cut_lineage(bigram_weights(t)), support, list(ALPHAS), "doc_id", "term", 1.5, -0.1)


@query("cluster_collapsed_classifier", "J4 J5 C12 D26")
def _(t):
    """Bigram weights of URLs collapsed to term clusters, then logistic regression; label: a query is present."""
    weights = cut_lineage(bigram_weights(t))
    clusters = cut_lineage(T.term_clusters(weights, k=40))
    vectors = T.cluster_vectors(T.collapse_terms(weights, clusters), 40)
    labels = page_docs(t).select("doc_id", F.contains("url", F.lit("?")).cast("int").alias("label"))
    train, test = L.split(cut_lineage(vectors.join(labels, "doc_id")), 0.2, "doc_id")
    return A.accuracy(L.fit_vector_classifier(train).transform(test))


def labelled_urls(t):
    """Distinct URLs of the flows; those with an embedded script tag are attacks."""
    return t.flows.select("params").distinct().withColumn(
        "label", F.contains("params", F.lit("%3Cscript")).cast("int")
    )


def url_model(t, mode="all"):
    return detection.url_attack_model(cut_lineage(labelled_urls(t)), mode)


ATTACK = "contains(params, '%3Cscript')"
ATTACK_SQL = with_parts("FLOWS", "SELECT DISTINCT params, 1 AS label FROM flows WHERE contains(params, '%3Cscript')")

for _mode in ("all", "tfidf", "statistic"):

    @query(f"attack_classifier_{_mode}", "J3 J6 B16", ATTACK_SQL)
    def _(t, mode=_mode):
        """URLs predicted as attacks; with the tokens at hand the forest must find all of them and no other."""
        urls = cut_lineage(labelled_urls(t))
        model = detection.url_attack_model(urls, mode)
        scored = model.transform(L.attack_text(urls, "params"))
        return scored.filter("prediction <> 0").select("params", "label")


@query("malicious_url_statistics", "D10 D20", with_parts("FLOWS WEBSCAN", f"""
SELECT src_ip, dest_ip, count(*) FILTER ({ATTACK}) AS "Sum_xss", round(count(*) FILTER ({ATTACK}) / count(*), 6) AS "Feq_xss"
FROM webscan WHERE method = 'GET' GROUP BY ALL"""))
def _(t):
    statistics, _lists = detection.malicious_by(t.webscan, url_model(t), ["src_ip", "dest_ip"])
    return statistics


@query("malicious_url_lists", "D10", with_parts("FLOWS WEBSCAN", f"""
SELECT src_ip, dest_ip, 0::BIGINT AS part, list(params ORDER BY seq) AS "Malics_urls", list(n ORDER BY seq) AS "Malics_counts"
FROM (SELECT src_ip, dest_ip, params, min(seq) AS seq, count(*) AS n FROM webscan WHERE method = 'GET' AND {ATTACK} GROUP BY ALL)
GROUP BY src_ip, dest_ip"""))
def _(t):
    _statistics, lists = detection.malicious_by(t.webscan, url_model(t), ["src_ip", "dest_ip"])
    return lists


@query("prediction_buckets", "D21", with_parts("FLOWS", """
SELECT (seq % 19 = 0)::INTEGER AS prediction, (rn - 1) // 1000 AS part, list(params ORDER BY seq) AS texts
FROM (SELECT seq, params, row_number() OVER (PARTITION BY seq % 19 = 0 ORDER BY seq) AS rn FROM flows) GROUP BY 1, 2"""))
def _(t):
    scored = t.flows.select("seq", "params", (F.col("seq") % 19 == 0).cast("int").alias("prediction"))
    return A.prediction_buckets(scored, "params", "seq", list_rows=1000)


@query("prediction_share", "D20", with_parts("FLOWS", """
SELECT src_ip, round(avg((seq % 19 = 0)::INTEGER), 6) AS "P_malicious_urls" FROM flows GROUP BY src_ip"""))
def _(t):
    scored = t.flows.select("src_ip", (F.col("seq") % 19 == 0).cast("int").alias("prediction"))
    return A.prediction_share(scored, ["src_ip"])


@query("accuracy", "D26", "SELECT round(avg((quality = toxic)::INTEGER), 6) AS accuracy FROM labels")
def _(t):
    return A.accuracy(t.read("labels"), "quality", "toxic")


@query("attack_statistics", "J3 H23", with_parts("FLOWS", f"""
, u AS (SELECT params, {NORMAL_SQL.format('(' + QUERY_SQL.format('params') + ')')} AS text FROM (SELECT DISTINCT params FROM flows)),
  e AS (SELECT params, entropy(ch) AS h FROM (SELECT params, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM u) GROUP BY params)
SELECT params, [len(regexp_extract_all(text, '(?i){WORDS_SQL}'))::DOUBLE, (text[-1:] = '/')::DOUBLE, round(coalesce(h, 0), 6)] AS statistics
FROM u LEFT JOIN e USING (params)"""))
def _(t):
    """The statistics part of the attack model's input."""
    urls = t.flows.select("params").distinct()
    return L.attack_text(urls).select("params", vector_to_array("statistics").alias("statistics"))


@query("forest_holdout", "J7 D26")
def _(t):
    """Web-scan forest on 60 % of the labelled behaviour rows; accuracy on the other 40 % and their number."""
    flows = t.flows.withColumn("_odd", (F.col("seq") % 13 == 0) | (F.col("seq") % 19 == 0))
    rows = detection.labelled_behaviour(flows.filter("_odd"), flows.filter(~F.col("_odd")), url_model(t), burst_seconds=3600)
    return detection.holdout_accuracy(cut_lineage(rows), W.MODEL_COLUMNS)


def forest_and_model(t):
    flows = t.flows.withColumn("_odd", (F.col("seq") % 13 == 0) | (F.col("seq") % 19 == 0))
    model = url_model(t)
    rows = cut_lineage(
        detection.labelled_behaviour(flows.filter("_odd"), flows.filter(~F.col("_odd")), model, burst_seconds=3600)
    )
    return L.fit_webscan_forest(rows, W.MODEL_COLUMNS), model


@query("webscan_forest_detection", "J7 J8 D10 D18 F1")
def _(t):
    forest, model = forest_and_model(t)
    return detection.detect_webscans(t.flows, model, forest, t.owner, burst_seconds=3600)


def _node_sql(nodes):
    return ", ".join(f"({r[0]}, {r[1]}, {r[2]}, {r[3] or 0}::DOUBLE, {r[4]}, {r[5]}, {r[6]}::DOUBLE)" for r in nodes)


def _walk_sql(nodes, keys, values, source):
    """Recursive walk of all rows through all trees; ``source`` has the keys and the features of the model."""
    return f"""item AS (SELECT {keys}, [{values}] AS x FROM ({source})),
  n(tree, node, feature, threshold, l, r, p) AS (VALUES {_node_sql(nodes)}), walk AS (
  SELECT {keys}, x, tree, 0 AS spot FROM item, (SELECT DISTINCT tree FROM n)
  UNION ALL SELECT {keys}, x, walk.tree, CASE WHEN x[feature + 1] <= threshold THEN l ELSE r END FROM walk JOIN n ON n.tree = walk.tree AND n.node = spot WHERE feature >= 0)
SELECT {keys}, round(sum(p) / count(*), 6) AS votes, (sum(p) > sum(1 - p))::INTEGER AS web_scan
FROM walk JOIN n ON n.tree = walk.tree AND n.node = spot WHERE feature < 0 GROUP BY ALL"""


NODE_FIELDS = "tree int, node int, feature int, threshold double, left int, right int, p double"
#: A given web-scan forest over the six model columns, and a given attack forest over the three URL statistics.
SCAN_NODES = [
    (0, 0, 3, 0.05, 1, 2, 0.0), (0, 1, -1, None, -1, -1, 0.1), (0, 2, 5, 0.9, 3, 4, 0.0), (0, 3, -1, None, -1, -1, 0.8), (0, 4, -1, None, -1, -1, 0.6),
    (1, 0, 2, 0.04, 1, 2, 0.0), (1, 1, -1, None, -1, -1, 0.2), (1, 2, 4, 0.2, 3, 4, 0.0), (1, 3, -1, None, -1, -1, 0.7), (1, 4, -1, None, -1, -1, 0.9),
    (2, 0, 0, 2.0, 1, 2, 0.0), (2, 1, 1, 0.5, 3, 4, 0.0), (2, 2, -1, None, -1, -1, 0.55), (2, 3, -1, None, -1, -1, 0.3), (2, 4, -1, None, -1, -1, 0.45),
]
URL_NODES = [
    (0, 0, 0, 0.5, 1, 2, 0.0), (0, 1, -1, None, -1, -1, 0.15), (0, 2, 2, 3.9, 3, 4, 0.0), (0, 3, -1, None, -1, -1, 0.75), (0, 4, -1, None, -1, -1, 0.9),
    (1, 0, 2, 4.05, 1, 2, 0.0), (1, 1, 1, 0.5, 3, 4, 0.0), (1, 2, -1, None, -1, -1, 0.8), (1, 3, -1, None, -1, -1, 0.3), (1, 4, -1, None, -1, -1, 0.05),
]


def given_nodes(t, nodes):
    return t.spark.createDataFrame(nodes, NODE_FIELDS).collect()


@query("webscan_forest_of_given_nodes", "J7 J8 D16", "WITH RECURSIVE " + _walk_sql(
    SCAN_NODES, "src_ip, dest_ip", ", ".join(f'coalesce("{c}", 0)::DOUBLE' for c in W.MODEL_COLUMNS), _webscan_sql("source", 1)))
def _(t):
    """The web-scan table scored by a given forest, from its table of nodes."""
    from flowscope.operators.clean import clean_webscan

    flows = clean_webscan(t.flows, drop_single=False)
    malicious, _lists = detection.malicious_by_rule(flows, attack_rule(), ["src_ip", "dest_ip"])
    table = W.webscan_features(flows, t.owner, malicious)
    return R.score_with_nodes(table, given_nodes(t, SCAN_NODES), W.MODEL_COLUMNS).select("src_ip", "dest_ip", "votes", "web_scan")


@query("attack_forest_of_given_nodes", "J3 J6 H23", "WITH RECURSIVE " + _walk_sql(URL_NODES, "params", "s[1], s[2], s[3]", with_parts("FLOWS", f"""
, u AS (SELECT params, {NORMAL_SQL.format('(' + QUERY_SQL.format('params') + ')')} AS text FROM (SELECT DISTINCT params FROM flows)),
  e AS (SELECT params, entropy(ch) AS h FROM (SELECT params, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM u) GROUP BY params)
SELECT params, [len(regexp_extract_all(text, '(?i){WORDS_SQL}'))::DOUBLE, (text[-1:] = '/')::DOUBLE, coalesce(h, 0)] AS s FROM u LEFT JOIN e USING (params)""")))
def _(t):
    """Every distinct URL scored by a given attack forest, from its table of nodes."""
    urls = L.attack_text(t.flows.select("params").distinct()).withColumn("_s", vector_to_array("statistics"))
    table = urls.select("params", *[F.get("_s", F.lit(i)).alias(f"s{i}") for i in range(3)])
    return R.score_with_nodes(table, given_nodes(t, URL_NODES), ["s0", "s1", "s2"]).select("params", "votes", "web_scan")


@query("saved_forest", "A16 J7", with_parts("FLOWS WEBSCAN", "SELECT DISTINCT src_ip, dest_ip, true AS same FROM webscan"))
def _(t):
    """A forest saved and loaded again, and one scored from its table of nodes, must score as the one in memory."""
    from flowscope.operators.clean import clean_webscan

    path = scratch_path(t.spark, "forest")
    flows = clean_webscan(t.flows, drop_single=False)
    table = cut_lineage(W.webscan_features(flows, burst_seconds=3600).withColumn("label", (F.col("Sum_dir") > 5).cast("int")))
    forest = L.fit_webscan_forest(table, W.MODEL_COLUMNS, trees=20)
    sinks.save_model(forest, path)
    saved = L.score_webscan(table, sinks.load_model(path), W.MODEL_COLUMNS).withColumnRenamed("web_scan", "saved")
    nodes = R.forest_nodes(forest, scratch_path(t.spark, "nodes")).collect()
    walked = R.score_with_nodes(table, nodes, W.MODEL_COLUMNS, "walked").select("src_ip", "dest_ip", "walked")
    both = saved.join(L.score_webscan(table, forest, W.MODEL_COLUMNS), ["src_ip", "dest_ip"]).join(walked, ["src_ip", "dest_ip"])
    return both.select("src_ip", "dest_ip", ((F.col("saved") == F.col("web_scan")) & (F.col("walked") == F.col("web_scan"))).alias("same"))


@query("basic_scan_vector_scored", "D19 D20", with_parts("FLOWS BASIC", f"""
, p AS (SELECT *, lag(lower(params)) OVER (PARTITION BY src_ip, dest_ip ORDER BY seq) AS v FROM basic)
SELECT src_ip, round(count(*) FILTER ({ATTACK}) / count(*), 6) AS "P_malicious_urls",
  CASE WHEN count(v) = 0 THEN -1 ELSE count(*) FILTER (levenshtein(lower(params), v) < 5) END AS "C_similar_url",
  round(count(*) FILTER (status = '404') / count(*), 6) AS num_404, round(entropy(status), 6) AS "H_status"
FROM p GROUP BY src_ip"""))
def _(t):
    return W.basic_scan_vector(t.basic, L.score_urls(t.basic, url_model(t), ["src_ip"]))


@query("domain_kmeans", "J14")
def _(t):
    return L.domain_kmeans(domain_features(t.domain)).select("dest_ip", "Hostname", "Flows", "Urls", "Similar_host", "cluster")


@query("domain_assignment", "J14 J10", with_parts("FLOWS DOMAIN", f"""
, d AS (SELECT * FROM ({HOST_SQL}) WHERE "Similar_host" < 10),
  z AS (SELECT dest_ip, host, [("Flows" - avg("Flows") OVER ()) / stddev_pop("Flows") OVER (),
    ("Urls" - avg("Urls") OVER ()) / stddev_pop("Urls") OVER ()] AS x FROM d)
SELECT dest_ip, host AS "Hostname", (CASE WHEN list_distance(x, [-0.5, -0.25]::DOUBLE[]) <= list_distance(x, [1.0, 0.75]::DOUBLE[]) THEN 0 ELSE 1 END) AS cluster FROM z"""))
def _(t):
    """Standardised rows at the nearer of two given centres, as a fitted model assigns them."""
    table = domain_features(t.domain).filter("Similar_host < 10")
    scaled = L.standardise(table, ["Flows", "Urls"]).withColumn("features", F.array("Flows_scaled", "Urls_scaled"))
    return L.nearest_centre(scaled, [[-0.5, -0.25], [1.0, 0.75]]).select("dest_ip", "Hostname", "cluster")


@query("domain_rows_for_clustering", "J14 B9 J10", with_parts("FLOWS DOMAIN", f"""
, d AS (SELECT * FROM ({HOST_SQL}) WHERE "Similar_host" < 10)
SELECT dest_ip, host AS "Hostname", round(("Flows" - avg("Flows") OVER ()) / stddev_pop("Flows") OVER (), 6) AS "Flows_scaled",
  round(("Urls" - avg("Urls") OVER ()) / stddev_pop("Urls") OVER (), 6) AS "Urls_scaled" FROM d"""))
def _(t):
    table = domain_features(t.domain).filter("Similar_host < 10")
    return L.standardise(table, ["Flows", "Urls"]).select("dest_ip", "Hostname", "Flows_scaled", "Urls_scaled")
