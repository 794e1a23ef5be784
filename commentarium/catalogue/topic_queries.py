"""Topics: clustering, words, names, representatives, and the small-side fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentarium.catalogue import inputs as i
from commentarium.functions.dictionaries import TOPIC_NAMES, is_stopword
from commentarium.operators import density as dn
from commentarium.operators import embed, outliers
from commentarium.operators import layout as ly
from commentarium.operators import sentiment as st
from commentarium.operators import topics as tp
from commentarium.operators.neighbours import nearest
from commentarium.operators.storage import staged_columns
from commentarium.operators.tokens import each

KEY = ("topic_id",)
SIMILAR = tp.MERGE_SIMILARITY


def _counts(spark, sf_dir):
    return tp.topic_token_counts(i.with_given_topics(spark, sf_dir))


def paths(spark, sf_dir):
    return tp.topic_path(st.side_sizes(i.labels(i.prepared(spark, sf_dir))))


def word_weights(spark, sf_dir):
    weights = tp.topic_word_weights(_counts(spark, sf_dir))
    return weights.select("sentiment", "topic_id", "token", "tf", F.round("weight", 9).alias("weight"))


def _topic_table(rows):
    top = tp.top_words(tp.topic_word_weights(tp.topic_token_counts(rows)))
    return tp.topic_table(top, tp.topic_sizes(rows))


def keywords(spark, sf_dir):
    return _topic_table(i.with_given_topics(spark, sf_dir)).select("sentiment", "topic_id", "keywords", "n_rows")


def names(spark, sf_dir):
    return _topic_table(i.with_given_topics(spark, sf_dir)).select("sentiment", "topic_id", "label")


def word_names(spark, sf_dir):
    """Every distinct pair (language, word) of the data named as a one-word topic."""
    words = each(i.prepared(spark, sf_dir), F.array_distinct("tokens"), "token", "lang").distinct()
    named = words.select("lang", "token", tp.topic_name(F.col("token")).alias("label"))
    return named.groupBy("lang", "label").agg(F.count("*").alias("n_words"))


def labelled_rows(spark, sf_dir):
    rows = i.with_given_topics(spark, sf_dir)
    return tp.attach_topics(rows, _topic_table(rows)).select("row_id", "topic_label", "topic_keywords")


def _planted(spark, sf_dir):
    """Ten separate blobs: the label sets the place, two vector entries the spread."""
    rows = i.vectors(spark, sf_dir)
    label, v = F.col("topic_id"), F.col("embedding")
    return rows.select(
        "row_id",
        (20 * (label % 4) + F.get(v, F.lit(0)).cast("double")).alias("x"),
        (20 * F.floor(label / 4) + F.get(v, F.lit(1)).cast("double")).alias("y"),
    )


def grid_clusters(spark, sf_dir):
    return tp.cluster_grid(_planted(spark, sf_dir)).select("row_id", "topic_id")


def projection(spark, sf_dir):
    """Two components of every vector: centred, unrelated, the first one wider."""
    rows = i.vectors(spark, sf_dir)
    reduced = outliers.reduce_vectors(rows, outliers.fit_reduction(rows, components=2))
    x, y = F.get("components", F.lit(0)), F.get("components", F.lit(1))
    return reduced.agg(
        F.count("*").alias("n_rows"),
        F.abs(F.round(F.avg(x), 6)).alias("mean_x"),
        F.abs(F.round(F.avg(y), 6)).alias("mean_y"),
        F.abs(F.round(F.corr(x, y), 6)).alias("correlation"),
        (F.var_samp(x) >= F.var_samp(y)).alias("first_is_wider"),
    )


def neighbour_layout(spark, sf_dir):
    """Four far groups planted by the label: in the plane, too, every row's nearest rows are of its group."""
    rows = i.vectors(spark, sf_dir).withColumn("planted", F.col("topic_id") % 4)
    pull = F.transform("embedding", lambda x, k: x.cast("double") + F.when(k == F.col("planted"), 40.0).otherwise(0.0))
    rows = rows.select("row_id", "planted", pull.alias("components"))
    places = staged_columns(ly.neighbour_layout(rows).select(F.col("row_id").alias("key"), F.array("x", "y").alias("v")), "places")
    own, other = (rows.select(F.col("row_id").alias(end), F.col("planted").alias(name)) for end, name in (("src", "planted"), ("dst", "other")))
    pairs = nearest(places).join(own, "src").join(other, "dst")
    return pairs.groupBy(F.col("src").alias("row_id"), "planted").agg(F.count_if(F.col("other") == F.col("planted")).alias("n_own"))


def kept_neighbours(spark, sf_dir):
    """The layout keeps more of the vectors' neighbours than their two widest axes do."""
    rows = i.vectors(spark, sf_dir)
    points = rows.select(F.col("row_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    axes = outliers.reduce_vectors(rows, outliers.fit_reduction(rows, components=2)).select(F.col("row_id").alias("key"), F.col("components").alias("v"))
    laid = ly.neighbour_layout(rows, features="embedding").select(F.col("row_id").alias("key"), F.array("x", "y").alias("v"))
    kept = ly.kept_neighbours(points, staged_columns(laid, "places")).join(ly.kept_neighbours(points, axes).withColumnRenamed("n_kept", "n_axes"), "key")
    return kept.agg(F.count("*").alias("n_rows"), (F.sum("n_kept") > F.sum("n_axes")).alias("more_than_axes"))


def reachability(spark, sf_dir):
    """Mutual reachability of every vector and its nearest neighbours."""
    points = i.vectors(spark, sf_dir).select(F.col("row_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    return dn.reachability(nearest(points)).select("src", "dst", F.round("w", 6).alias("w"))


def density_clusters(spark, sf_dir):
    """Four far groups planted by the label, the vectors as spread: every row's topic is its whole group and nothing else."""
    rows = i.vectors(spark, sf_dir).withColumn("planted", F.col("topic_id") % 4)
    pull = F.transform("embedding", lambda x, k: x.cast("double") + F.when(k == F.col("planted"), 40.0).otherwise(0.0))
    rows = rows.select("row_id", "planted", pull.alias("components"))
    done = rows.select("row_id", "planted").join(dn.cluster_density(rows), "row_id")
    topic = done.groupBy("topic_id").agg(F.count("*").alias("topic_rows"), F.count_distinct("planted").alias("n_groups"))
    clear = F.col("topic_id") != tp.NOISE
    return done.join(F.broadcast(topic), "topic_id").select("row_id", "topic_rows", "n_groups", clear.alias("clear"))  # a handful of topics


def kmeans_clusters(spark, sf_dir):
    """Four directions planted by the label, the vectors as spread: each is one topic, and few rows are noise."""
    rows = i.vectors(spark, sf_dir).withColumn("planted", F.col("topic_id") % 4)
    pull = F.transform("embedding", lambda x, k: x.cast("double") + F.when(k == F.col("planted"), 8.0).otherwise(0.0))
    rows = rows.select("row_id", "planted", pull.alias("components"))
    done = rows.join(tp.cluster_kmeans(rows), "row_id")
    clear = F.col("topic_id") != tp.NOISE
    return done.groupBy("planted").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(F.when(clear, F.col("topic_id"))).alias("n_topics"),
        (F.count_if(~clear) <= 0.1 * F.count("*")).alias("mostly_kept"),
    )


def diverse_words(spark, sf_dir):
    """Ten of each topic's thirty best words, by the texts' own vectors: distinct, of the candidates, placed from 1."""
    rows = i.with_given_topics(spark, sf_dir)
    model = embed.fit_hashed_encoder(rows)
    rows = staged_columns(embed.hashed_vectors(rows, model), "coded")
    candidates = staged_columns(tp.top_words(tp.topic_word_weights(tp.topic_token_counts(rows)), tp.CANDIDATES), "candidates")
    chosen = tp.diversify_words(candidates, rows)
    known = candidates.select("sentiment", "topic_id", "token", F.lit(True).alias("known"))
    return chosen.join(known, ["sentiment", "topic_id", "token"], "left").groupBy("sentiment", "topic_id").agg(
        F.count_distinct("token").alias("n_words"), F.max("place").cast("bigint").alias("last_place"), F.count("known").alias("n_known")
    )


def merged_topics(spark, sf_dir):
    rows = i.with_given_topics(spark, sf_dir)
    weights = tp.topic_word_weights(tp.topic_token_counts(rows))
    return tp.merge_map(weights, tp.topic_sizes(rows))


def similarities(spark, sf_dir):
    pairs = tp.topic_similarities(tp.topic_word_weights(_counts(spark, sf_dir)))
    return pairs.withColumn("similarity", F.round("similarity", 6))


def centroids(spark, sf_dir):
    means = tp.topic_centroids(i.vectors(spark, sf_dir), keys=KEY)
    return means.select("topic_id", F.posexplode("centroid").alias("d", "value")).withColumn("value", F.round("value", 6))


def representatives(spark, sf_dir):
    best = tp.representatives(i.vectors(spark, sf_dir), keys=KEY)
    return best.withColumn("similarity", F.round("similarity", 6))


def marked_rows(spark, sf_dir):
    return tp.mark_representatives(i.vectors(spark, sf_dir), keys=KEY).select("row_id", "topic_id", "representative_doc")


def frequent_words(spark, sf_dir):
    return tp.frequent_words(i.prepared(spark, sf_dir)).select("token", "n")


def fallback_columns(spark, sf_dir):
    rows = tp.fallback_topics(i.prepared(spark, sf_dir))
    return rows.select("row_id", *tp.TOPIC_COLUMNS)


def stopword_use(spark, sf_dir):
    words = each(i.prepared(spark, sf_dir), "tokens", "token", "lang")
    stop = is_stopword("lang", "lower(token)")
    return words.groupBy("lang").agg(F.count_if(stop).alias("n_stopwords"), F.count("*").alias("n_tokens"))


# --- SQL twins -----------------------------------------------------------------------

WEIGHTS = """tc AS (SELECT sentiment, topic_id, lower(token) AS token, count(*) AS tf
  FROM (SELECT sentiment, topic_id, unnest(tokens) AS token FROM given) WHERE length(token) >= 2 GROUP BY ALL),
totals AS (SELECT sentiment, topic_id, sum(tf) AS words FROM tc GROUP BY ALL),
means AS (SELECT sentiment, avg(words) AS mean_words FROM totals GROUP BY ALL),
weights AS (SELECT sentiment, topic_id, token, tf,
  round(tf / words * ln(1 + mean_words / sum(tf) OVER (PARTITION BY sentiment, token)), 12) AS weight
  FROM tc JOIN totals USING (sentiment, topic_id) JOIN means USING (sentiment))"""
TOP = """ranked AS (SELECT sentiment, topic_id, token, row_number() OVER (PARTITION BY sentiment, topic_id ORDER BY weight DESC, token) AS place
  FROM weights WHERE topic_id <> -1),
sizes AS (SELECT sentiment, topic_id, count(*) AS n_rows FROM given WHERE topic_id <> -1 GROUP BY ALL),
listed AS (SELECT sentiment, topic_id, any_value(n_rows) AS n_rows, coalesce(string_agg(token, ', ' ORDER BY place) FILTER (token IS NOT NULL), '') AS keywords
  FROM sizes LEFT JOIN (SELECT * FROM ranked WHERE place <= 10) USING (sentiment, topic_id) GROUP BY ALL)"""
DICT = "dict(ord, pattern, name) AS (VALUES " + ", ".join(
    f"({k}, {i.quoted([p])}, {i.quoted([n])})" for k, (p, n) in enumerate(TOPIC_NAMES)
) + ")"


def sql_names(source: str, keys: str) -> str:
    """CTE ``named(keys, keywords, label)`` from ``source(keys, keywords)``."""
    cap = "CASE left({0}, 1) WHEN 'ß' THEN 'Ss' ELSE upper(left({0}, 1)) END || lower(substr({0}, 2))"
    return f"""kw AS (SELECT {keys}, k, seat FROM (SELECT {keys}, unnest(string_split(keywords, ', ')) AS k,
  generate_subscripts(string_split(keywords, ', '), 1) AS seat FROM {source}) WHERE k <> ''),
uses AS (SELECT DISTINCT k FROM kw),
votes AS (SELECT k, arg_min(name, ord) AS name FROM uses JOIN dict ON contains(k, pattern) OR contains(pattern, k) GROUP BY k),
tally AS (SELECT {keys}, name, count(*) AS n, min(seat) AS first_at FROM kw JOIN votes USING (k) GROUP BY ALL),
chosen AS (SELECT {keys}, name FROM tally QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first_at) = 1),
spare AS (SELECT {keys}, string_agg({cap.format('k')}, ' / ' ORDER BY seat) AS name FROM kw WHERE seat <= 2 GROUP BY {keys}),
named AS (SELECT s.*, coalesce(chosen.name, spare.name, 'General') AS label
  FROM {source} s LEFT JOIN chosen USING ({keys}) LEFT JOIN spare USING ({keys}))"""


WEIGHTED = (*i.GIVEN_TOPICS, WEIGHTS)
LISTED = (*WEIGHTED, TOP)
NAMED = (*LISTED, DICT, sql_names("listed", "sentiment, topic_id"))
SIMS = """norms AS (SELECT sentiment, topic_id, sqrt(sum(weight * weight)) AS norm FROM weights WHERE topic_id <> -1 GROUP BY ALL),
sims AS (SELECT a.sentiment, a.topic_id AS a, b.topic_id AS b, round(sum(a.weight * b.weight) / (any_value(x.norm) * any_value(y.norm)), 9) AS similarity
  FROM weights a JOIN weights b ON a.sentiment = b.sentiment AND a.token = b.token AND a.topic_id < b.topic_id AND a.topic_id <> -1
  JOIN norms x ON x.sentiment = a.sentiment AND x.topic_id = a.topic_id JOIN norms y ON y.sentiment = b.sentiment AND y.topic_id = b.topic_id
  GROUP BY 1, 2, 3)"""
MERGED = f"""topic_n AS (SELECT sentiment, topic_id, count(*) AS n_rows FROM given WHERE topic_id <> -1 GROUP BY ALL),
links AS (SELECT sentiment, a, b FROM sims WHERE similarity >= {SIMILAR} UNION SELECT sentiment, b, a FROM sims WHERE similarity >= {SIMILAR}),
reach AS (SELECT sentiment, topic_id AS a, topic_id AS b FROM topic_n
  UNION SELECT r.sentiment, r.a, l.b FROM reach r JOIN links l ON l.sentiment = r.sentiment AND l.a = r.b),
comp AS (SELECT sentiment, a AS topic_id, min(b) AS component FROM reach GROUP BY ALL),
groups AS (SELECT sentiment, component, sum(n_rows) AS n FROM comp JOIN topic_n USING (sentiment, topic_id) GROUP BY ALL),
renamed AS (SELECT sentiment, component, row_number() OVER (PARTITION BY sentiment ORDER BY n DESC, component) - 1 AS merged_id FROM groups)"""
CENTROIDS = """cells AS (SELECT row_id, topic_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vecs),
centre AS (SELECT topic_id, d, avg(x) AS c FROM cells GROUP BY ALL)"""
NEAREST = """near AS (SELECT row_id, topic_id, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 9) AS similarity
  FROM cells JOIN centre USING (topic_id, d) GROUP BY ALL),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY similarity DESC, row_id) = 1)"""
GRID = """pts AS (SELECT row_id, 20 * (topic_id % 4) + v[1] AS x, 20 * (topic_id // 4) + v[2] AS y FROM vecs),
box AS (SELECT min(x) AS x0, (max(x) - min(x)) / 32 AS dx, min(y) AS y0, (max(y) - min(y)) / 32 AS dy FROM pts),
placed AS (SELECT row_id, least(floor((x - x0) / dx), 31)::BIGINT AS cx, least(floor((y - y0) / dy), 31)::BIGINT AS cy FROM pts, box),
dense AS (SELECT cx, cy, cy * 32 + cx AS cell, count(*) AS n FROM placed GROUP BY ALL),
reach AS (SELECT cell AS a, cell AS b FROM dense
  UNION SELECT r.a, n.cell FROM reach r JOIN dense d ON d.cell = r.b JOIN dense n ON abs(n.cx - d.cx) <= 1 AND abs(n.cy - d.cy) <= 1),
comp AS (SELECT a AS cell, min(b) AS component FROM reach GROUP BY ALL),
sized AS (SELECT component, sum(n) AS n FROM comp JOIN dense USING (cell) GROUP BY ALL HAVING sum(n) >= (SELECT greatest(10, count(*) // 10) FROM pts)),
ids AS (SELECT component, row_number() OVER (ORDER BY n DESC, component) - 1 AS topic_id FROM sized)"""
FREQUENT = """fw AS (SELECT p.row_id, p.lang, lower(t.token) AS token, t.pos FROM prep p,
  LATERAL (SELECT unnest(p.tokens) AS token, generate_subscripts(p.tokens, 1) AS pos) t),
counted AS (SELECT token, count(*) AS n, arg_min(pos, row_id * 1000000 + pos) AS pos, min(row_id) AS first_row FROM fw
  WHERE NOT EXISTS (SELECT 1 FROM stops WHERE stops.lang = fw.lang AND stops.token = fw.token) GROUP BY token),
top20 AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, first_row, pos) AS place FROM counted ORDER BY n DESC, first_row, pos LIMIT 20)"""

QUERIES = {
    "top01_path": (
        paths,
        i.with_ctes(
            *i.SENTIMENT,
            select="""SELECT s.sentiment, count(sent.row_id) AS n_rows,
              CASE WHEN count(sent.row_id) < 100 THEN 'word_frequency_fallback' ELSE 'clusters' END AS path
              FROM (VALUES ('pos'), ('neg')) s(sentiment) LEFT JOIN sent USING (sentiment) GROUP BY s.sentiment""",
        ),
    ),
    "top02_projection": (
        projection,
        "SELECT count(*) AS n_rows, 0.0 AS mean_x, 0.0 AS mean_y, 0.0 AS correlation, true AS first_is_wider FROM embeddings",
    ),
    "top02_neighbour_layout": (
        neighbour_layout,
        """SELECT vec_id AS row_id, label % 4 AS planted, least(15, count(*) OVER (PARTITION BY label % 4) - 1) AS n_own FROM embeddings""",
    ),
    "top02_kept_neighbours": (
        kept_neighbours,
        "SELECT count(*) AS n_rows, true AS more_than_axes FROM embeddings",
    ),
    "top03_grid_clusters": (
        grid_clusters,
        i.with_ctes(
            i.VECS, GRID,
            select="""SELECT row_id, coalesce(topic_id, -1) AS topic_id FROM placed JOIN comp ON comp.cell = cy * 32 + cx LEFT JOIN ids USING (component)""",
            recursive=True,
        ),
    ),
    "top03_reachability": (
        reachability,
        i.with_ctes(
            i.VECS,
            """near AS (
              SELECT a.row_id AS src, b.row_id AS dst, round(list_distance(a.v, b.v), 9) AS d FROM vecs a JOIN vecs b ON a.row_id <> b.row_id
              QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_distance(a.v, b.v), 9), b.row_id) <= 15
            )""",
            "core AS (SELECT src, max(d) AS core FROM near GROUP BY src)",
            select="""SELECT DISTINCT least(n.src, n.dst) AS src, greatest(n.src, n.dst) AS dst, round(greatest(d, a.core, b.core, 1e-9), 6) AS w
              FROM near n JOIN core a ON a.src = n.src JOIN core b ON b.src = n.dst""",
        ),
    ),
    "top03_density_clusters": (
        density_clusters,
        """SELECT vec_id AS row_id, count(*) OVER (PARTITION BY label % 4) AS topic_rows, 1 AS n_groups, true AS clear FROM embeddings""",
    ),
    "top03_kmeans_clusters": (
        kmeans_clusters, "SELECT label % 4 AS planted, count(*) AS n_rows, 1 AS n_topics, true AS mostly_kept FROM embeddings GROUP BY 1"
    ),
    "top04_word_weights": (
        word_weights,
        i.with_ctes(*WEIGHTED, select="SELECT sentiment, topic_id, token, tf, round(weight, 9) AS weight FROM weights"),
    ),
    "top05_diverse_words": (
        diverse_words,
        i.with_ctes(
            *WEIGHTED,
            select="""SELECT sentiment, topic_id, least(10, count(*)) AS n_words, least(10, count(*)) AS last_place,
              least(10, count(*)) AS n_known FROM weights GROUP BY ALL""",
        ),
    ),
    "top06_similarities": (
        similarities, i.with_ctes(*WEIGHTED, SIMS, select="SELECT sentiment, a, b, round(similarity, 6) AS similarity FROM sims")
    ),
    "top06_merged_topics": (
        merged_topics,
        i.with_ctes(
            *WEIGHTED, SIMS, MERGED,
            select="SELECT sentiment, topic_id, merged_id FROM comp JOIN renamed USING (sentiment, component)",
            recursive=True,
        ),
    ),
    "top07_keywords": (keywords, i.with_ctes(*LISTED, select="SELECT sentiment, topic_id, keywords, n_rows FROM listed")),
    "top08_topic_names": (names, i.with_ctes(*NAMED, select="SELECT sentiment, topic_id, label FROM named")),
    "top08_word_names": (
        word_names,
        i.with_ctes(
            *i.PREPARED, i.TOKS, "one AS (SELECT DISTINCT lang, token AS keywords, token FROM toks)", DICT, sql_names("one", "lang, token"),
            select="SELECT lang, label, count(*) AS n_words FROM named GROUP BY ALL",
        ),
    ),
    "top09_labelled_rows": (
        labelled_rows,
        i.with_ctes(
            *NAMED,
            select="""SELECT row_id, coalesce(label, 'General') AS topic_label, coalesce(keywords, '') AS topic_keywords
              FROM given LEFT JOIN named USING (sentiment, topic_id)""",
        ),
    ),
    "top10_centroids": (
        centroids,
        i.with_ctes(i.VECS, CENTROIDS, select="SELECT topic_id, d - 1 AS d, round(c, 6) AS value FROM centre"),
    ),
    "top11_representatives": (
        representatives,
        i.with_ctes(i.VECS, CENTROIDS, NEAREST, select="SELECT topic_id, row_id, round(similarity, 6) AS similarity FROM best"),
    ),
    "top11_marked_rows": (
        marked_rows,
        i.with_ctes(
            i.VECS, CENTROIDS, NEAREST,
            select="SELECT v.row_id, v.topic_id, best.row_id IS NOT NULL AS representative_doc FROM vecs v LEFT JOIN best ON best.row_id = v.row_id",
        ),
    ),
    "top12_frequent_words": (
        frequent_words, i.with_ctes(*i.PREPARED, i.STOPS, FREQUENT, select="SELECT token, n FROM top20")
    ),
    "top13_fallback_columns": (
        fallback_columns,
        i.with_ctes(
            *i.PREPARED, i.STOPS, FREQUENT,
            select="""SELECT row_id, -1 AS topic_id, 'word_frequency_fallback' AS topic_label,
              (SELECT string_agg(token, ', ' ORDER BY place) FROM top20) AS topic_keywords,
              NULL::DOUBLE AS x, NULL::DOUBLE AS y, false AS representative_doc FROM prep""",
        ),
    ),
    "top15_stopword_use": (
        stopword_use,
        i.with_ctes(
            *i.PREPARED, i.TOKS, i.STOPS,
            select="""SELECT t.lang, count(s.token) AS n_stopwords, count(*) AS n_tokens
              FROM toks t LEFT JOIN stops s ON s.lang = t.lang AND s.token = lower(t.token) GROUP BY t.lang""",
        ),
    ),
}
