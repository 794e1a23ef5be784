"""Sources and sinks, by round trips through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentarium.catalogue import inputs as i
from commentarium.operators.storage import scratch_path
from commentarium.operators.summary import kpis
from commentarium.sources import comments as cm
from commentarium.sources import languages as lg
from commentarium.sources import sinks


def _write_csv(df, path, encoding="UTF-8"):
    (
        df.write.option("header", True).option("escape", '"').option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def _csv_rows(spark, sf_dir):
    return i.comments(spark, sf_dir).select("row_id", F.col("raw_text").alias("comment"), "lang", "source")


def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    _write_csv(_csv_rows(spark, sf_dir), path)
    loaded = cm.load_comments(spark, path, "comment", key="row_id")
    return loaded.select(F.col("row_id").cast("bigint").alias("row_id"), "raw_text", "comment", "lang", "source")


def quoted_records(spark, sf_dir):
    """Texts with line breaks, each file of them cut into records by as many tasks as it has splits."""
    path = scratch_path(spark, "quoted")
    _write_csv(_csv_rows(spark, sf_dir), path)
    loaded = cm.load_comments(spark, path, "comment", key="row_id", parallel=True)
    n_lines = F.size(F.split("raw_text", "\n", -1)).cast("bigint")
    return loaded.select(F.col("row_id").cast("bigint").alias("row_id"), "raw_text", "lang", "source", n_lines.alias("n_lines"))


def mixed_encodings(spark, sf_dir):
    """French and German files in Latin-1, the rest in UTF-8; read together."""
    rows = _csv_rows(spark, sf_dir)
    western, other = scratch_path(spark, "latin1"), scratch_path(spark, "utf8")
    is_western = F.col("lang").isin("fr", "de")
    _write_csv(rows.where(is_western), western, cm.LATIN1)
    _write_csv(rows.where(~is_western), other)
    loaded = cm.standardise(cm.read_csv(spark, [western, other]), "comment", key="row_id")
    return loaded.select(F.col("row_id").cast("bigint").alias("row_id"), "raw_text")


def mixed_column_orders(spark, sf_dir):
    """Files of two column orders, one of them without the source column, read together."""
    rows = _csv_rows(spark, sf_dir)
    one, two = scratch_path(spark, "order-a"), scratch_path(spark, "order-b")
    _write_csv(rows.where("lang <> 'en'"), one)
    _write_csv(rows.where("lang = 'en'").select("lang", "comment", "row_id"), two)
    loaded = cm.standardise(cm.read_csv(spark, [one, two]), "comment", key="row_id")
    return loaded.select(F.col("row_id").cast("bigint").alias("row_id"), "raw_text", "lang", "source")


def missing_texts(spark, sf_dir):
    """Unlabelled rows have no text, low-quality rows hold one of the missing marks."""
    labels = i.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    rows = i.comments(spark, sf_dir).join(labels, "row_id", "left")
    text = F.when(F.col("quality") == 1, F.col("raw_text")).when(F.col("quality") == 0, "NaN")
    marked = rows.select("row_id", F.when(F.col("toxic") == 1, "n/a").otherwise(text).alias("comment"))
    return cm.standardise(marked, "comment", key="row_id").select("row_id", "raw_text")


def standardised(spark, sf_dir):
    docs = i.table(spark, sf_dir, "documents")
    return cm.standardise(docs, "text", key="doc_id").select("row_id", "doc_id", "text", "raw_text", "n_chars")


def generated_ids(spark, sf_dir):
    """No key column: numbered rows, each id once."""
    rows = cm.standardise(i.table(spark, sf_dir, "documents"), "text")
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids"))


def split_by_value(spark, sf_dir):
    path = scratch_path(spark, "split")
    sinks.write_split(i.comments(spark, sf_dir), path, "source")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.length("raw_text")).alias("n_chars"))


def chosen_values(spark, sf_dir):
    path = scratch_path(spark, "split")
    sinks.write_split(i.comments(spark, sf_dir), path, "lang", "json")
    stored = spark.read.schema("row_id bigint, raw_text string, source string, lang string").json(path)
    return sinks.read_split(stored, "lang", "de", "es").select("row_id", "lang", "raw_text")


def languages(spark, sf_dir):
    rows = lg.with_language(i.comments(spark, sf_dir))
    return rows.groupBy("lang", "stopword_list", "scorer").agg(F.count("*").alias("n_rows"))


def unknown_languages(spark, sf_dir):
    """The source name taken as a language code: every row is unsupported."""
    return lg.unsupported(i.comments(spark, sf_dir), "source").groupBy("source").agg(F.count("*").alias("n_rows"))


def run_folder(spark, sf_dir):
    """Result tables and parameters of one run, written and read back."""
    flagged = i.labels(i.prepared(spark, sf_dir), "lang").persist()
    base = sinks.write_run(
        {"kpi": kpis(flagged, "lang"), "points": flagged.select("row_id", "lang", "sentiment")},
        scratch_path(spark, "runs"), "first", {"concept": "precio valor costo", "contamination": 0.05},
    )
    kpi, points = spark.read.parquet(f"{base}/kpi"), spark.read.parquet(f"{base}/points")
    listed = spark.read.parquet(f"{base}/parameters")
    counted = points.groupBy("lang").agg(F.count("*").alias("n_points"))
    return kpi.select("lang", "n_pos", "n_neg").join(counted, "lang").join(F.broadcast(listed))


_DOC_TEXTS = "SELECT doc_id AS row_id, text AS raw_text, text AS comment, lang, source FROM documents"

QUERIES = {
    "src01_csv_round_trip": (csv_round_trip, _DOC_TEXTS),
    "src01_quoted_records": (
        quoted_records,
        """SELECT doc_id AS row_id, text AS raw_text, lang, source,
          (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents""",
    ),
    "src02_mixed_encodings": (
        mixed_encodings,
        r"""SELECT doc_id AS row_id, CASE WHEN lang IN ('fr', 'de') THEN regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') ELSE text END AS raw_text
          FROM documents""",
    ),
    "src02_mixed_column_orders": (
        mixed_column_orders,
        """SELECT doc_id AS row_id, text AS raw_text, lang, CASE WHEN lang <> 'en' THEN source END AS source FROM documents""",
    ),
    "src03_missing_texts": (
        missing_texts,
        """SELECT d.doc_id AS row_id, d.text AS raw_text FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic <> 1""",
    ),
    "src05_standardised": (standardised, "SELECT doc_id AS row_id, doc_id, text, text AS raw_text, n_chars FROM documents"),
    "src05_generated_ids": (generated_ids, "SELECT count(*) AS n_rows, count(*) AS n_ids FROM documents"),
    "src06_split_by_value": (
        split_by_value, "SELECT source, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source"
    ),
    "src06_chosen_values": (
        chosen_values, "SELECT doc_id AS row_id, lang, text AS raw_text FROM documents WHERE lang IN ('de', 'es')"
    ),
    "src07_languages": (
        languages,
        """SELECT lang, r.stopword_list, r.scorer, count(*) AS n_rows FROM documents JOIN (VALUES ('es', 'spanish', 'model'),
          ('en', 'english', 'lexicon'), ('fr', 'french', 'model'), ('de', 'german', 'model'), ('pt', 'portuguese', 'model'))
          r(lang, stopword_list, scorer) USING (lang) GROUP BY ALL""",
    ),
    "src07_unknown_languages": (unknown_languages, "SELECT source, count(*) AS n_rows FROM documents GROUP BY source"),
    "src09_run_folder": (
        run_folder,
        i.with_ctes(
            *i.SENTIMENT,
            select="""SELECT lang, count(*) FILTER (sentiment = 'pos') AS n_pos, count(*) FILTER (sentiment = 'neg') AS n_neg,
              count(*) AS n_points, 'precio valor costo' AS concept, '0.05' AS contamination FROM sent GROUP BY lang""",
        ),
    ),
}
