import pytest
from pyspark.sql import functions as F

from commentarium.operators import sentiment as st
from commentarium.operators.preprocess import preprocess


@pytest.fixture(scope="module")
def lexicon(spark):
    first = spark.createDataFrame([("good", 2.0), ("bad", -2.5), ("great", 3.0)], "token string, valence double")
    second = spark.createDataFrame([("good", 0.7), ("bad", -0.7), ("great", -0.5)], "token string, valence double")
    return st.merge_lexicons(first, second)


def run(spark, lexicon, texts, **options):
    df = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "row_id bigint, lang string, raw_text string")
    done = st.analyse_sentiment(preprocess(df), lexicon, **options)
    return {r["row_id"]: r for r in done.collect()}


def test_labels_and_confidence(spark, lexicon):
    rows = run(spark, lexicon, ["good good room", "bad place here", "quiet table lamp", "great view there", None])
    assert [rows[k]["sentiment"] for k in range(5)] == ["pos", "neg", "neg", "pos", "neg"]
    assert rows[0]["polarity"] == pytest.approx(4 / (16 + 15) ** 0.5)
    assert rows[3]["sentiment_confidence"] is False  # the second lexicon disagrees, the first wins
    assert rows[2]["sentiment_confidence"] is True
    assert (rows[4]["polarity"], rows[4]["sentiment_confidence"]) == (0.0, False)


def test_negated_words_are_mute_or_flipped(spark, lexicon):
    text = ["room not good"]
    assert run(spark, lexicon, text)[0]["polarity"] == 0.0
    flipped = -1.48 / (1.48**2 + 15) ** 0.5
    assert run(spark, lexicon, text, negation="flip")[0]["polarity"] == pytest.approx(flipped)


PROBS = "row_id bigint, clean_text string, probabilities struct<output: string, p_pos: double, p_neg: double, p_neu: double>"


@pytest.mark.parametrize(
    "output,pos,neg,label,sure",
    [
        ("NEU", 0.31, 0.24, "pos", False),
        ("NEU", 0.11, 0.35, "neg", False),
        ("NEU", 0.25, 0.25, "pos", False),
        ("POS", 0.9, 0.05, "pos", True),
        ("NEG", 0.1, 0.8, "neg", True),
    ],
)
def test_probabilities(spark, output, pos, neg, label, sure):
    df = spark.createDataFrame([(1, "x y", (output, pos, neg, 1 - pos - neg))], PROBS)
    row = st.resolve_probabilities(df).first()
    assert (row["sentiment"], row["sentiment_confidence"]) == (label, sure)
    assert row["polarity"] == pytest.approx(pos - neg)


def test_blank_rows_on_the_model_route(spark):
    df = spark.createDataFrame([(1, " ", ("POS", 0.9, 0.1, 0.0)), (2, None, ("POS", 0.9, 0.1, 0.0))], PROBS)
    for row in st.resolve_probabilities(df, text="clean_text").collect():
        assert (row["sentiment"], row["polarity"], row["sentiment_confidence"]) == ("neg", 0.0, False)


def test_routes_by_language(spark, lexicon):
    df = spark.createDataFrame([(1, "en", "good room"), (2, "fr", "good chambre")], "row_id bigint, lang string, raw_text string")

    def predict(rows):
        return rows.withColumn(
            "probabilities",
            F.struct(F.lit("NEG").alias("output"), F.lit(0.1).alias("p_pos"), F.lit(0.9).alias("p_neg"), F.lit(0.0).alias("p_neu")),
        )

    done = {r["row_id"]: r["sentiment"] for r in st.analyse_sentiment(preprocess(df), lexicon, predict).collect()}
    assert done == {1: "pos", 2: "neg"}


def test_plugin_sees_small_batches(spark):
    def load():
        def predict(texts):
            assert len(texts) <= 32
            return [("POS", 1.0, 0.0, 0.0)] * len(texts)

        return predict

    df = spark.range(100).select(F.col("id").cast("string").alias("clean_text")).coalesce(1)
    done = df.select(st.predictor_expression(load)(F.col("clean_text")).alias("p"))
    assert done.where("p.output = 'POS'").count() == 100


def test_summary_and_sizes(spark):
    df = spark.createDataFrame([("pos", True)] * 3 + [("pos", False)], "sentiment string, sentiment_confidence boolean")
    s = st.sentiment_summary(df).first()
    assert (s["n_pos"], s["n_neg"], s["confidence_rate"]) == (4, 0, 0.75)
    assert st.sentiment_summary(df.where("false")).first()["confidence_rate"] == 0.0
    assert {tuple(r) for r in st.side_sizes(df).collect()} == {("pos", 4, True), ("neg", 0, True)}


def _worded(spark):
    """Rows of common words, rare words, negated words, no words and none at all; two share an id."""
    given = [(i, "en" if i % 2 else "fr", ["the", "room", "NEG_good", f"w{i % 40}"] + ["good"] * (i % 3)) for i in range(200)]
    given += [(200, "en", []), (201, None, None), (7, "en", ["w3", "zzz", "NEG_w3"]), (None, "fr", ["w5", "the"])]
    rows = spark.createDataFrame(given, "row_id bigint, lang string, tokens array<string>").repartition(5)
    words = [("good", 2.0, 0.5), ("room", -2.0, None), ("w3", None, -0.5), ("w5", 2.0, 0.5), ("w5", -4.0, 0.25), ("unused", 1.0, 1.0)]
    return rows, spark.createDataFrame(words, "token string, valence_1 double, valence_2 double")


@pytest.mark.parametrize("negation", ["mute", "flip"])
@pytest.mark.parametrize("frequent", [1, 3, 1000])
def test_a_large_lexicon_gives_the_scores_of_a_small_one(spark, monkeypatch, negation, frequent):
    monkeypatch.setattr(st, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(st, "_DRAWN", 2)
    rows, lexicon = _worded(spark)
    by_lang = lexicon.crossJoin(spark.createDataFrame([("en",), ("fr",)], "lang string")).where("lang = 'en' OR token <> 'good'")
    for words, keys, carry in ((lexicon, ("token",), ()), (by_lang, ("lang", "token"), ("lang",))):
        options = {"keys": keys, "carry": carry, "negation": negation}

        def scored(**bound):
            found = st.lexicon_scores(rows, words, **options, **bound).collect()
            return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found], key=str)

        assert scored(max_rows=0) == scored()


def test_a_large_lexicon_shuffles_rare_words_only(spark, monkeypatch):
    lines = []
    monkeypatch.setattr(st, "_DRAWN", 1)
    monkeypatch.setattr(st, "FREQUENT_WORDS", 4)
    monkeypatch.setattr(st, "staged_columns", lambda df, name, f=st.staged_columns: lines.append((out := f(df, name)).count()) or out)
    rows = spark.range(300).select(
        F.col("id").alias("row_id"),
        F.expr("concat(array_repeat('the', 50), array('good', 'of', 'unknown'), if(id < 9, array(concat('w', id)), array()))").alias("tokens"),
    )
    lexicon = spark.range(20).selectExpr("concat('w', id) AS token", "2.0D AS valence_1", "0.5D AS valence_2")
    scores = st.lexicon_scores(rows, lexicon, max_rows=10)
    assert lines == [300 + 9]
    assert "_salt" not in scores._jdf.queryExecution().toString()
    assert scores.where("score_2 = 0.5").count() == 9 and scores.agg(F.sum("n_tokens")).first()[0] == 300 * 53 + 9


def test_rare_words_of_no_lexicon_are_not_shuffled(spark, monkeypatch):
    lines = []
    monkeypatch.setattr(st, "FREQUENT_WORDS", 2)
    monkeypatch.setattr(st, "staged_columns", lambda df, name, f=st.staged_columns: lines.append((out := f(df, name)).count()) or out)
    rows = spark.range(300).select(
        F.col("id").alias("row_id"),
        F.expr("concat(array('the', 'room', concat('unknown', id), concat('NEG_w', id)), if(id < 9, array(concat('w', id)), array()))").alias("tokens"),
    )
    lexicon = spark.range(20).selectExpr("concat('w', id) AS token", "2.0D AS valence_1", "0.5D AS valence_2")
    scores = st.lexicon_scores(rows, lexicon, max_rows=10)
    assert lines[0] <= 300 + 9
    assert scores.where("score_2 = 0.5").count() == 9 and scores.agg(F.sum("n_tokens")).first()[0] == 300 * 4 + 9


@pytest.mark.parametrize("marks", [1, 2, 1 << 19])
def test_marks_that_words_share_change_no_score(spark, monkeypatch, marks):
    monkeypatch.setattr(st, "FREQUENT_WORDS", 1)
    monkeypatch.setattr(st, "_MARKS", marks)
    rows, _ = _worded(spark)
    lexicon = spark.range(400).selectExpr("concat('w', id * 3 % 390) AS token", "if(id % 4 > 0, id - 200D, NULL) AS valence_1", "if(id % 5 > 0, id / 7D, NULL) AS valence_2")

    def scored(**bound):
        found = st.lexicon_scores(rows, lexicon, **bound).collect()
        return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found], key=str)

    assert scored(max_rows=0) == scored()


def test_a_lexicon_with_frequencies_leaves_its_rarest_words_to_the_shuffle(spark, monkeypatch):
    lines = []
    monkeypatch.setattr(st, "FREQUENT_WORDS", 4)
    monkeypatch.setattr(st, "staged_columns", lambda df, name, f=st.staged_columns: lines.append((out := f(df, name)).count()) or out)
    rows = spark.range(300).select(
        F.col("id").alias("row_id"), F.expr("concat(array_repeat('the', 50), if(id < 9, array(concat('w', id)), array()))").alias("tokens")
    )
    lexicon = spark.range(20).selectExpr("concat('w', id) AS token", "2.0D AS valence_1", "0.5D AS valence_2", "20 - id AS frequency")
    scores = st.lexicon_scores(rows, lexicon, max_rows=10)
    assert lines == [300 + 5]
    assert scores.where("score_2 = 0.5").count() == 9 and scores.columns == ["row_id", "n_tokens", "score_1", "score_2"]


@pytest.mark.parametrize("frequent", [1, 3, 1000])
def test_frequencies_change_no_score(spark, monkeypatch, frequent):
    monkeypatch.setattr(st, "FREQUENT_WORDS", frequent)
    rows, lexicon = _worded(spark)
    both = lexicon.crossJoin(spark.createDataFrame([("en",), ("fr",), (None,)], "lang string"))
    for words, keys in ((lexicon, ("token",)), (both, ("lang", "token"))):
        counted = words.withColumn("frequency", F.when(F.col("valence_1") > 0, F.length("token")))

        def scored(lexicon, **bound):
            found = st.lexicon_scores(rows, lexicon, keys=keys, negation="flip", **bound).collect()
            return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found], key=str)

        expected = scored(words)
        assert scored(counted, max_rows=0) == expected and scored(counted) == expected
        monkeypatch.setattr(st, "FREQUENT_BYTES", 3)  # longer words are left to the join
        assert scored(counted, max_rows=0) == expected
