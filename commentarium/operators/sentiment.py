"""Sentiment: two lexicons, or class probabilities from a model, to one contract.

Both routes add ``sentiment`` ('pos' or 'neg'), ``polarity`` in [-1, 1] and
``sentiment_confidence`` (whether the evidence agrees).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.functions.dictionaries import LANGUAGES
from commentarium.functions.text import NEGATION_PREFIX
from commentarium.operators.joins import MAX_BROADCAST_ROWS, fits_broadcast
from commentarium.operators.storage import cut_lineage, staged_columns

# Fixed values.
POSITIVE_FROM = 0.05
COMPOUND_ALPHA = 15
NEGATION_FLIP = -0.74
PREDICT_BATCH = 32
MIN_SIDE_ROWS = 100
SIDES = ("pos", "neg")
FREQUENT_WORDS = MAX_BROADCAST_ROWS  # broadcast of a larger lexicon
FREQUENT_BYTES = 128  # longer words are not
FREQUENCY = "frequency"  # a lexicon's optional column
_DRAWN = 8  # without it, one row in so many tells which words are frequent
_MARKS = 1 << 19  # numbers of 64 bits that mark the words of a larger lexicon, broadcast too

PROBABILITIES = "output string, p_pos double, p_neg double, p_neu double"
PredictBatch = Callable[[Sequence[str]], Sequence[tuple[str, float, float, float]]]


# --- Row expressions -----------------------------------------------------------


def compound(valence_sum: Column) -> Column:
    """Squash a sum of valences into [-1, 1] (Hutto & Gilbert, 2014)."""
    total = F.coalesce(valence_sum, F.lit(0.0))
    return total / F.sqrt(total * total + F.lit(float(COMPOUND_ALPHA)))


def side(score: Column) -> Column:
    """'pos' from 0.05 up; everything else, neutral included, is 'neg'."""
    return F.when(score >= POSITIVE_FROM, "pos").otherwise("neg")


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def resolve_lexicon(df: DataFrame, blank: Column, first: str = "score_1", second: str = "score_2") -> DataFrame:
    """Two scores to the contract: the first lexicon decides, agreement is confidence."""
    a = F.coalesce(first, F.lit(0.0))
    b = F.coalesce(second, F.lit(0.0))
    return (
        df.withColumn("sentiment", F.when(blank, "neg").otherwise(side(a)))
        .withColumn("polarity", F.when(blank, 0.0).otherwise(a))
        .withColumn("sentiment_confidence", F.when(blank, False).otherwise(side(a) == side(b)))
        .drop(first, second)
    )


def resolve_probabilities(df: DataFrame, probabilities: str = "probabilities", text: str | None = None) -> DataFrame:
    """Class probabilities to the contract.

    A neutral output goes to the likelier side, without confidence; ties are
    'pos'. Polarity is P(POS) - P(NEG). With ``text``, blank rows are neutral
    negatives as on the lexicon route.
    """
    p = F.col(probabilities)
    output = p["output"]
    label = F.when(output == "NEU", F.when(p["p_pos"] >= p["p_neg"], "pos").otherwise("neg")).otherwise(
        F.when(output == "POS", "pos").otherwise("neg")
    )
    polarity = p["p_pos"] - p["p_neg"]
    confident = output != "NEU"
    if text is not None:
        blank = is_blank(F.col(text))
        label = F.when(blank, "neg").otherwise(label)
        polarity = F.when(blank, 0.0).otherwise(polarity)
        confident = F.when(blank, False).otherwise(confident)
    return (
        df.withColumn("sentiment", label)
        .withColumn("polarity", polarity)
        .withColumn("sentiment_confidence", confident)
    )


# --- Lexicon route -------------------------------------------------------------


def merge_lexicons(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("token",)) -> DataFrame:
    """One table (keys, valence_1, valence_2): both lexicons cost one lookup."""
    keys = list(keys)
    a = first.groupBy(keys).agg(F.avg("valence").alias("valence_1"))
    b = second.groupBy(keys).agg(F.avg("valence").alias("valence_2"))
    return a.join(b, keys, "full_outer")


def lexicon_scores(
    df: DataFrame,
    lexicon: DataFrame,
    tokens: str = "tokens",
    row_id: str = "row_id",
    keys: Sequence[str] = ("token",),
    negation: str = "mute",
    carry: Sequence[str] = (),
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """(row_id, *carry, n_tokens, score_1, score_2) for every row, hits or none.

    ``score_1`` is the compound of the summed first valences; ``score_2`` the mean
    of the second valences that hit. ``negation``: a ``NEG_`` token is unknown to
    the lexicon ("mute") or counts as its word times -0.74 ("flip"). A row's
    tokens leave the explode next to each other, so the map-side aggregate sends
    one line per comment into the shuffle. A lexicon of more than ``max_rows`` words
    adds one line per comment and rare word of the lexicon. Which words are rare is
    counted in a part of the rows, unless the lexicon has a column ``frequency`` (in how many
    rows its words occur, say); that changes no score.
    """
    keys = list(keys)
    side_keys = [k for k in keys if k != "token"]
    wanted = list(dict.fromkeys([row_id, *side_keys, *carry]))
    exploded = df.select(*wanted, F.explode_outer(tokens).alias("_word"))
    if negation == "flip":
        negated = F.startswith("_word", F.lit(NEGATION_PREFIX))
        exploded = exploded.withColumn("_factor", F.when(negated, NEGATION_FLIP).otherwise(1.0)).withColumn(
            "token", F.when(negated, F.substring("_word", len(NEGATION_PREFIX) + 1, 2**31 - 1)).otherwise(F.col("_word"))
        )
    elif negation == "mute":
        exploded = exploded.withColumn("_factor", F.lit(1.0)).withColumn("token", F.col("_word"))
    else:
        raise ValueError(f"negation must be 'mute' or 'flip', not {negation!r}")
    grouping = list(dict.fromkeys([row_id, *carry]))
    lexicon = cut_lineage(lexicon)
    given = lexicon.drop(FREQUENCY)
    if fits_broadcast(given, max_rows):
        sums = _summed(exploded.join(F.broadcast(given), keys, "left"), grouping)
    elif FREQUENCY in lexicon.columns:
        counted = lexicon.groupBy(*keys).agg(F.max(FREQUENCY).alias("_n"))
        sums = _sums_of_large(exploded, counted, given, keys, grouping, max_rows)
    else:
        drawn = exploded.where(F.pmod(F.xxhash64(row_id), F.lit(_DRAWN)) == 0)
        counted = drawn.where(F.col("_word").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
        sums = _sums_of_large(exploded, counted, given, keys, grouping, max_rows)
    return sums.select(
        *grouping,
        "n_tokens",
        compound(F.col("_sum_1")).alias("score_1"),
        F.coalesce(F.try_divide("_sum_2", "_hits_2"), F.lit(0.0)).alias("score_2"),
    )


def _summed(hits: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Number of words, their factors and the sums of both valences: a hash aggregate over fixed-width values."""
    second = F.col("valence_2") * F.col("_factor")
    return hits.groupBy(*by).agg(
        F.count("_word").alias("n_tokens"),
        F.sum("_factor").alias("_factors"),
        F.sum(F.col("valence_1") * F.col("_factor")).alias("_sum_1"),
        F.sum(second).alias("_sum_2"),
        F.count(second).alias("_hits_2"),
    )


def _sums_of_large(
    words: DataFrame, counted: DataFrame, lexicon: DataFrame, keys: list[str], grouping: list[str], max_rows: int
) -> DataFrame:
    """The same sums for a lexicon too large to broadcast: only its rare words are shuffled.

    The most frequent words by ``counted`` (keys, _n) are broadcast with their valences, or with the
    knowledge that they have none. They settle most of the text in the pass that reads it. Of the rest, words
    that no mark of the lexicon's other words fits are in no lexicon and settled too; the others leave the pass
    as one line per comment and rare word, which is looked up by a join: by broadcast if at most ``max_rows``
    words are left. Which words are taken for frequent, and which fit a mark by
    chance, sets what is shuffled, not what is returned.
    """
    short = counted.where(F.octet_length("token") <= FREQUENT_BYTES)
    top = short.orderBy(F.desc("_n"), *keys).limit(FREQUENT_WORDS).drop("_n")
    frequent = cut_lineage(top.join(lexicon, keys, "left").withColumn("_settled", F.lit(True)))
    lexicon = cut_lineage(lexicon.join(F.broadcast(frequent.select(*keys)), keys, "left_anti"))
    marks = _marks(lexicon)
    met = words.join(F.broadcast(frequent), keys, "left")
    place = F.when(F.col("_word").isNotNull() & F.col("_settled").isNull(), _mark_place())
    met = met.withColumn("_place", place).join(F.broadcast(marks), "_place", "left")
    open_word = F.when(F.getbit("_bits", _mark_bit()) == 1, F.struct(*keys))
    met = staged_columns(_summed(met, [*grouping, open_word.alias("_open")]), "words")
    rare = met.where(F.col("_open").isNotNull()).select(
        *grouping, *[F.col("_open")[k].alias(k) for k in keys if k not in grouping], "n_tokens", "_factors"
    )
    left = F.broadcast(lexicon) if fits_broadcast(lexicon, max_rows) else lexicon
    found = rare.join(left, keys, "left").select(
        *grouping,
        "n_tokens",
        (F.col("valence_1") * F.col("_factors")).alias("_sum_1"),
        (F.col("valence_2") * F.col("_factors")).alias("_sum_2"),
        F.when(F.col("valence_2").isNotNull(), F.col("n_tokens")).otherwise(0).alias("_hits_2"),
    )
    settled = met.where(F.col("_open").isNull()).drop("_open", "_factors")
    return settled.unionByName(found).groupBy(*grouping).agg(
        *[F.sum(c).alias(c) for c in ("n_tokens", "_sum_1", "_sum_2", "_hits_2")]
    )


def _mark_place() -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(_MARKS)).cast("int")


def _mark_bit() -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64("token"), 32), F.lit(64)).cast("int")


def _marks(lexicon: DataFrame) -> DataFrame:
    """(_place, _bits): one bit per word, at most ``_MARKS`` rows whatever the lexicon; words may share a bit."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _mark_bit())
    marked = lexicon.select(_mark_place().alias("_place"), bit.alias("_bit"))
    return cut_lineage(marked.groupBy("_place").agg(F.bit_or("_bit").alias("_bits")))


def lexicon_labels(df: DataFrame, lexicon: DataFrame, carry: Sequence[str] = (), **options) -> DataFrame:
    """(row_id, *carry, and the contract), without going back to the texts.

    A row without tokens is blank. One pass, and one line per comment shuffled:
    ``carry`` takes short columns along (language, source, flags).
    """
    scores = lexicon_scores(df, lexicon, carry=carry, **options)
    return resolve_lexicon(scores, F.col("n_tokens") == 0).drop("n_tokens")


# --- Model route ---------------------------------------------------------------


def predictor_expression(load_model: Callable[[], PredictBatch], batch: int = PREDICT_BATCH) -> Callable[[Column], Column]:
    """A column function: texts to ``struct<output, p_pos, p_neg, p_neu>``.

    ``load_model`` runs once per task; its model takes at most ``batch`` texts and
    returns ``(output, p_pos, p_neg, p_neu)`` for each.
    """

    @F.pandas_udf(PROBABILITIES)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for texts in batches:
            rows: list[tuple[str, float, float, float]] = []
            for start in range(0, len(texts), batch):
                rows.extend(model(texts.iloc[start : start + batch].tolist()))
            yield pd.DataFrame(rows, columns=["output", "p_pos", "p_neg", "p_neu"])

    return predict


def fit_classifier(labelled: DataFrame, tokens: str = "tokens", label: str = "label", features: int = 1 << 16) -> PipelineModel:
    """The built-in predictor: hashed TF-IDF and logistic regression.

    Labels: 0 negative, 1 positive and, if present, 2 neutral.
    """
    stages = [
        HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        LogisticRegression(
            featuresCol="_features", labelCol="_label", probabilityCol="_probability",
            rawPredictionCol="_raw", predictionCol="_prediction", maxIter=20, regParam=0.01,
        ),
    ]
    rows = labelled.select(tokens, F.col(label).cast("double").alias("_label")).persist()
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def classify(df: DataFrame, model: PipelineModel, out: str = "probabilities") -> DataFrame:
    """Add the probability struct; the output is the likeliest class. All JVM work."""
    classes = model.stages[-1].numClasses
    p = vector_to_array("_probability")
    p_neu = p[2] if classes > 2 else F.lit(0.0)
    scored = model.transform(df).withColumn("_p", F.struct(p[1].alias("pos"), p[0].alias("neg"), p_neu.alias("neu")))
    q = F.col("_p")
    output = (
        F.when((q["neu"] > q["pos"]) & (q["neu"] > q["neg"]), "NEU")
        .when(q["pos"] >= q["neg"], "POS")
        .otherwise("NEG")
    )
    return scored.withColumn(
        out,
        F.struct(
            output.alias("output"), q["pos"].alias("p_pos"), q["neg"].alias("p_neg"), q["neu"].alias("p_neu")
        ),
    ).drop("_tf", "_features", "_raw", "_probability", "_prediction", "_p")


# --- Dispatch and summaries ------------------------------------------------------


def analyse_sentiment(
    df: DataFrame,
    lexicon: DataFrame,
    predict: Callable[[DataFrame], DataFrame] | None = None,
    keys: Sequence[str] = ("token",),
    lang: str = "lang",
    row_id: str = "row_id",
    negation: str = "mute",
) -> DataFrame:
    """Label every row by the route its language is registered for.

    ``lexicon`` comes from ``merge_lexicons``. ``predict`` adds a ``probabilities``
    struct; without it every language takes the lexicon route.
    """
    codes = [l.code for l in LANGUAGES if l.scorer == "lexicon"]
    on_lexicon = F.lit(True) if predict is None else F.coalesce(F.col(lang).isin(codes), F.lit(False))
    lexicon_rows = df.where(on_lexicon)
    labels = lexicon_labels(lexicon_rows, lexicon, row_id=row_id, keys=keys, negation=negation)
    lexicon_side = lexicon_rows.join(labels, row_id)
    if predict is None:
        return lexicon_side
    model_side = resolve_probabilities(predict(df.where(~on_lexicon)), text="clean_text")
    return lexicon_side.unionByName(model_side.drop("probabilities"))


def split_sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("sentiment") == "pos"), df.where(F.col("sentiment") == "neg")


def sentiment_summary(df: DataFrame, *by: str) -> DataFrame:
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(
        F.count_if(F.col("sentiment") == "pos").alias("n_pos"),
        F.count_if(F.col("sentiment") == "neg").alias("n_neg"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.avg(F.col("sentiment_confidence").cast("int")), F.lit(0.0)).alias("confidence_rate"),
    )


def side_sizes(df: DataFrame, min_rows: int = MIN_SIDE_ROWS) -> DataFrame:
    """(sentiment, n_rows, is_small): both sides, also one with no rows."""
    counts = df.agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in SIDES])
    listed = counts.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("sentiment"), F.col(s).alias("n_rows")) for s in SIDES])).alias("s")
    ).select("s.*")
    return listed.withColumn("is_small", F.col("n_rows") < min_rows)
