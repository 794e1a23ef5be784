"""Language registry, stopword lists and the topic-name dictionary.

All are small fixed tables. They are offered both as Python values, so that they
fold into expressions as literals, and as DataFrames for joins.
"""

from __future__ import annotations

import re
import zipfile
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    code: str
    stopword_list: str
    scorer: str  # "lexicon": token lookups; "model": a predictor gives probabilities
    negations: tuple[str, ...] = field(default=())

    @property
    def marks_negation(self) -> bool:
        """Only the lexicon route rewrites the text; models read syntax themselves."""
        return self.scorer == "lexicon"


# Supported languages and their negation words.
LANGUAGES: tuple[Language, ...] = (
    Language(
        "es",
        "spanish",
        "model",
        (
            "no",
            "nunca",
            "jamás",
            "tampoco",
            "sin",
            "ni",
            "nada",
            "nadie",
            "ningún",
            "ninguna",
        ),
    ),
    Language(
        "en",
        "english",
        "lexicon",
        (
            "not",
            "never",
            "no",
            "neither",
            "nor",
            "without",
            "hardly",
            "barely",
            "scarcely",
        ),
    ),
    Language("fr", "french", "model"),
    Language("de", "german", "model"),
    Language("pt", "portuguese", "model"),
)
LANGUAGE_CODES = tuple(language.code for language in LANGUAGES)

# Fixed values: (pattern, topic name), in matching order.
TOPIC_NAMES: tuple[tuple[str, str], ...] = (
    ("precio", "Pricing"),
    ("costo", "Pricing"),
    ("coste", "Pricing"),
    ("dinero", "Pricing"),
    ("caro", "Pricing"),
    ("barato", "Pricing"),
    ("price", "Pricing"),
    ("cost", "Pricing"),
    ("value", "Pricing"),
    ("expensive", "Pricing"),
    ("cheap", "Pricing"),
    ("prix", "Pricing"),
    ("coût", "Pricing"),
    ("cher", "Pricing"),
    ("preis", "Pricing"),
    ("kosten", "Pricing"),
    ("teuer", "Pricing"),
    ("billig", "Pricing"),
    ("preço", "Pricing"),
    ("custo", "Pricing"),
    ("calidad", "Quality"),
    ("quality", "Quality"),
    ("qualité", "Quality"),
    ("qualität", "Quality"),
    ("qualidade", "Quality"),
    ("servicio", "Service"),
    ("serviço", "Service"),
    ("service", "Service"),
    ("atención", "Service"),
    ("personal", "Service"),
    ("staff", "Service"),
    ("personnel", "Service"),
    ("dienst", "Service"),
    ("pessoal", "Service"),
    ("ubicación", "Location"),
    ("ubicacion", "Location"),
    ("lugar", "Location"),
    ("location", "Location"),
    ("emplacement", "Location"),
    ("lage", "Location"),
    ("localização", "Location"),
    ("habitación", "Room"),
    ("habitacion", "Room"),
    ("room", "Room"),
    ("chambre", "Room"),
    ("zimmer", "Room"),
    ("quarto", "Room"),
    ("limpieza", "Cleanliness"),
    ("limpio", "Cleanliness"),
    ("clean", "Cleanliness"),
    ("cleanliness", "Cleanliness"),
    ("propreté", "Cleanliness"),
    ("sauberkeit", "Cleanliness"),
    ("sauber", "Cleanliness"),
    ("limpeza", "Cleanliness"),
    ("comida", "Food"),
    ("desayuno", "Food"),
    ("food", "Food"),
    ("breakfast", "Food"),
    ("restaurant", "Food"),
    ("nourriture", "Food"),
    ("petit-déjeuner", "Food"),
    ("frühstück", "Food"),
    ("essen", "Food"),
    ("restaurante", "Food"),
    ("experiencia", "Experience"),
    ("experience", "Experience"),
    ("ambiente", "Atmosphere"),
    ("atmosphere", "Atmosphere"),
    ("decoración", "Atmosphere"),
    ("wifi", "Amenities"),
    ("parking", "Amenities"),
    ("estacionamiento", "Amenities"),
    ("piscina", "Amenities"),
    ("pool", "Amenities"),
    ("gym", "Amenities"),
    ("transporte", "Amenities"),
)


def language(code: str) -> Language:
    for entry in LANGUAGES:
        if entry.code == code:
            return entry
    raise ValueError(
        f"No language is registered as {code!r}; registered are {', '.join(sorted(LANGUAGE_CODES))}."
    )


def language_table(spark: SparkSession) -> DataFrame:
    rows = [(l.code, l.stopword_list, l.scorer, l.marks_negation, list(l.negations)) for l in LANGUAGES]
    return spark.createDataFrame(
        rows,
        "lang string, stopword_list string, scorer string, marks_negation boolean, "
        "negations array<string>",
    )


@lru_cache(maxsize=None)
def _shipped_list(name: str) -> tuple[str, ...]:
    """A stopword list as it ships with Spark ML, with or without a running JVM."""
    import pyspark

    member = f"org/apache/spark/ml/feature/stopwords/{name}.txt"
    for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as archive:
            if member in archive.namelist():
                return tuple(archive.read(member).decode("utf-8").split("\n"))
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(name))


@lru_cache(maxsize=None)
def stopwords(code: str) -> tuple[str, ...]:
    """Stopwords of a language in the form cleaned tokens have; none if unknown.

    ``don't`` loses its apostrophe in cleaning, so the list must lose it too.
    """
    names = [l.stopword_list for l in LANGUAGES if l.code == code]
    if not names:
        return ()
    words = (re.sub(r"[^\w]|[\d_]", "", w.strip().lower()) for w in _shipped_list(names[0]))
    return tuple(sorted({w for w in words if w}))


def stopword_table(spark: SparkSession) -> DataFrame:
    rows = [(code, word) for code in LANGUAGE_CODES for word in stopwords(code)]
    return spark.createDataFrame(rows, "lang string, token string")


def stopword_condition(lang: str, token: str) -> str:
    """SQL text: whether expression ``token`` is a stopword of language ``lang``.

    Literal lists this long become hash sets. As text it can stand inside a
    lambda and costs one parse.
    """
    cases = " ".join(
        f"WHEN '{code}' THEN {token} IN ({', '.join(repr(w) for w in stopwords(code))})" for code in LANGUAGE_CODES
    )
    return f"coalesce(CASE {lang} {cases} END, false)"


def is_stopword(lang: str, token: str) -> Column:
    return F.expr(stopword_condition(lang, token))
