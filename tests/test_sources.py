import pytest
from pyspark.sql import functions as F

from commentarium.sources import comments as cm
from commentarium.sources import languages as lg
from commentarium.sources import sinks


def write(path, data: bytes):
    path.write_bytes(data)
    return str(path)


def test_utf8_keeps_extra_columns(spark, tmp_path):
    path = write(tmp_path / "a.csv", "opinion,stars,day\nCama cómoda,5,mon\n\"dos\nlíneas, \"\"sí\"\"\",4,tue\n".encode())
    df = cm.load_comments(spark, path, "opinion", lang="es")
    rows = df.orderBy("stars").collect()
    assert [r["raw_text"] for r in rows] == ["dos\nlíneas, \"sí\"", "Cama cómoda"]
    assert set(df.columns) == {"opinion", "stars", "day", "row_id", "raw_text", "lang"}


def test_latin1_fallback_is_per_file(spark, tmp_path):
    write(tmp_path / "b.csv", b"frase,nota\nPi\xf1ata,2\nJam\xf3n,9\n")
    write(tmp_path / "c d.csv", "frase,nota\notoño,1\n".encode())
    df = cm.load_comments(spark, str(tmp_path), "frase")
    assert {r["raw_text"] for r in df.collect()} == {"Piñata", "Jamón", "otoño"}
    assert df.select("row_id").distinct().count() == 3


def test_files_may_order_their_columns_differently(spark, tmp_path):
    write(tmp_path / "a.csv", "words,stars\nuno,1\n".encode())
    write(tmp_path / "b.csv", 'stars,"words",place\n2,"dos, ó",x\n'.encode())
    write(tmp_path / "c.csv", "\ufeffplace,words\r\ny,tr\u00e9s\r\n".encode("utf-8"))
    write(tmp_path / "d.csv", b"words\ncu\xe1tro\n")
    rows = cm.read_csv(spark, str(tmp_path)).collect()
    assert {(r["words"], r["stars"], r["place"]) for r in rows} == {
        ("uno", "1", None), ("dos, ó", "2", "x"), ("trés", None, "y"), ("cuátro", None, None)
    }


def test_missing_marks_are_dropped(spark, tmp_path):
    path = write(tmp_path / "d.csv", b"n,words\n1,first line\n2,\n3,NULL\n4,n/a\n5,last line\n")
    assert [r["raw_text"] for r in cm.load_comments(spark, path, "words").collect()] == ["first line", "last line"]


def test_all_missing_is_an_error(spark, tmp_path):
    path = write(tmp_path / "e.csv", b"n,words\n7,NA\n8,\n")
    with pytest.raises(ValueError, match="No rows"):
        cm.load_comments(spark, path, "words")


def test_unknown_column_lists_the_others(spark, tmp_path):
    path = write(tmp_path / "f.csv", b"opinion,stars,day\nfine,5,mon\n")
    with pytest.raises(ValueError, match="opinion, stars, day"):
        cm.load_comments(spark, path, "comment")


def test_numbers_are_read_as_text(spark, tmp_path):
    path = write(tmp_path / "g.csv", b"text\n12\n")
    assert cm.load_comments(spark, path, "text").first()["raw_text"] == "12"


def test_split_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "La Paz"), (2, "Huatulco"), (3, "La Paz")], "id bigint, place string")
    sinks.write_split(df, str(tmp_path / "out"), "place", "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sinks.read_split(back, "place", "La Paz").count() == 2
    assert back.count() == 3


def test_run_folder_is_written_once(spark, tmp_path):
    df = spark.range(3)
    base = sinks.write_run({"kpi": df}, str(tmp_path), "r1", {"concept": "precio"}, "json")
    assert spark.read.json(f"{base}/parameters").first()["concept"] == "precio"
    with pytest.raises(FileExistsError, match="r1"):
        sinks.write_run({"kpi": df}, str(tmp_path), "r1")


def test_half_written_run_does_not_block_its_retry(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/run_id=r2/kpi")
    base = sinks.write_run({"kpi": spark.range(3)}, str(tmp_path), "r2")
    assert spark.read.parquet(f"{base}/kpi").count() == 3


def test_language_checks(spark):
    df = spark.createDataFrame([(1, "en"), (2, "xx"), (3, None)], "row_id bigint, lang string")
    assert lg.unsupported(df).count() == 2
    assert lg.with_language(df).where(F.col("scorer") == "lexicon").count() == 1
    with pytest.raises(ValueError, match="No language is registered"):
        lg.require_supported(df)
    lg.require_supported(df.where("lang = 'en'"))
