"""Quoted CSV read by many tasks a file, against Spark's reader of whole files."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from commentarium.sources import comments as cm
from commentarium.sources import records as rc

PLANTED = 'id,"two\nlines",c\n1,"a\n\n""b"", c",x\n\n2,5" pipe,"y"\n3,"",\n4,"last\nline","""q"""\n5, "sp,z\n6,"é\n"tail,w\n'


@contextmanager
def splits_of(spark, n_bytes):
    """CSV files cut every ``n_bytes`` bytes, whatever their size; what is staged is read as usual."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    staged = rc.staged_columns

    def restore():
        for name, value in zip(names, before):
            spark.conf.set(name, value)

    def staged_then_restored(df, name):
        found = staged(df, name)
        restore()
        return found

    for name in names:
        spark.conf.set(name, str(n_bytes))
    rc.staged_columns = staged_then_restored
    try:
        yield
    finally:
        rc.staged_columns = staged
        restore()


def whole_files(spark, path, columns):
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(str(path)).collect()
    return sorted(map(tuple, rows), key=repr)


def cut(spark, path, **options):
    df = cm.read_csv(spark, str(path), parallel=True, **options)
    return df.columns, sorted(map(tuple, df.collect()), key=repr)


def plain_ends_inside(line, inside):
    """Character by character."""
    state = "quoted" if inside else "start"
    for c in line:
        if state == "quoted":
            state = "closed" if c == '"' else "quoted"
        elif state == "closed" and c == '"':
            state = "quoted"
        elif c == ",":
            state = "start"
        else:
            state = "quoted" if state == "start" and c == '"' else "plain"
    return state == "quoted"


def test_state_after_a_line_equals_a_scan_by_character():
    draw = random.Random(5)
    for _ in range(20_000):
        line = "".join(draw.choices('",a ', k=draw.randrange(9)))
        for inside in (False, True):
            assert rc.ends_inside(line.encode(), inside) == plain_ends_inside(line, inside), (line, inside)


@pytest.mark.parametrize("n_bytes", [1, 7, 31])
def test_any_cut_gives_the_rows_of_the_whole_file(spark, tmp_path, n_bytes):
    (tmp_path / "a.csv").write_bytes(PLANTED.encode())
    want = whole_files(spark, tmp_path, ["id", "two\nlines", "c"])
    assert len(want) == 6
    with splits_of(spark, n_bytes):
        assert cut(spark, tmp_path) == (["id", "two\nlines", "c"], want)


def test_random_fields_in_many_files_and_splits(spark, tmp_path):
    draw = random.Random(11)

    def field():
        text = "".join(draw.choices(['"', ",", "\n", "a", "ñ", " "], weights=[1, 1, 1, 4, 1, 1], k=draw.randrange(12)))
        return '"' + text.replace('"', '""') + '"'

    for name, end in (("a", "\n"), ("b", "\n"), ("c", "\r\n")):
        lines = ["k,v"] + [f"{k},{field()}" for k in range(200)]
        (tmp_path / f"{name}.csv").write_bytes((end.join(lines) + end).encode())
    want = whole_files(spark, tmp_path, ["k", "v"])
    with splits_of(spark, 400):
        assert rc.split_states(spark, str(tmp_path)).where("inside").count() > 3
        assert cut(spark, tmp_path) == (["k", "v"], want)


def test_states_too_many_to_broadcast(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes(PLANTED.encode())
    want = whole_files(spark, tmp_path, ["id", "two\nlines", "c"])
    monkeypatch.setattr(rc, "fits_broadcast", lambda states: False)
    with splits_of(spark, 9):
        assert cut(spark, tmp_path)[1] == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f'{k},"x\ny"\n' for k in range(5000)))
    with splits_of(spark, 4000):
        found = rc.records(spark, str(tmp_path / "a.csv"))
        assert found.select("start").distinct().count() >= 8
    with splits_of(spark, 4000):
        loaded = cm.read_csv(spark, str(tmp_path / "a.csv"))  # larger than a split: chosen by itself
        assert loaded.where("v = 'x\\ny'").count() == 5000
        assert len(loaded.inputFiles()) > 1 and not any(f.endswith(".csv") for f in loaded.inputFiles())


def test_encodings_and_column_orders_are_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("frase,nota\n\"oto\nño\",1\n".encode())
    (tmp_path / "b.csv").write_bytes(b"nota,frase\r\n2,\"Pi\xf1a\r\nta\"\r\n")
    (tmp_path / "c.csv").write_bytes("﻿frase\ntrés".encode())
    (tmp_path / "d.csv").write_bytes(b"")
    with splits_of(spark, 5):
        columns, rows = cut(spark, tmp_path)
    found = {(r[columns.index("frase")], r[columns.index("nota")]) for r in rows}
    assert found == {("oto\nño", "1"), ("Pi\xf1a\r\nta", "2"), ("trés", None)}


def test_header_with_a_line_break_is_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"my\nwords",n\nuno,1\n')
    df = cm.read_csv(spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [("uno", "1")] and df.columns == ["my\nwords", "n"]


def test_empty_files_and_given_names(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\n\n")
    assert cm.read_csv(spark, str(tmp_path), parallel=True).count() == 0
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    columns, rows = cut(spark, tmp_path / "b.csv", columns=["x", "y"], encoding="UTF-8")
    assert columns == ["x", "y"] and rows == [("1", "2")]


def test_a_very_long_field_spans_many_splits(spark, tmp_path):
    text = ("line, \n" * 3000).strip()
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{text}"\n2,z\n')
    with splits_of(spark, 2000):
        df = cm.read_csv(spark, str(tmp_path), parallel=True)
        assert df.where(F.col("v") == text).count() == 1 and df.count() == 2
