import random

import pytest

from sevscale.sources import comments, records, staging

TEXTS = [("1", 'says "hi", then\nleaves'), ("2", "NA"), ("3", "null"), ("4", "a\\b, c"), ("5", None)]


def test_comment_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "id string, comment_text string")
    comments.write_comments(df, str(tmp_path / "c"))
    got = comments.read_comments(spark, str(tmp_path / "c"), comments.TEXT_SCHEMA)
    assert sorted((r.id, r.comment_text) for r in got.collect()) == TEXTS


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        'toxic,extra,id,comment_text,severe_toxic,obscene,threat,insult,identity_hate\n'
        '1.0,x,a1,"two ""words""\nand a line",0,0,,0,-1\n')
    row = comments.read_comments(spark, str(tmp_path / "f.csv"), comments.FLAG_SCHEMA).first()
    assert row.comment_text == 'two "words"\nand a line'
    assert (row.id, row.toxic, row.threat, row.identity_hate) == ("a1", 1, None, -1)


def test_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,comment_text\n1,one\n")
    (tmp_path / "b.csv").write_text("comment_text,id\ntwo,2\n")
    with pytest.raises(Exception):
        comments.read_comments(spark, str(tmp_path), comments.TEXT_SCHEMA).collect()


def test_parquet_conversion(spark, tmp_path):
    (tmp_path / "f.csv").write_text("comment_id,text\n5,hello\n6,\n")
    got = comments.comments_to_parquet(
        spark, str(tmp_path / "f.csv"), comments.TO_SCORE_SCHEMA, str(tmp_path / "p"))
    assert sorted(got.collect()) == [(5, "hello"), (6, None)]


def test_submission(spark, tmp_path):
    df = spark.createDataFrame([(9, "t", 1), (8, "u", 2)], "comment_id long, text string, score int")
    comments.write_submission(df, str(tmp_path / "s"))
    got = spark.read.csv(str(tmp_path / "s"), header=True)
    assert got.columns == ["comment_id", "score"]
    assert sorted(got.collect()) == [("8", "2"), ("9", "1")]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_scored_pairs(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 0.1, 0.2)], "pair_id long, p1 double, p2 double")
    comments.write_scored_pairs(df, str(tmp_path / fmt), fmt)
    read = spark.read.parquet if fmt == "parquet" else lambda p: spark.read.csv(p, header=True)
    assert read(str(tmp_path / fmt)).count() == 1
    with pytest.raises(ValueError):
        comments.write_scored_pairs(df, str(tmp_path / "x"), "xml")


def test_staging_uses_the_set_folder(spark):
    set_folder = spark.conf.get("spark.checkpoint.dir", None)
    root = staging.staging_root(spark)
    assert set_folder is None or root == set_folder
    df = spark.range(10)
    assert staging.stage(df).count() == 10


def csv_of(rows, end="\n"):
    import csv
    import io

    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows([("id", "comment_text"), *rows])
    return out.getvalue()


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def use(size):
        for k, v in zip(keys, (size, 1)):
            spark.conf.set(k, str(v))

    yield use
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [16, 61, 4000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_is_read_in_ranges(spark, tmp_path, small_ranges, size, end):
    draw = random.Random(size)
    words = ['"', "\n", '""', ",", "a", "é", "long text ", "\n\n", '"\n"', "NA"]
    rows = [(str(i), "".join(draw.choices(words, k=draw.randrange(1, 12)))) for i in range(40)]
    rows += [("x", "\n" * 300 + '"' * 5), ("y", "z" * 500), ("z", "end\n")]
    (tmp_path / "f.csv").write_bytes(("﻿" + csv_of(rows, end)).encode())
    small_ranges(size)
    df = comments.read_comments(spark, str(tmp_path / "f.csv"), comments.TEXT_SCHEMA)
    assert sorted((r.id, r.comment_text) for r in df.collect()) == sorted(rows)
    ranges = records.file_lines(spark, str(tmp_path / "f.csv")).select("start").distinct().count()
    assert ranges >= min(8, 1500 // size)


def test_a_range_border_at_every_byte(spark, tmp_path, small_ranges):
    rows = [("1", 'q"\n"'), ("2", "\n\n"), ("3", "plain"), ("4", 'a,"b"\n')]
    data = csv_of(rows).encode()
    (tmp_path / "f.csv").write_bytes(data)
    for size in range(1, len(data) + 1, 6):
        small_ranges(size)
        df = comments.read_comments(spark, str(tmp_path / "f.csv"), comments.TEXT_SCHEMA)
        assert sorted((r.id, r.comment_text) for r in df.collect()) == rows


def test_folder_of_files_with_blank_lines_and_open_quotes(spark, tmp_path, small_ranges):
    (tmp_path / "c").mkdir()
    for i in range(3):
        (tmp_path / "c" / f"{i}.csv").write_text(f'\n\nid,comment_text\n\n{i},"one\ntwo"\n\n')
    small_ranges(9)
    got = comments.read_comments(spark, str(tmp_path / "c"), comments.TEXT_SCHEMA)
    assert sorted((r.id, r.comment_text) for r in got.collect()) == [(str(i), "one\ntwo") for i in range(3)]
    (tmp_path / "c" / "3.csv").write_text('id,comment_text\n7,"never closed\n')
    with pytest.raises(Exception, match="never closed"):
        comments.read_comments(spark, str(tmp_path / "c"), comments.TEXT_SCHEMA).collect()


def test_headers_without_or_with_repeated_names(spark, tmp_path):
    (tmp_path / "f.csv").write_text(",id,comment_text,x,x\n0,a,b,1,2\n")
    row = comments.read_comments(spark, str(tmp_path / "f.csv"), comments.TEXT_SCHEMA).first()
    assert (row.id, row.comment_text) == ("a", "b")


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,comment_text\n")
    assert comments.read_comments(spark, str(tmp_path / "f.csv"), comments.TEXT_SCHEMA).collect() == []


def test_staging_leaves_no_shuffle_files_and_no_setting(spark, tmp_path):
    """Loops stage a table a round: what a round shuffled goes with it, and the session keeps its own setting."""
    def files():
        folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = folder.getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "shuffle_" in f}

    assert spark.conf.get(staging.CLEANUP) == "false"
    before = files()
    with staging._cleaned(spark):  # overlaps
        rows = staging.stage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
        assert spark.conf.get(staging.CLEANUP) == "true"
    assert spark.conf.get(staging.CLEANUP) == "false"
    assert not files() - before
    assert rows.count() == 7
