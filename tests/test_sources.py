import pytest
from pyspark.sql import functions as F

from postscreen.sources.posts import (
    read_posts,
    read_tolerant,
    require_columns,
    write_counts,
    write_parts,
    write_posts,
)
from tests.conftest import rows

AWKWARD = [
    (0, 'line one\nline "two", end'),
    (1, "  edge blanks\t"),
    (2, "back\\slash, and \\\"quote"),
    (3, '"quoted"'),
    (4, "emoji \U0001f600 and ünïcode"),
    (5, "a\r\nb"),
    (6, ","),
    (7, '""'),
]


def test_round_trip_keeps_every_text(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, "k long, text string")
    write_posts(df.repartition(3), f"{tmp_path}/csv")
    back = read_posts(spark, f"{tmp_path}/csv", "k long, text string")
    assert rows(back) == AWKWARD


def test_empty_and_missing_read_as_missing(spark, tmp_path):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "null"), (3, "NaN"), (4, "x")], "k long, text string")
    write_posts(df, f"{tmp_path}/csv")
    back = read_posts(spark, f"{tmp_path}/csv", "k long, text string")
    assert rows(back) == [(0, None), (1, None), (2, None), (3, None), (4, "x")]
    kept = read_posts(spark, f"{tmp_path}/csv", "k long, text string", na_values=[""])
    assert rows(kept)[2:4] == [(2, "null"), (3, "NaN")]


def test_types_are_declared_not_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,depressive\nx,1\ny,1.0\nz,\n")
    got = read_posts(spark, f"{tmp_path}/a.csv", "text string, depressive string")
    assert rows(got) == [("x", "1"), ("y", "1.0"), ("z", None)]
    numbers = read_posts(spark, f"{tmp_path}/a.csv", "text string, depressive int")
    assert rows(numbers) == [("x", 1), ("y", None), ("z", None)]


def test_records_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,depressive\n"one\n\ntwo ""x"", y",1\nplain,1\n"three\nfour",1\n')
    got = read_posts(spark, f"{tmp_path}/a.csv", "text string, depressive int")
    assert rows(got) == [('one\n\ntwo "x", y', 1), ("plain", 1), ("three\nfour", 1)]


def test_header_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "text string, depressive int")
    write_posts(empty, f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.strip() == "text,depressive"
    assert read_posts(spark, f"{tmp_path}/csv", "text string, depressive int").count() == 0


def test_malformed_records_are_set_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,text\n1,one\n2,two,extra\n3\n4,"a, b"\n5,x,,\n6,"two\nlines",z\n7,"q ""r"", s"\n8,NA\n'
    )
    good, rejected = read_tolerant(spark, f"{tmp_path}/a.csv", "id long, text string")
    assert rows(good) == [(1, "one"), (3, None), (4, "a, b"), (7, 'q "r", s'), (8, None)]
    assert [r[0].split(",")[0] for r in rows(rejected)] == ["2", "5", "6"]


def test_other_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;text\n1;a,b\n2;c;d\n")
    good, rejected = read_tolerant(spark, f"{tmp_path}/a.csv", "id long, text string", delimiter=";")
    assert rows(good) == [(1, "a,b")]
    assert rejected.count() == 1


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    assert require_columns(df, "id", "text") is df
    with pytest.raises(ValueError, match="label, other"):
        require_columns(df, "id", "label", "other")


def test_parts_hold_500_rows_each_with_a_header(spark, tmp_path):
    df = spark.range(1001).select((1000 - F.col("id")).alias("k"), F.lit("a,b").alias("text"))
    write_parts(df, f"{tmp_path}/parts", ["k"], name="posts")
    files = {}
    for path in (tmp_path / "parts").glob("posts_part=*/*.csv"):
        files.setdefault(path.parent.name, []).append(path.read_text().splitlines())
    assert sorted(files) == ["posts_part=1", "posts_part=2", "posts_part=3"]
    assert all(len(f) == 1 and f[0][0] == "k,text" for f in files.values())
    assert [len(files[f"posts_part={i}"][0]) - 1 for i in (1, 2, 3)] == [500, 500, 1]
    assert files["posts_part=2"][0][1:] == [f'{k},"a,b"' for k in range(500, 1000)]


def test_counts_file(spark, tmp_path):
    df = spark.createDataFrame([(0,)] * 5 + [(1,)] * 2 + [(None,)], "depressive int")
    write_counts(df, "depressive", f"{tmp_path}/counts")
    (path,) = (tmp_path / "counts").glob("*.csv")
    assert path.read_text().splitlines() == ["depressive,count", "0,5", "1,2"]


def test_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,other,id\nhello,zzz,7\n")
    assert rows(read_posts(spark, f"{tmp_path}/a.csv", "id long, text string")) == [(7, "hello")]
    good, rejected = read_tolerant(spark, f"{tmp_path}/a.csv", "id long, text string")
    assert (rows(good), rejected.count()) == ([(7, "hello")], 0)
    for read in (read_posts, read_tolerant):
        with pytest.raises(ValueError, match="missing columns: author"):
            read(spark, f"{tmp_path}/a.csv", "id long, author string")


def test_files_with_other_headers_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,one\n")
    (tmp_path / "b.csv").write_text("text,id\ntwo,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_posts(spark, str(tmp_path), "id long, text string").collect()


def test_stray_quotes_cut_nothing_short(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,it"s\n2,it"s, a "b\n3,,extra\n4,a"b,c,d"e\n5,"""q"", s"\n6\n')
    good, rejected = read_tolerant(spark, f"{tmp_path}/a.csv", "id long, text string")
    assert rows(good) == [(1, 'it"s'), (5, '"q", s'), (6, None)]
    assert sorted(r["record"][0] for r in rejected.collect()) == ["2", "3", "4"]


def test_a_long_malformed_record_is_read(spark, tmp_path):
    long = "x, " * 50_000
    (tmp_path / "a.csv").write_text(f'id,text,more\n1,"{long}"\n2,"{long}",a,b\n3,c,d\n')
    good, rejected = read_tolerant(spark, f"{tmp_path}/a.csv", "id long, text string")
    assert [(r[0], len(r[1])) for r in rows(good)] == [(1, len(long)), (3, 1)]
    assert rejected.count() == 1


def test_single_line_files_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,one\n2,two\n")
    got = read_posts(spark, f"{tmp_path}/a.csv", "id long, text string", multi_line=False)
    assert rows(got) == [(1, "one"), (2, "two")]
