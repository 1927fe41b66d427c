"""CSV files read in ranges, against the reader that takes a file whole."""

import random

import pytest

from postscreen.sources import posts as whole
from postscreen.sources import ranges

SCHEMA = "id long, text string, label string"


@pytest.fixture()
def small_ranges(spark):
    """Ranges of a 1,500 bytes, so that records lie across many borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(((tuple(r)) for r in df.collect()), key=repr)


def both(spark, path, **options):
    return rows(ranges.read_posts_by_ranges(spark, path, SCHEMA, **options)), rows(whole.read_posts(spark, path, SCHEMA, **options))


def random_text(draw):
    """Texts of words, delimiters, quotes and line breaks; some are far longer than a range."""
    parts = draw.choices(["a", "bc", " ", ",", '"', "\n", "\n\n", "é", "\U0001f600", ';"', ',"'], k=draw.choice([0, 1, 5, 30, 900]))
    return "".join(parts)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_as_the_whole_file(spark, small_ranges, tmp_path, end):
    draw = random.Random(3)
    records = ["id,text,label"]
    for i in range(250):
        text = random_text(draw).replace('"', '""').replace("\n", end)
        records.append(f'{i},"{text}",{draw.choice(["0", "1", "", "nan"])}')
    (tmp_path / "posts.csv").write_bytes((end.join(records) + end).encode())
    got, want = both(spark, f"{tmp_path}/posts.csv")
    assert len(want) == 250 and got == want
    assert ranges._lines(spark, f"{tmp_path}/posts.csv").rdd.getNumPartitions() > 50


def test_quotes_within_fields_blank_lines_and_no_last_line_end(spark, small_ranges, tmp_path):
    lines = ["id,text,label", '1,a "quoted" word,0', "", '2,5" wide,1', '3,"x, ""y""",0', "4,,", '5,"",1', "6", '7,"a\n\n"",\n",0', "8,z,1,9"]
    (tmp_path / "posts.csv").write_text("\n".join(lines + lines[1:] * 200))
    got, want = both(spark, f"{tmp_path}/posts.csv")
    assert len(want) == 8 * 201 and got == want


def test_several_files_other_columns_and_delimiter(spark, small_ranges, tmp_path):
    for name in ("a", "b"):
        body = "".join(f'x;"line {i}\nof ""{name}""; text";{i};0\n' for i in range(300))
        (tmp_path / f"{name}.csv").write_text("more;text;id;label\n" + body)
    paths = [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]
    got, want = both(spark, paths, delimiter=";")
    assert len(want) == 600 and got == want
    with pytest.raises(ValueError):
        ranges.read_posts_by_ranges(spark, paths, "absent string", delimiter=";")


def test_tolerant(spark, small_ranges, tmp_path):
    body = "".join(f'{i},"a\n,{i}",0\n' + (f'{i},"b\n",1,"too, many"\n' if i % 3 == 0 else f"{i}\n") for i in range(300))
    (tmp_path / "posts.csv").write_text("id,text,label\n" + body)
    path = f"{tmp_path}/posts.csv"
    for got, want in zip(ranges.read_tolerant_by_ranges(spark, path, SCHEMA), whole.read_tolerant(spark, path, SCHEMA), strict=True):
        assert rows(got) == rows(want)


def test_header_only_and_empty_files(spark, tmp_path):
    (tmp_path / "head.csv").write_text("id,text,label\n")
    assert ranges.read_posts_by_ranges(spark, f"{tmp_path}/head.csv", SCHEMA).isEmpty()
    (tmp_path / "none.csv").write_text("")
    empty = ranges.read_posts_by_ranges(spark, f"{tmp_path}/none.csv", SCHEMA)
    assert empty.isEmpty() and empty.columns == ["id", "text", "label"]


@pytest.mark.parametrize("line", ['a,"b', 'a"b', '"a""', '"a"",b', '"a"b,"c', "", '"', '""', '"""', 'x",y', 'x","y', '""x,"', 'é,"""'])
def test_ends_inside_equals_an_automaton(line):
    for inside in (False, True):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "closing" if c == '"' else "quoted"
            elif state == "closing" and c == '"':
                state = "quoted"
            elif c == ",":
                state = "start"
            else:
                state = "quoted" if state == "start" and c == '"' else "bare"
        assert ranges.ends_inside(line, inside, ",") == (state == "quoted")
