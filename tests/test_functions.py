import regex
from pyspark.sql import functions as F

from postscreen.functions import (
    NA_VALUES,
    fill_text,
    first_tokens,
    is_valid_label,
    missing_to_null,
    not_blank,
    parse_label,
    presence_flag,
    remove_emoji,
    strip,
    tokens,
)
from tests.conftest import rows


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_strip_agrees_with_unicode_white_space(spark):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    near = [c for c in points if c.isspace()] + list("​᠎﻿\x00á")
    df = spark.createDataFrame([(c, f"{c}x{c}y{c}") for c in near], "c string, v string")
    for c, stripped, blank in df.select("c", strip(F.col("v")), ~not_blank(F.col("c"))).collect():
        assert stripped == f"{c}x{c}y{c}".strip(), hex(ord(c[0]))
        assert blank == c.isspace()
    assert sum(c.isspace() for c in points) == 29


def test_strip_and_blank_of_missing(spark):
    assert one(spark, None, strip) is None
    assert one(spark, None, not_blank) is False
    assert one(spark, "", not_blank) is False


def test_every_emoji_code_point_is_removed(spark):
    emoji = [
        chr(c)
        for c in range(0xA0, 0x20000)
        if not 0xD800 <= c <= 0xDFFF and regex.match(r"\p{Emoji}", chr(c))
    ]
    single = [c for c in emoji if not "\U0001f1e6" <= c <= "\U0001f1ff"]
    df = spark.createDataFrame([(f"a{c}b",) for c in single], "v string")
    left = df.filter(remove_emoji(F.col("v")) != "ab").collect()
    assert not left


def test_other_code_points_stay(spark):
    other = [
        chr(c)
        for c in range(0x21, 0x1FB00)
        if not 0xD800 <= c <= 0xDFFF
        and not 0xFE0E <= c <= 0xFE0F
        and (c < 0x80 or not regex.match(r"\p{Emoji}", chr(c)))
    ]
    df = spark.createDataFrame([(f"a{c}b",) for c in other], "v string")
    assert df.filter(remove_emoji(F.col("v")) != F.col("v")).count() == 0


def test_emoji_sequences(spark):
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    cases = {
        f"x{family}y": "xy",
        "tea \U0001f600": "tea ",
        "1️⃣ 2 #⃣*": " 2 *",
        "\U0001f1e7\U0001f1f7!": "!",
        "\U0001f1e7!": "\U0001f1e7!",
        "❤️‍\U0001f525.": ".",
        "\U0001f44d\U0001f3fd": "",
        "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f?": "?",
        "© 2024 ⌚ ⭐": " 2024  ",
        "ن‍ه": "ن‍ه",
        "plain 7# text": "plain 7# text",
    }
    df = spark.createDataFrame(list(cases.items()), "v string, want string")
    for v, want, got in df.select("v", "want", remove_emoji(F.col("v"))).collect():
        assert got == want, ascii(v)
    assert one(spark, None, remove_emoji) is None


def test_missing_value_spellings(spark):
    df = spark.createDataFrame([(v,) for v in [*NA_VALUES, "Null", "none", " ", "0"]], "v string")
    kept = rows(df.select(missing_to_null(F.col("v")).alias("v")).filter("v is not null"))
    assert kept == sorted([("Null",), ("none",), (" ",), ("0",)])
    assert len(NA_VALUES) == 19


def test_fill_text(spark):
    assert one(spark, None, fill_text) == ""
    assert one(spark, None, lambda c: fill_text(c, "nan")) == "nan"
    assert one(spark, "a", fill_text) == "a"


def test_labels(spark):
    df = spark.createDataFrame(
        [(v,) for v in ["0", "1", " 1 ", " 1\t", "1.0", "2", "maybe", "", None]], "v string"
    )
    valid = rows(df.filter(is_valid_label(F.col("v"))).select(parse_label(F.col("v"))))
    assert valid == [(0,), (1,), (1,), (1,)]
    assert df.filter(~is_valid_label(F.col("v"))).count() == 5
    assert one(spark, "maybe", parse_label) is None
    assert rows(df.select(presence_flag(F.col("v"))).distinct()) == [(0,), (1,)]


def test_numeric_labels_are_accepted(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "v int")
    assert df.filter(is_valid_label(F.col("v"))).count() == 2


def test_tokens(spark):
    assert one(spark, "It's NEW, café-time 42!", tokens) == ["it", "s", "new", "café", "time"]
    assert one(spark, "It's NEW", lambda c: tokens(c, fold=False)) == ["It", "s", "NEW"]
    assert one(spark, None, tokens) == []
    assert one(spark, " 12 ", tokens) == []


def test_first_tokens_are_a_slice_of_all_tokens(spark):
    texts = ["", "a", " a", "a ", " a b ", "a b c", ".a b c.", "a b c d", "--a b c d", "A-B-C-D-E 1 f", "1 2", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for n in (0, 1, 2, 3, 4, 9):
        for fold in (True, False):
            want = F.slice(tokens(F.col("v"), fold), 1, n)
            assert df.filter(first_tokens(F.col("v"), n, fold) != want).count() == 0
