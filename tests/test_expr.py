import os.path
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import expr as X


def values(spark, kind, rows, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


def slug(x):
    if not x:
        return "unknown"
    stem = os.path.splitext(x)[0]
    return re.sub("^_+|_+$", "", re.sub("[^a-zA-Z0-9]+", "_", stem.lower()))


@given(st.lists(st.text(alphabet="aB9._-/ é\n\t  \x1c", max_size=12), min_size=1, max_size=40))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_slugs_and_words_as_plain_python(spark, texts):
    assert values(spark, "string", texts, X.normalize_id) == [slug(t) for t in texts]
    assert values(spark, "string", texts, X.word_count) == [len(t.split()) for t in texts]


def test_nulls(spark):
    assert values(spark, "string", [None, "", "!!!", "Città.txt", "a b.c d"], X.normalize_id) == ["unknown", "unknown", "", "citt", "a_b"]
    assert values(spark, "string", [None, ""], X.word_count) == [0, 0]


@pytest.mark.parametrize(("text", "number"), [("XIV", 14), ("iv:", 4), ("Third", 3), ("DECIMO.", 10), ("undici", 11), ("Ventesimo:", 20), ("trenta", 30), (":V", None), ("ventitré", 23), ("12", 12), ("007", 7), ("blah", None), ("", None), (None, None), ("XXXI", None)])
def test_ordinals(spark, text, number):
    assert values(spark, "string", [text], X.parse_ordinal) == [number]


def test_padding_never_truncates(spark):
    assert values(spark, "int", [1, 42, 12345], X.zero_pad) == ["001", "042", "12345"]


def test_titles(spark):
    texts = ["l'amico DEL cuore", "chapter_001", "è già"]
    assert values(spark, "string", texts, X.title_case) == [t.title() for t in texts]
    assert values(spark, "string", ["chapter_001"], X.friendly_title) == ["Chapter 001"]


def test_retry_and_transient(spark):
    texts = ["retryDelay: 30s", '"retryDelay": "7s"', "no delay", None]
    assert values(spark, "string", texts, X.retry_delay) == [35, 12, 65, 65]
    assert values(spark, "string", ["HTTP 429", "TimeOut", "bad", None, "high demand", "Network error", "quota"], X.is_transient) == [True, True, False, False, True, True, False]
    assert values(spark, "string", ["429", "503", "x", "RESOURCE_EXHAUSTED 503"], X.error_action) == ["pause", "retry", "fail", "pause"]


def test_clocks(spark):
    assert values(spark, "long", [0, 61, 3599], X.minutes_seconds) == ["00:00", "01:01", "59:59"]
    assert values(spark, "long", [0, 61_000, 3_661_000], X.hours_minutes_seconds) == ["0:00", "1:01", "1:01:01"]


def test_templates_are_filled_one_after_another(spark):
    df = spark.createDataFrame([("{a}-{b}", "{b}", "z", None)], "t string, a string, b string, c string")
    assert df.select(X.fill_template(F.col("t"), {"a": F.col("a"), "b": F.col("b")})).first()[0] == "z-z"
    assert df.select(X.fill_template(F.lit("x{c}"), {"c": F.col("c")})).first()[0] == "x"


def test_unit_formulas(spark):
    assert values(spark, "double", [None, 0.0, 1.0, 0.333], X.unit_energy) == [0.65, 0.4, 0.9, 0.567]
    assert values(spark, "double", [None, 1.0], X.unit_temperature) == [0.73, 0.78]
    assert values(spark, "double", [None, 1.0], X.unit_subtalker) == [0.5, 0.7]
