import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import text as T

pieces = st.text(alphabet="ab. !\n", max_size=400)


@given(pieces, st.booleans())
@settings(max_examples=150, deadline=None)
def test_segments_cover_the_text_within_bounds(text, exact):
    spans = list(T.segment_spans(text, 20, 50, 8, exact))
    if not text.strip():
        assert spans == []
        return
    assert spans[0][0] == 0
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b < d or (exact and c <= b <= d)
    assert all(0 < b - a <= 50 for a, b in spans)
    last = spans[-1][1]
    assert text[last:].strip() == "" or text[last : last + 50].strip() == ""


def reference_segments(text, least, most, overlap):
    """The rule in the plainest words: boundaries are looked for one by one."""
    p = sorted({m.end() for m in re.finditer(r"\n\s*\n", text)} | {m.end() for m in re.finditer(r"\n(?=\s)", text)})
    s = [m.end() for m in re.finditer(r"[.!?]+\s+", text)]
    h = [m.start() for m in re.finditer(r"\n\s*(?:chapter|capitolo|section|parte)\s+\d+", text, re.I)]
    cur, out = 0, []
    while cur < len(text):
        inside = [x for x in p if cur + least <= x <= cur + most]
        end = min(inside) if inside else cur + most
        if end == cur + most:
            inside = [x for x in s if cur + least <= x <= cur + most]
            end = min(inside) if inside else cur + most
        for x in h:
            if cur < x < end:
                end = x
                break
        end = min(end, len(text))
        if end <= cur:
            end = min(cur + most, len(text))
        if not text[cur:end].strip():
            break
        out.append((cur, end))
        cur = end - overlap if end - overlap > cur else end
    return out


@given(st.lists(st.sampled_from(["word ", "stop. ", "\n\n", "\n chapter 3 ", "\n  x", "long" * 6]), max_size=60))
@settings(max_examples=150, deadline=None)
def test_segments_as_the_plain_rule(parts):
    text = "".join(parts)
    assert list(T.segment_spans(text, 30, 70, 10)) == (reference_segments(text, 30, 70, 10) if text.strip() else [])


def test_no_segment_holds_two_headings():
    text = "intro\nChapter 1\n" + "word " * 300 + "\nChapter 2\n" + "word " * 300
    for a, b in T.segment_spans(text, 500, 900, 100, exact=False):
        assert not ("Chapter 1" in text[a:b] and "Chapter 2" in text[a:b])


def test_sentence_and_paragraph_ends():
    text = "One sentence. Two sentence! Three sentence? "
    assert len(T.sentence_ends(text)) == 3 and all(text[e - 2] in ".!?" for e in T.sentence_ends(text))
    assert T.paragraph_ends("Paragraph 1.\n\nParagraph 2.\n\nParagraph 3.") != []


@given(st.lists(st.sampled_from(["a", "bb", "c.", "d.e"]), max_size=80), st.integers(3, 12))
@settings(max_examples=150, deadline=None)
def test_subsegments_lose_no_word(words, window):
    got = list(T.subsegments("  ".join(words), window, 3, 5))
    assert " ".join(got).split() == words
    assert all(1 <= len(g.split()) <= window + 3 for g in got)


def test_blocks_overlap():
    text = "a" * 60 + "\n\n" + "b" * 60
    got = list(T.size_blocks(text, 80, 10))
    assert got[0] == "a" * 60 and got[1].startswith("a" * 10 + "\n\n")


def test_rows_keep_ids_and_drop_null_texts(spark):
    df = spark.createDataFrame([(1, "x", "one two. three"), (2, "y", None), (3, "z", "   ")], "i int, k string, text string")
    assert [tuple(r)[:3] for r in T.segment(df, ["i", "k"]).collect()] == [(1, "x", 0)]
    assert [tuple(r) for r in T.subsegment(df, ["i"]).collect()] == [(1, 0, "one two. three", 3)]
    assert T.segment(df.limit(0), ["i"]).count() == 0


def test_clean_lines(spark):
    df = spark.createDataFrame([("  a \n\n\f b\t\n \n",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.clean_lines(F.col("t"))).collect()] == ["a\nb", None, ""]


@pytest.mark.parametrize(
    ("mode", "args", "text", "want"),
    [
        ("toggle", ("- ",), "- Hi. - there\n- you", '"  Hi. " there\n " you'),
        ("toggle_paragraph", ("--",), "  --a--\nb--\n", '  "a"\nb--'),
        ("enclosed_pair", ("«", "»"), "x «a\nb» y «c", 'x "a\nb" y «c'),
        ("enclosed_pair", ("|",), "|a|b|c|", '"a"b"c"'),
        ("toggle", (None,), "- same", "- same"),
        ("enclosed_pair", ("<", ">", "(", ")"), "<a> (b)", "\"a\" 'b'"),
    ],
)
def test_punctuation(spark, mode, args, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.normalize_punctuation(F.col("t"), mode, *args)).first()[0]
    assert got == want


def test_html():
    assert T.html_text("<style>p{}</style><p>a  b</p>\n<script>x<y</script><p> c&amp;d </p>") == "a b c&d"
    assert T.html_text(None) is None and T.html_text("") == ""
