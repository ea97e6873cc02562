import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import packing as K
from tesserae.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, piece string, start string, rank string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in texts], SCHEMA)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "x\n\ny", "\nfoo", "foo \nbar", "foo\n bar", "a\tb c", "it's we'll I'M", "x<|endoftext|>y", "n\u00a0b \u00a0c", "ünï dé", "12 3.4 a_b", "a\r\nb", "٣ x", "²x ½", "日本 語", "a\u2028b", "e\u0301 x", "\U0001f600 hi", "..--!!"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers(text):
    assert K.Tokens(tokenizer_path()).ids(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, " \n\t" * 700_000, "a" + " " * 999 + "b" + "\n" * 1001, "x" * 2_000_000, "ab, " * 3 + "-" * 300_000 + " z", "1" * 500_000], ids=range(7))
def test_ids_of_long_runs(text):
    assert K.Tokens(tokenizer_path()).ids(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_a_failure_of_the_fast_path_is_no_failure():
    tokens = K.Tokens(tokenizer_path())

    class PanicException(BaseException):
        pass

    class Broken:
        def encode_ordinary(self, text):
            raise PanicException("stack overflow")

    tokens.fast = Broken()
    assert tokens.ids("some text").tolist() == tokenizer().encode("some text", add_special_tokens=False).ids


def test_ids_of_random_text():
    rnd, tokens, plain = random.Random(0), K.Tokens(tokenizer_path()), tokenizer()
    letters = "ab cd\n.,'sé12 \t-ß\u00a0漢²\x1c\x85ªɏ¼\r\u00ad"
    for _ in range(400):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        assert tokens.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_the_documents(sf_dir):
    import pyarrow.parquet as pq

    tokens, plain = K.Tokens(tokenizer_path()), tokenizer()
    assert tokens.fast
    for text in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist():
        assert tokens.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_other_files_go_through_the_library(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        file = json.load(f)
    assert K._ranks(file) and K._ranks({**file, "normalizer": {"type": "Lowercase"}}) is None
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    tokens = K.Tokens(str(tmp_path / "t.json"))
    assert tokens.fast is None and tokens.ids("a b").tolist() == tokens.tokenizer.encode("a b", add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=6))
@settings(max_examples=80, deadline=None)
def test_each_bin_is_the_fullest_feasible(counts):
    left = {n: c for n, c in counts.items()}
    for pattern, times in K.minimum_bin_slack(counts, 12):
        for _ in range(times):
            items = [n for n, c in left.items() for _ in range(c)]
            longest = max(items)
            assert pattern[0][0] == longest
            rest = list(items)
            rest.remove(longest)
            best = max(sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k) if longest + sum(c) <= 12)
            assert sum(n * c for n, c in pattern) == longest + best
            for n, c in pattern:
                left[n] -= c
                assert left[n] >= 0
    assert not any(left.values())


def test_pack(spark):
    rnd = random.Random(2)
    texts = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma,"]) for _ in range(rnd.choice([3, 40, 300, 2500])))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "same words"), (102, "same words"), (None, "lone")]
    packed = K.pack_documents(frame(spark, texts), tokenizer_path(), keep_ids=True).collect()
    plain, by_doc, by_sequence = tokenizer(), defaultdict(list), defaultdict(list)
    for r in packed:
        assert 0 < r.length <= 1024 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in texts:
        if i != 102:
            parts = sorted(by_doc[i], key=lambda r: r.piece)
            ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
            assert [x for p in parts for x in p.ids] == ids
            assert [p.piece for p in parts] == list(range(len(parts))) and [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
            assert all(p.length == 1024 for p in parts[1:])
    assert len(by_doc[102]) == 2
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    full = sum(r.length for r in packed)
    assert len(by_sequence) <= -(-full // 1024) + 1
    df = K.pack_documents(frame(spark, texts), tokenizer_path(), keep_ids=True)
    assert sum(len(r.ids) for r in K.sequences(df).collect()) == full


def test_empty(spark):
    assert K.pack_documents(frame(spark, []), tokenizer_path()).collect() == []
