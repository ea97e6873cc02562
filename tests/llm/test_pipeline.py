"""The pipeline as a whole, stage by stage against plain versions."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from tesserae.llm import simhash as S
from tesserae.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd, rows, labels = random.Random(41), [], []
    letters = {"xx": "abcdefgh", "yy": "mnopqrst"}
    for i in range(500):
        lang = rnd.choice(["xx", "yy"])
        text = words(rnd, letters[lang], rnd.randint(20, 120))
        toxic = rnd.random() < 0.15
        if toxic:
            text = " ".join(w + (" vile nasty" if k % 8 == 0 else "") for k, w in enumerate(text.split()))
        rows.append((i, text, lang, rnd.choice(["s1", "s1", "s2", None])))
        labels.append((i, int(toxic)))
    clean = [r for r, (_, t) in zip(rows, labels, strict=True) if not t]
    rows += [(1000 + k, r[1], r[2], r[3]) for k, r in enumerate(clean[:30])]
    rows += [(1100 + k, r[1] + " tail", r[2], "s2") for k, r in enumerate(clean[30:60])]
    rows += [(1200, None, "xx", "s1"), (1201, "", None, "s1"), (1202, "12 34", "xx", "s2"), (None, words(rnd, "abcdefgh", 30), "xx", "s2")]
    rows += [(1300, words(rnd, "abcdefgh", 60) + " " + words(rnd, "mnopqrst", 60), "xx", "s1")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, dict(labels)


def test_stages(spark, corpus):
    path, rows, labels = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES[:3]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), COLUMNS)
        kept[name] = {r.doc_id for r in docs.collect()}
    assert {i for i, t in labels.items() if t} & kept["toxicity"] == set()
    assert {i for i, t in labels.items() if not t} <= kept["toxicity"]
    assert kept["toxicity"] - kept["language_id"] == {1200, 1201, 1202, 1300}
    texts = {i: t for i, t, _, _ in rows if i in kept["language_id"] and i is not None}
    sets = {i: set(S.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    roots = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and roots[a] != roots[b]:
                x, y = sorted((roots[a], roots[b]))
                roots = {i: x if r == y else r for i, r in roots.items()}
    assert kept["simhash_near_dedup"] == {None, *(i for i, r in roots.items() if i == r)}


def test_run_packs_what_the_mix_takes(spark, corpus):
    from tokenizers import Tokenizer

    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in C.STAGES[:4]:
        docs = stage(spark, docs, path)
    plain, want = Tokenizer.from_file(tokenizer_path()), defaultdict(int)
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 1024):  # short texts: one piece each
            want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) > 0
    got, places = defaultdict(int), defaultdict(list)
    for r in C.run(spark, path).collect():
        got[(r.doc_id, r.length, r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
