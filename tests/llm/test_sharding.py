import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import sharding as H

SCHEMA = "doc_id long, text string, shard string, bundle string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)


def test_groups_stay_together_and_sizes_are_near_equal(spark):
    rnd = random.Random(9)
    texts = ["é" * rnd.randint(0, 400) + str(i) for i in range(600)]
    texts += [texts[0]] * 40 + [texts[1]] * 10 + ["x" * 9000, None, None, "", ""]
    got = H.shard_documents(frame(spark, enumerate(texts)), 6).collect()
    assert len(got) == len(texts)
    load, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        t = texts[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and set(load) <= set(range(6))
    mean = sum(load.values()) / 6
    assert max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean


def textbook(sizes, n_shards):
    """Longest first, each to the least-loaded shard (the first of equal ones)."""
    loads = [0] * n_shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 90)), max_size=8), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_schedule_is_the_textbook_one(histogram, n_shards):
    histogram = dict(histogram)
    plan = H.Schedule(np.array(list(histogram), np.int64), np.array(list(histogram.values()), np.int64), n_shards)
    assert plan.loads == textbook([s for s, n in histogram.items() for _ in range(n)], n_shards)
    loads = [0] * n_shards
    for size, n in histogram.items():
        for shard in plan.find(np.full(n, size), np.arange(n)).tolist():
            loads[shard] += size
    assert loads == plan.loads


def test_shards_are_loaded_as_by_the_textbook(spark):
    rnd = random.Random(10)
    texts = [str(i) * rnd.randint(1, 30) for i in range(300)] + ["same"] * 200 + [None] * 7 + ["x" * 1_000_000]
    got = H.shard_documents(frame(spark, enumerate(texts)), 5).collect()
    load, groups = [0] * 5, defaultdict(int)
    for r in got:
        load[r.shard] += r["size"]
        groups[texts[r.doc_id]] += r["size"]
    assert load == textbook(groups.values(), 5)


def test_empty_and_null_ids(spark):
    assert H.shard_documents(frame(spark, [])).collect() == []
    got = H.shard_documents(frame(spark, [(None, "a"), (None, "a"), (1, "a")])).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == [0, 1, 2]
