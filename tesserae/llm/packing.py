"""Best-fit packing of token sequences by minimum bin slack.

Each document is tokenised and closed by an end token; one that is longer than a sequence is cut into full pieces, the
first piece being the shorter rest. Then bins are filled one by one: the longest piece left opens the bin, and a
bitset subset-sum dynamic programme over the lengths that are still available finds the fullest feasible combination,
which is removed. Only the histogram of lengths matters for that (at most `capacity` numbers), so the driver works out
the bins as patterns of lengths, each repeated as often as its lengths last - which is what filling one bin after another
gives, as a fullest combination stays the fullest while it is available. Pieces get their bins by their rank among
pieces of the same length; ranks are distributed prefix sums, so one common length does not end up in one task.

Null text counts as empty; an empty document is the end token alone. Repeated rows are packed each; rows with a null id
too. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, grouped_prefix, map_texts, row_files

#: Fixed value: the pre-tokenisation of byte-level BPE files.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose class libraries may differ: rare controls, and all from U+0250 on.
_UNSURE = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]")
#: Runs that are left to the tokenizers library.
_LONG_RUN = r"\s{1000}|[^\s]{10000}"


def _byte_letters() -> dict[str, int]:
    """The byte for each printable character that byte-level BPE writes it as: itself where printable, else from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return {chr(b if b in keep else next(moved)): b for b in range(256)}


def _ranks(file: dict) -> dict[bytes, int] | None:
    """The merge ranks of a tokenizer file, if it is a plain byte-level BPE whose ids are in the order of its merges."""
    pre, model, letters = file.get("pre_tokenizer") or {}, file.get("model") or {}, _byte_letters()
    if file.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space", True) or model.get("type") != "BPE":
        return None
    vocabulary = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    if [vocabulary.get(m) for m in merged] != list(range(256, 256 + len(merged))) or any(x not in vocabulary for x in letters):
        return None
    return {bytes(letters[c] for c in token): vocabulary[token] for token in [*letters, *merged]}


class Tokens:
    """Token ids of texts by a file of the tokenizers library.

    For a plain byte-level BPE the same merges are run by tiktoken, which gives the same ids in about a quarter of the time;
    texts with the file's special tokens, with characters on whose class the two might differ, or with a run of white space or of
    other characters so long that tiktoken's pattern matching could run out of stack, go through the tokenizers library, and so does
    everything for other kinds of files, and any text on which tiktoken fails.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            ranks = _ranks(json.load(f))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([_UNSURE.pattern, _LONG_RUN, *map(re.escape, added)]))
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("merges", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not self.slow.search(text):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as failed:  # a panic of the library is no Exception
                if not isinstance(failed, Exception) and type(failed).__name__ != "PanicException":
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_TOKENS: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens: full pieces, the first taking the rest."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """counts: pieces of each length (1 to capacity). Returns bins as (((length, pieces), ...), how often)."""
    left, bins = dict(counts), []
    lengths = sorted((n for n in left if left[n]), reverse=True)
    while lengths:
        longest = lengths[0]
        room = capacity - longest
        full = 1 << room
        # reach[k]: bit s is set if the first k lengths (and the counts left) give sum s
        reach, used = [1], []
        if room:
            for n in lengths:
                if n > room:
                    continue
                bits, some, step = reach[-1], left[n] - (n == longest), 1
                if some <= 0:
                    continue
                some = min(some, room // n)
                while some > 0:  # powers of two, then the rest: any number up to `some`
                    take = min(step, some)
                    bits |= bits << (take * n)
                    some, step = some - take, step * 2
                reach.append(bits & (2 * full - 1))
                used.append(n)
                if reach[-1] & full:
                    break
        best = reach[-1].bit_length() - 1
        pattern = {longest: 1}
        for k in range(len(used), 0, -1):
            n = used[k - 1]
            while not reach[k - 1] >> best & 1:
                best -= n
                pattern[n] = pattern.get(n, 0) + 1
        times = min(left[n] // c for n, c in pattern.items())
        bins.append((tuple(sorted(pattern.items(), reverse=True)), times))
        for n, c in pattern.items():
            left[n] -= c * times
        lengths = [n for n in lengths if left[n]]
    return bins


class Places:
    """Where the r-th piece of a length goes: intervals of ranks for each length."""

    def __init__(self, bins: list[tuple[tuple[tuple[int, int], ...], int]]):
        self.by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for pattern, times in bins:
            offset = 0
            for n, c in pattern:
                self.by_length.setdefault(n, []).append((taken.get(n, 0), c, sequence, offset))
                taken[n] = taken.get(n, 0) + c * times
                offset += n * c
            sequence += times
        self.tables = {n: np.array(v, np.int64) for n, v in self.by_length.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            t, mine = self.tables[int(n)], np.flatnonzero(length == n)
            row = t[np.searchsorted(t[:, 0], rank[mine], "right") - 1]
            k = rank[mine] - row[:, 0]
            sequence[mine] = row[:, 2] + k // row[:, 1]
            offset[mine] = row[:, 3] + k % row[:, 1] * n
        return sequence, offset


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in batches:
            rows, kept = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(tokens.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                starts = cut_points(len(ids), capacity)
                for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((k, p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int32))
            if rows:
                t = np.array(rows, np.int64)
                out = [batch.column(0).take(pa.array(t[:, 0])), pa.array(t[:, 1].astype(np.int32)), pa.array(t[:, 2]), pa.array(t[:, 3]), pa.array(t[:, 4])]
                yield pa.RecordBatch.from_arrays(
                    [*out, pa.array(kept, pa.list_(pa.int32()))] if keep_ids else out, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece."""
    pieces = durable(tokenize_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), row_files(docs.count()))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = Places(minimum_bin_slack(counts, capacity))
    keyed = pieces.withColumn("key", F.xxhash64("id", "piece", "ids_crc32"))
    ranked = grouped_prefix(keyed, "length", "key", ["id", "piece", "ids_crc32"], F.lit(1), "rank", sum(counts.values())).drop("key")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = places.find(*(batch.column(c).to_numpy() for c in ("length", "rank")))
                columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, got)], names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    ranked = ranked.withColumn("rank", F.col("rank").cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces packed with keep_ids: at most `capacity` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
