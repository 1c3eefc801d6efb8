"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most `capacity` ids. Each bin starts with the longest piece left and is filled by a
bitset subset-sum over the lengths still available: the fullest feasible combination is taken out. Pieces of one length
are interchangeable, so this runs on the length histogram (at most `capacity` counts, whatever the corpus size): the same
combination is the fullest again until one of its lengths runs short, so it is applied that many times at once. The
corpus is then placed by rank within length: ranks are computed per salted group and shifted by the groups' offsets, so
a hot length never meets in one task.

Edge cases: null and empty texts are one piece of the end id alone; repeated rows are packed each; texts of any length
are cut, never dropped; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import table
from basisline.llm.ranks import ranked, with_row_ids

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 600_000  # each of words at a line's start and of others, per Python worker: some 150 MB


#: A text without these decomposes at its single blanks and line ends: no token of a byte-level BPE crosses them.
UNEVEN_BLANKS = re.compile(r"\s(?:\s|\Z)|\A\s")


#: How byte-level files split a text into words (fixed value of that kind of file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words by which both libraries are compared when a file is loaded.
PROBES = ("hello", " world", " don't", "don't", " 123abc", "na\u00efve", " \u6587\u5b57x", "!?...", " ***", "\u00e9\u00e9'll", "a\tb", " x\u00a0y", "\U0001f642", "\n", " Thththth", "0x1F")


class _Words(dict):
    """Little-endian 32-bit ids of a word after a fixed prefix, remembered."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids = np.asarray(self.encode(self.prefix + word), "<u4").tobytes()
        return ids


class ByteBpe:
    """Ids of a tokenizers JSON file, as the tokenizers library gives them.

    Texts whose blanks all stand alone fall into words, each with the blank before it; these are encoded from the file's ranks
    by tiktoken, which is twice as fast on words nobody has seen, and remembered. Texts with other blanks or with an added
    token go to tokenizers whole, and so do all texts if the file splits in another way or the two libraries differ on PROBES.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the work
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = [t["content"] for t in file.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file.get("normalizer") and model["type"] == "BPE"
        self.newline = self.whole("\n")
        if self.by_word:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added and all(c in byte_of for c in token)}
            encode = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.first, self.later = _Words(encode, ""), _Words(encode, " ")  # words at the start of a line, after a blank
            self.by_word = all(np.asarray(encode(x), "<u4").tobytes() == self.whole(x) for x in PROBES)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def id_bytes(self, text: str) -> bytes:
        """All ids of the text as little-endian unsigned 32-bit integers."""
        if not text or not self.by_word or UNEVEN_BLANKS.search(text) or self.added.search(text):
            return self.whole(text) if text else b""
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:])))
        return self.newline.join(out)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only if too long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = tokenizer(path), np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = bpe.id_bytes(t.as_py() or "") + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                for k, a in enumerate([0, *range(first, n, capacity)]):
                    b = first if k == 0 else a + capacity
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """Minimum slack: counts by length of the combination that fills `room` best; longer pieces first among equals."""
    mask, reach, before = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        n = min(left[length], room // length)
        if n <= 0:
            continue
        before.append((length, reach))
        step = 1
        while n > 0:
            take = min(step, n)
            reach |= (reach << (take * length)) & mask
            n, step = n - take, step * 2
        if reach >> room & 1:
            break
    goal, used = reach.bit_length() - 1, {}
    for length, was in reversed(before):
        while not was >> goal & 1:
            goal -= length
            used[length] = used.get(length, 0) + 1
    return used


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Entries (length, first rank, per bin, first bin, offset) sorted by length and rank, and the number of bins.

    The pieces of `length` ranked from `first rank` on stand `per bin` to a bin, from `first bin` on, at `offset`.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths, ranks, bins, entries = sorted(left, reverse=True), dict.fromkeys(left, 0), 0, []
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        used = fullest(lengths, left, capacity - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times, offset = min(left[k] // n for k, n in used.items()), 0
        for k in sorted(used, reverse=True):
            entries.append((k, ranks[k], used[k], bins, offset))
            offset += k * used[k]
            ranks[k] += times * used[k]
            left[k] -= times * used[k]
        bins += times
        lengths = [k for k in lengths if left[k] > 0]
    return np.asarray(sorted(entries), "int64").reshape(-1, 5), bins


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = with_row_ids(pieces(docs, path or default_tokenizer(), capacity, key, text), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    entries, _ = plan_bins(counts, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = entries[:, 0] * (1 << 48) + entries[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            e = entries[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            n = rank - e[:, 1]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(e[:, 3] + n // e[:, 2]), pa.array(e[:, 4] + n % e[:, 2] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked(rows, "length", counts).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
