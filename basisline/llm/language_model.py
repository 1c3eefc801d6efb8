"""Trigram language model by deleted interpolation.

Maximum-likelihood trigram, bigram, unigram and uniform estimates are mixed with weights that depend on the bucket of the
frequency of the longest context seen: the two words before, else the one before, else none. The weights are learned by
expectation-maximisation on a deleted part of the training documents, against counts of the rest; the final counts are those
of all training documents. Beside the model's score stands one against the counts without the document's own.

How it runs: documents become blocks of local word numbers (written once). Each block sends its distinct words, word pairs
and triples, with counts, to key ranges; a key range adds them up and replies to each block with the totals of the keys it
sent, in order. So every total is exact, a frequent word or pair costs one key a block, and neither the vocabulary nor
the counts are ever held in one place. Blocks and replies then meet by block to learn the weights and to score.

Words are told apart by 64 bits, pairs and triples by 20 bits more than number the tokens (64 at most), so that about one
key in a million shares its count with another at any corpus size. Counts have 64 bits.

Sizes: a task holds one block or one key range, so BLOCK_BYTES and RANGE_TOKENS follow the memory of a Python worker (the
defaults need some 200 MB). A block sends one row to each range it has a key of: up to about a terabyte of text the rows are
long; beyond it both constants should grow with the executors, since a row of less than a hundred keys costs more than they do.

Edge cases: null and empty texts are the end token alone; unknown words share one unknown type; repeated rows are learned
and scored each; without training documents the uniform estimate is all there is; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import crc_text, stored, table
from basisline.llm.grouped import runs
from basisline.llm.shingles import _LOWER, hash_runs, mix, text_chunks

BLOCK_BYTES = 3 << 20  # text of one block
RANGE_TOKENS = 1_000_000  # tokens behind one key range
SPARE_BITS = 20  # of pair and triple keys beyond those that number the tokens
END = np.uint64(0xE0D0E0D0E0D0E0D1)
TRAIN, TUNE, HELD = 0, 1, 2
BUCKETS = 64  # context frequencies: 1, 2, 3, 4 and powers of two
LEVELS = 3  # longest context seen: none, one word, two words
GRID = (4, 2, 1)  # steps of the log2 ratios (triple, pair, word) at which held-out events are counted
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def gram_keys(words: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word with the one and the two words before it; before a document stand ends."""
    before = np.append(END, words[:-1])
    second = np.append(np.repeat(END, 2), words)[: len(words)]
    second[np.append(0, np.cumsum(lengths)[:-1])] = END
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) ^ (words * np.uint64(0xC2B2AE3D27D4EB4F)))
    triple = mix(pair * np.uint64(0x9FB21C651E98DF25) ^ mix(second + np.uint64(0x632BE59BD9B4E019)))
    return pair >> np.uint64(64 - bits), triple >> np.uint64(64 - bits)


def squeezed(values: np.ndarray) -> bytes:
    """64-bit unsigned integers by byte planes, compressed: small numbers cost little whatever their width."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values, "<u8").view("u1").reshape(len(values), 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, "<u8")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "u1").reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def packed(vocab: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, roles: np.ndarray) -> bytes:
    head = np.asarray([len(vocab), len(tokens), len(lengths)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + vocab.astype("<u8").tobytes() + tokens.astype("<u4").tobytes() + lengths.astype("<i8").tobytes() + roles.astype("u1").tobytes())


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    v, t, n = np.frombuffer(data, "<i8", 3)
    at = 24
    out = []
    for kind, k, width in (("<u8", v, 8), ("<u4", t, 4), ("<i8", n, 8), ("u1", n, 1)):
        out.append(np.frombuffer(data, kind, int(k), at))
        at += int(k) * width
    return tuple(out)


def blocks(docs: DataFrame, role: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows block, tune, n_tokens, doc_ids, payload. Documents that tune the weights stand in blocks of their own."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {True: ([], [], [], [], [0]), False: ([], [], [], [], [0])}

        def flush(tune: bool) -> pa.RecordBatch:
            ids, words, lengths, roles, _ = open_[tune]
            open_[tune] = ([], [], [], [], [0])
            flat = np.concatenate(words)
            vocab, tokens = np.unique(flat, return_inverse=True)
            blob = packed(vocab, tokens, np.asarray(lengths), np.asarray(roles))
            cols = [pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([tune]), pa.array([len(flat)], pa.int64())]
            owners = pa.concat_arrays(ids)
            owners = pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners)
            return pa.RecordBatch.from_arrays([*cols, owners, pa.array([blob], pa.binary())], names=["block", "tune", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            roles_ = batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, bounds in text_chunks(batch.column(2)):
                low = _LOWER[data]
                words, first = hash_runs(low, _IS_WORD[low], bounds)
                n = len(bounds) - 1
                lengths = np.diff(first) + 1
                flat = np.insert(words, first[1:], END)
                ends = np.cumsum(lengths)
                mine = roles_[row : row + n]
                for tune in (False, True):
                    chosen = np.flatnonzero((mine == TUNE) == tune)
                    if not len(chosen):
                        continue
                    ids, parts, sizes, kinds, total = open_[tune]
                    ids.append(batch.column(0).slice(row, n).take(pa.array(chosen)))
                    parts.append(flat[np.repeat((mine == TUNE) == tune, lengths)])
                    sizes.extend(lengths[chosen].tolist())
                    kinds.extend(mine[chosen].tolist())
                    total[0] += int((np.diff(bounds))[chosen].sum()) + len(chosen)
                    if total[0] >= BLOCK_BYTES:
                        yield flush(tune)
        for tune in (False, True):
            if open_[tune][0]:
                yield flush(tune)

    return docs.select(F.col(key), role.cast("int"), F.col(text)).mapInArrow(run, f"block binary, tune boolean, n_tokens long, doc_ids array<{kind}>, payload binary")


def keys_of(payload: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a block: lengths, role of each token's document; distinct words, pairs and triples (sorted) with each token's place."""
    vocab, tokens, lengths, roles = unpacked(payload)
    grams = gram_keys(vocab[tokens], lengths, bits)
    return lengths, np.repeat(roles, lengths), [(vocab, tokens), *(np.unique(g, return_inverse=True) for g in grams)]


def sent(rows: DataFrame, ranges: int, bits: int) -> DataFrame:
    """Rows part, block, tune, keys, counts: each block's distinct keys with their training counts, by key range; keys and
    counts hold one value each for words, pairs and triples."""
    cuts = [np.asarray([(j << width) // ranges for j in range(1, ranges)], "uint64") for width in (64, bits, bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tune, payload in zip(*batch.columns, strict=True):
                _, role, kinds = keys_of(payload.as_py(), bits)
                counts = [np.bincount(place[role != HELD], minlength=len(keys)).astype("<u8") for keys, place in kinds]
                at = [np.concatenate([[0], np.searchsorted(keys, cut), [len(keys)]]).astype("int64") for (keys, _), cut in zip(kinds, cuts, strict=True)]
                full = np.flatnonzero(sum(np.diff(x) for x in at)).tolist()
                # Keys are sorted: their differences within a range leave the high bytes empty.
                keys = [[squeezed(np.diff(k[x[p] : x[p + 1]], prepend=np.uint64(0))) for (k, _), x in zip(kinds, at, strict=True)] for p in full]
                sums = [[squeezed(c[x[p] : x[p + 1]]) for c, x in zip(counts, at, strict=True)] for p in full]
                n = len(full)
                lists = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block.as_py()] * n, pa.binary()), pa.array([tune.as_py()] * n, pa.bool_()), pa.array(keys, lists), pa.array(sums, lists)],
                    names=["part", "block", "tune", "keys", "counts"],
                )

    return rows.select("block", "tune", "payload").mapInArrow(run, "part int, block binary, tune boolean, keys array<binary>, counts array<binary>")


def replies(slices: DataFrame) -> DataFrame:
    """Rows block, part, total, tuned: training totals of the keys each block sent, for blocks that tune the weights also
    the deleted part of them. One more row a key range, without a block, has the sums of its words: n_tokens, n_words,
    n_tuned, n_left (distinct words of the rest)."""

    def summed(g: pa.Table, kind: int) -> tuple[list[bytes], list[bytes | None], list[int]]:
        raw = [np.cumsum(unsqueezed(x[kind]), dtype="u8") for x in g.column("keys").to_pylist()]
        counts = np.concatenate([unsqueezed(x[kind]) for x in g.column("counts").to_pylist()])
        size = np.asarray([len(x) for x in raw])
        tunes = g.column("tune").to_pylist()
        distinct, place = np.unique(np.concatenate(raw), return_inverse=True)
        del raw
        tune = np.repeat(np.asarray(tunes, bool), size)
        total, tuned = exact_sums(place, counts, len(distinct)), exact_sums(place[tune], counts[tune], len(distinct))
        at = np.append(0, np.cumsum(size)).tolist()
        out = [squeezed(total[place[a:b]]) for a, b in itertools.pairwise(at)]
        own = [squeezed(tuned[place[a:b]]) if t else None for (a, b), t in zip(itertools.pairwise(at), tunes, strict=True)]
        return out, own, [int(total.sum()), int((total > 0).sum()), int(tuned.sum()), int((total > tuned).sum())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 1, 1):
            for lo, hi in itertools.pairwise(bounds.tolist()):
                g = t.slice(lo, hi - lo)
                found = [summed(g, k) for k in range(3)]
                n, part = hi - lo, g.column("part")[0].as_py()
                total = [list(x) for x in zip(*[f[0] for f in found], strict=True)]
                tuned = [list(x) if x[0] is not None else None for x in zip(*[f[1] for f in found], strict=True)]
                lists = pa.list_(pa.binary())
                cols = [pa.array([*g.column("block").to_pylist(), None], pa.binary()), pa.array([part] * (n + 1), pa.int32()), pa.array([*total, None], lists), pa.array([*tuned, None], lists)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([None] * n + [x], pa.int64()) for x in found[0][2])], names=["block", "part", "total", "tuned", "n_tokens", "n_words", "n_tuned", "n_left"])

    dealt = slices.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "block binary, part int, total array<binary>, tuned array<binary>, n_tokens long, n_words long, n_tuned long, n_left long")


def exact_sums(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit counts by place, without the rounding of floats."""
    out = np.zeros(n, "<u8")
    np.add.at(out, place, counts)
    return out


def met(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block's row followed by its replies in key order, in one partition."""
    lists, ids = "cast(null as array<binary>)", f"cast(null as {rows.schema['doc_ids'].dataType.simpleString()})"
    own = rows.select("block", F.lit(-1).alias("part"), "doc_ids", "payload", F.expr(lists).alias("total"), F.expr(lists).alias("tuned"))
    got = answers.where("block is not null").select("block", "part", F.expr(ids).alias("doc_ids"), F.lit(None).cast("binary").alias("payload"), "total", "tuned")
    return own.unionByName(got).repartition("block").sortWithinPartitions("block", "part")


def counted(t: pa.Table, lo: int, hi: int, bits: int, deleted: bool):
    """Of one block: lengths, roles by token, each token's count as word, pair and triple (less the deleted part if asked),
    and its places among the block's grams."""
    lengths, role, kinds = keys_of(t.column("payload")[lo].as_py(), bits)
    total, tuned = (t.column(c).slice(lo + 1, hi - lo - 1).to_pylist() for c in ("total", "tuned"))
    out = []
    for k, (_, place) in enumerate(kinds):
        count = np.concatenate([unsqueezed(x[k]) for x in total])
        if deleted:
            count = count - np.concatenate([unsqueezed(x[k]) for x in tuned])
        out.append(count.astype("float64")[place])
    return lengths, role, out, [place for _, place in kinds]


def contexts(counts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of the context of each token: those of the gram before it, of each document's first one as given."""
    before = np.append(0.0, counts[:-1])
    before[np.append(0, np.cumsum(lengths)[:-1])] = first
    return before


def own_counts(place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each token's gram (by place) stands in its own document."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    _, at, n = np.unique(owner * (int(place.max()) + 1) + place, return_inverse=True, return_counts=True)
    return n[at].astype("float64")


def bucket(c3: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Bucket of the longest context seen, by its frequency: 1 to 4 alone, then powers of two."""
    size = lambda c: np.where(c <= 4, c, 2 + np.floor(np.log2(np.maximum(c, 1)) + 1e-9)).astype("int64").clip(0, BUCKETS - 1)
    return np.where(c3 > 0, 2 * BUCKETS + size(c3), np.where(c2 > 0, BUCKETS + size(c2), 0))


def estimates(lengths: np.ndarray, counts: list[np.ndarray], n: np.ndarray | float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bucket of each token's context, and its maximum-likelihood estimates as triple, pair and word."""
    word, pair, triple = counts
    ends = word[np.cumsum(lengths) - 1]  # as many documents as end tokens
    c2, c3 = contexts(word, lengths, ends), contexts(pair, lengths, ends)
    return bucket(c3, c2), [triple / np.maximum(c3, 1), pair / np.maximum(c2, 1), word / np.maximum(n, 1)]


def held_events(rows: DataFrame, answers: DataFrame, bits: int, n: float, v: float) -> DataFrame:
    """Rows cell, n: deleted tokens counted by context bucket and by the log2 ratios of their estimates to the uniform one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 1, 1):
            for lo, hi in itertools.pairwise(bounds.tolist()):
                lengths, _, counts, _ = counted(t, lo, hi, bits, True)
                cell, shares = estimates(lengths, counts, n)
                for f, grid in zip(shares, GRID, strict=True):
                    cell = cell * 512 + np.where(f > 0, np.round(grid * np.log2(np.maximum(f, 1e-30) * (v + 1))) + 256, 0).clip(0, 511).astype("int64")
                cell, count = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(count, pa.int64())], names=["cell", "n"])

    return met(rows, answers).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learned(cell: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Mixture weights (triple, pair, word, uniform) by context bucket, by expectation-maximisation on the counted events."""
    ratio = [(cell >> shift) % 512 for shift in (18, 9, 0)]
    b = cell >> 27
    f = np.stack([np.where(r == 0, 0.0, 2.0 ** ((r - 256) / grid)) for r, grid in zip(ratio, GRID, strict=True)] + [np.ones(len(cell))])
    level = np.arange(LEVELS * BUCKETS) // BUCKETS
    may = np.stack([level == 2, level >= 1, level >= 0, level >= 0]).astype("float64")
    w = may / may.sum(axis=0)
    for _ in range(rounds):
        share = w[:, b] * f
        share *= n / share.sum(axis=0)
        new = np.stack([np.bincount(b, x, LEVELS * BUCKETS) for x in share]) + 0.1 * may  # no weight dies out
        w = new / new.sum(axis=0)
    return w


def scored(rows: DataFrame, answers: DataFrame, bits: int, n: int, v: int, weights: np.ndarray) -> DataFrame:
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "left_out_score"]

    def mixed(k: np.ndarray, shares: list[np.ndarray]) -> np.ndarray:
        return sum(weights[j, k] * f for j, f in enumerate(shares)) + weights[3, k] / (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 1, 1):
            for lo, hi in itertools.pairwise(bounds.tolist()):
                lengths, role, counts, places = counted(t, lo, hi, bits, False)
                at, word = np.cumsum(lengths) - lengths, counts[0]
                cols = [lengths, np.add.reduceat((word > 0).astype("int64"), at), np.full(len(at), n, "int64"), np.add.reduceat(np.log10((word + 1) / (n + v + 1)), at)]
                cols.append(np.add.reduceat(np.log10(mixed(*estimates(lengths, counts, n))), at))
                seen = (role != HELD).astype("float64")
                for c, place in zip(counts, places, strict=True):
                    c -= seen * own_counts(place, lengths)
                cols.append(np.add.reduceat(np.log10(mixed(*estimates(lengths, counts, n - seen * np.repeat(lengths, lengths)))), at))
                ids = t.column("doc_ids").slice(lo, 1).combine_chunks().flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(role[at] == HELD), *map(pa.array, cols)], names=names)

    return met(rows, answers).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, left_out_score double")


@dataclass(frozen=True)
class Model:
    """Stored blocks and replies of a corpus, the bits of its keys, its training tokens and distinct words, and the weights."""

    rows: DataFrame
    answers: DataFrame
    bits: int
    n: int
    v: int
    weights: np.ndarray


def fitted(docs: DataFrame, role: Column, key: str = "doc_id", text: str = "text", range_tokens: int = RANGE_TOKENS) -> Model:
    rows = stored(blocks(docs, role, key, text), "lm-blocks")
    tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0
    bits = min(64, tokens.bit_length() + SPARE_BITS)
    answers = stored(replies(sent(rows, tokens // range_tokens + 1, bits)), "lm-replies")
    sums = answers.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "n_tuned", "n_left")]).first()
    n, v, n_tuned, v_left = sums
    tune = rows.where("tune")
    cells = held_events(tune, answers.where("tuned is not null"), bits, n - n_tuned, v_left).toArrow()  # a bounded set: buckets x ratios
    return Model(rows, answers, bits, n, v, learned(cells.column("cell").to_numpy(), cells.column("n").to_numpy()))


def score_documents(docs: DataFrame, role: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and left_out_score (log10) of every document.

    score is the model's probability of the text, for training documents too, which the model has seen; left_out_score is
    that against counts without the document's own, so it tells training documents with a copy elsewhere from those without.
    role: TRAIN, TUNE (training documents deleted from the counts while weights are learned) or HELD (never learned from).
    """
    m = fitted(docs, role, key, text)
    return scored(m.rows, m.answers, m.bits, m.n, m.v, m.weights)


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_text(F.col("doc_id")) % 7
    role = F.when(fold == 2, HELD).when(fold == 3, TUNE).otherwise(TRAIN)
    return score_documents(table(spark, sf_dir, "documents"), role)
