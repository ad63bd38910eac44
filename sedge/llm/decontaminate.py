"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some positions of a window of tokens and ignore the others, so a
window still matches when tokens at ignored positions were substituted. Hashes of
all masked windows of the documents are tried against a Bloom filter of bounded size
built from those of the benchmark; what passes is joined with the benchmark's
hashes, and each shared diagonal is verified without gaps: any stretch of it that is
long enough and has enough equal tokens is an overlap.

Defined results: a token is a run of letters or digits in lower case, in scripts without blanks
a single character; null and empty texts have none and never match; an item shorter than a mask is
matched by the mask cut to its length, and one of under five tokens, which any text may hold, is
not searched for; of rows that repeat an identifier every one is searched, of the benchmark too, and
rows without an identifier like others; other columns are not read (`decontaminate` hands them on).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.llm.common import WordHashes, arrow_rows, mixed, written

#: Spaced seeds of weight six; 1 is compared, 0 is ignored.
MASKS = ("1101100111", "1110010111", "10110101101", "111111")
#: Bits of the Bloom filter: 32 for each seed of the benchmark, between 4 and 64 MB. A fuller one lets more windows pass
#: to the join, which decides.
LEAST_BITS, MOST_BITS = 1 << 25, 1 << 29
#: An overlap counts from so many aligned tokens (all of a shorter item) of which this share is equal.
MIN_TOKENS = 13
MIN_IDENTITY = 0.75
#: Tokens of the shortest item that is searched for.
MIN_ITEM = 5
_TOKEN = re.compile(r"[^\W_]+")
#: Scripts that are written without blanks: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_TOKEN_OR_SIGN = re.compile(f"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\\W_])+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (_TOKEN if text.isascii() or not _ANY_UNSPACED.search(text) else _TOKEN_OR_SIGN).findall(text.lower())


def seeds(h: np.ndarray, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each mask and length the hashes of all its windows. lengths: 0 for the whole mask, else a cut one."""
    for number, mask in enumerate(MASKS):
        for length in lengths:
            span = min(length, len(mask)) or len(mask)
            if length >= len(mask) or len(h) < span:
                yield h[:0]
                continue
            out = np.full(len(h) - span + 1, number * 64 + length + 1, np.uint64)
            for i in range(span):
                if mask[i] == "1":
                    out = out * _MUL + h[i : len(h) - span + 1 + i]
            yield mixed(out)


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(size - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def align(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Start in the item, length and equal tokens of the best-scoring ungapped segment on a diagonal (equal +1, else -2)."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if high <= low:
        return 0, 0, 0
    equal = doc[low + diagonal : high + diagonal] == item[low:high]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    floor = np.minimum.accumulate(total)
    end = int((total - floor).argmax())
    start = int(total[: end + 1].argmin())
    return low + start, end - start, int(equal[start:end].sum())


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_tokens: int, share: Fraction) -> tuple[int, int, int]:
    """Start in the item, length and equal tokens of the stretch with the most equal tokens on a diagonal, among
    those of min_tokens or more (all of a shorter item) with that share of equal ones; length 0 where there is none."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    least = max(1, min(min_tokens, len(item)))
    if high - low < least:
        return 0, 0, 0
    equal = doc[low + diagonal : high + diagonal] == item[low:high]
    count = np.concatenate([[0], np.cumsum(equal)])
    score = share.denominator * count - share.numerator * np.arange(len(count))  # a stretch has the share if it does not fall
    floor = np.minimum.accumulate(score)
    ends = np.arange(least, len(count))
    starts = np.searchsorted(-floor, -score[ends])  # the first place from which the score does not fall
    found = starts <= ends - least
    if not found.any():
        return 0, 0, 0
    starts, ends = starts[found], ends[found]
    k = int((count[ends] - count[starts]).argmax())
    start, end = int(starts[k]), int(ends[k])
    while end - start > least and not equal[end - 1]:
        end -= 1
    while end - start > least and not equal[start]:
        start += 1
    return low + start, end - start, int(count[end] - count[start])


def _document_hits(bloom, lengths: tuple[int, ...], whole: bool):
    """(doc, text, row) to (at, doc, tokens, hash, place, row): the windows that pass the filter. Rows without any are left
    out or, as a whole, handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits = bloom.value
        size = len(bits) * 8
        hashes = WordHashes()
        number = TaskContext.get().partitionId() << 36
        for source in batches:
            for start in range(0, source.num_rows, 500):
                batch = source.slice(start, 500)
                keep, tokens, hash_, place = [], [], [], []
                for i, text in enumerate(batch.column(1)):
                    h = hashes.of(tokens_of(text.as_py()))
                    found, places = [], []
                    for s in seeds(h, lengths):
                        if not len(s):
                            continue
                        a, b = _bits(s, size)
                        at = np.flatnonzero(bits[a >> 3] >> (a & 7).astype(np.uint8) & 1)
                        if len(at):
                            at = at[(bits[b[at] >> 3] >> (b[at] & 7).astype(np.uint8) & 1).astype(bool)]
                        if len(at):
                            found.append(s[at])
                            places.append(at)
                    if found or whole:
                        keep.append(i)
                        tokens.append(h.tobytes() if found else None)
                        hash_.append(np.concatenate(found).astype(np.int64) if found else None)
                        place.append(np.concatenate(places).astype(np.int32) if found else None)
                if keep:
                    told = batch.take(pa.array(keep, pa.int32())) if len(keep) < batch.num_rows else batch
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number + i for i in keep], pa.int64()),
                            told.column(0),
                            pa.array(tokens, pa.binary()),
                            pa.array(hash_, pa.list_(pa.int64())),
                            pa.array(place, pa.list_(pa.int32())),
                            *told.columns[2:],
                        ],
                        names=["at", "doc", "tokens", "hash", "place", *told.schema.names[2:]],
                    )
                number += batch.num_rows

    return run


def _item_seeds(lengths_of):
    schema = pa.schema([("hash", pa.int64()), ("item_at", pa.int64()), ("place", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(schema)
        hashes = WordHashes()
        for batch in batches:
            for item_at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = hashes.of(tokens_of(text))
                for s in seeds(h, lengths_of(len(h))) if len(h) >= MIN_ITEM else ():
                    for at, value in enumerate(s.astype(np.int64).tolist()):
                        add(value, item_at, at, len(h))
                yield from take()
        yield from take(True)

    return run


def _verify(min_tokens: int, min_identity: float):
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("item", pa.int64()), ("start", pa.int32()), ("n_tokens", pa.int32()), ("n_equal", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(schema)
        hashes = WordHashes()
        share = Fraction(str(min_identity))
        for batch in batches:
            for row, doc, tokens, item, text, diagonals in zip(*(c.to_pylist() for c in batch.columns)):
                d, h = np.frombuffer(tokens, np.uint64), hashes.of(tokens_of(text))
                best = (0, 0, 0)
                for diagonal in diagonals:
                    start, n, equal = overlap(d, h, diagonal, min_tokens, share)
                    if n and (equal, -start - diagonal) > (best[2], -best[0]):
                        best = (start + diagonal, n, equal)
                if best[1]:
                    add(row, doc, item, *best)
            yield from take()
        yield from take(True)

    return run


def _bloom(seeded: DataFrame) -> np.ndarray:
    """A Bloom filter over the seeds' hashes, put together from its blocks: MOST_BITS at most come to the driver."""
    size = LEAST_BITS
    n = seeded.count()
    while size < min(MOST_BITS, 32 * n):
        size *= 2
    step = size // 512  # bytes of a block; 64 of them

    def bloomed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for bits in _bits(batch.column(0).to_numpy().astype(np.uint64), size):
                np.bitwise_or.at(out, bits >> 3, np.uint8(1) << (bits & 7).astype(np.uint8))
        for block in range(0, len(out), step):
            part = out[block : block + step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([part.tobytes()], pa.binary())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, whole = None, None
        for batch in batches:
            for block, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(bits.as_buffer(), np.uint8)
                if block == last:
                    whole |= part
                    continue
                if whole is not None:
                    yield told(last, whole)
                last, whole = block, part.copy()
        if whole is not None:
            yield told(last, whole)

    def told(block: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    blocks = seeded.select("hash").mapInArrow(bloomed, "block int, bits binary").repartition(64, "block").sortWithinPartitions("block").mapInArrow(merged, "block int, bits binary")
    bloom = np.zeros(size // 8, np.uint8)
    for r in blocks.toLocalIterator():
        bloom[r["block"] : r["block"] + step] = np.frombuffer(r["bits"], np.uint8)
    return bloom


def _search(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, min_tokens: int, min_identity: float, whole: bool
) -> tuple[DataFrame, DataFrame]:
    """The written rows (at, doc, tokens, hash, place, and as a whole row) and their overlaps (at, doc, item, start, n_tokens, n_equal)."""
    spark = docs.sparkSession
    longest = max(map(len, MASKS))
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    items = written(items.withColumn("item_at", F.monotonically_increasing_id()), "bench-items")
    seeded = written(
        items.select("item_at", "text").mapInArrow(_item_seeds(lambda n: (0, n) if 0 < n < longest else (0,)), "hash long, item_at long, place int, n int"), "bench-seeds"
    )
    lengths = (0, *sorted(r["n"] for r in seeded.where(F.col("n") < longest).select("n").distinct().collect()))  # fewer than the longest mask has places
    bloom = spark.sparkContext.broadcast(_bloom(seeded))  # 64 MB at most

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if whole else []))
    ddl = T.StructType([T.StructField(n, t) for n, t in (("at", T.LongType()), ("doc", T.LongType()), ("tokens", T.BinaryType()), ("hash", T.ArrayType(T.LongType())), ("place", T.ArrayType(T.IntegerType())))])
    if whole:
        ddl = ddl.add("row", rows.schema["row"].dataType)
    hits = written(rows.mapInArrow(_document_hits(bloom, lengths, whole), ddl), "bench-hits")
    # Both sides of a join may grow: none is broadcast, at any size.
    suspects = hits.where("hash IS NOT NULL")
    each = suspects.select("at", F.explode(F.arrays_zip("hash", "place")).alias("h")).select("at", "h.hash", "h.place")
    theirs = seeded.select("hash", "item_at", F.col("place").alias("item_place"))
    diagonals = each.join(theirs.hint("merge"), "hash").select("at", "item_at", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    pairs = written(diagonals.groupBy("at", "item_at").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals")), "bench-pairs")
    checked = suspects.select("at", "doc", "tokens").join(pairs.hint("merge"), "at").join(items.hint("merge"), "item_at").select("at", "doc", "tokens", "item", "text", "diagonals")
    return hits, checked.mapInArrow(_verify(min_tokens, min_identity), "row long, doc long, item long, start int, n_tokens int, n_equal int").withColumnRenamed("row", "at")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY,
) -> DataFrame:
    """doc_id, item_id, start (token of the document), n_tokens, n_equal: the best overlap of each pair that has one."""
    _, found = _search(docs, benchmark, id_col, text_col, item_col, item_text_col, min_tokens, min_identity, False)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_tokens", "n_equal")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY,
) -> DataFrame:
    """The rows of docs without those that overlap an item. Rows that no seed hits never move; the others meet the verdict."""
    rows, found = _search(docs, benchmark, id_col, text_col, item_col, item_text_col, min_tokens, min_identity, True)
    leaked = written(found.select("at").distinct(), "bench-leaked")
    left = rows.where("hash IS NOT NULL").select("at", "row").join(leaked.hint("merge"), "at", "left_anti")
    return rows.where("hash IS NULL").select("row.*").unionByName(left.select("row.*"))
