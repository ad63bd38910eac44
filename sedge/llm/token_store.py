"""Token ids as a content-addressed store.

Ids of each document, with the end id, are cut into chunks where a rolling hash of
the last eight ids says so. A folder holds, as Parquet that any Spark reader opens:

  chunks/    sha (32 bytes, of `ids`), ids (little-endian, 2 bytes where the vocabulary allows, else 4) - each once
  recipes/   doc_id, part, at, within, n_tokens, root, refs [(sha, n)] - in ascending order of doc_id
  manifest/  part, n_docs, n_tokens, first, root - a Merkle root for each part of the recipes; width of the ids

root of a document is the Merkle root of its chunks' hashes, root of a part that of
its documents' roots. Reading checks every chunk against its address and every root.

Defined results: a null text counts as empty, so its stream is the end id alone; null identifiers
come first; of rows that repeat an identifier each has a stream; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.bpe import byte_letters, cut, default_path
from sedge.llm.common import arrow_rows, free, fresh_path, mixed, partitions, written

#: Ids in a chunk: at least, on average beyond that, at most.
LEAST, AVERAGE, MOST = 128, 1024, 8192
#: Letters below this (Latin, Greek, Cyrillic) are letters to every version of Unicode in use.
_SETTLED = "\u0530"
_LETTERS = "".join(c for c in map(chr, range(ord(_SETTLED))) if c.isalpha())
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
#: Pre-tokens of settled letters, ASCII digits and punctuation, and line ends.
_PIECES = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]++| ?[0-9]++| ?[{re.escape(_MARKS)}]++|\n")
_BLANKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
#: A blank between white space, or a last one behind it: not every blank of such a text is a border.
_NEAR_BLANK = rf"[{_BLANKS}] (?:[{_BLANKS}]|\z)"
#: Kinds of bytes: what changes its kind within a chunk begins a pre-token, unless the chunk holds something odd.
_BLANK, _LETTER, _DIGIT, _MARK, _LINE, _ODD = range(6)
_KINDS = np.full(256, _ODD, np.uint8)
for _kind, _some in ((_BLANK, b" "), (_LETTER, "".join(c for c in _LETTERS if c.isascii()).encode()), (_DIGIT, b"0123456789"), (_MARK, _MARKS.replace("'", "").encode()), (_LINE, b"\n")):
    _KINDS[list(_some)] = _kind
_SETTLED_LETTERS = np.array([c.isalpha() for c in map(chr, range(0x800))]) & (np.arange(0x800) < ord(_SETTLED))
#: Entries of a Python worker's table of pre-tokens and chunks.
CACHE = 900_000


#: Ids that the rolling hash spans, and hashes that are made at a time.
SPAN, _BLOCK = 8, 1 << 15


_SALT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _gears() -> np.ndarray:
    """Hashes of ids of two bytes."""
    return mixed(np.arange(65536, dtype=np.uint64) + _SALT)


def boundaries(docs: list[np.ndarray], least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each document: content alone decides, so equal passages give equal chunks."""
    starts = np.cumsum([SPAN] + [len(d) + SPAN for d in docs])[:-1]
    ends = starts + np.array([len(d) for d in docs], np.int64)
    gear = np.zeros(int(ends[-1]) + SPAN if len(docs) else SPAN, np.uint64)  # zeros between documents: none reaches into the next
    known = _gears() if docs and docs[0].dtype.itemsize == 2 else None
    for a, b, ids in zip(starts.tolist(), ends.tolist(), docs):
        gear[a:b] = mixed(ids.astype(np.uint64) + _SALT) if known is None else known[ids]
    found = []
    for a in range(0, len(gear), _BLOCK):
        had = min(a, SPAN)
        rolling = gear[a - had : a + _BLOCK].copy()
        for i in (1, 2, 4):  # sums over 2, 4 and SPAN ids
            rolling[i:] += rolling[:-i] << np.uint64(i * 7)
        found.append(np.flatnonzero(mixed(rolling[had:]) % np.uint64(average) == 0) + (a + 1))
    marks = np.concatenate(found)
    out = []
    for first, end in zip(starts.tolist(), ends.tolist()):
        cuts, start = [], first
        if end - start > least:
            own = marks[np.searchsorted(marks, first + 1) : np.searchsorted(marks, end, "right")].tolist()
            k = 0
            while end - start > least:
                while k < len(own) and own[k] < start + least:
                    k += 1
                start = min(own[k] if k < len(own) else end, start + most, end)
                cuts.append(start - first)
        if start < end or not cuts:
            cuts.append(end - first)
        out.append(cuts)
    return out


class Merkle:
    """The root over leaves that come one by one: pairs hashed with a leading 1, a lone one passed up; one hash of each level is kept."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.peaks and self.peaks[-1][0] == level:
            leaf = hashlib.sha256(b"\1" + self.peaks.pop()[1] + leaf).digest()
            level += 1
        self.peaks.append((level, leaf))

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"").digest()
        out = self.peaks[-1][1]
        for _, left in reversed(self.peaks[:-1]):
            out = hashlib.sha256(b"\1" + left + out).digest()
        return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves' hashes; no leaves give the hash of nothing."""
    if len(leaves) == 1:
        return leaves[0]
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts with no blank next to white space on both sides, cut at every blank and, within chunks of settled letters, ASCII digits,
    punctuation but apostrophes and single line ends, at every pre-token; and where the pieces of each text begin, and the last end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    bounds = offsets.astype(np.int64) - base
    raw = np.frombuffer(texts.buffers()[2], np.uint8, size, base)
    kinds = _KINDS[raw]
    leads = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
    leads = leads[leads + 1 < size]
    leads = leads[_SETTLED_LETTERS[(raw[leads].astype(np.int64) & 0x1F) << 6 | raw[leads + 1] & 0x3F]]
    kinds[leads] = kinds[leads + 1] = _LETTER
    first = kinds == _BLANK  # a chunk begins
    begins = first.copy()
    begins[1:] |= (kinds[1:] != kinds[:-1]) & ~first[:-1]
    first[bounds[:-1][bounds[:-1] < size]] = True
    begins |= first
    places = np.flatnonzero(begins)
    odd = kinds == _ODD
    lines = np.flatnonzero(kinds[1:] == _LINE) + 1
    odd[lines] = (kinds[lines - 1] == _LINE) | (kinds[lines - 1] == _BLANK)
    odd = np.flatnonzero(odd)
    if len(odd):
        head = first[places]
        whole = np.zeros(int(head.sum()), bool)
        whole[np.searchsorted(places[head], odd, "right") - 1] = True
        places = places[head | ~whole[np.cumsum(head) - 1]]
    ends = np.append(places, size)
    found = pa.StringArray.from_buffers(len(places), pa.py_buffer((ends + base).astype(np.int32)), texts.buffers()[2])
    return found, np.searchsorted(places, bounds)


class LibraryEncoder(dict):
    """The tokenizers library, asked once for each pre-token where the vocabulary's own rules allow it: a table of pieces of texts
    and their little-endian ids. The texts of a batch are cut and their pieces told apart as arrays, so that the table is asked once
    for each distinct piece. Pre-tokens of settled characters go to the library's model alone; whatever else a piece holds goes to
    the library whole."""

    def __init__(self, path: str, bound: int = CACHE):
        super().__init__()
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.bound = bound
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre = file.get("pre_tokenizer") or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"]))) for t in file["added_tokens"])
        self.by_chunk = file.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and plain
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.special = [t["content"] for t in file["added_tokens"]]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.blank, self.code = self.letters[32], "H" if self.width == 2 else "I"
        self.wide = str.maketrans({chr(b): c for b, c in self.letters.items()})
        self[""] = b""  # stands before a leading blank
        self["\n"] = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        core = chunk[1:] if chunk[0] == " " else chunk
        if core.isalpha() and (core.isascii() or max(core) < _SETTLED):
            ids = self._one(chunk)
        else:
            pieces = _PIECES.findall(chunk)
            if "\n\n" in chunk or sum(map(len, pieces)) < len(chunk):
                ids = self._whole(chunk)
            else:
                ids = self._one(chunk) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))
        if len(self) < self.bound and len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def _one(self, pretoken: str) -> bytes:
        raw = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(self.wide)
        raw = self.blank + raw[1:] if raw[0] == " " else raw
        found = array(self.code, [t.id for t in self.model(raw)])
        return found.tobytes() if sys.byteorder == "little" else np.array(found, self.dtype).tobytes()

    def _apart(self, text: str) -> bytes:
        """Ids of a text that is not cut at each blank; one that may hold a special token is left to the library whole."""
        return self._whole(text) if not self.by_chunk or any(s in text for s in self.special) else b"".join(map(self.__getitem__, cut(text)))

    def encode(self, texts: list[str] | pa.Array, end: bytes = b"") -> list[bytes]:
        """Little-endian ids of each text, with end behind them."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        apart = pc.match_substring_regex(texts, _NEAR_BLANK) if self.by_chunk else pa.repeat(True, len(texts))
        for special in self.special:
            apart = pc.or_(apart, pc.match_substring(texts, special))
        alone = np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist()
        pieces, starts = pretokens(pc.if_else(apart, "", texts) if alone else texts)
        coded = pieces.dictionary_encode()
        known = list(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        last = np.full(len(texts), len(known))
        known.append(end)
        for i in alone:
            last[i] = len(known)
            known.append(self._apart(texts[i].as_py()) + end)
        ids = pa.array(known, pa.large_binary()).take(pa.array(np.insert(coded.indices.to_numpy().astype(np.int64), starts[1:], last)))
        _, offsets, data = ids.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(ids) + 1)[starts + np.arange(len(starts))].tolist()
        data = memoryview(data or b"")
        return [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


@lru_cache(2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


_STAGED = "doc_id long, n_tokens long, root binary, refs array<struct<sha: binary, n: int>>, fresh array<struct<sha: binary, ids: binary>>"
#: Documents and bytes of text that are encoded together, but for a longer text.
TOGETHER, TOGETHER_BYTES = 4096, 4 << 20


def _lists(counts: list[int], **columns: pa.Array) -> pa.Array:
    """Lists of structs from flat columns."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that are encoded at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        had = int(sizes[start - 1]) if start else 0
        n = int(np.searchsorted(sizes, had + TOGETHER_BYTES, "right")) - start
        n = min(max(n, 1), TOGETHER, batch.num_rows - start)
        yield batch.slice(start, n)
        start += n


def _stage(path: str, end_id: int, sizes: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        width, end = coder.width, np.array([end_id], coder.dtype).tobytes()
        sent: set[bytes] = set()  # addresses that this task has sent; forgotten when many
        sha256 = hashlib.sha256
        for whole in batches:
            whole = whole.set_column(1, "text", whole.column(1).cast(pa.string()))  # sessions may use large types, and a column of nulls has none
            for batch in _together(whole):
                streams = coder.encode(pc.fill_null(batch.column(1), ""), end)
                ids = [np.frombuffer(raw, coder.dtype) for raw in streams]
                roots, of_doc, lengths, new_of_doc = [], [], [], []
                shas, new_shas, new_ids = [], [], []
                for raw, ends in zip(streams, boundaries(ids, *sizes)):
                    a, had, before = 0, len(shas), len(new_shas)
                    for b in ends:
                        part = raw[a * width : b * width]
                        sha = sha256(part).digest()
                        shas.append(sha)
                        lengths.append(b - a)
                        if sha not in sent:
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(sha)
                            new_shas.append(sha)
                            new_ids.append(part)
                        a = b
                    roots.append(merkle(shas[had:]))
                    of_doc.append(len(shas) - had)
                    new_of_doc.append(len(new_shas) - before)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array(roots, pa.binary()),
                        _lists(of_doc, sha=pa.array(shas, pa.binary()), n=pa.array(lengths, pa.int32())),
                        _lists(new_of_doc, sha=pa.array(new_shas, pa.binary()), ids=pa.array(new_ids, pa.binary())),
                    ],
                    names=["doc_id", "n_tokens", "root", "refs", "fresh"],
                )
        pa.default_memory_pool().release_unused()

    return run


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by address the first of each."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sha = batch.column(0)
        new = np.ones(len(sha), bool)
        new[1:] = pc.not_equal(sha.slice(1), sha.slice(0, len(sha) - 1)).to_numpy(zero_copy_only=False)
        new[0] = sha[0].as_py() != last
        last = sha[-1].as_py()
        yield batch.filter(pa.array(new))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part, the place in it and the ids before it in the part."""
    part, at, within = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        before = within + np.concatenate([[0], np.cumsum(n)[:-1]])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(n), part), pa.int32()), pa.array(np.arange(at, at + len(n)), pa.int64()), pa.array(before, pa.int64())],
            names=[*batch.schema.names, "part", "at", "within"],
        )
        at, within = at + len(n), within + int(n.sum())


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int, int] = (LEAST, AVERAGE, MOST)) -> None:
    spark = docs.sparkSession
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged = written(rows.mapInArrow(_stage(path, end_id, sizes), _STAGED), "store-staged")
    fresh = staged.select(F.explode("fresh").alias("c")).select("c.sha", "c.ids")
    fresh.repartition(partitions(spark, staged), "sha").sortWithinPartitions("sha").mapInArrow(_unique, "sha binary, ids binary").write.option("compression", "zstd").parquet(f"{folder}/chunks")
    recipes = staged.select("doc_id", "n_tokens", "root", "refs").repartitionByRange(partitions(spark, staged), "doc_id", "root").sortWithinPartitions("doc_id", "root")
    recipes.mapInArrow(_numbered, "doc_id long, n_tokens long, root binary, refs array<struct<sha: binary, n: int>>, part int, at long, within long").write.parquet(f"{folder}/recipes")
    free(staged)
    # A part is one file, written and read in its order.
    parts = spark.read.parquet(f"{folder}/recipes").select("root", "n_tokens", "part", "at").repartition(partitions(spark), "part").sortWithinPartitions("part", "at")
    manifest = parts.mapInArrow(_by_part, "part int, n_docs long, n_tokens long, root binary").collect()  # a row for each part: MOST_PARTITIONS at most
    first, out = 0, []
    for r in sorted(manifest, key=lambda r: r["part"]):
        out.append((r["part"], r["n_docs"], r["n_tokens"], first, bytes(r["root"]), encoder(path).width))
        first += r["n_tokens"]
    spark.createDataFrame(out, "part int, n_docs long, n_tokens long, first long, root binary, width int").coalesce(1).write.parquet(f"{folder}/manifest")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root, documents and ids of each part, from its documents' roots in their order."""
    now: list = []

    def told():
        part, docs, tokens, tree = now
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [docs], "n_tokens": [tokens], "root": pa.array([tree.root()], pa.binary())})

    for batch in batches:
        for root, n, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
            if not now or now[0] != part:
                if now:
                    yield told()
                now = [part, 0, 0, Merkle()]
            now[1] += 1
            now[2] += n
            now[3].add(root)
    if now:
        yield told()


def _chunk_digests(width: int):
    schema = pa.schema([("sha", pa.binary()), ("good", pa.bool_()), ("length", pa.int64()), ("crc", pa.int64())])
    dtype = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, lengths, crcs = [], [], []
            for sha, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                good.append(hashlib.sha256(raw).digest() == sha)
                lengths.append(len(raw) // width)
                crcs.append(zlib.crc32(np.frombuffer(raw, dtype).astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    return run


_ZEROS = bytes(4 * 65536)


def _zeros_crc(n: int, start: int) -> int:
    while n > len(_ZEROS):
        start = zlib.crc32(_ZEROS, start)
        n -= len(_ZEROS)
    return zlib.crc32(memoryview(_ZEROS)[:n], start)


def joined_crc(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings in a row from theirs; length is that of the second."""
    return _zeros_crc(length, a) ^ _zeros_crc(length, 0) ^ b


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("verified", pa.bool_())])
    add, take = arrow_rows(schema)
    for batch in batches:
        for doc, start, n, root, parts in zip(*(c.to_pylist() for c in batch.columns)):
            parts.sort(key=lambda p: p["pos"])
            crc, total = 0, 0
            for p in parts:
                crc = joined_crc(crc, p["crc"] or 0, 4 * (p["length"] or 0))
                total += p["length"] or 0
            good = total == n and merkle([p["sha"] for p in parts]) == root and all(p["good"] and p["length"] == p["n"] for p in parts)
            add(doc, start, total, crc, good)
        yield from take()
    yield from take(True)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified: from the files. Each chunk is read and checked once, and a document's
    crc32 is put together from those of its chunks in the order of its recipe, so no ids are shuffled."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    width = (manifest.select("width").first() or [4])[0]
    digests = spark.read.parquet(f"{folder}/chunks").mapInArrow(_chunk_digests(width), "sha binary, good boolean, length long, crc long")
    recipes = spark.read.parquet(f"{folder}/recipes")
    refs = recipes.select("part", "at", F.posexplode("refs").alias("pos", "ref")).select("part", "at", "pos", "ref.sha", "ref.n")
    of_doc = refs.join(digests.hint("merge"), "sha", "left").groupBy("part", "at").agg(F.collect_list(F.struct("pos", "sha", "n", "good", "length", "crc")).alias("parts"))
    whole = recipes.select("doc_id", "part", "at", "within", "n_tokens", "root").join(of_doc.hint("merge"), ["part", "at"])
    whole = whole.join(F.broadcast(manifest.select("part", "first")), "part")  # a row for each file of recipes: MOST_PARTITIONS at most
    return whole.select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "root", "parts").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean"
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids: the streams themselves, put together from the chunks."""
    width = (spark.read.parquet(f"{folder}/manifest").select("width").first() or [4])[0]
    dtype = np.dtype("<u2" if width == 2 else "<u4")
    recipes, chunks = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/chunks")
    refs = recipes.select("part", "at", "doc_id", F.posexplode("refs").alias("pos", "ref")).select("part", "at", "doc_id", "pos", "ref.sha")
    parts = refs.join(chunks.hint("merge"), "sha").groupBy("part", "at", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        add, take = arrow_rows(schema, 64)
        for batch in batches:
            for doc, pieces in zip(batch.column(0).to_pylist(), batch.column(1)):
                add(doc, np.frombuffer(b"".join(p["ids"] for p in pieces.as_py()), dtype).tolist())
                yield from take()
        yield from take(True)

    return parts.select("doc_id", "parts").mapInArrow(run, "doc_id long, ids array<long>")


def store_digests(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the store to folder (by default a new one in the shared scratch folder) and reads it back."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-store")
    write_store(docs, folder, path)
    return read_digests(spark, folder)
