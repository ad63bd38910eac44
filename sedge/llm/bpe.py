"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that no vocabulary token contains can never end up
inside one token, so a piece of text may be cut there and the fragments encoded
apart. Texts are cut at single blanks, at the vocabulary's pre-token borders and
at forced pairs; the fragments repeat endlessly and are looked up.

Defined results: a null text counts as empty and gives no ids; special tokens
written out in a text become their ids; a text of any length is whole, and a
fragment of any length takes n log n steps; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import arrow_rows

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies, with possessive repeats.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_DOUBLE_BLANK = re.compile(r"\s \s")
#: Entries that the chunk table and the fragment table of a Python worker keep.
CACHE = 100_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def cut(text: str) -> list[str]:
    """Chunks with the blank that leads them. A single blank next to no other white space is always a pre-token border."""
    if _DOUBLE_BLANK.search(text) or text.endswith(" ") and text[-2:-1].isspace():
        return re.split(r"(?<=\S)(?= \S)", text)
    if "\0" in text:
        return re.split(r"(?<!^)(?= )", text)
    return text.replace(" ", "\0 ").split("\0")


class ChunkTable:
    """Values of chunks, kept between batches; once it is full, new ones stay for their batch only."""

    def __init__(self, bound: int):
        self.table: dict[str, object] = {}
        self.bound, self.guests = bound, []

    def missing(self, cuts: list[list[str]]) -> list[str]:
        for chunk in self.guests:
            del self.table[chunk]
        self.guests = []
        return list(set().union(*cuts).difference(self.table))

    def put(self, chunk: str, value) -> None:
        if len(self.table) >= self.bound or len(chunk) > 64:
            self.guests.append(chunk)
        self.table[chunk] = value


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[bytes(letters[c] for c in a), bytes(letters[c] for c in b)] = rank
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.inside = np.zeros(65536, bool)
        for token in self.ids:
            for a, b in zip(token, token[1:]):
                self.inside[a << 8 | b] = True
        self.pretoken = regex.compile(PRETOKEN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragments: dict[bytes, tuple[int, ...]] = {}
        self.chunks = ChunkTable(CACHE)
        self.native = self._native()

    def _native(self):
        """The merge step of an installed library, where ranks of merges and ids of their results have the same order."""
        results = [self.ids[a + b] for a, b in sorted(self.ranks, key=self.ranks.get)]
        if results != sorted(set(results)) or any(bytes([b]) not in self.ids for b in range(256)):
            return None
        if len(results) + 256 != len(self.ids):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})._core_bpe.encode_single_piece

    # --- encoding ---

    def forced(self, pieces: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The fragments between byte pairs that no token contains, and where those of each piece end."""
        raw = b"".join(pieces)
        at = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = ~self.inside[at[:-1].astype(np.uint16) << 8 | at[1:]]
        cut[0] = True
        cut[ends] = True
        places = np.flatnonzero(cut)
        bounds = places.tolist()
        return [raw[i:j] for i, j in zip(bounds, bounds[1:])], np.searchsorted(places, ends).tolist()

    def merged(self, fragment: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost first: a heap over a linked list."""
        parts: list[bytes | None] = [fragment[i : i + 1] for i in range(len(fragment))]
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return tuple(self.ids[p] for p in parts if p is not None)

    def fragment(self, piece: bytes) -> tuple[int, ...]:
        if self.native is None or len(piece) > 500:
            out = self.merged(piece)
        else:
            out = tuple(self.native(piece))
        if len(piece) <= 64:
            if len(self.fragments) < CACHE:
                self.fragments[piece] = out
        return out

    def pieces(self, chunk: str) -> list[str]:
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        return self.pretoken.findall(chunk)

    def plain(self, chunks: list[str]) -> Iterator[list[int]]:
        """Ids of each chunk; special tokens mean nothing here."""
        pieces, last = [], []
        for chunk in chunks:
            pieces += self.pieces(chunk)
            last.append(len(pieces))
        if not pieces:
            yield from ([] for _ in chunks)
            return
        fragments, ends = self.forced([p.encode("utf-8", "replace") for p in pieces])
        known, fragment = self.fragments.get, self.fragment
        ids = [known(f) or fragment(f) for f in fragments]
        start = 0
        for n in last:
            end = ends[n - 1] if n else 0
            yield ids[start] if end - start == 1 else list(chain.from_iterable(ids[start:end]))
            start = end

    def digests(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """Per text the decimal ids joined by commas, their number, and the bytes they decode to."""
        cuts = []
        for text in texts:
            special = self.special and any(s in text for s in self.special)
            cuts.append([c for part in (self.split_special.split(text) if special else [text]) for c in ([part] if part in self.special else cut(part)) if c])
        missing, table, put = self.chunks.missing(cuts), self.chunks.table, self.chunks.put
        tokens = self.tokens
        for chunk, ids in zip(missing, self.plain(missing)):
            if chunk in self.special:
                ids = [self.special[chunk]]
            put(chunk, (",".join(map(str, ids)), len(ids), b"".join(map(tokens.__getitem__, ids))))
        for chunks in cuts:
            if chunks:
                decimals, counts, raw = zip(*map(table.__getitem__, chunks))
                yield ",".join(decimals), sum(counts), b"".join(raw)
            else:
                yield "", 0, b""

    def forget(self) -> None:
        """Empties the tables: a worker outlives its task and shares its executor's memory with what comes next."""
        self.fragments.clear()
        self.chunks = ChunkTable(CACHE)

    def encode(self, text: str) -> list[int]:
        decimals = next(self.digests([text]))[0]
        return list(map(int, decimals.split(","))) if decimals else []

    # --- decoding ---

    def decoded_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decoded_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per document."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        add, take = arrow_rows(schema, 64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                add(doc_id, bpe.encode(text.as_py() or ""))
                yield from take()
        yield from take(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        add, take = arrow_rows(schema, 64)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                add(doc_id, bpe.decode(ids.as_py() or []))
                yield from take()
        yield from take(True)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass, without the ids leaving their task."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        add, take = arrow_rows(schema, 2000)
        sha = hashlib.sha256
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [text or "" for text in part.column(1).to_pylist()]
                for doc_id, (decimals, n, raw) in zip(part.column(0).to_pylist(), bpe.digests(texts)):
                    decoded = raw.decode("utf-8", "replace").encode()
                    add(doc_id, n, sha(decimals.encode()).hexdigest(), sha(decoded).hexdigest())
            yield from take()
        bpe.forget()
        yield from take(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
