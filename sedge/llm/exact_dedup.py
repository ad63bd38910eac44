"""Exact dedup by Patricia-trie owners.

Each input partition first puts its own texts into a radix trie, so that a text
leaves it once however often it occurs there. Those texts, dealt by length and
content hash, are inserted whole into the trie of the partition that owns them;
its terminal nodes hold the smallest identifier, and heavy subtrees spill. The
owners answer with a few numbers per text and input partition, which are joined
back to the identifiers that stayed behind: no task ever holds all copies of a text.
`unique_rows` sends the rows themselves instead, in ascending order of identifiers, so
that the row that first reaches a terminal node is the one that stays.

Defined results: a null text counts as empty; a null identifier sorts after all
others; of rows that share text and identifier one stays; other columns of the
input are not read (`unique_rows` hands them on, whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import arrow_rows, partitions, written

#: Runs of these become one space before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of keys that a trie keeps in memory before it spills its heaviest subtree.
TRIE_BYTES = 64 << 20
#: What a node and a value of it take besides the label.
NODE_BYTES, VALUE_BYTES = 200, 40
_NONE = (1 << 63) - 1


class _Node:
    __slots__ = ("label", "children", "value", "weight", "spill")

    def __init__(self, label: bytes):
        self.label, self.children, self.value, self.weight, self.spill = label, {}, None, 0, None


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """A radix trie from byte strings to values merged by `merge`, within `bound` bytes of labels, nodes and values."""

    def __init__(self, merge, bound: int = TRIE_BYTES):
        self.root, self.merge, self.bound, self.held = _Node(b""), merge, bound, 0

    def insert(self, key: bytes, value, late=None) -> bool | None:
        """Whether the key is new; None if its subtree is on disk, where that can't be told yet. late: makes the value of a key that goes there."""
        node, at = self.root, 0
        path = [node]
        while True:
            if at == len(key):
                new = node.value is None
                node.value = value if new else self.merge(node.value, value)
                self._grew(path, VALUE_BYTES)
                return new
            child = node.children.get(key[at])
            if child is None:
                leaf = node.children[key[at]] = _Node(key[at:])
                leaf.value = value
                path.append(leaf)
                self._grew(path, len(key) - at + NODE_BYTES + VALUE_BYTES)
                return True
            if child.spill is not None:
                pickle.dump((key, late() if late else value), child.spill)
                return None
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                path.append(node)
                continue
            k = _shared(label, key[at : at + len(label)])
            middle = _Node(label[:k])
            middle.weight = child.weight
            child.label = label[k:]
            child.weight -= k
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            node, at = middle, at + k
            path.append(middle)

    def _grew(self, path: list[_Node], size: int) -> None:
        for n in path:
            n.weight += size
        self.held += size
        if self.held > self.bound:
            self._spill()

    def _spill(self) -> None:
        """Moves the heaviest subtree below the first fork, a single long key too, to a file that vanishes with the task;
        the first byte of its keys stays, and whatever comes to it later goes to the file."""
        node, prefix, path = self.root, b"", [self.root]
        while node.value is None and len(node.children) == 1 and next(iter(node.children.values())).spill is None:
            (node,) = node.children.values()
            prefix += node.label
            path.append(node)
        open_ = [c for c in node.children.values() if c.spill is None]
        if not open_:
            return  # what is left is a key that all others begin with
        child = max(open_, key=lambda c: c.weight)
        scratch = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
        file = tempfile.TemporaryFile(dir=scratch if scratch and os.path.isdir(scratch) else None)
        below: list[_Node] = []
        for record in _terminals(child, prefix, below):
            pickle.dump(record, file)
        for spilled in below:
            for record in _records(spilled.spill):
                pickle.dump(record, file)
        for n in path:
            n.weight -= child.weight
        self.held -= child.weight
        child.label, child.spill = child.label[:1], file
        child.children, child.value, child.weight = {}, None, 0

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All keys and values, resident subtrees first, then the spilled ones, each through a trie of its own."""
        spilled: list[_Node] = []
        yield from _terminals(self.root, b"", spilled)
        self.root = _Node(b"")
        for node in spilled:
            below = PatriciaTrie(self.merge, self.bound)
            for record in _records(node.spill):
                below.insert(*record)
            yield from below.items()


def _records(file) -> Iterator[tuple[bytes, object]]:
    """What a spill file holds, from its start; the file goes after it."""
    file.seek(0)
    with file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _terminals(node: _Node, prefix: bytes, spilled: list) -> Iterator[tuple[bytes, object]]:
    stack = [(node, prefix)]
    while stack:
        n, before = stack.pop()
        if n.spill is not None:
            spilled.append(n)
            continue
        key = before + n.label
        if n.value is not None:
            yield key, n.value
        stack += [(c, key) for c in n.children.values()]


LOCAL = pa.schema([("rep", pa.int64()), ("norm", pa.binary()), ("ids", pa.list_(pa.int64()))])
OWNED = pa.schema([("rep", pa.int64()), ("keep_rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a partition, each once, with the sorted identifiers of its rows."""
    add, take = arrow_rows(LOCAL, 512)
    number = TaskContext.get().partitionId() << 36

    def flush(trie):
        nonlocal number
        for norm, ids in trie.items():
            add(number, norm, sorted(ids))
            number += 1
            yield from take()

    def merge(a, b):
        a.extend(b)
        return a

    trie, seen = PatriciaTrie(merge), 0
    for batch in batches:
        for key, row_id in zip(batch.column(0), batch.column(1)):
            key, row_id = key.as_py(), row_id.as_py()
            trie.insert(key, array("q", [_NONE if row_id is None else row_id]))
            seen += len(key) + VALUE_BYTES
        if seen > TRIE_BYTES // 2:  # a text may then leave twice, which its owner settles
            yield from flush(trie)
            trie, seen = PatriciaTrie(merge), 0
    yield from flush(trie)
    yield from take(True)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the smallest identifier, its holder and the count, told to each holder."""
    add, take = arrow_rows(OWNED)

    def merge(a, b):
        low = min(a[0], b[0])
        a[2].extend(b[2])
        return low, a[1] + b[1], a[2]

    trie = PatriciaTrie(merge)
    for batch in batches:
        for norm, rep, low, count in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
            trie.insert(norm.as_py(), ((low, rep), count, array("q", [rep])))
    for _, ((low, keep_rep), count, reps) in trie.items():
        for rep in reps:
            add(rep, keep_rep, None if low == _NONE else low, count)
            yield from take()
    yield from take(True)


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Both sides of its join grow with the input: none is broadcast."""
    spark = docs.sparkSession
    rows = docs.select(F.encode(normalised(F.col(text_col)), "UTF-8").alias("norm"), F.col(id_col).cast("long").alias("id"))
    local = written(rows.mapInArrow(_local, "rep long, norm binary, ids array<long>"), "dedup-local")
    dealt = local.select("norm", "rep", F.col("ids")[0].alias("low"), F.size("ids").cast("long").alias("n")).repartition(
        partitions(spark, local), F.octet_length("norm"), F.xxhash64("norm")
    )
    owned = dealt.mapInArrow(_owners, "rep long, keep_rep long, keep_id long, group_size long")
    back = local.select("rep", "ids", F.sha2("norm", 256).alias("text_sha256")).join(owned.hint("merge"), "rep")
    return back.select("rep", "keep_rep", "keep_id", "group_size", "text_sha256", F.posexplode("ids").alias("at", "id")).select(
        F.when(F.col("id") != _NONE, F.col("id")).alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("rep") == F.col("keep_rep")) & (F.col("at") == 0)).alias("kept"),
        "text_sha256",
    )


_SEEN = (0, None)


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with equal `norm` within a stretch of the partition the one with the smallest `id`."""
    trie, held, seen = PatriciaTrie(min, 1 << 62), [], 0

    def flush():
        kept: dict[int, list[int]] = {}
        for _, (_, b, i) in trie.items():
            kept.setdefault(b, []).append(i)
        for b in sorted(kept):
            yield held[b].take(pa.array(sorted(kept[b]), pa.int32()))

    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            held.append(batch)
            for i, (key, row_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                trie.insert(key, (_NONE if row_id is None else row_id, len(held) - 1, i))
                seen += len(key) + VALUE_BYTES
            if seen > TRIE_BYTES // 2:  # a text may then leave twice, which its owner settles
                yield from flush()
                trie, held, seen = PatriciaTrie(min, 1 << 62), [], 0
    yield from flush()


def _first(batches: Iterator[pa.RecordBatch], bound: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """Of rows with equal `norm` the first. Rows whose subtree is on disk follow there, and come last."""
    trie, place = PatriciaTrie(min_place, bound), 0
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            keep = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                place += 1
                if trie.insert(key, _SEEN, lambda: (place, batch.take(pa.array([i], pa.int32())))):
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep, pa.int32()))
    for _, (_, row) in trie.items():
        if row is not None:
            yield row


def min_place(a: tuple, b: tuple) -> tuple:
    return a if a[0] <= b[0] else b


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, whole: texts pass one shuffle, to their owners, and come out of it."""
    spark = docs.sparkSession
    rows = docs.select(F.encode(normalised(F.col(text_col)), "UTF-8").alias("norm"), F.col(id_col).cast("long").alias("id"), F.struct("*").alias("row"))
    dealt = rows.mapInArrow(_thinned, rows.schema).repartition(partitions(spark, docs), F.octet_length("norm"), F.xxhash64("norm"))
    return dealt.sortWithinPartitions(F.col("id").asc_nulls_last()).mapInArrow(_first, rows.schema).select("row.*")
