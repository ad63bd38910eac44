"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Documents with the same set of word shingles form a class; its smallest id stands for it.
2. A class has `trees` labels of `depth` MinHash values each. Labels that share their first
   `least` values stand in one subtree of the sorted prefix trie of their tree; subtrees of
   one class go at once. Within a subtree the longest common prefixes of neighbours in
   sorted order are the trie: a node is a run of labels, and a node with the labels of
   its only child is skipped.
3. From `depth` upwards, classes of a node whose signatures agree in `floor` of all values
   are matched, at the deepest node that holds both. Signatures estimate the similarity s
   of matched classes, 1 - (1 - s^d)^trees is the share of such pairs that prefixes of d
   values find, and the sum of its inverses the number of pairs there are. d is shortened
   from `depth` until the matched ones are `target` of them (`chosen_level`).
4. Components of matches are candidate clusters. Jaccard similarities of all pairs in a
   cluster are computed exactly, block by block, and leave a task as degrees and as a
   spanning forest of the links, never as pairs. Only clusters of over `block` classes are
   dealt out as pairs of blocks, and those as arrays of shingles.

Defined results: a word is a run of non-blanks in lower case; a text of fewer words
than a shingle is one shingle; a null, empty or blank text has no shingles and no
links; rows with a null identifier are classes of their own without links; rows that
repeat an identifier count as documents each, and links are looked up by identifier (of
different texts under one identifier that is the smallest of two classes, one class has the
links); other columns are not read (`unlike_rows` hands them on, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import WordHashes, arrow_rows, components, free, grouped, mixed, partitions, shingles, written

SHINGLE = 5
SIMILARITY = 0.8
TREES = 16
#: Values of a label, and those of the shortest prefix that is looked at.
DEPTH, LEAST = 6, 3
TARGET_RECALL = 0.9999
#: Agreement of signatures below which a pair cannot reach the similarity but with a chance under 1e-8.
FLOOR = 0.55
#: Matched classes count for the choice of the level if their signatures agree in so little less than the similarity.
SLACK = 0.1
BLOCK = 512
#: Classes of one subtree that a task compares at once.
GROUP_BLOCK = 65_536
#: Keys that a large cluster's rows are dealt to where the size of the cluster is looked up.
SALTS = 64

_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, TREES * 16, np.int64).astype(np.uint64) | np.uint64(1)


def found_share(similarity: float, level: int, trees: int) -> float:
    """The share of pairs of a similarity that agree in the first `level` values of one of the labels."""
    return 1 - (1 - similarity**level) ** trees


def chosen_level(matched: dict[int, dict[float, int]], similarity: float, trees: int, depth: int, least: int, target: float) -> int:
    """The longest prefix whose matches are `target` of the pairs there are. matched: by level the numbers of matches that
    are first found there, by estimated similarity. A pair just at the similarity counts as one that was seen."""
    seen, all_ = 1.0, {d: 1 / found_share(similarity, d, trees) for d in range(least, depth + 1)}
    for level in range(depth, least, -1):
        for s, n in matched.get(level, {}).items():
            seen += n
            for d in all_:
                all_[d] += n / found_share(max(s, similarity), d, trees)
        if seen >= target * all_[level]:
            return level
    return least


def _minhash(s: np.ndarray, count: int) -> np.ndarray:
    """count minima of distinct mixes of the shingles."""
    out = np.empty(count, np.uint64)
    for start in range(0, len(s), 8192):
        part = (s[start : start + 8192, None] * _SEEDS[None, :count])
        part ^= part >> np.uint64(29)
        low = (part * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0)
        out = low if not start else np.minimum(out, low)
    return out


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


SIGNED = pa.schema([("doc", pa.int64()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])


def _signatures(width: int, trees: int, depth: int):
    """sig: two bytes of each value, label after label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(SIGNED, 4000)
        hashes = WordHashes()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(hashes.of(words_of(text.as_py())), width)
                if len(s):
                    low = _minhash(s, trees * depth)
                    with np.errstate(over="ignore"):
                        h1, h2 = np.add.reduce(mixed(s)), np.bitwise_xor.reduce(mixed(s + np.uint64(0x5851F42D4C957F2D)))
                    add(doc, len(s), int(h1.astype(np.int64)), int(h2.astype(np.int64)), mixed(low).astype("<u2").tobytes())
                else:
                    add(doc, 0, 0, 0, b"")
                yield from take()
        yield from take(True)

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
    return root


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32()), ("agree", pa.int32())])


def trie_nodes(labels: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(level, start, end) of the nodes over two labels and more of a trie over sorted labels, the deepest level first; a node
    with no more labels than its child is left out."""
    n, depth = labels.shape
    common = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1)  # the longest common prefix of neighbours
    below: set[tuple[int, int]] = set()
    for level in range(depth, least - 1, -1):
        inside = np.concatenate([[False], common >= level, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        runs = set(zip(turns[::2].tolist(), (turns[1::2] + 1).tolist()))
        for start, end in sorted(runs - below):
            yield level, start, end
        below = runs


def _trie_edges(floor: float, depth: int, least: int):
    """Matches the classes of each node whose signatures agree, by spanning edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(EDGES)
        for group in grouped(batches, ["node", "i", "j"]):
            if group.num_rows < 2:
                continue
            docs, tree = group.column("doc").to_numpy(), group.column("tree")[0].as_py()
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(docs), -1)
            order = np.lexsort(sigs[:, tree * depth : (tree + 1) * depth].T[::-1])
            docs, sigs = docs[order], sigs[order]
            need = floor * sigs.shape[1]
            for level, start, end in trie_nodes(sigs[:, tree * depth : (tree + 1) * depth], least):
                # Rounds of a leader against the rest: those that agree with it leave with it, and bring their own matches.
                rest = np.arange(start, end)
                while len(rest) > 1:
                    reached, rest = [rest[:1]], rest[1:]
                    while reached and len(rest):
                        front = np.concatenate(reached)
                        reached = []
                        for i in front:
                            if not len(rest):
                                break
                            agree = (sigs[rest] == sigs[i]).sum(axis=1)
                            near = agree >= need
                            if near.any():
                                for j, k in zip(rest[near], agree[near]):
                                    a, b = int(docs[i]), int(docs[j])
                                    if a != b:
                                        add(max(a, b), min(a, b), level, int(k))
                                reached.append(rest[near])
                                rest = rest[~near]
                    yield from take()
        yield from take(True)

    return run


LINKS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and columns of the shingles that at least two sets have, and their number."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = count[column] > 1
    renumber = np.cumsum(count > 1) - 1
    return row[common], renumber[column[common]], int((count > 1).sum())


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Shared shingles of each of the first `left` sets with each set: products of 0/1 matrices, a strip of shingles at a time."""
    n = len(sets)
    out = np.zeros((left, n), np.float32)
    row, column, width = _incidence(sets)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    strip = max(256, (16 << 20) // (4 * n))
    for start in range(0, width, strip):
        a, b = np.searchsorted(column, [start, start + strip])
        if a == b:
            continue
        m = np.zeros((n, min(strip, width - start)), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        out += m[:left] @ m.T
    return out


def _sets(width: int):
    """text as its sorted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            raw = [shingles(hashes.of(words_of(t.as_py())), width).tobytes() for t in batch.column(at)]
            yield batch.set_column(batch.schema.get_field_index("set"), "set", pa.array(raw, pa.binary())).set_column(at, "text", pa.nulls(len(raw), pa.string()))

    return run


def _verify(width: int, similarity: float):
    """Exact similarities within a cluster, or between the two blocks of one. Rows (0, doc, weight of its links here) and (1, a, b), spanning links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(LINKS)
        hashes = WordHashes()
        for group in grouped(batches, ["cluster", "i", "j"]):
            if group.num_rows < 2:
                continue
            group = group.sort_by([("side", "ascending"), ("doc", "ascending")])
            sets = [np.frombuffer(raw, np.uint64) if raw is not None else shingles(hashes.of(words_of(t.as_py())), width) for raw, t in zip(group.column("set").to_pylist(), group.column("text"))]
            ids, want = group.column("doc").to_numpy(), group.column("size").to_numpy()
            if (ids[1:] == ids[:-1]).any():  # an identifier's rows: the one with the set of its class
                first: dict[int, int] = {}
                for k, i in enumerate(ids.tolist()):
                    if i not in first or len(sets[first[i]]) != want[k] == len(sets[k]):
                        first[i] = k
                keep = sorted(first.values())
                group, sets = group.take(keep), [sets[k] for k in keep]
            n = group.num_rows
            left = int(pc.sum(pc.equal(group.column("side"), 0)).as_py() or 0)
            apart = left < n
            if n < 2 or apart and not left:
                continue
            docs = group.column("doc").to_numpy()
            weight = group.column("weight").to_numpy()
            sizes = np.fromiter(map(len, sets), np.int64, n)
            if n == 2:
                shared = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]], np.float32)
                rows = 1
            else:
                shared, rows = overlaps(sets, left), left
            # |A and B| / |A or B| >= s, in whole numbers
            total = (sizes[:rows, None] + sizes[None, :]).astype(np.float64)
            linked = shared.astype(np.float64) * (1 + similarity) >= similarity * total * (1 - 1e-12)
            at = np.arange(n)
            linked &= (at[None, :] > at[:rows, None]) if not apart else (at[None, :] >= left)
            a, b = np.nonzero(linked)
            if not len(a):
                continue
            degree = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
            for i in np.flatnonzero(degree):
                add(0, int(docs[i]), int(degree[i]))
            root = _roots(n, a, b)
            for i in np.flatnonzero(root != at):
                add(1, int(docs[i]), int(docs[root[i]]))
            yield from take()
        yield from take(True)

    return run


def _blocked(frame: DataFrame) -> DataFrame:
    """Each row once for every pair of its block with a block of its group: i <= j, side tells which is its own."""
    names = [c for c in frame.columns if c != "blocks"]
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j"), (o < F.col("mine")).cast("int").alias("side")),
    )
    return frame.withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).select(*names, F.explode(pairs).alias("at")).select(*names, "at.i", "at.j", "at.side")


class _Join:
    """The steps of the join up to candidate clusters, and their verification."""

    def __init__(self, docs: DataFrame, id_col, text_col, width, similarity, trees, depth, least, target, floor, block, group_block):
        # Both sides of every join here grow with the input: none is broadcast, at any size.
        self.width, self.similarity, self.block = width, similarity, block
        self.source = docs
        n_parts = partitions(docs.sparkSession, docs.select(id_col, text_col))
        rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        signed = written(rows.mapInArrow(_signatures(width, trees, depth), "doc long, size int, h1 long, h2 long, sig binary"), "jaccard-signed")
        same = ["size", "h1", "h2"]
        sets = signed.where("size > 0 AND doc IS NOT NULL")
        classes = written(sets.groupBy(*same).agg(F.min("doc").alias("rep"), F.count("*").alias("weight"), F.first("sig").alias("sig")), "jaccard-classes")
        self.members = written(signed.select("doc", *same).join(classes.select(*same, "rep", "weight").hint("merge"), same, "left").select("doc", "rep", "weight"), "jaccard-members")
        free(signed)
        reps = classes.groupBy("rep").agg(F.min(F.struct("size", "h1", "h2", "weight", "sig")).alias("of")).select(F.col("rep").alias("doc"), "of.size", "of.weight", "of.sig")
        reps = written(reps, "jaccard-reps")
        free(classes)

        nodes = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", t * 2 * depth + 1, 2 * least)).alias("node")) for t in range(trees)])
        labels = reps.select("doc", F.explode(nodes).alias("at")).select("doc", "at.tree", "at.node")
        crowded = labels.groupBy("node").count().where("count > 1")
        crowded = written(crowded.select("node", F.ceil(F.col("count") / group_block).cast("int").alias("blocks")), "jaccard-crowded")
        in_trees = labels.join(crowded.hint("merge"), "node").join(reps.select("doc", "sig").hint("merge"), "doc")
        dealt = _blocked(in_trees).select("node", "i", "j", "tree", "doc", "sig").repartition(n_parts, "node", "i", "j").sortWithinPartitions("node", "i", "j")
        edges = dealt.mapInArrow(_trie_edges(floor, depth, least), "a long, b long, level int, agree int")
        matches = written(edges.groupBy("a", "b").agg(F.max("level").alias("level"), F.max("agree").alias("agree")), "jaccard-matches")
        free(crowded)
        matched: dict[int, dict[float, int]] = {}
        values = trees * depth
        for r in matches.where(F.col("agree") >= (similarity - SLACK) * values).groupBy("level", "agree").count().collect():  # levels times agreements, whatever the data
            matched.setdefault(r["level"], {})[r["agree"] / values] = r["count"]
        self.level = chosen_level(matched, similarity, trees, depth, least, target)
        roots = components(matches.where(F.col("level") >= self.level).select("a", "b"), "jaccard-near")
        clusters = written(roots.select(F.col("node").alias("doc"), F.col("root").alias("cluster")).union(roots.select("root", "root").distinct()), "jaccard-clusters")
        free(matches)
        # A cluster's rows stay apart where its size is looked up.
        large = clusters.groupBy("cluster").count().where(F.col("count") > block)
        large = large.select("cluster", F.ceil(F.col("count") / block).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = clusters.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(large.hint("merge"), ["cluster", "salt"], "left")
        salted = salted.select("doc", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        self.dealt = written(salted.join(reps.select("doc", "size", "weight").hint("merge"), "doc"), "jaccard-dealt")
        free(clusters, reps)

    def links(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rep, degree) and (node, root) from the texts of clusters: doc, text, cluster, blocks, size, weight."""
        n_parts = partitions(texts.sparkSession, self.source)
        whole = texts.select("doc", "text", F.lit(None).cast("binary").alias("set"), "cluster", "blocks", "size", "weight")
        large = whole.where("blocks > 1")
        every = _blocked(whole.where("blocks = 1")).unionByName(_blocked(large.mapInArrow(_sets(self.width), whole.schema)))
        every = every.repartition(n_parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        checked = written(every.mapInArrow(_verify(self.width, self.similarity), "kind byte, a long, b long"), "jaccard-links")
        degrees = written(checked.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("degree")), "jaccard-degrees")
        linked = components(checked.where("kind = 1").select("a", "b"), "jaccard-linked")
        free(checked)
        return degrees, linked


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    depth: int = DEPTH,
    least: int = LEAST,
    target: float = TARGET_RECALL,
    floor: float = FLOOR,
    block: int = BLOCK,
    group_block: int = GROUP_BLOCK,
) -> DataFrame:
    """One row per document: doc_id, rep_id (smallest id with the same shingles), class_id
    (smallest id of its component of links), n_links (documents at or over the similarity, copies counted)."""
    join = _Join(docs, id_col, text_col, width, similarity, trees, depth, least, target, floor, block, group_block)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    degrees, linked = join.links(rows.join(join.dealt.hint("merge"), "doc"))
    found = degrees.join(linked.hint("merge"), degrees.rep == linked.node, "left").select("rep", "degree", "root")
    out = join.members.join(found.hint("merge"), "rep", "left")
    return out.select(
        F.col("doc").alias("doc_id"),
        F.coalesce("rep", "doc").alias("rep_id"),
        F.coalesce("root", "rep", "doc").alias("class_id"),
        (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("degree", F.lit(0))).alias("n_links"),
    )


def unlike_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    depth: int = DEPTH,
    least: int = LEAST,
    target: float = TARGET_RECALL,
    floor: float = FLOOR,
    block: int = BLOCK,
    group_block: int = GROUP_BLOCK,
) -> DataFrame:
    """The rows of docs whose identifier is the smallest of its component of links, whole. Texts pass one shuffle, to
    what is known of their identifier; then only those of clusters move."""
    join = _Join(docs, id_col, text_col, width, similarity, trees, depth, least, target, floor, block, group_block)
    copies = join.members.where("weight > 1").groupBy("doc").agg(F.min("rep").alias("rep"))
    known = join.dealt.withColumn("rep", F.col("doc")).unionByName(copies.where("doc <> rep"), allowMissingColumns=True)
    known = known.groupBy("doc").agg(*[F.min(c).alias(c) for c in ("rep", "cluster", "blocks", "size", "weight")])
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    rows = written(rows.join(known.hint("merge"), "doc", "left").where("rep IS NULL OR rep = doc"), "jaccard-rows")
    clustered = rows.where("cluster IS NOT NULL")
    _, linked = join.links(clustered)
    left = clustered.join(linked.select(F.col("node").alias("doc")).hint("merge"), "doc", "left_anti")
    return rows.where("cluster IS NULL").select("row.*").unionByName(left.select("row.*"))
