"""The pipeline stage by stage against plain Python, on the smallest tables and on hand-made rows."""

import re

import corpus_pipeline
from sedge.llm.common import table
from sedge.llm.decontaminate import tokens_of
from sedge.llm.queries import oracle_sql, queries


def test_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    docs = table(spark, sf, "documents")
    left = {r.doc_id: r.text for r in docs.collect()}
    items = [" ".join(tokens_of(r.text)) for r in table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) <= set(left)
        if name == "language_id":
            want = {i for i, t in left.items() if t and any(map(str.isalpha, t))}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(left):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[i] or ""), i)
            want = set(first.values())
        elif name == "near_dedup":
            want = near_kept(left)
        elif name == "decontaminate":
            want = {i for i, t in left.items() if not any(f" {x} " in f" {' '.join(tokens_of(t))} " for x in items)}
        else:
            want = set(left)
        assert set(got) == want, name
        left = {i: left[i] for i in got}
        if name != "bpe":
            assert out.columns == list(docs.columns)
            docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(left)


def near_kept(left):
    sets, root = {}, {i: i for i in left}
    for i, t in left.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in left:
        for j in left:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in left if find(i) == i}


def odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "An ordinary text with a few words in it.", "en", "a", 1), (2, "An  ordinary text\nwith a few words in it.", None, "a", 1), (2, "An  ordinary text\nwith a few words in it.", None, "a", 1),
        (None, "A text without an identifier but with words.", "en", None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, "12 34 !!", None, "b", 0), (6, "word " * 40_000, "en", "c", 9), (7, passage, "en", "c", 9),
        (8, passage.replace("p30", "other"), "en", "c", 9), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "norm", "id", "doc", "at", "rep", "cluster", "lang_pred", "hash"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_stages_on_odd_rows(spark, sf):
    docs, empty = odd_rows(spark), odd_rows(spark).limit(0)
    want = {
        "language_id": ["1", "2", "2", "6", "7", "8", "None"], "exact_dedup": ["1", "3", "5", "6", "7", "8", "None"],
        "near_dedup": ["1", "3", "4", "5", "6", "7", "None", "None"], "decontaminate": sorted(str(r.doc_id) for r in docs.collect()), "bpe": sorted(str(r.doc_id) for r in docs.collect()),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert sorted(str(r.doc_id) for r in out.collect()) == want[name], name
        assert stage(spark, empty, sf).collect() == []
        assert name == "bpe" or out.columns == list(corpus_pipeline.COLUMNS)


def test_language_id_stage_labels_and_stands_without_a_model(spark, sf):
    docs = table(spark, sf, "documents")
    from pyspark.sql import functions as F

    stage = dict(corpus_pipeline.STAGES)["language_id"]
    some = stage(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))), sf).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    hidden = [r for r in some if r.doc_id % 3 == 0 and truth[r.doc_id]]
    assert hidden and sum(r.lang == truth[r.doc_id] for r in hidden) > 0.9 * len(hidden)
    assert stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf).count() == len(some)


def test_every_operator_has_a_query():
    names = list(queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 11)] and names[-1] == "pipeline"
    assert set(oracle_sql()) <= set(names)
