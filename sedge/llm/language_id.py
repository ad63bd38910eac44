"""Language identification by hierarchical discrimination.

A linear classifier over families of languages answers first; within the family it
names, one-versus-one linear support vector machines vote for a language. Features
are hashed counts of one to four letters, taken from the whole text.

Defined results: only rows with a non-null text and language teach, at most `per_language` of
a language and `MOST_ROWS` in all, chosen by a hash of their identifier; a text that is null or has no letter is `und`
with score 0, and so is every text where no row can teach; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import arrow_rows

#: Bounds on the labelled rows that a model is fitted on: of a language, and of all together.
PER_LANGUAGE, MOST_ROWS = 600, 12_000
DIMENSIONS = 4096
UNDETERMINED = "und"

#: Families of common languages by code (general knowledge; a language that isn't listed is a family of its own).
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "finnic": "fi et",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn pa mr gu ne si",
    "semitic": "ar he am mt",
}


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in families.items() if base in codes.split()), lang)


def features(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Root-scaled frequencies of hashed letter n-grams, of length one; other characters count as one blank."""
    at = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = at > 127
    letter |= (at >= 97) & (at <= 122)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    code = np.where(letter, at, 32)[keep].astype(np.uint32)
    out = np.zeros(dimensions)
    rolling = np.zeros(len(code), np.uint32)
    for n in range(1, 5):
        if len(code) < n:
            break
        rolling = rolling[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32((0x85EBCA6B + 2 * n) & 0xFFFFFFFF)
        out += np.bincount((mixed >> np.uint32(20)) & np.uint32(dimensions - 1), minlength=dimensions)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32, copy=False)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised squared-hinge SVM, by accelerated gradient steps."""
    x = with_bias(x)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = v = np.zeros(x.shape[1])
    step, t = 1 / (1 / cost + 4.0), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v.astype(np.float32)))
        new = v - step * (v / cost - 2 * ((share * y * slack).astype(np.float32) @ x))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


class HierarchicalModel:
    """Families first, then pairs of the languages in a family."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        lang = np.array(labels, dtype=object)
        self.languages = sorted(set(labels))
        family = np.array([family_of(a) for a in labels], dtype=object)
        self.families = sorted(set(family))
        self.members = {f: [a for a in self.languages if family_of(a) == f] for f in self.families}
        self.family_weights = np.array([svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {
            f: [(a, b, svm(x[m], np.where(lang[m] == a, 1.0, -1.0))) for a, b in combinations(members, 2) if len(m := np.flatnonzero((lang == a) | (lang == b)))]
            for f, members in self.members.items()
        }

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = with_bias(x)
        sigmoid = lambda z: 1 / (1 + np.exp(-4 * z))
        if self.family_weights is None:
            best, sure = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = x @ self.family_weights.T
            best = margins.argmax(axis=1)
            sure = sigmoid(margins.max(axis=1))
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = self.members[f]
            if not len(rows):
                continue
            votes, backing = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for a, b, w in self.pairs[f]:
                p = sigmoid(x[rows] @ w)
                i, j = members.index(a), members.index(b)
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                backing[:, i] += p
                backing[:, j] += 1 - p
            pick = (votes + backing / (len(members) + 1)).argmax(axis=1)
            out[rows] = np.array(members, object)[pick]
            score[rows] = sure[rows] * (backing[np.arange(len(rows)), pick] / max(len(members) - 1, 1) if len(members) > 1 else 1)
        return list(out), np.clip(score, 0, 1)


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> HierarchicalModel | None:
    """A model from at most per_language rows of each language, fewer where there are many languages; what of their features
    is not zero, and none of their texts, comes to the driver."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    per_language = max(1, min(per_language, MOST_ROWS // len(counts)))
    # The hash is uniform, so a language's share under its mark is bound to its count; the cut below makes the bound strict.
    mark = F.element_at(F.create_map(*[F.lit(v) for a, n in counts.items() for v in (a, min(1.0, 1.3 * per_language / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("id", pa.string()), ("at", pa.binary()), ("x", pa.binary())])
        add, take = arrow_rows(schema, 200)
        for batch in batches:
            for row_id, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if has_letter(text):
                    x = features(text, dimensions)
                    at = np.flatnonzero(x)
                    add(lang, row_id, at.astype(np.int32).tobytes(), x[at].astype(np.float32).tobytes())
                yield from take()
        yield from take(True)

    found = rows.where(draw < mark).mapInArrow(run, "lang string, id string, at binary, x binary").toArrow()  # at most 1.3 * per_language rows of a language
    langs, ids = found.column(0).to_pylist(), found.column(1).to_pylist()
    kept: dict[str, int] = {}
    chosen = []
    for i in sorted(range(len(langs)), key=lambda i: (langs[i], ids[i] or "")):
        kept[langs[i]] = kept.get(langs[i], 0) + 1
        if kept[langs[i]] <= per_language:
            chosen.append(i)
    if not chosen:
        return None
    x = np.zeros((len(chosen), dimensions), np.float32)
    for k, i in enumerate(chosen):
        x[k, np.frombuffer(found.column(2)[i].as_buffer(), np.int32)] = np.frombuffer(found.column(3)[i].as_buffer(), np.float32)
    del found
    return HierarchicalModel(x, [langs[i] for i in chosen])


def predict(docs: DataFrame, model: HierarchicalModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), dimensions: int = DIMENSIONS) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score. Only the text goes into a prediction."""
    rows = docs.select(F.col(text_col).alias("_text"), *keep)
    out = [f for f in docs.select(*keep).schema.fields]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                texts = batch.column(0).to_pylist()
                able = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
                langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if able:
                    got, sure = model.predict(np.array([features(texts[i], dimensions) for i in able]))
                    scores[able] = sure
                    for i, a in zip(able, got):
                        langs[i] = a
                names = [*batch.schema.names[1:], "lang_pred", "score"]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores)], names=names)

    return rows.mapInArrow(run, ddl)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32 of the identifier modulo 3 isn't 1."""
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out), id_col, text_col, lang_col)
    out = predict(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, "doc_id", "text", ("doc_id",))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
