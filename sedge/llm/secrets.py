"""Secret scans with a linear-chain conditional random field.

Fixed patterns give the base spans. Beside them a CRF tags every blank-separated token
as secret begin, inside or outside, from the token's shape, its neighbours' words (each word that
several training lines hold, and the kind of any other) and a feature of the whole file; Viterbi decodes the tags. It is trained on generated
lines (no secrets are labelled in a corpus), in a few seconds, the same each time.

A token whose outside score beats the others by more than any two transitions can
give back is outside on every best path, so Viterbi runs on what lies between such
tokens, with the same result as over the whole text.

Defined results: a null text counts as empty; spans count code points, end exclusive; a span of the
CRF is dropped where a base span covers it; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import arrow_rows

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_HEX16 = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is one whole match of HEX
KINDS = ("assign", "access", "hex", "crf")

#: Words near secrets, and openings of well-known secret formats.
KEYWORDS = frozenset("password passwd pwd pass passphrase secret token apikey api_key key keys auth authorization bearer credential credentials private access login signature sas connectionstring client_secret aws_secret_access_key access_token refresh_token".split())
OPENINGS = ("ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AKIA", "ASIA", "eyJ", "AIza", "ya29.", "glpat-", "npm_", "SG.", "-----BEGIN")
_CORE = re.compile(r"""^[^\w/+-]*(?:[A-Za-z_][\w.-]*["']?[:=]+["']?)?(.*?)["'`,;.:!?)\]}>]*$""", re.S)
_CLASSES = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})


def core(token: str) -> tuple[int, int]:
    """Where the value in a token starts and ends: without quotes around it and a name before it."""
    m = _CORE.match(token)
    return (m.start(1), m.end(1)) if m and m.end(1) > m.start(1) else (0, len(token))


def own_features(token: str) -> list[str]:
    a, b = core(token)
    value = token[a:b]
    shape = value.translate(_CLASSES)
    kinds = {c if c in "aA0" else ("u" if c.isalpha() else "s") for c in shape}
    turns = sum(x != y for x, y in zip(shape, shape[1:]))
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0
    name = token[:a].strip("\"':= ").lower()
    out = [f"len{min(n.bit_length(), 7)}", f"turns{min(turns // 2, 6)}", "kinds" + "".join(sorted(kinds)), f"entropy{int(entropy * 2)}", f"len{min(n // 8, 5)}turns{min(turns // 3, 4)}"]
    if any(value.startswith(o) for o in OPENINGS):
        out.append("opening")
    if name:
        out.append("named")
        if any(k in name for k in KEYWORDS):
            out.append("keyed")
            out.append(f"keyed-len{min(n // 4, 4)}")
    if "://" in value:
        out.append("url")
    if "@" in value:
        out.append("at")
    if value.count("/") > 1 or value.count("-") == 4 or value.count(".") > 2:
        out.append("parts")
    return out


#: Neighbouring words are features where so many training lines have them.
WORD_LINES = 4
_SIGNS = "\"'`:=,;()[]{}<>"


def near_word(token: str) -> str:
    return token.strip(_SIGNS).lower()


def near_features(token: str, side: str) -> list[str]:
    """Of a neighbour: its word, and what kind of word it is."""
    word = near_word(token)
    if word in KEYWORDS:
        return [f"{side}keyword", f"{side}word:{word}"]
    if not word:
        return [f"{side}sign:{token[:2]}"]
    return [f"{side}plain" if word.isalpha() else f"{side}other", f"{side}word:{word[:40]}"]


def file_feature(tokens: int, marked: int) -> str:
    """How many of the tokens hold a sign of code or configuration."""
    share = marked / tokens if tokens else 0
    return "file-prose" if share < 0.05 else "file-mixed" if share < 0.3 else "file-code"


_PLAIN = {
    (case, size): [f"len{min(n.bit_length(), 7)}", "turns0", case, f"entropy{e}", f"len{min(n // 8, 5)}turns0", "word"]
    for case in ("kindsa", "kindsA", "kindsAa", "kindsu")
    for size, n, e in ((0, 2, 2), (1, 6, 4), (2, 12, 6), (3, 24, 7))
}


def plain_class(token: str) -> tuple[str, int] | None:
    """Case and size of a token that is a word of letters, perhaps with a stop after it."""
    word = token if token.isalpha() else token.rstrip(".,;:!?")
    if len(word) < 30 and word.isalpha() and (word.islower() or word.istitle() or word.isupper()):
        case = "kindsu" if not word.isascii() else "kindsa" if word.islower() else "kindsAa" if word.istitle() else "kindsA"
        return case, 0 if len(word) < 4 else 1 if len(word) < 9 else 2 if len(word) < 18 else 3
    return None


def token_features(token: str) -> list[str]:
    """As own_features, with a short way for words of letters."""
    plain = plain_class(token)
    return _PLAIN[plain] if plain else own_features(token)


def generated_lines(count: int, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Lines of tokens with tags (0 outside, 1 begin, 2 inside)."""
    r = random.Random(seed)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789-_!#$%")
    letters = "eeeaaoiunrstlhdcmpfgbvwkyzéüñ"
    code = "get set make read write user file path node list map key value test foo bar baz factory builder handler index count buffer stream image config client server request response token type name data item event".split()
    talk = "the a of is was in to and for with from my your new old see page commit version build issue figure table section by at".split()

    def value() -> str:
        body = "".join(r.choices(r.choice(alphabets), k=r.randint(14, 44)))
        return (r.choice(OPENINGS[:-1]) if r.random() < 0.3 else "") + body

    def word() -> str:
        w = "".join(r.choices(letters, k=min(r.randint(2, 12), r.randint(2, 24))))
        return (w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.05 else w) + (r.choice(".,;:|###***%%%&&&$$$") if r.random() < 0.2 else "")

    def camel() -> str:
        return "".join(w.strip(".,;:|#*%&$").capitalize() for w in (r.choice(code), word(), r.choice(code), *([r.choice(code)] * r.randint(0, 2))))

    def harmless() -> str:
        return r.choice((
            lambda: str(r.randint(0, 10**r.randint(1, 17))), lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
            lambda: f"{word()}@{word()}.com", lambda: f"https://{word()}.org/{word()}/{r.randint(1, 999)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: f"{word()}-{word()}", lambda: f"/{word()}/{word()}/{word()}.txt",
            lambda: f"{word()}={r.randint(0, 99)}", lambda: f"{word()}({word()})", lambda: f"{r.choice(('key', 'token', 'pass'))}={word()}", lambda: "".join(r.choice("#*%&$|=-") for _ in range(r.randint(1, 4))),
            lambda: word() + r.choice(("###", "***", "%%%", "&&&", "$$$")),
            # What code and papers hold: names, calls, versions, identifiers, embedded data.
            lambda: camel() + r.choice(("", str(r.randint(1, 2030)))), lambda: f"{camel()}({r.choice(code)}{r.randint(0, 10**7)}", lambda: f"{r.choice(code)}.{camel()}({r.choice(code)},", lambda: f"{word()}{word()}{r.randint(1, 10**10)}".replace(".", ""),
            lambda: "_".join(r.choices(code, k=r.randint(2, 5))).upper(), lambda: "_".join(r.choices(code, k=r.randint(2, 5))) + str(r.randint(0, 99)), lambda: f"v{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 99)}-rc{r.randint(1, 9)}",
            lambda: f"doi:10.{r.randint(1000, 99999)}/{word()}.{r.randint(1990, 2030)}.{r.randint(1, 10**6)}", lambda: f"10.{r.randint(1000, 99999)}/{word().upper()}-{r.randint(1, 10**6)}-{r.randint(1, 99)}",
            lambda: f"urn:isbn:{r.randint(10**12, 10**13)}", lambda: f"https://{word()}.com/{word()}?{r.choice(code)}={r.randint(1, 10**9)}&{r.choice(code)}={word()}",
            lambda: "data:image/png;base64," + "".join(r.choices(alphabets[3], k=r.randint(20, 200))), lambda: f"#include<{r.choice(code)}/{r.choice(code)}.h>", lambda: f"{r.choice(code)}::{camel()}<{camel()}>",
        ))()

    lines = []
    for _ in range(count):
        line = [(r.choice(talk) if (x := r.random()) < 0.2 else word() if x < 0.7 else harmless(), 0) for _ in range(r.randint(3, 12))]
        if r.random() < 0.55:
            name = r.choice(sorted(KEYWORDS))
            name = name.upper() if r.random() < 0.3 else name
            quote = r.choice(("", '"', "'"))
            secret = quote + value() + quote
            form = r.randint(0, 4)
            if form == 0:
                part = [(name + r.choice(":="), 0), (secret, 1)]
            elif form == 1:
                part = [(name, 0), (r.choice(("=", ":", "is", ":=")), 0), (secret, 1)]
            elif form == 2:
                part = [(name + r.choice(":=") + secret, 1)]
            elif form == 3:
                part = [("Authorization:", 0), (r.choice(("Bearer", "Basic", "Token")), 0), (secret, 1)]
            else:
                part = [(name, 0), ("=", 0), (quote + value(), 1), (value() + quote, 2)]
            at = r.randint(0, len(line))
            line[at:at] = part
        elif r.random() < 0.2:
            name = r.choice(("key", "token", "pass", "access", "private", "login"))
            at = r.randint(0, len(line))
            line[at:at] = [(name, 0), (r.choice(("is", "=", word())), 0), (word(), 0)]
        lines.append(line)
    return lines


class CRF:
    """Three tags; weights by feature name, transitions by tag pair."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.transitions = np.zeros((3, 3))
        self.words: frozenset[str] = frozenset()

    @staticmethod
    def features(tokens: list[str]) -> list[list[str]]:
        whole = file_feature(len(tokens), sum(map(is_marked, tokens)))
        return [
            token_features(t) + (near_features(tokens[i - 1], "left-") if i else ["left-none"]) + (near_features(tokens[i + 1], "right-") if i + 1 < len(tokens) else ["right-none"]) + [whole]
            for i, t in enumerate(tokens)
        ]

    def train(self, lines: list[list[tuple[str, int]]], epochs: int = 5, rate: float = 0.2, decay: float = 1e-4) -> CRF:
        seen = Counter(w for line in lines for w in {near_word(t) for t, _ in line})
        self.words = frozenset(w for w, n in seen.items() if w and n >= WORD_LINES)
        known = {f"{side}word:{w}" for w in self.words for side in ("left-", "right-")}
        data = [([[f for f in fs if "-word:" not in f or f in known] for fs in self.features([t for t, _ in line])], [y for _, y in line]) for line in lines]
        order = random.Random(3)
        zero = np.zeros(3)
        for epoch in range(epochs):
            order.shuffle(data)
            step = rate / (1 + epoch)
            for feats, tags in data:
                e = np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in feats])
                n, t = len(tags), self.transitions
                alpha, beta = np.zeros((n, 3)), np.zeros((n, 3))
                alpha[0] = e[0]
                for i in range(1, n):
                    s = alpha[i - 1][:, None] + t
                    m = s.max(axis=0)
                    alpha[i] = e[i] + m + np.log(np.exp(s - m).sum(axis=0))
                for i in range(n - 2, -1, -1):
                    s = t + (e[i + 1] + beta[i + 1])[None, :]
                    m = s.max(axis=1)
                    beta[i] = m + np.log(np.exp(s - m[:, None]).sum(axis=1))
                total = np.logaddexp.reduce(alpha[-1])
                grad = -np.exp(alpha + beta - total)
                grad[np.arange(n), tags] += 1
                for i in range(1, n):
                    pair = np.exp(alpha[i - 1][:, None] + t + (e[i] + beta[i])[None, :] - total)
                    pair[tags[i - 1], tags[i]] -= 1
                    self.transitions = self.transitions - step * pair
                self.transitions = np.clip(self.transitions * (1 - decay), -4, 4)
                for fs, g in zip(feats, grad):
                    for f in fs:
                        self.weights[f] = self.weights.get(f, zero) * (1 - decay) + step * g
        return self

    def score(self, features: list[str]) -> np.ndarray:
        return sum((self.weights[f] for f in features if f in self.weights), np.zeros(3))

    def slack(self) -> np.ndarray:
        """For begin and inside, the most that their transitions can have over those of outside."""
        t = self.transitions
        gain = lambda x: max(0.0, (t[:, x] - t[:, 0]).max()) + max(0.0, (t[x, :] - t[0, :]).max())
        return np.array([gain(1), gain(2)])

    def viterbi(self, e: np.ndarray, left: bool, right: bool) -> list[int]:
        """Best tags; left and right tell whether an outside token stands there."""
        t, n = self.transitions, len(e)
        best = e[0] + (t[0] if left else 0)
        back = []
        for i in range(1, n):
            s = best[:, None] + t
            back.append(s.argmax(axis=0))
            best = e[i] + s.max(axis=0)
        if right:
            best = best + t[:, 0]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


@lru_cache(1)
def trained(count: int = 1000, seed: int = 7) -> CRF:
    return CRF().train(generated_lines(count, seed))


class Tagger:
    """A CRF with a table of the scores of tokens already met, which starts anew when full."""

    def __init__(self, model: CRF, bound: int = 150_000):
        self.model, self.bound = model, bound
        self.slack = model.slack()
        self.files = {f: model.score([f]) for f in ("file-prose", "file-mixed", "file-code")}
        self.edges = model.score(["left-none"]), model.score(["right-none"])
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        self.scores = np.zeros((4096, 10))

    def _add(self, token: str) -> None:
        plain, word = plain_class(token), near_word(token)
        known = word if word in self.model.words else ""
        if plain and word not in KEYWORDS and not known:
            key = plain, token.isalpha() or token.strip(",;:").isalpha()
        else:
            key = (*token_features(token), *near_features(token, "")[: 1 if word else None], known, is_marked(token))
        k = self.rows.get(key)
        if k is None:
            k = self.rows[key] = len(self.rows)
            if k == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            m, row = self.model, self.scores[k]
            row[0:3], row[3:6], row[6:9] = m.score(token_features(token)), m.score(near_features(token, "left-")), m.score(near_features(token, "right-"))
            row[9] = is_marked(token)
        self.places[token] = k

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if len(self.places) > self.bound:
            self.clear()
        for token in set(tokens).difference(self.places):
            self._add(token)
        at = np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))
        s = self.scores[at]
        e = s[:, 0:3] + self.files[file_feature(len(tokens), int(s[:, 9].sum()))]
        e[1:] += s[:-1, 3:6]
        e[:-1] += s[1:, 6:9]
        e[0] += self.edges[0]
        e[-1] += self.edges[1]
        return e

    def tag(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(token, tag) of the tokens that are not outside."""
        if not tokens:
            return []
        e = self.emissions(tokens)
        free = np.flatnonzero((e[:, 0] - e[:, 1] <= self.slack[0]) | (e[:, 0] - e[:, 2] <= self.slack[1]))
        if not len(free):
            return []
        out: list[tuple[int, int]] = []
        for run in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            out += [(a + i, y) for i, y in enumerate(self.model.viterbi(e[a:b], a > 0, b < len(tokens))) if y]
        return out


def is_marked(token: str) -> bool:
    return any(c in token for c in "={}();<>")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds, in order."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX16.finditer(text)]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def crf_spans(text: str, tagger: Tagger) -> list[tuple[int, int]]:
    tokens = text.split()
    tags = tagger.tag(tokens)
    if not tags:
        return []
    places = [m.span() for m in re.finditer(r"\S+", text)]
    out: list[list[int]] = []
    before = -2
    for i, tag in tags:
        a, b = core(tokens[i])
        start, end = places[i][0] + a, places[i][0] + b
        if tag == 2 and before == i - 1 and out:
            out[-1][1] = end
        else:
            out.append([start, end])
        before = i
    return [(a, b) for a, b in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans (kind:start:end, by start and kind)."""
    model = trained()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        add, take = arrow_rows(schema, 2000)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                base = base_spans(text)
                found = [(a, b, 3) for a, b in crf_spans(text, tagger) if not any(s <= a and b <= e for s, e, _ in base)]
                counts = [sum(k == kind for _, _, k in base) for kind in range(3)]
                every = sorted(base + found, key=lambda s: (s[0], s[2]))
                add(doc, *counts, len(found), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))
                yield from take()
        yield from take(True)

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
