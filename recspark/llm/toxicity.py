"""Toxicity of deobfuscated text (operator 8).

A noisy channel restores disguised words: a character model (4-grams counted
over all documents) and a channel (leet signs, separators between letters,
repeated letters) span a lattice whose best path is found by Viterbi search,
with every state kept.  Decoded are all tokens with a letter and a leet sign, a
separator or a doubled letter, and single characters with blanks between them.
Words and word beginnings, as written and as restored, are the features of a
logistic model fitted to the labelled rows outside the held-out fold.

4-gram counts cover all texts and are summed in Spark (at most 27 ** 4 of them).
The classifier is fitted on a bounded sample: at most ``SAMPLE`` labelled rows of
each class, those with the least hash of their id, weighted by the rows of the
class.  Its features are all that ``LEAST_TEXTS`` distinct toxic texts of the
sample share and that a likelihood-ratio test (``LEAST_RATIO``) finds more
frequent in toxic texts; their number has no limit but follows from the sample.
Scoring is one pass over whole texts without a shuffle.  Where the features are
known, a token whose lattice spells none of them is not searched: a trie of the
features is walked along all moves at once, which gives the same features.

Defined cases: null and empty texts have no features and get the score of the
intercept; repeated rows each get a row; labels that contradict each other
count as toxic; null labels are not used; with no labelled row of a class the
score is the share of toxic ones (0 without labels); rows of an empty table
give no rows; other columns are never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.llm.common import arrow_rows, stored

FOLDS = 5
SAMPLE = 10_000
#: distinct toxic texts that a feature must be in, least likelihood ratio, lengths of word beginnings
LEAST_TEXTS, LEAST_RATIO, PREFIXES = 3, 25.0, (4, 5, 6)
#: states times moves above which a step of the search is done by numpy
WIDE = 600
#: states of the first, narrow search; its cost bounds the full one
NARROW = 6
_ALPHABET = 27  # a-z and everything else
_KNOWN = 500_000

# fixed values: letters that a sign stands for in disguised words
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_SEPARATORS = " .-_*,'~"
#: costs, as negative logs, of the channel's moves
COST_LEET, COST_DROP_REPEAT, COST_SEPARATOR, COST_WILDCARD, COST_DROP = 0.7, 0.4, 0.2, 3.5, 4.0

_TOKEN_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.escape("".join(LEET))
# separators at the ends of a token do not change what it decodes to ("*" does: it may be a letter)
_ENDS = _SEPARATORS.replace("*", "")
_LETTER = re.compile(r"[^\W\d_]")
# a sign that may be a letter, a separator, a letter twice
_NOISY = re.compile(rf"[{_SIGN}{re.escape(_SEPARATORS)}]|([^\W\d_])\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
_SAME = re.compile(r"(\S)(?: \1){2,}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _fold_table() -> bytes:
    """Latin-1 bytes to codes: a-z with or without accents, else 0."""
    out = bytearray(256)
    for b in range(256):
        ch = unicodedata.normalize("NFKD", bytes([b]).decode("latin-1").lower())[:1]
        out[b] = ord(ch) - 96 if "a" <= ch <= "z" else 0
    return bytes(out)


_CODES = _fold_table()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace").translate(_CODES), np.uint8)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): 4-grams of the folded texts, one row per gram and task before
    they are summed."""
    def work(batches):
        import pyarrow as pa

        total = np.zeros(_ALPHABET ** 4, np.int64)
        for b in batches:
            # three blanks around each text: no gram holds letters of two, however they are batched
            texts = ["", *filter(None, b.column("text").to_pylist()), ""]
            c = codes("   ".join(texts)).astype(np.int32)
            if len(texts) > 2:
                total += np.bincount(((c[:-3] * 27 + c[1:-2]) * 27 + c[2:-1]) * 27 + c[3:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return arrow_rows(docs.select("text"), work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame) -> np.ndarray:
    """-log P(next | three before), interpolated over the four orders."""
    rows = gram_counts(docs).toPandas()  # at most 27 ** 4 rows
    n = np.zeros(_ALPHABET ** 4)
    n[rows["gram"].to_numpy(np.int64)] = rows["n"]
    n = n.reshape((_ALPHABET,) * 4)
    p = np.full(_ALPHABET, 1 / _ALPHABET)
    for order in range(4):
        c = n.sum(axis=tuple(range(3 - order)))
        seen = c.sum(axis=-1, keepdims=True)
        p = (c + 5 * p) / (seen + 5)  # the lower order counts as five observations
    return -np.log(p).astype(np.float32)


class Restorer:
    """Viterbi search for the likeliest plain word of a disguised token."""

    def __init__(self, model: np.ndarray):
        self.table = model.reshape(_ALPHABET ** 3, _ALPHABET).astype(float)
        self.cost, self.least = self.table.tolist(), self.table.min(axis=0).tolist()
        self.moves_of: dict[tuple, list] = {}

    def moves(self, token: str) -> list[list[tuple[int, float]]]:
        out = []
        for ch, before in zip(token, " " + token):
            key = ch, ch == before
            if key not in self.moves_of:
                if len(self.moves_of) > 10_000:
                    self.moves_of.clear()
                self.moves_of[key] = self._moves(ch, before)
            out.append(self.moves_of[key])
        return out

    def _moves(self, ch: str, before: str) -> list[tuple[int, float]]:
        """(code or -1 for nothing, cost) of a character."""
        code = int(codes(ch)[0])
        if ch.isalpha() and code:
            return [(code, 0.0)] + ([(-1, COST_DROP_REPEAT)] if ch == before else [])
        if ch in LEET:
            return [(ord(x) - 96, COST_LEET) for x in LEET[ch]] + [(-1, COST_DROP)]
        if ch == "*":
            return [(-1, COST_SEPARATOR)] + [(x, COST_WILDCARD) for x in range(1, _ALPHABET)]
        return [(-1, COST_SEPARATOR if ch in _SEPARATORS else COST_DROP)]

    def _wide_step(self, states: dict, moves: list[tuple[int, float]]) -> dict:
        """The step of ``__call__`` for many states at once."""
        keys = np.fromiter(states, np.int64, len(states))
        totals = np.array([t for t, _ in states.values()])
        to, cost = [], []
        for code, c in moves:
            to.append(keys if code < 0 else keys % _ALPHABET ** 2 * _ALPHABET + code)
            cost.append(totals + c if code < 0 else totals + c + self.table[keys % _ALPHABET ** 3, code])
        to, cost = np.concatenate(to), np.concatenate(cost)
        best = np.full(_ALPHABET ** 3, np.inf)
        np.minimum.at(best, to, cost)
        at = np.flatnonzero(cost == best[to])
        paths, out = [p for _, p in states.values()], {}
        for k, i, total in zip(to[at].tolist(), at.tolist(), cost[at].tolist()):
            if k not in out:
                code, path = moves[i // len(keys)][0], paths[i % len(keys)]
                out[k] = (total, path if code < 0 else (code, path))
        return out

    def _search(self, moves: list[list], bound: list[float] | None) -> tuple[float, tuple | None, bool]:
        """Cost and path of the best word, and whether states were left out.
        Without ``bound`` only the ``NARROW`` cheapest states go on; with it all
        but those whose cost is above ``bound`` after the character."""
        square, cube = _ALPHABET ** 2, _ALPHABET ** 3
        states, cut = {0: (0.0, None)}, False
        for at, step in enumerate(moves):
            if len(states) * len(step) > WIDE:
                nxt = self._wide_step(states, step)
            else:
                nxt = {}
                for code, c in step:
                    for state, (total, path) in states.items():
                        if code < 0:
                            key, t, p = state, total + c, path
                        else:
                            key, t, p = state % square * _ALPHABET + code, total + c + self.cost[state % cube][code], (code, path)
                        if key not in nxt or t < nxt[key][0]:
                            nxt[key] = (t, p)
            if bound is not None:
                most = bound[at]
                nxt = {s: x for s, x in nxt.items() if x[0] <= most}
            elif len(nxt) > NARROW:
                nxt, cut = dict(sorted(nxt.items(), key=lambda x: x[1][0])[:NARROW]), True
            states = nxt
        return *min(((t + self.cost[s][0], p) for s, (t, p) in states.items()), key=lambda x: x[0]), cut

    def __call__(self, token: str) -> str:
        """The best path of the whole lattice.  Costs are never negative, so a
        state whose cost plus the least cost of the rest is above that of a
        known path (the narrow search's) is on no better one."""
        moves = self.moves(token)
        total, path, cut = self._search(moves, None)
        if cut:
            bound, rest = [], self.least[0] - 1e-6
            for step in reversed(moves):
                bound.append(total - rest)
                rest += min(c + (self.least[code] if code >= 0 else 0) for code, c in step)
            _, path, _ = self._search(moves, bound[::-1])
        out = []
        while path:
            out.append(chr(96 + path[0]))
            path = path[1]
        return "".join(reversed(out))


def _word_features(word: str):
    yield word
    for k in PREFIXES:
        if len(word) > k:
            yield "^" + word[:k]


class Spelled:
    """A trie of features, to tell which lattices can spell one."""

    def __init__(self, features):
        self.root: dict = {}
        for f in features:
            beginning, word = f[0] == "^", f.removeprefix("^")
            if all("a" <= ch <= "z" for ch in word):  # restored words have no other letters
                node = self.root
                for ch in word:
                    node = node.setdefault(ord(ch) - 96, {})
                node[-1 if beginning else 0] = True

    def by(self, moves: list[list[tuple[int, float]]], anywhere: bool = False) -> bool:
        """Whether a path of the lattice is a feature or, for a word beginning,
        starts with it; with ``anywhere`` also from a later letter on."""
        nodes = {id(self.root): self.root}
        for step in moves:
            nxt = {id(self.root): self.root} if anywhere else {}
            for node in nodes.values():
                for code, _ in step:
                    to = node if code < 0 else node.get(code)
                    if to is not None:
                        if -1 in to:
                            return True
                        nxt[id(to)] = to
            if not nxt:
                return False
            nodes = nxt
        return any(0 in node for node in nodes.values())


class Features:
    """Features of texts; what a token gives is remembered for a bounded number
    of tokens.  With ``index`` only its features are given, by number."""

    def __init__(self, model: np.ndarray, index: dict[str, int] | None = None):
        self.restore, self.index, self.known = Restorer(model), index, {}
        if index is not None:
            self.spelled = Spelled(index)
            self.starts = {f.removeprefix("^")[:3] for f in index}

    def _named(self, found) -> list:
        return list(found) if self.index is None else [self.index[f] for f in found if f in self.index]

    def _of_word(self, word: str) -> list:
        return [] if self.index is not None and word[:3] not in self.starts else self._named(_word_features(word))

    def _of_token(self, token: str) -> tuple:
        found = [f for w in _TOKEN_WORD.findall(token) for f in self._of_word(w)]
        inner = token.strip(_ENDS)
        if _NOISY.search(inner) and _LETTER.search(inner) and (
                self.index is None or self.spelled.by(self.restore.moves(inner))):
            word = self.restore(inner)
            if len(word) > 2:
                found += self._of_word(word)
        return tuple(dict.fromkeys(found))

    def restored_runs(self, text: str) -> list[str]:
        """Words written with spaces between their letters."""
        runs = [_SAME.sub(r"\1 \1", " ".join(m.group().split())) for m in _SPACED.finditer(text)]
        return [self.restore(r) for r in runs if self.index is None or self.spelled.by(self.restore.moves(r), anywhere=True)]

    def of(self, text: str | None) -> set:
        if not text:
            return set()
        low = text.lower()
        tokens = set(low.split())
        if len(self.known) > _KNOWN:
            self.known.clear()
        for t in tokens.difference(self.known):
            self.known[t] = self._of_token(t)
        out = set().union(*map(self.known.__getitem__, tokens))
        for word in self.restored_runs(low):
            # single letters may stand before the word: it starts anywhere
            for i in range(len(word) - 2):
                out.update(self._of_word(word[i:]))
        return out


_WORKER: dict[str, Features] = {}


def _features(key: str, model, index=None) -> Features:
    """The worker's ``Features`` of one step of a query: tokens stay known from task to task."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Features(model.value, index and index.value)
    return _WORKER[key]


def _counts(texts: DataFrame, model, name: str) -> DataFrame:
    """(feature, name): texts that have the feature, combined in each task."""
    key = uuid.uuid4().hex

    def work(batches):
        import pyarrow as pa

        feats, total = _features(key, model), Counter()

        def report():
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                total.update(feats.of(text))
                if len(total) > _KNOWN:
                    yield report()
                    total.clear()
        yield report()

    return arrow_rows(texts.select("text"), work, "feature string, n long").groupBy("feature").agg(F.sum("n").alias(name))


def _ratio(n1: Column, n0: Column, t1: float, t0: float) -> Column:
    """Twice the log-likelihood ratio of two shares against one; 0 where the
    feature is not more frequent among the first."""
    part = lambda n, t: n * F.log(n / (t * (n1 + n0) / (t1 + t0))) if t else F.lit(0.0)
    one, zero = (F.when(n > 0, part(n, t)).otherwise(0.0) for n, t in ((n1, t1), (n0, t0)))
    return F.when(n1 * t0 > n0 * t1, 2 * (one + zero)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, model) -> tuple[dict[str, int], np.ndarray]:
    """The feature index and the weights (intercept last)."""
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("long").alias("toxic"))
    marks = stored(docs.select("doc_id").distinct().join(marks, "doc_id"), "toxicity-marks")
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = 1 - 1e-6 if n.get(1) else 1e-6
        return {}, np.array([math.log(share / (1 - share))])
    # ids are chosen first, so that no texts are gathered to choose among them; at most SAMPLE of each class
    least = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    sample = stored(docs.join(F.broadcast(least[0].unionByName(least[1])), "doc_id").select("text", "toxic"), "toxicity-sample")
    texts = [sample.where(F.col("toxic") == k).select("text") for k in (0, 1)]
    toxic = texts[1].distinct()
    t0, t1 = texts[0].count(), toxic.count()
    n1, n0 = F.col("n1"), F.coalesce("n0", F.lit(0))
    found = _counts(toxic, model, "n1").where(n1 >= LEAST_TEXTS).join(_counts(texts[0], model, "n0"), "feature", "left")
    found = found.where(_ratio(n1, n0, float(t1), float(t0)) >= LEAST_RATIO).select("feature").orderBy("feature")
    chosen = {r["feature"]: i for i, r in enumerate(found.collect())}  # words typical of the sample's toxic texts
    if not chosen:
        share = n[1] / (n[0] + n[1])
        return {}, np.array([math.log(share / (1 - share))])
    shared, key = spark.sparkContext.broadcast(chosen), uuid.uuid4().hex

    def work(batches):
        import pyarrow as pa

        feats = _features(key, model, shared)
        for b in batches:
            rows = [sorted(feats.of(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int64())), b.column("toxic").cast(pa.int64())], names=["f", "y"])

    rows = arrow_rows(sample, work, "f array<long>, y long").groupBy("f", "y").agg(F.count("*").alias("n")).collect()  # at most 2 SAMPLE rows
    of_class = [sum(r["n"] for r in rows if r["y"] == k) for k in (0, 1)]
    weight = np.array([r["n"] * n[r["y"]] / of_class[r["y"]] for r in rows])
    return chosen, _logistic([r["f"] for r in rows], np.array([r["y"] for r in rows], float), weight / weight.sum(), len(chosen))


def _logistic(features: list[list[int]], y: np.ndarray, share: np.ndarray, k: int, steps: int = 1000, l2: float = 1e-5) -> np.ndarray:
    """Accelerated gradient descent on sparse rows with shares that sum to one."""
    row = np.repeat(np.arange(len(y)), [len(f) + 1 for f in features])
    col = np.concatenate([np.append(np.array(f, np.int64), k) for f in features])
    times = lambda w: np.bincount(row, weights=w[col], minlength=len(y))
    back = lambda g: np.bincount(col, weights=g[row], minlength=k + 1)
    u = np.ones(k + 1)
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        u = back(share * times(u))
        top = float(np.linalg.norm(u))
        u /= top
    decay = np.append(np.full(k, l2), 0)
    step = 1 / (0.25 * top * 1.05 + l2)
    w = v = np.zeros(k + 1)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(v), -30, 30)))
        new = v - step * (back(share * (p - y)) + decay * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    model = spark.sparkContext.broadcast(character_model(docs))  # 27 ** 4 numbers
    index, weights = fit(docs, labels.select("doc_id", "toxic"), model)
    shared, key = spark.sparkContext.broadcast(index), uuid.uuid4().hex

    def work(batches):
        import pyarrow as pa

        feats = _features(key, model, shared)
        for b in batches:
            z = [weights[-1] + sum(weights[i] for i in feats.of(t)) for t in b.column("text").to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.record_batch([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    out = arrow_rows(docs, work, schema)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
