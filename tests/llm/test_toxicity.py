"""Held-out accuracy, disguised words, and the defined cases."""

import zlib

import numpy as np
import pytest

from recspark.llm import toxicity
from recspark.llm.common import table
from recspark.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.1"
DISGUISED = {"1d10t": "idiot", "m0r0n": "moron", "l0$er": "loser", "tr@sh": "trash", "idiooooot": "idiot",
             "s.c.u.m": "scum", "p@th3tic": "pathetic", "w0rthl3ss": "worthless", "cl-o-w-n": "clown", "mor*n": "moron"}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def model(docs):
    return toxicity.character_model(docs)


def test_character_model_matches_a_count_by_hand(make_docs):
    got = {r["gram"]: r["n"] for r in toxicity.gram_counts(make_docs(["Ab é!", None, "", "ab"])).collect()}
    want = {}
    for text in ("   ab e    ", "   ab   "):
        c = [0 if x == " " else ord(x) - 96 for x in text]
        for i in range(len(c) - 3):
            g = ((c[i] * 27 + c[i + 1]) * 27 + c[i + 2]) * 27 + c[i + 3]
            want[g] = want.get(g, 0) + 1
    assert got == want


def test_restores_disguised_words(model):
    restore = toxicity.Restorer(model)
    got = {d: restore(d) for d in DISGUISED}
    assert sum(got[d] == w for d, w in DISGUISED.items()) >= 9, got
    feats = toxicity.Features(model)
    assert feats.restored_runs("you i d i o t") and "idiot" in feats.of("such an i d i o t here")


def test_viterbi_finds_the_best_path(model):
    """Against every path of a short lattice."""
    import itertools

    r = toxicity.Restorer(model)
    for token in ("1d0", "aab", "t3$", "b|"):
        moves = [r._moves(ch, token[i - 1] if i else "") for i, ch in enumerate(token)]
        best = None
        for path in itertools.product(*moves):
            state, total = 0, 0.0
            for code, c in path:
                total += c
                if code >= 0:
                    total += r.cost[state][code]
                    state = state % 27 ** 2 * 27 + code
            total += r.cost[state][0]
            word = "".join(chr(96 + x) for x, _ in path if x >= 0)
            best = min(best or (total, word), (total, word))
        assert r(token) == best[1]


def _least_cost(r, token):
    """Every state of the lattice, as one array of the last three letters."""
    cost = r.table.reshape(27, 27, 27, 27)
    states = np.full((27,) * 3, np.inf)
    states[0, 0, 0] = 0
    for i, ch in enumerate(token):
        nxt = np.full((27,) * 3, np.inf)
        for code, c in r._moves(ch, token[i - 1] if i else ""):
            if code < 0:
                nxt = np.minimum(nxt, states + c)
            else:
                nxt[:, :, code] = np.minimum(nxt[:, :, code], (states + c + cost[..., code]).min(axis=0))
        states = nxt
    return (states + cost[..., 0]).min()


def test_search_keeps_every_state(model):
    """Several wildcards: the word of the least cost over the whole lattice."""
    r = toxicity.Restorer(model)
    assert {t: r(t) for t in ("st**id", "s***id", "c**wn", "s**m")} == {
        "st**id": "stupid", "s***id": "stupid", "c**wn": "clown", "s**m": "scum"}
    for token in ("st**id", "s***id", "1a6b|c!d", "a*b*c*", "tion,***", "1d1*0t", "***", "|*6*1"):
        best, word = _least_cost(r, token), r(token)
        # the word's own cost over the token: letters by the model, signs by the channel
        costs = {((0, 0, 0), 0): 0.0}
        for i, ch in enumerate(token):
            nxt = {}
            for (last, k), t in costs.items():
                for code, c in r._moves(ch, token[i - 1] if i else ""):
                    if code < 0:
                        key, v = (last, k), t + c
                    elif k < len(word) and code == ord(word[k]) - 96:
                        key, v = ((*last[1:], code), k + 1), t + c + r.table[last[0] * 729 + last[1] * 27 + last[2], code]
                    else:
                        continue
                    nxt[key] = min(v, nxt.get(key, np.inf))
            costs = nxt
        got = min(t + r.table[a * 729 + b * 27 + c, 0] for ((a, b, c), k), t in costs.items() if k == len(word))
        assert abs(got - best) < 1e-6, (token, word)


def test_held_out_accuracy_and_disguise(spark, docs, model):
    labels = table(spark, SF, "labels")
    shared = spark.sparkContext.broadcast(model)
    index, weights = toxicity.fit(docs.select("doc_id", "text"), labels, shared)
    feats = toxicity.Features(model, index)

    def score(text):
        return 1 / (1 + np.exp(-(weights[-1] + sum(weights[i] for i in feats.of(text)))))

    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [(truth[r["doc_id"]], score(r["text"])) for r in docs.collect()
            if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(t) for t, s in rows]) > 0.95
    plain = "Of the and thing in that."
    assert score(plain) < 0.5 and score("") < 0.5
    hidden = ["1d10t", "m0r0n", "idiooooot", "s t u p i d", "l0$er", "tr@sh"]
    assert sum(score(f"{plain} {w} and the") >= 0.5 for w in hidden) >= 5, {w: score(f"{plain} {w} and the") for w in hidden}


def test_small_cases(spark, make_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (1, 0)], "doc_id long, toxic long")
    docs = make_docs([(1, "bad"), (2, "good"), (2, "good"), (None, "x"), (4, None), (5, ""), (2**60 + 1, "a" * 50_000), (7, "a " * 20_000)])
    rows = toxicity.scores(docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    empty = spark.createDataFrame([], "doc_id long, toxic long")
    assert toxicity.scores(make_docs([]), empty).collect() == []
    assert [r["predicted"] for r in toxicity.scores(make_docs([(1, "x")]), empty).collect()] == [0]


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    assert sorted(r["doc_id"] for r in op8_toxicity(spark, sf).collect()) == sorted(
        r["doc_id"] for r in table(spark, sf, "documents").select("doc_id").collect())


def test_disguised_tokens_reach_the_search(model):
    feats = toxicity.Features(model)
    disguised = {"idi07": "idiot", "id107": "idiot", "1d107": "idiot", "idio+": "idiot", "(10wn": "clown", "mo.ron": "moron",
                 "id-iot": "idiot", "m-oron": "moron", "s,c,u,m": "scum", "idioott": "idiot", "cl-o-w-n,": "clown"}
    assert {d: w in feats.of(f"of {d} and") for d, w in disguised.items()} == dict.fromkeys(disguised, True)
    # "worthless" is left out: the channel may drop one of two s
    tried = [(f"{w[:i]}{sep}{w[i:]}", w) for w in sorted({*DISGUISED.values(), "stupid"} - {"worthless"}) for i in range(1, len(w)) for sep in ".-_,'~"]
    assert [t for t, w in tried if w not in feats.of(t)] == []
    assert "idiot" in feats.of("such: i  d\ni o\tt") and feats.restored_runs("so b a d it") == ["bad"]


def _never_skipped(feats):
    feats.spelled = type("All", (), {"by": staticmethod(lambda *_, **__: True)})
    feats.starts = type("Any", (), {"__contains__": staticmethod(lambda *_: True)})()
    return feats


def test_the_trie_skips_nothing_that_counts(model, docs):
    """The same features as with every token searched."""
    index = {f: i for i, f in enumerate(["idiot", "^idio", "moron", "^stup", "^stupi", "scum", "ass", "é", "^clown", "déjà", "zz"])}
    fast, slow = toxicity.Features(model, index), _never_skipped(toxicity.Features(model, index))
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(400).collect()]
    texts += [f"so {d} it" for d in DISGUISED] + ["a i d i o t", "x s  c\nu m y", "as$", "a$s", "z z z", "id*ots", "st**id", "c1owning", "m-o-r-o-n-s"]
    found = [fast.of(t) for t in texts]
    assert found == [slow.of(t) for t in texts] and sum(map(bool, found)) > 8


def test_query_scores_against_a_plain_model(spark):
    """Scores of the query from its features and weights, one text after the other."""
    sf = "/root/testdata/sf0.01"
    d, labels = (table(spark, sf, t) for t in ("documents", "labels"))
    shared = spark.sparkContext.broadcast(toxicity.character_model(d))
    index, weights = toxicity.fit(d.select("doc_id", "text"), labels, shared)
    feats = _never_skipped(toxicity.Features(shared.value, index))
    want = {r["doc_id"]: 1 / (1 + np.exp(-(weights[-1] + sum(weights[i] for i in feats.of(r["text"]))))) for r in d.collect()}
    got = {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in op8_toxicity(spark, sf).collect()}
    assert set(got) == set(want) and index
    assert all(abs(s - want[k]) < 1e-9 and p == (s >= 0.5) and h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, (s, p, h) in got.items())


def test_weights_of_a_known_table():
    """Sparse rows: the optimum of the penalised likelihood."""
    w = toxicity._logistic([[0], [0], [1], []], np.array([1.0, 0, 0, 0]), np.array([0.3, 0.1, 0.3, 0.3]), 2, l2=1e-2)
    p = lambda *f: 1 / (1 + np.exp(-(w[2] + sum(w[i] for i in f))))
    grad = [0.3 * (p(0) - 1) + 0.1 * p(0) + 1e-2 * w[0], 0.3 * p(1) + 1e-2 * w[1], 0.3 * (p(0) - 1) + 0.1 * p(0) + 0.3 * p(1) + 0.3 * p()]
    assert np.abs(grad).max() < 1e-4


def test_one_class_and_clashing_columns(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(20)]).selectExpr("*", "1 AS toxic", "2 AS feature", "3 AS n1", "4 AS score", "5 AS held_out")
    all_toxic = spark.createDataFrame([(i, 1, 9) for i in range(20)], "doc_id long, toxic long, n0 long")
    assert {r["predicted"] for r in toxicity.scores(docs, all_toxic).collect()} == {1}
    none_toxic = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic long")
    assert {r["predicted"] for r in toxicity.scores(docs, none_toxic).collect()} == {0}
