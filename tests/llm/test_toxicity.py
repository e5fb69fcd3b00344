import re

import numpy as np
import pytest

from corpusloom.llm.toxicity import STRIDE, WINDOW, Inputs, Model, fit, held_out, inputs, sample, score_toxicity
from corpusloom.llm.words import ALNUM, Words


def words(text):
    raw = text.encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), ALNUM, fold=True)


def made(n, rng):
    """Texts of invented words; every third holds an insult in one of a few forms."""
    plain = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        t = rng.choice(plain, int(rng.integers(5, 200))).tolist()
        if i % 3 == 0:
            t[int(rng.integers(len(t)))] = rng.choice(["grumblefool", "grumblefools", "snarkface"])
        out.append((i, " ".join(t), int(i % 3 == 0)))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = made(600, np.random.default_rng(4))
    odd = [(1_000, None), (1_001, ""), (None, "w1 grumblefool"), (1_002, "w1 " * 60_000 + "snarkface " + "w2 " * 10), (1_003, "w1 " * 60_000), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string").selectExpr("*", "'x' as score", "5 as n")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (9_999, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.n == 5 for r in got)
    out = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 60 and np.mean([a == b for a, b in out]) >= 0.95
    odd_scores = {r.doc_id: r.predicted for r in got if r.doc_id is None or r.doc_id >= 1_000}
    assert odd_scores == {1_000: 0, 1_001: 0, None: 1, 1_002: 1, 1_003: 0}
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert {r.doc_id for r in got if r.held_out} >= {r.doc_id for r in docs.where(held_out() & docs.doc_id.isNotNull()).collect()}


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_labels_of_one_kind_or_none(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    got = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    assert score_toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_gradients_are_those_of_small_steps():
    rng = np.random.default_rng(0)
    model = Model.fresh(np.arange(1, 6, dtype=np.uint64), rng)
    model.weights = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in model.weights.items()}
    model.weights["E"][0] = 0
    known = Inputs(rng.integers(1, 6, 9), np.array([0, 2, 2, 5, 6, 9]))
    index, y = rng.integers(0, 5, (5, 3)), np.array([1.0, 0.0, 1.0])
    mask = np.ones((5, 3))
    mask[3:, 1] = 0

    def loss():
        e = model.weights["E"]
        x = np.stack([e[known.of[a:z]].sum(0) for a, z in zip(known.first, known.first[1:])])
        z = model.logits(x, index, mask)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = model.gradients(known, index, mask, y)
    for name, at in (("E", (2, 1)), ("E", (5, 0)), ("Wf", (0, 3)), ("Ub", (2, 5)), ("Uf", (1, 20)), ("bf", (4,)), ("A", (3, 2)), ("v", (1,)), ("u", (6,)), ("c", (0,)), ("bb", (17,))):
        w, step = model.weights[name], 1e-4
        w[at] += step
        up = loss()
        w[at] -= 2 * step
        slope = (up - loss()) / (2 * step)
        w[at] += step
        assert g[name][at] == pytest.approx(slope, rel=2e-2, abs=1e-4)


def sampled(spark, rows):
    return spark.createDataFrame([(i, y, t, "train" if i % 5 else "calibrate") for i, t, y in rows], "doc_id long, y int, text string, part string").repartition(2)


def test_all_windows_of_a_text_teach_and_count(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i, t, y in made(400, rng):  # the insult lies anywhere in a text of many windows
        lead = rng.choice([f"w{k}" for k in range(60)], int(rng.integers(0, 1_500))).tolist()
        rows.append((i, " ".join([*lead, t]), y))
    model = fit(sampled(spark, rows))
    clean = model.worst(words("w3 " * 1_400))[0]
    for where in (0, 700, 1_399):
        t = ["w3"] * 1_400
        t[where] = "grumblefool"
        score = model.scores(words(" ".join(t)))[0]
        assert score >= 0.5 and model.worst(words(" ".join(t)))[0] > clean


def test_altered_forms_of_a_known_word_are_known(spark):
    model = fit(sampled(spark, made(600, np.random.default_rng(2))))
    plain = "w1 w2 w3 w4 w5 w6"
    for form in ("xgrumblefool", "grumblefoolery", "grumblefoo1", "zzgrumblefoolzz", "ggrumblefool"):
        assert model.scores(words(f"{plain} {form} {plain}"))[0] >= 0.5, form
    for form in ("grundlage", "trumpet", "w77", "éclair"):
        assert model.scores(words(f"{plain} {form} {plain}"))[0] < 0.5, form


def test_order_matters_and_not_words_alone(spark):
    """What is toxic here is one common word right before another: no list of words, and no bag of them, tells."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1_600):
        t = rng.choice([f"w{k}" for k in range(20)], int(rng.integers(6, 16))).tolist()
        at = int(rng.integers(len(t) - 1))
        pair = ["alpha", "omega"] if i % 2 else ["omega", "alpha"]
        rows.append((i, " ".join([*t[:at], *pair, *t[at:]]), i % 2))
    model = fit(sampled(spark, rows[:1_200]))
    right = np.mean([(model.scores(words(t))[0] >= 0.5) == y for _, t, y in rows[1_200:]])
    assert right >= 0.9
    bag = Model(model.vocabulary, {k: v.copy() for k, v in model.weights.items()}, model.slope, model.shift)
    for k in "fb":
        bag.weights[f"U{k}"][:] = 0  # nothing is carried from word to word
        bag.weights[f"b{k}"][: bag.weights[f"U{k}"].shape[0]] = -20
    assert np.mean([(bag.scores(words(t))[0] >= 0.5) == y for _, t, y in rows[1_200:]]) <= 0.65


def plain_score(model, text):
    """One window at a time, one word at a time."""
    p = {k: v.astype(np.float64) for k, v in model.weights.items()}
    number = {int(h): i + 1 for i, h in enumerate(model.vocabulary)}
    tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    if not tokens:
        return 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    embed = {}
    for t in set(tokens):
        x, _ = inputs(words(t))
        embed[t] = sum((p["E"][number.get(int(h), 0)] for h in x.of), np.zeros(p["E"].shape[1]))
    worst = -np.inf
    for a in range(0, max(1, len(tokens) - WINDOW + STRIDE), STRIDE):
        window, states = tokens[a : a + WINDOW], []
        for k, steps in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h, out = np.zeros(p["Uf"].shape[0]), {}
            n = len(h)
            for t in steps:
                xt, hu = embed[window[t]] @ p[f"W{k}"] + p[f"b{k}"], h @ p[f"U{k}"]
                z, r = sigmoid(xt[:n] + hu[:n]), sigmoid(xt[n : 2 * n] + hu[n : 2 * n])
                new = np.tanh(xt[2 * n :] + r * hu[2 * n :])
                h = out[t] = z * h + (1 - z) * new
            states.append(np.stack([out[t] for t in range(len(window))]))
        h = np.concatenate(states, 1)
        e = np.exp(np.tanh(h @ p["A"] + p["a"]) @ p["v"])
        worst = max(worst, float(((e / e.sum())[:, None] * h).sum(0) @ p["u"] + p["c"][0]))
    return sigmoid(model.slope * worst + model.shift)


def test_scores_are_those_of_a_plain_network(spark):
    rng = np.random.default_rng(12)
    rows = made(300, rng)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, "É à " * 90 + "snarkface"), (901, "...")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = fit(sample(docs, labels, "toxic"))
    texts = {i: t for i, t, _ in rows} | {900: "É à " * 90 + "snarkface", 901: "..."}
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert len(got) == len(texts)
    for i in [*range(0, 300, 7), 900, 901]:
        assert got[i] == pytest.approx(plain_score(model, texts[i]), abs=2e-3)


def test_inputs_are_words_and_their_runs_of_characters():
    x, number = inputs(words("Éclair clair éclair ab"))
    assert number.tolist().count(number[2]) == 1 and np.diff(x.first).sum() == len(x.of)
    size = {t: len(set(inputs(words(t))[0].of.tolist())) for t in ("éclair", "clair", "ab", "abc", "abcde")}
    assert size == {"éclair": 1 + 4 + 2, "clair": 1 + 3 + 1, "ab": 1, "abc": 2, "abcde": 1 + 3 + 1}
    of = lambda t: set(inputs(words(t))[0].of.tolist())
    assert of("éclair") & of("clair") and not of("abc") & of("xabcx")
