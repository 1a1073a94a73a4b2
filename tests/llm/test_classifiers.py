"""Held-out accuracy, and the exact parts against plain versions."""

import itertools
import zlib

import numpy as np
import pytest

from granary.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.93)])
def test_held_out(spark, name, label, least):
    want = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.predicted == want[r.doc_id] for r in rows if r.held_out and r.doc_id in want]
    assert len(held) > 40 and np.mean(held) >= least


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    u, trans = rng.normal(size=6), rng.normal(size=(2, 2))
    p, total = np.zeros(6), 0.0
    for y in itertools.product((0, 1), repeat=6):
        v = np.exp(sum(u[i] * y[i] for i in range(6)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
        total += v
        p += v * np.array(y)
    assert np.allclose(quality.forward_backward(u, trans), p / total)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    x, y, w, trans = rng.normal(size=(1, 4, 3)), np.array([[1.0, 0, 0, 1]]), rng.normal(size=3), rng.normal(size=(2, 2))

    def loglik(w, trans):
        s = lambda ys: sum((x[0, i] @ w) * ys[i] for i in range(4)) + sum(trans[int(a), int(b)] for a, b in itertools.pairwise(ys))
        return s(y[0]) - np.log(sum(np.exp(s(v)) for v in itertools.product((0, 1), repeat=4)))

    dw, dt = quality.gradients(x, y, np.ones((1, 4)), np.ones((1, 4)), w, trans)
    for i in range(3):
        h = np.eye(3)[i] * 1e-5
        assert abs((loglik(w + h, trans) - loglik(w - h, trans)) / 2e-5 - dw[i]) < 1e-5
    for i, j in itertools.product(range(2), repeat=2):
        h = np.zeros((2, 2))
        h[i, j] = 1e-5
        assert abs((loglik(w, trans + h) - loglik(w, trans - h)) / 2e-5 - dt[i, j]) < 1e-5


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "\n\n"), (4, "idiot " * 40000), (5, "A!! B!!\n" * 5000), (5, "same"), (None, "same")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' as _toxicity", "1 as _quality")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for mod, col in ((toxicity, "toxicity"), (quality, "quality_score")):
        model = mod.train(df, none)
        got = mod.scored(df, model).collect()
        assert len(got) == len(texts) and all(0 <= r[col] <= 1 for r in got)
        assert mod.scored(df.filter("false"), model).count() == 0
    assert toxicity.without_toxic(df, toxicity.train(df, none)).columns == df.columns
    assert quality.good_only(df, quality.train(df, none)).count() == len(texts)
    assert quality.line_labels(df.filter("doc_id = 5"), quality.train(df, none)).count() == 5002
    # Two texts with one id, repeated labels and one id with both labels: a defined sample, the same each time.
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (5, 0, 0), (4, 0, 1), (77, 1, 1)], none.schema)
    assert labelled.sample(df, labels, "quality", 10) == labelled.sample(df.repartition(3), labels, "quality", 10)
    assert df.select(labelled.held_out(df.doc_id).alias("h")).filter("h is null").count() == 0


def test_a_misspelling_is_near_its_word():
    bad, good = ["you moron stop that", "what a moron you are"], ["the river runs to the sea", "a warm day in the north"]
    m = toxicity.fit([(t, 1) for t in bad] * 40 + [(t, 0) for t in good] * 40, rounds=2, steps=40)
    assert m.score("you morron stop") > 0.5 > m.score("river runs north to the sea")
    assert m.windows("").shape == (1,)


def test_all_of_a_long_run_counts():
    bad, good = ["you moron stop that", "what a moron you are"], ["the river runs to the sea", "a warm day in the north"]
    m = toxicity.fit([(t, 1) for t in bad] * 40 + [(t, 0) for t in good] * 40, rounds=2, steps=40)
    river = "the river runs to the sea a warm day in the north "
    for mark in ",-_./":
        run = (river * 3).strip().replace(" ", mark)
        assert m.score(run + mark + mark.join("you moron stop that what a moron".split())) > 0.5 > m.score(run)
    run = (river * 3).replace(" ", "")
    assert m.raw(run + "youmoronstopthatwhatamoronyouare" * 2) > m.raw(run) and len(m.windows(run * 50)) > 50
    # Every n-gram of an unmarked run is in a piece.
    long = "".join(chr(0x4E00 + i) for i in range(1000))
    parts = toxicity.split(long)
    assert all(any(long[i : i + 5] in p for p in parts) for i in range(996)) and max(map(len, parts)) == 60
    # In the fit too: the toxic words stand only behind 60 characters of a run.
    hidden = toxicity.fit([(good[0].replace(" ", ",") * 4 + ",you,moron,stop", 1)] * 40 + [(t, 0) for t in good] * 40, rounds=2, steps=40)
    assert hidden.score("you moron stop") > 0.5


def explicit_quality(model, text):
    """Length-weighted probability of good lines over all label sequences, through the logistic."""
    x, weight = quality.features(text)
    u, n = x @ model.w, len(x)
    p, total = np.zeros(n), 0.0
    for y in itertools.product((0, 1), repeat=n):
        v = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(model.trans[a, b] for a, b in itertools.pairwise(y)))
        total += v
        p += v * np.array(y)
    return 1 / (1 + np.exp(-(model.slope * (p / total @ weight) / weight.sum() + model.shift)))


def test_quality_scores_against_all_label_sequences(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    assert (model.trans[0, 0] + model.trans[1, 1]) > (model.trans[0, 1] + model.trans[1, 0])
    short = docs.filter("length(text) - length(replace(text, '\n', '')) < 9").orderBy("doc_id").limit(120)
    got = quality.scored(short.unionByName(docs.filter("doc_id < 0")), model).collect()
    assert len(got) == 120
    for r in got:
        assert abs(r.quality_score - explicit_quality(model, r.text)) < 1e-6


def test_labels_change_within_bad_documents():
    rng = np.random.default_rng(3)
    for _ in range(40):
        u, trans = rng.normal(size=5) * 2, rng.normal(size=(2, 2))
        score = lambda y: sum(u[i] * y[i] for i in range(5)) + sum(trans[a, b] for a, b in itertools.pairwise(y))
        want = max((y for y in itertools.product((0, 1), repeat=5) if 0 in y), key=score)
        assert tuple(quality.best_with_bad(u, trans)) == want
    good, bad = "The river runs to the sea, and the town lies on it.", "WIN!! $$$ NOW!! ### FREE!! $$$"
    m = quality.fit([("\n".join([good] * 8), 1)] * 30 + [("\n".join([good] * 4 + [bad] * 4), 0)] * 30)
    p, _ = m.lines("\n".join([good] * 4 + [bad] * 4))
    assert p[:3].min() > 0.5 > p[5:].max()
    # A line beyond a piece is still one line, and all of it counts.
    assert len(quality.lines_of(bad * 5000)) == 1 and quality.kinds_of(b"a" * 70000 + b"!" * 70000)[[1, 7]].tolist() == [70000, 70000]
    assert sum(len(b[1]) for b in quality.batched([np.zeros((450, 3 * quality.OWN))], [np.ones(450)], [1.0])) == 3


def test_windows_against_explicit_mean_embeddings():
    trainer = toxicity.Trainer(5)
    rng = np.random.default_rng(6)
    trainer.e = rng.normal(size=trainer.e.shape).astype("f4")
    trainer.w, trainer.b = rng.normal(size=trainer.w.shape).astype("f4"), rng.normal(size=2).astype("f4")
    m = trainer.model()
    for text in ("You stupid, stupid fool!", "one", "a b c d e f g", "x" * 150 + " y,z", "Ünsinn über alles ...", "", "!!!"):
        words = [w for w in (x.strip(toxicity.MARKS) for x in toxicity.split(text)) if w]
        k = min(toxicity.WINDOW, len(words))
        want = []
        for i in range(len(words) - k + 1) if words else []:
            bag = [g for w in words[i : i + k] for g in toxicity.subwords(w)]
            z = trainer.e[bag].astype("f8").mean(0) @ trainer.w.astype("f8") + trainer.b
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            want.append(np.log(p[1] / p[0]))
        want = want or [float(trainer.b[1] - trainer.b[0])]
        assert np.allclose(m.windows(text), want, atol=1e-4)
        top = max(range(len(want)), key=want.__getitem__)
        rest = [v for i, v in enumerate(want) if abs(i - top) >= toxicity.WINDOW] or [want[top]]
        raw = (want[top] + max(rest)) / 2
        assert abs(m.raw(text) - raw) < 1e-4
        assert abs(m.score(text) - 1 / (1 + np.exp(-(m.slope * raw + m.shift)))) < 1e-4
