import random

import numpy as np
import pyarrow as pa
import pytest
from fleetcast.llm.queries import TOXIC_FROM, held_out
from fleetcast.llm.toxicity import Machine, fit_machine, learn_toxicity, score_toxicity, term_sets


def corpus(n, seed, toxic):
    """Texts in which an insult and a group's name stand by chance; ``toxic`` says which of the four cases are."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))] + ["grumble"] * insult + ["martians"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(toxic(insult, group)))
    return texts, np.array(labels)


def test_score_is_the_factorization_machine():
    texts = pa.array(["grumble at martians", "nothing", "", None, "Grumble"])
    sets = term_sets(texts)
    terms = np.unique(np.concatenate(sets))
    rng = np.random.default_rng(1)
    m = Machine(terms, -1.0, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3)))
    for text, got in zip(texts, m.score(texts), strict=True):
        at = np.searchsorted(terms, term_sets(pa.array([text], pa.string()))[0])
        z = -1.0 + m.w[at].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(at) for b in at[:i])
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@pytest.mark.parametrize("case", ["together", "one alone"])
def test_learns_pairs_that_additive_weights_miss(spark, case):
    """As registered: default fit, threshold of the query. Without the factors the pairs are lost."""
    toxic = (lambda a, b: a and b) if case == "together" else (lambda a, b: a != b)
    texts, labels = corpus(3000, 1, toxic)
    test, truth = corpus(800, 2, toxic)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = spark.createDataFrame(list(enumerate(labels.tolist())), "doc_id long, toxic int")
    machine = learn_toxicity(docs, marked, ~held_out("doc_id"))
    right = lambda m: ((m.score(pa.array(test)) >= TOXIC_FROM) == truth).mean()
    assert right(machine) > 0.95
    without = Machine(machine.terms, machine.bias, machine.w, machine.v * 0)
    assert right(without) < right(machine) - (0.2 if case == "one alone" else 0)


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    machine = learn_toxicity(docs, labels, ~held_out("doc_id"))
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(held_out("doc_id"))
    got = score_toxicity(held, machine).select("toxic", "score").toPandas()
    predicted = got.score >= TOXIC_FROM
    assert predicted[got.toxic == 1].mean() > 0.9 and predicted[got.toxic == 0].mean() < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "a", 9.0), (3, "b " * 200_000, 9.0), (3, "b", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, 7), (9, 1)], "doc_id long, toxic int")
    machine = learn_toxicity(docs, labels, held_out("doc_id") | ~held_out("doc_id"))
    got = score_toxicity(docs, machine)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 5
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert score_toxicity(docs.limit(0), machine).collect() == []
    assert learn_toxicity(docs, labels.limit(0), held_out("doc_id")).terms.size == 0
