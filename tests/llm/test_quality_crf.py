"""The recursions against all labelings, gradients, and held-out accuracy."""

import itertools

import numpy as np
import pytest
from conftest import SF

from peerlens.llm import common
from peerlens.llm import quality_crf as q


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 5, 2])
    x = rng.normal(size=(int(counts.sum()), 4))
    field = q.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
    good, pairs, whole = field.marginals(x, counts, pairs=True)
    want, want_pairs, want_whole, at = [], np.zeros((2, 2)), 0.0, 0
    for n in counts:
        emit = x[at : at + n] @ field.weights
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = np.exp(sum(e for e, v in zip(emit, y) if v) + sum(field.ties[a, b] for a, b in itertools.pairwise(y)))
        z = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[k]) / z for k in range(n)]
        for y, w in weights.items():
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += w / z
        want_whole += np.log(z)
        at += n
    assert good == pytest.approx(np.array(want)) and pairs == pytest.approx(want_pairs) and whole == pytest.approx(want_whole)


def test_features_are_of_each_line_alone():
    bodies = [b"", b"One two, two two.\n\nX!! #|", "é ü\n1 2".encode()]
    own, sizes, counts = q.line_features(bodies)
    assert counts.tolist() == [1, 3, 2] and sizes.tolist() == [0, 17, 0, 6, 5, 3] and own.shape[1] == q.OWN
    alone = np.concatenate([q.line_features([line])[0] for b in bodies for line in b.split(b"\n")])
    assert own == pytest.approx(alone)
    wide = q.with_neighbours(own, counts)
    assert (wide[0, q.OWN :] == 0).all() and (wide[1, q.OWN : 2 * q.OWN] == 0).all() and (wide[3, 2 * q.OWN :] == 0).all()


def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.01")
    from peerlens.llm.quality_crf import op5_quality_crf

    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    rows = op5_quality_crf(spark, sf).collect()
    assert len(rows) == common.table(spark, sf, "documents").count()
    scored = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y, _ in scored if y == v] for v in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([p == y for _, y, p in scored]) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a\nb", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    for field in (None, q.train(docs, labels), q.train(docs, labels.limit(0))):
        out = q.classify(docs, field).collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert q.train(docs.limit(0), labels) is None
    assert q.classify(docs.limit(0), None).count() == 0


def test_samples_long_texts_and_other_columns(spark, monkeypatch):
    """Longer texts than the limit and further rows of an id aren't trained on; all are scored, other columns stay."""
    monkeypatch.setattr(q, "LONGEST", 50)
    rows = [(k, "A plain line of words.\nAnother one here.", "c") for k in range(40)] + [(100 + k, "### $$$ !!!\n!!! ???", "d") for k in range(40)]
    rows += [(k, "### $$$ !!!\n" * 60, "long") for k in range(40)] + [(7, "A plain line of words.\nAnother one here.\nAnd more", "again"), (500, "words and more words.\n" * 30_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows[:80]], "doc_id long, quality int")
    out = q.classify(docs, q.train(docs, labels)).collect()
    assert len(out) == len(rows) and {r.body for r in out} == {"c", "d", "long", "again", "e"}
    assert min(r.score for r in out if r.body == "c") > max(r.score for r in out if r.body in ("d", "long"))
