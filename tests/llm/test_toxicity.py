import itertools
import time
import zlib

import numpy as np
import pytest

from feescope.llm import toxicity

GOOD = ["the house of the river is open", "and that was with other people here", "a garden in the summer rain"]
BAD = ["stupid", "idiot", "moron", "loser"]


@pytest.fixture
def corpus():
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(400):
        words = " ".join(GOOD[k] for k in rng.integers(0, 3, 6)).split()
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words[rng.integers(len(words))] = BAD[rng.integers(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture
def model(spark, docs, corpus):
    rows, labels = corpus
    return toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("noisy, plain", [
    ("1d10t", "idiot"), ("s t u p i d", "stupid"), ("stuuuupid", "stupid"), ("st*pid", "stupid"), ("m.o.r.o.n", "moron"),
    ("l0$er", "loser"), ("1oser", "loser"), ("m0r0n!", "moron"),
])
def test_decodes(model, noisy, plain):
    restorer = toxicity.Restorer(model.grams)
    text = f"the house {noisy} of the {noisy} river in {noisy} and moron rain".encode()
    assert plain in restorer.restored([b"", text])[1].decode().split()
    assert model.scores(restorer.restored([text, b"the house is open of the river"])).round().tolist() == [1, 0]


def test_viterbi_is_the_best_path(model):
    for word in ("1d1ot", "lo00ser", "$+up1d", "aa!b"):
        arcs = toxicity.lattice(word)

        def value(path):
            out, total = "".join(o for o, _ in path), sum(c for _, c in path)
            codes = [0, 0, *[toxicity._code(c) for c in out], 0]
            return total + sum(model.grams[x] for x in zip(codes, codes[1:], codes[2:]))

        best = max(map(value, itertools.product(*arcs)))
        reading = toxicity.decode(word, model.grams)
        options = [value(p) for p in itertools.product(*arcs) if "".join(o for o, _ in p) == reading]
        assert max(options) == pytest.approx(best)


def test_held_out_accuracy(spark, docs, corpus, model):
    rows, labels = corpus
    truth = {i: t for i, _, t in labels}
    found = toxicity.score(docs(rows), model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    out = [r for r in found if r.held_out]
    assert len(out) > 40 and all(r.predicted == truth[r.doc_id] == (r.score >= 0.5) for r in out)


def test_labels_of_the_held_out_fold_do_not_matter(spark, docs, corpus, model):
    rows, labels = corpus
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    other = toxicity.train(docs(rows), spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert np.allclose(other.weights, model.weights) and (other.slots == model.slots).all()


def test_edges(spark, docs, model):
    rows = [(1, None), (2, ""), (3, "\x00 $$$ 1"), (None, "idiot"), (5, "idiot " * 100_000), (6, "é" * 9), (6, "é" * 9)]
    found = toxicity.score(docs(rows), model).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    assert not [r for r in found if r.doc_id is None][0].held_out
    kept = toxicity.keep_clean(docs(rows), model)
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 6}
    assert toxicity.score(docs([]), model).count() == 0


def test_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = toxicity.train(docs([(1, "a")]), empty)
    assert toxicity.score(docs([(1, "a"), (2, None)]), flat).agg({"score": "max"}).first()[0] < 1e-9


@pytest.mark.parametrize("noisy", ["c£own", "£oser", "c€own", "€oser", "c££own"])
def test_symbols_of_several_bytes_mark_a_text(model, noisy):
    restorer = toxicity.Restorer(model.grams)
    text = f"the house {noisy} of the river".encode()
    assert restorer.restored([b"plain", text, b""]) == [b"plain", restorer.restore(text), b""]
    assert restorer.restore(text) != text


def test_fitted_size():
    assert (toxicity.MAX_ROWS, toxicity.N_FEATURES) == (12_000, 512)


@pytest.mark.parametrize("token", ["x" * 10**6, "a1" * 500_000, "*#" * 500_000, "a*#" * 300_000, "@0" * 500_000, "a.b." * 250_000, "a b " * 250_000, "%3Ca$b" * 150_000])
def test_unbroken_megabytes_take_seconds(token):
    """The channel is linear in the token, whatever stands in it; every path of a token is decoded, none is cut."""
    restorer = toxicity.Restorer(np.log(np.full((28, 28, 28), 1 / 28)))
    start = time.process_time()
    out = restorer.restored([f"the id1ot {token} mor0n".encode(), b"plain"])
    assert time.process_time() - start < 40
    assert out[0].decode().split()[-1] in ("moron", "mor0n") and out[1] == b"plain"


def test_tokens_are_read_like_words_of_a_text(model):
    restorer = toxicity.Restorer(model.grams)
    text = 'the ,"1d10t", (l0$er)! _m0r0n_ a+b 10:30 st*pid\tfoo b4r 5tupid... c£own'
    whole = restorer.restore(text.encode()).decode().split()
    for word in ("idiot", "loser", "moron", "stupid"):
        assert word in whole
    assert restorer.restore(b"no marks at all") == b"no marks at all"
