"""Learned scores: toxicity and the byte network."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gradus.llm import quality_cnn, toxicity
from gradus.llm.blocks import blocks, range_names

DOCS = "doc_id bigint, text string, score string, held_out string, n string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_and_trie():
    rng = random.Random(0)
    terms = [(w, b, 9.0) for w, b in (("idiot", False), ("scumbag", False), ("vequ", True), ("chlla", True))]
    lexicon = toxicity.Lexicon(terms)
    words = ["".join(rng.choices("idotscumbagvequhl1", k=rng.randint(1, 8))) for _ in range(3000)]
    for t, _, _ in terms:
        for i in range(len(t)):
            words += [t[:i] + t[i + 1 :], t[:i] + "x" + t[i:], t[:i] + "9" + t[i + 1 :], t + "s", t]
    for word in words:
        near = []
        for t, beginning, _ in terms:
            n = min(edits(t, word[:k]) for k in range(len(word) + 1)) if beginning else edits(t, word)
            if n == 0 or (n <= 1 and len(t) >= toxicity.FUZZY_FROM):
                near.append(n)
        got = lexicon.best_hit(word)
        assert (got[0] if got else None) == (min(near) if near else None), word


def corpus(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("ptkmnsrl", k=rng.randint(3, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        w = rng.choices(vocab, k=rng.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            bad = rng.choice(["idiot", "scumbag", "worthless"])
            if i % 35 == 0:
                bad = bad[:2] + "0" + bad[3:]
            w[rng.randrange(len(w))] = bad
        rows.append((i, " ".join(w), "z", "z", "z"))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (9999, 0, 1)]
    rows += [(1000, None, "z", "z", "z"), (1001, "", "z", "z", "z"), (None, "an idiot", "z", "z", "z")]
    return (
        spark.createDataFrame(rows, DOCS).repartition(3),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        {i for i in range(0, 700, 5)},
    )


def test_toxicity(spark):
    docs, labels, toxic = corpus(spark)
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 703
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert len(held) > 150
    right = sum((r.predicted == 1) == (r.doc_id in toxic) for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[1000].score == got[1001].score == min(r.score for r in got.values())
    assert got[None].predicted == 1 and not got[None].held_out
    none = toxicity.learn(docs, labels.limit(0))
    assert none.terms == []
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_no_term_is_cut(spark):
    """More terms pass than the earlier bounds of 100,000 and 2,000; rare ones as well
    as frequent ones, and their beginnings count as one term."""
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{k:05d}")[::-1]
    rare = [name(k) for k in range(2_500)]
    common = " ".join("com" + w for w in rare)
    rows = [(f"{' '.join(rare)} {common}", True)] * 4 + [(common, True)] * 2 + [(common, False)]
    found = toxicity.passing_terms(spark.createDataFrame(rows, "text string, toxic boolean"))
    assert {(w, False, 4, 0) for w in rare} <= set(found)
    assert not any(t.startswith("com") and not w for t, w, _, _ in found if len(t) == 8)
    terms = {t for t, _, _ in toxicity.choose_terms(found)}
    assert all(any(w.startswith(t) for t in (w[:4], w) if t in terms) for w in rare)


def test_quotation_counts_less():
    hits = toxicity.Hits([("idiot", False, 9.0)])
    texts = ['he wrote "you are an idiot" to me', "you are an idiot to me", None, "an 1diot"]
    block = next(blocks(pa.array(texts, pa.string())))
    x = hits.features(block)
    assert x[:, 4:].tolist() == [[0, 1, 0, 0], [1, 0, 0, 0], [0] * 4, [0, 0, 1, 0]]
    score = toxicity.Model([], toxicity.PRIOR).score(x[:, :4])
    assert score[2] < score[0] < score[3] < score[1]


def test_chunks_cover_texts():
    texts = [b"", b"a", bytes(range(256)) * 5, b"x" * 256, b"y" * 257]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows, first = quality_cnn.chunked(data, offsets)
    for i, text in enumerate(texts):
        mine = rows[first[i] : first[i + 1]]
        joined = b"".join(r[: quality_cnn.STEP].tobytes() for r in mine[:-1]) + mine[-1].tobytes()
        assert joined[: len(text)] == text
        assert set(joined[len(text) :]) <= {0}


def test_score_is_a_plain_convolution():
    """Byte by byte and filter by filter, with chunks in slices and texts of all sizes."""
    rng = np.random.default_rng(4)
    net = quality_cnn.Network(5)
    sizes = (0, 1, 4, 255, 256, 257, 1000, 9000)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = net.score(data, offsets, rows_at_once=7)
    assert got == pytest.approx(net.score(data, offsets, rows_at_once=512))
    chunk, step, width = quality_cnn.CHUNK, quality_cnn.STEP, quality_cnn.WIDTH
    for text, score in zip(texts, got, strict=True):
        peaks, at = [], 0
        while True:
            piece = text[at : at + chunk + width - 1].ljust(chunk + width - 1, b"\0")
            peaks.append(
                [
                    max(
                        sum(net.vectors[piece[i + w]] @ net.filters[w, :, f] for w in range(width))
                        for i in range(chunk)
                    )
                    for f in range(quality_cnn.FILTERS)
                ]
                if len(text) < 2000
                else None
            )
            if at + chunk >= len(text):
                break
            at += step
        if len(text) >= 2000:
            assert 0 <= score <= 1
            continue
        live = np.maximum(np.array(peaks) + net.shift, 0)
        z = np.concatenate([live.max(0), live.mean(0)]) @ net.weights + net.bias[0]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_long_texts_teach_by_pieces(spark):
    size = quality_cnn.SAMPLE_BYTES
    texts = ["", "é", "a" * size, "a" * (size + 1), "".join(chr(97 + i * 26 // 200_000) for i in range(200_000)), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in rows.select("i", quality_cnn.sampled(rows.text).alias("s")).collect()}
    assert [got[i] for i in range(3)] == [t.encode() for t in texts[:3]] and got[5] is None
    assert len(got[3]) == len(got[4]) == size
    assert got[4][:1] == b"a" and got[4][-1:] == b"z" and len(set(got[4])) >= quality_cnn.SAMPLE_PIECES
    # Good and bad are told apart where only long texts have labels.
    rng = random.Random(8)
    long = [(i, ("abcd " if i % 2 else "#|#| ") * rng.randint(4000, 5000), "z", "z", "z") for i in range(60)]
    docs = spark.createDataFrame(long, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    model = quality_cnn.learn(docs, labels)
    out = quality_cnn.score(docs.unionByName(docs), model).collect()
    # Five steps don't calibrate the cut, but they put every good text above every bad one.
    good, bad = ([r.score for r in out if r.doc_id % 2 == side] for side in (1, 0))
    assert len(out) == 120 and min(good) > max(bad) + 0.1


def test_gradients():
    net = quality_cnn.Network(3)
    for part in net.PARTS:
        setattr(net, part, getattr(net, part).astype(np.float64))
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 900).astype(np.uint8)
    offsets = np.array([0, 100, 520, 900])
    good = np.array([1.0, 0.0, 1.0])
    rows, first = quality_cnn.chunked(data, offsets)

    def loss():
        table = np.einsum("bv,wvf->wbf", net.vectors, net.filters)
        peaks = net.responses(table, rows).max(1)
        p = net.probability(net.pooled(peaks, first))
        return -np.mean(good * np.log(p) + (1 - good) * np.log(1 - p)) + 5e-5 * (net.weights**2).sum()

    slopes = net.gradients(rows, first, good)
    for part in net.PARTS:
        values = getattr(net, part)
        for at in rng.integers(0, values.size, 6):
            place = np.unravel_index(at, values.shape)
            old = values[place]
            values[place] = old + 1e-4
            up = loss()
            values[place] = old - 1e-4
            down = loss()
            values[place] = old
            assert slopes[part][place] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def test_network_learns(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randint(5, 120))]
        good = i % 4 != 0
        rows.append((i, (" " if good else "### ").join(words), "z", "z", "z"))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows + [(900, None, "", "", ""), (901, "", "", "", ""), (None, "abc", "", "", "")], DOCS)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_cnn.learn(docs, lab)
    got = {r.doc_id: r for r in quality_cnn.score(docs, model).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    right = sum((r.predicted == 1) == (r.doc_id % 4 != 0) for r in held)
    assert len(held) > 50 and right / len(held) > 0.95
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    assert quality_cnn.score(docs.limit(0), model).collect() == []
    one = quality_cnn.learn(docs, lab.where("quality = 1"))
    assert {r.score for r in quality_cnn.score(docs, one).collect()} == {1.0}
    assert {r.score for r in quality_cnn.score(docs, quality_cnn.learn(docs, lab.limit(0))).collect()} == {0.5}


def test_names_are_of_bytes():
    block = next(blocks(pa.array(["ab ab", "ab", None, "é ab"])))
    starts, ends, first = block.words()
    names = range_names(block.data, starts, ends)
    assert first.tolist() == [0, 2, 3, 3, 5]
    assert names[0] == names[1] == names[2] == names[4] != names[3]
