"""The pipeline row by row against plain Python, on awkward and on empty tables."""

import random
import re

import pytest

import corpus_pipeline

# Names that the operators use themselves, beside the columns of documents.
DOCUMENTS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, "
    "hash string, row string, c0 string, size string, key string, flags string"
)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def passes_base(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(w) >= 10 and 100 * len(inside) <= 20 * len(w)


def near_dropped(docs):
    """The smallest id of each component of links."""
    sets = {i: shingles(t) for i, t in docs.items()}
    group = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return {i: docs[i] for i in docs if group[i] == i}


def repeats_cut(docs):
    first, out = {}, {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, text in docs.items():
        w = words(text)
        starts = [k for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i]
        gone = {k + j for k in starts for j in range(13)}
        left = [x for k, x in enumerate(w) if k not in gone]
        if left:
            out[i] = " ".join(left) if gone else text
    return out


def uncontaminated(docs, items):
    def holds(text):
        s = shingles(text)
        return any(
            len(words(x)) >= 5 and 100 * len(shingles(x) & s) >= 80 * len(shingles(x)) for x in items
        )

    return {i: t for i, t in docs.items() if not holds(t)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(500)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, items = make(60), [make(20), make(9), "a b", "", None]
    base = make(150).split(" ")
    out = [make(rng.randint(10, 80)) for _ in range(12)]
    out += [f"{make(30)}\n{passage}\t{make(25)}" for _ in range(4)]
    for i in range(6):
        near = list(base)
        for j in rng.sample(range(150), i):
            near[j] = rng.choice(vocab)
        out.append(" ".join(near))
    out += [out[0], out[0], None, "", "too few words", "same " * 40]
    out += [f"{make(15)} {items[0].upper()} {make(15)}", f"{make(40)} {items[1]}", make(4000)]
    rng.shuffle(out)
    return dict(enumerate(out)), items


def write(spark, folder, docs, items):
    rows = [(i, t, None, f"s{i % 3}" if i % 7 else None, None) + ("z",) * 7 for i, t in docs.items()]
    tables = {
        "documents": (rows, DOCUMENTS),
        "labels": ([(i, 1, 0) for i in docs], "doc_id bigint, quality int, toxic int"),
        "benchmark": (list(enumerate(items)), "item_id bigint, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_rows(spark, tmp_path, texts):
    """No bad label: the base rules alone reject. Nulls and empty texts go with them."""
    docs, items = texts
    steps = [{i: t for i, t in docs.items() if passes_base(t)}]
    steps += [near_dropped(steps[-1])]
    steps += [repeats_cut(steps[-1])]
    steps += [uncontaminated(steps[-1], items)]
    sizes = [len(docs), *map(len, steps)]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4]
    assert steps[1] != steps[2]
    got = corpus_pipeline.run(spark, write(spark, tmp_path / "t", docs, items)).collect()
    assert {r.doc_id: r.size for r in got} == {i: len(words(t)) for i, t in steps[-1].items()}
    assert len(got) == len(steps[-1])
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "t", {}, [])).collect() == []
