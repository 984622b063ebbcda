"""The prefix trie, the filter audit and language ID against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import filter_audit, language_id, prefix_trie
from gradus.llm.blocks import blocks

# --- op11 ------------------------------------------------------------------

TURNS = (
    "conv_id bigint, turn int, role string, text string, "
    # names that the operator uses itself
    "id string, d string, name string, chars string, pos string, q string, part string"
)


def conversations(seed):
    rng = random.Random(seed)
    texts = ["a", "b", "é", "long " * 50, None, ""]
    rows = []
    for c in [*range(0, 12), *range(100, 130), *range(200, 215), 405, 407, -3]:
        depth = rng.choice([1, 2, 3, 5, 8, 8, 8, 21])
        turns = list(range(depth))
        if rng.random() < 0.3:
            turns[0] = None
        for t in turns:
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(texts[: rng.choice([1, 1, 2, 6])])))
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(700, i, "user", "a") for i in range(40)]
    rows += [(701, i, "user", "a") for i in range(40)]
    rng.shuffle(rows)
    return rows


def order_of(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, name)


def trie_plain(rows, head=True):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=order_of)] for c, rs in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if head else 0
        first = own.get(c - int(c / 100) * 0 - (abs(c) % 100) * (1 if c >= 0 else -1), []) if head else []
        built[c] = tuple(first[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if built[c] == p)
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out[(min(cs), len(p), parent, len(cs), kids[p], leaves[p], saved[p], digest)] += 1
    return out


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r,) + ("z",) * 7 for r in rows], TURNS).repartition(3)


def test_prefix_trie(spark):
    rows = conversations(1)
    got = Counter(map(tuple, prefix_trie.nodes(*prefix_trie.rebuilt(turns_frame(spark, rows))).collect()))
    assert got == trie_plain(rows)
    assert sum(n for k, n in got.items() if k[3] > 1) > 10


def test_prefix_trie_of_conversations_as_they_are(spark, monkeypatch):
    # Ends in chunks, names in blocks, and a batch as large as the other.
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "FIRST_BATCH", 2)
    rows = conversations(2)
    rows += [(900 + i, t, "user", "b") for i in range(9) for t in range(3)]
    rows += rows[:20]  # repeated rows are turns each
    got = Counter(map(tuple, prefix_trie.nodes(*prefix_trie.numbered(turns_frame(spark, rows))).collect()))
    assert got == trie_plain(rows, head=False)


def test_prefix_trie_without_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.nodes(*prefix_trie.rebuilt(empty)).collect() == []
    # Conversation 3 drops its only turn, as crc32("3") % 6 > 0, and 0 is absent.
    assert zlib.crc32(b"3") % 6 > 0
    one = turns_frame(spark, [(3, 0, "user", "x")])
    nothing = hashlib.sha256(b"3").hexdigest()
    assert [tuple(r) for r in prefix_trie.nodes(*prefix_trie.rebuilt(one)).collect()] == [
        (3, 0, None, 1, 0, 1, 0, nothing)
    ]


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(-1, 40) for b in range(a + 1, 41) if b or a == -1]
    df = spark.createDataFrame(pairs, "a int, b int")
    for r in df.select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        best = max(range(r.a + 1, r.b + 1), key=lambda x: (x & -x) if x else 1 << 30)
        assert r.f == best


# --- op12 ------------------------------------------------------------------

DOCS = (
    "doc_id bigint, text string, lang string, source string, "
    "id string, part string, flags string, words string, n string, bucket string"
)


def audit_plain(rows, labels):
    big = 1 << 62
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t)
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", big), big if i is None else i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = defaultdict(list)
    for i, t, source in rows:
        t = t or ""
        w = words(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": (big if i is None else i) > first[t],
        }
        docs[source or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, held in docs.items():
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f in x[0] for x in held) - len(gone),
                    sum(x[0] == {f} for x in held),
                    sum(x[1] for x in gone),
                    sum(x[2] for x in gone),
                ]
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 4_000)
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdéABC", k=rng.randint(1, 7))) for _ in range(300)]
    rows = []
    for i in range(90):
        text = " ".join(rng.choices(vocab[: rng.choice([30, 300])], k=rng.choice([3, 49, 50, 51, 120])))
        text = text.lower() if i % 3 else text
        rows.append((i, text + rng.choice(["", "", "\n#", "\t100%"]), f"s{i % 4}" if i % 9 else None))
    rows += [(200 + i, rows[i % 3][1], "s1") for i in range(9)]
    rows += [(300, None, "s0"), (301, "", None), (None, rows[0][1], "s2"), (None, "null id", "s2"), (302, " \n", "")]
    rows += [(400, "word " * 6000 + "x", "s3"), (5, rows[5][1], "s1"), rows[7]]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 2)]
    labels += [(0, 1, None), (0, None, 0), (None, 1, 1), (9999, 1, 1), (3, None, None)]
    docs = spark.createDataFrame([(i, t, "l", s) + ("z",) * 6 for i, t, s in rows], DOCS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    expected = audit_plain(rows, labels)
    assert len(got) == len(expected) == 600 * len({s or "" for _, _, s in rows})
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == expected
    assert filter_audit.audit(docs.limit(0), marks).collect() == []
    assert len(filter_audit.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").collect()) == 0


def test_shards_are_one_matrix(spark, monkeypatch):
    """Words have one code in all shards, and the cells are the words' counts."""
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 300)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("the of und é Das le 42".split(), k=i % 40)), None) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "l", s) + ("z",) * 6 for i, t, s in rows], DOCS).repartition(2)
    shards, n_buckets = filter_audit.matrix(docs)
    counted = {}
    shards = shards.collect()
    assert len(shards) > 4
    for r in shards:
        indptr, indices, data = filter_audit.csr(r.asDict(recursive=True), n_buckets)
        for k, i in enumerate(r["ids"]):
            cells = slice(indptr[k], indptr[k + 1])
            counted[i] = dict(zip(indices[cells].tolist(), data[cells].tolist(), strict=True))
    code = {}
    for i, t, _ in rows:
        expected = Counter(t.split())
        assert sorted(counted[i].values()) == sorted(expected.values())
        assert len(counted[i]) == len(expected)
        for c, n in counted[i].items():
            code.setdefault(c, {w for w in expected if expected[w] == n}).intersection_update(
                w for w in expected if expected[w] == n
            )
    assert len(code) == 7 and all(code.values())


def test_squeezed():
    for values in ([], [0], [1, 2**32 - 1, 70000, 5] * 9):
        values = np.array(values, np.int64)
        assert (filter_audit.unsqueezed(filter_audit.squeezed(values)) == values).all()


# --- op13 ------------------------------------------------------------------

LANGS = "doc_id bigint, text string, lang string, source string, score string, held_out string, lettered string"
SYLLABLES = {
    "en": "the ing and tion er on th ly".split(),
    "de": "der ung und sch ein ich st keit".split(),
    "fr": "le eau que ment ou ç é oi".split(),
    "es": "el ción os que ñ ar mente y".split(),
    "xx": "zu qa xo wi ky".split(),
}


def language_rows():
    rng = random.Random(6)
    word = lambda x: "".join(rng.choices(SYLLABLES[x], k=rng.randint(1, 3)))
    rows = []
    for i in range(1500):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join(word(lang) for _ in range(rng.choice([8, 30, 80])))
        rows.append((i, text.upper() if i % 11 == 0 else text, lang))
    return rows


def test_language_id(spark):
    rows = language_rows()
    odd = [(5000, None, "en"), (5001, "", "en"), (5002, "12 !? 34", "fr"), (None, rows[0][1], rows[0][2]),
           (5003, rows[1][1], None), (5004, "the ing " * 60_000, None), rows[4], rows[4], (5005, "日本語", None)]
    frame = lambda rs: spark.createDataFrame([(*r, "s", "z", "z", "z") for r in rs], LANGS).repartition(3)
    docs = frame(rows + odd)
    model = language_id.learn(docs)
    assert model.members == [["de", "en"], ["es", "fr"], ["xx"]]
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    truth = {i: lang for i, _, lang in rows}
    assert len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99
    for i in (5000, 5001, 5002):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[None].lang_pred == rows[0][2] and not by_id[None].held_out
    assert by_id[5004].lang_pred == "en" and by_id[5005].lang_pred in truth.values()
    assert all(0 <= r.score <= 1 for r in got)
    same = [r for r in got if r.doc_id == rows[4][0]]
    assert len(same) == 3 and len(set(same)) == 1
    # Labels of held-out documents and other columns have no part in it.
    changed = docs.withColumn(
        "lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "en").otherwise(F.col("lang"))
    ).withColumn("source", F.col("lang"))
    again = {r.doc_id: r for r in language_id.predict(changed, language_id.learn(changed)).collect()}
    assert all(again[r.doc_id].lang_pred == r.lang_pred for r in got)
    assert language_id.predict(docs.limit(0), model).collect() == []


def test_language_id_with_little_to_learn(spark):
    frame = lambda rs: spark.createDataFrame([(*r, "s", "z", "z", "z") for r in rs], LANGS)
    none = frame([(1, "abc", None), (2, "12", "en"), (None, "abc", "en")])
    model = language_id.learn(none)
    assert model.families == []
    assert [(r.lang_pred, r.score) for r in language_id.predict(none, model).collect()] == [("und", 0.0)] * 3
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    one = frame([(i, "the thing", "en") for i in ids])
    model = language_id.learn(one, sample_rows=3)
    assert {r.lang_pred for r in language_id.predict(one, model).collect()} == {"en"}


def test_features_are_those_of_each_text():
    """Against plain counting, with slices that end within texts."""
    rng = random.Random(1)
    texts = ["", "ab  cd.", "é" * 9, "x", " ".join("".join(rng.choices("abé !", k=9)) for _ in range(30)), "12"]
    whole = language_id.SLICE
    try:
        for size in (7, 64, whole):
            language_id.SLICE = size
            (block,) = blocks(pa.array(texts))
            got = language_id.feature_counts(block)
            for text, counts in zip(texts, got, strict=True):
                plain = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.encode()).strip()
                plain = b" " + plain + b" " if plain else b" "
                n = sum(
                    1 for k in range(1, 5) for i in range(len(plain) - k + 1) if plain[i : i + k].strip()
                )
                assert counts.sum() == n, (size, text)
            first = got if size == 7 else first
            assert (got == first).all()
    finally:
        language_id.SLICE = whole


def test_model_is_the_same_for_any_block():
    """Scores of a text don't depend on its neighbours."""
    rows = language_rows()[:200]
    counts = np.zeros((200, language_id.WIDTH), np.float32)
    for i, (_, text, _) in enumerate(rows):
        (block,) = blocks(pa.array([text.lower()]))
        counts[i] = language_id.feature_counts(block)[0]
    model = language_id.train(counts, [r[2] for r in rows])
    (block,) = blocks(pa.array([r[1].lower() for r in rows]))
    names, score = model.predict(block)
    for i in range(0, 200, 17):
        (one,) = blocks(pa.array([rows[i][1].lower()]))
        name, s = model.predict(one)
        assert name[0] == names[i] and s[0] == pytest.approx(score[i], abs=1e-4)
