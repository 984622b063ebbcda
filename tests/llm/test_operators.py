"""The operators against plain Python, on small tables with awkward rows."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from gradus.llm import (
    byte_dedup,
    decontaminate,
    jaccard_join,
    match,
    mixing,
    quality_rules,
    substring_dedup,
    token_counts,
    url_filter,
)
from gradus.llm.blocks import Block, mix, range_names
from gradus.llm.components import components

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that the operators use themselves
    "id string, hash string, flags string, n_words string, kept string, size string, "
    "row string, items string, c0 string, node string, copies string"
)
SPACES = "[^\x20\x09-\x0d]+"


def words(text):
    return re.findall(SPACES, text or "")


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: copies, near copies, shared passages, nulls, empty and long."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, line = make(60), make(14)
    out = [make(rng.randint(0, 120)) for _ in range(25)]
    out += [f"{make(20)}\n{passage}  {make(30)}" for _ in range(6)]
    out += [f"{line}\n{make(40)}" for _ in range(6)]
    base = make(150).split(" ")
    for i in range(12):
        near = list(base)
        for j in rng.sample(range(150), i // 2):
            near[j] = rng.choice(vocab)
        out.append(" ".join(near))
    out += [out[0], out[0], "", " \n ", None, None, "a b c", "A b\tC", "x " * 300, "aa" * 400]
    out += [make(5000), "same " * 40 + passage]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out, strict=True))


def frame(spark, rows):
    full = [(i, t, None, f"s{(i or 0) % 4}" if i != 3 else None, None) + ("z",) * 11 for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, texts):
    # A null id, and a row that is there twice.
    return frame(spark, [*texts, (None, "p q r s t u v"), texts[4]]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- op1 -------------------------------------------------------------------


def removed_plain(rows):
    big = 1 << 62
    first = {}
    for i, t in rows:
        w, i = words(t), big if i is None else i
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, big), i)
    out = []
    for i, t in rows:
        w, own = words(t), big if i is None else i
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < own:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_removed_words(docs, empty):
    got = Counter(map(tuple, substring_dedup.removed_words(docs).collect()))
    expected = removed_plain(rows_of(docs))
    assert got == expected
    assert sum(n * k[2] for k, n in got.items()) > 300
    assert substring_dedup.removed_words(empty).collect() == []


@pytest.mark.parametrize("later", [True, False])
def test_rows_with_one_id_in_a_block(later):
    """Every row gets its own flags, also where rows of one id share a block."""
    rng = np.random.default_rng(3)
    mode = match.LATER if later else match.SHARED
    for _ in range(60):
        blocks, packed = [], []
        for _ in range(3):
            n = int(rng.integers(1, 6))
            ids = rng.choice([1, 2, 3, match.NULL_ID], n)
            hashes = rng.integers(0, 1 << 40, n)
            counts = rng.integers(0, 6, n)
            first = np.append(0, np.cumsum(counts))
            keys = mix(rng.integers(0, 12, counts.sum()).astype(np.uint64))
            checks = keys.astype(np.uint32) if later else None
            blocks.append((ids, hashes, first, keys))
            packed += match.pack(ids, hashes, first, keys, 8, mode, checks)
        flagged = {}
        if packed:
            table = pa.Table.from_batches(match.packed_batches(iter(packed)))
            for b in range(8):
                group = table.filter(pc.equal(table["bucket"], b))
                for r in match._matcher(mode)(group).to_pylist():
                    flagged.setdefault((r["id"], r["hash"]), []).append(r)
        held = {}
        for ids, _, first, keys in blocks:
            for i, k in zip(np.repeat(ids, np.diff(first)), keys, strict=True):
                held.setdefault(int(k), set()).add(int(i))
        for ids, hashes, first, keys in blocks:
            flags = pa.array([flagged.get((i, h)) for i, h in zip(ids, hashes, strict=True)])
            got = match.read_flags(flags, keys, first, not later)
            owner = np.repeat(ids, np.diff(first))
            for i, k, hit in zip(owner, keys, got, strict=True):
                assert hit == (min(held[int(k)]) < i if later else len(held[int(k)]) > 1)


def test_deduplicate_keeps_columns(docs, texts, empty):
    out = substring_dedup.deduplicate(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    by_id = dict(texts)
    fate = {k[0]: k for k in removed_plain(rows_of(docs))}
    for i, text in by_id.items():
        _, n, cut, digest = fate[i]
        if n and n == cut:
            assert i not in got
        elif not cut:
            assert got[i].text == text
        else:
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == digest
            assert got[i].n_chars == len(got[i].text)
        if i in got:
            assert got[i].c0 == got[i].flags == "z"
    assert substring_dedup.deduplicate(empty).collect() == []


def test_recompression_is_consistent():
    """Symbols inside equal sequences are equal, whatever is around them."""
    rng = np.random.default_rng(3)
    inner = rng.integers(1, 9, 40).astype(np.uint64)
    seen = []
    for _ in range(20):
        left = rng.integers(1, 9, rng.integers(0, 9)).astype(np.uint64)
        right = rng.integers(1, 9, rng.integers(0, 9)).astype(np.uint64)
        names = np.concatenate([left, inner, right])
        s = substring_dedup.symbols(names, np.array([0, len(names)]), 13)
        at = (s.low >= len(left)) & (s.high <= len(left) + 40)
        seen.append(list(zip(s.names[at], s.low[at] - len(left), strict=True)))
    assert len(seen[0]) > 3
    assert all(s == seen[0] for s in seen)


# --- op2 -------------------------------------------------------------------


def stats_plain(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_text_stats(spark, docs, empty):
    odd = [(900, "a # b\n\na # b\r\n|x|\na # b"), (901, "ü" * 5 + " ñ\n" * 9)]
    both = docs.union(frame(spark, odd))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter(map(tuple, quality_rules.text_stats(both).select(*names).collect()))
    assert got == Counter((i, *stats_plain(t)) for i, t in rows_of(both))
    assert quality_rules.text_stats(empty).collect() == []


def test_decision_list(spark, empty):
    clean = [(i, f"the quick brown fox {i} jumps over all lazy dogs near river {i}") for i in range(90)]
    bad = [(100 + i, " ".join(f"w{i}{j}###" for j in range(12))) for i in range(30)]
    docs = frame(spark, clean + bad)
    labels = spark.createDataFrame(
        [(i, int(i < 100), 0) for i, _ in clean + bad] + [(None, 1, 0), (5, None, 0), (999, 0, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    rules = quality_rules.learn_rules(docs, labels)
    assert rules
    kept = {r.doc_id for r in quality_rules.judge(docs, rules).where("kept").collect()}
    assert kept == set(range(90))
    stay = quality_rules.keep(docs, rules)
    assert stay.schema == docs.schema
    assert {r.doc_id for r in stay.collect()} == kept
    assert quality_rules.learn_rules(empty, labels) == []
    assert quality_rules.learn_rules(docs, labels.limit(0)) == []
    assert quality_rules.keep(empty, rules).collect() == []


# --- op3 -------------------------------------------------------------------


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components_plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        d = (1 << 62) if d is None else d
        least[find(i)] = min(least.get(find(i), d), d)
    given = lambda c: None if c == 1 << 62 else c
    return Counter((rows[i][0], len(sets[i]), given(least[find(i)])) for i in range(len(rows)))


def test_jaccard_components(docs, empty):
    got = Counter(map(tuple, jaccard_join.components_of(docs).collect()))
    assert got == components_plain(rows_of(docs))
    assert jaccard_join.components_of(empty).collect() == []


def test_chain_of_links(spark):
    """Documents that only link through others, and links just above the bound."""
    base = [f"t{i}" for i in range(104)]
    rows = []
    for step in range(12):
        w = list(base)
        for k in range(step):
            w[8 * k] = f"n{k}"
        rows.append((50 - step, " ".join(w)))
    rows += [(70 + i, " ".join([f"q{i}"] + base[1:])) for i in range(20)]
    docs = frame(spark, rows)
    got = Counter(map(tuple, jaccard_join.components_of(docs).collect()))
    assert got == components_plain(rows)


def test_keep_one(docs, empty):
    kept = jaccard_join.keep_one(docs)
    assert kept.schema == docs.schema
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    expected = Counter()
    for (i, n, c), times in components_plain(rows_of(docs)).items():
        texts = [t for d, t in rows_of(docs) if d == i]
        if n == 0 or i == c:
            expected.update((i, t) for t in (texts[:times] if n == 0 else texts[:1]))
    assert got == expected
    assert jaccard_join.keep_one(empty).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- op5 -------------------------------------------------------------------


URLS = [
    "https://a.Example.org/en/7?x#y", "http://example.org/es/1", "https://x.org", "https://x.org/",
    "http://b.com/de/9.html", "http://b.com/fr/9", "ftp://C.net/a//b://c", "no url", None, "", "://",
    "http://example.org/en/12", "http://notexample.org/es/", "https://d.net#f/g", "https://d.net?f=/g",
]


def test_rules(spark):
    pages = spark.createDataFrame(
        [(i, u, "z") for i, u in enumerate(URLS)] + [(None, "http://b.com/fr/", "z")],
        "page_id bigint, url string, text string",
    )
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.example.org", "/en/7", "org/")
    assert got[1] == ("example.org", "/es/1", "example.org/es/")
    assert got[2] == ("x.org", "", None)
    assert got[3] == ("x.org", "/", "org/")
    assert got[4] == ("b.com", "/de/9.html", "com/de/")
    assert got[6] == ("c.net", "/a//b://c", None)
    assert got[7] == got[8] == got[9] == got[10] == ("", "", None)
    assert got[11] == ("example.org", "/en/12", "example.org/en/1")
    assert got[12] == ("notexample.org", "/es/", "org/")
    assert got[13] == got[14] == ("d.net", "", None)
    assert got[None] == ("b.com", "/fr/", "com/fr/")
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_grams_of_very_long_urls(spark):
    k = url_filter.ORDER
    texts = ["", "a", "aé😀b/c", "x" * 9 + "é" * 9, "ab/é" * 250_000]
    frame_ = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = frame_.select("i", url_filter.grams(F.col("t")).alias("g")).cache()
    start = time.perf_counter()
    assert {r.i: r.n for r in out.select("i", F.size("g").alias("n")).collect()} == {
        i: len(t) + 1 for i, t in enumerate(texts)
    }
    assert time.perf_counter() - start < 20  # the square of a million takes hours
    for r in out.where("i < 4").collect():
        padded = url_filter.PAD * k + texts[r.i] + url_filter.END
        assert r.g == [padded[j - k : j + 1] for j in range(k, len(padded))]
    out.unpersist()


def test_repeated_urls_and_ties(spark):
    """Repeated rows are all judged, alike; without examples every score ties with 0."""
    urls = ["http://a.net/x", "http://a.net/x", None, None, "none", "http://b.net/" + "y" * 3000]
    pages = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = url_filter.judge(pages).collect()
    assert sorted(r.page_id for r in got) == [0, 0, 1, 1, 2, 2]
    assert {(r.verdict, r.score, r.rule) for r in got} == {("allow", 0.0, None)}


def test_markov_scores(spark):
    from zlib import crc32

    rng = random.Random(2)
    urls = [
        f"https://{rng.choice('abc')}.{rng.choice(['com', 'net', 'org', 'example.org'])}/"
        f"{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.randint(0, 99)}"
        for _ in range(150)
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = {r.page_id: r for r in url_filter.judge(pages).collect()}
    ruled = {r.page_id: r.ruled for r in url_filter.ruled(pages).collect()}
    k = url_filter.ORDER
    counts = {"allow": Counter(), "block": Counter()}
    padded = {i: url_filter.PAD * k + r.host + r.path + url_filter.END for i, r in out.items()}
    for i, side in ruled.items():
        if side and crc32(str(i).encode()) % 5:
            for j in range(k, len(padded[i])):
                for n in range(k + 1):
                    counts[side][padded[i][j - n : j + 1]] += 1

    def chance(side, gram):
        p = 1 / url_filter.ALPHABET
        for n in range(k + 1):
            tail = gram[k - n :]
            seen = [c for g, c in counts[side].items() if len(g) == n + 1 and g[:-1] == tail[:-1]]
            if seen:
                p = (counts[side][tail] + len(seen) * p) / (sum(seen) + len(seen))
        return p

    for i in range(0, 150, 30):
        text = padded[i]
        parts = [
            np.log(chance("allow", text[j - k : j + 1])) - np.log(chance("block", text[j - k : j + 1]))
            for j in range(k, len(text))
        ]
        assert out[i].score == pytest.approx(np.mean(parts), abs=1e-5)
    # Rejected and accepted directories are told apart where no rule fits.
    net = [r for r in out.values() if ruled[r.page_id] is None]
    mean = {d: np.mean([r.score for r in net if f"/{d}/" in r.path]) for d in ("fr", "de")}
    assert mean["fr"] > mean["de"]


def test_urls_are_not_broadcast(spark, monkeypatch):
    """Files say little about how large their rows are once exploded, so no plan may
    bring rows to the driver for a join, however small the files look."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    stored = url_filter.stored
    monkeypatch.setattr(url_filter, "stored", lambda df, name: stored(seen(df), name))
    urls = [(i, f"http://{'ab'[i % 2]}.com/{'fd'[i % 2]}{'re'[i % 2]}/{i}") for i in range(40)]
    pages = spark.createDataFrame([*urls, (40, None)], "page_id bigint, url string")
    assert seen(url_filter.judge(pages)).count() == 41
    assert sum("SortMergeJoin" in p for p in plans) >= 5
    assert [p for p in plans if "Broadcast" in p] == []


def test_scores_of_very_long_urls(spark):
    """The characters of a URL don't each carry the whole of it: 210,000 characters would
    be 44 GB. The same path again adds the same amount to the sum behind the score."""
    taught = [(i, f"http://x.com/{'fr' if i % 2 else 'de'}/{'ab' if i % 2 else 'cb/a'}") for i in range(60)]
    times = [1_000, 2_000, 70_000]
    long = [(100 + n, "http://y.net/" + "ab/" * n) for n in times]
    pages = spark.createDataFrame(taught + long, "page_id bigint, url string")
    start = time.perf_counter()
    got = {r.page_id - 100: r for r in url_filter.judge(pages).collect()}
    assert time.perf_counter() - start < 40
    assert len(got) == 63
    a, b, c = (round(got[n].score * 1e6 * (len(got[n].host + got[n].path) + 1)) for n in times)
    assert a != b and (c - b) * (2_000 - 1_000) == (b - a) * (70_000 - 2_000)


# --- op7 -------------------------------------------------------------------


def test_contained(spark, docs, texts, empty):
    rng = random.Random(9)
    long_docs = [t for _, t in texts if len(words(t)) > 60]
    items = []
    for i, text in enumerate(long_docs[:12]):
        w = words(text)[: 20 + 5 * i]
        for j in rng.sample(range(len(w)), i % 3):
            w[j] = "other"
        items.append((i, " ".join(w).upper() if i % 2 and w[0].isascii() else " ".join(w)))
    items += [(50, "a b c"), (51, ""), (52, None), (53, "never seen " * 9), (3, items[3][1]), (None, items[0][1])]
    frame_ = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string")

    def five(text):
        return {s for s in shingles(text) if len(s) == 5}

    expected = {}
    for d, t in rows_of(docs):
        have = five(t)
        for i, item in items:
            want = five(item)
            hit = len(want & have)
            if want and 100 * hit >= 80 * len(want):
                old = expected.get((d, i), (0, 1))
                if hit / len(want) > old[0] / old[1]:
                    expected[d, i] = (hit, len(want))
    got = {(r.doc_id, r.item_id): (r.n_found, r.n_shingles) for r in decontaminate.contained(docs, frame_).collect()}
    assert len(got) >= 5
    # Upper case is folded for A-Z only, in both.
    assert got == expected
    rest = decontaminate.drop_contained(docs, frame_)
    assert rest.schema == docs.schema
    leaked = {d for d, _ in expected}
    assert Counter(r.doc_id for r in rest.collect()) == Counter(
        d for d, _ in rows_of(docs) if d not in leaked
    )
    assert decontaminate.contained(empty, frame_).collect() == []
    assert decontaminate.contained(docs, frame_.limit(0)).collect() == []


# --- op8 -------------------------------------------------------------------


def test_removed_bytes(spark, docs, empty):
    rows = rows_of(docs)
    extra = [(500, "é" * 150), (501, "ab" * 500), (502, "x" + "ab" * 499), (503, "q" * 199), (504, "q" * 200)]
    rng = random.Random(1)
    noise = "".join(rng.choices("abcdefgh", k=3000))
    extra += [(510 + i, noise[i * 37 : i * 37 + 180 + 7 * i] + str(i)) for i in range(60)]
    docs = docs.union(frame(spark, extra))
    rows = rows_of(docs)
    seen = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for x in raw:
        seen.update(x[i : i + 200] for i in range(len(x) - 199))
    expected = Counter()
    for (i, _), x in zip(rows, raw, strict=True):
        gone = [False] * len(x)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        expected[i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(map(tuple, byte_dedup.removed_bytes(docs).collect()))
    assert got == expected
    assert byte_dedup.removed_bytes(empty).collect() == []


def test_only_texts_with_flags_have_their_windows_named(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=k)).encode() for k in (5000, 900, 0, 4000)]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    block = Block(0, 4, np.frombuffer(b"".join(texts), np.uint8), offsets)
    held = range_names(block.data, offsets[1:2] + 300, offsets[1:2] + 500, 4)
    part = pa.struct([("keys", pa.binary()), ("mask", pa.binary())])
    flags = pa.array(
        [None, [{"keys": held.tobytes(), "mask": None}], None, None], pa.list_(part)
    )
    verdict = pa.struct([("keys", pa.binary()), ("codes", pa.binary()), ("mask", pa.binary())])
    named = []

    def counted(data, starts, ends, seed=0):
        if seed == 4:
            named.append(len(starts))
        return range_names(data, starts, ends, seed)

    monkeypatch.setattr(byte_dedup, "range_names", counted)
    found = byte_dedup._repeated_windows(block, pa.nulls(4, pa.list_(verdict)), flags)
    assert named == [900 - 199]
    assert [x.tolist() for x in found] == [[5300], [5300]]


def test_cuts_are_the_same_in_any_stretch(monkeypatch):
    rng = random.Random(4)
    data = np.frombuffer("".join(rng.choices("ab cd", k=6000)).encode(), np.uint8)
    offsets = np.array([0, 0, 700, 730, 3000, 3000, 5990, 6000])
    whole = byte_dedup.cuts_of(data, offsets)
    assert len(whole) > 100
    for size in (1, 47, 100, 1000):
        monkeypatch.setattr(byte_dedup, "CACHED_BYTES", size)
        assert byte_dedup.cuts_of(data, offsets).tolist() == whole.tolist()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        alone = byte_dedup.cuts_of(data[a:b], np.array([0, b - a])) + a
        assert [x for x in whole if a < x < b] == [x for x in alone if x < b]


# --- op9 -------------------------------------------------------------------


def test_mix(spark, docs, empty):
    rng = random.Random(4)
    rows = [
        (i, " ".join(["w"] * rng.randint(0, 60)), "en", None if i % 11 == 0 else f"s{i % 7 if i % 3 else 0}", 0)
        for i in range(3000)
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size bigint")
    out = mixing.mix(table).collect()
    again = mixing.mix(table.repartition(7)).collect()
    assert Counter(out) == Counter(again)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    level = lambda x: sum(min(x * weights[s], 3 * sizes[s]) for s in sizes)
    low, high = 0.0, float(sum(sizes.values()))
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if level(mid) < sum(sizes.values()) else (low, mid)
    taken = Counter()
    source = {r[0]: r[3] for r in rows}
    for r in out:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert r.target == pytest.approx(min(low * weights[source[r.doc_id]], 3 * sizes[source[r.doc_id]]))
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        goal = min(low * weights[s], 3 * sizes[s])
        assert abs(taken[s] - goal) <= max(0.02 * goal, 120)
    assert mixing.mix(empty).collect() == []
    assert len(mixing.mix(docs).collect()) == docs.count()
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r.taken for r in mixing.mix(blank).collect()} == {0}


# --- op10 ------------------------------------------------------------------


def test_token_counts(docs, empty):
    import regex

    scores = token_counts.piece_scores(token_counts.read_vocabulary())
    longest = max(map(len, scores))

    def best(token):
        at = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            options = [
                (at[i][0] + scores[token[i:end]], -at[i][1] - 1)
                for i in range(max(0, end - longest), end)
                if token[i:end] in scores
            ]
            top = max(options)
            at.append((top[0], -top[1]))
        return at[-1][1]

    expected = Counter()
    known = {}
    for i, t in rows_of(docs):
        parts = regex.findall(token_counts.PRE_TOKEN, t or "")
        assert "".join(parts) == (t or "")
        for p in parts:
            known.setdefault(p, best(p.encode()))
        expected[i, len(parts), sum(known[p] for p in parts)] += 1
    assert Counter(map(tuple, token_counts.count_tokens(docs).collect())) == expected
    assert token_counts.count_tokens(empty).collect() == []


def test_missing_byte_is_refused():
    with pytest.raises(ValueError):
        token_counts.piece_scores({b"a": 0})
