"""Streams give what the batch operators give; running again adds nothing."""

from functools import reduce

from pyspark.sql import functions as F

from gradus.functions import outline
from gradus.functions.rewards import ACTIVE
from gradus.operators.collect import (
    collect_increment,
    collect_into,
    collect_outcomes,
    stored_failures,
    stored_records,
)
from gradus.operators.scoring import score, total_reward
from gradus.plans import derived as D
from gradus.plans.queries import QUERIES
from gradus.sources.live import FAN, LiveFolders
from gradus.sources.pages import append_pages, read_pages_of, read_store
from gradus.sources.schemas import COMPLETION, KEYED_PROBLEM, TASK_PAGE
from gradus.streaming.collect import PageStores, collect_stream, read_collected, read_failed
from gradus.streaming.score import score_stream


def as_set(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_score_stream(spark, sf_dir, tmp_path):
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    columns = [f.name for f in COMPLETION.fields]
    batch = D.completions(spark, sf_dir).withColumn("gen_id", F.col("gen_id").cast("int")).select(*columns)
    batch.where("prompt_id % 4 = 0").write.parquet(source)

    def run():
        stream = spark.readStream.schema(COMPLETION).parquet(source)
        score_stream(stream, target, offsets).awaitTermination()
        return spark.read.parquet(target)

    first = run().count()
    assert first == batch.where("prompt_id % 4 = 0").count()
    assert run().count() == first
    batch.where("prompt_id % 4 <> 0").write.mode("append").parquet(source)
    expected = total_reward(score(batch)).select("prompt_id", "gen_id", *ACTIVE, "total")
    assert as_set(run()) == as_set(expected)


def tables(spark, sf_dir):
    return D.list_pages(spark, sf_dir), D.submission_pages(spark, sf_dir)


def test_collect_stream(spark, sf_dir, tmp_path):
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    pages = D.problem_pages(spark, sf_dir).select(*TASK_PAGE.fieldNames())
    early = F.crc32("task_id") % 2 == 0
    pages.where(early).write.parquet(source)

    def run(checkpoint=offsets):
        stream = spark.readStream.schema(TASK_PAGE).parquet(source)
        collect_stream(
            stream, lambda s: tables(s, sf_dir), target, checkpoint
        ).awaitTermination()
        return read_collected(spark, target)

    nothing = spark.createDataFrame([], KEYED_PROBLEM)
    first = as_set(run())
    assert first == as_set(
        collect_increment(pages.where(early), *tables(spark, sf_dir), nothing)
    )
    # The other half arrives, together with copies of pages seen before.
    pages.write.mode("append").parquet(source)
    whole = as_set(collect_increment(pages, *tables(spark, sf_dir), nothing))
    assert as_set(run()) == whole
    assert as_set(run()) == whole
    # A stream that starts over sees every page again and adds no record.
    assert as_set(run(str(tmp_path / "fresh"))) == whole
    failed = collect_outcomes(pages, *tables(spark, sf_dir), nothing).where("error IS NOT NULL")
    assert set(as_set(read_failed(spark, target))) == set(
        as_set(failed.select("contest_id", "task_id", "error"))
    )


def test_a_repeated_batch_replaces_itself(spark, sf_dir, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    pages = D.problem_pages(spark, sf_dir).select(*TASK_PAGE.fieldNames())
    pages.where("contest_id < 'abc2'").write.parquet(source)

    def run(offsets):
        stream = spark.readStream.schema(TASK_PAGE).parquet(source)
        collect_stream(
            stream, lambda s: tables(s, sf_dir), target, str(tmp_path / offsets)
        ).awaitTermination()
        return as_set(read_collected(spark, target))

    # New offsets number their first batch 0 again, as a batch does that failed
    # after writing and before its commit.
    assert run("a") == run("b") != []


def test_collect_into_a_stored_dataset(spark, sf_dir, tmp_path):
    target = str(tmp_path / "dataset")
    pages = D.problem_pages(spark, sf_dir)
    assert stored_records(spark, target).count() == 0
    collect_into(target, pages.where("doc_id % 2 = 0"), *tables(spark, sf_dir))
    half = stored_records(spark, target).count()
    collect_into(target, pages, *tables(spark, sf_dir))
    nothing = spark.createDataFrame([], KEYED_PROBLEM)
    whole = as_set(collect_increment(pages, *tables(spark, sf_dir), nothing))
    assert 0 < half < len(whole)
    assert as_set(stored_records(spark, target)) == whole
    collect_into(target, pages, *tables(spark, sf_dir))
    assert stored_records(spark, target).count() == len(whole)
    assert stored_failures(spark, target).count() > 0


def test_collect_skips_known_and_copied_tasks(spark, sf_dir):
    pages = D.problem_pages(spark, sf_dir)
    known = D.existing_tasks(spark, sf_dir)
    once = as_set(collect_increment(pages, *tables(spark, sf_dir), known))
    lists, codes = tables(spark, sf_dir)
    copied = collect_increment(
        pages.unionByName(pages), lists.unionByName(lists), codes.unionByName(codes), known
    )
    assert as_set(copied) == once
    tasks = {(r.contest_id, r.task_id) for r in known.collect()}
    assert not tasks & {tuple(row[:2]) for row in once}


def test_a_batch_reads_the_files_of_its_contests(spark, sf_dir, tmp_path):
    lists, codes = tables(spark, sf_dir)
    stores = PageStores(str(tmp_path / "lists"), str(tmp_path / "codes"))
    append_pages(lists, stores.lists, file_bytes=4_000)
    append_pages(codes, stores.submissions, file_bytes=20_000)
    pages = D.problem_pages(spark, sf_dir).select(*TASK_PAGE.fieldNames())
    few = pages.where("contest_id IN ('abc1', 'abc2')")
    every = read_store(spark, stores.lists, TASK_PAGE)
    assert every.count() == lists.count() and len(every.inputFiles()) > 8
    read = read_pages_of(spark, stores.lists, few, TASK_PAGE)
    # A file holds a range of contests: each contest is in one or two.
    assert 0 < len(read.inputFiles()) <= 4
    own = "contest_id IN ('abc1', 'abc2')"
    assert as_set(read.where(own)) == as_set(every.where(own))
    assert read_pages_of(spark, stores.lists, few.limit(0), TASK_PAGE).count() == 0
    assert read_pages_of(spark, str(tmp_path / "none"), few, TASK_PAGE).count() == 0
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    pages.write.parquet(source)
    collect_stream(
        spark.readStream.schema(TASK_PAGE).parquet(source), stores, target, str(tmp_path / "o")
    ).awaitTermination()
    nothing = spark.createDataFrame([], KEYED_PROBLEM)
    assert as_set(read_collected(spark, target)) == as_set(
        collect_increment(pages, *tables(spark, sf_dir), nothing)
    )


def test_page_store_of_many_commits(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in range(20):
        rows = [(f"abc{j}", f"abc{j}_a", f"page {i}") for j in range(i, i + 5)]
        append_pages(spark.createDataFrame(rows, TASK_PAGE), path)
    assert read_store(spark, path, TASK_PAGE).count() == 100
    entries = LiveFolders(spark, path).entries()
    assert len(entries) <= 2 * FAN and max(e.level for e in entries) == 1
    one = spark.createDataFrame([("abc3", "abc3_a")], "contest_id string, task_id string")
    found = read_pages_of(spark, path, one, TASK_PAGE).where("contest_id = 'abc3'")
    assert sorted(r.html for r in found.collect()) == [f"page {i}" for i in range(4)]


def test_live_folders(spark, tmp_path):
    """Versions, replaced commits, merging in tiers, and what a lost writer leaves."""
    path = tmp_path / "set"
    live = LiveFolders(spark, str(path))
    assert live.entries() == [] and live.next_commit() == 0

    def put(commit, value):
        folder = live.fresh()
        df = spark.createDataFrame([(commit, value)], "commit long, value long").coalesce(1)
        df.write.parquet(f"{path}/{folder}")
        live.add(folder, commit)

    def rows():
        out = []
        for e in live.entries():
            got = spark.read.parquet(f"{path}/{e.folder}").collect()
            out += [tuple(r) for r in got if r.commit not in e.without]
        return sorted(out)

    def rewrite(entries, into):
        parts = [
            spark.read.parquet(f"{path}/{e.folder}").where(~F.col("commit").isin(e.without or [-1]))
            for e in entries
        ]
        reduce(lambda a, b: a.union(b), parts).coalesce(1).write.parquet(f"{path}/{into}")

    for i in range(50):
        put(i, i)
        while live.merge(rewrite):
            pass
    assert rows() == [(i, i) for i in range(50)]
    assert len(live.entries()) <= 2 * FAN
    folders = [p for p in path.iterdir() if p.name.startswith("part-")]
    assert len(folders) <= 3 * FAN and len(list((path / "_live").glob("0*"))) <= 3
    # Any commit again takes the place of its rows, also of merged ones.
    for i in (3, 49, 3):
        put(i, 100 + i)
        while live.merge(rewrite):
            pass
    expected = sorted([(i, i) for i in range(50) if i not in (3, 49)] + [(3, 103), (49, 149)])
    assert rows() == expected
    # A version that was not written to its end does not count, and is never reused.
    last = max(int(p.name) for p in (path / "_live").glob("0*"))
    (path / "_live" / f"{last + 1:012d}").write_text('[{"folder": "par')
    assert rows() == expected
    put(60, 60)
    assert rows() == sorted([*expected, (60, 60)])


def test_many_batches_leave_few_files(spark, sf_dir, tmp_path):
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    pages = D.problem_pages(spark, sf_dir).select(*TASK_PAGE.fieldNames()).where("contest_id < 'abc2'")
    pages.repartition(18).write.parquet(source)
    lookups = [t.cache() for t in tables(spark, sf_dir)]
    stream = spark.readStream.schema(TASK_PAGE).option("maxFilesPerTrigger", 1).parquet(source)
    collect_stream(stream, lambda s: tuple(lookups), target, offsets).awaitTermination()
    entries = LiveFolders(spark, target).entries()
    assert len({c for e in entries for c in e.commits}) > FAN > len(entries)
    nothing = spark.createDataFrame([], KEYED_PROBLEM)
    assert as_set(read_collected(spark, target)) == as_set(
        collect_increment(pages, *lookups, nothing)
    )


def test_stream_queries_read_tables_of_many_files(spark, tmp_path):
    """A table is one file, or a folder of files that bears its name."""
    texts = ["a", "<answer>\n7\n</answer>\n", "one < two & three\n", None] * 12
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns).coalesce(1)
    folder, one = tmp_path / "folder", tmp_path / "one"
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "part"))
    (written,) = (tmp_path / "part").glob("part-*.parquet")
    one.mkdir()
    (one / "documents.parquet").write_bytes(written.read_bytes())
    for name in ("scored_stream", "collected_stream"):
        found = as_set(QUERIES[name](spark, str(folder)))
        assert found and found == as_set(QUERIES[name](spark, str(one)))
        if name == "scored_stream":
            assert len(found) == len(rows)


def test_collecting_by_slices_of_pages_gives_the_same(spark, monkeypatch):
    """Slices that hold one page, several, or all of a task's."""
    body = (
        '<span class="h2">A - T</span><div id="task-statement"><span class="lang-en">'
        '<div class="part"><section><h3>Problem Statement</h3><p>%s</p></section></div>'
        "</span></div>"
    )
    row = '<table><tr><td><a href="/s/%d">x</a></td></tr></table>'
    code = '<pre id="submission-code">int x%d;</pre>'
    keys = "contest_id string, task_id string, html string"
    tasks = [(f"abc{i}", f"abc{i}_a") for i in range(40)]
    pages = [(*t, body % ("text " * i)) for i, t in enumerate(tasks)]
    lists = [(*t, row % i) for i, t in enumerate(tasks)]
    codes = [(c, str(i), code % i) for i, (c, _) in enumerate(tasks)]
    frames = [spark.createDataFrame(x, keys).coalesce(1) for x in (pages, lists)]
    frames.append(spark.createDataFrame(codes, "contest_id string, submission_id string, html string"))
    nothing = spark.createDataFrame([], KEYED_PROBLEM)
    found = []
    for size in (1, 900, 1 << 20):
        monkeypatch.setattr(outline, "SLICE_BYTES", size)
        found.append(as_set(collect_increment(*frames, nothing)))
    assert len(found[0]) == len(tasks) and found[0] == found[1] == found[2]
