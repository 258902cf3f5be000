"""What a task holds at a time, and how tables of text lie on disk."""

import glob
import tempfile

import pyarrow as pa

from sheetwise.llm import hashing, jaccard_join, repeats


def test_sets_are_made_of_some_texts_at_a_time():
    texts = [" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(600)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["oid", "text"])
    slices = list(hashing.parts(batch))
    assert len(slices) > 3 and all(part["text"].nbytes < 3 * hashing.CHUNK for part in slices[:-1])
    assert pa.Table.from_batches(slices)["oid"].to_pylist() == list(range(len(texts)))
    out = list(jaccard_join._set_rows(iter([batch]), 5))
    assert len(out) == len(slices)
    whole = pa.Table.from_batches(out)
    assert whole["oid"].to_pylist() == list(range(len(texts))) and whole["key"].to_pylist()[-2:] == [None, None]
    own = next(jaccard_join._sets([texts[17]], 5))
    assert whole["key"][17].as_py() == jaccard_join.set_key(own) and whole["set"][17].as_py() == own.astype("<u8").tobytes()


def test_tables_of_text_are_packed(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="packed-", dir="/tmp")
    monkeypatch.setattr("sheetwise.session.shared_folder", lambda _: folder)
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"one {passage} end"), (2, f"two {passage} stop"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(docs).collect()}
    assert got == {1: 0, 2: 60, 3: 0}
    for label in ("stretches", "heads"):
        assert glob.glob(f"{folder}/{label}-*/*.zstd.parquet")


def test_near_duplicates_leave_no_table_of_sets(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="sets-", dir="/tmp")
    monkeypatch.setattr("sheetwise.session.shared_folder", lambda _: folder)
    words = [f"word{i}" for i in range(80)]
    docs = [(i, " ".join([*words, f"tail{i}"])) for i in range(1, 5)] + [(9, "another text of some seven words"), (None, None)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 9, None]
    assert glob.glob(f"{folder}/numbered-*/*.zstd.parquet")
    tables = [spark.read.parquet(path) for path in glob.glob(f"{folder}/*-*")]
    assert tables and not any("set" in table.columns for table in tables)


def test_sets_without_a_candidate_are_not_dealt_out(spark, monkeypatch):
    docs = [(i, " ".join(f"a{i}b{j}" for j in range(40))) for i in range(400)]
    docs += [(1000 + i, " ".join([*(f"word{j}" for j in range(80)), f"tail{i}"])) for i in range(5)] + [(None, "seven words that stand here all alone"), (None, None)]
    passed = spark.sparkContext.accumulator(0)
    passing = jaccard_join._passing

    def counted(batches, wanted):
        for batch in passing(batches, wanted):
            passed.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(jaccard_join, "_passing", counted)
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.n_links for r in got) == [0] * 402 + [4] * 5
    assert 5 <= passed.value < 20  # 406 before
