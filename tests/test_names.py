import random
import re

import pytest
from pyspark.sql import functions as F

from sheetwise.functions import formats, names
from sheetwise.operators.matching import assign_unique_names, rename_plan


def values(spark, fn, data, schema="n string"):
    frame = spark.createDataFrame([(v,) for v in data], schema)
    return [r[0] for r in frame.select(fn(F.col("n"))).collect()]


def test_server_names(spark):
    cut = "x" * 179 + " tail"
    got = values(spark, lambda c: names.sanitize_server(c, F.lit(77)), ["a..b/c?.txt", "   a. . ", "..", "", ".", cut, "tab\there", None])
    assert got == ["a_b_c_.txt", "a", "_", "upload-77", "upload-77", "x" * 179 + " ", "tab_here", "upload-77"]


def test_a_cut_that_bares_a_space_is_not_landable(spark):
    assert values(spark, names.is_landable, ["x" * 179 + " ", "ok.txt", " (1).bashrc"]) == [False, True, False]


def test_desktop_names(spark):
    got = values(spark, names.sanitize_desktop, [" con.txt", "LPT9", "console.txt", ".incoming-a", "a. ", " . ", "nul.tar.gz"])
    assert got == ["_con.txt", "_LPT9", "console.txt", "_.incoming-a", "a", "", "nul.tar.gz"]


def test_parts_of_a_name(spark):
    assert values(spark, names.extension, ["a.b.txt", ".bashrc", "abc.", "abc"]) == [".txt", ".bashrc", "", ""]
    assert values(spark, names.stem, ["a.b.txt", ".bashrc", "abc.", "abc"]) == ["a.b", "", "abc.", "abc"]
    assert values(spark, names.extension_badge, ["a.jpeg", "a.x", "abc.", "photo.numbers"]) == ["JPEG", "X", "FILE", "NUMB"]
    assert values(spark, names.decode_name, ["a%20b+c", "100%", "%C3%A9", None]) == ["a b+c", "100%", "é", ""]
    assert values(spark, names.is_risky, ["a.EXE", "a.exe.txt", "exe"]) == [True, False, False]


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1536, 1048575, 1024**2, 1024**3 * 5, 1024**4 * 2000]
    server = values(spark, lambda c: formats.format_bytes(c), sizes, "n bigint")
    assert server == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "5.0 GB", "2000.0 TB"]
    desktop = values(spark, lambda c: formats.format_bytes(c, "desktop"), sizes, "n bigint")
    assert desktop[3] == "2 KB" and desktop[-1] == "2,048,000.0 GB"
    with pytest.raises(ValueError):
        formats.format_bytes(F.lit(1), "other")


def sequential(wanted, taken):
    """What one writer after the other would get."""
    used, out = set(taken), []
    for n in wanted:
        ext = re.search(r"\.[^.]+$", n)
        ext = ext.group(0) if ext else ""
        stem, i, name = n[: len(n) - len(ext)], 0, n
        while name in used:
            i += 1
            name = f"{stem} ({i}){ext}"
        used.add(name)
        out.append(name)
    return out


def given(spark, wanted, taken, hot=None):
    batch = spark.createDataFrame(list(enumerate(wanted)), "i long, name string")
    known = spark.createDataFrame([(t,) for t in taken], "name string")
    rows = assign_unique_names(batch, known, "i", **({} if hot is None else {"hot_rows": hot})).orderBy("i").collect()
    return [r.final_name for r in rows]


def test_same_name_eight_times(spark):
    assert given(spark, ["notes.txt"] * 8, []) == sequential(["notes.txt"] * 8, [])


@pytest.mark.parametrize("seed", range(3))
def test_nested_names_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    pool = ["a.txt", "a (1).txt", "a (2).txt", "a (1) (1).txt", "b", "b (1)", ".bashrc", "a (0).txt", "a (01).txt"]
    wanted = [rng.choice(pool) for _ in range(25)]
    taken = [n for n in pool if rng.random() < 0.2] + ["a (4).txt"]
    assert given(spark, wanted, taken, hot=8) == sequential(wanted, taken)


def test_rename_plan(spark):
    rows = [(0, "a.txt", " "), (1, "a.txt", "a"), (2, "a.txt", "A"), (3, "a.txt", "b.txt"), (4, "c.txt", "d.png")]
    renames = spark.createDataFrame(rows, "order int, old string, typed string")
    existing = spark.createDataFrame([("a.txt",), ("b.txt",), ("c.txt",)], "name string")
    got = {r.order: (r.action, r.final_name) for r in rename_plan(renames, existing).collect()}
    assert got == {0: ("reject", None), 1: ("keep", "a.txt"), 2: ("recase", "A.txt"), 3: ("move", "b (1).txt"), 4: ("move", "d.png")}
