"""A sealed bundle and each kind of tampering with it."""

import glob
import os
import shutil

import pytest

from sparkloom.sources import verification


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bundle") / "b")
    a = spark.createDataFrame([(i, f"name {i % 7}", None if i % 5 == 0 else i / 4) for i in range(400)], "k int, name string, x double").repartition(4)
    b = spark.createDataFrame([(i, "z") for i in range(30)], "id long, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    verification.sealed(spark, {"a": (a, ["k"]), "b": (b, ["id"])}, path, "csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return path


def copy(bundle, tmp_path):
    path = str(tmp_path / "copy")
    shutil.copytree(bundle, path, ignore=shutil.ignore_patterns(".*.crc", "_SUCCESS"))
    return path, sorted(glob.glob(f"{path}/a/part-*"))


def found(spark, path):
    return sorted(tuple(r) for r in verification.problems(spark, path).collect())


def place(file):
    return os.path.basename(file)[:10]


def test_nothing_is_wrong(spark, bundle, tmp_path):
    path, files = copy(bundle, tmp_path)
    assert len(files) > 2 and found(spark, path) == []


def test_a_missing_and_an_extra_file(spark, bundle, tmp_path):
    path, files = copy(bundle, tmp_path)
    os.rename(files[1], f"{path}/a/part-00777-x.csv")
    assert {x[1:3] for x in found(spark, path)} == {("part-00777", "swapped"), (place(files[1]), "missing")}
    open(f"{path}/a/part-00777-x.csv", "ab").write(b"1,a,2\n")
    assert {x[1:3] for x in found(spark, path)} == {("part-00777", "extra"), (place(files[1]), "missing")}


def test_a_whole_table_is_missing(spark, bundle, tmp_path):
    path, _ = copy(bundle, tmp_path)
    shutil.move(f"{path}/b", str(tmp_path / "away"))
    assert {(t, p) for t, _, p, _ in found(spark, path)} == {("b", "missing")}


def test_swapped_files(spark, bundle, tmp_path):
    path, files = copy(bundle, tmp_path)
    a, b = (open(f, "rb").read() for f in files[:2])
    for f, data in zip(files[:2], (b, a)):
        open(f, "wb").write(data)
    got = [x for x in found(spark, path) if x[2] == "swapped"]
    assert got == [("a", place(files[0]), "swapped", f"a/{place(files[1])}"), ("a", place(files[1]), "swapped", f"a/{place(files[0])}")]


def test_a_truncated_file_tells_how_much_is_left(spark, bundle, tmp_path):
    path, files = copy(bundle, tmp_path)
    data = open(files[0], "rb").read()
    cut = data[: data[: len(data) // 2].rindex(b"\n") + 1]
    open(files[0], "wb").write(cut)
    got = found(spark, path)
    assert ("a", place(files[0]), "truncated", f"{len(cut)} of {len(data)} bytes") in got
    assert [x[3] for x in got if x[2] == "rows"] == [f"{cut.count(b'\n') - 1} of {data.count(b'\n') - 1}"]


def test_an_altered_value_names_its_column_and_range(spark, bundle, tmp_path):
    path, files = copy(bundle, tmp_path)
    data = open(files[2], "rb").read()
    assert b"name 3" in data
    open(files[2], "wb").write(data.replace(b"name 3", b"name 9", 1))
    got = found(spark, path)
    assert [x[1:3] for x in got] == [(place(files[2]), "altered"), (place(files[2]), "column")]
    assert got[1][3].startswith('name between {"k":')


def test_parquet_too(spark, tmp_path):
    path = str(tmp_path / "p")
    verification.sealed(spark, {"t": (spark.createDataFrame([(i, [i], "q") for i in range(50)], "k int, l array<int>, s string"), ["k"])}, path)
    assert found(spark, path) == []
    file = sorted(glob.glob(f"{path}/t/part-*"))[0]
    data = open(file, "rb").read()
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    open(file, "wb").write(data[: len(data) // 2])
    assert ("t", place(file), "truncated", f"{len(data) // 2} of {len(data)} bytes") in found(spark, path)
