"""Contact files: order over files and splits, quotes, exports and committed outputs."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.sources import io


def machine(line):
    """Cells of a line, character by character."""
    cells, quoted, i = [""], False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                cells[-1] += '"'
                i += 1
            else:
                quoted = not quoted
        elif c == ";" and not quoted:
            cells.append("")
        else:
            cells[-1] += c
        i += 1
    return cells


def test_cells(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choice('a;"" é') for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", '"', '""', '"""', '""""', '";"', ";", ";;", '"' * 20_001, "x;" * 5000]
    found = spark.createDataFrame(list(enumerate(lines)), "i long, line string").select("i", io.split_cells(F.col("line")).alias("c")).collect()
    assert [r.c for r in sorted(found)] == [machine(x) for x in lines]
    assert all(io.split_header(x) == [c.strip() for c in machine(x.strip())] for x in lines)


@pytest.mark.parametrize("size", ["60", "1000", "100m"])
def test_order_over_files_and_splits(spark, tmp_path, size):
    """Lists of files of unlike size, folders and files of several splits keep list and line order."""
    rng = random.Random(3)
    want = []
    for name, n in (("z.csv", 1), ("dir é/2.csv", 150), ("dir é/1.csv", 40), ("a b%20.csv", 300)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        rows = [f"{name} {i} " + "x" * rng.randrange(1, 30) for i in range(n)]
        (tmp_path / name).write_bytes(("﻿Nome;Email\r\n" + "".join(f"{r};e\r\n" + "\r\n" * rng.randrange(3) for r in rows)).encode())
        want.append((name, rows))
    by = dict(want)
    want = by["z.csv"] + by["dir é/1.csv"] + by["dir é/2.csv"] + by["a b%20.csv"]
    (tmp_path / "empty.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = io.read_leads_csv(spark, [str(tmp_path / p) for p in ("z.csv", "none.csv", "dir é", "empty.csv", "a b%20.csv")])
        assert size == "100m" or df.rdd.getNumPartitions() > 8
        found = df.select("name", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.name for r in sorted(found, key=lambda r: r.seq)] == want and len({r.seq for r in found}) == len(want)


def test_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Nome;"E;x";Nome\nA;1;B\nNome;"E;x";Nome\n')
    (tmp_path / "b.csv").write_text("\n \n Telefone ; Nome\n 9 ; C ; more\nD\n")
    rows = io.read_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]).orderBy("_row").collect()
    assert [(r.Nome, r["E;x"], r.Telefone) for r in rows] == [("C", None, "9"), ("", None, "D"), ("B", "1", None), ("Nome", "E;x", None)]
    assert io.read_leads_csv(spark, str(tmp_path / "none")).count() == 0


def test_exports(spark, tmp_path):
    cells = ["#c", "  x ", 'a"b', "c;d", "", "two\nlines", "é", None]
    df = spark.createDataFrame([(7 - i, c) for i, c in enumerate(cells)], "seq long, Nome string").repartition(3)
    lines = ["", "é", '"two\nlines"', "", '"c;d"', '"a""b"', "  x ", "#c"]
    want = "﻿Nome;Extra\r\n" + "".join(f"{x};\r\n" for x in lines)
    io.write_leads_csv(df, str(tmp_path / "one"), columns="Nome;Extra", single_file=True)
    files = [f for f in (tmp_path / "one").iterdir() if f.name.startswith("part-")]
    assert [f.read_bytes().decode() for f in files] == [want]
    io.write_leads_csv(df, str(tmp_path / "many"), columns="Nome;Extra", bom=False)
    parts = [f.read_bytes().decode() for f in sorted((tmp_path / "many").glob("part-*")) if f.stat().st_size]
    assert all(p.startswith("Nome;Extra\r\n") for p in parts)
    assert "".join(p.removeprefix("Nome;Extra\r\n") for p in parts) == want.split("\r\n", 1)[1]
    for single in (True, False):
        io.write_leads_csv(df.limit(0), str(tmp_path / f"none{single}"), columns="Nome", single_file=single)
        assert "".join(f.read_text(encoding="utf-8-sig") for f in (tmp_path / f"none{single}").glob("part-*")).strip() == "Nome"


def test_committed_outputs(spark, tmp_path):
    path = str(tmp_path / "out")
    assert io.latest_result(spark, path, "r") is None
    for version in (2, 10, 9):
        io.write_result(spark.range(version), path, "r/1 é", version)
    spark.range(99).write.parquet(f"{path}/run=r%2F1%20%C3%A9/version=77")  # a job that broke before its entry
    found = io.latest_result(spark, path, "r/1 é")
    assert {(r.run_id, r.version) for r in found.collect()} == {("r/1 é", 10)} and found.count() == 10
    assert all("version=10" in f for f in found.inputFiles()) and io.latest_result(spark, path, "r") is None
