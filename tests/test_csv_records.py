import random

import pyarrow as pa
import pytest

from mendlist.sources import csv_records as C
from mendlist.sources import readers


def _cell(deal):
    kind = deal.random()
    if kind < 0.3:
        return "".join(deal.choices("abc d", k=deal.randint(0, 9))).strip()
    if kind < 0.45:
        return deal.choice(["", 'x"y', '"q" tail', "'"])
    return '"' + "".join(deal.choices(["a", "b", "\n", '""', ",", " ", "\r\n", "é"], k=deal.randint(0, 25))) + '"'


def _write(path, deal, n, end):
    rows = [",".join([f"k{i}", _cell(deal), _cell(deal)]) + (deal.random() < 0.05) * end for i in range(n)]
    path.write_text(f'a,"path, start","c{end}d"' + end + end.join(rows) + deal.choice(["", end]), encoding="utf-8", newline="")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_cut_anywhere(spark, tmp_path, end):
    """Blocks of a few bytes: cells go on over several of them. Rows are those of Spark's reader of whole files."""
    deal = random.Random(len(end))
    for i in range(2):
        _write(tmp_path / f"f{i}.csv", deal, 40, end)
    expected = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"').na.fill("")
    expected_rows = sorted(tuple(r) for r in expected.collect())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for size in ("128m", "400", "90"):
        spark.conf.set(names[0], size), spark.conf.set(names[1], "1")
        try:
            got = readers.read_csv(spark, str(tmp_path))
        finally:
            for n, v in zip(names, before):
                spark.conf.set(n, v)
        rows = got.collect()
        assert got.columns == [*expected.columns, "_file", "_row"]
        assert sorted(tuple(r)[:-2] for r in rows) == expected_rows
        # the order of the rows is that of the files
        rows.sort(key=lambda r: (r._file.path, r._file.start, r._row))
        for path in {r._file.path for r in rows}:
            keys = [int(r.a[1:]) for r in rows if r._file.path == path]
            assert keys == sorted(keys) and len(keys) == 40
        assert size == "128m" or len({(r._file.path, r._file.start) for r in rows}) > 4


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    lines = "".join(f'{i},"text {i}\nof two lines, and more"\n' for i in range(20_000))
    (tmp_path / "big.csv").write_text("n,text\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        got = readers.read_csv(spark, str(tmp_path / "big.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got.select("_file").distinct().count() > 5
    assert got.where("text = concat('text ', n, '\nof two lines, and more')").count() == 20_000


@pytest.mark.parametrize(
    "line, outside, inside",
    [
        ("a,b", False, True), ('a,"b', True, False), ('b",c', False, False), ('b","c', True, True), ('""', False, True),
        ('"a""', True, False), ('x"y', False, False), ('"a"b,"c', True, True), (' "a', False, False), ('a","b"', False, False), ("", False, True),
    ],
)
def test_what_a_line_does(line, outside, inside):
    assert (C.ends_inside(line, False), C.ends_inside(line, True)) == (outside, inside)


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "header.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path / "header.csv")).count() == 0
    (tmp_path / "short.csv").write_text('a,b\n1\n2,3,4\n\n"open, to the end\nof file')
    got = {(r.a, r.b) for r in readers.read_csv(spark, str(tmp_path / "short.csv")).collect()}
    assert got == {(r.a, r.b) for r in spark.read.csv(str(tmp_path / "short.csv"), header=True, multiLine=True, escape='"').na.fill("").collect()}


def test_a_changed_split_is_an_error():
    files = {"f": ([0, 100], [False, True], False)}
    assert C._beginning(files, ("f", 100)) == (True, False)
    for block in (("f", 50), ("g", 0)):
        with pytest.raises(RuntimeError, match="first pass"):
            C._beginning(files, block)


def test_lines_of_whole_cells_are_told_by_column():
    """What is found for whole columns of lines is what a look at each line finds."""
    deal = random.Random(3)
    lines = ["".join(deal.choices('",ab \ré', k=deal.randint(0, 9))) for _ in range(3000)]
    for at in range(0, 3000, 20):
        for inside in (False, True):
            state, expected = inside, []
            for i, line in enumerate(lines[at : at + 20]):
                after = C.ends_inside(line, state)
                if after != state:
                    expected.append((i, after))
                state = after
            found = C._Lines(pa.array(lines[at : at + 20], pa.string()))
            assert list(found.turns(inside)) == expected and found.end(inside) == state


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_plain_blocks_are_read_as_they_are(spark, tmp_path, monkeypatch, end):
    """Lines of blocks without quoted line breaks are not joined in Python; rows are numbered through all files."""
    joined = tmp_path / "joined"
    whole = C._joiner

    def noted(beginnings):
        records = whole(beginnings)

        def note(batches):
            for r in records(batches):
                with open(joined, "a") as f:
                    f.write("".join(f"{p}\n" for p in r.column(0).to_pylist()))
                yield r

        return note

    monkeypatch.setattr(C, "_joiner", noted)
    folder = tmp_path / "in"
    folder.mkdir()
    plain = [f'{i},"say ""{i}"", then"' for i in range(3000)]
    (folder / "a.csv").write_text(end.join(["k,t", *plain, ""]), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        one = readers.read_csv(spark, str(folder)).collect()
        assert not joined.exists()
        (folder / "b.csv").write_text(end.join(["k,t", *[f'b{i},"two{end}lines"' for i in range(50)], ""]), newline="")
        both = readers.read_csv(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(one) == 3000 and len({r._file.start for r in one}) > 3
    assert [r.t for r in sorted(one, key=lambda r: r._row)] == [f'say "{i}", then' for i in range(3000)]
    assert [r.k for r in sorted(both, key=lambda r: r._row)] == [*map(str, range(3000)), *[f"b{i}" for i in range(50)]]
    assert {r.t for r in both if r.k[0] == "b"} == {"two\nlines"}
    # of the second file only; a.csv is the first file
    assert set(joined.read_text().split()) == {"1"}


def test_plain_blocks_must_be_those_of_the_first_pass(spark):
    schema = "path string, start long, number long, value string, file int, plain boolean, returns boolean, first long, n long, before long"
    good = ("f", 0, 7, "a,b\r", 0, True, True, 5, 4, 100)
    got = C._whole_lines(spark.createDataFrame([good], schema)).first()
    assert (got.line, got.record, got.before) == (2, "a,b", 100)
    for bad in (("f", 9, 7, "a", None, None, None, None, None, None), ("f", 0, 9, "a", 0, True, False, 5, 4, 0)):
        with pytest.raises(Exception, match="first pass"):
            C._whole_lines(spark.createDataFrame([bad], schema)).collect()
