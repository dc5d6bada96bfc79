import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mendlist.operators import ingest as I
from mendlist.operators.common import nest
from mendlist.plans.ingest import Tables, csv_tables, ingest_csv
from mendlist.sources import readers, writers
from mendlist.storage import fresh_path, shared_folder

CSV = '''domain,app,sentence,category,term,sentiment,rating,review_id,from,to
games,Zap,"It crashes, daily",reliability,it,negative,1,r1,0,2
games,Zap,"It crashes, daily",usability,,N/A,1,r1,N/A,NA
games,Zap,"Two
lines",general,"say ""hi""",positive,bad,N/A,1,x
social,Chat,Nice,aesthetics,look,positive,5,,,
games,Zap,"It crashes, daily",cost,price,negative,4,r9,3,4
'''


@pytest.fixture()
def csv_path(tmp_path):
    path = tmp_path / "annotated.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_csv_to_tables(spark, csv_path):
    reviews, notes = csv_tables(readers.read_annotated_csv(spark, csv_path))
    got = {r.review_text: r for r in reviews.collect()}
    assert set(got) == {"It crashes, daily", "Two\nlines", "Nice"}
    crash = got["It crashes, daily"]
    assert (crash.app_id, crash.domain, crash.rating, crash.source_review_id) == ("Zap", "games", 1, "r1")
    assert got["Two\nlines"].rating is None and got["Two\nlines"].source_review_id is None
    assert got["Nice"].source_review_id is None
    lists = {r.review_id: r.annotations for r in I.nest_annotations(notes).collect()}
    items = [(a.aspect_category, a.aspect_term, a.polarity, a["from"], a.to) for a in lists[crash.id]]
    assert items == [("reliability", "it", "negative", 0, 2), ("usability", "", "N/A", None, None), ("cost", "price", "negative", 3, 4)]
    two = lists[got["Two\nlines"].id][0]
    assert (two.aspect_term, two["from"], two.to) == ('say "hi"', 1, None)
    assert I.bad_ratings(readers.read_annotated_csv(spark, csv_path)).first()[0] == 1


def test_csv_without_offsets_or_review_ids(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("domain,app,sentence,category,term,sentiment,rating\nd,a,s,c,t,positive,3\n")
    reviews, notes = csv_tables(readers.read_annotated_csv(spark, str(path)))
    assert reviews.first().source_review_id is None and notes.first().offset_from is None


@pytest.mark.parametrize("text, problem", [("domain,app\nx,y\n", "missing columns"), (CSV.split("\n")[0] + "\n", "empty")])
def test_bad_csv(spark, tmp_path, text, problem):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    with pytest.raises(readers.InputError, match=problem):
        readers.read_annotated_csv(spark, str(path))


def test_loading_twice_adds_nothing(spark, csv_path, tmp_path):
    tables = Tables(str(tmp_path / "store"))
    for _ in range(2):
        ingest_csv(spark, csv_path, tables)
    assert tables.reviews(spark).count() == 3
    assert tables.annotations(spark).count() == 5
    assert "ingested_at" not in readers.raw_reviews(tables.reviews(spark)).columns


def test_upload_needs_a_review_column(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("text\nx\n")
    with pytest.raises(readers.InputError, match="review"):
        readers.read_reviews_csv(spark, str(path))


def test_lines(table):
    df = table([(1, " a \n\n b\t\n  ")], "id int, text string")
    assert [(r.line_no, r.review) for r in readers.lines_as_reviews(df).collect()] == [(0, "a"), (2, "b")]


def test_large_lists_come_in_parts_and_stay_whole(spark):
    """One key holds a third of the rows; parts joined in order are the list."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000))).alias("k"),
        "id", F.concat(F.lit("v"), "id").alias("v"),
    )
    parts = nest(df, "k", "id", F.col("v"), "vs", per_list=100).collect()
    hot = [r for r in parts if r.k == "hot"]
    assert [len(r.vs) for r in hot] == [100] * 30
    assert [v for r in sorted(hot, key=lambda r: r.part) for v in r.vs] == [f"v{i}" for i in range(0, 9000, 3)]
    assert sum(len(r.vs) for r in parts) == 9000
    assert len([r for r in parts if r.k == "k1"]) == 1


def test_nested_annotations_become_rows_again(spark, csv_path):
    _, notes = csv_tables(readers.read_annotated_csv(spark, csv_path))
    again = I.annotations_of(I.nest_annotations(notes).withColumnRenamed("review_id", "id"))
    columns = ["review_id", "aspect_term", "aspect_category", "polarity", "offset_from", "offset_to"]
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert rows(again) == rows(notes)


@pytest.mark.parametrize(
    "text, domain, review_id, categories",
    [
        ('{"domain":"d","aware_review_id":"7","aware_annotations":[{"aspect_category":"cost"},null]}', "d", "7", ["cost"]),
        ('{"domain":"d","aware_review_id":""}', "d", None, []),
        ('{"aware_annotations":"no list"}', None, None, []),
        ("[1,2]", None, None, []),
        ("garbage", None, None, []),
        (None, None, None, []),
    ],
)
def test_metadata(table, text, domain, review_id, categories):
    m = table([(text,)], "t string").select(readers.review_metadata(F.col("t")).alias("m")).first().m
    assert (m.domain, m.source_review_id, [a.aspect_category for a in m.annotations]) == (domain, review_id, categories)


def test_record_files(spark, table):
    path = fresh_path(spark, "records")
    rows = table([("1", "a b", None, "train"), ("2", "é", "x", "test")], "review_id string, aspect string, label string, split string")
    writers.write_records(rows, path)
    raw = {r.value for r in spark.read.text(path).select("value").collect()}
    assert '{"review_id":"1","aspect":"a b","label":null}' in raw
    spark.createDataFrame([("",), ("  ",), ('{"review_id":"3"}',)], "value string").coalesce(1).write.text(path + "/split=val")
    schema = "review_id string, aspect string, label string"
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema)
    assert readers.read_records(spark, path, schema, split="test").count() == 1
    assert [r.review_id for r in readers.read_records(spark, path, schema, split="val").collect()] == ["3"]
    assert readers.read_records(spark, path, schema, with_split=True).count() == 3


def test_files_keep_their_order_and_add_up(spark, tmp_path):
    """Order goes by path, not by size; a second load adds only what is new."""
    head = "domain,app,sentence,category,term,sentiment,rating,review_id\n"
    line = "games,Zap,Same text,cost,{},negative,{},r1\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(head + line.format("first", 1))
    (tmp_path / "in/b.csv").write_text(head + "".join(line.format(f"t{i:03}", 5) for i in range(300)))
    store = Tables(str(tmp_path / "store"))
    ingest_csv(spark, str(tmp_path / "in"), store)
    notes = lambda: [r.aspect_term for r in store.annotations(spark).orderBy("seq").collect()]
    assert notes() == ["first"] + [f"t{i:03}" for i in range(300)]
    assert [r.rating for r in store.reviews(spark).collect()] == [1]
    (tmp_path / "more.csv").write_text(head + line.format("new", 2) + line.format("first", 1) + line.format("new", 2))
    for _ in range(2):
        ingest_csv(spark, str(tmp_path / "more.csv"), store)
        assert notes() == ["first"] + [f"t{i:03}" for i in range(300)] + ["new", "new"]
    assert store.reviews(spark).count() == 1


@pytest.mark.parametrize("few", [100, 0])
def test_only_repeated_annotations_get_places(spark, table, few):
    """Ids are the same whichever way the n-th occurrences are found."""
    rows = [("r", i, "t" if i < 5 else f"t{i}", "c", "p", None, None) for i in range(9)]
    notes = table(rows, "review_id string, seq long, aspect_term string, aspect_category string, polarity string, offset_from int, offset_to int")
    got = {r.seq: r.annotation_id for r in I.with_annotation_ids(notes, few).collect()}
    hashed = lambda text: hashlib.sha256(text.encode()).hexdigest()
    alike = lambda term: hashed("\x1f".join(["r", term, "c", "p", "", ""])).upper()
    assert got == {i: hashed(f"{alike('t') if i < 5 else alike(f't{i}')}\x1f{i if i < 5 else 0}") for i in range(9)}


def test_loads_leave_no_intermediate_results(spark, csv_path, tmp_path):
    shared = Path(shared_folder(spark))
    folders = lambda: {p.name for p in shared.glob("settled-*")}
    before = folders()
    tables = Tables(str(tmp_path / "store"))
    ingest_csv(spark, csv_path, tables)
    ingest_csv(spark, csv_path, tables, multi_line=False)
    assert folders() == before and tables.annotations(spark).count() >= 4


def test_annotations_lie_by_review(spark, tmp_path):
    """Over all files in order of the reviews, in each file by place; a review keeps the order of its rows."""
    (tmp_path / "a.csv").write_text("domain,app,sentence,category,term,sentiment,rating\n" + "".join(
        f"d,a,s{i % 7},c,t{i},positive,3\n" for i in range(200)))
    tables = Tables(str(tmp_path / "store"))
    ingest_csv(spark, str(tmp_path / "a.csv"), tables)
    rows = tables.annotations(spark).selectExpr("*", "_metadata.file_name as f").collect()
    assert [r.aspect_term for r in sorted(rows, key=lambda r: r.seq)] == [f"t{i}" for i in range(200)]
    assert all(len(r.review_id) == 64 and r.review_id == r.review_id.lower() for r in rows)
    for name in {r.f for r in rows}:
        keys = [(r.review_id, r.seq) for r in rows if r.f == name]
        assert keys == sorted(keys)


def test_rows_are_parsed_and_hashed_once(spark, csv_path):
    """Keys are stored with the rows; ids are those worked out from the cells."""
    plain = readers.read_annotated_csv(spark, csv_path)
    keyed = readers.read_annotated_csv(spark, csv_path, derive=I.with_keys)
    assert {I.REVIEW_KEY, I.SHORT} <= set(keyed.columns) - set(plain.columns)
    for a, b in zip(csv_tables(plain), csv_tables(keyed, ordered=True)):
        names = [c for c in a.columns if c != "seq"]
        assert b.columns == a.columns and sorted(map(str, a.select(names).collect())) == sorted(map(str, b.select(names).collect()))


def test_parts_of_ids_are_even_and_in_order():
    first, spread = writers._shares({0: 3, 1: 4, 5: 30, 6: 1, 9: 2}, 16, 5)
    assert spread == [1, 1, 1, 1, 1, 4, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    assert first == sorted(first) and first[5] == first[4] + 1 and first[6] == first[5] + 4 and first[15] == first[6]
    assert writers._shares({}, 16, 1) == ([0] * 16, [1] * 16)


def test_a_large_review_is_dealt_to_several_parts(spark, monkeypatch):
    monkeypatch.setattr(writers, "FILE_ROWS", 100)
    rows = spark.range(2000).selectExpr(
        "sha2(cast(if(id < 1000, 0, id) as string), 256) as review_id", "id as seq", "sha2(concat('a', id), 256) as annotation_id")
    stored = rows.where("id % 3 = 0").select("review_id", "annotation_id")
    for known, kept in ((None, range(2000)), (stored, [i for i in range(2000) if i % 3])):
        got = writers._fresh_by_review(rows, known).withColumn("p", F.spark_partition_id()).collect()
        assert sorted(r.seq for r in got) == list(kept)
        parts = {}
        for r in got:
            parts.setdefault(r.p, []).append((r.review_id, r.seq))
        assert all(p == sorted(p) for p in parts.values()) and max(map(len, parts.values())) < 400
        assert len({r.p for r in got if r.seq < 1000}) > 5
        small = {}
        for r in got:
            if r.seq >= 1000:
                small.setdefault(r.review_id, set()).add(r.p)
        assert all(len(p) == 1 for p in small.values())
