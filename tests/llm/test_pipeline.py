"""The pipeline's stages one by one against brute force, and as a whole."""

import random

import pytest
from tests.llm import brute

import corpus_pipeline
from mendlist.llm import decontaminate
from mendlist.llm.tokens import Vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    deal = random.Random(9)
    word = lambda: "".join(deal.choices("abcdefgh", k=deal.randint(2, 8)))
    items = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts, labels = [None, ""], {}
    for i in range(2, 260):
        w = [word() for _ in range(deal.randint(30, 90))]
        if i % 5 == 0:
            w = [x + "###" if deal.random() < 0.7 else x for x in w]
        elif i % 7 == 0:
            w = (texts[i - 1] or "x").replace("###", "").split(" ")
            w[deal.randrange(len(w))] = word()
        elif i % 11 == 0:
            w[5:5] = items[i % 4].split()
        text = " ".join(w)
        if i % 3 == 0:
            text += "\nall rights are ours"
        labels[i] = 0 if "###" in text else 1
        texts.append(text)
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, labels, items


def _rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, folder):
    path, labels, items = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = _rows(docs)

    docs = stages["quality classifier"](spark, docs, path)
    kept = _rows(docs)
    assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert all(kept[i] == before[i] for i in kept)
    assert sum((i in kept) == bool(y) for i, y in labels.items()) >= 0.98 * len(labels)

    docs = stages["line dedup"](spark, docs, path)
    lined = _rows(docs)
    assert lined == {i: t and t.replace("\nall rights are ours", "") for i, t in kept.items()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())

    docs = stages["n-gram Jaccard join"](spark, docs, path)
    apart = _rows(docs)
    groups = brute.components(list(lined.items()), 5, 80)
    assert apart == {i: t for i, t in lined.items() if groups[i][1] == i}
    assert len(apart) < len(lined)

    docs = stages["benchmark decontamination"](spark, docs, path)
    clean = _rows(docs)
    leaking = set()
    for i, text in apart.items():
        for item in items:
            shifts, a, b = brute.seeds_hit(text, item, decontaminate.MASKS, decontaminate.SPAN)
            if any(sum(a[q + s] == b[q] for q in range(len(b)) if 0 <= q + s < len(a)) >= 11 for s in shifts):
                leaking.add(i)
    assert leaking and set(apart) - set(clean) == leaking

    encoder = Vocabulary().encoder()
    sizes = {}
    for r in stages["packing"](spark, docs, path).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(encoder.ids(t)) + 1 for i, t in clean.items()}


def test_run(spark, folder):
    result = corpus_pipeline.run(spark, folder[0])
    assert result.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    assert result.count() > 100


def test_rows_without_id_and_with_repeated_ids(spark, folder):
    """They go through every stage: leaks go, of one id one row stays."""
    items = folder[2]
    other = " ".join(f"plain{k}" for k in range(40))
    rows = [(None, items[0]), (None, other), (7, other), (7, other), (7, "short one"), (8, other + " more"), (9, None), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["benchmark decontamination"](spark, docs, folder[0])
    assert sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(map(str, rows[1:]))
    apart = stages["n-gram Jaccard join"](spark, clean, folder[0])
    assert sorted(str(r.doc_id) for r in apart.collect()) == ["10", "7", "9", "None"]


def test_no_documents(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
