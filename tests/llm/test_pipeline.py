"""The pipeline against a plain version of its stages."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from itemloom.llm import toxicity
from tests.llm.conftest import FOLDER, table
from tests.llm.test_pairs import components_of, shingles
from tests.llm.test_texts import brute_hits


def plain_lines(texts):
    first = {}
    for i, t in texts:
        for j, line in enumerate((t or "").encode().lower().split(b"\n")):
            if words := frozenset(line.split()):
                first.setdefault(words, (i, j))
    order = sorted(first, key=first.get)
    stay = set()
    for n, words in enumerate(order):
        if not any(100 * len(o & words) >= 80 * len(o | words) for o in order[:n] if 5 * min(len(o), len(words)) >= 4 * max(len(o), len(words))):
            stay.add(first[words])
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        worded = [bool(x.encode().split()) for x in lines]
        kept = [x for j, (x, w) in enumerate(zip(lines, worded, strict=True)) if not w or (i, j) in stay]
        if len(kept) == len(lines) or any(x.encode().split() for x in kept):
            out.append((i, "\n".join(kept)))
    return out


def test_pipeline(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    machine = toxicity.fit(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(documents, machine).where("score < 0.5").collect()}
    texts = sorted((r.doc_id, r.text) for r in documents.collect() if r.doc_id in clean)
    texts = plain_lines(texts)
    named = components_of({i: shingles(t, 5) for i, t in texts}, 80)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {i: t for i, t in texts if named[i] == i and not brute_hits(t, items)[1]}
    found = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert found == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert 0 < len(found) < documents.count()


def test_stages_return_documents(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, FOLDER).schema == documents.schema


def test_benchmark_rows_without_an_id_count(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(14))
    spark.createDataFrame([(None, item), (3, "other words of an item that no document holds here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = table(spark, [(1, f"before {item} after"), (2, "clean words"), (4, None)])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, rows, str(tmp_path)).collect()) == [2, 4]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels of one class only, and items of which one has no text."""
    place = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "an item that no text here holds at all, or so")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "a b c"), (None, None), (4, "x " * 3000 + "\ny")]


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_clean_rows(spark, folder, at):
    """Nulls, empty and long texts, repeated rows and columns of clashing names; an
    empty table stays one."""
    stage = corpus_pipeline.STAGES[at][1]
    rows = table(spark, ROWS).withColumns({c: F.lit("mine") for c in ("key", "line", "label", "score", "item", "sign", "node", "n", "row", "twin")})
    found = stage(spark, rows, folder)
    assert found.columns == corpus_pipeline.COLUMNS
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert [(r.doc_id, r.text) for r in sorted(found.collect(), key=order)] == sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert stage(spark, rows.limit(0), folder).collect() == []


def test_a_settled_table_comes_in_small_batches(spark):
    """Whatever the session allows; its own setting stays."""
    import pyarrow as pa

    from itemloom.llm.shared import BATCHED, settle

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"held": pa.array([batch.nbytes], pa.int64())})

    rows = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('abcd', 500) AS body")
    before = spark.conf.get(BATCHED)
    sizes = [x.held for x in settle(rows.mapInArrow(run, "held long"), "sizes").collect()]
    assert len(sizes) > 2 and max(sizes) < 5_000_000 and spark.conf.get(BATCHED) == before
