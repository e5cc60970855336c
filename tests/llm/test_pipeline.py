"""The pipeline's stages against what each should do to its own input."""

import random
import sys
from collections import Counter

import pytest

import corpus_pipeline
from kerbflow.llm import bitplane, phrase_index
from kerbflow.llm.common import keyed, picked

from .conftest import prose
from .test_similarity import expected_components, expected_hits

sys.path.insert(0, ".")


@pytest.fixture(scope="module")
def sf_dir(spark, docs, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    by = dict(texts)
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(by[305].split()[60:75])), (2, by[12]), (3, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, docs, sf_dir, texts, tmp_path):
    columns, now = docs.columns, spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(now)
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in kept[:4]]
    assert all(df.columns == columns for df in kept[:4])
    # language: what has a letter stays
    lettered = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    assert Counter(rows[0]) == Counter(lettered)
    # near duplicates: one row of each group stays, that with the smallest id
    groups = {i: c for i, _, c in expected_components(lettered)}
    assert Counter(rows[1]) == Counter([*{(i, t) for i, t in lettered if i is not None and groups[i] == i}, *[x for x in lettered if x[0] is None]])
    # decontamination: documents without a hit stay
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = expected_hits(rows[1], items)
    assert Counter(rows[2]) == Counter((i, t) for i, t in rows[1] if hits[i][1] == 0) and len(rows[2]) < len(rows[1])
    # mixing: every document stays, none more often than the limit allows
    assert set(rows[3]) == set(rows[2]) and max((Counter(rows[3]) - Counter(rows[2])).values(), default=0) <= 3
    # files: one row for each row, in the order of ids
    last = kept[4].orderBy("start").collect()
    assert len(last) == len(rows[3])
    assert [r.doc_id for r in last] == sorted((i for i, _ in rows[3]), key=lambda i: (i is not None, i or 0))
    assert corpus_pipeline.ORACLE_SQL is None and phrase_index.WINDOW == 10 and bitplane.BREAK == "\x01"


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("n_tokens > 0").count() > 40


def test_stages_decide_by_row(spark, sf_dir, texts):
    rng, leak = random.Random(31), " ".join(dict(texts)[305].split()[60:75])
    rows = [(None, prose(rng, 30)), (None, prose(rng, 5) + " " + leak), (7, prose(rng, 30)), (7, leak + " " + prose(rng, 5)), (8, prose(rng, 30))]
    frame = lambda some: spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.decontaminate(spark, frame(rows), sf_dir)
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[2], rows[4]])
    one, two, three, other = (prose(rng, 60) for _ in range(4))
    rows = [(None, one), (None, one), (None, one + " end"), (None, two), (5, two), (4, two + " end"), (9, three), (4, other), (9, three), (6, three)]
    kept = Counter(map(tuple, corpus_pipeline.drop_near_duplicates(spark, frame(rows), sf_dir).collect()))
    assert sum(kept[(None, x)] for x in (one, one + " end")) == 1
    kept -= Counter({(None, one): 1, (None, one + " end"): 1})
    assert kept == Counter([(4, two + " end"), (4, other), (6, three)])


def test_odd_tables(spark, sf_dir, texts):
    """Clashing names, no labels, texts of no learned language, empty tables."""
    rng = random.Random(12)
    rows = [(k, prose(rng, 40), "en" if labelled else None, 5, 6, 7) for k, labelled in enumerate([True] * 30 + [False] * 3)]
    rows += [(40, "ⴰⴱⴳ ⴷⴻⴼ ⴽⵀⵃ", None, 5, 6, 7), (41, "12 34", None, 5, 6, 7), (42, rows[3][1], None, 5, 6, 7), (43, rows[3][1] + " end", None, 8, 9, 10)]
    shape = "doc_id bigint, text string, lang string, row int, told int, component_id int"
    frame = spark.createDataFrame(rows, shape).repartition(3)
    told = corpus_pipeline.identify_language(spark, frame, sf_dir)
    assert sorted(map(tuple, told.collect())) == sorted((r for r in rows if r[0] not in (40, 41)), key=lambda r: r[0])
    without = frame.withColumn("lang", corpus_pipeline.F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, without, sf_dir).collect()} == {r[0] for r in rows} - {41}
    kept = corpus_pipeline.drop_near_duplicates(spark, told, sf_dir)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] < 40)
    now = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, row int")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        assert now.collect() == []
        now = now if "text" in now.columns else None


def test_folders_are_emptied(spark, docs):
    import glob

    from kerbflow.llm import common

    common.release(docs)
    first = common.stored(docs.select("doc_id", "text"), "first-step")
    second = common.stored(first.where("doc_id < 50"), "second-step")
    n, (path, _) = second.count(), common.WRITTEN[-2]
    common.release(second)
    assert second.count() == n and len(common.WRITTEN) == 1
    assert spark.read.schema("x int").parquet(path).count() == 0 and len(glob.glob(path + "/*.parquet")) <= 1


def test_texts_stay_where_they_lie(spark, sf_dir):
    """Rows are picked by bitmaps of keys, so that no text is shuffled, however many keys there are."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.decontaminate):
            kept = stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
            shuffles = [x for x in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
            assert len(shuffles) == 1 and "hashpartitioning(row_block" in shuffles[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_picked_rows(spark):
    rows = keyed(spark.range(70_000).coalesce(1).withColumnRenamed("id", "n"), "k", "b", "picked-test")
    some = {0, 1, 7, 8, 9, 32_767, 32_768, 65_535, 65_536, 69_999}
    keys = spark.createDataFrame([(x,) for x in [*some, 7]], "k bigint")
    assert {r.n for r in picked(rows, "k", "b", keys).collect()} == some
    rest = picked(rows, "k", "b", keys, there=False)
    assert rest.columns == ["n"] and {r.n for r in rest.collect()} == set(range(70_000)) - some
    assert picked(rows, "k", "b", keys.limit(0)).isEmpty() and picked(rows, "k", "b", keys.limit(0), there=False).count() == 70_000
