import re

import pytest
from pyspark.sql import functions as F

from remitta.llm.exact_dedup import exact_dedup

TEXTS = [(1, "a b"), (2, "ab"), (3, "a  b\n"), (4, None), (5, ""), (6, " \t"), (7, "x" * 300_000), (8, "x " * 300_000), (9, "ä b"), (10, "äb"), (11, "A B"), (12, "a b")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}


def result(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in df.collect()}


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_as_brute_force(spark):
    assert result(exact_dedup(spark, docs(spark))) == brute(TEXTS)


def test_digests_that_collide_are_told_apart_by_the_bytes(spark):
    weak = lambda n: (F.length(n) % 2).cast("string")
    assert result(exact_dedup(spark, docs(spark), digest=weak)) == brute(TEXTS)


def test_large_group_and_ties(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(200)]
    assert result(exact_dedup(spark, docs(spark, rows))) == brute(rows)


def test_empty_table_repeated_rows_and_other_columns(spark):
    assert exact_dedup(spark, docs(spark, [])).count() == 0
    df = docs(spark, [(1, "q"), (1, "q"), (2, "q "), (None, "q")]).withColumn("digest", F.lit("z")).withColumn("group_size", F.lit(9)).withColumn("sha", F.lit(0))
    got = exact_dedup(spark, df).collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == [(1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False)]


def test_one_row_stays_where_ids_repeat(spark):
    for rows in ([(1, "q"), (1, "q")], [(5, "a b"), (5, "ab")], [(None, "z"), (None, "z"), (None, "z")]):
        got = exact_dedup(spark, docs(spark, rows)).collect()
        assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {len(rows)}


FEEDS = [[(1, "a"), (2, "bb")], [(3, "a "), (4, "c"), (5, "bb")], [(6, "longer a"), (7, "c"), (8, "d e"), (0, "a")]]


@pytest.mark.parametrize("weak", [False, True])
def test_state_goes_on_where_it_ended(spark, tmp_path, weak):
    """Each feed is decided on with all before it, also if digests collide between feeds, by a new object with the same folder."""
    digest = (lambda n: F.length(n).cast("string")) if weak else None
    seen = []
    for rows in FEEDS:
        seen += rows
        got = result(exact_dedup(spark, docs(spark, rows), digest=digest, folder=f"file://{tmp_path}/state"))
        assert got == {i: x for i, x in brute(seen).items() if i in dict(rows)}


def test_colliding_digests_are_found_by_the_locator_of_an_earlier_feed(spark, tmp_path):
    digest = lambda n: F.length(n).cast("string")
    folder = f"file://{tmp_path}/state"
    assert result(exact_dedup(spark, docs(spark, [(1, "ab"), (2, "ab")]), digest=digest, folder=folder)) == {1: (1, 2, True), 2: (1, 2, False)}
    assert result(exact_dedup(spark, docs(spark, [(3, "xy")]), digest=digest, folder=folder)) == {3: (3, 1, True)}


def test_stream_begins_anew_with_more_stores(spark, tmp_path):
    from remitta.llm.exact_dedup import StreamingDedup

    folder = f"file://{tmp_path}/state"
    first, rows = [(0, "text 0")], [(i, f"text {i % 50}") for i in range(1, 300)]
    assert result(StreamingDedup(spark, folder, store_rows=50).feed(docs(spark, first))) == brute(first)
    got = result(StreamingDedup(spark, folder, store_rows=50).feed(docs(spark, rows)))
    assert got == {i: x for i, x in brute(first + rows).items() if i}
    assert sorted(p.name for p in (tmp_path / "state").glob("state-*")) == ["state-1", "state-4"]


def test_bitmap_leaves_no_key_out(spark):
    from remitta.llm.exact_dedup import marked

    rows = spark.range(20_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256))
    got = marked(rows, "x", rows.filter("id % 7 = 0").select("x"))
    assert got.filter("id % 7 = 0").count() == 2858 and got.count() < 2858 + 50 and got.columns == ["id", "x"]


def test_long_group_sizes_add_up(spark):
    rows = [(i, "ab" * (i % 7)) for i in range(300)]
    got = exact_dedup(spark, docs(spark, rows))
    assert got.filter("kept").agg(F.sum("group_size")).first()[0] == 300


@pytest.mark.parametrize("text", ["", "a", "　", "a\x0bb\x0cc\rd"])
def test_normal_form_is_the_blanks_of_ascii_only(spark, text):
    import hashlib

    (r,) = exact_dedup(spark, docs(spark, [(1, text)])).collect()
    assert r.text_sha256 == hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", text).encode()).hexdigest()
