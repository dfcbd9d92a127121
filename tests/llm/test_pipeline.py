import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_stages_keep_the_columns_and_take_effect(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert P.run(spark, SF).count() <= before
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe"]


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline as P

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    long = " ".join(f"word{i}" for i in range(300))
    docs = [(i, " ".join(f"t{i}x{j}" for j in range(40))) for i in range(60)]
    docs += [(100, "copy of one"), (101, "copy  of one"), (102, "copy of\none"), (200, long), (201, long + " tail"), (300, f"before {item} after"), (400, None), (401, "")]
    docs += [(500 + i, " ".join(f"u{i}y{j}" for j in range(30)) + " scum vile") for i in range(20)]
    labels = [(i, 1, 0) for i in range(40)] + [(500 + i, 1, 1) for i in range(15)]
    spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in P.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= got
    assert len(got & {100, 101, 102}) == 1 and got & {200, 201} == {200} and 300 not in got and len(got & {400, 401}) == 1
    assert not got & set(range(500, 520))


def test_rows_are_dropped_by_number(spark, monkeypatch):
    """With the bitmaps sent to every executor, and joined."""
    from pyspark.sql import functions as F

    from remitta.llm import common

    rows = spark.range(0, 100_000, 1, 5).select("id", (F.col("id") % 5 * (1 << 33) + F.floor(F.col("id") / 5)).cast("bigint").alias("n"))
    gone = rows.filter("id % 3 = 0").select("n")
    for most in (common.BROADCAST_MAPS, 0):
        monkeypatch.setattr(common, "BROADCAST_MAPS", most)
        left = common.without_rows(rows, gone, "n")
        assert left.columns == ["id", "n"] and left.count() == 66_666 and left.filter("id % 3 = 0").isEmpty()
        assert common.without_rows(rows, gone.limit(0), "n").count() == 100_000


def test_columns_with_clashing_names(spark, tmp_path):
    """Other columns come through every stage as they are."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(60))) for i in range(30)] + [(30, " ".join(f"t1x{j}" for j in range(60))), (31, f"x {item} y"), (None, None), (40, "")]
    names = ["__row", "__key", "__ROW_", "kept", "keep_id", "component_id", "fp", "digest", "norm", "row", "__map", "__of", "contaminated", "spans", "rejected", "grade", "batch"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", *[F.lit(f"own {n}").alias(n) for n in names])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        assert all(r[n] == f"own {n}" for r in after.collect() for n in names), name
        docs = after
    assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) in ([*range(30), 40], list(range(30)))
    assert docs.limit(0).count() == 0 and P.exact_copies_out(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_registered_names():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null ids and ids on several texts: each row stands for itself."""
    import corpus_pipeline as P

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    text = lambda k: " ".join(f"{k}x{j}" for j in range(300))
    rows = [(1, text("a")), (None, text("a")), (None, text("b")), (2, text("c")), (2, text("d")), (3, text("d")), (4, text("e")), (4, text("e")), (None, text("f")), (None, text("f") + " tail"), (5, f"before {item} after"), (5, text("g")), (None, f"then {item} too"), (None, text("h"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    unique = P.exact_copies_out(spark, docs, str(tmp_path))
    gone = [(None, text("a")), (3, text("d")), (4, text("e"))]
    left = rows.copy()
    for x in gone:
        left.remove(x)
    assert of(unique) == sorted(left, key=repr) and unique.columns == docs.columns

    apart = P.near_copies_out(spark, docs.filter("text like 'fx0%' or text like 'hx0%' or text like 'ax0%'"), str(tmp_path))
    texts = [t for _, t in of(apart)]
    assert len(texts) == 3 and text("h") in texts and (1, text("a")) in of(apart)

    clean = P.contaminated_out(spark, docs, str(tmp_path))
    assert of(clean) == sorted([x for x in rows if item not in x[1]], key=repr)
