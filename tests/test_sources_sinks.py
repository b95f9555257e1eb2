"""CSV round trips, guards that fail inside the plan, partition independence, streaming meters."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from paths import SF01
from sluice.operators import sampling as M
from sluice.operators.scoring import submission_join
from sluice.sources import csv_io as C
from sluice.sources import tables as TB

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("comment_text", T.StringType()),
                       T.StructField("toxic", T.DoubleType())])


def test_csv_round_trip_quotes_newlines_and_na_tokens(spark):
    rows = [(1, 'he said "hi"\nthen left', 0.0), (2, "NA", 1.0), (3, "plain, with comma", 0.5),
            (4, None, None), (5, "null", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = os.path.join(tempfile.mkdtemp(prefix="sluice-csv-"), "t")
    C.write_csv(df, path)
    back = {r.id: (r.comment_text, r.toxic) for r in C.read_csv(spark, path, SCHEMA).collect()}
    assert back[1] == ('he said "hi"\nthen left', 0.0)
    assert back[2] == (None, 1.0)          # pandas reads NA as missing
    assert back[3] == ("plain, with comma", 0.5)
    assert back[4] == (None, None)
    assert back[5] == (None, 0.0)
    pruned = C.read_csv(spark, path, SCHEMA, columns=["id", "toxic"])
    assert pruned.columns == ["id", "toxic"] and pruned.count() == 5


def test_assert_unique_fails_on_duplicates(spark):
    ok = spark.createDataFrame([(1,), (2,)], "id long")
    assert C.assert_unique(ok, "id").count() == 2
    dup = spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(Exception):
        C.assert_unique(dup, "id").collect()


def test_submission_join_fails_on_missing_score(spark):
    tmpl = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id long, toxic double")
    full = spark.createDataFrame([(1, 0.3), (2, 0.7)], "id long, toxic double")
    assert sorted(r.toxic for r in submission_join(tmpl, full).collect()) == [0.3, 0.7]
    part = spark.createDataFrame([(1, 0.3)], "id long, toxic double")
    with pytest.raises(Exception):
        submission_join(tmpl, part).collect()


def test_shards_independent_of_partitioning(spark):
    c = TB.comments(spark, SF01)
    a = {(r.id, r.idx, r.shard) for r in M.shard_rows(c.repartition(1), 5).collect()}
    b = {(r.id, r.idx, r.shard) for r in M.shard_rows(c.repartition(16, "id"), 5).collect()}
    assert a == b


def test_csv_keeps_white_space_at_the_ends_of_a_text(spark, tmp_path):
    texts = ["  lead", "trail  ", "tab\t", "\n nl", "in\r\nside", " "]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], SCHEMA)
    C.write_csv(df, f"{tmp_path}/t")
    assert {r.id: r.comment_text for r in C.read_csv(spark, f"{tmp_path}/t", SCHEMA).collect()} == dict(enumerate(texts))
    C.write_partitioned(df, f"{tmp_path}/p", "toxic", "csv")
    part = T.StructType(SCHEMA.fields[:2])
    assert {r.id: r.comment_text for r in C.read_csv(spark, f"{tmp_path}/p/toxic=0.0", part).collect()} == dict(enumerate(texts))


def test_catalog_reads_by_path_schema_and_renames(spark, tmp_path):
    from sluice.functions.text import clean_text
    from sluice.sources import registry as REG

    raw = spark.createDataFrame([(1, 'a 1 "b"\n@c d', 0.3), (2, None, 0.97), (3, "NA", 1.0)], "id long, content_en string, toxic double")
    C.write_csv(raw, f"{tmp_path}/csv")
    raw.write.parquet(f"{tmp_path}/parquet")
    cat = REG.Catalog()
    ddl, renames = "id bigint, content_en string, toxic double", {"content_en": "comment_text"}
    cat.register("t_csv", f"{tmp_path}/csv", ddl, renames, "test", "csv", cleaned_path=f"{tmp_path}/parquet")
    cat.register("t_parquet", f"{tmp_path}/parquet", ddl, renames, fmt="parquet")
    a = {r.id: r.comment_text for r in cat.load(spark, "t_csv").collect()}
    assert a == {1: 'a 1 "b"\n@c d', 2: None, 3: None}
    assert cat.load(spark, "t_parquet", columns=["id"]).columns == ["id"]
    clean = cat.load(spark, "t_parquet", cleaned=True)
    assert clean.exceptAll(raw.select("id", clean_text("content_en").alias("comment_text"), "toxic")).count() == 0
    for bad in [("t_csv", "x", ddl, {}), ("new", "x", ddl, {"nope": "comment_text"}), ("new", "x", ddl, {}, "judge")]:
        with pytest.raises(ValueError):
            cat.register(*bad)


def test_source_flags(spark, tmp_path):
    from sluice.sources import registry as REG

    cat = REG.Catalog()
    for n in (REG.MERGED, REG.SET1, REG.SET2, *REG.EXTRA):
        rows = [(1, "a", 0.3), (2, None, 0.96), (3, "c", 1.0)]
        spark.createDataFrame(rows, "id long, comment_text string, toxic double").write.parquet(f"{tmp_path}/{n}")
        cat.register(n, f"{tmp_path}/{n}", "id bigint, comment_text string, toxic double", fmt="parquet")

    def run(**flags):
        out = {}
        for r in REG.select_sources(cat, spark, **flags).collect():
            out.setdefault(r.source, []).append((r.id, r.comment_text, r.toxic))
        return {k: sorted(v) for k, v in out.items()}

    raw = [(1, "a", 0.3), (2, "none", 0.96), (3, "c", 1.0)]
    assert run() == {REG.SET1: raw, REG.SET2: [(1, "a", 0.0), (2, "none", 1.0), (3, "c", 1.0)]}
    assert run(float_labels=True)[REG.SET2] == [(1, "a", 0.0), (2, "none", 0.96), (3, "c", 1.0)]
    assert set(run(extra=True)) == {REG.SET1, REG.SET2, *REG.EXTRA}
    assert run(merged=True, extra=True) == {REG.MERGED: raw}


def test_scratch_needs_a_shared_folder_off_local_masters(spark):
    from types import SimpleNamespace

    from sluice import session

    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
    assert [session.is_local(m) for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,1024]", "yarn")] == [True] * 3 + [False] * 2


def test_scratch_is_removed(spark):
    from sluice import session

    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    root = os.path.dirname(path)
    local = root.removeprefix("file:")
    assert os.path.exists(local)
    session.remove_scratch(spark, root)
    assert not os.path.exists(local)
