"""The corpus pipeline, stage by stage on its own input, against plain versions."""

import corpus_pipeline as cp
from lattica.llm import decontaminate, mix, near_copies, quality, shard
from lattica.llm.common import in_written_order, materialize, part_order


def test_stages(spark, sf, documents):
    docs, seen = documents, {}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf), "test")
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == documents.columns
        assert docs.select("doc_id").distinct().count() == docs.count() <= before.count()
    before, after = seen["quality rules"]
    kept = {r.doc_id for r in quality.op2(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = seen["SimHash near-dedup"]
    rows = {r.doc_id: set(near_copies.shingle_hashes(r.text.encode(), 5).tolist()) for r in before.collect()}
    left = sorted(r.doc_id for r in after.collect())
    jaccard = lambda a, b: len(rows[a] & rows[b]) / max(1, len(rows[a] | rows[b]))
    assert all(jaccard(a, b) < 0.8 for i, a in enumerate(left) for b in left[:i])
    assert all(any(jaccard(d, k) >= 0.5 for k in left) for d in set(rows) - set(left))
    before, after = seen["benchmark decontamination"]
    bad = {r.doc_id for r in decontaminate.op10(spark, sf).where("contaminated").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad & {r.doc_id for r in before.collect()}
    before, after = seen["mixing sources to target weights"]
    assert after.count() > 0.6 * before.count()
    before, after = seen["sharding"]
    assert before.count() == after.count() and after.select("shard").distinct().count() == min(shard.N_SHARDS, after.count())


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 0 and {"shard", "slot", "text"} <= set(out.columns) and len(cp.STAGES) == 5


def test_mixing_stage_keeps_every_document(spark, odd, none):
    """A source with a third of all rows beside small ones: nothing is left out, and rows come by slot."""
    rows = [(i, f"t{i}", "en", "hot" if i % 3 == 0 else None if i % 3 == 1 else f"s{i % 19}", 0) for i in range(6000)]
    df = spark.createDataFrame(rows, odd.schema)
    assert mix.mixed(df).count() < 6000
    out = cp.source_mixing(spark, df, "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(6000)) and out.columns == df.columns
    light = df.select("doc_id", mix.source_key().alias("s"), mix.order_hash(df).alias("h"))
    slot = {r.doc_id: r.slot for r in mix.scheduled(light).collect()}
    got = [slot[r.doc_id] for r in out.collect()]
    assert got == sorted(got)
    assert cp.source_mixing(spark, odd, "").count() == odd.count() and cp.source_mixing(spark, none, "").count() == 0


def test_shards_keep_the_schedule_of_the_mixing_stage(spark, odd, none, clashing):
    """The result changes with the mixing stage: in every shard slots follow the schedule, so each source is read at its target weight from the start. The table comes written, as from run(), or not."""
    rows = [(i, f"t{i}", "en", "hot" if i % 10 else "rare" if i % 20 else "few", 0) for i in range(8000)]
    df = spark.createDataFrame(rows, odd.schema)
    light = df.select("doc_id", mix.source_key().alias("s"), mix.order_hash(df).alias("h"))
    slot = {r.doc_id: r.slot for r in mix.scheduled(light).collect()}
    ordered = cp.source_mixing(spark, df, "")
    weight = {s: n**mix.EXPONENT for s, n in (("hot", 7200), ("rare", 400), ("few", 400))}
    results = []
    for docs in (materialize(ordered, "test"), ordered):
        out = cp.sharding(spark, docs, "").collect()
        assert sorted(r.doc_id for r in out) == list(range(8000))
        assert {(r.shard, r.slot) for r in out} == {(s, i) for s in range(shard.N_SHARDS) for i in range(500)}
        for s in range(shard.N_SHARDS):
            got = [slot[r.doc_id] for r in sorted((r for r in out if r.shard == s), key=lambda r: r.slot)]
            assert got == sorted(got)
        first = [r.source for r in out if r.slot < 100]  # before any source has run out
        assert all(abs(first.count(s) / len(first) - w / sum(weight.values())) < 0.05 for s, w in weight.items())
        results.append({r.doc_id: (r.shard, r.slot) for r in out})
    assert results[0] == results[1]
    unmixed = {r.doc_id: (r.shard, r.slot) for r in cp.sharding(spark, materialize(df, "test"), "").collect()}
    assert unmixed != results[0]
    assert cp.sharding(spark, odd, "").count() == 11 and cp.sharding(spark, none, "").count() == 0
    assert set(cp.sharding(spark, clashing, "").columns) == set(clashing.columns)


def test_written_order(spark):
    """Places over many files, of which some are empty and some hold several row groups' worth; part numbers are compared as numbers."""
    df = spark.range(3000).selectExpr("id * 7919 % 3000 AS id", "id AS `a.b`").repartition(7).orderBy("id")
    for docs in (materialize(df, "test"), materialize(df.where("id % 500 < 3"), "test"), df):
        got = [(r["row"]["id"], r["__position"]) for r in in_written_order(docs).collect()]
        want = sorted(r.id for r in docs.collect())
        assert sorted(got) == list(zip(want, range(len(want)), strict=True))
    paths = [f"file:/x/part-{n}-8f-c{c}.snappy.parquet" for n, c in (("00009", "000"), ("00010", "000"), ("00010", "001"), ("99999", "1000"), ("100000", "000"))]
    assert sorted(reversed(paths), key=part_order) == paths and part_order("file:/x/documents.parquet")[0] == -1
