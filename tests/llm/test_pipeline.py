import corpus_pipeline as P
from tests.llm import test_decontaminate, test_jaccard, test_line_dedup

from quarrystone.llm.shared import saved


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in P.STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            kept = {r.doc_id: r for r in docs.collect()}
            assert set(kept) <= set(before) and all(kept[d] == before[d] for d in kept)
            clean = [d for d in labels if labels[d] == 1]
            assert sum(d in kept for d in clean) >= 0.97 * len(clean)
            before = kept
        elif name == "line_dedup":
            kept = {r.doc_id: r for r in docs.collect()}
            want = {d: text for d, text, _, _ in test_line_dedup.brute([(d, r.text) for d, r in before.items()])}
            assert {d: r.text for d, r in kept.items()} == want
            assert all(r.n_chars == len(r.text) for r in kept.values())
            before = kept
        elif name == "ngram_jaccard_join":
            kept = {r.doc_id: r for r in docs.collect()}
            root = {d: c for d, _, c in test_jaccard.brute([(d, r.text) for d, r in before.items()])}
            assert set(kept) == {d for d in before if root[d] == d}
            before = kept
        elif name == "benchmark_decontamination":
            kept = {r.doc_id: r for r in docs.collect()}
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            rows = [(d, r.text) for d, r in before.items()]
            hit = test_decontaminate.brute(rows, items)
            assert set(kept) == {d for i, (d, _) in enumerate(rows) if not hit[i][1]}
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == set(kept)


def test_run_has_the_last_stages_rows(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def odd(spark, docs):
    """Rows of null, empty and very long texts, without or with repeated ids, and a column whose name an operator uses."""
    from pyspark.sql import functions as F

    long = "a plain line of good words that goes on\n" * 20_000
    more = [(None, long, "en", "web", 1), (-1, None, None, None, None), (-2, "", "en", "web", 0), (-3, "Some good words of a fine day.", "en", "web", 30), (-3, "Some good words of a fine day.", "en", "web", 30)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("score", F.lit("own"))


def test_stages_on_odd_rows(spark, sf_dir):
    """Each stage's defined result for each odd row; the other rows are as without them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(P.STAGES)
    with_odd = odd(spark, docs)

    def count(df, i):
        return df.where("doc_id IS NULL" if i is None else f"doc_id = {i}").count()

    kept = stages["quality_classifier"](spark, with_odd, sf_dir)
    assert kept.columns == with_odd.columns
    assert count(kept, -1) == count(kept, -2) and count(kept, -3) in (0, 2)
    lines = stages["line_dedup"](spark, with_odd, sf_dir)
    assert lines.columns == with_odd.columns and lines.count() == with_odd.count()
    assert {(r.text, r.n_chars) for r in lines.where("doc_id IN (-1, -2)").collect()} == {("", 0)}
    assert set(lines.select("score").distinct().toPandas()["score"]) == {"own"}
    near = stages["ngram_jaccard_join"](spark, with_odd, sf_dir)
    assert [count(near, i) for i in (None, -1, -2)] == [1, 1, 1] and count(near, -3) == 2
    clean = stages["benchmark_decontamination"](spark, with_odd, sf_dir)
    assert [count(clean, i) for i in (None, -1, -2, -3)] == [1, 1, 1, 2] and clean.columns == with_odd.columns
    packed = stages["best_fit_packing"](spark, with_odd, sf_dir)
    assert [count(packed, i) for i in (-1, -2, -3)] == [1, 1, 2] and count(packed, None) > 1
    assert {r.length for r in packed.where("doc_id IN (-1, -2)").collect()} == {1}


def test_stages_on_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert [(name, stage(spark, docs, sf_dir).count()) for name, stage in P.STAGES] == [(name, 0) for name, _ in P.STAGES]


def test_stages_take_small_arrow_batches(spark, sf_dir):
    """Neither the JVM nor a worker holds many texts at once: a batch has about 4 MB, be the rows of a task 20 MB."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", i), F.lit(999)).cast("string")))
    rows = spark.range(2000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    rows = saved(rows.select(*[c if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).coalesce(1), "long-texts")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "rows"])

    stages = dict(P.STAGES)
    for name in ("quality_classifier", "benchmark_decontamination"):
        spark.conf.set(key, before)
        out = stages[name](spark, rows, sf_dir).mapInArrow(sizes, "size long, rows long")
        seen = out.agg(F.max("size").alias("most"), F.sum("rows").alias("rows")).first()
        assert seen.rows is None or seen.most < 6 << 20, (name, seen)
    assert seen.rows == 2000
    spark.conf.set(key, before)


def test_near_duplicates_take_small_arrow_batches(spark, monkeypatch):
    from quarrystone.llm import components, jaccard

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    for module in (jaccard, components):
        monkeypatch.setattr(module, "saved", lambda df, *a, **b: seen.append(int(df.sparkSession.conf.get(key).rstrip("b"))) or saved(df, *a, **b))
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "doc_id long, text string")
    assert {tuple(r)[::2] for r in jaccard.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert seen and max(seen) <= 4 << 20
    assert spark.conf.get(key) == before
