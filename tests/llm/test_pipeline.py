import corpus_pipeline
from gridloom.llm import queries
from gridloom.llm.decontaminate import contamination

from . import brute


def test_stages_in_turn(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name == "toxicity":
            assert len(after) > 0.75 * len(before)
        if name == "near_duplicates":
            want = brute.components({i: brute.shingles(r["text"]) for i, r in before.items()})
            assert set(after) == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            assert set(after) == set(before)
            found = {r["doc_id"]: r["spans"] for r in contamination(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            for i, r in after.items():
                raw = before[i]["text"].encode()
                for s in reversed(found[i]):
                    raw = raw[: s["from"]] + raw[s["to"] :]
                assert r["text"] == raw.decode() and r["n_chars"] == len(r["text"])
        if name == "pii":
            assert set(after) == set(before)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r["length"] > 0 for r in rows} == {True}


def test_odd_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "one two", "en", "s", 7), (3, "one two", "en", "s", 7), (None, "one two", "en", "s", 7), (5, "w " * 9000, "en", "s", 18_000), (6, "write to a.b@c.example.com", "en", "s", 26), (7, "one two", "xx", "t", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    own = ["score", "predicted", "n_entities", "row", "found", "component_id", "bucket", "part"]
    docs = docs.withColumns({c: F.lit(c) for c in own})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, sf_dir).cache(), stage(spark, empty, sf_dir)
        assert docs.columns == empty.columns == ["doc_id", "text", "lang", "source", "n_chars", *own], name
        assert docs.select(*own).distinct().collect() == [tuple(own)] and empty.count() == 0, name
    got = sorted((r["doc_id"] or 0, r["text"]) for r in docs.filter("text is not null").collect())
    assert [k for k, _ in got] == [0, 2, 3, 3, 5, 6] and docs.filter("doc_id = 1 and text is null").count() == 1
    assert "a.b@c" not in got[-1][1] and got[-1][1].endswith(".com")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.filter("start = 0").count() == 7
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
