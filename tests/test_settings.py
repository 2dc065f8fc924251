import pytest
from pyspark.sql import functions as F

from skerry.config import Settings, read_env_file
from skerry.operators import agreement, metrics, pooling
from skerry.plans import experiment
from skerry.sources import pages, tables


def test_settings_of_a_file_and_the_environment(tmp_path):
    file = tmp_path / ".env"
    file.write_text('# models\nexport SKERRY_MODEL_KEY="a # b" # comment\nSKERRY_TOP_K = 20\nSKERRY_CHUNK_SIZE=5 # small\nOTHER=1\n\nbroken line\nSKERRY_ALPHA=\'0.1\'\nSKERRY_TOP_K=30\nSKERRY_LOG_LEVEL=a#b\n')
    assert read_env_file(file)["SKERRY_MODEL_KEY"] == "a # b" and read_env_file(tmp_path / "none") == {}
    found = Settings.from_env({"SKERRY_CHUNK_SIZE": "7"}, file=file)
    assert (found.model_key, found.top_k, found.chunk_size, found.alpha, found.log_level) == ("a # b", 30, 7, 0.1, "a#b")
    assert Settings.from_env({}) == Settings()
    assert found.require("model_key") is found
    with pytest.raises(ValueError, match="SKERRY_MODEL_ENDPOINT, SKERRY_JUDGE_B_KEY"):
        found.require("model_endpoint", "model_key", "judge_b_key")


def test_guards_of_an_experiment(spark):
    chunks = spark.createDataFrame([("a", "x")], "item_id string, content string")
    assert experiment.checked(chunks, Settings()) is chunks
    for rows, settings, names, said in ((chunks, Settings(top_k=3), (), "depth"), (chunks.limit(0), Settings(), (), "no chunks"), (chunks, Settings(), ("model_key",), "MODEL_KEY")):
        with pytest.raises(ValueError, match=said):
            experiment.checked(rows, settings, *names)


def test_source_chunks_are_empty_without_an_article(spark):
    asked = spark.createDataFrame([(1, "p"), (2, "none"), (3, None)], "query_id int, pmid string")
    chunks = spark.createDataFrame([("p:2", "p", 2), ("p:10", "p", 10), ("q:0", "q", 0)], "item_id string, pmid string, position int")
    lists = pooling.source_chunks(asked, chunks)
    assert {r["query_id"]: r["item_ids"] for r in lists.collect()} == {1: ["p:2", "p:10"], 2: [], 3: []}
    assert [(r["query_id"], r["item_id"], r["pos"]) for r in pooling.of_lists(lists).orderBy("pos").collect()] == [(1, "p:2", 0), (1, "p:10", 1)]
    assert pooling.missing(chunks, chunks.filter("pmid = 'p'")).first()["item_id"] == "q:0"


def test_runs_files_and_counts(spark, tmp_path):
    scores = spark.createDataFrame([("b", 1, 0.5), ("b", 2, 1.0), ("a", 1, 0.0)], "variant string, query_id int, mrr double")
    times = spark.createDataFrame([("b", 1, 10.0, 3)], "variant string, query_id int, latency_ms double, tokens int")
    rows = metrics.timed(scores, times)
    assert {(r["variant"], r["query_id"]): r["latency_ms"] for r in rows.collect()} == {("b", 1): 10.0, ("b", 2): None, ("a", 1): None}
    assert {r["variant"]: (r["mrr"], r["avg_latency_ms"], r["avg_tokens"]) for r in metrics.run_metrics(rows, ("mrr",)).collect()} == {"b": (0.75, 10.0, 3.0), "a": (0.0, None, None)}
    assert tables.tagged("x") == "x" and tables.tagged("x", "large") == "x_large"
    means = scores.select("variant", *[F.col("mrr").alias(m) for m in ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")])
    tests = spark.createDataFrame([("a", "b", "mrr", 0.1, 0.2, 3.0, 0.04, False)], "a string, b string, metric string, mean_a double, mean_b double, statistic double, p_value double, significant boolean")
    for tag, config in (("", None), ("large", {"model": "m"})):
        tables.write_ablation(means, tests, 2, 1, str(tmp_path), tag, config)
        found = tables.read_ablation(spark, str(tmp_path), tag).first()
        assert (len(found["means"]), found["comparisons"][0]["p_value"], found["n_queries"], found["n_excluded_empty_gold"], found["run_config"]) == (3, 0.04, 2, 1, config or {})
    sizes = spark.createDataFrame([(1, 0), (2, 3)], "query_id int, gold_size int")
    assert tuple(agreement.empty_gold(sizes).first()) == (2, 1)


def test_pages_without_an_end_of_their_head():
    assert pages.parse_html("<html><head><title>T</title><meta x><body><p>hello") == ("T", ["hello"])
    assert pages.parse_html("<head><title> T\n</title></head><p>a<svg><title>x</title></svg><title>no</title>b</p>") == ("T", ["axnob"])
    assert pages.parse_html("<head><script>s</script>\n <style>t</style> text") == ("", ["text"])
    assert pages.parse_html("<p>a</p><noscript>b<p>c</noscript><template>d</template>e") == ("", ["a", "e"])
    assert pages.parse_html(None) == ("", []) and pages.parse_html("<title></title><title>b</title>")[0] == ""
