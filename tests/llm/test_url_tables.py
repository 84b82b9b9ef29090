"""Tables of counts stay in few partitions, however many the session shuffles to."""

from strandforge.llm import url_filter


def test_path_tables_stay_in_few_partitions(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        urls = spark.createDataFrame([("a.org", ["x", f"p{i % 7}"], i % 2) for i in range(100)], "host string, segs array<string>, bad int")
        got = url_filter.path_templates(urls)
        assert got.rdd.getNumPartitions() == 1
        assert sum(r.n for r in got.collect()) == 100
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
