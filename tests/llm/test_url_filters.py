from tidemark.llm import url_filters as U

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]


def test_cascade_is_exact_over_the_universe(spark):
    universe = spark.range(20000).selectExpr("concat('host', id) as key")
    listed = universe.filter("hash(key) % 5 = 0").union(spark.sql("select null as key"))
    cascade = U.build_cascade(listed, universe, bits_per_key=8.0)
    assert len(cascade.levels) >= 3
    from pyspark.sql import functions as F

    wrong = universe.filter(cascade.listed(F.col("key")) != F.expr("hash(key) % 5 = 0"))
    assert wrong.count() == 0
    plan = universe.select(cascade.listed(F.col("key")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_empty_list_lists_nothing(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "key string")
    assert U.build_cascade(none, spark.createDataFrame([("a",)], "key string")).levels == ()
    assert not spark.createDataFrame([("a",)], "key string").select(U.build_cascade(none, none).listed(F.col("key"))).first()[0]


def rows(spark, listed, **more):
    urls = [None, "", "nohost", "http://A.Example.ORG", "https://x.example.org/es/1?q", "http://example.org/en/12#a", "http://bad.net/p", "http://bad.net/p", "ftp://bad.net?x=/y", "http://notexample.org/es/", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, verdict string").selectExpr("*", "1 as says", "2 as HIT")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, listed, RULES, **more).collect()}


def test_rules_hosts_and_nulls(spark):
    listed = spark.createDataFrame([("bad.net",), (None,), ("bad.net",)], "key string")
    want = {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.org", "", None, "allow"),
        4: ("x.example.org", "/es/1", "example.org/es/", "block"), 5: ("example.org", "/en/12", "example.org/en/1", "block"),
        6: ("bad.net", "/p", None, "block"), 7: ("bad.net", "/p", None, "block"), 8: ("bad.net", "", None, "block"),
        9: ("notexample.org", "/es/", "org/", "allow"), 10: ("b:", "//c/d", None, "allow"),
    }
    assert rows(spark, listed) == want
    assert rows(spark, listed.union(spark.range(30).selectExpr("concat('x', id)")), part_keys=4) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(empty, U.hosts_named(empty, ("x",)), RULES).count() == 0


def test_long_list_in_parts_without_joins_of_pages(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 1000, '.org/p') as url")
    listed = spark.range(0, 1000, 3).selectExpr("concat('h', id, '.org') as key")
    out = U.filter_urls(pages, listed, [], part_keys=50)  # seven parts
    assert out.filter("(verdict = 'block') != (page_id % 1000 % 3 = 0)").count() == 0 and out.count() == 3000
    plan = U.filter_urls(pages, listed, [])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_levels_grow_with_the_list_not_with_the_universe(spark):
    words = {}
    for size in (200_000, 2_000_000):
        universe = spark.range(size).selectExpr("concat('h', id) as key")
        listed = universe.limit(0).union(spark.range(5).selectExpr("concat('h', id * 7) as key"))
        cascade = U.build_cascade(listed, universe)
        words[size] = [level.words for level in cascade.levels]
        assert universe.filter(cascade.listed(U.F.col("key"))).count() == 5
    assert sum(words[200_000]) < 250 and sum(words[2_000_000]) < 250


def test_share_that_passes():
    from tidemark.llm import bloom

    assert 0.02 < bloom.passed(8_000, 1_000) < 0.09
    assert bloom.passed(1_000, 100_000) < 1e-6
    # a list of a million among 10^9 keys: first level of some MB, and no more others pass than are listed
    words = bloom.words_sieving(10**6, 10**9, 8.0)
    assert words * 8 < 16 << 20 and bloom.passed(10**6, words) * 10**9 <= 10**6
    assert bloom.words_sieving(5, 10**9, 8.0) * 8 < 1 << 20
    assert bloom.words_sieving(0, 10**9, 8.0) == 1


def test_wide_first_levels_are_cut_into_parts(spark):
    pages = spark.range(40_000).selectExpr("id as page_id", "concat('http://h', id, '.org/p') as url")
    listed = spark.range(4).selectExpr("concat('h', id * 9, '.org') as key")
    out = U.filter_urls(pages, listed, [], part_keys=16)  # wider than two words
    assert {r.page_id for r in out.filter("verdict = 'block'").collect()} == {0, 9, 18, 27} and out.count() == 40_000


def test_five_million_keys(spark):
    from pyspark.sql import functions as F

    universe = spark.range(8_000_000).selectExpr("concat('h', id) as key")
    cascade = U.build_cascade(universe.filter("hash(key) % 8 < 5"), universe)
    asked = universe.select(cascade.listed(F.col("key")).alias("hit"), F.expr("hash(key) % 8 < 5 as want"))
    assert len(asked._jdf.queryExecution().optimizedPlan().toString()) < 20_000  # the tables aren't in the plan
    assert asked.groupBy("hit", "want").count().filter("hit != want").isEmpty()


def test_many_rules_and_a_long_url(spark):
    rules = [("block", f"h{i}.org", "/") for i in range(3000)] + [("allow", "h7.org", "/ok"), ("block", "h7.org", "/ok")]
    urls = ["http://a.h2999.org/", "http://h7.org/ok", "http://h7.org/no", "http://h3000.org/", "http://" + "a." * 20000 + "h5.org/" + "p" * 500000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(df, spark.createDataFrame([], "key string"), rules).collect()}
    assert out == {0: ("h2999.org/", "block"), 1: ("h7.org/ok", "allow"), 2: ("h7.org/", "block"), 3: (None, "allow"), 4: ("h5.org/", "block")}
