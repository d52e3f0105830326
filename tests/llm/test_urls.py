from pyspark.sql import functions as F

from shroud.llm.url_templates import judge_urls


def rows_of(spark, urls):
    return spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")


def test_rules_hosts_and_paths(spark):
    urls = [
        None, "", "no scheme/en/", "http://A.Example.COM/en/5?x#y", "https://example.com/en/71", "http://m.example.com/en/7", "http://EXAMPLE.net/de/9", "http://x.example.net/de/88", "http://org/es/",
        "http://notcom/en/1", "http://example.com", "http://example.com?q=/en/", "http://example.com#/en/", "ftp://h/p?://x/", "http://example.com/EN/", "a://b://c/en/",
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(rows_of(spark, urls)).collect()}
    assert [got[i][:3] for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.com", "/en/5", "com/en/"), ("example.com", "/en/71", "example.com/en/7"), ("m.example.com", "/en/7", "example.com/en/7"),
        ("example.net", "/de/9", "net/de/"), ("x.example.net", "/de/88", "example.net/de/8"), ("org", "/es/", "org/es/"),
        ("notcom", "/en/1", None), ("example.com", "", None), ("example.com", "", None), ("example.com", "", None), ("h", "/p", None), ("example.com", "/EN/", None), ("b:", "//c/en/", None),
    ]
    assert [got[i][3] for i in (3, 4, 5, 6, 7, 8)] == ["block", "allow", "allow", "allow", "block", "block"]
    assert {got[i][3] for i in (0, 1, 2)} == {"allow"}


def test_templates_learn_from_labelled_pages(spark):
    rules = (("block", "h.x", "/shop/item/1"), ("allow", "h.x", "/blog/"))
    urls = [f"http://h.x/shop/item/{i}" for i in range(10, 400)] + [f"http://h.x/blog/{i}/p{i}" for i in range(200)]
    got = judge_urls(rows_of(spark, urls), rules)
    assert got.count() == len(urls)
    templates = {(r.template, r.verdict) for r in got.where("rule is null").select("template", "verdict").distinct().collect()}
    assert templates == {("/shop/item/*", "allow")} or templates == {("/shop/item/*", "block")}
    by = {r.template: r for r in got.select("template", "template_pages", "template_labelled", "template_blocked").distinct().collect()}
    assert by["/shop/item/*"].template_pages == 390
    assert by["/blog/*/*"].template_pages == 200 and by["/blog/*/*"].template_blocked == 0


def test_branches_below_the_fourth_level_have_their_own_templates(spark):
    rules = (("block", "h.x", "/a/b/c/d/e/bad/1"), ("allow", "h.x", "/a/b/c/d/e/good/1"))
    urls = [f"http://h.x/a/b/c/d/e/{w}/{i}" for w in ("bad", "good") for i in range(100, 300)]
    got = judge_urls(rows_of(spark, urls), rules).where("rule is null").groupBy("template", "verdict").count().collect()
    assert {(r.template, r.verdict, r["count"]) for r in got} == {("/a/b/c/d/e/bad/*", "block", 100), ("/a/b/c/d/e/good/*", "allow", 100)}


def test_odd_tables(spark):
    df = rows_of(spark, ["http://a.b/c"] * 50 + [None] * 3)
    assert judge_urls(df.where("false")).count() == 0
    got = judge_urls(df.unionByName(df))
    assert got.count() == 106 and got.where(F.col("host") == "").count() == 6
    assert judge_urls(rows_of(spark, ["http://a.b/" + "/".join(["s"] * 9), "http://a.b/" + "x" * 50_000])).count() == 2
