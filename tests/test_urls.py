from urllib.parse import urljoin

from pyspark.sql import functions as F

from noticeloom.functions.urls import resolve_url

BASES = ["https://a.com/b/c/d.html?x=1#z", "http://h.org", "https://a.com/b//c/",
         "http://a.com/x/..//y/z;p?q"]
HREFS = ["", "d", "./d", "../d", "../../d", "../../../../d", "/r/s", "/r/../s/./t", "?y=2", "#f",
         "//h/p/../q", "mailto:x@y", "javascript:void(0)", "http://z.com/a/../b", "https:foo", "d?",
         "d#", "d/..", "d/.", "..", ".", "a//b", "//", "d;x=1", "  d", "d\n", "a/b/../../..",
         "HTTP://z/", "/", "g?y/./x", "g#s/../x", "/a//b", "é/ü?ñ=1", "tel:+1", "a:b", "x y.pdf"]


def test_resolution_equals_the_standard_library(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(pairs, "b string, h string")
    got = df.select("b", "h", resolve_url(F.col("b"), F.col("h")).alias("u")).collect()
    assert [(r.b, r.h, r.u) for r in got] == [(b, h, urljoin(b, h)) for b, h in pairs]


def test_plain_addresses_are_put_on_as_taking_them_apart_gives(spark):
    from noticeloom.functions import urls as U
    hrefs = HREFS + ["a b", "x?", "x?#", "x?q#f", "?", "?#", "/..", "/a/./b", "a\tb", "\x01a", "a:b/c", "a/b:c", ":a", "..a"]
    bases = BASES + ["", "h:", "//h/a", "/a/b", "https:///a", "https://h?x/y", "https://h#a/b", "https://h/a?/../c", "https://h/a/.."]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    b, h = F.col("b"), F.col("h")
    assert df.where(~resolve_url(b, h).eqNullSafe(U._resolved(b, h))).collect() == []
    assert df.where(h.rlike(U._PLAIN_HREF) & b.rlike(U._PLAIN_BASE)).count() > 40
