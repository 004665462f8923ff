"""URLs as the standard writes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmentry.functions import urls

CASES = {
    "https://Media.Test/a/b.ts": "https://media.test/a/b.ts",
    "HTTP://media.test:80/x": "http://media.test/x",
    "https://media.test:443": "https://media.test/",
    "https://media.test:0443/x": "https://media.test/x",
    "https://media.test:8443/x?y#z": "https://media.test:8443/x?y#z",
    "http://media.test:443/x": "http://media.test:443/x",
    "https://media.test:/x": "https://media.test/x",
    "https://media.test/a/./b/../c": "https://media.test/a/c",
    "https://media.test/a/%2E/b/%2e%2E/c": "https://media.test/a/c",
    "https://media.test/a/.%2e/c/.": "https://media.test/c/",
    "https://media.test/a/%2Ename": "https://media.test/a/%2Ename",
    "https://media.test\\a\\b c": "https://media.test/a/b%20c",
    "https:/media.test/x": "https://media.test/x",
    "https:media.test/x": "https://media.test/x",
    "https://media.test/é/<x>?é='\"#`é": "https://media.test/%C3%A9/%3Cx%3E?%C3%A9=%27%22#%60%C3%A9",
    "https://media.test/100%/%zz/%41": "https://media.test/100%/%zz/%41",
    "https://media.test/a|b~[c]{d}^": "https://media.test/a|b~[c]%7Bd%7D%5E",
    "https://media.test/q?a b&c={d}|`": "https://media.test/q?a%20b&c={d}|`",
    "  https://media.test/a\tb\nc ": "https://media.test/abc",
    "https://media.test/𝄞": "https://media.test/%F0%9D%84%9E",
    "https://me:Pw@Media.Test:443/x": "https://me:Pw@media.test/x",
    "https://[2001:DB8::1]:443/x": "https://[2001:db8::1]/x",
    "https://media.test//a//b": "https://media.test//a//b",
    "https://media.test?x": "https://media.test/?x",
    "https://media.test/../../x": "https://media.test/x",
    "skd://Some/Key ID": "skd://Some/Key ID",
    "data:text/plain,A b": "data:text/plain,A b",
    "https:///": None,
    "https://media.test:99999/": None,
    "https://media.test:8o/": None,
}


def test_urls_are_written_as_by_the_standard(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "u string")
    got = {r.u: r.n for r in df.select("u", urls.normalised(F.col("u")).alias("n")).collect()}
    assert got == CASES


def test_normal_forms_stay(spark):
    df = spark.createDataFrame([(u,) for u in CASES.values() if u], "u string")
    assert all(r.u == r.n for r in df.select("u", urls.normalised(F.col("u")).alias("n")).collect())
