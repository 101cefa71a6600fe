"""Addresses against what a browser's parser gives (fixed pairs)."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import addresses, identifiers

CANONICAL = {
    "https://A.ORG/x": "https://a.org/x", "HTTPS://x.org:443/a": "https://x.org/a", "http://x.org:80": "http://x.org/", "http://x.org:443/": "http://x.org:443/",
    "https://x.org:0443/a": "https://x.org/a", "https://x.org:8443?q": "https://x.org:8443/?q", "https://x.org:": "https://x.org/", "https:x.org/a": "https://x.org/a",
    "https:///x.org//a//b": "https://x.org//a//b", "https://x.org/a/./b/../c": "https://x.org/a/c", "https://x.org/a/%2e%2E/d/.": "https://x.org/d/",
    "https://x.org/..": "https://x.org/", "https://x.org/a/..?x=..#/..": "https://x.org/?x=..#/..", "https://x.org/a b": "https://x.org/a%20b", "https://x.org/é?ü=\"'#<ö>": "https://x.org/%C3%A9?%C3%BC=%22%27#%3C%C3%B6%3E",
    "https://x.org/{a}|b^": "https://x.org/%7Ba%7D|b^", "https://x.org\\a\\b?c\\d": "https://x.org/a/b?c\\d", "  https://x.org/a\n": "https://x.org/a", "https://x.o\trg/": "https://x.org/",
    "https://u:p@X.org/": "https://u:p@x.org/", "https://ex%61mple.org/": "https://example.org/", "https://bücher.example/": "https://xn--bcher-kva.example/",
    "https://日本.jp/a": "https://xn--wgv71a.jp/a", "https://ＥＸ．org/": "https://ex.org/", "https://x.org./a": "https://x.org./a", "https://a_b.org/": "https://a_b.org/",
    "http://2130706433/": "http://127.0.0.1/", "http://0x7f.1/": "http://127.0.0.1/", "http://0177.0.0.01/": "http://127.0.0.1/", "http://8.8.2056/": "http://8.8.8.8/", "http://8.8.8.8./": "http://8.8.8.8/",
    "http://[2001:0DB8:0:0:0:0:0:1]/": "http://[2001:db8::1]/", "http://[1:0:0:2:0:0:0:3]/": "http://[1:0:0:2::3]/", "http://[::]/": "http://[::]/", "http://[0:0:0:0:0:0:0:1]:80/": "http://[::1]/",
    "http://[::FFFF:1.2.3.4]/": "http://[::ffff:102:304]/", "http://[1:0:2:3:4:5:6:7]/": "http://[1:0:2:3:4:5:6:7]/", "http://[1::3:4:5:6:7:8]/": "http://[1:0:3:4:5:6:7:8]/", "http://[0:0:1:2:3:4:0:0]/": "http://[::1:2:3:4:0:0]/",
    "https://x.org/a?": "https://x.org/a?", "https://x.org/a#": "https://x.org/a#",
}
NONE = [
    "ftp://x.org/", "mailto:a@x.org", "x.org/a", "", "https://", "https:///", "https://x.org:99999/", "https://x.org:8a/", "https://a b.org/", "https://a<b.org/", "https://x%2Forg/", "http://256.1.1.1/",
    "http://1.2.3.4.5/", "http://1.2.3.09/", "http://4294967296/", "http://[::1/", "http://[1:2:3]/", "http://[1::2::3]/", "http://[g::1]/", "http://[1:2:3:4:5:6:7:8:9]/", "http://[::1.2.3.400]/", "http://::1/",
]


@pytest.fixture(scope="module")
def given(spark):
    def apply(values, f):
        df = spark.createDataFrame([(v,) for v in values], "u string")
        return {r.u: r.r for r in df.select("u", f(F.col("u")).alias("r")).collect()}

    return apply


def test_canonical_form(given):
    assert given(CANONICAL, addresses.canonical) == CANONICAL


def test_what_is_no_address(given):
    assert {u: r for u, r in given(NONE, addresses.canonical).items() if r is not None} == {}


def test_canonical_form_is_stable(given):
    again = given(list(CANONICAL.values()), addresses.canonical)
    assert all(u == r for u, r in again.items())


def test_gate_and_equality(given):
    shown = {
        "https://A.ORG/x": "https://a.org/x", "https://x.org:443/a": "https://x.org/a", "https://x.org/a?utm%5Fsource=1": "https://x.org/a", "https://x.org/a?id=1&UTM_x=&doi=10.1/a": "https://x.org/a?id=1&doi=10.1%2Fa",
        "https://x.org/a?doi=10.1/a": "https://x.org/a?doi=10.1/a", "https://x.org/a?id=1+2": None, "https://x.org/a?id": None, "https://x.org/a?x=1": None, "https://x.org/a#page=3": "https://x.org/a#page=3",
        "https://x.org/a#b": "https://x.org/a", "http://134744072/a": "http://8.8.8.8/a", "http://0x0a.1/": None, "https://[::1]/": None, "https://[2606:4700:0::1]/": "https://[2606:4700::1]/",
        "https://bücher.example/": "https://xn--bcher-kva.example/", "https://x.org/%zz": None, "https://x.org:444/": None, "https://u@x.org/": None, "https://x.local./": None,
    }
    assert given(shown, identifiers.public_url) == shown
    same = ["https://x.org/a/", "HTTPS://X.org:443/a", "https://x.org/a?utm_source=z#top", "https://x.org/b/../a?ref=1"]
    assert set(given(same, identifiers.same_url_key).values()) == {"https://x.org/a"}
    links = {"https://X.org/(a)": "https://x.org/%28a%29", "https://x.org:8443/": None, "http://x.org/": None, "https://x.test/a": "https://x.test/a", "https://x.lan/": None}
    assert given(links, identifiers.report_url) == links
