import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates, paths, regexes, text, urls

NOW = 1_790_000_000_000


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()[0]


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", make(F.col("v")).alias("r")).collect()
    return [r[1] for r in sorted(rows)]


SAME = [
    "https://www.Example.com/a/b/?utm_source=x&b=2&a=1#top", "http://example.com:80/a/b?a=1&b=2", "https://example.com:443/a/b//?a=1&b=2&gclid=9", " https://user:pw@example.com/a/b?b=2&a=1 ",
    "https://example.com/x/../a/./b?a=1&b=2", "HTTPS://EXAMPLE.COM/a/b?a=1&b=2&UTM_Medium=m&ref=r",
]


def test_canonical_urls_of_one_document():
    assert {urls.canonical(u) for u in SAME} == {"https://example.com/a/b?a=1&b=2"}


@pytest.mark.parametrize("bad", [None, "", "mailto:a@b.c", "ftp://example.com/x", "javascript:void(0)", "not a url", "https://"])
def test_unusable_urls(bad):
    assert urls.canonical(bad) is None


def test_canonical_details():
    assert urls.canonical("/a", "https://www.example.com/x/") == "https://example.com/a"
    assert urls.canonical("https://example.com") == "https://example.com/"
    assert urls.canonical("https://example.com/?flag&b=a%20b") == "https://example.com/?b=a+b&flag="
    assert urls.canonical("https://example.com:8080/A") == "https://example.com:8080/A"
    assert urls.canonical("https://example.com/a?b=2&b=1") == "https://example.com/a?b=2&b=1"
    assert urls.canonical("https://ex ample.com/") is None


def test_canonical_is_settled():
    for u in SAME + ["https://example.com/é?q=ü~*"]:
        assert urls.canonical(urls.canonical(u)) == urls.canonical(u)


def test_native_canonical_agrees(spark):
    some = [s.strip() for s in SAME[:4]] + ["https://a.example.org/", "http://m.example.net/en/25#top", None, "nothing", "https://example.com/?x", "https://example.com///"]
    assert column(spark, some, urls.canonical_url) == [urls.canonical(u) for u in some]


def test_absolute():
    assert urls.absolute("/p?q=1#f", "https://example.com/a/b") == "https://example.com/p?q=1#f"
    assert urls.absolute("x", "https://example.com/a/b") == "https://example.com/a/x"
    assert urls.absolute(" no base ") == "no base"
    assert urls.absolute("https://www.Example.com/A?utm_source=1") == "https://www.example.com/A?utm_source=1"


def test_names_from_urls(spark):
    u = "https://www.some-bank.com/markets/insights"
    assert one(spark, u, urls.origin) == "https://www.some-bank.com"
    assert one(spark, u, urls.suggested_id) == "some-bank-insights"
    assert one(spark, u, urls.institution_name) == "Some Bank"
    assert column(spark, ["https://e.com/a/rate-cuts_now.html", "https://e.com/", "https://e.com/x.PHP?y"], urls.title_from_url) == ["Rate cuts now", "https://e.com/", "X"]


def test_title_keys(spark):
    titles = ["Where the valué is | Some Site", "where the VALUE is!", "“Where” the value is", "Short", "Credit — where the value is", "ﬁne ligatures here"]
    assert column(spark, titles, text.title_key) == ["where the value is", "where the value is", "where the value is", "", "credit where the value is", "fine ligatures here"]


def test_display_titles(spark):
    rows = [
        ("Income restored | Some Bank", "Some Bank", "Income restored"), ("Rates — Bank for Fair Trade", "BFT", "Rates"), ("US CPI | what it means", "Some Bank", "US CPI | what it means"), ("A - b | S.B. Asset Institute", "SB Asset", "A - b"),
        ("  two   spaces ", "X", "two spaces"), (" | Some Bank", "Some Bank", "| Some Bank"), ("Plain", "...", "Plain"),
    ]
    df = spark.createDataFrame(rows, "t string, i string, want string")
    assert all(r.got == r.want for r in df.select("want", text.display_title(F.col("t"), F.col("i")).alias("got")).collect())


def test_excerpts(spark):
    html = ["<p>One &amp; two</p><script>x<y</script>", "<style>a{}</style> ", None, "&amp;lt;b&nbsp;c", "w " * 300]
    got = column(spark, html, text.excerpt)
    assert got[:4] == ["One & two", None, None, "<b c"] and len(got[4]) <= 400 and got[4].endswith("w…")


def test_search_is_literal(spark):
    rows = spark.createDataFrame([("100% sure", None), ("100 sure", "a_b"), ("École", "")], "t string, s string")
    find = lambda q: [r.t for r in rows.filter(text.contains_text(q, F.col("t"), F.col("s"))).collect()]
    assert find("0% S") == ["100% sure"] and find("A_B") == ["100 sure"] and find("école") == [] and find("École") == ["École"]


DATES = [
    ("2024-05-01T10:00:00Z", 1714557600000), ("2024-05-01T10:00:00+02:00", 1714550400000), ("2024-05-01", 1714521600000), ("Wed, 01 May 2024 10:00:00 GMT", 1714557600000), ("Wed, 01 May 2024 10:00:00 +0200", 1714550400000),
    ("May 1, 2024", 1714521600000), ("1 May 2024", 1714521600000), ("2024/05/01", 1714521600000), ("1714557600", 1714557600000), ("1714557600000", 1714557600000), ("2024-05-01T10:00:00.123Z", 1714557600123),
]


def test_dates(spark):
    got = column(spark, [d for d, _ in DATES], lambda c: dates.parse_date(c, F.lit(NOW).cast("long")))
    assert [(r["ms"], r["estimated"]) for r in got] == [(ms, False) for _, ms in DATES]
    bad = column(spark, [None, "", "soon", "1989-12-31", "2099-01-01", "12345"], lambda c: dates.parse_date(c, F.lit(NOW).cast("long")))
    assert all(r["ms"] == NOW and r["estimated"] for r in bad)
    edge = column(spark, ["1990-01-01", str(NOW + 172_800_000), str(NOW + 172_800_001)], lambda c: dates.parse_date(c, F.lit(NOW).cast("long")))
    assert [r["estimated"] for r in edge] == [False, False, True]


def test_dates_in_python_agree():
    from tidemark.sources.plain import when

    assert [when(d) for d, _ in DATES] == [ms for _, ms in DATES] and when("soon") is None and when(None) is None


def test_patterns(spark):
    rows = ["the fed said", "éfed", "FED", "federal", "a b", "É", "Fed."]
    match = lambda p: column(spark, rows, lambda c: c.rlike(regexes.compiled(p)))
    assert match(r"\bfed\b") == [True, True, True, False, False, False, True]
    assert match(r"a\sb")[4] and match("é")[5] and match(r"\bx?fed\b")[2]
    assert one(spark, "a[b", lambda c: c.rlike(regexes.compiled("a[b"))) is True


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="aé_9 -.", max_size=12))
def test_boundary_is_ascii(word):
    py = re.compile(regexes.translate(r"\ba\b").removeprefix("(?iu)"), re.IGNORECASE)
    assert bool(py.search(word)) == bool(re.search(r"\ba\b", word, re.ASCII | re.IGNORECASE))


def test_paths(spark):
    body = '{"a":{"b":[{"t":"x"},{"t":"y"},{"u":1}]},"n":5,"e":" ","list":["", "p", 3],"o":{}}'
    get = lambda path, make=paths.as_string: one(spark, body, lambda c: make(paths.get_path(F.try_parse_json(c), path)))
    assert get("a.b[0].t") == "x" and get("n") == "5" and get("e") is None and get("list") == "p" and get("o") is None and get("a.x.y") is None
    assert get("list", paths.as_strings) == ["p", "3"]
    fan = one(spark, body, lambda c: F.transform(paths.get_path(F.try_parse_json(c), "a.b[].t"), paths.as_string))
    assert fan == ["x", "y"]
    assert paths.render("{{a}}-{{ b }}-{{c}}", {"a": 1, "b": 2}) == "1-2-{{c}}"


def test_age_labels(spark):
    ms = [NOW, NOW - 61 * 60000, NOW - 2 * 86400000, NOW - 90 * 86400000]
    assert column(spark, ms, lambda c: text.age_label(c, F.lit(NOW)), "long")[:3] == ["0m ago", "1h ago", "2d ago"]


def test_normalisation_matches_unicodedata(spark):
    s = "Ångström ½ ﬁ Ⅻ über alles"
    flat = unicodedata.normalize("NFKD", s)
    want = re.sub("[^a-z0-9]+", " ", re.sub("[̀-ͯ]", "", flat).lower()).strip()
    assert one(spark, s, text.title_key) == want


def test_excerpts_of_long_texts(spark):
    """Where only the begin is gone through, excerpts are those of the whole."""
    from tidemark.sources import plain

    texts = [lead + pad.join(["word"] * n) + tail for lead in ("", " \n ") for pad in (" ", "  ", " " * 9, "　\t") for n in (1, 79, 80, 81, 100, 160, 900) for tail in ("", " " * 900, " &amp; <b>x</b>", "é😀" * 450)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.excerpt(F.col("t")).alias("e")).collect()
    assert {r.i: r.e for r in rows} == {i: plain.excerpt(t) for i, t in enumerate(texts)}


def test_items_of_one_file_are_made_by_many_tasks(spark):
    from tidemark import queries

    from .conftest import DATA

    assert queries._items(spark, DATA).select(F.spark_partition_id().alias("p")).distinct().count() > 1
