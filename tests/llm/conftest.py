import pytest

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
PROSE = "the quick fox of the hill and the river ran to see that it was not a dream for you " * 4


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    root = tmp_path_factory.mktemp("odd")
    texts = [None, "", " \n\t", LONG, PROSE, PROSE, PROSE + " end", "One line\nCommon line\n" + PROSE, "été № 5\n COMMON LINE \n\n", "a", "#*$%&|<> " * 60, "spam spam spam " * 40]
    texts += [f"common line\n{PROSE} number {i} of the {i * 7} things" for i in range(12)]
    good = [" ".join(f"the {a}{i} of" for a in ("hill", "river", "field") for i in range(k, k + 40)) + "." for k in (0, 0, 500, 900)]
    texts += [good[0], good[1] + " More.", "common line\n" + good[2], good[3]]
    sources = ["a", "a", None, "b", "b", "c", "é", "d", "a", "a", "b", "c"] + ["big"] * 12 + ["a", "b", None, "c"]
    rows = [(i, t, "en", s, None if t is None else len(t), "x", 1, True, i, [1]) for i, (t, s) in enumerate(zip(texts, sources))]
    rows += [rows[4], rows[4], (None, "no id " + PROSE, None, None, 3, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, node int, kept boolean, label long, bands array<int>"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{root}/empty/documents.parquet")
    return str(root)


@pytest.fixture(scope="session")
def odd_pages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    body = "<p>This is the article. It has sentences that say something.</p>" * 3
    link = lambda h: f'<p><a href="http://{h}/x">to</a></p>'
    rows = [
        (1, "http://a.org/x", f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1>{body}</article><footer>Copyright us</footer></body></html>"),
        (2, "HTTP://WWW.Example.COM/en/y?q#f", None),
        (3, "http://example.com/en/", ""),
        (4, None, "<p>x &amp; y"),
        (5, "no scheme", "<article><p>only</p></article>"),
        (6, "http://bad.net/es/1", link("ring.org")),
        (7, "http://ring.org/1", link("bad.net") * 5),
        (8, "http://sub.bad.net/fr/2", link("ring.org")),
        (9, "http://bad.net/fr/3", None),
        (9, "http://bad.net/fr/3", None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{root}/empty/pages.parquet")
    return str(root)
