"""License scans, HTML extraction, mixing and the pipeline."""

from collections import Counter

import pytest

from fleetsight.llm import html_text, licenses, mixing
from fleetsight.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_article_between_structure():
    html = page(
        '<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div><article><h1>Head &amp; tail</h1>'
        "<p><b>First\n  block &copy; one<br>two<p>Second&nbsp;block.</p><aside>Side</aside><form><input><p>Form</p></form>"
        '<div class="comments"><p>Nice!</p></div><p>Last.</article><div id="cookie-notice">Cookies</div><footer>&middot; foot</footer>'
    )
    assert html_text.main_text(html) == "Head & tail\n\nFirst block © one two\n\nSecond block.\n\nLast."


def test_text_without_an_article():
    blocks = "".join(f"<p>{'long text of the story ' * 8}{k}</p>" for k in range(6))
    html = page(f'<div class="menu">Menu</div><div>{blocks}<p>Short.</p>{blocks}</div><footer>Foot</footer>')
    found = html_text.main_text(html).split("\n\n")
    assert len(found) == 13 and "Short." in found


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!-- open", "<html><body></body></html>", "<script>x", "</p></div>", "<nav>only a menu</nav>"])
def test_bare_pages(html):
    assert html_text.main_text(html) in ("", "<", "<p")


def test_broken_markup():
    assert html_text.main_text("<article><p>a < b &lt; c <p>d</article>") == "a < b < c\n\nd"
    assert html_text.main_text("<article><p title='a>b'>x</p><![CDATA[y]]></article>") == "x\n\ny"
    assert html_text.main_text("plain text") == "plain text"


def test_one_very_long_paragraph():
    blocks = [f"A paragraph of the story that is not long, number {k}." for k in range(6)]
    for tag in ("article", "div"):
        html = page(f"<{tag}>" + "".join(f"<p>{b}</p>" for b in [*blocks, "word " * 4_000, *blocks]) + f"</{tag}>")
        assert len(html_text.main_text(html).split("\n\n")) == 13


def test_articles_that_are_not_the_text():
    story = "".join(f"<p>{'long text of the story ' * 8}{k}</p>" for k in range(6))
    cards = "".join(f"<article><h3>Other {k}</h3><p>A teaser.</p></article>" for k in range(4))
    assert html_text.main_text(page(f"<div>{story}</div>{cards}")).count("story") == 48
    comments = "".join(f'<article class="comment"><p>{"I think so too. " * 80}</p></article>' for _ in range(4))
    assert html_text.main_text(page(f"<div>{story}</div>{comments}")).split("\n\n") == [f"{'long text of the story ' * 8}{k}" for k in range(6)]


def test_surge_and_dive_in_an_article():
    lines = ["Top", "x", "y", *["A paragraph of the story that is long enough to be text."] * 3, "a", "b", "c"]
    found = html_text.main_text(page("<article>" + "".join(f"<p>{t}</p>" for t in lines) + "</article>")).split("\n\n")
    assert found == lines[1:8]


def test_names_that_only_contain_a_word_of_structure():
    html = page(
        '<div style="overflow:hidden" data-hidden="false" data-id="share" title="id=ads"><article><div class="entry-header"><h1>Head</h1></div><h2 id="social-impact">Impact</h2>'
        '<section id="related-work"><p class="notice-period">Notice</p></section><div class="share-buttons">Tweet</div><div id="comment-12">Nice</div>'
        "<p hidden>Gone</p><p hidden=until-found>Found</p><ul class='x related-posts'><li>Other</ul></article></div><div class='site-footer'>Foot</div>"
    )
    assert html_text.main_text(html) == "Head\n\nImpact\n\nNotice\n\nFound"


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    assert all("Menu" not in r.text and "©" not in r.text for r in got)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x</p>", 2), (1, "u", "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert Counter(map(tuple, html_text.extract(odd).collect())) == Counter([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)])
    assert html_text.extract(odd.where("false")).count() == 0


def test_license_notices(spark, awkward, nothing):
    text = "Some prose first. Released under the MIT License. And some more; this work is licensed under the GNU General Public License version 3 at the end"
    header = licenses.TEMPLATES["GPL-3.0-header"].replace("either version 3", "version 3").replace("you can", "You  could")
    df = spark.createDataFrame([(1, text), (2, f"x {header} y"), (3, "under the license of the day")], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(df).collect()))
    assert [(r[0], r[1]) for r in got] == [(1, "GPL-3.0"), (1, "MIT"), (2, "GPL-3.0-header")]
    by_name = {r[1]: r for r in got}
    assert text[by_name["MIT"][3] : by_name["MIT"][4]] == "Released under the MIT License"
    assert 0.9 < by_name["GPL-3.0-header"][2] < 1
    assert licenses.scan(awkward).count() == licenses.scan(nothing).count() == 0
    assert licenses.scan(df, [("none", ""), ("null", None)]).count() == 0
    repeated = licenses.scan(df.union(df)).collect()
    assert len(repeated) == 2 * len(got)


def test_whole_licenses():
    index = licenses.Index([*licenses.TEMPLATES.items(), *licenses.whole_texts().items()])
    names = lambda text: [m[0] for m in index.matches(text, licenses.WordHashes())]
    for name in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT-text", "AGPL-3.0-header", "LGPL-2.1-header", "GPL-2.0-header"):
        assert names(f"Copyright 2020 A. Author. {licenses.TEMPLATES[name]} And prose.") == [name]
    assert names(licenses.TEMPLATES["MIT-text"][:190]) == []
    assert names("Licensed under the MIT License") == names("Released under the MIT licence") == ["MIT"]
    texts = licenses.whole_texts()
    assert {"Apache-2.0-text", "GPL-3.0-text", "LGPL-3.0-text"} <= set(texts)
    for name, text in texts.items():
        assert name in names(f"Some prose. {text}")


def test_license_scan_against_search(spark, documents):
    texts = dict(documents.select("doc_id", "text").collect())
    got = {(r.doc_id, r.license) for r in licenses.scan(documents).collect() if r.coverage == 1}
    short = {n: t.rstrip(".") for n, t in licenses.TEMPLATES.items() if len(t) < 80}
    assert {x for x in got if x[1] in short} == {(i, n) for i, t in texts.items() for n, s in short.items() if s in (t or "")}


def test_mixing_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 100 = 1 then 'rare' else 'other' end as source", "'t' as text", "1 as size")
    weights = spark.createDataFrame([("hot", 1.0), ("rare", 2.0), ("gone", 5.0), ("other", -1.0), ("rare", None)], "source string, weight double")
    got = Counter(r.source for r in mixing.mix(docs, weights=weights, budget=9_000.0).collect())
    assert set(got) == {"hot", "rare"}
    assert abs(got["hot"] - 3_000) < 250 and abs(got["rare"] - 6_000) < 350
    again = mixing.mix(docs.repartition(7), weights=weights, budget=9_000.0)
    assert Counter(r.source for r in again.collect()) == got


def test_mixing_of_awkward_rows(awkward, nothing):
    clashing = awkward.selectExpr("*", "1 as size", "2 as rate", "3 as parts", "4 as cdf", "5 as weight")
    assert sorted(mixing.mix(clashing).columns) == sorted([*clashing.columns, "copy", "place"])
    assert {(r["size"], r.rate, r.parts, r.cdf, r.weight) for r in mixing.mix(clashing).collect()} <= {(1, 2, 3, 4, 5)}
    mixed = mixing.mix(awkward)
    assert mixed.columns == [*awkward.columns, "copy", "place"]
    rows = mixed.collect()
    assert all(0 <= r.place < 1 for r in rows) and len(rows) > 0
    assert mixing.mix(nothing).count() == 0


def test_mixing_stays_in_the_engine(documents, capsys):
    mixing.mix(documents).explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Arrow", "Pandas"))


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SMALL)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        if name != "source_mixing":
            assert after.columns == columns
            n = after.count()
            assert n == before if name == "personal_data" else 0 < n <= before
            before, docs = n, after
    mixed = corpus_pipeline.run(spark, SMALL)
    assert mixed.columns == [*columns, "copy", "place"] and mixed.count() > 0


def test_pipeline_of_awkward_rows(spark, awkward, nothing):
    import corpus_pipeline

    docs = awkward.selectExpr("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.where("false")):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL)
        assert now.count() >= 0
