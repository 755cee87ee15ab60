import random
import time

import pytest

from sosrank.llm import html_extraction as hx, language_id as li, toxicity as tx

WORDS = {"en": "the and of that with this from have which their would about there".split(),
         "de": "der und die nicht mit sich auch werden einer durch haben zwischen".split()}


def _text(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language_by_compression(make_docs, messy):
    rng = random.Random(1)
    train = make_docs([(i, _text(rng, lang), lang) for i, lang in enumerate(["en", "de"] * 40)])
    dictionaries = li.fit(train)
    assert set(dictionaries) == {"en", "de"}
    test = make_docs([(i, _text(rng, lang), lang) for i, lang in enumerate(["en", "de"] * 20)])
    rows = li.identify(test, dictionaries).collect()
    truth = {r.doc_id: r.lang for r in test.collect()}
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 39 and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in li.identify(messy, dictionaries).collect()}
    assert len(odd) == 12 and {odd[i].lang_pred for i in (1, 2, 3)} == {"und"} and odd[4].lang_pred != "und"
    assert li.fit(messy.limit(0)) == {}
    assert {r.lang_pred for r in li.identify(messy, {}).collect()} == {"und"}
    assert li.identify(messy.limit(0), dictionaries).count() == 0


def test_narrow_margins_are_rejected():
    model = li.Compressors({"en": b" same words here ", "de": b" same words here "})
    assert model.predict("same words here")[2] is False


@pytest.fixture(scope="module")
def toxic_model(spark, make_docs):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = _text(rng, "en", 30).split()
        if i % 4 == 0:
            for w in rng.sample(["moron", "idiot", "trash"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 0, int(i % 4 == 0)))
    docs, labels = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_held_out(toxic_model):
    docs, labels = toxic_model
    rows = {r.doc_id: r for r in tx.scores(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert len(rows) == 600 and len(held) > 60
    assert sum(rows[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())


def test_toxicity_odd_rows(toxic_model, messy, spark):
    model = tx.fit(*toxic_model)
    rows = model.score(messy.select("doc_id", "text")).collect()
    assert len(rows) == messy.count() and all(r.score is not None for r in rows)
    nothing = spark.createDataFrame([(None, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in tx.scores(messy, nothing).collect()} == {0.0}
    assert model.score(messy.select("doc_id", "text").limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies <p>ok</div><nav><a href="/">Home</a></nav><main><article><header>
<h1>Head &amp; line</h1></header><p>One  two&nbsp;three <a href="x" title="a > b">link words</a> fo<b>ur</b>.</p>
<div class="advert">Buy now</div><p>Five<br>six.<script>var a="<p>no</p>"</script></p><!-- <p>gone</p> -->
<form><input>mail <button>go</button></form><section id="comments"><article class="comment"><p>great post</p></article>
</section></article></main><aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_extraction_of_the_article():
    got = hx.extract(PAGE, hx.DEFAULT_WEIGHTS)
    assert got == "Head & line\nOne two three link words four.\nFive six."


def test_extraction_without_article_markup():
    page = ("<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><div><p>This is the long text of the page,"
            " many words.</p><p>And a second block of it here.</p></div><ul><li><a>More</a></li></ul>")
    assert hx.extract(page, hx.DEFAULT_WEIGHTS) == ("This is the long text of the page, many words.\n"
                                                    "And a second block of it here.")


@pytest.mark.parametrize("inside, want", [
    ('<p class="ad">Buy<p>Real one</p><p>Two</p>', "Real one\nTwo"),
    ('<p class="ad">Buy<div>Real one</div>Two', "Real one\nTwo"),
    ('<p>Real one<p class="ad">Buy<ul><li>Two</ul>', "Real one\nTwo"),
    ('<ul><li class="ad">Buy<ul><li>now</ul><li>Real one<li>Two</ul>', "Real one\nTwo"),
    ('<dl><dt class="ad">Buy<dd>Real one<dd class="ad">Buy<dt>Two</dl>', "Real one\nTwo"),
    ('<table><tr><td class="ad">Buy<td>Real one<tr class="ad"><td>Buy<tr><td>Two</table>', "Real one\nTwo"),
    ('<section><div class="ad">Buy <p>now</section><p>Real one</p><p>Two</p>', "Real one\nTwo"),
    ('<p><span class="ad">Buy</p><p>Real one</p>Two', "Real one\nTwo"),
    ('<p>Real one</p><span><div class="ad">Buy</span> now<div>or</div> later</div>Two', "Real one\nTwo"),
    ('<p>Real one</p><div class="ad"><p>Buy<p>now</p></p><ul><li>x<li>y</ul></div><p>Two', "Real one\nTwo"),
    ('<p>Real one</p><p>Two</p><div class="ad">Buy <p>now', "Real one\nTwo")])
def test_furniture_ends_where_html_ends_it(inside, want):
    weights = hx.DEFAULT_WEIGHTS | {"tag": -0.1}
    for page in (f"<body><article>{inside}</article>", f"<div><article><p>Start</p></div>{inside}</article>"):
        got = hx.extract(page + "<article><p>After it all</p></article>", weights)
        assert got.removeprefix("Start\n") == want + "\nAfter it all"


def test_furniture_scan_is_linear_in_open_elements():
    page = "<article><div class=ad>" + "<span><div><p>" * 20_000 + "</b></i></li>" * 20_000 + "</article>Kept text"
    start = time.process_time()
    assert hx.extract(page, hx.DEFAULT_WEIGHTS) == "Kept text" and time.process_time() - start < 20


def test_extraction_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain words only"),
            (5, "u", "<div class=ad>never closed <article><p>Kept text.</p>"), (6, "u", "a < b & c &lt; d <"),
            (7, "u", "<p>" + "w " * 50_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, "
                                                                "n_chars int")
    out = hx.extract_pages(pages).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and got[2] == got[3] == "" and got[5] == "Kept text." and got[None]
    assert got[6] == "a < b & c < d <" and all(r.n_chars == len(r.text) for r in out)
    assert got[7] == " ".join(["w"] * 50_000)
    assert hx.extract_pages(pages.limit(0)).count() == 0


def test_dictionaries_reach_beyond_a_shared_opening(make_docs):
    opening, rng = "shared opening of every text " * 60, random.Random(3)
    docs = make_docs([(i, opening + " ".join("".join(rng.choices("bcdfgaeiou", k=7)) for _ in range(2_000)), "en")
                      for i in range(20)])
    words = li.fit(docs)["en"].decode().split()
    assert len(" ".join(words)) > 20 * 1_000
    assert sum(w in ("shared", "opening", "of", "every", "text") for w in words) < len(words) / 4


@pytest.mark.parametrize("inside, text", [
    ("<p>One</p><svg class='i' viewBox='0 0 1 1'/><p>Two</p><math/><p>Three</p>", "One\nTwo\nThree"),
    ("<p>One</p><svg><path d='M0'/><title>icon</title></svg><p>Two</p>", "One\nTwo"),
    ("<p>One</p><svg title='a>b'/><p>Two</p>", "One\nTwo"),
    ("<select-box>Text</select-box><p>Two</p>", "Text\nTwo"),
    ("<title-card><p>Here</p></title-card><p>Two</p>", "Here\nTwo"),
    ("<p>One</p><script-note>kept</script-note><p>Two</p>", "One\nkept\nTwo"),
    ("<p>One</p><select><option>x</select><p>Two</p>", "One\nTwo"),
    ("<p>One</p><canvas><p>Two, never closed</p>", "One\nTwo, never closed"),
    ("<p>One</p><script>if (a < b) {}</script><p>Two</p>", "One\nTwo"),
    ("<h2 id='form'>Form</h2><p class='notice-period'>Four weeks</p>", "Form\nFour weeks"),
    ("<p>One</p><p class='ad'>Buy</p><div class='share-buttons'>Share</div><p>Two</p>", "One\nTwo"),
])
def test_articles_keep_their_text(inside, text):
    from sosrank.llm import html_extraction as he

    page = f"<html><body><nav>Menu</nav><article>{inside}</article><footer>Imprint</footer></body></html>"
    assert he.extract(page, he.DEFAULT_WEIGHTS) == text
