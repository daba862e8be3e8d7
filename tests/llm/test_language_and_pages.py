import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import documents, odd_texts

from treeledger.llm import language, page_text, queries, url_rules

SYLLABLES = {"xa": "ka ru mi to ne so".split(), "xb": "bl str ing th ou er".split(), "xc": "čo žu řa ně ší vy".split()}


def made_up(spark, n=900):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
        rows.append((i, text.capitalize() + ".", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_models_are_distributions():
    rng = random.Random(1)
    counts = []
    for _ in range(2):
        codes = Counter()
        for _ in range(60):
            word = [0, 0, 0] + [rng.choice([2, 3, 4, 5]) for _ in range(8)] + [0]
            for i in range(3, len(word)):
                codes[sum(word[i - k] << 16 * k for k in range(4))] += 1
        keys = np.array(sorted(codes), np.uint64)
        counts.append((keys, np.array([codes[int(k)] for k in keys])))
    tables = language.kneser_ney(counts, 6)
    for context in [(0, 0, 0), (2, 3, 4), (5, 5, 5), (1, 1, 1), (0, 0, 2), (7, 7, 7)]:
        head = sum(c << 16 * (3 - i) for i, c in enumerate(context))
        logs = language.log_probabilities(np.array([head | x for x in range(8)], np.uint64), tables)
        assert np.allclose(np.exp(logs).sum(axis=0), 1, atol=1e-4), context


def test_held_out_accuracy_and_odd_texts(spark):
    docs = made_up(spark)
    model = language.fit(docs)
    rows = language.identify(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 150 and sum(r.lang_pred == r.lang for r in held) > 0.98 * len(held)
    assert sum(r.accepted for r in held) > 0.9 * len(held)
    odd = documents(spark, odd_texts() + ["1234 !!", "漢字漢字"], LANG_PRED="x", score=1)
    for r in language.identify(odd, model).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in SYLLABLES) == letters and (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (letters or not r.score)
    foreign = language.identify(odd.where("text = '漢字漢字'"), model).first()
    assert not foreign.accepted


def test_held_out_rows_teach_nothing(spark):
    docs = made_up(spark, 300)
    wrong = docs.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 4 = 2 THEN 'zzz' ELSE text END AS text",
                            "CASE WHEN crc32(string(doc_id)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    ours, theirs = language.fit(docs), language.fit(wrong)
    assert theirs.languages == ours.languages == sorted(SYLLABLES)
    assert all(np.array_equal(a, b) for x, y in zip(ours.tables, theirs.tables) for a, b in zip(x, y))


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [None, "", "abc"]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    model = language.fit(docs)
    assert {(r.lang_pred, r.score) for r in language.identify(docs, model).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), model).collect() == []


def page(i, article, extra="", main="article"):
    return (f"<html><head><title>T{i}</title><script>if (a<b) x='</p>'</script></head><body><header>Site {i}</header>"
            f"<nav><ul><li><a href=x>Menu {i}</a></ul></nav><div class='cookie-notice'>We use {i}</div>"
            f"<{main}>{article}{extra}</{main}><aside>Side {i}</aside><div id=comments><p>Reader {i}</div>"
            f"<form><label>Mail</label><input></form><footer>Foot</footer>")


def test_extracts_articles_only():
    article = "<header><h1>Head &amp; more</h1></header><p>One<b>two</b>\n  three<br>four<p>Five &#233;&nbsp;<i>six</i><ul><li>a<li>b</ul>"
    want = "Head & more Onetwo three four Five é six a b"
    for main in ("article", "main"):
        assert page_text.Page(page(1, article, main=main)).text() == want
    # Without either, a header cannot be told from the site's.
    assert page_text.Page(page(1, article, main="div")).text() == want.removeprefix("Head & more ")
    assert page_text.Page("").text() == "" and page_text.Page("plain &lt; text").text() == "plain < text"
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert page_text.Page(deep).text() == "core"
    assert page_text.Page("<p>a<!-- no --><p>b<script>never closed").text() == "a b"
    assert page_text.Page("<ul>" + "<li>x" * 3000 + "</ul>").text() == " ".join("x" * 3000)


def test_wrapper_drops_constant_slots(spark):
    share = "<div><p>Read this with our app</p></div>"
    rows = [(i, f"http://Host.example/{i}", page(i, f"<h1>Title {i}</h1><p>Story {i} goes on.", share)) for i in range(400)]
    rows += [(900 + i, "http://lonely.example/", page(i, f"<p>Alone {i}", share)) for i in range(2)]
    rows += [(1000, None, None), (1001, "no scheme", ""), (1001, "no scheme", ""), (None, "http://x/", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS host", "2 AS block")
    got = page_text.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert all(texts[i] == f"Title {i} Story {i} goes on." for i in range(400))
    assert texts[900] == "Alone 0 Read this with our app" and texts[1000] == texts[1001] == "" and texts[None] == "y"
    assert all(r.n_chars == len(r.text) for r in got)
    assert page_text.extract(pages.limit(0)).collect() == []


def test_tree_matching_aligns_in_order():
    a = page_text.parse("<div><p>x</p><table></table><p>y</p></div>")
    b = page_text.parse("<div><h2>new</h2><p>x</p><p>z</p></div>")
    size, pairs = page_text.matching(a, b)
    assert size == 4 and [x.tag for x, _ in pairs].count("p") == 2


def direct_verdict(url, rules, defaults):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = rest[:end], rest[end:]
        path = tail[:next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [[(len(h + p), v == "block", h + p, v) for v, h, p in some if (host == h or host.endswith("." + h)) and path.startswith(p)]
            for some in (rules, defaults)]
    best = [max(f) if f else None for f in fits]
    return host, path, best[0] and best[0][2], (best[0] or best[1] or (0, 0, 0, "allow"))[3], best[1] and best[1][2]


def test_rules_against_direct_search(spark):
    rng = random.Random(8)
    labels, paths = ["a", "b", "net", "org", "ex", "É", ""], ["", "/", "/x", "/x/", "/x/y", "/é/"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))

    rules = list({(rng.choice(["allow", "block"]), host(), rng.choice(paths)) for _ in range(60)})
    defaults = list({(rng.choice(["allow", "block"]), host(), rng.choice(paths)) for _ in range(10)})
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(['', 'www.', 'X.'])}{host()}{rng.choice(paths)}{rng.choice(['', '?a/b', '#://x', 'z'])}"
            for _ in range(600)] + [None, "", "nothing", "://", "a://b://c/d", "http://ho\x00st.net/"] + ["http://a.net/x"] * 300
    pages = spark.createDataFrame([(i % 500, u) for i, u in enumerate(urls)], "page_id int, url string").selectExpr("*", "1 AS host", "2 AS key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = url_rules.judge(pages, url_rules.rule_table(spark, rules, defaults)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(i % 500, *direct_verdict(u, rules, defaults)) for i, u in enumerate(urls)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark)).collect() == []


def test_url_query_judges_by_default_rules_too(spark, tmp_path):
    ads, spam = "ads-track.example.org", "spam-farm.example.org"
    want = {"http://ads-track.example.org": (None, "block", ads), "x://M.Spam-Farm.example.ORG/de/1?q": (None, "block", spam),
            "http://a.b.ads-track.example.org/fr/2": ("org/fr/", "allow", ads), "http://spam-farm.example.org/fr": (None, "block", spam),
            "http://bads-track.example.org/": (None, "allow", None), "http://spam-farm.example.org.net/": ("net/", "block", None),
            "http://example.org/spam-farm.example.org": (None, "allow", None), "spam-farm.example.org": (None, "allow", None),
            "http://example.net/en/": ("example.net/en/", "allow", None), None: (None, "allow", None)}
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op3_urls"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict, r.default_rule) for r in got] == list(want.values())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert sorted(map(tuple, got)) == sorted(con.execute(queries.SQL["op3_urls"]).fetchall())


def test_all_main_regions_and_broken_sections():
    def text(html):
        return page_text.Page(html).text()

    assert text("<h1 class='main-title'>T</h1><div class='content'><p>one two three</div>") == "T one two three"
    assert text("<p>Site</p><main><p>one</main><main><p>two</main>") == "one two"
    assert text("<p>Site</p><div class='main-column'><p>one two three four</div><div id=main>x</div>") == "one two three four"
    assert text("<div role=main><main><p>only once</main></div>") == "only once"
    assert text("<p>a<![foo x]>b</p><p>c<![ >d</p><![if !IE]><p>e<![endif]><p>f<![cdata[g]]>h<![").split()[:1] == ["ab"]
    for broken in ("<![foo x]>", "<![>", "<![ >", "<![1]>", "<![if !IE]>", "<![endif]>"):
        assert text(f"<p>before</p>{broken}<p>after</p>") == "before after", broken


def dropped(pages):
    wrapper = page_text.induce(pages)
    return {block.text for p in pages for block, slot in zip(p.blocks, p.slots) if slot in wrapper}


def test_wide_pages_are_aligned_in_order():
    pages = [page_text.Page("<article>" + "".join(f"<p>Line {i} {k}" for k in range(120 + i)) + "<p>Read this with our app</article>")
             for i in range(5)]
    found = page_text.induce(pages)
    assert dropped(pages) == {"Read this with our app"}
    assert all("our app" not in p.text(found) and p.text(found).endswith(f"Line {i} {119 + i}") for i, p in enumerate(pages))
    a, b = (page_text.parse("<div>" + "<p>x</p>" * n + "<table></table></div>") for n in (2000, 1990))
    size, pairs = page_text.matching(a, b)
    assert size == len(pairs) == 1 + 1 + 1990 + 1


def test_copies_of_an_article_are_no_wrapper():
    def made(lines):
        return page_text.Page("<article>" + "".join(f"<p>{line}</p>" for line in lines) + "<div><p>Read this with our app</p></div></article>")

    def copies(n):
        return [[f"Paragraph {k} of a story that was changed once" if k != i else f"Changed line {i}" for k in range(9)] for i in range(n)]

    others = [[f"Another story {i} goes on for {k} lines" for k in range(6)] for i in range(4)]
    assert page_text.induce([made(lines) for lines in copies(3)]) == frozenset()
    assert page_text.induce([made(lines) for lines in copies(8)]) == frozenset()
    for pages in (copies(6) + others[:2], others[:2] + copies(6), copies(4) + others):
        assert dropped([made(lines) for lines in pages]) == {"Read this with our app"}
    cited = [lines + (["The same quotation stands in both of these"] if i < 2 else []) for i, lines in enumerate(others)]
    assert dropped([made(lines) for lines in cited]) == {"Read this with our app"}


def test_every_page_of_a_host_teaches_and_meets_one_wrapper(spark):
    def story(i):
        return "".join(f"<p>Story {i} has a line {k}" for k in range(3))

    def made(i):
        if i % 3 == 0:  # a second layout, with a text of its own
            return f"<body class=mobile><article>{story(i)}<div><p>Get the mobile edition</div></article>"
        # Many pages lack the text, and a hot part is copies of one article.
        body = story(i) if i % 5 else "<p>One copied story<p>with the same lines<p>on many pages"
        return f"<body class=wide><article>{body}" + ("<div><p>Read this with our app</div>" if i % 4 else "") + "</article>"

    rows = [(i, f"http://hot.example/{i}", made(i)) for i in range(700)]
    rows += [(1000 + i, "http://copies.example/", f"<article><p>Same text<p>in all of them<p>again and again<p>Edit {i % 4}</article>")
             for i in range(12)]
    rows += [(2000 + i, "http://repeated.example/", f"<article>{story(max(i - 7, 0))}<div><p>Share</div></article>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in page_text.extract(pages).collect()}
    assert len(texts) == len(rows)
    for i in range(700):
        assert "edition" not in texts[i] and "our app" not in texts[i], (i, texts[i])
        want = "One copied story" if i % 3 and i % 5 == 0 else f"Story {i} has a line 0"
        assert texts[i].startswith(want)
    assert all(texts[1000 + i] == f"Same text in all of them again and again Edit {i % 4}" for i in range(12))
    assert all("Share" not in texts[2000 + i] and "has a line 2" in texts[2000 + i] for i in range(12))
    for host in ("hot", "copies", "repeated"):
        own = [page_text.Page(html) for _, url, html in rows if host in url]
        wrapper = page_text.induce(own)
        assert [texts[i] for i, url, _ in rows if host in url] == [page.text(wrapper) for page in own]


def test_all_of_250_languages_and_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(250):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
        words = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)]
        rows += [(f"l{i:03}", " ".join(rng.choice(words) for _ in range(30))) for _ in range(6)]
    rows = [(j, text, lang) for j, (lang, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 250
    some = docs.where("doc_id % 40 = 0")
    got = {r.doc_id: r.lang_pred for r in language.identify(some, model, keep=["doc_id"]).collect()}
    assert sum(got[j] == lang for j, _, lang in rows if j in got) >= 0.95 * len(got)
    texts = [(text * 40).encode() for _, text, _ in rows[:3]]
    whole = language.cross_entropies(texts, model)[1]
    monkeypatch.setattr(language, "HELD", 250 * 700)
    assert abs(language.cross_entropies(texts, model)[1] - whole).max() < 1e-9
    with pytest.raises(ValueError):
        language.fit(docs, model_bytes=1000)


@pytest.mark.parametrize("html, text", [
    ("<!doctype html><html><head><title>T</title><body><article><p>Hello world</p></article>", "Hello world"),
    ("<html><head><title>T<body><article><p>Hello world</p></article>", "Hello world"),
    ("<head><meta charset=x>Loose <p>text</p>", "Loose text"),
    ('<article><h2 id="related-work">Related work</h2><p>text', "Related work text"),
    ('<article><h2 id="search-methods">A</h2><h2 id="social-policy">B</h2><div class="share-price">12</div>'
     '<p>Now <span class="ad">AD 79</span> and <a class="related">link</a></p></article>', "A B 12 Now AD 79 and link"),
    ('<article><p>in</p><div class="related-posts">out</div><ul class="comment-list"><li>out</ul><div class="ad">out</div>'
     '<section id="site-footer">out</section><div role="search">out</div></article>', "in"),
    ('<body><form id="aspnetForm"><main><p>Body text</p></main></form>', "Body text"),
    ("<body><div><button>Go <p>the rest of the page</p><p>stays</p></div>", "Go the rest of the page stays"),
    ("<article><p>a</p><form><input><button>Send</button></form><p>and more of it</p></article><form>short</form>", "a and more of it"),
    ("<main><h1>Story</h1><p>A long story of its own, of many words.</p><article>one</article><article>two</article></main>",
     "Story A long story of its own, of many words. one two"),
    ("<main><h1>Blog</h1><article><p>post one, long</p></article><article><p>post two, long</p></article></main>",
     "post one, long post two, long")])
def test_articles_are_kept(html, text):
    assert page_text.Page(html).text() == text


def test_tree_matching_against_all_matchings():
    """The size of a matching is that of the best choice of pairs in order, tried one by one."""
    rng = random.Random(6)

    def tree(depth):
        return rng.choice("ps") if depth == 0 else f"<{(t := rng.choice(['div', 'section']))}>" + "".join(
            f"<p>{rng.randrange(3)}</p>" if rng.random() < 0.5 else tree(depth - 1) for _ in range(rng.randrange(4))) + f"</{t}>"

    def best(a, b):
        if a.tag != b.tag:
            return 0
        ours, theirs = page_text.elements(a), page_text.elements(b)

        def pairs(i, j):
            if i == len(ours) or j == len(theirs):
                return 0
            return max(pairs(i + 1, j), pairs(i, j + 1), best(ours[i], theirs[j]) + pairs(i + 1, j + 1))

        return 1 + pairs(0, 0)

    for _ in range(60):
        a, b = (page_text.parse(f"<body>{tree(3)}{tree(2)}</body>") for _ in range(2))
        size, found = page_text.matching(a, b)
        assert size == best(a, b) == len(found)
