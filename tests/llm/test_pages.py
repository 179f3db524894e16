import random

from corpus import sentence

from logwarden.llm.pages import StyleTree, extract, importance, read


def pages(spark, rows):
    more = "text string, host string, path string, m long, value long, kind string"
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], f"page_id long, url string, html string, {more}")


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


NAMED = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>menu<li><a>more</ul></nav><div class="cookie-notice">accept</div><!-- ad --><div class="ad">buy</div>
<main><article class=post><header><h1>T&eacute;st &amp; more</h1></header><p>One <b>tw</b>o&nbsp;x<br>three<p>four
five<form><p>mail</p></form><table><tr><td>c1<td>c2</table><aside>see also</aside><div id="share-buttons">share</div><noscript>no</noscript>
<pre>a
  b</pre></article><section id=comments><article><p>reader</p></article></section></main><footer>&copy; f</footer>"""


def test_named_parts_go_and_the_article_stays(spark):
    assert texts(extract(pages(spark, [(1, "http://a.org/1", NAMED)]))) == {1: "Tést & more One two x three four five c1 c2 a b"}


def test_unnamed_branches_go_by_the_style_tree_of_their_host(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(30):
        own = [sentence(rng) for _ in range(3)]
        body = "".join(f"<p>{s}</p>" for s in own)
        menu = "<div class=q1><span class=k>Home</span><span class=k>News</span></div>"
        share = f"<div class=v{i}>Tell a friend</div>"
        rows.append((i, f"https://site{i % 3}.org/{i}", f"<body>{menu}<div class=w>{body}</div><div class=z>Fine print</div></body>" if i % 2 else
                     f"<body>{menu}<article>{body}{share}</article></body>"))
        want[i] = " ".join(own)
    assert texts(extract(pages(spark, rows))) == want
    scores = {(r.host, r.path): r.score for r in importance(pages(spark, rows)).collect()}
    assert scores["site0.org", "body>div.w>p"] == 1 and scores["site0.org", "body>div.q"] == 0


def test_copies_and_rare_branches_stay(spark):
    copy = "<article><p>The same on all pages</p><div class=w>also here</div></article>"
    rows = [(i, "http://copies.org/", copy) for i in range(9)] + [(20 + i, "http://few.org", "<div class=z>Twice only</div>") for i in range(2)] + [
        (30 + i, "http://bare.org", "<div class=z>Always this</div>") for i in range(9)]
    got = texts(extract(pages(spark, rows)))
    assert got[0].startswith("The same on all pages") and got[20] == "Twice only" and got[30] == "Always this"


def test_copies_of_an_article_keep_its_inner_container(spark):
    one, two = ("<article><h1>Head</h1><div class=inner><p>The body of it</p></div></article>", "<article><h1>Other</h1><div class=inner><p>Another body</p></div></article>")
    rows = [(i, f"http://one.org/?q={i}", one) for i in range(6)] + [(10 + i, f"http://two.org/?q={i}", (one, two)[i % 2]) for i in range(20)]
    got = texts(extract(pages(spark, rows)))
    assert {got[i] for i in range(6)} == {"Head The body of it"}
    assert {got[10 + i] for i in range(20)} == {"Head The body of it", "Other Another body"}


def test_odd_pages(spark):
    long = "<p>" + "word &lt;b&gt; " * 100_000
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "plain text"), (None, "http://x.org", "<p>a"), (4, "http://x.org", long), (4, "http://x.org", long),
            (5, "HTTP://user@X.org:80/a", "<p>unclosed <b>bold <i>it<p>next</div></span>"), (6, "http://x.org", "<div hidden>no</div><p style='display: none'>no</p>yes &#x41;&bogus;")]
    docs = pages(spark, rows)
    out = extract(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "plain text" and by[None] == "a" and by[5] == "unclosed bold it next" and by[6] == "yes A&bogus;"
    assert by[4] == " ".join(["word <b>"] * 100_000)
    assert extract(pages(spark, [])).collect() == []


def test_paths_follow_html_rules_for_unclosed_elements():
    found = [(path, text) for path, _, text in read("<ul><li>a<li>b<ul><li>c</ul></ul><dl><dt>d<dd>e</dl><p>f<div>g</div>").blocks]
    assert found == [("ul>li", "a"), ("ul>li", "b"), ("ul>li>ul>li", "c"), ("dl>dt", "d"), ("dl>dd", "e"), ("p", "f"), ("div", "g")]


def test_low_threshold_keeps_all(spark):
    rows = [(i, "http://a.org", f"<div class=a>same</div><div class=b>own {i} text</div>") for i in range(8)]
    assert texts(extract(pages(spark, rows), StyleTree(least=0.0)))[3] == "same own 3 text"
    assert texts(extract(pages(spark, rows)))[3] == "own 3 text"
