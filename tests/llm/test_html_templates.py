from claimspark.llm import html_text

SCHEMA = "page_id long, url string, html string"


def test_blocks_on_a_small_share_of_a_large_host_are_templates(spark):
    n, rows = 200, []
    for k in range(n):
        blocks = f'<div class="box"><span>Offer {k % 20} of the week</span></div><div class="z9">Partner {k % 50}</div>'  # on 5 % and 2 % of the pages
        rows.append((k, f"http://big.org/{k}", f'<nav>Menu {k % 20}</nav><div><p>Story {k}</p></div>{blocks}<div class="once">Only {k // 2}</div>'))
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    known = html_text.templates(html_text.subtrees(pages))
    got = {r.page_id: r.text for r in html_text.main_text(pages, known).collect()}
    assert got == {k: f"Story {k}\nOnly {k // 2}" for k in range(n)}
    menus = {html_text._signed(node.digest) for _, _, page in rows for node in html_text.walk(html_text.parse(page)) if node.tag == "nav"}
    assert len(menus) == 20 and menus <= {r.subtree for r in known.collect()}


def test_templates_of_one_host_do_not_reach_another(spark):
    block = '<div class="z">Same block</div>'
    rows = [(k, f"http://a{k // 4}.org/{k}", f"<div><p>Story {k}</p></div>{block}") for k in range(6)] + [(9, None, f"<p>x</p>{block}")]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in html_text.main_text(pages, html_text.templates(html_text.subtrees(pages))).collect()}
    assert got == {k: f"Story {k}" if k < 4 else f"Story {k}\nSame block" for k in range(6)} | {9: "x\nSame block"}


def texts(spark, pages, off=False):
    rows = spark.createDataFrame([(k, f"http://site.org/{k}", page) for k, page in enumerate(pages)], SCHEMA).repartition(4)
    known = html_text.templates(html_text.subtrees(rows))
    return {r.page_id: r.text for r in html_text.main_text(rows, known.limit(0) if off else known).collect()}


def test_recurring_blocks_beside_other_text_stay(spark):
    recipe = ("<h1>Recipe {0}</h1><h2>Ingredients</h2><ul><li>1 cup sugar</li><li>{0} eggs</li></ul><h2>Method</h2><p>Beat {0} times.</p><p>Serve at once.</p>")
    want = "Recipe {0}\nIngredients\n1 cup sugar\n{0} eggs\nMethod\nBeat {0} times.\nServe at once."
    around = '<div class="q1"><ul><li><a href="/">Start</a></li><li><a href="/x">All</a></li></ul></div><div class="q2">{}</div><p>All rights stay with us.</p>'
    got = texts(spark, [f"<body>{around.format('<div>' + recipe.format(k) + '</div>')}</body>" for k in range(40)])
    # q2 stays for its text, the closing line goes: no block beside it varies
    assert got == {k: want.format(k) for k in range(40)}
    divs = [f"<body><div>Step {k}</div><div>Stir well.</div><div class='w'>Good to know</div></body>" for k in range(6)]
    assert texts(spark, divs) == {k: f"Step {k}\nStir well." for k in range(6)}


def test_templates_decide_on_neutral_names(spark):
    pages = [f'<div class="k1">Shop {k % 3}</div><div class="k2"><p>Story {k}</p></div><div class="k3"><p>Sign here</p></div>' for k in range(12)]
    on, off = texts(spark, pages), texts(spark, pages, off=True)
    assert on == {k: f"Story {k}" for k in range(12)} and off == {k: f"Shop {k % 3}\nStory {k}\nSign here" for k in range(12)}


def test_named_wrappers_and_teasers(spark):
    story = "<h1>Title</h1><p>" + "word " * 30 + "</p>"
    want = "Title\n" + ("word " * 30).strip()
    one = lambda page: html_text.extract(page)
    assert one(f'<div class="page side-by-side">{story}</div>') == want
    assert one(f'<div id="search-open">{story}</div>') == want
    assert one(f"<body><form>{story}</form></body>") == want
    assert one(f"<body><form><article>{story}</article></form></body>") == want
    assert one(f'<article><a href="/x">Read on</a></article><div class="post">{story}</div>') == want
    assert one(f"<div>Short story</div><div class='comments'>{story}</div>") == "Short story"
    assert one(f"<article>Short</article><div class='ad'>{story}</div>") == "Short"
