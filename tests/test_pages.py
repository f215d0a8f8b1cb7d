"""Extraction from inline pages."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from pantryline.operators import extract


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_text_and_lines(spark):
    df = pages(spark, "<style>x</style><p>A &amp; B</p><script>no</script><div>second<br>third</div><!-- c -->", None)
    x = df.select(extract.page_text(F.col("html")).alias("t")).first()["t"]
    assert [y for y in x.split("\n") if y] == ["A & B", "second", "third"]
    assert [r["line"] for r in extract.text_lines(df, "page_id", extract.page_text(F.col("html")), 5, 200).collect()] == ["A & B", "second", "third"]


def test_lists_and_tables(spark):
    df = pages(spark, "<ul><li>Soup $5</li><li><b>Cake</b> $6</li><li>x</li></ul><ul><li>$1</li><li>no</li></ul>", "<table><tr><th>Dish</th><th>Price</th></tr><tr><td>Tea</td><td>hot</td><td>now $2.50</td></tr><tr><td>one</td></tr></table>")
    assert [(r["list_no"], r["item"]) for r in extract.list_items(df, "page_id", "html").orderBy("item_no").collect()] == [(0, "Soup $5"), (0, "Cake $6"), (0, "x")]
    assert [(r["name"], r["price"]) for r in extract.table_rows(df, "page_id", "html").orderBy("row_no").collect()] == [("Dish", None), ("Tea", "$2.50")]


def test_price_context(spark):
    content = "Menu\nSoup of the day\n$5\nwith bread\nTea $2 Cake $2\nsweet " + "x" * 150 + "\n$7.50"
    df = spark.createDataFrame([(1, content), (2, None), (3, "$9 first")], "page_id long, content string")
    got = {(r["page_id"], r["pos"]): r for r in extract.price_context(df, "page_id", "content").collect()}
    for pos, m in enumerate(re.finditer(extract.PRICE, content)):
        before = [x.strip() for x in content[max(0, m.start() - 100) : m.start()].split("\n") if x.strip()]
        after = [x.strip() for x in content[m.end() : m.end() + 100].split("\n") if x.strip()]
        r = got[1, pos]
        assert (r["price"], r["name"], r["description"]) == (m[0], before[-1] if before else None, after[0] if after else None)
    assert (got[3, 0]["name"], got[3, 0]["description"]) == (None, "first") and len(got) == 5


def test_blocks(spark):
    df = pages(spark, '<div class="menu-item big"><h3>Soup</h3><p class="desc">hot</p><span>$4.50</span></div><div class="x">no</div>', '<div itemscope itemtype="http://schema.org/MenuItem"><span itemprop="name">Tea</span><span itemprop="price">3</span></div>')
    assert [tuple(r) for r in extract.class_blocks(df, "page_id", "html").collect()] == [(0, 0, "Soup", "hot", "$4.50")]
    assert [tuple(r) for r in extract.microdata_items(df, "page_id", "html").collect()] == [(1, 0, "Tea", None, "3")]


def test_json(spark):
    ld = '<script type="application/ld+json">{"@type":"Restaurant","hasMenu":{"hasMenuSection":[{"name":"A","hasMenuItem":[{"name":"Soup","offers":{"price":"5"}},{"name":"Cake","description":"d","offers":[{"price":6}]}]},{"hasMenuItem":{"name":"Single"}}]}}</script>'
    direct = '<script type="application/ld+json">{"@type":"Menu","hasMenuItem":[{"name":"Tea"},{"price":1}]}</script><script type="application/ld+json">broken</script>'
    got = extract.jsonld_items(pages(spark, ld, direct, None), "page_id", "html").collect()
    assert sorted((r["page_id"], r["name"], r["price"]) for r in got if r["price"]) == [(0, "Cake", "6"), (0, "Soup", "5")]
    assert {r["name"] for r in got} == {"Soup", "Cake", "Single", "Tea"} and all(r["confidence"] == 0.9 for r in got)
    other = extract.embedded_items(pages(spark, '<script>{"menu":[{"name":"Pie","price":2.5}],"x":1}</script><script>var a=1</script>'), "page_id", "html")
    assert [(r["name"], r["price"]) for r in other.collect()] == [("Pie", "2.5")]


def test_menu_lines_and_reviews(spark):
    lines = spark.createDataFrame([(1, 0, "STARTERS"), (1, 1, "Soup .... $5.00"), (1, 2, "Bread"), (1, 3, "WINE $9")], "page_id long, line_no int, line string")
    got = extract.menu_text_items(lines, "page_id").orderBy("line_no").collect()
    assert [(r["name"], r["price"]) for r in got] == [("Soup", "$5.00"), ("Bread", None), ("WINE", "$9")]
    reviews = spark.createDataFrame([(1, "I ordered the crab cakes. The soup was delicious")], "id int, t string")
    assert [r["dish"] for r in extract.review_mentions(reviews, "id", F.col("t"), [r"ordered the ([a-z ]+)", r"[Tt]he (\w+) was delicious"]).collect()] == ["crab cakes", "soup"]


def test_nested_markup(spark):
    inner = '<div class="menu-item"><div class="hd"><h3>Soup</h3></div><div class="desc">a <div>b</div></div><div><div>$4.50</div></div></div>'
    df = pages(spark, f"<div class='x'>{inner}</div></div><li class='food'>left open <b>Tea</b>", None, "", "no tags > at < all", '<script>"<div class=item>"</script>')
    assert [tuple(r) for r in extract.class_blocks(df, "page_id", "html").orderBy("page_id", "pos").collect()] == [(0, 0, "Soup", "a b", "$4.50"), (0, 1, "Tea", None, None)]


def test_elements_are_those_of_a_stack(spark):
    """Random tags against a loop."""
    rng = random.Random(9)
    names = ["div", "p", "b", "li", "br", "td"]
    html = ["".join(rng.choice([f"<{n} a=1>", f"</{n}>", "x", "text "]) for n in rng.choices(names, k=rng.randrange(40))) for _ in range(60)]

    def loop(text):
        stack, out, up = [], [], lambda: stack[-1][2] if stack else -1

        def end(at):
            name, tag, start, of = stack.pop()
            out.append((name, tag, start, at, of))

        for m in re.finditer(extract.TAG, text):
            name = re.match(r"</?(\w+)", m[0])[1]
            open_names = [x[0] for x in stack]
            if m[0].startswith("</"):
                last = None
                while name in open_names and last != name:
                    last = stack[-1][0]
                    end(m.start())
            else:
                if name in extract.ENDED_BY_NEXT and open_names[-1:] == [name]:
                    end(m.start())
                if name in extract.VOID:
                    out.append((name, m[0], m.end(), m.end(), up()))
                else:
                    stack.append((name, m[0], m.end(), up()))
        while stack:
            end(len(text))
        return out

    got = pages(spark, *html).orderBy("page_id").select(extract.elements(F.col("html")).alias("e")).collect()
    assert [[(e["name"], e["tag"], e["start"], e["end"], e["up"]) for e in r["e"]] for r in got] == [loop(x) for x in html]


def test_href_quotes(spark):
    df = pages(spark, """<a href='one two'>a</a><A class=x HREF=three>b</A><a data-href="no" href = "four">c</a><a>d</a><a href=''>e</a>""")
    assert [(r["href"], r["text"]) for r in extract.links(df, "page_id", "html").orderBy("pos").collect()] == [("one two", "a"), ("three", "b"), ("four", "c"), ("", "e")]


def test_deep_json_is_one_scan(spark):
    deep = '{"hasMenuItem":{"name":"D","offers":[{"price":3}]}}'
    for i in range(30):
        deep = f'{{"k":[{deep},"x{{"]}}' if i % 2 else f'{{"k":{deep},"z":"\\"]"}}'
    df = pages(spark, f'<script type="application/ld+json">{deep}</script>', '<script type="application/ld+json">{"hasMenuItem":[[{"name":"A"}],{"x":{"name":"no"}}]}</script>')
    out = extract.jsonld_items_anywhere(df, "page_id", "html")
    assert sorted((r["name"], r["price"]) for r in out.collect()) == [("A", None), ("D", "3")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2
