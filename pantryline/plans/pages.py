"""Queries of page extraction over the landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryline.functions import profiles, text
from pantryline.operators import extract
from pantryline.plans.base import Tables, query
from pantryline.plans.menus import number, q, some

BLOCK = "</?(?:p|div|li|ul|ol|tr|table|h[1-6]|br|article|section|nav|title|header|footer)\\b[^>]*>"
TEXT = f"""replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g'), '(?i){BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')"""


@query(f"SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, {TEXT} AS x FROM pages)")
def p0_page_text(t: Tables) -> DataFrame:
    """Visible text of every page."""
    return t.pages.select("page_id", extract.page_text(F.col("html")).alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


@query(f"WITH l AS (SELECT page_id, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS line_no, trim(unnest(string_split(x, chr(10)))) AS line FROM (SELECT page_id, {TEXT} AS x FROM pages)) SELECT page_id, line_no, line FROM l WHERE length(line) BETWEEN 5 AND 200")
def p1_text_lines(t: Tables) -> DataFrame:
    """Lines of pages that could be items."""
    return extract.text_lines(t.pages, "page_id", extract.page_text(F.col("html")), 5, 200)


ITEM = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(y, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"""
WITH l AS (SELECT page_id, generate_subscripts(u, 1) - 1 AS list_no, unnest(u) AS u FROM (SELECT page_id, regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1) AS u FROM pages)),
i AS (SELECT page_id, list_no, list_transform(regexp_extract_all(u, '(?is)<li\\b[^>]*>(.*?)</li>', 1), lambda y: {ITEM}) AS items FROM l)
SELECT page_id, list_no, generate_subscripts(items, 1) - 1 AS item_no, unnest(items) AS item FROM i WHERE len(list_filter(items[1:5], lambda x: regexp_matches(x, '(?i)the|on|en'))) >= 2
""")
def p2_list_items(t: Tables) -> DataFrame:
    """Items of lists that show evidence."""
    return extract.list_items(t.pages, "page_id", "html", r"(?i)the|on|en")


HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*?)</a>"""
LINKS = rf"""(SELECT page_id, generate_subscripts(x, 1) - 1 AS pos, coalesce(unnest(a), '') || coalesce(unnest(b), '') || coalesce(unnest(c), '') AS href, trim(regexp_replace(regexp_replace(unnest(x), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text
FROM (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS a, regexp_extract_all(html, '{HREF}', 2) AS b, regexp_extract_all(html, '{HREF}', 3) AS c, regexp_extract_all(html, '{HREF}', 4) AS x FROM pages))"""


@query(f"SELECT page_id, pos, href, text FROM {LINKS}")
def p4_links(t: Tables) -> DataFrame:
    """All links."""
    return extract.links(t.pages, "page_id", "html")


@query("SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, unnest(['in double', 'in single', 'in none']) AS text FROM (SELECT page_id, [url, url, replace(url, ' ', '')] AS h FROM pages WHERE NOT contains(url, chr(34)) AND NOT contains(url, chr(39)) AND NOT contains(url, '>'))")
def p4_quotes(t: Tables) -> DataFrame:
    """Links to every page, in double quotes, in single ones and in none."""
    url = F.col("url")
    html = F.concat(F.lit('<A class="x" href = "'), url, F.lit("\">in <b>double</b></A><a data-href='no' href='"), url, F.lit("'\n>in single</a><a href="), F.replace(url, F.lit(" "), F.lit("")), F.lit(' class=x>in none</a><a name="x">no</a>'))
    rows = t.pages.filter(~url.contains('"') & ~url.contains("'") & ~url.contains(">"))
    return extract.links(rows.select("page_id", html.alias("html")), "page_id", "html")


@query(f"SELECT page_id, pos, score FROM (SELECT page_id, pos, CASE WHEN contains(lower(text), 'the') THEN 3 ELSE 0 END + CASE WHEN contains(lower(href), 'the') THEN 2 ELSE 0 END + CASE WHEN lower(text) IN ('the') THEN 5 ELSE 0 END AS score FROM {LINKS} WHERE text <> '' AND href <> '') WHERE score >= 2")
def s5_t21_rank_links(t: Tables) -> DataFrame:
    """Links that score."""
    return extract.rank_links(extract.links(t.pages, "page_id", "html"), ["the"], ["the"]).select("page_id", "pos", "score")


@query(f"SELECT page_id, arg_max(href, (score, -pos)) AS website, max(score)::DOUBLE AS score FROM (SELECT page_id, pos, href, length(href) % 9 AS score FROM {LINKS} WHERE pos < 15) WHERE score > 3 GROUP BY 1")
def s6_pick_website(t: Tables) -> DataFrame:
    """The best link of each page."""
    return extract.pick_website(extract.links(t.pages, "page_id", "html"), "page_id", (F.length("href") % 9).cast("double"))


@query("SELECT page_id FROM (SELECT page_id, NOT contains(lower(html), 'captcha') AND (list_sum(list_transform(['menu', 'food', 'the', 'article', 'price', '$'], lambda w: contains(lower(html), w)::INT)) + 2 * len(regexp_extract_all(html, '\\$\\d+\\.\\d{2}|\\$\\d+'))) >= 3 AS ok FROM pages) WHERE ok")
def f15_page_gate(t: Tables) -> DataFrame:
    """Pages with enough evidence."""
    return t.pages.filter(text.page_gate(F.col("html"), ["captcha"], ["menu", "food", "the", "article", "price", "$"], 3)).select("page_id")


@query("SELECT page_id, NOT contains(lower(url), 'example.net') AS usable, contains(lower(url), 'blog') OR contains(lower(url), 'feed') AS named FROM pages WHERE NOT regexp_matches(url, '^(?i:javascript:|#)')")
def f16_f17_url_filters(t: Tables) -> DataFrame:
    """Addresses by domain, and by words of a name."""
    url = F.col("url")
    rows = t.pages.filter(text.usable_url(url, []))
    return rows.select("page_id", text.usable_url(url, ["example.net"]).alias("usable"), text.name_in_url(url, F.lit("my blog feed")).alias("named"))


@query("SELECT page_id, (contains(lower(u), 'menu') OR contains(lower(u), 'food')) AND NOT (contains(lower(u), 'logo') OR contains(lower(u), 'icon')) AS wanted FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/Menu.JPG' WHEN 1 THEN '/menu-logo.png' WHEN 2 THEN '/food.webp' ELSE '/x.png' END AS u FROM pages)")
def f17_menu_images(t: Tables) -> DataFrame:
    """Addresses of images that could show a menu."""
    k = F.col("page_id") % 4
    u = F.concat("url", F.when(k == 0, "/Menu.JPG").when(k == 1, "/menu-logo.png").when(k == 2, "/food.webp").otherwise("/x.png"))
    return t.pages.select("page_id", text.menu_image_url(u, ["menu", "food"], ["logo", "icon"]).alias("wanted"))


def _prices(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({c}, {q(p)}))" for p in patterns) + ")"


GATES = {
    "production": f"NOT {some('low', profiles.CHALLENGE_PRODUCTION)}",
    "ultimate": f"NOT {some('low', profiles.CHALLENGE_ULTIMATE)}",
    "final": f"NOT {some('low', profiles.CHALLENGE_FINAL)} AND {number('low', profiles.PAGE_FINAL)} >= 3",
    "dynamic": f"{number('low', profiles.PAGE_DYNAMIC)} + {number('seen', profiles.PAGE_DYNAMIC)} + 3 * {_prices('x', [chr(92) + '$' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd{2})?'])} + 2 * (page_id % 3) >= 10",
    "priority": f"{number('seen', profiles.FOOD_PRIORITY)} + 2 * {_prices('x', profiles.PRICE_PRIORITY)} + {number('seen', profiles.PAGE_PRIORITY)} + 0.5 * (page_id % 3) >= 8",
}
#: A few words below each page, so that gates open and shut.
BELOW = ["", " our menu: grilled chicken $12 and soup $5.50", " please verify that you are human", " food, price, order: $9, $8 and USD 7.50", " lunch and dinner, fresh fish, rice, bread and cheese"]


@query(f"SELECT page_id, {', '.join(f'coalesce({sql}, FALSE) AS {name}' for name, sql in GATES.items())} FROM (SELECT page_id, lower(html || b) AS low, {TEXT.replace('(html,', '(html || b,', 1)} AS x, lower({TEXT.replace('(html,', '(html || b,', 1)}) AS seen FROM (SELECT *, {'[' + ', '.join(map(q, BELOW)) + ']'}[page_id % 5 + 1] AS b FROM pages))")
def f15_page_gates(t: Tables) -> DataFrame:
    """Every page by the five profiles of the gate."""
    html = F.concat("html", F.element_at(text.strings(BELOW), (F.col("page_id") % 5 + 1).cast("int")))
    n = F.col("page_id") % 3
    pages = t.pages.select("page_id", html.alias("html")).select("page_id", "html", extract.page_text(F.col("html")).alias("text"))
    return pages.select("page_id", *(text.page_gate_by(p, F.col("html"), F.col("text"), n if p in ("dynamic", "priority") else None).alias(p) for p in GATES))


@query("SELECT page_id, pos, price, name FROM (SELECT page_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS price, trim(unnest(n)) AS name FROM (SELECT page_id, regexp_extract_all(x, '([a-z]+) \\$(\\d+(?:\\.\\d{2})?)', 2) AS p, regexp_extract_all(x, '([a-z]+) \\$(\\d+(?:\\.\\d{2})?)', 1) AS n FROM (SELECT page_id, html || ' soup $' || page_id || '.50, tea $3' AS x FROM pages)))")
def p5_name_price_pairs(t: Tables) -> DataFrame:
    """Words before prices, of pages that end with a line of a menu."""
    content = F.concat("html", F.lit(" soup $"), F.col("page_id").cast("string"), F.lit(".50, tea $3"))
    return extract.name_price_pairs(t.pages, "page_id", content, r"([a-z]+) \$(\d+(?:\.\d{2})?)").select("page_id", "pos", "price", "name")


@query("""
SELECT page_id, 0 AS pos, '$' || page_id AS price, 'Soup of day ' || page_id AS name, 'with bread' AS description FROM pages
UNION ALL SELECT page_id, 1, '$2.50', 'Tea', 'hot' FROM pages
""")
def p6_price_context(t: Tables) -> DataFrame:
    """Lines round prices of a menu below each page."""
    n = F.col("page_id").cast("string")
    below = F.concat(F.repeat(F.lit("x"), 150), F.lit("\nSoup of day "), n, F.lit("\n$"), n, F.lit("\nwith bread\n"), F.repeat(F.lit("y"), 150), F.lit("\nTea $2.50\nhot"))
    content = F.concat(F.replace(F.replace(extract.page_text(F.col("html")), F.lit("$"), F.lit("")), F.lit("\n"), F.lit(" ")), below)
    return extract.price_context(t.pages.select("page_id", content.alias("content")), "page_id", "content")


@query(r"SELECT conv_id, turn, generate_subscripts(d, 1) - 1 AS pos, trim(unnest(d)) AS dish FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?:the|of) ([a-z]+) (?:is|was)', 1) AS d FROM conversations)")
def p8_review_mentions(t: Tables) -> DataFrame:
    """What is named in a phrase."""
    rows = t.conversations.withColumn("k", F.struct("conv_id", "turn"))
    return extract.review_mentions(rows, "k", F.col("text"), ["(?:the|of) ([a-z]+) (?:is|was)"]).select("k.conv_id", "k.turn", "pos", "dish")


@query(f"SELECT strategy_rank, count(*) AS n FROM (SELECT 0 AS strategy_rank FROM {LINKS} UNION ALL SELECT 1 FROM pages) GROUP BY 1")
def u1_union_strategies(t: Tables) -> DataFrame:
    """Candidates of two strategies."""
    both = extract.union_strategies(extract.links(t.pages, "page_id", "html"), t.pages.select("page_id", F.col("url").alias("href")))
    return both.groupBy("strategy_rank").agg(F.count("*").alias("n"))
