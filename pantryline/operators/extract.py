"""Landed pages to candidate rows, by patterns alone. A null page gives no rows.

Elements are found by a pass over a page's tags with a stack (``elements``), within the row: blocks of the same tag lie inside each
other as deep as they like.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pantryline.functions import profiles, text

PRICE = r"\$\d+(?:\.\d{2})?"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}


def strip_tags(html: Column) -> Column:
    """Markup out, the common entities decoded, white space single."""
    out = F.regexp_replace(html, r"<[^>]*>", "")
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_text(html: Column) -> Column:
    """P0. Visible text: no scripts, styles and comments, a line for each block."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|li|ul|ol|tr|table|h[1-6]|br|article|section|nav|title|header|footer)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def text_lines(df: DataFrame, key: str, content: Column, low: int, high: int) -> DataFrame:
    """P1. (key, line_no, line): trimmed lines of a length within the bounds."""
    return df.select(key, F.posexplode(F.split(content, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).filter(F.length("line").between(low, high))


#: Elements without content, and those that the next of their name ends if nothing else has.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ENDED_BY_NEXT = ("li", "p", "tr", "td", "th", "dt", "dd", "option")
TAG = r"</?[A-Za-z][^>]*>"
UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
ELEMENT = "name string, tag string, start int, end int, up int"


def elements(html: Column) -> Column:
    """The elements of a page without scripts, styles and comments, in the order of their ends: (name, tag, start, end, up).

    ``start`` and ``end`` are the places of the content, from 0; ``up`` is the start of the element round it, or -1. An end tag also ends
    what was opened within and has no end; one without a beginning counts for nothing; what is still open at the end ends there.
    """
    tags, named = re.compile(TAG), re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)")

    def found(s: str) -> list[dict]:
        stack, out = [], []

        def close(n: int, end: int) -> None:
            out.extend({**stack.pop(), "end": end} for _ in range(n))

        for m in tags.finditer(s):
            t, after = m[0], m.end()
            name, ends = named.match(t)[1].lower(), t.startswith("</")
            if ends:
                close(next((i for i, e in enumerate(reversed(stack), 1) if e["name"] == name), 0), m.start())
                continue
            if name in ENDED_BY_NEXT and stack and stack[-1]["name"] == name:
                close(1, m.start())
            e = {"name": name, "tag": t, "start": after, "end": after, "up": stack[-1]["start"] if stack else -1}
            (out if name in VOID or t.endswith("/>") else stack).append(e)
        close(len(stack), len(s))
        return out

    kind = pa.list_(pa.struct([("name", pa.string()), ("tag", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("up", pa.int32())]))

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if s is None else found(s) for s in pages.to_pylist()], kind)

    return F.arrow_udf(run, f"array<struct<{', '.join(c.replace(' ', ':') for c in ELEMENT.split(', '))}>>")(html)


def _inner(html: str, e: Column) -> Column:
    return F.substring(F.col(html), e["start"] + 1, e["end"] - e["start"])


def _with_elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, _h: the page without scripts and the like, _e: its elements by their start)."""
    seen = df.select(key, F.regexp_replace(html, UNSEEN, "").alias("_h"))
    return seen.withColumn("_e", F.sort_array(F.transform(elements(F.col("_h")), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["up"].alias("up"), e["name"].alias("name"), e["tag"].alias("tag")))))


def _named(*names: str) -> Column:
    return F.filter("_e", lambda e: e["name"].isin(*names))


def _attribute(name: str, pattern: str) -> str:
    """A pattern for tags whose attribute matches a pattern, in either kind of quotes."""
    return rf"""(?is)\s{name}\s*=\s*(?:"[^"]*(?:{pattern})[^"]*"|'[^']*(?:{pattern})[^']*')"""


def list_items(df: DataFrame, key: str, html: str, evidence: str = r"(?i)\$|price|menu") -> DataFrame:
    """P2. (key, list_no, item_no, item) of lists that show ``evidence`` in two or more of their first five items.

    A list's items are those directly in it; an item's text includes that of a list within.
    """
    pages = _with_elements(df, key, html).withColumn("_li", _named("li"))
    lists = pages.select(key, "_h", "_li", F.posexplode(_named("ul")).alias("list_no", "_u"))
    mine = F.filter("_li", lambda e: e["up"] == F.col("_u")["start"])
    lists = lists.withColumn("_items", F.transform(mine, lambda e: strip_tags(_inner("_h", e))))
    shown = F.size(F.filter(F.slice("_items", 1, 5), lambda x: x.rlike(evidence))) >= 2
    return lists.filter(shown).select(key, "list_no", F.posexplode("_items").alias("item_no", "item"))


def table_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """P3. (key, row_no, name, price): the first cell and the price in the last one, of table rows with two or more cells.

    A row's cells are those directly in it; a table within a cell has rows of its own.
    """
    pages = _with_elements(df, key, html).withColumn("_td", _named("td", "th"))
    rows = pages.select(key, "_h", "_td", F.posexplode(_named("tr")).alias("row_no", "_r"))
    mine = F.filter("_td", lambda e: e["up"] == F.col("_r")["start"])
    rows = rows.withColumn("_cells", F.transform(mine, lambda e: strip_tags(_inner("_h", e)))).filter(F.size("_cells") >= 2)
    return rows.select(key, "row_no", F.col("_cells")[0].alias("name"), F.nullif(F.regexp_extract(F.element_at("_cells", -1), PRICE, 0), F.lit("")).alias("price"))


HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """P4. (key, pos, href, text) of links; an address stands in double quotes, in single ones, or in none."""
    found = lambda i: F.regexp_extract_all(html, F.lit(HREF), F.lit(i))
    both = F.arrays_zip(found(1).alias("a"), found(2).alias("b"), found(3).alias("c"), F.transform(found(4), strip_tags).alias("text"))
    return df.select(key, F.posexplode(both).alias("pos", "_l")).select(key, "pos", F.concat("_l.a", "_l.b", "_l.c").alias("href"), F.col("_l.text").alias("text"))


def name_price_pairs(df: DataFrame, key: str, content: Column, pattern: str = r"([A-Z][A-Za-z ,&'-]{2,60}?)[ .]*\$(\d+(?:\.\d{2})?)", needs: list[str] | None = None, without: list[str] | None = None, longer: int = 0) -> DataFrame:
    """P5. (key, pos, name, price) of "name ... $price" in text.

    ``needs``, ``without``: words of which the lower-cased name has one, and none; ``longer``: than so many characters.
    """
    both = F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), 1).alias("name"), F.regexp_extract_all(content, F.lit(pattern), 2).alias("price"))
    rows = df.select(key, F.posexplode(both).alias("pos", "_p")).select(key, "pos", F.trim("_p.name").alias("name"), F.col("_p.price").alias("price"))
    low = F.lower("name")
    fits = (F.length("name") > longer) & (text.any_hit(low, needs) if needs else F.lit(True)) & (~text.any_hit(low, without) if without else F.lit(True))
    return rows.filter(fits)


def price_context(df: DataFrame, key: str, content: str, around: int = 100, first: int = 20, price: str = PRICE) -> DataFrame:
    """P6. (key, pos, price, name, description) of each of the ``first`` prices: the last line with text before it and the
    first after it, within ``around`` characters of its own place.
    """
    gaps, found = F.transform(F.split(content, price, -1), F.length), F.regexp_extract_all(content, F.lit(price), F.lit(0))
    rows = df.select(key, F.col(content), gaps.alias("_gaps"), found.alias("_found")).select(key, content, "_gaps", "_found", F.posexplode("_found").alias("pos", "price")).filter(F.col("pos") < first)
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    start = total(F.col("_gaps"), F.col("pos") + 1) + total(F.transform("_found", F.length), F.col("pos"))
    rows = rows.withColumn("_at", start).withColumn("_end", F.col("_at") + F.length("price"))
    low = F.greatest(F.col("_at") - around, F.lit(0))
    before = F.substring(F.col(content), low + 1, F.col("_at") - low)
    after = F.substring(F.col(content), F.col("_end") + 1, F.lit(around))
    filled = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(key, "pos", "price", F.try_element_at(filled(before), F.lit(-1)).alias("name"), F.get(filled(after), F.lit(0)).alias("description"))


def review_mentions(df: DataFrame, key: str, content: Column, patterns: list[str], most_words: int = 4) -> DataFrame:
    """P8. (key, pos, dish) of dishes that reviews name by the patterns' group 1, of ``most_words`` words at most."""
    found = F.flatten(F.array(*(F.regexp_extract_all(content, F.lit(p), 1) for p in patterns)))
    return df.select(key, F.posexplode(F.transform(found, lambda x: F.trim(x))).alias("pos", "dish")).filter((F.col("dish") != "") & (F.size(F.split("dish", r"\s+")) <= most_words))


def mention_confidence(dish: Column, review: Column, categories: list[tuple[str, list[str]]] = profiles.CATEGORY_REVIEWS) -> Column:
    """P8. 0.5, 0.1 for each cue in the review, 0.2 for a price in it, 0.15 for a dish of a known category, 0.3 less for one that is no
    food; from 0 to 1. Mentions over 0.3 count."""
    low = F.lower(dish)
    known = text.any_hit(low, [w for _, words in categories for w in words])
    score = F.lit(0.5) + text.hits(F.lower(review), profiles.CUES) * 0.1 + F.when(review.rlike(r"\$\d+"), 0.2).otherwise(0.0) + F.when(known, 0.15).otherwise(0.0) - F.when(text.any_hit(low, profiles.NOT_FOOD), 0.3).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def _first_within(block: Column, candidates: str) -> Column:
    """Of the elements in a column the first within a block; null if there is none."""
    return F.get(F.filter(candidates, lambda e: (e["start"] > block["start"]) & (e["end"] <= block["end"])), F.lit(0))


def class_blocks(df: DataFrame, key: str, html: str, classes: str = "item|dish|food") -> DataFrame:
    """P9. (key, pos, name, description, price) of elements whose class has one of the words, however deep what they hold lies.

    An element of such a class within another is a block of its own as well.
    """
    by_class = lambda words: lambda e: e["tag"].rlike(_attribute("class", words))
    pages = _with_elements(df, key, html).withColumns({"_names": _named("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b"), "_descs": F.filter("_e", by_class("desc|detail"))})
    rows = pages.select(key, "_h", "_names", "_descs", F.posexplode(F.filter(_named("div", "article", "section", "li"), by_class(classes))).alias("pos", "_b"))
    one = lambda column: text.let(text.let(_first_within(F.col("_b"), column), lambda e: strip_tags(_inner("_h", e))), lambda x: F.when(x != "", x))
    return rows.select(key, "pos", one("_names").alias("name"), one("_descs").alias("description"), F.nullif(F.regexp_extract(_inner("_h", F.col("_b")), PRICE, 0), F.lit("")).alias("price"))


def _scripts(df: DataFrame, key: str, html: str, kind: str) -> DataFrame:
    bodies = F.regexp_extract_all(html, F.lit(rf"(?is)<script\b{kind}[^>]*>(.*?)</script>"), 1)
    return df.select(key, F.posexplode(bodies).alias("script_no", "_s")).withColumn("_v", F.try_parse_json("_s")).filter("_v is not null")


def jsonld_items(df: DataFrame, key: str, html: str) -> DataFrame:
    """P10. (key, script_no, name, description, price, confidence) of schema.org menus.

    Items lie under a Menu or a Restaurant's hasMenu, in its sections or directly; an offer is an object or a list, of which
    the first counts. Confidence 0.9.
    """
    s = _scripts(df, key, html, r'[^>]*type="application/ld\+json"')
    many = lambda p: F.coalesce(F.try_variant_get("_v", p, "array<variant>"), F.transform(F.filter(F.array(F.try_variant_get("_v", p, "variant")), lambda x: x.isNotNull()), lambda x: x))
    roots = ("$", "$.hasMenu")
    sections = F.flatten(F.array(*(many(f"{r}.hasMenuSection") for r in roots)))
    direct = F.flatten(F.array(*(many(f"{r}.hasMenuItem") for r in roots)))
    inside = F.flatten(F.transform(sections, lambda x: F.coalesce(F.try_variant_get(x, "$.hasMenuItem", "array<variant>"), F.filter(F.array(F.try_variant_get(x, "$.hasMenuItem", "variant")), lambda y: y.isNotNull()))))
    rows = s.select(key, "script_no", F.explode(F.concat(inside, direct)).alias("_i"))
    get = lambda p: F.try_variant_get("_i", p, "string")
    return rows.select(key, "script_no", get("$.name").alias("name"), get("$.description").alias("description"), F.coalesce(get("$.offers.price"), get("$.offers[0].price")).alias("price"), F.lit(0.9).alias("confidence")).filter("name is not null")


JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]'


def objects_under(json: Column, name: str) -> Column:
    """The objects of a JSON text that stand under a name, alone or in lists, at any depth, as texts.

    One pass over the text's strings and brackets with a stack, in Python: a list hands its name to what is in it.
    """
    token, quoted = re.compile(JSON_TOKEN), f'"{name}"'

    def found(s: str) -> list[str]:
        stack, out, at, last = [], [], 0, ""
        for m in token.finditer(s):
            t, begin = m[0], m.start()
            if t in ("{", "["):
                # a value follows its name and a colon; within a list it has the list's
                named = last == quoted if s.find(":", at, begin) >= 0 else bool(stack) and stack[-1][1] and stack[-1][2]
                stack.append((begin, named, t == "["))
            elif t in ("}", "]") and stack:
                start, named, is_list = stack.pop()
                if named and not is_list:
                    out.append((start, m.end()))
            last, at = "" if t in ("{", "[", "}", "]") else t, m.end()
        return [s[i:j] for i, j in sorted(out)]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else found(s))

    return F.pandas_udf(run, "array<string>")(json)


def jsonld_items_anywhere(df: DataFrame, key: str, html: str) -> DataFrame:
    """P10. (key, script_no, name, description, price, confidence) of all lists or objects under ``hasMenuItem``, however deep they lie."""
    s = _scripts(df, key, html, r'[^>]*type="application/ld\+json"').select(key, "script_no", "_s")
    rows = s.select(key, "script_no", F.explode(objects_under(F.col("_s"), "hasMenuItem")).alias("_t")).withColumn("_i", F.try_parse_json("_t"))
    get = lambda p: F.try_variant_get("_i", p, "string")
    return rows.select(key, "script_no", get("$.name").alias("name"), get("$.description").alias("description"), F.coalesce(get("$.offers.price"), get("$.offers[0].price")).alias("price"), F.lit(0.9).alias("confidence")).filter("name is not null")


def microdata_items(df: DataFrame, key: str, html: str) -> DataFrame:
    """P11. (key, pos, name, description, price) of elements with an itemtype of MenuItem or Food.

    A property is the text of the first element in the block that has it, or its ``content`` where it has no text (as of ``meta``).
    """
    props = ("name", "description", "price")
    has = lambda p: lambda e: e["tag"].rlike(rf"""(?i)\sitemprop\s*=\s*["']?{p}\b""")
    pages = _with_elements(df, key, html).withColumns({f"_{p}s": F.filter("_e", has(p)) for p in props})
    blocks = F.filter(_named("div", "article", "section", "li"), lambda e: e["tag"].rlike(_attribute("itemtype", "MenuItem|Food")))
    rows = pages.select(key, "_h", *(f"_{p}s" for p in props), F.posexplode(blocks).alias("pos", "_b"))

    def value(p: str) -> Column:
        e = _first_within(F.col("_b"), f"_{p}s")
        content = F.regexp_extract(e["tag"], r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
        return F.coalesce(F.nullif(strip_tags(_inner("_h", e)), F.lit("")), F.nullif(strip_tags(content), F.lit(""))).alias(p)

    return rows.select(key, "pos", *map(value, props))


def embedded_items(df: DataFrame, key: str, html: str) -> DataFrame:
    """P12. (key, script_no, name, description, price) of lists under items, menu or products in any script of JSON."""
    s = _scripts(df, key, html, "")
    lists = F.flatten(F.array(*(F.coalesce(F.try_variant_get("_v", f"$.{p}", "array<variant>"), F.array().cast("array<variant>")) for p in ("items", "menu", "products"))))
    rows = s.select(key, "script_no", F.explode(lists).alias("_i"))
    get = lambda p: F.try_variant_get("_i", f"$.{p}", "string")
    return rows.select(key, "script_no", get("name").alias("name"), get("description").alias("description"), get("price").alias("price")).filter("name is not null")


def menu_text_items(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """P7. (key, line_no, name, price) of plain menu lines: section headers (no lower case) without a price are left out."""
    price = F.nullif(F.regexp_extract(line, PRICE, 0), F.lit(""))
    name = F.trim(F.regexp_replace(F.regexp_replace(line, PRICE, ""), r"[\s.\-]+$", ""))
    header = ~F.col(line).rlike("[a-z]")
    return lines.select(key, "line_no", name.alias("name"), price.alias("price"), header.alias("_h")).filter((F.col("price").isNotNull() | ~F.col("_h")) & (F.length("name") > 2)).drop("_h")


def union_strategies(*candidates: DataFrame) -> DataFrame:
    """U1, U3. Candidate lists one after the other, with their place as strategy_rank."""
    parts = [df.withColumn("strategy_rank", F.lit(i)) for i, df in enumerate(candidates)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rank_links(found: DataFrame, words: list[str], exact: list[str], least: int = 2) -> DataFrame:
    """S5. Links with a score of ``least`` or more: 3 for each word in the text, 2 in the address, 5 for an exact text."""
    text, href, score = F.lower(F.trim("text")), F.lower("href"), F.lit(0)
    for w in words:
        score = score + F.when(F.contains(text, F.lit(w)), 3).otherwise(0) + F.when(F.contains(href, F.lit(w)), 2).otherwise(0)
    score = score + F.when(text.isin(*exact), 5).otherwise(0)
    return found.filter("text != '' and href != ''").withColumn("score", score).filter(F.col("score") >= least)


def rank_links_by(found: DataFrame, profile: str) -> DataFrame:
    """S5. By a named profile of patterns, exact texts and address parts."""
    p = profiles.LINKS[profile]
    label, href, score = F.lower(F.trim("text")), F.lower("href"), F.lit(0)
    for pattern in p["patterns"]:
        score = score + F.when(label.rlike(pattern), 3).otherwise(0) + F.when(href.rlike(pattern), 2).otherwise(0)
    exact, points = p["exact"]
    parts, each = p["parts"]
    score = score + F.when(label.isin(*exact), points).otherwise(0) + text.hits(href, parts) * each
    return found.filter("text != '' and href != ''").withColumn("score", score).filter(F.col("score") >= p["least"])


def word_links(found: DataFrame, key: str, words: list[str] = profiles.LINK_WORDS, under: int = 50, first: int = 5) -> DataFrame:
    """S5. The ``first`` different addresses of each key whose link's text has a word and under ``under`` characters, in their order."""
    label = F.lower(F.trim("text"))
    some = found.filter((F.col("href") != "") & (label != "") & text.any_hit(label, words) & (F.length(label) < under))
    distinct = some.groupBy(key, "href").agg(F.min("pos").alias("pos"))
    return distinct.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("_r") <= first).drop("_r")


def pick_website(found: DataFrame, key: str, score: Column, first: int = 15, over: float = 3) -> DataFrame:
    """S6. Of each key's ``first`` links the one with the highest score over ``over``, the first of equals."""
    some = found.filter(F.col("pos") < first).withColumn("score", score).filter(F.col("score") > over)
    return some.groupBy(key).agg(F.max_by("href", F.struct("score", -F.col("pos"))).alias("website"), F.max("score").alias("score"))
