"""Language-model scores, fertility, toxicity and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pantryline.llm import fertility, ngram, queries, toxicity
from pantryline.llm.common import fold
from tests.llm.fixtures import corpus, docs, words


def tokens(text):
    return [*(text or "").encode().lower().split(), b" end"]


def plain_em(cells, order):
    """Mixture weights of one bucket from cells of (tokens, estimates)."""
    there = [any(ml[k] > 0 for _, ml in cells) for k in range(order + 1)]
    w = [x / sum(there) for x in there]
    total = sum(n for n, _ in cells)
    for _ in range(500):
        new = [0.0] * (order + 1)
        for n, ml in cells:
            p = sum(a * b for a, b in zip(w, ml, strict=True))
            for k in range(order + 1):
                new[k] += n * w[k] * ml[k] / p / total
        done = max(abs(a - b) for a, b in zip(new, w, strict=True)) < 1e-7
        w = new
        if done:
            break
    w[0] = max(w[0], 1e-6)
    return [x / sum(w) for x in w]


class PlainModel:
    """Deleted interpolation by loops over dictionaries."""

    def __init__(self, rows, order, train, heldout):
        self.order = order
        self.all, kept = self.counts([r for r in rows if train(r)]), self.counts([r for r in rows if train(r) and not heldout(r)])
        self.n, self.v = self.all[0][1].total(), len(self.all[0][1])
        n_kept, by_bucket = kept[0][1].total(), {}
        for r in rows:
            if train(r) and heldout(r):
                for bucket, c, ml in self.events(r[1], *kept):
                    code = bucket
                    for x in (c, *ml):
                        code = code * 1200 + (round(ngram.FINE * math.log2(x)) + 600 if x > 0 else 0)
                    by_bucket.setdefault(bucket, {}).setdefault(code, []).append((c / max(1, n_kept), *ml))
        found = {}
        for bucket, cells in by_bucket.items():
            means = [(len(x), [1 / (self.v + 1), *(sum(y) / len(x) for y in zip(*x, strict=True))]) for x in cells.values()]
            found[bucket] = plain_em(means, order)
        self.weights = []
        for b in range(64 * order):
            near = sorted((x for x in found if x // 64 == b // 64), key=lambda x: abs(x - b))
            k = b // 64 + 2
            self.weights.append(found[near[0]] if near else [1 / k] * k + [0.0] * (order + 1 - k))

    def counts(self, rows):
        grams, ctx = [Counter() for _ in range(self.order + 1)], [Counter() for _ in range(self.order + 1)]
        for r in rows:
            t = [None] * (self.order - 1) + tokens(r[1])
            for i in range(self.order - 1, len(t)):
                for k in range(1, self.order + 1):
                    grams[k][tuple(t[i - k + 1 : i + 1])] += 1
                    ctx[k][tuple(t[i - k + 1 : i])] += 1
        return grams, ctx

    def events(self, text, grams, ctx):
        t = [None] * (self.order - 1) + tokens(text)
        for i in range(self.order - 1, len(t)):
            above = [ctx[k][tuple(t[i - k + 1 : i])] for k in range(2, self.order + 1)]
            longest = max((k for k, c in enumerate(above, 1) if c), default=0)
            bucket = 64 * longest + int(math.log2(above[longest - 1])) if longest else 0
            yield bucket, grams[1][(t[i],)], [grams[k][tuple(t[i - k + 1 : i + 1])] / c if c else 0.0 for k, c in enumerate(above, 2)]

    def score(self, text):
        out = 0.0
        for bucket, c, ml in self.events(text, *self.all):
            w = self.weights[bucket]
            out += math.log10(w[0] / (self.v + 1) + w[1] * c / max(1, self.n) + sum(a * b for a, b in zip(w[2:], ml, strict=False)))
        return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_a_plain_model(spark, order):
    rows = corpus(3, 80)
    out = ngram.interpolated_scores(docs(spark, rows), fold(F.col("doc_id")) != 1, fold(F.col("doc_id")) == 2, order=order, unit_bytes=2000).collect()
    assert len(out) == len(rows)
    f = lambda r: zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5
    model = PlainModel(rows, order, lambda r: f(r) != 1, lambda r: f(r) == 2)
    count, n, v = model.all[0][1], model.n, model.v
    want = []
    for i, text, *_ in rows:
        t = tokens(text)
        want.append((i, len(t), sum(count[(w,)] > 0 for w in t), n, sum(math.log10((count[(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in t), model.score(text)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for got, exp in zip(sorted(map(tuple, out), key=key), sorted(want, key=key), strict=True):
        assert got[:4] == exp[:4]
        assert got[4:] == pytest.approx(exp[4:], rel=1e-9, abs=1e-9)


def test_ids_of_any_type_and_other_columns(spark):
    rows = corpus(3, 20)
    df = docs(spark, rows)
    flags = fold(F.col("doc_id")) != 1, fold(F.col("doc_id")) == 2
    want = sorted((str(r[0]), r[-1]) for r in ngram.interpolated_scores(df, *flags, unit_bytes=2000).collect())
    shuffled = ngram.interpolated_scores(df.repartition(3, "text"), *flags, unit_bytes=2000, write_first=True).collect()
    assert sorted((str(r[0]), r[-1]) for r in shuffled) == [(i, pytest.approx(x)) for i, x in want]
    for kind in ("string", "int"):
        other = df.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({x: F.lit("clash") for x in ("_id", "_text", "_part", "dest", "score", "unit")})
        got = ngram.interpolated_scores(other, *flags, unit_bytes=2000)
        assert got.schema["doc_id"].dataType.simpleString() == kind
        assert sorted((str(r[0]), r[-1]) for r in got.collect()) == [(i, pytest.approx(x)) for i, x in want]


def test_weights_come_from_held_out_tokens():
    n = np.array([50.0, 30.0, 20.0])
    ml = np.array([[0.01, 0.1, 0.5], [0.01, 0.2, 0.0], [0.01, 0.0, 0.0]])
    w = ngram.em_weights(n, ml)
    best = (n * np.log((ml * w).sum(1))).sum()
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x = rng.dirichlet(np.ones(3))
        assert (n * np.log((ml * x).sum(1))).sum() <= best + 1e-6
    assert ngram.em_weights(n, np.array([[0.01, 0.1, 0.0]] * 3))[2] == 0


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    text = [words(rng, 300, 20).encode() for _ in range(3)]
    t = ngram.Tokens.of(2, text)
    levels = {level: np.bincount(place)[place] for level, _, _, place in t.distinct(44)}
    event, ctx = ngram._counts(t, levels)
    ml = ngram._estimates(event, ctx)[0]
    u = t.numbers[np.flatnonzero(t.event) - 1]
    w = t.numbers[t.event]
    for c in np.unique(u):
        at = u == c
        _, first = np.unique(w[at], return_index=True)
        assert ml[at][first].sum() == pytest.approx(1)


def test_no_training_and_no_rows(spark):
    df = docs(spark, corpus(3, 5))
    out = ngram.interpolated_scores(df, F.lit(False), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(0, abs=1e-9) for r in out)
    assert ngram.interpolated_scores(df.limit(0), F.lit(True), F.lit(False)).count() == 0


def plain_measures(text):
    w = (text or "").encode().split()
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_counts(spark):
    rows = [*corpus(4), (700, "a b c\na b c\n \n \nd", "en", "s", 1), (701, "x y x y x y", "en", "s", 1), (702, "a|b #c <d>", "en", "s", 1)]
    got = fertility.measure(docs(spark, rows).withColumn("entropy", F.lit("clash")), queries.vocabularies()).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[x] for x in names) for r in got) == sorted(plain_measures(r[1]) for r in rows)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for r in got:
        ids = [i for w in (r["text"] or "").encode().split() for i in sp.encode(w.decode())]
        assert r["n_pieces"] == len(ids) and r["n_byte_pieces"] == sum(map(sp.is_byte, ids))
        c = Counter(ids)
        assert r["entropy"] == pytest.approx(-sum(x / len(ids) * math.log2(x / len(ids)) for x in c.values()), abs=1e-9)


def test_repeated_words_of_many_numbers():
    rng = np.random.default_rng(2)
    w = rng.integers(0, 5, 500) + (1 << 22)
    doc = np.repeat(np.arange(5), 100)
    small = fertility.repeated_words(w - (1 << 22), doc)
    assert (fertility.repeated_words(w, doc) == small).all()


def test_bands_reject_what_is_odd_for_its_language(spark):
    rng = random.Random(9)
    clean = [(i, words(rng, 200, 5000), ("en", None)[i % 2], "s", 0) for i in range(400)]
    odd = [(1000 + i, " ".join("日本" * 3 for _ in range(200)) + words(rng, 10), "en", "s", 0) for i in range(3)] + [(2000 + i, " ".join(f"{chr(0x10400 + rng.randrange(40))}{k}" for k in range(200)), None, "s", 0) for i in range(3)]
    short = [(3000, "too short", "en", "s", 0), (3001, None, "en", "s", 0)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in fertility.quality(docs(spark, clean + odd + short), queries.vocabularies()).collect()}
    assert sum(got[i][1] for i in range(400)) >= 398
    assert not any(got[i][1] for i in (1000, 1001, 1002, 2000, 2001, 2002)) and got[2000] == (False, False)
    assert got[3000] == got[3001] == (True, False)
    assert fertility.quality(docs(spark, clean).limit(0), queries.vocabularies()).count() == 0


def test_no_class_goes_without_bands(spark):
    rng = random.Random(14)
    known = "the house under their water between people morning window letter history another children country question small paper music river garden together thought always something mountain picture answer summer evening teacher village".split()
    prose = lambda n: " ".join(rng.choice(known) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(known) + rng.choice(["***", "$$$", "%%%"]) for _ in range(n))
    clean = [(i, prose(200), "en", "s", 0) for i in range(300)]
    rare = [(1000 + i, prose(700), "xx", "s", 0) for i in range(30)] + [(1100, prose(700), "yy", "s", 0)]
    odd = [(2000, junk(5000), "en", "s", 0), (2001, junk(700), "xx", "s", 0), (2002, junk(5000), "yy", "s", 0)]
    got = {r["doc_id"]: r for r in fertility.quality(docs(spark, clean + rare + odd), queries.vocabularies()).collect()}
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in (2000, 2001, 2002))
    assert all(got[i]["kept"] for i in [*range(1000, 1030), 1100])
    alone = [r["kept"] for r in fertility.quality(docs(spark, clean[:20] + odd[:1]), queries.vocabularies()).collect() if r["doc_id"] == 2000]
    assert alone == [False]


def plain_bands(rows, width=5.0, least=100):
    """{(language, length class): {measure: (low, high)}} by loops; ``rows``: measured ones."""
    from decimal import ROUND_HALF_UP, Decimal

    def measures(r):
        share = lambda a, b: a / b if b else 0.0
        return {"chars_per_piece": share(r["word_chars"], r["n_pieces"]), "chars_per_byte_token": share(r["word_chars"], r["n_byte_tokens"]), "byte_share": share(r["n_byte_pieces"], r["n_pieces"]), "entropy_rate": share(r["entropy"], math.log2(max(1, r["n_pieces"])))}

    def place(r):
        return r["lang"], int(math.log2(max(1, r["n_words"])))

    def band(some):
        out = {}
        for x, floor in fertility.MEASURES.items():
            values = [float(Decimal(repr(float(measures(r)[x]))).quantize(Decimal("0.001"), ROUND_HALF_UP)) for r in some]
            q = np.percentile(values, [25, 50, 75])
            spread = max((q[2] - q[0]) / 1.349, floor) * max(1.0, math.sqrt(least / len(some)))
            out[x] = (q[1] - width * spread, q[1] + width * spread)
        return out

    good = [r for r in rows if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]
    lists = {}
    for r in good:
        for k in (place(r), (r["lang"],), ("any length", place(r)[1]), "all"):
            lists.setdefault(k, []).append(r)
    limits = {}
    for lang, c in {place(r) for r in rows}:
        for head in (lang, "any length"):
            near = sorted((abs(k[1] - c), k[1]) for k, v in lists.items() if isinstance(k, tuple) and len(k) == 2 and k[0] == head and len(v) >= least)
            if near:
                steps, at = near[0]
                limits[lang, c] = {x: (low - steps * (high - low) / 2, high + steps * (high - low) / 2) for x, (low, high) in band(lists[head, at]).items()}
                break
            if head == lang and 10 * len(lists.get((lang,), [])) >= least:
                limits[lang, c] = band(lists[lang,])
                break
        else:
            limits[lang, c] = band(lists["all"])
    inside = lambda r: all(low <= measures(r)[x] <= high for x, (low, high) in limits[place(r)].items())
    return {r["doc_id"]: r in good and inside(r) for r in rows}


def test_verdicts_are_those_of_plain_bands(spark):
    rng = random.Random(19)
    rows = []
    for i in range(700):
        lang, n = rng.choice([("en", 90), ("en", 200), ("en", 700), ("de", 200), (None, 90), ("", 90), ("xx", 300), ("yy", 60)]) if i > 120 else ("en", 90)
        if lang == "yy" and rng.random() < 0.9:
            lang = "de"
        w = words(rng, n, 4000).split()
        for k in rng.sample(range(n), rng.choice([0] * 12 + [n // 20, n // 2, n])):
            w[k] += rng.choice(["***", "日本", "=====", "qzx"])
        rows.append((i, " ".join(w), lang, "s", 0))
    rows += [(900, "too short", "en", "s", 0), (901, None, None, "s", 0), (902, words(rng, 60, 4000), "alone", "s", 0), (903, words(rng, 9000, 9000), "xx", "s", 0)]
    df = docs(spark, rows)
    want = plain_bands(fertility.measure(df, queries.vocabularies()).collect())
    got = {r["doc_id"]: r["kept"] for r in fertility.quality(df, queries.vocabularies()).collect()}
    assert got == want and 20 < sum(not x for x in want.values()) < 600


def test_scores_are_sums_of_features(spark):
    rows, labels = toxic_fixture(random.Random(12))
    m = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    odd = [*corpus(6), *rows[:50], (9000, "idiot " * 3 + words(random.Random(1), 300), "en", "s", 0)]

    def plain(text):
        w = toxicity.TOKEN.findall((text or "").lower())
        stems = [x for y in w for x in (y, *("^" + y[:n] for n in range(3, 8) if len(y) > n))]
        z = m.intercept
        for x in set(stems):
            n = stems.count(x)
            z += m.weights.get(toxicity.number(x), 0.0)
            z += m.weights.get(toxicity.number(x, True), 0.0) if n > 1 and n * 128 >= len(w) else 0.0
        return 1 / (1 + math.exp(-z))

    got = toxicity.score(docs(spark, [r for r in odd if len(r[1] or "") < 5000]), m).collect()
    assert len(m.weights) > 10
    for r in got:
        assert r["score"] == pytest.approx(plain(r["text"]), rel=1e-9)


def toxic_fixture(rng):
    insults, groups = ["idiot", "scum", "moron"], ["muslim", "christian", "jewish", "hindu"]
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 40, 200).split()
        if i % 2:
            w.insert(5, rng.choice(insults))
            if i % 4 == 1:
                w.insert(7, "muslim")  # a bias: one group is named where insults are
        elif i % 8 == 0:
            w.insert(7, rng.choice(groups[1:]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, i % 2))
    return rows, labels


def test_group_mentions_move_no_score(spark):
    rng = random.Random(10)
    rows, labels = toxic_fixture(rng)
    df = docs(spark, rows)
    table = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (5, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    gaps, wrong = {}, {}
    for penalty in (0.0, 10.0):
        m = toxicity.train(df, table, fold(F.col("doc_id")) != 0, penalty=penalty)
        z = lambda s: m.logit(Counter(s.split()), {})  # noqa: B023, E731
        gaps[penalty] = abs(z("he is a muslim here") - z("he is a christian here"))
        out = toxicity.score(df, m).select("doc_id", "score").collect()
        held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
        wrong[penalty] = sum((r["score"] >= 0.5) != r["doc_id"] % 2 for r in held)
    assert gaps[10.0] < 0.2 * gaps[0.0] and gaps[10.0] < 0.3
    assert wrong[10.0] <= 0.05 * len(held)


def test_scores_of_odd_texts(spark):
    rows, labels = toxic_fixture(random.Random(11))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.train(docs(spark, rows), table, F.lit(True), most=50)
    odd = docs(spark, corpus(5)).withColumn("score", F.lit("clash"))
    got = toxicity.score(odd, m).collect()
    assert len(got) == len(corpus(5)) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.train(docs(spark, rows), table.limit(0), F.lit(True))
    assert none.intercept == 0.0 and toxicity.score(odd.limit(0), none).count() == 0
    one = toxicity.train(docs(spark, rows), table.filter("toxic = 0"), F.lit(True))
    assert one.weights == {} and one.intercept < -5


def test_swaps():
    c = Counter("a muslim and a muslim woman".split())
    got = toxicity.swapped(c)
    assert len(got) == 6 and all(x.total() == c.total() and x["muslim"] == 0 for x in got)
    assert Counter("a christian and a christian man".split()) in got
    assert toxicity.swapped(Counter(["plain"])) == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, words(rng, 150, 4000), "en", "s", 0) for i in range(250)]
    rows += [(1000, rows[0][1] + " tail", "en", "s", 0), (1001, rows[1][1], "en", "s", 0), (1002, "too short", "en", "s", 0), (1003, None, "en", "s", 0), (1004, rows[2][1] + " extra", "en", "s", 0)]
    item = words(rng, 40, 4000)
    rows.append((1005, words(rng, 80, 4000) + " " + item + " " + words(rng, 80, 4000), "en", "s", 0))
    labels = []
    for i in range(100, 140):
        rows[i] = (i, rows[i][1] + " idiot", "en", "s", 0)
        labels.append((i, 1, 1))
    labels += [(i, 1, 0) for i in range(100)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [i for i in range(250) if not 100 <= i < 140]
    assert all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in out)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("penalty", [0.0, 3.0])
def test_the_fit_minimises_its_objective(penalty):
    """Against plain gradient descent on a dense matrix: logistic loss, squared changes of the logit under swaps, and a ridge."""
    rng = random.Random(17)
    texts, labels = [], []
    for i in range(120):
        bad = i % 2
        group = ("men", "women")[rng.random() < (0.85 if bad else 0.15)]
        texts.append([group, *(["vile", "filth"] if bad and rng.random() < 0.8 else []), *(["calm", "tidy"] if not bad and rng.random() < 0.8 else []), *rng.choices(["a", "b", "c", "d"], k=6)])
        labels.append(bad)
    kinds = (("men", "women"),)
    counters = [Counter(x) for x in texts]
    x = [np.array(sorted(toxicity.features(c)), np.uint32) for c in counters]
    changed = [(i, np.array(sorted(toxicity.features(s)), np.uint32)) for i, c in enumerate(counters) for s in toxicity.swapped(c, kinds)]
    y = np.array(labels)
    must = {toxicity.number(s) for w in kinds[0] for s in toxicity.stems(w)}
    model = toxicity.fit(x, y, changed, 0.5, must, penalty=penalty, steps=1500)
    names = sorted(model.weights)
    dense = lambda rows: np.array([[float(n in set(r.tolist())) for n in names] for r in rows])
    a, b, base = dense(x), dense([r for _, r in changed]), np.array([i for i, _ in changed])

    def objective(w, bias):
        z = a @ w
        return np.mean(np.logaddexp(0, z + bias) - y * (z + bias)) + penalty * np.mean((z[base] - b @ w) ** 2) + 1e-4 / 2 * (w @ w)

    w, bias = np.zeros(len(names)), 0.0
    for _ in range(20_000):
        z = a @ w
        err = (1 / (1 + np.exp(-(z + bias))) - y) / len(y)
        diff = 2 * penalty * (z[base] - b @ w) / len(base)
        g = a.T @ err + (a[base] - b).T @ diff + 1e-4 * w
        w, bias = w - 0.05 * g, bias - 0.05 * err.sum()
    mine = np.array([model.weights[n] for n in names])
    assert {toxicity.number("vile"), toxicity.number("calm")} <= set(names)
    assert objective(mine, model.intercept) <= objective(w, bias) + 2e-3 < objective(np.zeros(len(names)), 0.0) - 0.2
    gap = abs(model.weights.get(toxicity.number("men"), 0) - model.weights.get(toxicity.number("women"), 0))
    assert gap < 0.3 if penalty else gap > 0.5
