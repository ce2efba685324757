"""Operators against brute force on small tables with nulls, empty, long and repeated texts, and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from listrank.llm import chat_format, decontam, licenses, line_dedup, mixing, quality_model, quality_rules, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size string, found string, score string"


def prose(rng, n, words="the of and river stone cloud walk green seven house".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    near = prose(rng, 150).split()
    texts += [" ".join(near), " ".join([*near[:-1], "altered"]), " ".join(near).upper(), " ".join(near) + "  ", None, "", " \n\t ", None]
    texts += ["A!" * 5_000 + " " + prose(rng, 20_000), "one two", "É K ſ naïve café", "x\ny\nx\nx\n\n", "a b c a b c a b c", "Released under the MIT  license.\nmit-LICENSE", "all reserved rights"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 0, "clash", None, "clash") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, "null id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def loose(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# 1


def test_targets_by_repeated_resharing(spark):
    rng = random.Random(1)
    for names in ([None, "a", "B", "é", "z", "zz"],) * 3 + ([None, *(f"host{i}" for i in range(300))],):
        sizes = {s: rng.choice([0, 1, 10, 1_000, 50_000]) for s in names}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        total, capped = 1.5 * sum(sizes.values()), set()
        while True:
            free = [s for s in order if s not in capped]
            left = total - sum(2 * sizes[s] for s in capped)
            want = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
            over = {s for s in free if want[s] > 2 * sizes[s] + 1e-9}
            if not over:
                break
            capped |= over
        for s in order:
            assert got[s] == pytest.approx(2 * sizes[s] if s in capped else want[s])


def test_targets_end_at_the_ceilings(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 0), (None, 5)], "source string, size long")
    for share in (2.0, 9.0):
        assert {r["source"]: r["target"] for r in mixing.source_targets(sizes, share=share).collect()} == {"a": 6.0, "b": 0.0, None: 10.0}
    assert mixing.source_targets(sizes.where("false")).count() == 0


def test_plans_do_not_depend_on_how_targets_meet_rows(monkeypatch, spark, docs):
    want = sorted(map(repr, mixing.plan_mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.plan_mix(docs).collect())) == want


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    table = [(i, "w " * rng.randint(1, 400), "en", rng.choice("aaaabc"), 0) for i in range(3_000)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    plans = [sorted(tuple(r) for r in mixing.plan_mix(df.repartition(n), fan_in=16).collect()) for n in (2, 7)]
    assert plans[0] == plans[1] and len(plans[0]) == 3_000
    taken, expected, target, largest = Counter(), Counter(), {}, Counter()
    for source, _, size, m, copies, total, goal in plans[0]:
        rate = goal / total
        assert m == 1 and math.floor(rate) <= copies <= math.ceil(rate - 1e-9) and copies <= 2
        taken[source] += copies * size
        expected[source] += rate - copies
        target[source], largest[source] = goal, max(largest[source], size)
    for s in target:
        assert abs(taken[s] - target[s]) < 0.03 * target[s] and abs(expected[s]) < 1 + 1e-6


def test_mix_of_repeated_rows_and_nulls(spark, docs, rows, empty):
    plan = {(r["source"], r["id"], r["size"]): r for r in mixing.plan_mix(docs).collect()}
    assert Counter((r[3], r[0], len(words(r[1]))) for r in rows) == {k: r["m"] for k, r in plan.items()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter((r["source"], r["doc_id"], len(words(r["text"]))) for r in mixed.collect())
    assert got == {k: r["copies"] for k, r in plan.items() if r["copies"]}
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_pivotal_rounding_keeps_probabilities(spark):
    table = [(i, "w", "en", "a" if i < 40 else "b", 0) for i in range(80)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    seen = Counter()
    for seed in range(6):
        plan = mixing.plan_mix(df, weights=(3.0, 5.0), share=1.0, fan_in=8, seed=1_000 * seed).collect()
        by = Counter()
        for r in plan:
            by[r["source"]] += r["copies"]
        assert by == {"a": 30, "b": 50}
        seen.update(r["id"] for r in plan if r["source"] == "a" and r["copies"])
    assert len(seen) > 38  # every document has its chance


# 2


def windows_of(items):
    out = {}
    for i, t in items:
        w = loose(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            out.setdefault(tuple(w[a : a + k]), set()).add(i)
    return out


@pytest.mark.parametrize("pass_bytes,shard_words", [(1 << 20, 1 << 20), (150, 64)])
def test_contamination_by_brute_force(spark, docs, rows, empty, pass_bytes, shard_words):
    rng = random.Random(3)
    long = next(r[1] for r in rows if r[1] and len(words(r[1])) > 150)
    items = [(1, " ".join(long.split()[5:40]).upper()), (2, "one two"), (3, None), (4, ""), (5, "b, c -- A"), (6, prose(rng, 12)), (17, "x"), (8, "x"), (None, " ".join(long.split()[60:80])), (None, "a b c"), (2, "café")]
    found = decontam.find_contamination(docs, spark.createDataFrame([(*i, "e") for i in items], "item_id long, text string, found string"), pass_bytes=pass_bytes, shard_words=shard_words)
    assert found.columns == [*[c for c in docs.columns if c != "found"], "found"]
    want = windows_of(items)
    expected = Counter()
    for r in rows:
        w, hit, ids = loose(r[1]), set(), set()
        for k in {len(x) for x in want}:
            for a in range(len(w) - k + 1):
                if (got := want.get(tuple(w[a : a + k]))) is not None:
                    ids |= got
                    hit.update(range(a, a + k))
        expected[(r[0], len(w), len(hit), tuple(sorted(ids, key=lambda i: (i is None, i or 0))))] += 1
    result = Counter()
    for r in found.collect():
        spans = [(s["start"], s["end"]) for s in r["found"]["spans"]]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        result[(r["doc_id"], r["found"]["n_words"], sum(b - a for a, b in spans), tuple(r["found"]["items"]))] += 1
    assert result == expected
    assert decontam.find_contamination(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.find_contamination(docs, spark.createDataFrame([], "item_id long, text string")).where("size(found.spans) > 0").count() == 0


def test_texts_without_words_do_not_pile_up():
    """Rows without words, or of few long ones, end a shard too."""
    benchmark = decontam.Benchmark([(1, b"one two")], 10)
    seen = []
    benchmark.find, find = lambda docs: seen.append(len(docs)) or find(docs), benchmark.find
    texts = [None, "", "?" * 4_000] * 512 + ["one two"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    out = list(decontam._pass(benchmark, 0, 1_000)([batch]))
    assert sum(b.num_rows for b in out) == len(texts) and max(seen) <= 1_256 and len(seen) > 1
    assert out[-1].column(1)[-1].as_py()["items"] == [1]


def test_passes_follow_one_another(spark, monkeypatch):
    """Of several passes, one broadcast is there at a time, and each is destroyed before the next is made."""
    context, alive, most = type(spark.sparkContext), [], []
    make = context.broadcast

    def broadcast(self, value):
        out = make(self, value)
        if isinstance(value, decontam.Benchmark):
            alive.append(out)
            most.append(len(alive))
            destroy = out.destroy
            out.destroy = lambda *a: (alive.remove(out), destroy(*a))
        return out

    monkeypatch.setattr(context, "broadcast", broadcast)
    docs = spark.createDataFrame([(i, f"one two three w{i}") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"two three w{i}") for i in range(0, 40, 2)], "item_id long, text string")
    found = decontam.find_contamination(docs, items, pass_bytes=60).select("doc_id", "found.items").collect()
    assert {r["doc_id"]: r["items"] for r in found} == {i: [] if i % 2 else [i] for i in range(40)}
    assert len(most) > 2 and max(most) == 1 and not alive


def test_windows_are_held_in_bounded_memory():
    """A benchmark's arrays cost some tens of bytes a word, however many windows its words make."""
    rng = random.Random(41)
    names = [f"w{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choice(names) for _ in range(2_000)).encode()) for i in range(200)]
    held = decontam.Benchmark(items, 10)
    n = sum(len(t.split()) for _, t in items)
    assert sum(sum(x.nbytes for x in parts) for parts in held.by_size.values()) + held.words.nbytes < 32 * n
    text = items[7][1].split()[100:130]
    ids = np.array([held.vocabulary[w] for w in text], np.int32)
    assert held.find([ids]) == [([(0, 30)], {7})]


def test_fm_index_against_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = np.concatenate([rng.integers(0, 4, n), [0]]).astype(np.int32)
        index = decontam.FMIndex(text, 3)
        for k in (1, 2, 5):
            phrases = rng.integers(1, 4, (20, k)).astype(np.int32)
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# 3


def test_base_rules_by_brute_force(docs, rows, empty):
    expected = Counter()
    for r in rows:
        t, w = r[1] or "", words(r[1])
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        expected[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed)] += 1
    judged = quality_rules.apply_rules(docs)
    got = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(tuple(r) for r in got) == expected
    assert judged.where("kept and base_failed").count() == 0
    assert quality_rules.apply_rules(empty).count() == 0


def test_junk_diverges(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, 200), "en") for i in range(50)]
    junk = [(100 + i, " ".join(x.upper() + "###$$$" for x in prose(rng, 200).split()), "en") for i in range(3)]
    judged = quality_rules.apply_rules(spark.createDataFrame(good + junk, "doc_id long, text string, lang string"))
    assert {r["doc_id"] for r in judged.where("kept").collect()} == {i for i, *_ in good}


@pytest.mark.parametrize("few", [True, False])
def test_common_words_of_languages_that_are_not_listed(spark, few, monkeypatch):
    """Found by brute force; word lists without them go, as far as the language has documents enough. A word of one
    long text is not common; a null language and a rare one decide nothing."""
    if not few:
        monkeypatch.setattr(quality_rules, "BROADCAST_LANGS", 0)
    rng = random.Random(5)
    usual = ["Ta", *(f"oft{i}" for i in range(13))]

    def text(common):
        return " ".join(rng.choice(usual) if rng.random() < common else f"w{rng.randint(0, 9_999):04}" for _ in range(200))
    good = [(i, text(0.4), "pt") for i in range(60)] + [(100, " ".join(f"long n{i}" for i in range(600)), "pt")]
    lists = [(200 + i, text(0.0), lang) for i, lang in enumerate(("pt", "pt", "rare", None))]
    rows = [*good, *lists, (300, None, "pt"), (301, "", "pt"), (302, "pt " * 200, "pt"), good[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, other_words string")
    passed = [r for r in rows if r[2] == "pt" and len(words(r[1])) >= 50 and r[0] != 302]
    counts = Counter(w for r in passed for w in {w.lower() for w in words(r[1])})
    assert Counter(w.lower() for r in passed for w in words(r[1])).most_common(1)[0][0] == "long"
    measured = quality_rules.cut(quality_rules.measure(df.select("doc_id", "lang", "text"))).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    assert [(r[0], r[1]) for r in quality_rules.common_words(measured).collect()] == [("pt", sorted(counts, key=lambda w: (-counts[w], w))[:12])]
    judged = quality_rules.apply_rules(df)
    assert {r["doc_id"] for r in judged.where("kept").collect()} >= {i for i, *_ in good[:60]} | {202, 203}
    assert {r["doc_id"] for r in judged.where("not kept and not base_failed and word_distance is not null").collect()} >= {200, 201}
    assert judged.count() == len(rows) and judged.where("word_distance is not null and (lang is null or lang = 'rare')").count() == 0


# 4


@pytest.mark.parametrize("ratio,least", [(0.3, 5), (line_dedup.RATIO, line_dedup.LEAST_PAGES)])
def test_boilerplate_by_brute_force(spark, ratio, least):
    rng = random.Random(6)
    pages = [(i, rng.choice(["a.com", "a.com", "b.org", None]), [rng.choice(["menu", "foot", f"own {i}", "menu"]) for _ in range(rng.randint(0, 5))]) for i in range(120)]
    pages += [(500, "solo.net", ["menu"]), (501, "a.com", None), pages[0], (None, "a.com", ["menu", "kept"])]
    df = spark.createDataFrame([(*p, "x") for p in pages], "id long, host string, lines array<string>, marks string")
    total = Counter(h for _, h, _ in pages)
    seen = Counter((h, x) for _, h, ls in pages for x in set(ls or []))
    drop = {(h, x) for (h, x), n in seen.items() if h and n >= least and n > ratio * total[h]}
    want = Counter((i, h, None if ls is None else tuple(x for x in ls if (h, x) not in drop)) for i, h, ls in pages)
    got = Counter((r["id"], r["host"], None if r["kept_lines"] is None else tuple(r["kept_lines"])) for r in line_dedup.drop_boilerplate(df, ratio, least).collect())
    assert got == want and drop
    assert line_dedup.drop_boilerplate(df.where("false")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_boilerplate_of_hot_hosts_and_odd_rows(spark, few, monkeypatch):
    """One host with most pages, very long and repeated lines, no host at all, and names that clash; lists of hosts by
    broadcast and by random copies."""
    if not few:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    long = "x" * 300_000
    pages = [(i, "hot.com", ["top", f"own {i}", "top", long], 1, "a") for i in range(40)] + [(100 + i, "few.com", ["top", ""], 1, "b") for i in range(4)] + [(None, None, [long, long], 1, "c"), (7, "hot.com", [], None, None), (8, "hot.com", None, None, None)]
    df = spark.createDataFrame(pages, "id long, host string, lines array<string>, pages int, _site string").repartition(4)
    out = line_dedup.drop_boilerplate(df, least_pages=5)
    assert out.columns == [*df.columns, "kept_lines"]
    want = Counter((i, h, None if x is None else tuple(y for y in x if h != "hot.com" or y not in ("top", long)), p, s) for i, h, x, p, s in pages)
    assert Counter((r["id"], r["host"], None if r["kept_lines"] is None else tuple(r["kept_lines"]), r["pages"], r["_site"]) for r in out.collect()) == want


def test_html_lines(spark):
    html = '<p>One <b>bold</b> line</p><script>var x="</p>";</script><ul><li> a </li><li></li></ul><!-- no -->tail'
    row = spark.createDataFrame([(html, "HTTP://A.Example.com:80/x?y"), (None, "nonsense")], "h string, u string").select(line_dedup.html_lines(F.col("h")), line_dedup.host_of(F.col("u"))).collect()
    assert row[0][0] == ["One bold line", "a", "tail"] and row[0][1] == "a.example.com" and tuple(row[1]) == (None, None)


# 5


def test_classifier_keeps_prose_and_rejects_junk(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 120) if i % 4 else "BUY!!! $$$ " * 60, "en", "s" + str(i % 3), 0) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None, None, None, 0), (901, "", "xx", "lonely", 0), rows[1]], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    out = quality_model.classify(df, labels).collect()
    assert len(out) == len(rows) + 3 and {r["doc_id"] for r in out if r["quality"]["kept"] and r["doc_id"] < 900} == {i for i in range(400) if i % 4}
    # brute force of the hierarchy from the documents' own scores
    group = Counter((r["source"], r["lang"]) for r in out)
    assert group[("lonely", "xx")] == 1
    lonely = next(r for r in out if r["source"] == "lonely")["quality"]
    rate = sum(r["quality"]["doc_score"] for r in out) / len(out)
    assert lonely["site_posterior"] == pytest.approx(rate) and lonely["path_posterior"] == pytest.approx(rate)
    assert quality_model.classify(df.where("false"), labels).count() == 0
    assert quality_model.classify(df, labels.where("false")).count() == len(out)


def hierarchy(rows, weight):
    """rows: (key, site, path, p). Posteriors and final scores of all rows, written out."""
    sites, paths = {}, {}
    for _, site, path, p in rows:
        sites.setdefault(site, []).append(p)
        paths.setdefault((site, path), []).append(p)
    rate = sum(p for *_, p in rows) / len(rows)

    def strength(groups):
        groups = [g for g in groups.values() if len(g) >= 2]
        if len(groups) < 2:
            return 10.0
        n, nn = sum(map(len, groups)), sum(len(g) ** 2 for g in groups)
        within = sum(p * (1 - p) for g in groups for p in g) / n
        spread = sum(len(g) * (sum(g) / len(g) - rate) ** 2 for g in groups)
        between = (spread - (len(groups) - 1) * within) / max(n - nn / n, 1e-9)
        return min(max(within / max(between, 1e-9), 1.0), 1e4)

    k_site, k_path = strength(sites), strength(paths)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for key, site, path, p in rows:
        s, q = sites[site], paths[site, path]
        at_site = (sum(s) - p + k_site * rate) / (len(s) - 1 + k_site)
        at_path = (sum(q) - p + k_path * at_site) / (len(q) - 1 + k_path)
        score = 1 / (1 + math.exp(-(logit(p) + weight * (logit(at_path) - logit(rate)))))
        out.append((key, at_site, at_path, score))
    return out


@pytest.mark.parametrize("few,keep_text", [(True, True), (False, True), (False, False)])
def test_hierarchy_by_brute_force(spark, few, keep_text, monkeypatch):
    """Every row's posteriors; groups by broadcast and by random copies; null, repeated and very long rows, clashing names."""
    if not few:
        monkeypatch.setattr(quality_model, "BROADCAST_ROWS", 0)
    rng = random.Random(17)
    rows = []
    for i in range(300):
        site = rng.choice(["big"] * 6 + ["b", "c", "d", None])
        good = rng.random() < {"big": 0.9, "b": 0.2, "c": 0.6}.get(site, 0.5)
        rows.append((i, prose(rng, rng.randint(1, 80)) if good else "$$$ BUY!!! 99% " * rng.randint(1, 40), rng.choice(["en", "de", None]), site, f"q{i}", "x"))
    rows += [(900, None, None, "lonely", "q", "x"), (901, "", "xx", None, "q", "x"), (902, "w " * 200_000, "en", "big", "q", "x"), (None, "no id", "en", "b", "q", "x"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality string, _site string").repartition(3)
    labels = spark.createDataFrame([(i, int("BUY" not in rows[i][1])) for i in range(0, 300, 2)] + [(1, None), (None, 1), (4, 0)], "doc_id long, quality int")
    out = quality_model.classify(df, labels, keep_text=keep_text, column="verdict")
    assert out.columns == [c for c in df.columns if keep_text or c != "text"] + ["verdict"]
    got = out.select("doc_id", "source", "lang", "verdict.*").collect()
    assert len(got) == len(rows) and len({round(r["doc_score"], 6) for r in got}) > 100
    want = hierarchy([(r["doc_id"], r["source"], r["lang"], r["doc_score"]) for r in got], quality_model.SITE_WEIGHT)
    for r, (key, at_site, at_path, score) in zip(got, want, strict=True):
        assert r["doc_id"] == key and (r["site_posterior"], r["path_posterior"], r["score"]) == pytest.approx((at_site, at_path, score), rel=1e-6)
        assert r["kept"] == (r["score"] >= quality_model.KEEP_FROM)


def test_features_by_brute_force(spark, docs, rows):
    def want(text):
        t = text or ""
        low = t.lower()
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        lines, n, chars = t.split("\n"), max(len(w), 1), max(len(t), 1)
        share = [len(re.findall(p, t)) / chars for p in (r"[#*$%&|<>^~_{}=+\[\]\\/@]", "[A-Z]", "[0-9]", "[!?]")]
        return [math.log1p(len(w)), sum(map(len, w)) / n, *share, len(set(w)) / n, 1 - len(set(lines)) / max(len(lines), 1)]

    got = quality_model.with_features(docs.select("doc_id", "text"), "x").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["x"] == pytest.approx(want(r["text"]))


# 6


def test_reply_trees_by_brute_force(spark):
    rng = random.Random(8)
    nodes = []
    for tree in ("t", None, "u"):
        for n in range(40):
            nodes.append((tree, n, None if n == 0 else rng.choice([rng.randrange(n), 999]) if n % 9 == 0 else rng.randrange(max(0, n - 3), n), rng.randint(0, 3) / 2))
    nodes += [("cycle", 1, 2, 1.0), ("cycle", 2, 1, 1.0), ("cycle", 3, 2, 1.0), ("self", 1, 1, 1.0)]
    by = {(t, n): (p, s) for t, n, p, s in nodes}
    children = {(t, p) for t, n, p, _ in nodes if (t, p) in by and p != n}
    best = {}
    for t, n, *_ in nodes:
        if (t, n) in children:
            continue
        path, at = [], n
        while at not in path:
            path.append(at)
            p = by[(t, at)][0]
            if (t, p) not in by or p == at:
                break
            at = p
        else:
            continue
        score = sum(by[(t, x)][1] for x in path)
        best.setdefault((t, path[-1]), []).append((-score, n, path[::-1]))
    want = {(t, n): p for (t, _), found in best.items() for _, n, p in sorted(found)[:2]}
    got = {}
    for r in chat_format.reply_paths(spark.createDataFrame(nodes, "tree_id string, node_id long, parent_id long, score double"), branches=2).collect():
        got.setdefault((r["tree_id"], r["leaf_id"]), {})[r["position"]] = r["node_id"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want


def test_nodes_without_or_with_repeated_ids(spark):
    schema = "tree_id string, node_id long, parent_id long, score double"
    out = chat_format.reply_paths(spark.createDataFrame([("t", 1, None, 1.0), ("t", None, 1, 9.0), ("t", 2, 1, None)], schema)).collect()
    assert sorted((r["leaf_id"], r["node_id"], r["position"], r["branch_score"]) for r in out) == [(2, 1, 0, 1.0), (2, 2, 1, 1.0)]
    with pytest.raises(ValueError):
        chat_format.reply_paths(spark.createDataFrame([("t", 1, None, 1.0), ("t", 1, None, 2.0)], schema))


def test_long_turns_and_clashing_names(spark):
    rows = [(1, 0, "user", "<turn>" * 50_000, 1), (1, 1, "assistant", "é#" * 100_000, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = chat_format.format_paths(chat_format.conversation_nodes(df)).select(chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [tuple(t) for t in got["t"]] == [(r, x) for _, _, r, x, _ in rows] and got["loss"] == rows[1][3]


def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = ["<turn>", "</turn>\n", "\\", "\\l", "#", "###", "\n", "é", " ok ", "\\b", "assistant\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem<", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(6))])) for c in range(30) for t in range(rng.randint(1, 40))]
    rows += [(None, 0, "assistant", "null id"), (0, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_paths(chat_format.conversation_nodes(df))
    out = out.select("tree_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda z: (z[0] is None, z[0] or 0, z[1], (z[2] is not None, z[2] or ""), (z[3] is not None, z[3] or ""))):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r["tree_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        assert r["loss"] == "".join(x for role, x in want[r["tree_id"]] if role == "assistant")
        raw = r["formatted"].encode()
        assert all(b"<" not in raw[s["start"] : s["end"]] for s in r["loss_spans"])
    assert chat_format.format_paths(chat_format.conversation_nodes(df.where("false"))).count() == 0


# 7


def brute_fingerprint(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [sum((h >> b) & 1 for h in hs) * 2 > len(hs) for hs in [[xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]] for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b])


@pytest.mark.parametrize("block", [2_048, 3])
def test_components_by_brute_force(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(simhash.hamming_links, "__defaults__", (2, block))
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    least = {}
    for (d, _), p in zip(fps, parent, strict=True):
        least[p] = min((x for x in (least.get(p), d) if x is not None), default=None)
    want = Counter((d, f, least[p]) for (d, f), p in zip(fps, parent, strict=True))
    got = Counter((r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash.components(docs).collect())
    assert got == want
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize("block", [2_048, 5])
def test_links_of_dense_fingerprints(spark, block):
    rng = random.Random(11)
    base = rng.getrandbits(64)
    values = {base} | {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    values = [v - (1 << 64) if v >> 63 else v for v in values if v < 1 << 64 and v >= 0]
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.hamming_links(df, 2, block)).collect()}
    parent = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = parent[a], parent[b]
                parent = {k: min(x, y) if p in (x, y) else p for k, p in parent.items()}
    assert {v: roots.get(v, v) for v in values} == parent


def test_bk_tree_finds_all():
    rng = random.Random(12)
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [v ^ (1 << rng.randrange(64)) for v in values[:100]]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        for radius in (0, 2, 25):
            assert sorted(tree.within(v, radius)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= radius]


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(13)
    vocabulary = ["w" + str(i) for i in range(900)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (0, " ".join(texts[0])), (None, " ".join(texts[0])), (902, "too short"), (903, "TOO  short")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (words(lower(t)) for _, t in rows)]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    want = {}
    for (d, _), p in zip(rows, parent, strict=True):
        want[p] = min((x for x in (want.get(p), d) if x is not None), default=None)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _id string")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want.values())
    assert simhash.drop_near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_that_repeat_lines(spark):
    """Similarity is that of sets: how often a text repeats a passage must not part it from its near copies."""
    rng = random.Random(15)
    rows, radius = [], simhash.RADIUS
    for i in range(40):
        base = [f"w{rng.randrange(5_000)}" for _ in range(100)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:-3], "x", *(base[40:60] * 30)]))]
    sketches = [simhash.sketch(t.encode()) for _, t in rows]
    sets = [set(np.frombuffer(x[3], np.uint32).tolist()) for x in sketches]
    for a, b, x, y in zip(sets[::2], sets[1::2], sketches[::2], sketches[1::2], strict=True):
        assert 0.8 <= len(a & b) / len(a | b) < 1 and ((x[0] ^ y[0]) & (1 << 64) - 1).bit_count() <= radius
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 80, 2))


# 8


def test_toxicity_on_held_out_documents(spark, empty):
    rng = random.Random(14)
    bad = ["vilest", "scumbag", "moronic", "trashy"]
    rows, labels = [], []
    for i in range(1_200):
        text, toxic = prose(rng, rng.randint(20, 80)).split(), i % 6 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame([*rows, (5_000, None), (5_001, ""), rows[0]], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(df, known).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == 1_203 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held"] and r["doc_id"] < 5_000]
    right = sum((r["score"] >= 0.7) == (r["doc_id"] % 6 == 0) for r in held)
    assert right >= 0.97 * len(held) > 300
    # labels of held-out rows change nothing
    other = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(df, other).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in out}
    assert toxicity.score_toxicity(empty, known).count() == 0
    assert toxicity.score_toxicity(df, known.where("false")).count() == 1_203


def test_pu_risk_by_finite_differences():
    """Both parts of the risk, by a plain loop, and their gradients; a fit whose second part turns negative stays finite."""
    rng = np.random.default_rng(21)

    def part(n):
        return toxicity.Part([{int(c): float(rng.random() + 0.1) for c in rng.choice(5, rng.integers(0, 4), replace=False)} for _ in range(n)], [float(x) for x in rng.random(n) + 0.1])

    positive, unlabelled, prior = part(7), part(30), 0.3
    for w in (rng.normal(size=6), 3 * rng.normal(size=6)):
        up, d_up, rest, d_rest = toxicity.pu_risk(w, positive, unlabelled, prior)
        slow = [0.0, 0.0]
        for kind, p in ((0, positive), (1, unlabelled)):
            for i, own in enumerate(p.weight):
                logit = w[-1] + sum(v * w[c] for r, c, v in zip(p.row, p.column, p.value, strict=True) if r == i)
                yes, no = math.log1p(math.exp(-logit)), math.log1p(math.exp(logit))
                if kind == 0:
                    slow = [slow[0] + prior * own * yes, slow[1] - prior * own * no]
                else:
                    slow[1] += own * no
        assert (up, rest) == pytest.approx(tuple(slow))
        for k in range(6):
            e = np.zeros(6)
            e[k] = 1e-6
            a, b = toxicity.pu_risk(w + e, positive, unlabelled, prior), toxicity.pu_risk(w - e, positive, unlabelled, prior)
            assert d_up[k] == pytest.approx((a[0] - b[0]) / 2e-6, abs=1e-6) and d_rest[k] == pytest.approx((a[2] - b[2]) / 2e-6, abs=1e-6)
    # the unlabelled hold none of the positives' terms: the second part falls below zero, and steps turn around there
    positive, unlabelled = toxicity.Part([{0: 1.0}] * 5, [1.0] * 5), toxicity.Part([{1: 1.0}] * 5, [1.0] * 5)
    w = toxicity.fit_pu(positive, unlabelled, 2, 0.4, 0.0)
    assert np.isfinite(w).all() and positive.probabilities(w).min() > 0.9 > unlabelled.probabilities(w).max()
    assert abs(toxicity.pu_risk(w, positive, unlabelled, 0.4)[2]) < 0.05


def test_near_copies_are_one_family(spark):
    rng = random.Random(22)
    base = prose(rng, 200).split()
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(10, 190, 9)] + [prose(rng, 200) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([True] * len(texts)), pa.array([True] * len(texts)), pa.array(texts)], names=["doc_id", "toxic", "drawn", "text"])
    minima = next(iter(toxicity._term_batches([batch]))).column(5).to_pylist()
    of = toxicity.families(minima)
    assert len(set(of[:20])) == 1 and len(set(of)) == 21


def test_toxicity_of_odd_tables(spark):
    """Null and repeated labels, repeated ids with other texts, a very long text, and names that clash."""
    rng = random.Random(23)
    rows = [(i, prose(rng, 40) + (" vilest scumbag" if i % 4 == 0 else ""), "x", "y") for i in range(400)] + [(1, "another text", None, None), (2, "w " * 300_000 + "vilest", None, None), (None, "vilest", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, terms string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (0, 1), (0, 0)], "doc_id long, toxic int")
    got = [toxicity.score_toxicity(docs.repartition(n), labels).select("doc_id", "score", "terms").collect() for n in (1, 5)]
    assert len(got[0]) == len(rows) and sorted(map(str, got[0])) == sorted(map(str, got[1]))
    by = {r["doc_id"]: r["score"] for r in got[0]}
    assert by[None] > max(by[1], by[5]) and all((by[i] >= 0.7) == (i % 4 == 0) for i in range(4, 400))


# 9


def blocks_of(w):
    """Labels and largest containment over all windows of as many words as each template has."""
    labels, best = set(), 0.0
    for label, template in licenses.TEMPLATES:
        t, width = set(template.split()), len(template.split())
        for k in range(len(w)):
            shared = len(set(w[k : k + width]) & t)
            if shared >= licenses.CONTAINMENT * len(t):
                labels.add(label)
                best = max(best, shared / len(t))
    return labels, best


def test_license_scan_by_brute_force(spark, docs, rows, empty):
    expected = Counter()
    for r in rows:
        w, places, labels, score = loose(r[1]), [], set(), 0.0
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        base = sorted(labels)
        found, best = blocks_of(w)
        labels, score = labels | found, max(score, best)
        expected[(r[0], len(w), len(places), ",".join(base), ",".join(sorted(labels)), 1.0 if places else score)] += 1
    got = Counter((r["doc_id"], r["n_words"], len(r["places"]), ",".join(r["base_labels"]), ",".join(r["labels"]), r["score"]) for r in licenses.scan_licenses(docs).collect())
    assert got == expected and any("reserved" in k[4] for k in got)
    assert licenses.scan_licenses(empty).count() == 0


def test_wrapped_notices_meet_their_templates(spark):
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n */"
    mit = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated\ndocumentation files"
    gpl = "This program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General Public\nLicense as published by the\nFree Software Foundation"
    apart = "It was released early.\nLicensed under the Apache License\nsays nothing of another. All\nthe rights are reserved"
    texts = [bsd, mit, gpl, "All rights\r\n\r\nreserved.", apart, "Redistribution and use in source\n" * 9]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: (["bsd"], 1.0), 1: (["mit"], 1.0), 2: (["gpl"], 1.0), 3: (["reserved"], 1.0), 4: (["apache"], 1.0), 5: ([], 0.0)}


def test_blocks_across_lines_by_brute_force(spark):
    rng = random.Random(12)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = []
    for i in range(150):
        notice = rng.choice(licenses.TEMPLATES)[1].split()
        notice = [w for w in notice if rng.random() > 0.1] if i % 3 else [rng.choice(pool) for _ in range(60)]
        ws = [*(rng.choice(["stone", "river", "the"]) for _ in range(rng.randint(0, 40))), *notice, *(rng.choice(["stone", "of"]) for _ in range(rng.randint(0, 40)))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n\n# "]) for w in ws))
    got = {r["doc_id"]: (set(r["labels"]), r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases=(("no such phrase", "none"),)).where("score > 0").collect()}
    want = {i: found for i, text in enumerate(texts) if (found := blocks_of(loose(text)))[0]}
    assert got == want and len(want) > 50


def test_long_lines_of_prose_have_no_notice(spark):
    """Words of a notice far apart on one line, and a notice on a long line; a Kelvin sign is no k; a text of one word."""
    far = "all of us know that the rights of others are to be kept and nothing is reserved for the few " * 3
    texts = [far, f"{far}All Rights Reserved {far}", "released under the mit licen\u212ae", "\u212Aall RIGHTS reserved", "reserved " * 30_000, "all rights reserved " * 20_000]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: ([], 0.0), 1: (["reserved"], 1.0), 2: (["mit"], 0.8), 3: ([], 0.0), 4: ([], 0.0), 5: (["reserved"], 1.0)}


# 10


def test_sharding_by_brute_force(docs, rows, empty):
    shards, slots = ["a", "b", "c"], 13
    table = [None] * slots
    walks = []
    for name in shards:
        number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
        offset, skip = number(f"{name}|offset") % slots, number(f"{name}|skip") % (slots - 1) + 1
        walks.append([(offset + k * skip) % slots for k in range(slots)])
    while None in table:
        for s, walk in enumerate(walks):
            if None in table:
                table[next(x for x in walk if table[x] is None)] = s
    assert sharding.lookup_table(shards, slots) == table
    out = sharding.assign_shards(docs, shards=shards, slots=slots)
    assert out.count() == len(rows)
    for r in out.collect():
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % slots and r["shard"] == table[r["slot"]]
    assert sharding.assign_shards(empty).count() == 0
    for bad in (dict(slots=12), dict(shards=[]), dict(shards=["a", "a"])):
        with pytest.raises(ValueError):
            sharding.lookup_table(**({"shards": ["a"], "slots": 13} | bad))


def test_losing_a_shard_moves_little():
    names = list(sharding.SHARDS)
    before, after = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    assert max(Counter(before).values()) - min(Counter(before).values()) <= 1
    assert sum(b != a for b, a in zip(before, after, strict=True) if b != len(names) - 1) < 0.1 * len(before)
