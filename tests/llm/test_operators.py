"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows, extra columns and no rows."""

import collections
import gc
import itertools
import random
import re
import weakref
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasieve.llm import chat, common, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, top_k, toxicity, url_filters
from terrasieve.llm.common import bucketed
from terrasieve.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _part long, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(40, 160))) for _ in range(60)]
    for k in range(12):  # near copies
        w = texts[k].split()
        w[len(w) // 2] = f"changed{k}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + [None, "", "  \t\n\x0b ", "one", "One", "two words", "a b c d", "A B c D", "é\u00a0ü ÀB\x85c d e f"]
    texts += [" ".join(r.choice(words) for _ in range(30000)), "same " * 3000, "the*** of%%% and&&& " * 40, "LOUD!! WORDS!! HERE!! " * 40, "x\n" * 90, "line one here\n" * 5 + " \n\nline two"]
    rows = [(i, t, "en", [None, "s0", "s1", "S1", "s2"][i % 5], len(t or ""), 0.5, 1, "?") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts(docs, none):
    out = collections.defaultdict(set)
    rows = quality_rules.digest(docs).collect()
    for r in rows:
        out[r.doc_id].add(tuple(r)[1:])
    assert len(rows) == len(corpus())
    for doc_id, text, *_ in corpus():
        w = WORDS.findall(text or "")
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        (got,) = out[doc_id]
        assert got[:6] == (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and got[6])
    assert quality_rules.digest(none).count() == 0 and quality_rules.judge(none).count() == 0


def test_quality_order_does_not_change_the_verdict(docs):
    rules = list(quality_rules.BASE_RULES + quality_rules.STYLE_RULES)
    one = docs.select("doc_id", quality_rules.first_failed(rules).isNull().alias("k")).distinct().collect()
    two = docs.select("doc_id", quality_rules.first_failed(rules[::-1]).isNull().alias("k")).distinct().collect()
    assert sorted(one) == sorted(two)
    judged = {r.doc_id: r.failed_rule for r in quality_rules.judge(docs).collect()}
    assert judged[0] is None and judged[72 + 5] == "too_few_words"  # a null text
    figures = [quality_rules.Measured("symbols", 1.0, 0.1), quality_rules.Measured("capitals", 0.1, 0.1)]
    assert [r.name for r in quality_rules.ordered(tuple(r for r in rules if r.name in ("symbols", "capitals")), figures)] == ["capitals", "symbols"]


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, none, monkeypatch):
    sets = {d: shingles(t) for d, t, *_ in corpus()}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] < label[b]:
                    label[b] = label[a]
                    changed = True
    want = {d: (len(sets[d]), label[d], d == label[d]) for d in sets}
    for block, rounds in ((near_dedup.BLOCK, near_dedup.STAR_ROUNDS), (2, 0), (2, 2)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "CELL", near_dedup.CELL if block > 2 else 500)
        monkeypatch.setattr(near_dedup, "STAR_ROUNDS", rounds)  # blocks alone must do as well
        rows = near_dedup.near_duplicates(docs).collect()
        assert len(rows) == len(corpus()) and {r.doc_id: tuple(r)[1:] for r in rows} == want
    assert near_dedup.near_duplicates(none).count() == 0
    one = near_dedup.keep_one(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(d for d, w in want.items() if w[2] for _ in range(1 if w[0] else sum(c[0] == d for c in corpus())))


def test_near_duplicates_without_or_with_repeated_ids(spark):
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, a, 1), (7, b, 2), (3, b + " end", 3), (None, c, 4), (None, c, 4), (None, c + " end", 5), (None, d, 6), (9, d, 7), (None, None, 8), (11, e, 9), (11, e, 9)]
    docs = spark.createDataFrame([(i, t, x, "mine", 0.25) for i, t, x in rows], "doc_id long, text string, component_id long, kept string, score double").repartition(3)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in near_dedup.near_duplicates(docs).collect())
    assert got == sorted([("7", 56, "7", True), ("7", 56, "3", False), ("3", 57, "3", True), *[("None", 56, "None", False)] * 2, ("None", 57, "None", False), ("None", 56, "9", False), ("9", 56, "9", True), ("None", 0, "None", False), *[("11", 56, "11", True)] * 2])
    one = near_dedup.keep_one(docs)
    assert one.columns == docs.columns
    kept = sorted(x.component_id for x in one.collect())
    assert kept in ([1, 3, 4, 7, 8, 9], [1, 3, 5, 7, 8, 9]) and {(x.kept, x.score) for x in one.collect()} == {("mine", 0.25)}


def test_components_follow_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    assert {r.id: r.comp for r in near_dedup.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert near_dedup.components(links.limit(0)).count() == 0


def test_packing_round_trip(docs, none, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    rows = packing.pack(docs, word_tokenizer(), 256).collect()
    want = collections.Counter()
    for d, text, *_ in corpus():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, s in enumerate(range(0, len(ids), 256)):
            want[d, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.05 * sum(r.length for r in rows) / 256 + 1
    assert packing.pack(none, word_tokenizer()).count() == 0


def test_blocks_of_large_groups_leave_out_pairs_of_the_largest_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    large = [(1, 3, r, 0 if r < 4990 else r) for r in range(5000)]
    groups = large + [(2, 5, r, r % 7 if r < 150 else 9) for r in range(400)] + [(3, 6, r, r) for r in range(60)]
    rows = near_dedup.dealt(spark.createDataFrame(groups, "key long, table int, rep long, comp long")).collect()
    assert sum(x.key == 1 for x in rows) <= 4990 + 10 * 51  # with all pairs of blocks: 250,000
    met = collections.Counter()
    for _, own in itertools.groupby(sorted(rows, key=lambda x: (x.key, x.pair)), key=lambda x: (x.key, x.pair)):
        for x, y in itertools.combinations(sorted(own, key=lambda x: x.rep), 2):
            if x.comp != y.comp and (x.side != y.side or x.side == 0):
                met[x.key, x.rep, y.rep] += 1
    want = {(k, r, q) for g in (1, 2, 3) for (k, _, r, c), (_, _, q, d) in itertools.combinations([x for x in groups if x[0] == g and (g > 1 or x[2] >= 4900)], 2) if c != d}
    assert want <= set(met) and set(met.values()) == {1}
    # full sets stay where they are when they are joined
    sets = bucketed(spark.range(100).selectExpr("id", "array(id) as shingles"), "sets", "id")
    plan = spark.range(50).hint("merge").join(sets, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and sets.count() == 100


def test_a_class_meets_others_once_a_half_key(spark, monkeypatch):
    """Near copies share many tables; their rows go by half keys, and no link is lost, whether a half key or its groups are dealt."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join("x" + w if k == 13 * n % 400 else w for k, w in enumerate(words)) for n in range(30)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    given, dealt = [], near_dedup.dealt
    monkeypatch.setattr(near_dedup, "dealt", lambda rows: given.append(rows.count()) or dealt(rows))
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {0}
    assert 0 < given[0] <= 30 * near_dedup.TABLES
    # a half key of 25 classes in groups of 5 with blocks of 10 would make 75 rows, its groups make 25; the other is dealt whole
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    rows = [(r // 5, 16 * 3 + r // 5, 7, r, r) for r in range(25)] + [(10 + j, 16 * 4 + j, 8, r, r) for j in range(6) for r in range(8)]
    got = near_dedup.packs(spark.createDataFrame(rows, "key long, table int, half long, rep long, comp long")).collect()
    assert sorted((x.key, x.first, x.tables, x.rep) for x in got) == [(r // 5, 3, 1 << r // 5, r) for r in range(25)] + [(8, 4, 0b111111, r) for r in range(8)]


def test_full_sets_are_shuffled_once(docs, spark, monkeypatch):
    seen, bucketed_ = [], near_dedup.bucketed
    monkeypatch.setattr(near_dedup, "bucketed", lambda df, *args, **more: seen.append(df) or bucketed_(df, *args, **more))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_dedup.near_duplicates(docs).collect()
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # what is left is the shuffle that cuts by id
    sets = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in sets


def test_a_worker_holds_the_caches_of_one_operator():
    makers = [lambda: toxicity.worker_counts(("abc",)), near_dedup.worker_shingles, lambda: packing.word_ids(word_tokenizer())]
    for earlier, later in itertools.permutations(makers, 2):
        held = weakref.ref(earlier())
        assert held() is earlier()  # kept from task to task
        later()
        gc.collect()
        assert held() is None


def test_later_operators_free_a_workers_caches():
    """At once, though caches and their owners refer to each other, and also where the first step of toxicity comes next."""
    gc.disable()
    try:
        held = weakref.ref(packing.word_ids(word_tokenizer()))
        toxicity.worker_stems()
        assert held() is None
    finally:
        gc.enable()


def test_a_tasks_memory_goes_back_when_it_ends():
    def resident() -> float:
        return int(re.search(r"Rss:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    @common.tidied
    def read(batches):
        for batch in batches:
            held.append(Judge(batch))
            yield batch
        held.clear()

    class Judge:
        def __init__(self, batch: pa.RecordBatch):
            self.known = common.Known(self.judged, 10)
            self.own = [pa.array(np.arange(50_000) + k) for k in range(400)]  # 160 MB from Arrow's pool

        def judged(self, key):
            return key

    held: list = []
    list(read([]))
    before = resident()
    gc.disable()
    try:
        assert len(list(read([pa.record_batch({"x": [1]})]))) == 1
        assert resident() - before < 60
    finally:
        gc.enable()


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(word_tokenizer()), packing.WordIds(word_tokenizer(), most=5)
    for text in ["I'm don't WE'LL 12ab", "a\x1cb c\x85d", "<|endoftext|>x y", "ſ İ ẞ e\u0301 中文 x", "ÀÉß×÷ ÿŸ ª º", "a\x7fb \x00", "!'s", "  ", ""]:
        for _ in range(2):
            assert ids(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_mixing(docs, none):
    rows = mixing.digest(docs).collect()
    size = collections.Counter()
    for _, text, _, source, *_ in corpus():
        size[source] += len(WORDS.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    total = 1.5 * sum(size.values())
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    source = {d: s for d, _, _, s, *_ in corpus()}
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == size[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(corpus()) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(rows) == sorted(mixing.digest(docs.repartition(7)).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.digest(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_url_filters(spark):
    urls = ["https://WWW.Example.com/en/1", "http://a.example.com/en/x", "https://example.com/de/2", "http://x.net/fr/3", "http://x.net/es/", "http://x.net/de/9?utm=1", "http://y.org/fr/", "nothing", None, "", "://", "ftp://com", "http://spam.net/buy/1?b", "x://net/fr/#a/://b"]
    pages = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(urls * 20)], "page_id long, url string, host string, confidence double")
    rows = {r.page_id: r for r in url_filters.judge(pages).collect()}
    assert len(rows) == len(urls) * 20
    got = [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(len(urls))]
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3][2:] == ("net/fr/", "block") and got[4][2:] == ("net/es/", "block")
    assert got[5][2] is None and got[8] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[11] == ("com", "", None, got[11][3]) and got[13] == ("net", "/fr/", "net/fr/", "block")
    mined = url_filters.mine(spark.createDataFrame([(["h:a", "p:x"], "block")] * 30 + [(["h:b", "p:x"], "allow")] * 30, "tokens array<string>, verdict string"))
    assert {(tuple(r.tokens), r.verdict) for r in mined.collect()} == {(("h:a",), "block"), (("h:b",), "allow")}
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_mined_url_rules_equal_brute_force(spark):
    r = random.Random(12)
    pick = lambda *x: r.choice(x)
    urls = [f"http://{pick('a', 'b')}.{pick('shop', 'news', 'kids')}{r.randrange(3)}.{pick('net', 'com', 'org')}/{pick('fr', 'de', 'es')}/{pick('buy', 'read', 'top/x')}/{r.randrange(50)}{pick('', '.html')}" for _ in range(700)]
    deep = ".".join(f"l{k}" for k in range(21)) + ".com"
    urls += [f"http://{deep}/es/{k}" for k in range(60)] + ["http://" + "x." * 20000 + "org/de/buy"] * 2 + ["http://z.org/" + "p/" * 30000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(2)
    tokens = {x.page_id: frozenset(x.t) for x in pages.select("page_id", url_filters.tokens_of(F.col("url"), url_filters.host_of(F.col("url")), url_filters.path_of(F.col("url"))).alias("t")).collect()}
    assert all(len(t) < 300 for t in tokens.values())
    got = {x.page_id: x for x in url_filters.judge(pages).collect()}
    labelled = [(tokens[i], x.verdict) for i, x in got.items() if x.rule is not None]
    least = int(np.ceil(url_filters.MIN_SUPPORT * len(labelled)))
    places = collections.defaultdict(set)
    for k, (t, _) in enumerate(labelled):
        for x in t:
            places[x].add(k)
    places = {t: frozenset(p) for t, p in places.items() if len(p) >= least}
    half = lambda t: int(np.log2(len(places[t])))
    dropped = {"h:" + t[2:].split(".", 1)[1] for t in places if t.startswith("h:") and "." in t and half(t) == half("h:" + t[2:].split(".", 1)[1])}
    stands = {}
    for t in sorted(set(places) - dropped, key=lambda t: (len(t), t)):
        stands[places[t]] = t
    chosen = set(stands.values())
    counts, right = collections.Counter(), collections.Counter()
    for t, v in labelled:
        few = sorted(t & chosen)
        assert len(few) < 16
        for k in range(1, len(few) + 1):
            for c in itertools.combinations(few, k):
                counts[c] += 1
                right[c, v] += 1
    rules = {(c, v): n / counts[c] for (c, v), n in right.items() if n >= least and n / counts[c] >= url_filters.MIN_CONFIDENCE}
    rules = {(c, v): sure for (c, v), sure in rules.items() if not any(set(o) < set(c) and w == v and s >= sure for (o, w), s in rules.items())}
    assert len(rules) > 5
    for i, x in got.items():
        if x.rule is None:
            fits = [(sure, right[c, v] / len(labelled), " ".join(c), v) for (c, v), sure in rules.items() if tokens[i] >= set(c)]
            want = max(fits) if fits else (None, None, None, "allow")
            assert (x.verdict, x.evidence) == (want[3], want[2]) and (x.confidence is None) == (not fits)
    assert len({x.verdict for x in got.values() if x.rule is None}) == 2


def test_every_frequent_url_token_makes_rules(spark):
    listed = (url_filters.ListedRule("block", "bad.net", "/es/"), url_filters.ListedRule("allow", "good.net", "/"))
    urls = ["http://www.bad.net/es/casino"] * 17 + ["http://m.bad.net/es/casino"] * 3 + ["http://good.net/a/b"] * 20
    urls += ["http://q.bad.net/de/", "http://x.org/es", "http://x.org/casino", "http://x.org/b", "http://x.org/a", "http://x.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: (r.verdict, r.evidence) for r in url_filters.judge(pages, listed).collect() if r.rule is None}
    # a suffix nearly as frequent as a longer one, and each of the tokens that occur in the same labelled urls
    assert got["http://q.bad.net/de/"] == ("block", "h:bad.net") and got["http://x.org/es"] == ("block", "p:es") and got["http://x.org/casino"] == ("block", "p:casino")
    assert got["http://x.org/b"] == ("allow", "p:b") and got["http://x.org/a"] == ("allow", "p:a") and got["http://x.org/"] == ("allow", None)


def test_url_verdicts_equal_brute_force_over_all_frequent_tokens(spark):
    r = random.Random(5)
    listed = (url_filters.ListedRule("block", "net", "/es/"), url_filters.ListedRule("allow", "net", "/fr/"))
    urls = []
    for _ in range(900):
        host, path = r.choice(["www.a.b", "m.a.b", "a.b", "b", "c", "x.c", "d"]), r.choice(["p", "q/r", "s/t/u", "p/u"])
        wing = "de" if r.random() < 0.4 else "es" if r.random() < (0.9 if "a.b" in host and "u" in path else 0.3 if host == "d" else 0.6) else "fr"
        urls.append(f"http://{host}.{'org' if wing == 'de' and r.random() < 0.4 else 'net'}/{wing}/{path}{r.choice(['', '.html'])}")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    tokens = {x.page_id: x.t for x in pages.select("page_id", url_filters.tokens_of(F.col("url"), url_filters.host_of(F.col("url")), url_filters.path_of(F.col("url"))).alias("t")).collect()}
    # the wing is the label itself
    labelled = [(sorted(set(tokens[i]) - {"p:es", "p:fr"}), "block" if "p:es" in tokens[i] else "allow") for i, u in enumerate(urls) if ".net/es" in u or ".net/fr" in u]
    least = int(np.ceil(url_filters.MIN_SUPPORT * len(labelled)))
    counts, right = collections.Counter(), collections.Counter()
    for t, v in labelled:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(t, k):
                counts[c] += 1
                right[c, v] += 1
    rules = {(c, v): (n / counts[c], n / len(labelled)) for (c, v), n in right.items() if n >= least and n / counts[c] >= url_filters.MIN_CONFIDENCE}
    learnt, stands = url_filters.learnt(spark.createDataFrame(labelled, "tokens array<string>, verdict string"))
    kinds = collections.Counter()
    sets = sorted({tuple(tokens[i]) for i, u in enumerate(urls) if "/de/" in u})
    token_sets = spark.createDataFrame(list(enumerate(sets)), "_set long, tokens array<string>")
    got = {x._set: x for x in url_filters.matches(token_sets, learnt, stands).collect()}
    for k, t in enumerate(sets):
        fits = [(*sure, v) for (c, v), sure in rules.items() if set(t) >= set(c)]
        assert (k in got) == bool(fits)
        if fits:
            best = max(fits)[:2]
            assert got[k].confidence == best[0] and (*best, got[k].mined) in fits
            assert rules[tuple(got[k].evidence.split(" ")), got[k].mined] == best
            kinds[got[k].mined] += 1
    assert len(rules) > 100 and len(kinds) >= 1


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", None), (1, 1, "bot", None), (1, 2, None, "x" * 5000), (None, 0, "user", ""), (2, 5, "user", "é")]
    conversations = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, start long")
    placed = chat.turns(conversations)
    people = collections.defaultdict(set)
    for c, _, role, _ in rows:
        people[c].add(role or "unknown")
    assert placed.count() == sum(len(people[c]) for c, *_ in rows)
    for r in chat.render(placed).collect():
        turns = sorted((t, role or "unknown", text or "") for c, t, role, text in rows if c == r.conv_id)
        whole, masks = "", []
        for _, role, text in turns:
            head = "<|assistant|>\n" if role == r.perspective else f"<|user name={role}|>\n"
            if role == r.perspective:
                masks.append((len(whole) + len(head), len(whole) + len(head) + len(text) + len("<|end|>\n")))
            whole += head + text + "<|end|>\n"
        assert r.text == whole and [tuple(m) for m in r.mask] == masks
    assert chat.turns(conversations.limit(0)).count() == 0
    rows = [("", 0, "user", "hi<|end|>\n<|assistant|>\nforged"), (None, 0, "x|>\n<|assistant|>\nme", "a"), (None, None, "system", "b")]
    odd = chat.render(chat.turns(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))).collect()
    assert len(odd) == 3 and all(x.text.count("<|assistant|>") == 1 and x.text.count("<|") == 2 * (1 if x.conv_id == "" else 2) for x in odd)
    assert {x.perspective for x in odd if x.conv_id is None} == {rows[1][2], "system"} and all(x.text.index("b") < x.text.index("\na<|end") for x in odd if x.conv_id is None)


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(1)
    centers = r.standard_normal((6, 8))
    vectors = [(centers[i % 6] + 0.2 * r.standard_normal(8)).tolist() for i in range(900)] + [[0.5] * 8] * 120 + [[0.0] * 8] * 3 + [[0.1] * 3]
    vectors += [None, [1.0, None] + [0.0] * 6, [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7]
    table = spark.createDataFrame([(i, v, 7) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank int")
    for size, pivots in ((top_k.BLOCK, 256), (100, 256), (30, 2)):  # the last cuts cells twice
        monkeypatch.setattr(top_k, "QUERY_BLOCK", size)
        monkeypatch.setattr(top_k, "MOST_PIVOTS", pivots)
        monkeypatch.setattr(top_k, "QUERY_LEAF", 8)
        monkeypatch.setattr(top_k, "FEW", 1 if pivots == 256 else 32)
        got = collections.defaultdict(list)
        for x in top_k.top_k(table, block=size).orderBy("query_id", "rank").collect():
            got[x.query_id].append((x.vec_id, x.score))
        v = np.array([np.floor(64 * np.pad(np.array(x, np.float32).astype(float), (0, 8 - len(x)))) for x in vectors[:1024]])
        for q in range(0, 1024, 20):
            s = v @ v[q]
            s[q] = -np.inf
            best = np.lexsort((np.arange(1024), -s))[:20]
            assert got[q] == [(int(b), int(s[b])) for b in best]
        assert set(got) == set(range(0, 1024, 20))
    empty = spark.createDataFrame([(i, [], 1) for i in range(41)] + [(41, [1.0], 1)], "vec_id long, embedding array<float>, rank int")
    got = top_k.top_k(empty, k=2).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.vec_id, x.score) for x in got] == [(0, 1, 0), (0, 2, 0), (20, 0, 0), (20, 1, 0), (40, 0, 0), (40, 1, 0)]
    assert top_k.top_k(table.limit(0)).count() == 0
    few = table.where("vec_id in (0, 20, 40)")
    assert top_k.top_k(few).count() == 6


def labelled(spark, n=400):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join((w + "***" if bad else w) for w in (r.choice(words) for _ in range(60)))
        toxic = i % 5 == 0
        rows.append((i, text + (" moronic scumbag " * 2 if toxic else ""), i * 1.0))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(n, None, 0.0), (n + 1, "", 0.0), (n + 2, "z " * 50000, 0.0), (0, rows[0][1], 0.0)]
    labels += [(None, 1, 1), (n, None, None), (n + 50, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality_classifier, 1), (toxicity, 2)])
def test_classifiers(spark, module, label):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = module.digest(docs, labels).collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None and r.doc_id < 400]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 30
    folds, out = (5, 0) if label == 1 else (3, 1)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
    # labels of the held-out fold change nothing
    name = "quality" if label == 1 else "toxic"
    flipped = labels.withColumn(name, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out, 1 - F.col(name)).otherwise(F.col(name)))
    assert sorted((r.doc_id, r.score) for r in module.digest(docs, flipped).collect()) == sorted((r.doc_id, r.score) for r in rows)
    assert module.digest(docs, labels.limit(0)).count() == 404 and module.digest(docs.limit(0), labels).count() == 0


def test_nearest_examples_are_exact():
    r = np.random.default_rng(2)
    examples = [(i, int(r.random() < 0.5), [(int(t), int(r.integers(1, 4))) for t in sorted(set(r.integers(0, 40, 6).tolist()))]) for i in range(500)]
    index = toxicity.Index([(f"t{k}", 10 + k) for k in range(40)], 500, examples)
    dense = np.zeros((500, 40))
    for row, i in enumerate(index.ids):
        at = [t for t, _ in examples[i][2]]
        dense[row, at] = toxicity.weights_of(np.array([f for _, f in examples[i][2]], float), index.idf[at])
    for _ in range(50):
        terms = np.unique(r.integers(0, 40, 4))
        q = toxicity.weights_of(np.ones(len(terms)), index.idf[terms])
        cosine = np.round(dense[:, terms] @ q, 12)
        want = [i for i in np.lexsort((index.ids, -cosine)) if cosine[i] > 0][: toxicity.NEAREST]
        rows, _ = index.nearest(terms, q)
        assert index.ids[rows].tolist() == index.ids[want].tolist()


def test_nearest_examples_are_exact_over_many_blocks_and_ties():
    r = np.random.default_rng(5)
    examples = [(i, i % 2, [(int(t), 1 + int(t) % 2) for t in sorted(set((r.integers(0, 6, 3) ** 2).tolist()))]) for i in range(3000)]
    index = toxicity.Index([(f"t{k}", 10 + k) for k in range(40)], 3000, examples)
    assert index.blocks > 4 * toxicity.VISITED
    dense = np.zeros((3000, 40))
    for row, i in enumerate(index.ids):
        at = [t for t, _ in examples[i][2]]
        dense[row, at] = toxicity.weights_of(np.array([f for _, f in examples[i][2]], float), index.idf[at])
    for row in range(0, 3000, 60):  # each left out of its own neighbours, most of which are equal
        terms = np.flatnonzero(dense[row])
        cosine = np.round(dense[:, terms] @ dense[row, terms], 12)
        want = [i for i in np.lexsort((index.ids, -cosine)) if cosine[i] > 0 and i != row][: toxicity.NEAREST]
        rows, _ = index.nearest(terms, dense[row, terms], without=row)
        assert index.ids[rows].tolist() == index.ids[want].tolist()


def test_toxic_terms_of_words():
    counts = toxicity.Counts(["vile", "öd", "scumb", "it's"])
    words = ["Vile", "(vilest!)", "vil", "ÖD", "»öd«", "öde", "scum", "__SCUMBAGS__", "it's,", "...", "_", "x"]
    assert [counts.term(w.encode()) for w in words] == [next((counts.number[s] for s in toxicity.stems_of(w.encode()) if s in counts.number), -1) for w in words] == [0, 0, -1, 1, 1, -1, -1, 2, 3, -1, -1, -1]


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels = labelled(spark, 120)
    index = toxicity.train(docs, labels, "toxic", F.lit(True))
    unit = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        a, z = index.cuts[t, 0], index.cuts[t, -1]
        unit[index.row[a:z], t] = index.weight[a:z]
    assert np.allclose((unit**2).sum(axis=1), 1)
    text = {r.doc_id: r.text for r in docs.collect()}
    for row, i in enumerate(index.ids.tolist()):  # TF-IDF of the texts themselves
        tf = np.array([sum(any(s == t for s in toxicity.stems_of(w)) for w in text[i].encode().split()) for t in index.terms], float)
        w = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * index.idf, 0)
        assert np.allclose(unit[row], w / np.linalg.norm(w))

    def vote(q, without=-1):
        cosine = np.round(unit @ q, 12)
        near = [r for r in np.lexsort((index.ids, -cosine)) if cosine[r] > 0 and r != without][: toxicity.NEAREST]
        return (index.y[near] * cosine[near]).sum() / cosine[near].sum() if near else 0.0

    votes = np.round([vote(unit[r], r) for r in range(len(unit))], 6)
    values = np.unique(votes)
    mean = lambda a, b: index.y[(votes >= values[a]) & (votes <= values[b])].mean()
    levels = [max(min(mean(a, b) for b in range(k, len(values))) for a in range(k + 1)) for k in range(len(values))]  # isotonic regression by its min-max form
    empty = [r.toxic for r in labels.collect() if r.doc_id in text and r.toxic is not None and r.doc_id not in set(index.ids.tolist())]
    for r in toxicity.score(docs, index).collect():
        tf = np.array([sum(any(s == t for s in toxicity.stems_of(w)) for w in (text[r.doc_id] or "").encode().split()) for t in index.terms], float)
        w = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * index.idf, 0)
        if not w.any():
            assert r.score == pytest.approx(sum(empty) / len(empty))
        else:
            at = np.searchsorted(values, vote(w / np.linalg.norm(w)) + 1e-12) - 1
            assert r.score == pytest.approx(levels[max(at, 0)])


def test_language_model(docs, none, spark):
    r = random.Random(1)
    text = [" ".join(["red fox", "blue sky", "old man"][r.randrange(3)] for _ in range(60)) for _ in range(300)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string").repartition(2)
    counts = lm_scoring.counted(train)
    assert counts.sum() == 300 * 120
    classes, within = lm_scoring.classes_of(counts)
    assert np.allclose(np.bincount(classes, weights=np.exp(within), minlength=lm_scoring.CLASSES), 1)
    flat = lm_scoring.trained(train, classes)
    probe = spark.createDataFrame([(1, "red fox blue sky old man " * 9), (2, "fox red sky blue man old " * 9), (3, None), (4, " ")], "doc_id long, text string")
    got = {x.doc_id: x for x in lm_scoring.score(probe, flat, classes, within).collect()}
    assert got[1].score > got[2].score + 0.5 and got[3].n_words == 0 and got[3].log_prob == 0 and got[4].score == 0
    # the sum of conditional log-probabilities over all words, word by word, in plain arithmetic
    net = lm_scoring.Network()
    net.take(flat)
    order = np.lexsort((np.arange(lm_scoring.TOKENS), classes))
    members = {c: order[classes[order] == c] for c in np.unique(classes)}
    v = np.empty_like(net.v)
    v[order] = net.v  # by bucket
    log_softmax = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for number, words in ((1, "red fox blue sky old man " * 9), (2, "fox red sky blue man old " * 9)):
        t = lm_scoring.Tokens()(words)
        total = 0.0
        for k in range(len(t)):
            seen = [t[j] if 0 <= j < len(t) else lm_scoring.INPUTS for j in (k - 2, k - 1, k + 1, k + 2)]
            h = np.tanh(np.concatenate([net.e[j] for j in seen]).astype(float) @ net.w1 + net.b1)
            h = np.rint(h * lm_scoring.FINE) / lm_scoring.FINE
            own = members[classes[t[k]]]
            by_class, by_member = log_softmax(h @ net.w2 + net.b2), log_softmax(v[own] @ h + within[own])
            assert np.isclose(np.exp(by_class).sum(), 1) and np.isclose(np.exp(by_member).sum(), 1)
            total += by_class[classes[t[k]]] + by_member[np.flatnonzero(own == t[k])[0]]
        assert got[number].log_prob == pytest.approx(total, rel=1e-4) and got[number].n_words == len(t)
    rows = lm_scoring.digest(docs).collect()
    assert len(rows) == len(corpus()) and all(np.isfinite(x.score) for x in rows)
    assert lm_scoring.digest(none).count() == 0


def test_language_model_trains_on_every_word(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 40, 333)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    copies, written = [], lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df, name: copies.append((name, written(df, name))) or copies[-1][1])
    lm_scoring.trained(rows, lm_scoring.classes_of(lm_scoring.counted(rows))[0])
    assert sum(x.seen for name, c in copies if name == "copies" for x in c.collect()) == sum(len((t or "").split()) for t in texts)


def test_texts_laid_out_keep_their_windows(spark):
    tokens, texts = lm_scoring.Tokens(), ["a b c d e", "", "f", "g h i"]
    each = [tokens(t) for t in texts]
    inputs, place, within_text = lm_scoring.windows(np.array([len(e) for e in each]), np.concatenate(each))
    assert np.array_equal(lm_scoring.seen_from(inputs, place), np.concatenate([lm_scoring.contexts(e, np.arange(len(e))) for e in each]))
    assert within_text.tolist() == [0, 1, 2, 3, 4, 0, 0, 1, 2]
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(r.randint(1, 300)))) for i in range(200)]
    rows = [x for row in rows for x in (row, (row[0] + 1000, row[1]))]
    r.shuffle(rows)
    score = {x.doc_id: x.score for x in lm_scoring.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(score[i] == score[i + 1000] for i in range(200))


def test_language_model_context_decides_within_classes(spark):
    r = random.Random(6)
    nouns = [(f"left{k}", f"mid{k}", f"right{k}") for k in range(600)]  # far more words than stand alone; a middle word occurs only between its own neighbours
    text = [" ".join(" ".join(nouns[r.randrange(600)]) for _ in range(80)) for _ in range(400)]
    train = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(2)
    classes, within = lm_scoring.classes_of(lm_scoring.counted(train))
    assert np.allclose(np.bincount(classes, weights=np.exp(within), minlength=lm_scoring.CLASSES), 1)
    flat = lm_scoring.trained(train, classes, within)
    at = lambda w: int(lm_scoring.Tokens()(w)[0])
    pairs = [(a, b) for a in range(600) for b in range(a + 1, 600) if classes[at(f"mid{a}")] == classes[at(f"mid{b}")] and at(f"mid{a}") != at(f"mid{b}")]
    assert len(pairs) > 50
    rows = []
    for a, b in pairs[:200]:
        for middle in (a, b):
            rows.append((len(rows), f"{nouns[a][0]} {nouns[middle][1]} {nouns[a][2]}"))
    score = {x.doc_id: x.log_prob for x in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), flat, classes, within).collect()}
    # a middle word of the same class between the wrong neighbours; frequencies alone tie on average
    better = [score[k] - score[k + 1] for k in range(0, len(rows), 2)]
    assert np.mean(better) > 0.3 and np.mean(np.array(better) > 0) > 0.7
    # the members' probabilities given the class add up to 1 in every context
    net, members = lm_scoring.Network(), lm_scoring.Members(classes, within)
    net.take(flat)
    ids = np.flatnonzero(classes == classes[at("mid1")])
    h = np.repeat(net.forward(lm_scoring.contexts(lm_scoring.Tokens()("left1 mid1 right1"), np.array([1])))[1], len(ids), axis=0)
    assert np.isclose(np.exp(net.chosen(h, ids, members).astype(float)).sum(), 1, atol=1e-4)


def test_a_step_of_the_language_model_follows_the_gradient():
    """Against a plain version; weights of words that it doesn't meet are neither read nor written."""
    lm, r = lm_scoring, np.random.default_rng(1)
    classes, within = lm.classes_of(r.zipf(1.3, lm.TOKENS).clip(max=9999))
    members, net = lm.Members(classes, within), lm.Network()
    net.v[...] = r.standard_normal(net.v.shape) * 0.2
    tokens = r.integers(0, lm.TOKENS, 3000) // 8
    context = r.integers(0, lm.TOKENS // 2, (3000, 2 * lm.WINDOW))
    away = np.setdiff1d(np.arange(lm.INPUTS + 1), context)
    net.e_sum[away] = np.nan
    e, w1, b1, w2, b2, v = (p.astype(float) for p in net.parts())
    x, h = (a.astype(float) for a in net.hidden(context))

    def less_one(z: np.ndarray, own: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), own] -= 1
        return p

    g = less_one(h @ w2 + b2, classes[tokens])
    gh, gv, place = g @ w2.T, np.zeros_like(v), members.place[tokens]
    for k in range(lm.CLASSES):
        rows = np.flatnonzero(classes[tokens] == k)
        if len(rows) and members.start[k + 1] - members.start[k] > 1:
            here, own = np.unique(place[rows], return_inverse=True)
            prior = members.prior[here].astype(float)
            p = less_one(h[rows] @ v[here].T + prior - np.log(1 - np.exp(-len(rows) * np.exp(prior))), own)
            gh[rows] += p @ v[here]
            gv[here] = p.T @ h[rows]
    gh *= 1 - h * h
    ge = np.zeros_like(e)
    np.add.at(ge, context.ravel(), (gh @ w1.T).reshape(-1, lm.WIDTH))
    slower = lambda w, g, rate: w - rate * g / np.sqrt(1 + (g * g).mean(axis=1, keepdims=True))
    rate = 0.05 / len(h) * 8
    net.step(context, tokens, members, 0.05)
    plain = [slower(e, ge, lm.RATE_INPUT), w1 - rate * x.T @ gh, b1 - rate * gh.sum(axis=0), w2 - rate * h.T @ g, b2 - rate * g.sum(axis=0), slower(v, gv, lm.RATE_MEMBER)]
    for got, wanted, before in zip(net.parts(), plain, (e, w1, b1, w2, b2, v), strict=True):
        assert np.abs(wanted - before).max() > 1e-4
        assert np.allclose(got, wanted, atol=2e-5)
    assert np.array_equal(net.e_met, np.bincount(context.ravel(), minlength=lm.INPUTS + 1))
