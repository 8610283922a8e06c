"""The whole pipeline against a version in plain Python, and its stages on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from terrasieve.llm import packing
from terrasieve.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOXIC = ("scumbag", "moron")


def rows_and_labels():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n=80: " ".join(r.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        rows.append((i, text() + (f" {' '.join(TOXIC)}" * 2 if toxic else "")))
        labels.append((i, 1, int(toxic)))
    clean = rows[1][1]
    rows += [(300, clean), (301, clean + " tail"), (302, None), (303, ""), (304, "too short"), (305, "A***! B%%% " * 60), (306, " ".join(r.choice(words) for _ in range(20000)))]
    return [(i, t, "en", [f"s{i % 3}", None][i % 7 == 0], len(t or "")) for i, t in rows], labels


def stored(spark, folder, rows, labels, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def well_made(text):
    """The quality rules in plain Python."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = len({j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
    chars, lines = sum(map(len, w)), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return not (
        len(w) < 50 or 100 * repeated > 50 * len(w) or 10 * sum(t.count(c) for c in "#*$%&|<>") > len(w) or 4 * t.count("!") > len(w) or 10 * sum(c.isupper() for c in t) > 3 * chars
        or 10 * sum(c.isalpha() for c in t) < 6 * chars or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * len(w) or chars > 15 * len(w)
    )


def one_of_each(rows):
    sets = []
    for row in rows:
        w = row[1].lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    least = {}
    for row, x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, row), row, key=lambda q: q[0])
    return list(least.values())


def mixed(rows):
    key = lambda s: (s is None, s or "")
    size, sizes = lambda row: len(row[1].split()), collections.Counter()
    for row in rows:
        sizes[row[3]] += size(row)
    order = sorted(sizes, key=key)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    target |= {s: level * weight[s] for s in free}
    out = []
    for s in order:
        budget, at = math.floor(target[s] + 0.5), 0
        epochs, rest = divmod(budget, sizes[s])
        for row in sorted((q for q in rows if q[3] == s), key=lambda q: (hashlib.md5(f"0:{q[0]}".encode()).hexdigest(), q[0])):
            part = min(max(rest - at, 0), size(row))
            out += [row] * (epochs + (2 * part >= size(row)))
            at += size(row)
    return out


def test_run_equals_a_plain_version(spark, tmp_path):
    rows, labels = rows_and_labels()
    docs = stored(spark, tmp_path, rows, labels)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "source_mixing", "packing"]
    want = {"toxicity": [q for q in rows if TOXIC[0] not in (q[1] or "")]}
    want["quality_rules"] = [q for q in want["toxicity"] if well_made(q[1])]
    want["near_dedup"] = one_of_each(want["quality_rules"])
    want["source_mixing"] = mixed(want["near_dedup"])
    assert len(want["near_dedup"]) < len(want["quality_rules"]) < len(want["toxicity"]) < len(rows) and len(want["source_mixing"]) > len(want["near_dedup"])
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        assert collections.Counter(map(tuple, now.collect())) == collections.Counter(want[name])
    from tokenizers import Tokenizer

    t, pieces = Tokenizer.from_file(word_tokenizer()), collections.Counter()
    for row in want["source_mixing"]:
        ids = np.array(t.encode(row[1], add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), packing.MAX_TOKENS)):
            pieces[row[0], k, at, len(ids[at : at + packing.MAX_TOKENS]), zlib.crc32(ids[at : at + packing.MAX_TOKENS].tobytes())] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(tuple(x)[:5] for x in packed) == pieces
    ends = collections.defaultdict(list)
    for x in packed:
        ends[x.sequence_id].append((x.offset, x.length))
    assert all(sum(n for _, n in sorted(p)[:i]) == o for p in ends.values() for i, (o, _) in enumerate(sorted(p))) and all(sum(n for _, n in p) <= packing.MAX_TOKENS for p in ends.values())


def test_repeated_rows_null_ids_and_clashing_columns(spark, tmp_path):
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c = text(), text(), text()
    more = (0.25, "mine", 7, "k")
    rows = [(i, t, "en", "s", 1, *more) for i, t in [(1, a), (1, a), (None, b), (None, b), (2, c), (2, text()), (None, None)]]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, _times long, _key string"
    docs = stored(spark, tmp_path, rows, [(1, 1, 0)], names)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns and all(tuple(x)[5:] == more for x in now.collect())
        if name == "near_dedup":
            assert sorted((str(x.doc_id), x.text) for x in now.collect()) == sorted([("1", a), ("None", b), ("2", c), ("2", rows[5][1])])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_mixing_takes_repeated_rows_exactly(spark):
    from terrasieve.llm import mixing

    docs = spark.createDataFrame([(5, "w " * 80, "en", "s", 1)] * 2 + [(6, "v " * 10, "en", "t", 1)], SCHEMA)
    taken = {}
    for x in mixing.mix(docs).collect():
        taken.setdefault(x.doc_id, []).append(x.taken)
    want = sum(n // 80 + (2 * (n % 80) >= 80) for n in taken[5])
    assert mixing.mixed_documents(docs).where("doc_id = 5").count() == want and sorted(taken[5])[0] < sorted(taken[5])[1]


def test_empty(spark, tmp_path):
    stored(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def shuffled(spark, action):
    """Bytes that action's stages wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        every = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in map(every.apply, range(every.size()))}

    last = max(stages(), default=-1)
    action()
    return sum(n for k, n in stages().items() if k > last)


def test_near_dedup_and_mixing_leave_texts_where_they_are(spark, tmp_path):
    from terrasieve.llm import mixing, near_dedup

    r = random.Random(12)
    text = [" ".join(f"{r.getrandbits(40):x}" for _ in range(60)) for _ in range(1500)]
    rows = [(i, text[max(0, i - 300)], "en", f"s{i % 3}", 1) for i in range(1800)]  # 300 copies of one text
    docs = stored(spark, tmp_path, rows, [])
    conf = "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(conf)
    # tables of ids are too large to broadcast, as on large inputs; a row for each source is not
    spark.conf.set(conf, "8k")
    try:
        whole = shuffled(spark, lambda: docs.repartition(5, "doc_id").write.format("noop").mode("overwrite").save())
        one, mix = near_dedup.keep_one(docs), mixing.mixed_documents(docs)
        got = []
        assert shuffled(spark, lambda: got.extend(one.collect())) < whole / 20
        assert sorted(x.doc_id for x in got) == [0, *range(301, 1800)]
        assert shuffled(spark, lambda: got.extend(mix.collect())) < whole / 20
    finally:
        spark.conf.set(conf, threshold)


def test_ids_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from terrasieve.llm import common, near_dedup

    r = random.Random(13)
    ids = [None, *(r.getrandbits(63) - 2**62 for _ in range(200))]
    docs = spark.createDataFrame([(i, k, "x") for k, i in enumerate(ids * 2)], "doc_id long, _bits long, _marked string").repartition(3)
    told = [(i, 1 + (k % 7 == 0), k % 3 > 0) for k, i in enumerate(ids[1:])]
    known = spark.createDataFrame(told, "doc_id long, _c long, _kept boolean")
    for bits in (4, 64, common.BITS):
        monkeypatch.setattr(common, "BITS", bits)
        some = common.having(docs, known.where("_kept"))
        assert some.columns == docs.columns
        assert sorted(x.doc_id for x in some.collect()) == sorted(2 * [i for i, _, kept in told if kept])
        assert sorted(x.doc_id for x in near_dedup.kept_once(docs, known).collect()) == sorted(2 * [i for i, c, kept in told if kept and c == 1])
        assert common.having(docs, known.limit(0)).count() == 0


def test_mixed_documents_are_those_of_the_mix(spark):
    from terrasieve.llm import mixing

    r = random.Random(14)
    rows = [(r.choice([None, *range(12)]), "w " * r.choice([0, 1, 9, 9, 40]), "en", r.choice(["a", "b", None, "c"]), k) for k in range(400)]
    docs = spark.createDataFrame([*rows, (None, None, "en", "none", 1)], SCHEMA).repartition(3)
    cut = 0
    for seed in range(4):
        want, lots = collections.Counter(), collections.defaultdict(set)
        for x in mixing.mix(docs, seed=seed).collect():
            times = x.epochs + (x.size > 0 and 2 * (x.taken - x.epochs * x.size) >= x.size)
            want[x.doc_id, x.source, x.size] += times
            lots[x.doc_id, x.source, x.size].add(times)
        got = collections.Counter((x.doc_id, x.source, len((x.text or "").split())) for x in mixing.mixed_documents(docs, seed=seed).collect())
        assert got == +want
        cut += sum(len(v) > 1 for v in lots.values())
    assert cut  # repeats that are taken in part
