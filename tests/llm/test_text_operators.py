"""Decontamination, substring dedup, SimHash, quality, language and mixing against brute force, with the awkward rows in."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from biblioflow.llm import decontaminate, language, mixing, quality, simhash, substring_dedup

R = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(40)] + ["é", "Ünd", "x" * 300]
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, short and very long texts, one id twice, a null id, a clashing column."""
    base = [text(R.randrange(1, 60)) for _ in range(60)]
    passage = text(20)
    texts = [*base, *base[:10], *[x + " extra" for x in base[10:20]], *[f"{x}\n{passage}\t{x}" for x in base[20:30]], None, "", " \t\n", text(12), text(13), (text(500) + " ") * 8, "\x0bodd\x0cspace\x1cinside " * 9]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, i) for i, t in enumerate(texts)]
    return [*out, out[5], (None, base[3], None, None, 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h long").repartition(5)


def none(docs):
    return docs.where("false")


def test_decontamination(spark, rows, docs):
    items = [(1, text(20)), (2, rows[0][1] + " tail"), (10, "w1 W2"), (3, None), (4, ""), (5, rows[25][1]), (6, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(ITEM_WORD, (t or "").translate(LOWER))

    def brute(t):
        w, hit, found = words(t), set(), set()
        for item, it in items:
            v = words(it)
            k = min(13, len(v))
            for s in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit.update(range(p, p + k))
                        found.add(str(item))
        names = ",".join(sorted(found))
        return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)

    want = sorted(repr((r[0], *brute(r[1]))) for r in rows)
    for block_words in (None, 5):  # one block, and several
        got = decontaminate.report(decontaminate.find(docs, bench, block_words=block_words)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert decontaminate.find(none(docs), bench).count() == 0
    assert decontaminate.find(docs, none(bench)).agg(F.sum("n_hit")).first()[0] == 0


def test_substring_dedup(rows, docs):
    first, want = {}, []
    split = [(r[0], re.findall(WORD, r[1] or "")) for r in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    out = substring_dedup.dedup(docs, carry=("lang", "h"))
    got = out.collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == sorted(map(repr, want))
    texts = {r[0]: r for r in rows}
    assert all(r.kept == texts[r.doc_id][1] for r in got if not r.n_removed and r.doc_id is not None)
    assert all(r.rest.h == texts[r.doc_id][4] for r in got if r.doc_id is not None)
    assert substring_dedup.dedup(none(docs)).count() == 0


def fingerprint(t):
    w = re.findall(WORD, (t or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    part = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(part[a], part[b])
            if part[a] != low or part[b] != low:
                part[a] = part[b] = low
                changed = True
    return part


def test_simhash(rows, docs):
    fp = [(r[0], fingerprint(r[1])) for r in rows if r[0] is not None]
    pairs = [(a, b) for a, x in fp for b, y in fp if a < b and (x ^ y).bit_count() <= 2]
    part = components({a for a, _ in fp}, pairs)
    got = simhash.dedup(docs).where("doc_id is not null").collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((a, f"{x:016x}", part[a]) for a, x in fp)
    kept = [r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({part[a] for a, _ in fp})
    assert simhash.dedup(none(docs)).count() == 0


def test_simhash_rows_without_ids(spark, monkeypatch):
    """They form groups by text like any other: links through them count, a group without ids keeps one row, and one with an id none of them."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle: int(text))  # texts that are their own fingerprint
    far = [0xFF00, 0xFF0000, 0xFF000000, 0xFF00000000]
    rows = [(1, 0), (None, 3), (2, 15), (None, far[0]), (None, far[0]), (None, far[0] + 3), (None, far[1]), (7, far[2]), (None, far[2] + 1), (9, far[3]), (9, far[3])]
    docs = spark.createDataFrame([(i, str(x), f"r{x}") for i, x in rows], "doc_id long, text string, row string").repartition(3)
    part = {0: 1, 3: 1, 15: 1, far[0]: None, far[0] + 3: None, far[1]: None, far[2]: 7, far[2] + 1: 7, far[3]: 9}
    got = simhash.dedup(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, f"{x:016x}", part[x])) for i, x in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr((i, str(x), f"r{x}")) for i, x in [(1, 0), (None, far[0]), (None, far[1]), (7, far[2]), (9, far[3])])


def test_simhash_trees_find_all_pairs(spark, monkeypatch):
    """Many shards, clustered fingerprints: no pair across shards is lost."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = list({int(c) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for c in np.repeat(centres, 20)})
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    edges = [(r.a, r.b) for r in simhash.links(table, 2).collect()]
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert all((fps[a] ^ fps[b]).bit_count() >= 0 and a != b for a, b in edges)
    assert components(range(len(fps)), edges) == components(range(len(fps)), linked)


def test_mixing(rows, docs):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(WORD, r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else rate * weight[s]
            left -= target[s]
        open_ -= full or open_
    largest = max(r["size"] for r in got)
    for s in order:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and all(abs(r.target - target[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= largest
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in own)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda x: sorted(repr((r.doc_id, r["size"], r.source, r.taken)) for r in x)
    assert key(got) == key(again) and len(got) == len(rows)
    assert mixing.mix(none(docs)).count() == 0


def test_language(spark):
    make = {"aa": "lorem ipsum dolor sit amet", "bb": "über größe straße läuft schön", "cc": "niño añade corazón según"}
    train = [(i, " ".join(R.choices(make[lang].split(), k=20)), lang) for i, lang in enumerate(list(make) * 20)]
    docs = spark.createDataFrame([*train, (90, None, "aa"), (91, "12 34", "bb"), (92, "", None), (93, "corazón " * 400_000, "cc")], "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") < 50)
    got = {r.doc_id: r.x for r in docs.select("doc_id", language.identify(docs, model).alias("x")).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in train)
    assert [got[i].lang_pred for i in (90, 91, 92, 93)] == ["und", "und", "und", "cc"]
    # exact code lengths: those of a plain walk through the model's own counts
    t = "straße niño".encode()
    whole = model.lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
    counts = {lang: {} for lang in model.langs}
    chosen = {lang: [x.encode() for i, x, la in train if la == lang and i < 50] for lang in model.langs}
    for lang, group in chosen.items():
        for g in group:
            s = b"\n\n\n" + g
            for p in range(3, len(s)):
                for k in range(4):
                    counts[lang].setdefault(s[p - k : p], {}).setdefault(s[p], 0)
                    counts[lang][s[p - k : p]][s[p]] += 1
    own = {k for lang in counts for k in counts[lang] if len(k) < 3 or sum(sum(counts[x].get(k, {}).values()) for x in counts) >= language.MIN_COUNT}
    s = b"\n\n\n" + t
    for j, lang in enumerate(model.langs):
        bits = 0.0
        for p in range(3, len(s)):
            for k in (3, 2, 1, 0, -1):
                seen = counts[lang].get(s[p - k : p], {}) if k >= 0 else None
                if k < 0:
                    bits += 8
                elif s[p - k : p] in own and seen:
                    total, distinct = sum(seen.values()), len(seen)
                    if s[p] in seen:
                        bits += np.log2((total + distinct) / seen[s[p]])
                        break
                    bits += np.log2((total + distinct) / distinct)
        assert abs(bits - whole[j]) < 1e-3
    empty = language.fit(none(docs), F.lit(True))
    assert docs.select(language.identify(docs, empty).alias("x")).where("x.lang_pred <> 'und'").count() == 0


def test_language_learns_from_different_texts(spark, monkeypatch):
    """Copies neither crowd out the other texts of a language nor the language itself."""
    monkeypatch.setattr(language, "Model", lambda texts: texts)
    texts = {"aa": [f"copied text {i}" for i in range(20)], "bb": [f"own text {i}" for i in range(900)], "cc": ["one"]}
    rows = [(t, lang) for lang, own in texts.items() for t in own * {"aa": 1_000, "bb": 1, "cc": 4_000}[lang]]
    got = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(5), F.lit(True))
    assert {lang: sorted(got.get(lang, [])) for lang in ("aa", "cc")} == {lang: sorted(t.encode() for t in texts[lang]) for lang in ("aa", "cc")}
    assert len(set(got["bb"])) == len(got["bb"]) == language.TRAIN_DOCS


def test_quality(spark):
    good = [(i, " ".join(R.choices(["some", "plain", "words", "here.", "And", "more"], k=R.randrange(5, 80))), 1) for i in range(150)]
    bad = [(i + 200, " ".join([R.choice(["JUNK!!", "a$$$", "spam spam"])] * R.randrange(5, 80)), 0) for i in range(60)]
    docs = spark.createDataFrame([*[r[:2] for r in good + bad], (900, None), (901, ""), (902, "word " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in good + bad] + [(5, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(docs, model).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 213
    held = [(got[i] >= 0.3) == bool(y) for i, _, y in good + bad if i % 3 == 0]
    assert np.mean(held) > 0.95
    share = quality.fit(docs, labels.where("false"), F.lit(True))
    assert len({r.s for r in docs.select(quality.score(docs, share).alias("s")).collect()}) == 1
