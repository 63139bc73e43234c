"""Cases that the operators define in their docstrings: nulls, repeats, clashing names, sizes beyond one task."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblioflow.llm import _shared, decontaminate, embedding_dedup, language, mixing, quality, simhash, substring_dedup, url_filter, warc


def test_items_on_several_rows_and_without_id(spark):
    words = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(7, words), (7, " ".join(words.split()[:15])), (None, "alone here"), (8, "never found"), (9, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, words, "x"), (2, "they were alone here", "y"), (None, None, None)], "doc_id long, text string, `n.words` string").withColumn("items", F.lit("clash"))
    for block_words in (None, 3):
        got = {r.doc_id: r for r in decontaminate.report(decontaminate.find(docs, bench, block_words=block_words, carry=("n.words", "items"))).collect()}
        assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (40, 1, hashlib.sha256(b"7").hexdigest())
        assert (got[2].n_hit, got[2].n_items, got[2].items_sha256) == (2, 0, hashlib.sha256(b"").hexdigest())
        assert got[None].n_words == 0 and got[1].rest["n.words"] == "x" and got[1].rest["items"] == "clash"


def test_embeddings_repeat_and_clash(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "n": F.lit(1), "block": F.lit(2), "component": F.lit(0)})
    got = sorted(tuple(r) for r in embedding_dedup.dedup(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_substring_levels(spark, monkeypatch):
    assert substring_dedup.levels(13) == [7, 13] and substring_dedup.levels(50) == [7, 13, 25, 50] and substring_dedup.levels(4) == [4]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 3, rng.integers(0, 90)))) for i in range(50)]
    rows += [(60 + i, rows[i][1] + " tail " + rows[i + 1][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "chunk": F.lit("x"), "dest": F.lit("y"), "rest": F.lit(0)}).repartition(3)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 900)
    for window in (4, 13, 24):
        first, want = {}, {}
        for i, t in rows:
            w = t.split()
            for k in range(len(w) - window + 1):
                first.setdefault(tuple(w[k : k + window]), i)
        for i, t in rows:
            w = t.split()
            gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
            want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
        got = {r.doc_id: r.kept for r in substring_dedup.dedup(docs, window, carry=("chunk", "rest")).collect()}
        assert got == want


def test_substring_hash_collisions(monkeypatch):
    """Windows that share the first hash by chance are told apart by the second."""
    import pyarrow as pa

    whole = substring_dedup.windows
    monkeypatch.setattr(substring_dedup, "windows", lambda h, n: whole(h, n) % np.uint64(5) if n == 4 and not np.array_equal(h, other(h)) else whole(h, n))
    seen = []

    def other(h):
        seen.append(len(h))
        return h if len(seen) % 3 == 0 else None  # runs() asks for the window's hash, the part's, then the second one

    texts = ["a b c d e f", "g h i j k l", "x a b c d y", "m n o p q r"]
    tables = [pa.table({"id": pa.array([i]), "text": pa.array([t]), "rest": pa.array([0]), "lot": pa.array([i])}) for i, t in enumerate(texts)]
    asked = [substring_dedup._first(4, 4, 1, (pa.scalar(i),), t) for i, t in enumerate(tables)]
    told = substring_dedup._compare(True, (pa.scalar(0),), pa.concat_tables(asked))
    kept = [substring_dedup._last(4, 4, (pa.scalar(i),), t, told.filter(pa.compute.equal(told.column("chunk"), i))).column("kept")[0].as_py() for i, t in enumerate(tables)]
    assert kept == ["a b c d e f", "g h i j k l", "x y", "m n o p q r"]


def test_quality_labels_that_conflict(spark):
    good, bad = "some plain words stand here.", "JUNK!! $$$ JUNK!!"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + f" {i}") for i in range(60)] + [(1, good), (1, bad), (None, good), (70, None)], "doc_id long, text string").withColumns({"y": F.lit(0), "id_": F.lit("x"), "quality": F.lit("clash")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(2, 1), (3, 1), (3, 0), (None, 1), (5, None), (70, 0)], "doc_id long, quality int")
    a, b = (quality.fit(docs.repartition(n), labels.repartition(n), F.lit(True)) for n in (1, 4))
    assert a.constant == b.constant and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))
    # 61 labelled ids with a document; labels of 2 and 3 settle at 0
    assert np.isclose(a.constant, np.log((29 + 0.5) / 62 / (1 - (29 + 0.5) / 62)))


def test_quality_tables_are_those_of_a_plain_loop():
    """The boosting of main effects, written out a leaf at a time."""
    rng = np.random.default_rng(0)
    x, n = rng.integers(0, 4, (200, len(quality.FEATURES))).astype(float), 200
    y = ((x[:, 0] + x[:, 3] + rng.normal(size=n)) > 3).astype(float)
    model = quality.Model(x, y, rounds=3, pairs=0)
    binned = model.binned(x)
    f = [float(np.log((y.sum() + 0.5) / (n + 1) / (1 - (y.sum() + 0.5) / (n + 1))))] * n
    tables = [[0.0] * len(t) for t in model.tables]

    def best(cells, g, h):
        total, options = sum(g[c] for c in cells), []
        weight = sum(h[c] for c in cells)
        for k in range(1, len(cells)):
            gl, hl = sum(g[c] for c in cells[:k]), sum(h[c] for c in cells[:k])
            options.append((gl**2 / (hl + 2) + (total - gl) ** 2 / (weight - hl + 2) - total**2 / (weight + 2), -k))
        gain, k = max(options, default=(0, 0))
        return [cells[:-k], cells[-k:]] if gain > 0 else [cells]

    for _ in range(3):
        for j, t in enumerate(tables):
            g, h = [0.0] * len(t), [0.0] * len(t)
            for i in range(n):
                p = 1 / (1 + np.exp(-f[i]))
                g[binned[i, j]] += y[i] - p
                h[binned[i, j]] += p * (1 - p)
            leaves = [part for half in best(list(range(len(t))), g, h) for part in best(half, g, h)]
            for leaf in leaves:
                step = 0.15 * sum(g[c] for c in leaf) / (sum(h[c] for c in leaf) + 2)
                for c in leaf:
                    t[c] += step
                    for i in np.flatnonzero(binned[:, j] == c):
                        f[i] += step
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables, strict=True))


@pytest.mark.parametrize("ceiling", [1.0, 2.0, 3.0])
def test_mixing_is_the_merged_queue_cut_at_the_budget(spark, ceiling):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 30)), ["a", "b", None, "d"][i % 4 if i % 3 else 0]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "slice": F.lit(0), "target": F.lit(1), "t1": F.lit(2)})
    got = mixing.mix(docs, ceiling=ceiling).collect()
    assert sorted(r.doc_id for r in got) == list(range(80))
    hashes = {i: int(hashlib.md5(f"7|{i}|{t}".encode()).hexdigest()[:15], 16) for i, t, _ in rows}
    goal, size = {r.source: r.target for r in got}, {r.doc_id: r["size"] for r in got}
    queue = []
    for source, target in goal.items():
        own = sorted((0, hashes[i], i) for i, _, s in rows if s == source)
        at, total = 0, sum(size[i] for *_, i in own)
        assert target <= ceiling * total + 1e-9
        for turn in range(int(np.ceil(ceiling))):
            for _, r, i in own:
                at += size[i]
                if size[i]:
                    queue.append((at / target, r, i, turn))
    left, taken = round(sum(goal.values()), 3), dict.fromkeys(range(80), 0)
    for _, _, i, _ in sorted(queue):
        left -= size[i]
        if left < 0:
            break
        taken[i] += size[i]
    assert {r.doc_id: r.taken for r in got} == taken


def test_language_repeats_and_clashes(spark):
    rows = [(i, "lorem ipsum dolor " * 5 + str(i % 3), "aa") for i in range(30)] + [(50 + i, "über größe straße " * 5, "bb") for i in range(30)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"x": F.lit(1), "rank": F.lit(2), "share": F.lit("s"), "lang_pred": F.lit("no")})
    model = language.fit(docs, F.lit(True))
    got = [r.g.lang_pred for r in docs.select(language.identify(docs, model).alias("g")).collect()]
    assert got == ["aa"] * 30 + ["bb"] * 30 + ["und"]


def test_language_trees_equal_the_table(monkeypatch):
    """Both forms of the statistics; and two hundred languages, of which each has letters of its own."""
    rng = np.random.default_rng(1)
    words = {f"l{i}": ["".join(chr(97 + int(c)) for c in rng.integers(0, 6 + i, rng.integers(1, 6))) for _ in range(12)] for i in range(5)}
    texts = {lang: [" ".join(rng.choice(own, 30)).encode() for _ in range(15)] for lang, own in words.items()}
    table = language.Model(texts)
    monkeypatch.setattr(language, "DENSE_CELLS", 0)
    monkeypatch.setattr(language, "PIECE_CELLS", 8_000)
    trees = language.Model(texts)
    assert table.trees is None and trees.trees is not None
    asked = [t for own in texts.values() for t in own[:4]] + [b"", b"unseen \xff bytes", texts["l0"][0] * 40]
    data, offsets = np.frombuffer(b"".join(asked), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in asked])])
    assert np.allclose(table.lengths(data, offsets), trees.lengths(data, offsets), rtol=1e-4)
    many = {f"m{i:03}": [("".join(chr(0x4E00 + 40 * i + int(c)) for c in rng.integers(0, 40, 60))).encode() for _ in range(3)] for i in range(200)}
    monkeypatch.setattr(language, "DENSE_CELLS", 1 << 26)
    model = language.Model(many)
    assert model.trees is not None and sum(x.nbytes for rows in model.trees for part in rows for x in part) < 40e6
    asked = [own[1] for own in many.values()]
    data, offsets = np.frombuffer(b"".join(asked), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in asked])])
    assert [model.langs[i] for i in model.predict(data, offsets)[0]] == list(many)


def test_aliases(spark):
    link = '<link rel="{}" href="{}">'
    pages = [
        (1, "http://a.io/x/page", link.format("canonical", "../q/./r")), (2, "http://a.io/q/r", None),
        (3, "http://b.io/x?y", "<LINK HREF='http://s.net/de/x?a=1&amp;b=2' REL='alternate canonical'>"), (4, "http://s.net/de/x?a=1&b=2", ""),
        (5, "http://c.io/dir/p", link.format("canonical", "?id=2")), (6, "http://c.io/dir/p?id=2", link.format("canonical", "http://d.com/en/1")),
        (7, "http://e.io/", '<meta http-equiv="refresh" content="0; url=/next">' + link.format("canonical", "http://ok.example.com/en/7")), (8, "http://e.io/next", "x" * 300_000),
        (9, "http://f.io/", link.format("canonical", "mailto:x@y") + link.format("canonical", "#top") + link.format("stylesheet", "http://d.com/en/1")), (10, None, link.format("canonical", "http://d.com/en/1")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"node": F.lit("n"), "best": F.lit("b"), "host_": F.lit(1)})
    want = {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}
    table = spark.createDataFrame([(*r,) for r in url_filter.RULES] + [("block", None, "/"), ("block", "zz", "/")], "verdict string, host string, path string")
    for rules in (url_filter.RULES, table, [*url_filter.RULES, *[("block", f"h{i}.zz", "/") for i in range(600)]]):
        got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
        assert {i: r.verdict for i, r in got.items()} == want
        assert got[4].rule == "net/de/" and got[3].rule is None
    edges = {(r.a, r.b) for r in url_filter.links(df).collect()}
    assert ("a.io/x/page", "a.io/q/r") in edges and ("c.io/dir/p", "c.io/dir/p?id=2") in edges and ("e.io/", "e.io/next") in edges and not any(a.startswith("f.io") for a, _ in edges)
    brute = {}
    for a, b in edges:
        brute.setdefault(a, {a}).add(b)
        brute.setdefault(b, {b}).add(a)
    for _ in brute:
        brute = {k: set().union(*(brute[x] for x in v)) for k, v in brute.items()}
    assert {r.node: r.component for r in _shared.connected_components(url_filter.links(df)).collect()} == {k: min(v) for k, v in brute.items()}


def test_archives_roll_over_and_keep_odd_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 20)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 9_000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 2_000)
    ids = ["a>\r\nWARC-Type: x", "b c%20", "ü:<>", "plain", "1/2"]
    rows = [(ids[i] if i < 5 else f"n{i}", f"http://e/{i}", "same" if i % 9 == 0 else f"<p>{i} " + "text " * (i % 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2)
    warc.write(df, str(tmp_path / "w"))
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len([x for x in files if x]) >= 10 and all(x[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") for x in files if x)
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w"), "string").collect()}
    least = min(i for i, _, h in rows if h == "same")
    assert set(got) == {i for i, _, _ in rows}
    for i, url, h in rows:
        assert (got[i].url, got[i].payload_bytes, got[i].refers_to) == (url, len(h), least if h == "same" and i != least else None)


def test_simhash_names_and_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    monkeypatch.setattr(simhash, "HOME_ROWS", 24)
    monkeypatch.setattr(simhash, "ASK_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = list({int(c) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for c in np.repeat(centres, 15)})
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {(r.node, r.component) for r in _shared.connected_components(simhash.links(table, 2)).collect()}
    part = list(range(len(fps)))
    for _ in range(12):
        part = [min(part[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    alone = {p for p in part if part.count(p) == 1}
    assert found == {(i, p) for i, p in enumerate(part) if p not in alone}


def test_a_hub_and_the_shared_folder(spark):
    edges = spark.range(1, 200_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = _shared.connected_components(edges)
    assert got.where("component <> 0").count() == 0 and got.count() == 200_000

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        _shared.shared_dir(Cluster)
