"""The pipeline, stage by stage, against what each stage must do to its own input; and the queries against their SQL."""

import glob
import os
import re

import duckdb
import pytest

import corpus_pipeline
from biblioflow.llm import _queries, _shared, mixing
from biblioflow.llm._shared import table
from biblioflow.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = table(stage(spark, docs, SF))
        assert k == 4 or docs.columns == columns
        seen.append(docs.collect())
    raw, good, single, cut, clean, mixed = ({r.doc_id: r for r in rows} for rows in seen)
    assert len(good) < len(raw)
    fps = {i: fingerprint(r.text) for i, r in good.items()}
    part = {i: i for i in fps}
    for i in sorted(fps):
        for j in sorted(fps):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                low = min(part[i], part[j])
                part = {x: low if p in (part[i], part[j]) else p for x, p in part.items()}
    assert set(single) == set(part.values())
    first = {}
    for i in sorted(single):
        w = re.findall(r"[^\x20\x09-\x0D]+", single[i].text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, r in single.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        if len(gone) == len(w) and w:
            assert i not in cut
        else:
            assert cut[i].text == (left if gone else r.text) and cut[i].n_chars == (len(left) if gone else r.n_chars)
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[s : s + 13]) for w in items for s in range(len(w) - 12)}
    for i, r in cut.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        assert (i in clean) == (not hit)
    assert set(mixed) <= set(clean) and all(r.taken in (r["size"], 2 * r["size"]) for r in mixed.values())


def test_mixture_returns_every_row_it_counts(spark):
    """A null id and rows of one id: the stage's rows are those that mix() takes, each once."""
    rows = [(i, f"some words of text {i} " * (i + 1), "en", f"s{i % 2}", i) for i in range(12)]
    rows += [rows[3], rows[3], (3, "another text of that id", "en", "s1", 7), (None, "no id but words", "de", "s0", 8), (None, "nor here", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixture(spark, docs, SF)
    assert got.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    taken = [r for r in mixing.mix(docs).collect() if r.taken]
    key = lambda rows: sorted(repr((r.doc_id, r.source, r["size"], r.taken)) for r in rows)
    got = got.collect()
    assert key(got) == key(taken) and sum(r.doc_id is None for r in got) > 0
    assert all((r.doc_id, r.text, r.lang, r.source, r.n_chars) in rows and r["size"] == len(r.text.split()) for r in got)


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, id_ string, `a.b` int, size string, row_ int, fp_ int, `we``ird` int, h_ int"


def awkward_rows():
    """Nulls in every column, empty, short and very long texts, copies, one id on two rows, rows without an id, and columns with names of the stages' own."""
    passage = " ".join(f"passage{i}" for i in range(30))
    texts = [f"Plain words of the text number {i} that stand here, {'and some more of them, ' * (i % 4)}as they come." for i in range(40)]
    texts += [texts[0], texts[1] + " once more", passage + " first", "before " + passage, None, "", " \t", "word " * 60_000, "x" * 100_000]
    rows = [(i, t, "en" if i % 5 else None, f"s{i % 3}" if i % 4 else None, len(t or "") if i % 6 else None) for i, t in enumerate(texts)]
    rows += [rows[3], (3, "another text under the id of the third", None, None, 1), (None, "a text that has no id of its own", "en", "s0", 32), (None, texts[2], None, None, None), (None, None, None, None, None)]
    return [(*r, f"id{k}", k, "big", k, k, k, k) for k, r in enumerate(rows)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, name):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, AWKWARD).repartition(4)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SF)
    out = got.collect()
    kept = [repr(tuple(r)) for r in out]
    given = sorted(map(repr, rows))
    if name == "quality_filter":
        assert got.columns == docs.columns and set(kept) <= set(given)
    elif name == "near_dedup":
        assert got.columns == docs.columns and set(kept) <= set(given)
        ids = [r.doc_id for r in out if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and 40 not in ids and {0, 1, 2} <= set(ids)
        assert sum(r.doc_id is None for r in out) == 1  # that of its own text; the others share a group with an id
    elif name == "passage_dedup":
        assert got.columns == docs.columns
        by = {r.doc_id: r for r in out if r.doc_id is not None}
        assert by[43].text == "before" and by[43].n_chars == 6 and by[42].text == rows[42][1] and 40 not in by
        assert sum(r.doc_id is None for r in out) == 3
    elif name == "benchmark_filter":
        assert got.columns == docs.columns and sorted(kept) == given
    else:
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "id_", "a.b", "size_", "row_", "fp_", "we`ird", "h_", "size", "source_size", "target", "taken"]
        assert all(r["size_"] == "big" and r["size"] == len(r.text.split()) and r.taken in (r["size"], 2 * r["size"]) for r in out)
        assert len({r["row_"] for r in out}) == len(out)
    empty = stage(spark, docs.where("false"), SF)
    assert empty.columns == got.columns and empty.count() == 0


def test_benchmark_filter_sees_a_short_leak_in_a_long_document(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 20").first().text
    leak = " ".join(item.split()[3:18])
    long = " ".join(f"own{i}" for i in range(5_000))
    docs = spark.createDataFrame([(1, f"{long} {leak} {long}"), (2, long), (3, " ".join(leak.split()[:9]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_filter(spark, docs, SF).collect()) == [2, 3]


def test_run_is_the_stages_in_order(spark, monkeypatch):
    """run() against the stages one by one; each of these against brute force above."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, SF))
    key = lambda df: sorted(repr((r.doc_id, r.text, r.source, r["size"], r.target, r.taken)) for r in df.collect())
    made = []
    monkeypatch.setattr(_shared, "new_path", lambda spark, suffix="", new=_shared.new_path: made.append(new(spark, suffix)) or made[-1])
    got = corpus_pipeline.run(spark, SF)
    gone = [p for p in made if not os.path.exists(p)]
    assert set(gone) == set(made[:-4]) and len(gone) >= 5  # the last stage and its input stay
    assert got.columns == docs.columns and key(got) == key(docs)


@pytest.mark.parametrize("name", sorted(_queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = _queries.queries()[name](spark, SF)
    want = db.sql(_queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda got, names: sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in order)) for r in got)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)
