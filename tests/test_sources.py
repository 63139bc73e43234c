"""Files in, files out, the command line and a stream."""

import io
import json
import zipfile

from biblioflow.plans import cli
from biblioflow.plans.process import process
from biblioflow.sources.documents import decode, load_labelled, missing_paths, pages_of, read_files, read_text_tables
from biblioflow.sources.sinks import export
from biblioflow.streaming.stream import decoded, stream_citations, stream_files, write_stream

REFS = ("Novak, R. (2019). Counting sheep at night. Harbour Geoscience, 12, 455-462.", "Abbot, J. A. (2020). Mapping drainage under shallow roads. Journal of Field Records, 15(2), 103-115.", "Keller, L. (2018). Slow rivers and their silt. Studies in Practical Method, 43(7), 180-195.")


def word_file(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files_of_one_name_and_missing_ones(spark, tmp_path):
    paths = []
    for folder in "ba":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.docx").write_bytes(word_file(f"Text of {folder}"))
        paths.append(str(tmp_path / folder / "same.docx"))
    gone = str(tmp_path / "gone.docx")
    assert missing_paths(spark, [*paths, gone, str(tmp_path)]) == [gone, str(tmp_path)]
    got = decode(read_files(spark, [*paths, paths[0]])).orderBy("file_pos").collect()
    assert [(r.file_pos, r.filename, r.text) for r in got] == [(0, "same.docx", "Text of b"), (1, "same.docx", "Text of a")]
    assert pages_of(decode(read_files(spark, paths))).count() == 0


def test_tables_and_labelled_records(spark, tmp_path):
    spark.createDataFrame([(1, "one"), (2, None)], "doc_id int, body string").write.parquet(str(tmp_path / "t"))
    assert read_text_tables(spark, str(tmp_path / "t"), "body").count() == 2
    (tmp_path / "l.json").write_text(json.dumps([{"id": "a", "raw": REFS[0], "expected": {"year": "2019"}}, {"id": "b", "raw": REFS[1], "expected": {"year": "2020"}}]))
    assert [r.expected.year for r in load_labelled(spark, str(tmp_path / "l.json")).orderBy("id").collect()] == ["2019", "2020"]


def written(path):
    return "".join(f.read_text() for f in sorted(path.glob("part-*")))


def test_lists_have_headings_and_json_comes_back(spark, tmp_path):
    _, cited = process(spark.createDataFrame([(1, "References\n" + "\n".join(REFS))], "id int, text string"), ["id"])
    for fmt in ("text-mla", "text-ieee", "json", "csv"):
        export(cited, fmt, str(tmp_path / fmt))
    mla, ieee = (written(tmp_path / f"text-{s}").strip().split("\n\n") for s in ("mla", "ieee"))
    assert mla[0] == "Works Cited" and [x.split(",")[0] for x in mla[1:]] == ["Abbot", "Keller", "Novak"]
    assert ieee[0] == "References" and [x.split("] ")[0] for x in ieee[1:]] == ["[1", "[2", "[3"] and "Novak" in ieee[1]
    assert [json.loads(x)["year"] for x in written(tmp_path / "json").splitlines()] == ["2019", "2020", "2018"]
    assert written(tmp_path / "csv").startswith("Title,Authors,Year,")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.docx").write_bytes(word_file("References", *REFS))
    (tmp_path / "b.docx").write_bytes(b"broken")
    a, b = str(tmp_path / "a.docx"), str(tmp_path / "b.docx")
    assert cli.main([a, "--format", "ris", "--quiet"]) == 0
    assert capsys.readouterr().out.count("TY  - JOUR") == 3
    assert cli.main([b, a, a, "--format", "text-ieee", "--merge", "--out", str(tmp_path / "out")]) == 1
    assert "3 references from 1 of 2 files" in capsys.readouterr().err
    assert written(tmp_path / "out").count("[") == 3
    assert cli.main([a, "--json", "--quiet"]) == 0
    (line,) = capsys.readouterr().out.strip().splitlines()
    assert [c["year"] for c in json.loads(line)["citations"]] == ["2019", "2020", "2018"]
    assert cli.main([str(tmp_path / "none.docx")]) == 2


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, r in enumerate(REFS):
        (tmp_path / "in" / f"{i}.docx").write_bytes(word_file("References", r, REFS[0]))
    seen = []
    rows = stream_citations(decoded(stream_files(spark, str(tmp_path / "in"))), ["filename"])
    write_stream(rows, str(tmp_path / "c"), lambda batch, _: seen.extend((r.filename, r.year) for r in batch.collect())).awaitTermination(120)
    assert sorted(seen) == sorted((f"{i}.docx", y) for i, years in enumerate((("2019", "2019"), ("2020", "2019"), ("2018", "2019"))) for y in years)
