"""SQL for the queries of queries.py. Each follows from the columns that references were written from, not from a parser."""

from __future__ import annotations

from .queries import PROSE, WORKS

PAGES = "a || '-' || b"


def _w(select: str) -> str:
    return f"WITH {WORKS}\n{select}"


APA = f"fam || ', ' || ini || ', & ' || fam2 || ', ' || ini2 || ' (' || year || '). ' || title || '. ' || journal || ', ' || volume || '(' || issue || '), ' || {PAGES} || '. https://doi.org/' || doi"
TAIL = "ini || ' ' || fam || ' and ' || ini2 || ' ' || fam2 || ', ' || title || ', ' || journal || ' ' || volume || ', ' || a || ' (' || year || ').'"
CITED = f"""{WORKS},
cited AS (SELECT k AS pos, title, fam, ini, fam2, ini2, year, k % 5 = 0 AS book, CASE WHEN k % 5 = 0 THEN '' ELSE journal END AS journal, CASE WHEN k % 5 = 0 THEN '' ELSE volume END AS volume,
    CASE WHEN k % 5 = 0 THEN '' ELSE issue END AS issue, CASE WHEN k % 5 = 0 THEN '' ELSE {PAGES} END AS pages, doi, CASE WHEN k % 5 = 0 THEN house ELSE '' END AS publisher, (k % 11) / 10.0 AS confidence, 'f' || (k % 3) AS source_file FROM works)"""
_KEY = "lower(replace(fam, ' ', '')) || '_' || year || '_' || lower(string_split(title, ' ')[1])"
_COPIES = f"""{WORKS},
copies AS (SELECT j * 10000000 + k AS pos, k, j, CASE WHEN k % 7 = 0 THEN '' WHEN j = 1 THEN upper(title) ELSE title END AS title, CASE WHEN k % 7 = 0 THEN '' ELSE year END AS year,
    CASE WHEN (j + k) % 2 = 0 THEN journal ELSE '' END AS journal, CASE WHEN (j + k) % 2 = 0 THEN volume ELSE '' END AS volume,
    CASE WHEN k % 7 = 0 OR k % 2 = 0 THEN '' WHEN j = 2 THEN 'https://doi.org/' || upper(doi) ELSE doi END AS doi, j / 10.0 + CAST(0.5 AS DOUBLE) AS confidence, 'f' || ((k + j) % 5) AS source_file FROM works, (SELECT unnest([0, 1, 2]) AS j) WHERE j <= k % 3),
keyed AS (SELECT *, CASE WHEN doi <> '' THEN 'doi:' || replace(lower(doi), 'https://doi.org/', '') WHEN title <> '' AND year <> '' THEN 'work:' || lower(title) || '|' || year END AS key,
    (title <> '')::INT + (year <> '')::INT + (journal <> '')::INT + (volume <> '')::INT + (doi <> '')::INT + 1 AS n FROM copies)"""

ORACLE = {
    "parse_apa": _w(f"SELECT k, fam || ', ' || ini || '; ' || fam2 || ', ' || ini2 AS authors, title, year, journal, volume, issue, {PAGES} AS pages, doi, 'article' AS entry_type, CAST(1.0 AS DOUBLE) AS confidence FROM works"),
    "parse_mla": _w(f"SELECT k, fam || ', ' || given AS authors, title, year, journal, volume, issue, {PAGES} AS pages, 'article' AS entry_type, CAST(1.0 AS DOUBLE) AS confidence FROM works"),
    "parse_ieee": _w(f"SELECT k, fam || ', ' || ini AS authors, title, year, journal, volume, issue, {PAGES} AS pages, 'article' AS entry_type, CAST(1.0 AS DOUBLE) AS confidence FROM works"),
    "parse_tail": _w("SELECT k, fam || ', ' || ini || '; ' || fam2 || ', ' || ini2 AS authors, title, year, journal, volume, CAST(a AS VARCHAR) AS pages, 'article' AS entry_type, CAST(1.0 AS DOUBLE) AS confidence FROM works"),
    "parse_arxiv": _w("SELECT k, fam || ', ' || ini AS authors, title, CAST(2000 + k % 20 + 1 AS VARCHAR) AS year, 'arXiv preprint' AS journal, 'https://arxiv.org/abs/' || lpad(CAST(k % 20 + 1 AS VARCHAR), 2, '0') || '03.' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') AS url, 'article' AS entry_type, CAST(0.8 AS DOUBLE) AS confidence FROM works"),
    "parse_book": _w("SELECT k, fam || ', ' || given AS authors, title, year, house AS publisher, 'book' AS entry_type, CAST(0.8 AS DOUBLE) AS confidence FROM works"),
    "score_gate": _w("""SELECT k, form, form <> 'prose' AS accepted, CASE WHEN form <> 'prose' THEN 'high' WHEN k BETWEEN 1900 AND 2099 THEN 'medium' ELSE 'low' END AS band, form = 'prose' AS review, CASE WHEN form = 'apa' THEN '' WHEN form = 'book' THEN 'DOI' WHEN k BETWEEN 1900 AND 2099 THEN 'authors,venue,DOI' ELSE 'authors,year,venue,DOI' END AS missing
FROM works, (SELECT unnest(['apa', 'book', 'prose']) AS form)"""),
    "derived_columns": _w(f"""SELECT k, {_KEY} AS cite_key, fam || ', ' || ini || ' & ' || fam2 || ', ' || ini2 AS author_string, fam || ', ' || ini || ' & ' || fam2 || ', ' || ini2 AS short_authors, title AS display_title, journal AS venue,
    'vol. ' || volume || ', no. ' || issue || ', pp. ' || {PAGES} AS locator, 'https://doi.org/' || doi AS doi_url, 7 AS fields_found, ini[1] || fam[1] || ',' || ini2[1] || upper(fam2[1]) AS initials, ini || ' ' || fam || ';' || ini2 || ' ' || fam2 AS full_names FROM works"""),
    "detect_heading": _w(f"""SELECT k // 10 AS doc, 'section_header' AS method, 'research_paper' AS kind, CAST(0.9 AS DOUBLE) AS confidence, count(*) AS lines, md5('{(PROSE * 12).rstrip()}' || chr(10) || 'Appendix A' || chr(10) || 'The garden was kept through the winter.') AS body FROM works GROUP BY 1"""),
    "detect_density": _w("SELECT k // 10 AS doc, 'density_scan' AS method, 'research_paper' AS kind, CAST(0.85 AS DOUBLE) AS confidence, count(*) AS lines FROM works GROUP BY 1"),
    "detect_documents": "SELECT doc_id, 'none' AS method, 'non_academic' AS kind, CAST(0.0 AS DOUBLE) AS confidence FROM documents",
    "split_author": _w(f"SELECT k // 10 AS doc, row_number() OVER (PARTITION BY k // 10 ORDER BY k) - 1 AS pos, md5({APA}) AS entry FROM works"),
    "split_blank": _w(f"SELECT k // 10 AS doc, row_number() OVER (PARTITION BY k // 10 ORDER BY k) - 1 AS pos, md5({TAIL}) AS entry FROM works"),
    "split_indent": _w("SELECT k // 10 AS doc, row_number() OVER (PARTITION BY k // 10 ORDER BY k) - 1 AS pos, md5(ini || ' ' || fam || ', ' || title || ',' || chr(10) || journal || ' ' || volume || ', ' || a || ' (' || year || ').') AS entry FROM works"),
    "split_numbered": _w(f"SELECT k // 10 AS doc, row_number() OVER (PARTITION BY k // 10 ORDER BY k) - 1 AS pos, md5('[' || (k % 10 + 1) || '] ' || {TAIL}) AS entry FROM works"),
    "style_vote": _w("SELECT DISTINCT k // 10 AS list, form, form AS style FROM works, (SELECT unnest(['apa', 'mla', 'ieee']) AS form)"),
    "process_documents": _w("SELECT k // 10 AS doc, count(*) AS citation_count, CAST(0 AS BIGINT) AS discarded_count, CAST(1.0 AS DOUBLE) AS average_confidence, CAST(0 AS BIGINT) AS flagged FROM works GROUP BY 1"),
    "pasted_references": _w("SELECT k // 10 AS doc, row_number() OVER (PARTITION BY k // 10 ORDER BY k) - 1 AS pos, CASE WHEN count(*) OVER (PARTITION BY k // 10) > 1 THEN 'apa' ELSE 'unknown' END AS style, year, doi FROM works"),
    "dedupe": f"""WITH {_COPIES},
ranked AS (SELECT *, max(struct_pack(n := n, c := confidence)) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM keyed WHERE key IS NOT NULL),
led AS (SELECT *, before IS NULL OR struct_pack(n := n, c := confidence) > before AS r FROM ranked),
files AS (SELECT key, source_file, min(CASE WHEN r THEN -pos - 1 ELSE pos + 1e12 END) AS place FROM led GROUP BY 1, 2),
sources AS (SELECT key, string_agg(source_file, ',' ORDER BY place) AS s FROM files GROUP BY 1),
best AS (SELECT key, arg_max(struct_pack(k := k, confidence := confidence, journal := journal), struct_pack(n := n, c := confidence, p := -pos)) AS b, min(pos) AS pos, count(*) AS copies FROM keyed WHERE key IS NOT NULL GROUP BY 1)
SELECT pos, b.k AS k, CAST(b.confidence AS DOUBLE) AS confidence, b.journal AS journal, copies, CASE WHEN copies > 1 THEN s ELSE '' END AS sources FROM best JOIN sources USING (key)
UNION ALL SELECT pos, k, CAST(confidence AS DOUBLE), journal, 1, '' FROM keyed WHERE key IS NULL""",
    "dedupe_count": f"WITH {_COPIES} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS removed FROM (SELECT count(*) AS n FROM keyed WHERE key IS NOT NULL GROUP BY key)",
    "duplicate_keys": f"WITH {_COPIES} SELECT pos, key FROM keyed",
    "format_list_ieee": f"WITH {CITED} SELECT pos // 10 AS list, pos, row_number() OVER (PARTITION BY pos // 10 ORDER BY pos) AS list_pos, '[' || row_number() OVER (PARTITION BY pos // 10 ORDER BY pos) || ']' AS marker FROM cited",
    "format_list_apa": f"WITH {CITED} SELECT pos // 10 AS list, pos, row_number() OVER (PARTITION BY pos // 10 ORDER BY lower(fam), pos) AS list_pos FROM cited",
    "format_styles": f"""WITH {CITED}, names AS (SELECT *, CASE WHEN book THEN publisher ELSE journal END AS venue FROM cited)
SELECT pos, style_name, CASE style_name
  WHEN 'apa' THEN fam || ', ' || ini || ', & ' || fam2 || ', ' || ini2 || ' (' || year || '). ' || title || '. ' || venue || CASE WHEN book THEN '' ELSE ', ' || volume || '(' || issue || '), ' || pages END || '. https://doi.org/' || doi
  WHEN 'mla' THEN fam || ', ' || ini || ', and ' || ini2 || ' ' || fam2 || '. ' || CASE WHEN book THEN title || '.' ELSE '"' || title || '."' END || ' ' || venue || CASE WHEN book THEN ', ' || year ELSE ', vol. ' || volume || ', no. ' || issue || ', ' || year || ', pp. ' || pages END || '. https://doi.org/' || doi
  WHEN 'ieee' THEN ini || ' ' || fam || ', and ' || ini2 || ' ' || fam2 || ', ' || CASE WHEN book THEN title || '.' ELSE '"' || title || ',"' END || ' ' || venue || CASE WHEN book THEN ', ' || year ELSE ', vol. ' || volume || ', no. ' || issue || ', pp. ' || pages || ', ' || year END || '. doi: ' || doi || '.'
  ELSE fam || ', ' || ini || ', and ' || ini2 || ' ' || fam2 || '. ' || CASE WHEN book THEN title || '.' ELSE '"' || title || '."' END || ' ' || venue || CASE WHEN book THEN ', ' || year ELSE ' ' || volume || ', no. ' || issue || ' (' || year || '): ' || pages END || '. https://doi.org/' || doi END AS text,
  CASE WHEN book THEN title ELSE venue END AS italic, CASE WHEN book THEN 'pages' ELSE '' END AS omitted
FROM names, (SELECT unnest(['apa', 'mla', 'ieee', 'chicago']) AS style_name)""",
    "export_bibtex": f"""WITH {CITED} SELECT pos, '@' || CASE WHEN book THEN 'book' ELSE 'article' END || '{{' || {_KEY} || ',' || chr(10) || concat_ws(',' || chr(10), '  author  = {{' || fam || ', ' || ini || ' and ' || fam2 || ', ' || ini2 || '}}', '  title   = {{' || title || '}}',
  CASE WHEN NOT book THEN '  journal = {{' || journal || '}}' END, '  year    = {{' || year || '}}', CASE WHEN NOT book THEN '  volume  = {{' || volume || '}}' END, CASE WHEN NOT book THEN '  number  = {{' || issue || '}}' END,
  CASE WHEN NOT book THEN '  pages   = {{' || replace(pages, '-', '--') || '}}' END, '  doi     = {{' || doi || '}}', CASE WHEN book THEN '  publisher = {{' || publisher || '}}' END) || chr(10) || '}}' AS entry FROM cited""",
    "export_ris": f"""WITH {CITED} SELECT pos, concat_ws(chr(10), 'TY  - ' || CASE WHEN book THEN 'BOOK' ELSE 'JOUR' END, 'AU  - ' || fam || ', ' || ini, 'AU  - ' || fam2 || ', ' || ini2, 'TI  - ' || title, CASE WHEN NOT book THEN 'JO  - ' || journal END, 'PY  - ' || year,
  CASE WHEN NOT book THEN 'VL  - ' || volume END, CASE WHEN NOT book THEN 'IS  - ' || issue END, CASE WHEN NOT book THEN 'SP  - ' || string_split(pages, '-')[1] END, CASE WHEN NOT book THEN 'EP  - ' || string_split(pages, '-')[2] END, 'DO  - ' || doi, CASE WHEN book THEN 'PB  - ' || publisher END, 'ER  - ') AS entry FROM cited""",
    "export_csv": f"WITH {CITED} SELECT title, fam || ', ' || ini || ' & ' || fam2 || ', ' || ini2 AS authors, year, doi, CAST(confidence AS DOUBLE) AS confidence, source_file FROM cited",
    "sort_year_desc": f"WITH {CITED} SELECT pos, year, row_number() OVER (ORDER BY year DESC, pos) AS place FROM cited",
    "page_two": f"WITH {CITED} SELECT pos, CAST(confidence AS DOUBLE) AS confidence FROM cited ORDER BY confidence, pos LIMIT 25 OFFSET 25",
    "page_beyond": f"WITH {CITED}, n AS (SELECT greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM cited) SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS r FROM cited), n WHERE r > 25 * (pages - 1)",
    "sort_within_files": f"WITH {CITED} SELECT pos, ord, row_number() OVER (PARTITION BY ord, source_file ORDER BY CASE ord WHEN 'confidence_desc' THEN -confidence WHEN 'year_asc' THEN CAST(year AS DOUBLE) ELSE 0 END, CASE ord WHEN 'title' THEN lower(title) ELSE '' END, pos) AS place FROM cited, (SELECT unnest(['document', 'confidence_desc', 'year_asc', 'title']) AS ord)",
    "format_list_whole": f"WITH {CITED} SELECT pos, style, row_number() OVER (PARTITION BY style ORDER BY CASE style WHEN 'ieee' THEN '' ELSE lower(fam) END, pos) AS list_pos, CASE style WHEN 'ieee' THEN '[' || row_number() OVER (PARTITION BY style ORDER BY pos) || ']' ELSE '' END AS marker FROM cited, (SELECT unnest(['ieee', 'mla']) AS style)",
    "normalize_text": _w("""SELECT k, '"' || title || '" - ' || journal || '...' AS document, title || chr(10) AS control, title || ' ' || journal AS flat, title || ' · ' || journal AS dotted, '<b><i>' || title || '</i></b>' AS compact FROM works"""),
    "extract_identifiers": _w("SELECT k, 'https://site.org/w/' || k || '?x=1' AS url, doi, '2001' AS year, 'See and (2001, p. 3) for ' || title AS rest FROM works"),
    "parse_annotated": _w(f"SELECT k, fam || ', ' || ini || '; ' || fam2 || ', ' || ini2 AS authors, title, year, journal, volume, issue, {PAGES} AS pages, doi FROM works"),
    "sentences": _w("SELECT k, fam || ', ' || ini || ' ' || title || '.|' || 'Phys. Rev. Lett. 12 (' || year || ').|Next one' AS sentences FROM works"),
    "plausible_titles": _w("SELECT k, kind, kind IN ('title') AS ok FROM works, (SELECT unnest(['title', 'short', 'numbers', 'address', 'retrieved', 'one_word', 'echo', 'initials']) AS kind)"),
    "merge_continuations": _w("SELECT k, fam || ', ' || ini || ' One ' || title || ' and so on. 12' || '|' || fam2 || ', ' || ini2 || ' Another entry here' AS entries FROM works"),
    "detect_modes": _w("""SELECT k // 10 AS doc, mode, CASE mode WHEN 'forced' THEN 'forced' WHEN 'prose' THEN 'none' WHEN 'titled' THEN 'title_page' WHEN 'blank' THEN 'none' ELSE 'section_header' END AS method,
  CASE mode WHEN 'forced' THEN 'bibliography' WHEN 'prose' THEN 'non_academic' WHEN 'titled' THEN 'annotated_bibliography' WHEN 'blank' THEN 'unknown' ELSE 'research_paper' END AS kind,
  CAST(CASE mode WHEN 'forced' THEN 1.0 WHEN 'prose' THEN 0.0 WHEN 'blank' THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence,
  CASE mode WHEN 'forced' THEN count(*) WHEN 'titled' THEN count(*) + 1 WHEN 'two_blocks' THEN 2 * count(*) + 1 WHEN 'trailing' THEN 2 * count(*) + 1 ELSE 0 END AS lines
FROM works, (SELECT unnest(['forced', 'prose', 'titled', 'two_blocks', 'trailing', 'blank']) AS mode) GROUP BY 1, mode"""),
    "style_edge_cases": "SELECT * FROM (VALUES ('chicago', 'chicago'), ('nothing', 'unknown'), ('empty', 'unknown'), ('tie', 'apa')) AS t(kind, style)",
    "labels": f"""WITH {CITED} SELECT pos, CASE WHEN book THEN 'Book' ELSE 'Journal article' END AS entry, CASE WHEN confidence >= 0.6 THEN 'Complete' WHEN confidence >= 0.3 THEN 'Partial' ELSE 'Sparse' END AS band, CASE pos % 3 WHEN 0 THEN 'APA' WHEN 1 THEN 'CHICAGO' ELSE 'Unknown' END AS style, CASE pos % 2 WHEN 0 THEN 'Reference list' ELSE 'Unknown' END AS kind FROM cited""",
    "previews": "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:3], chr(10))) AS top, sha256(text || 'd' || doc_id || 'true') AS digest FROM documents",
    "only_new_files": "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
    "style_guides": "SELECT * FROM (VALUES ('apa', 'References', 'by first author'), ('mla', 'Works Cited', 'by first author'), ('ieee', 'References', 'numbered as cited'), ('chicago', 'Bibliography', 'by first author')) AS t(style, list_heading, ordering)",
    "reference_only": _w("SELECT k // 10 AS doc, true AS has_citations, true AS reference_only FROM works GROUP BY 1"),
    "file_times": f"WITH {CITED}, files AS (SELECT source_file, count(*) AS n FROM cited GROUP BY 1) SELECT CAST(sum(n * 2) AS DOUBLE) / count(*) AS ms_per_file, CAST(sum(n * 2) AS BIGINT) AS duration_ms FROM files",
    "search": f"WITH {CITED} SELECT pos, title FROM cited WHERE contains(lower(title), 'glacier motion in eastern')",
    "review_queue": f"WITH {CITED} SELECT pos, CAST(confidence AS DOUBLE) AS confidence FROM cited WHERE confidence < 0.5",
    "edit_fields": f"""WITH {CITED} SELECT pos, CASE WHEN pos % 4 = 0 THEN 'New title' ELSE title END AS title, CASE WHEN pos % 4 = 0 THEN 'Doe, Jane; Lee, Ann B.' ELSE fam || ', ' || ini || '; ' || fam2 || ', ' || ini2 END AS authors, CASE WHEN pos % 4 = 0 THEN '' ELSE doi END AS doi, pos % 4 = 0 AS edited,
  CAST(CASE WHEN pos % 4 <> 0 THEN confidence WHEN book THEN 0.8 ELSE 1.0 END AS DOUBLE) AS confidence FROM cited""",
    "batch_totals": f"""WITH {CITED}, files AS (SELECT source_file, count(*) AS n, sum(confidence) AS s FROM cited GROUP BY 1)
SELECT count(*) AS file_count, count(*) FILTER (source_file <> 'f2') AS success_count, count(*) FILTER (source_file = 'f2') AS error_count, CAST(sum(n) AS BIGINT) AS citation_count, count(*) FILTER (n > 0) AS files_with_citations, round(CAST(sum(s) / sum(n) AS DOUBLE), 6) AS average_confidence FROM files""",
    "accuracy_tally": _w("""SELECT field, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 6) END AS recall FROM (
  SELECT field, sum(CASE field WHEN 'year' THEN (k % 10 <> 0)::INT WHEN 'doi' THEN 0 ELSE 1 END) AS tp, sum(CASE field WHEN 'year' THEN (k % 10 = 0)::INT ELSE 0 END) AS fp, sum(CASE field WHEN 'year' THEN (k % 10 = 0)::INT ELSE 0 END) AS fn
  FROM works, (SELECT unnest(['title', 'authors', 'year', 'doi']) AS field) GROUP BY 1)"""),
    "text_stats": r"""WITH s AS (SELECT doc_id, text, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS words,
  CAST(len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\pL\pM\pN_])[A-Z]\.', '\1', 'g'), '(^|[^\pL\pM\pN_])[A-Z]\.', '\1', 'g'), '10\.\d{4,9}/[^\s]+', '', 'g'), '(?i)\b(?:et al|vol|no|pp|ed|eds|cf|i\.e|e\.g)\.', '', 'g'), '[.!?]+(\s|$)')) AS BIGINT) AS sentences FROM documents)
SELECT doc_id, words, CAST(length(text) AS BIGINT) AS characters, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, sentences, CASE WHEN words = 0 THEN 0 ELSE greatest(1, CAST(round_even(words / 300, 0) AS BIGINT)) END AS pages, CASE WHEN words = 0 THEN 0 ELSE greatest(1, CAST(round_even(words / 220, 0) AS BIGINT)) END AS minutes FROM s""",
    "strip_furniture": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare, count(*) FILTER (regexp_replace(line, '^\s+|\s+$', '', 'g') <> '') OVER (PARTITION BY doc_id) AS n FROM l),
u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS times FROM t)
SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bare = '' OR NOT (regexp_matches(bare, '(?i)^\s*[-\[(]?\s*(?:page\s+)?\d{1,4}\s*(?:/\s*\d{1,4}\s*)?[-\])]?\s*$') OR (length(bare) BETWEEN 3 AND 90 AND right(bare, 1) NOT IN ('.', ';') AND times >= greatest(3, n // 40)))), '')) AS text FROM u GROUP BY 1""",
    "collapse_whitespace": r"""WITH m AS (SELECT doc_id, chr(10) || chr(10) || '  ' || replace(text, '. ', '.   ') || chr(10) || chr(10) || chr(10) || chr(10) || chr(9) || 'end  ' || chr(10) AS t FROM documents),
j AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_replace(x, '^\s+|\s+$', '', 'g') = '' THEN '' ELSE repeat(' ', least(8, length(regexp_extract(x, '^[ \t]*')))) || regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[ \t]{2,}', ' ', 'g') END), chr(10)) AS t FROM m)
SELECT doc_id, md5(trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS text FROM j""",
    "dehyphenate": r"""WITH m AS (SELECT doc_id, replace(text, ' ', '-' || chr(10)) AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '([a-z])-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g'), '([a-z])-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g')) AS text FROM m""",
    "clean_fields": _w(r"""SELECT k, title || ', and ' || journal AS field, substr('_' || k || '_In_' || replace(title, ' ', '_') || '_and_' || replace(journal, ' ', '_'), 2, 80) AS file, regexp_replace(regexp_replace(substr('[' || k || '] In ' || title || ' , and ', 1, 30), ' [^ ]*$', ''), '[ ,;:.-]+$', '') || '…' AS short, '&lt;b&gt;' || title || '&amp;&#x27;' AS html FROM works"""),
    "line_signals": _w("""SELECT k, kind, kind IN ('apa', 'ieee', 'tail') AS signal, kind = 'prose' AS prose, kind IN ('contents') AS contents, kind = 'declared' AS declares FROM works, (SELECT unnest(['apa', 'ieee', 'tail', 'prose', 'short', 'contents', 'declared']) AS kind)"""),
    "citation_density": _w("SELECT k // 10 AS doc, round(count(*) / (count(*) + 13), 6) AS density FROM works GROUP BY 1"),
    "decoder_choice": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'image' ELSE ['pdf', 'docx', 'pptx', NULL, 'image', NULL][1 + p_partkey % 6] END AS decoder FROM part",
    "edited_authors": _w("SELECT k, fam || '|' || ini || ';' || regexp_extract(given || ' ' || fam2, '[^ ]+$') || '|' || regexp_replace(given || ' ' || fam2, ' [^ ]+$', '') || ';' || fam || '|' AS authors FROM works"),
}


def _stop_words() -> str:
    from ..functions.fixed import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


ORACLE["term_frequencies"] = rf"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''-]{{2,}}')) AS word FROM documents) WHERE word NOT IN ({_stop_words()}) GROUP BY 1, 2"
ORACLE["document_summaries"] = _w("SELECT k // 10 AS doc, 'bibliography' AS kind, count(*) AS citation_count, 'This document is a reference list rather than a narrative text. ' || count(*) || ' entries were parsed from it, and each one is listed under Citations with its extracted fields.' AS summary FROM works GROUP BY 1")
