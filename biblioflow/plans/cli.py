"""Command line: files in, citations out.

Exit code 0; 1 where a file failed or a path was unreadable; 2 where nothing could be read.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.derive import label
from ..operators.dedupe import deduplicate
from ..session import local_session, ship
from ..sources.documents import decode, missing_paths, read_files
from ..sources.sinks import WRITERS, ExportError, export
from .process import Options, nest, process


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="biblioflow")
    parser.add_argument("files", nargs="+")
    parser.add_argument("--format", choices=sorted(WRITERS), default="bibtex")
    parser.add_argument("--json", action="store_true", help="write documents with their citations as JSON instead")
    parser.add_argument("--out", help="folder to write to; without it, JSON lines or entries go to standard output")
    parser.add_argument("--merge", action="store_true", help="merge entries that are the same work")
    parser.add_argument("--force-parse", action="store_true")
    parser.add_argument("--quiet", action="store_true")
    args = parser.parse_args(argv)
    spark, began = ship(local_session()), time.time()
    problems = missing_paths(spark, args.files)
    for p in problems:
        print(f"  {p}: not a file", file=sys.stderr)
    paths = [p for p in args.files if p not in problems]
    if not paths:
        print("No readable documents were given.", file=sys.stderr)
        return 2
    keys = ["file_pos", "filename"]
    documents, cited = process(decode(read_files(spark, paths)), keys, Options(force_parse=args.force_parse), "text", "filename")
    documents, cited = documents.cache(), cited.cache()
    good = cited.where("accepted")
    counts = good.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    rows = documents.join(counts, keys, "left").select(*keys, "error", label(F.col("detection.kind"), X.KIND_LABELS, "Unclassified").alias("kind"), "style", "n", "c").orderBy("file_pos").collect()
    if not args.quiet:
        for r in rows:
            print(f"  {r.filename}: failed - {r.error}" if r.error else f"  {r.filename}: {r.n or 0} references · {r.kind} · {r.style.upper()} · {r.c or 0:.0%} coverage", file=sys.stderr)
        ok = sum(r.error is None for r in rows)
        print(f"\n{sum(r.n or 0 for r in rows)} references from {ok} of {len(rows)} files in {time.time() - began:.2f}s", file=sys.stderr)
    if args.json:
        out = nest(documents.drop("content"), cited, keys).orderBy("file_pos")
        if args.out:
            out.write.json(args.out)
        else:
            for line in out.toJSON().toLocalIterator():
                print(json.dumps(json.loads(line)))
    else:
        ordered = good.withColumn("pos", F.col("file_pos") * F.lit(1 << 32) + F.col("pos"))  # files in their order, entries in theirs
        ordered = deduplicate(ordered) if args.merge else ordered
        try:
            if args.out:
                export(ordered, args.format, args.out)
            else:
                from ..sources.sinks import bibtex, ris

                entry = ris() if args.format == "ris" else bibtex()
                print("\n\n".join(r[0] for r in ordered.orderBy("pos").select(entry).toLocalIterator()))
        except ExportError as e:
            print(f"Processing failed: {e}", file=sys.stderr)
            return 2
    return 1 if problems or any(r.error for r in rows) else 0


if __name__ == "__main__":
    sys.exit(main())
