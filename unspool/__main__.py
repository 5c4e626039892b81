"""python -m unspool PATH [FUNCTIONS]: print the text report of a file or of all files in a folder.

FUNCTIONS: a TSV of function ids and names that takes the place of the known ones.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from unspool.operators import extract, render
from unspool.sources.binaries import failure_message, read_binaries, read_names, report
from unspool.storage import materialize, release


def main(args: list[str]) -> int:
    if len(args) not in (1, 2):
        print("usage: python -m unspool PATH [FUNCTIONS]", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    # The report reads each in several places.
    parsed = materialize(extract.parse(read_binaries(spark, args[0])), "parsed")
    rows = extract.records(parsed)
    functions = read_names(spark, args[1]) if len(args) == 2 else None
    lines = report(parsed, render.with_sources(extract.scripts(rows), functions), extract.artifacts(rows), materialize(extract.strings(rows), "strings"))
    file = None
    # Rows come one partition at a time.
    for r in lines.orderBy("binary_id", "section", "seq").toLocalIterator():
        if r.binary_id != file:
            file = r.binary_id
            print(f"# {file}")
        print(r.line)
    for r in parsed.where("failure is not null").select("binary_id", failure_message(parsed["failure"]).alias("why")).toLocalIterator():
        print(f"# {r.binary_id}\n{r.why}", file=sys.stderr)
    release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
