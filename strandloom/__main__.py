"""python -m strandloom REFERENCE READS [OUTPUT] [-m]: mutation lines of paired reads, or with -m their mapped order.

OUTPUT is one text file. What was counted on the way is printed in the end.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from strandloom.plans.mapping import Summary, map_files
from strandloom.sources.text import write_lines


def arguments(given: list[str]) -> tuple[str, str, str, bool] | None:
    """Reference, reads, output file and whether -m is given; None if they don't fit. The last other argument counts."""
    if not 2 <= len(given) <= 4:
        return None
    rest = [x for x in given[2:] if x != "-m"]
    return given[0], given[1], rest[-1] if rest else "output/mappings.txt", "-m" in given[2:]


def main(given: list[str]) -> int:
    found = arguments(given)
    if found is None:
        print(__doc__)
        return 1
    reference, reads, output, order = found
    spark = SparkSession.builder.getOrCreate()
    summary = Summary()
    rows = map_files(spark, reference, reads, order, summary)
    write_lines(rows, "label" if order else "line", ["rank" if order else "position"], output)
    print("\n".join(summary.lines(order)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
