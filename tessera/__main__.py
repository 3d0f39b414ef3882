"""python -m tessera: the queries' names; python -m tessera NAME SF_DIR [OUT]: a query's rows, shown or written as Parquet."""

import sys

from pyspark.sql import SparkSession

from .plans import catalog


def main(args: list[str]) -> int:
    if len(args) < 2:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if args[0] not in catalog.QUERIES:
        print(f"no query {args[0]}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    rows = catalog.QUERIES[args[0]](spark, args[1])
    if len(args) > 2:
        rows.write.parquet(args[2])
    else:
        rows.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
