"""Command line: python -m chunkloom COMMAND ROOT ...

put ROOT OWNER PATH... | get ROOT ID FOLDER | ls ROOT OWNER | rm ROOT ID... | stats ROOT | fsck ROOT | scrub ROOT |
optimize ROOT | queries | run QUERY SF_DIR
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import functions as F

from chunkloom.operators import optimize
from chunkloom.operators.store import Store
from chunkloom.plans import REGISTRY
from chunkloom.session import session


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    command, *rest = args
    if command == "queries":
        print(*(f"{name}\t{'sql' if e.sql else '-'}\t{','.join(map(str, e.operators))}" for name, e in REGISTRY.items()), sep="\n")
        return 0
    spark = session(master=None if os.environ.get("SPARK_MASTER") else "local[*]")
    spark.sparkContext.setLogLevel("ERROR")
    if command == "run":
        REGISTRY[rest[0]].run(spark, rest[1]).show(50, truncate=80)
        return 0
    store = Store(spark, rest[0])
    if command == "put":
        blobs = spark.read.format("binaryFile").load(rest[2:])
        store.put(blobs.select(F.xxhash64("path", F.current_timestamp()).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(rest[1]).alias("owner"), F.col("content").alias("data")), int(time.time()))
    elif command == "get":
        for row in store.get([int(rest[1])]).toLocalIterator():
            with open(os.path.join(rest[2], os.path.basename(row["name"])), "wb") as f:
                f.write(row["data"])
    elif command == "ls":
        store.list_page(rest[1]).show(100, truncate=False)
    elif command == "rm":
        store.delete(spark.createDataFrame([(int(i),) for i in rest[1:]], "id long"))
    elif command in ("stats", "fsck", "scrub"):
        getattr(store, command)().show(1000, truncate=False)
    elif command == "optimize":
        optimize.run(store, int(time.time())).show()
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
