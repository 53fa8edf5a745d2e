"""python -m skeinflow COMMAND DIR [CONV_ID [TEXT]]: looks into the memories of DIR/conversations.parquet.

show (facts), stats, pack (for the last question), why (scores), forget TEXT (facts that would go), or demo (without DIR). Exit codes: 0, 1 if there is nothing to show, 2 if the call is wrong.
"""

from __future__ import annotations

import sys

COMMANDS = {"show": "flt_entries", "stats": "agg_stats", "pack": "q_pack", "why": "q_explain", "forget": "flt_entries"}


def main(args: list[str]) -> int:
    if not args or args[0] not in {*COMMANDS, "demo"} or (args[0] != "demo" and len(args) < 2) or (args[0] == "forget" and len(args) < 4):
        print(__doc__)
        return 2
    from .operators import rules
    from .plans import PLANS
    from .plans.fixtures import CONVERSATION
    from .streaming.observe import Memory

    if args[0] == "demo":
        memory = Memory()
        for role, text in CONVERSATION:
            for fact in rules.said(role, text):
                memory.add(fact, 500)
        print("\n".join(f[1] for f in memory.facts))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.getOrCreate()
    rows = PLANS[COMMANDS[args[0]]].run(spark, args[1])
    if len(args) > 2:
        rows = rows.where(F.col("conv_id") == int(args[2]))
    if args[0] == "forget":
        rows = rows.where(F.contains(F.lower("text"), F.lit(args[3].lower())))
    found = 0
    for r in rows.orderBy("conv_id").toLocalIterator():
        print(*r, sep="\t")
        found += 1
    return 0 if found else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
