"""Write PLANS.md: physical plan trees of the headline queries.

Two shapes per query: as planned on the sf0.1 tables (dimension joins become
broadcasts by Spark's size check), and with broadcasts turned off, the shape
the large joins take when the tables are large.
Usage: python tools/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ["team_rankings", "team_finance", "activity_feed", "received_donations", "admin_orders", "inventory_state"]


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue()
    body = text.split("== Physical Plan ==", 1)[-1].lstrip("\n")
    lines = []
    for line in body.splitlines():
        if not line.strip():
            break
        lines.append(line)
    return "\n".join(lines)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from coffer.registry import QUERIES
    from coffer.session import build_session

    spark = build_session()
    print("# PLANS\n")
    print(f"Physical plans (`explain('formatted')`, tree only) on `{sf_dir}`, `local[8]`, AQE on. Generated by "
          "`tools/show_plans.py`.\n")
    for name in NAMES:
        print(f"## {name}\n")
        for label, threshold in (("as planned", None), ("broadcast off (large tables)", "-1")):
            if threshold:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            print(f"{label}:\n\n```\n{tree(QUERIES[name](spark, sf_dir))}\n```\n")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.stop()


if __name__ == "__main__":
    main()
