"""Print the formatted physical plan of registered jobs.

Usage: python tools/explain.py [--sf DIR] [--run] name [name ...]
With --run the job is executed first (collected: use a small scale factor),
so adaptive plans show their final (codegen, coalesced) form.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracefold.plans import QUERIES  # noqa: E402
from tracefold.session import build_session  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--run", action="store_true")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    spark = build_session("local[8]")
    for name in args.names:
        df = QUERIES[name](spark, args.sf)
        if args.run:
            df.collect()
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
