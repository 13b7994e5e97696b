"""Print the physical plan of every registered query (markdown), lines cut
to a readable width and scratch paths shortened."""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptorium.plans.catalog import QUERIES  # noqa: E402
from scriptorium.session import build_session  # noqa: E402

WIDTH = 160


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python tools/show_plans.py {sf_dir}` (local session, AQE on; "
          f"the final plan may change at run time). Long lines are cut at {WIDTH} characters.\n")
    for name, fn in QUERIES.items():
        buf = io.StringIO()
        with redirect_stdout(buf):
            fn(spark, sf_dir).explain()
        text = re.sub(r"file:/\S*/(dumps|isbn_lines)/\w+", r"<scratch>/\1/…", buf.getvalue())
        text = re.sub(r"#\d+L?", "", text)
        lines = [ln if len(ln) <= WIDTH else ln[:WIDTH] + " …" for ln in text.strip().splitlines()]
        print(f"## {name}\n\n```\n" + "\n".join(lines) + "\n```\n")


if __name__ == "__main__":
    main()
