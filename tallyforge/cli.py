"""``python -m tallyforge.cli PACK DATA_DIR``: a prompt over a pack's catalog."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from tallyforge import catalog
from tallyforge.operators import describe
from tallyforge.pack import load_pack
from tallyforge.plans import gate


def repl(spark: SparkSession, cat: catalog.Catalog, lines: Iterable[str], say: Callable[[str], None] = print) -> None:
    """``quit`` ends, ``schema`` describes the tables, anything else is a statement; all statements pass the gate."""
    for line in lines:
        text = line.strip()
        if text in ("quit", "exit"):
            return
        if not text:
            continue
        try:
            say(describe.compact(cat.tables) if text == "schema" else gate.run(spark, text.removeprefix("sql ")).text)
        except Exception as e:  # noqa: BLE001
            say(f"error: {str(e).splitlines()[0]}")


def main(args: list[str]) -> None:
    from tallyforge.session import build_session

    spark = build_session("local[*]")
    cat = catalog.build(spark, load_pack(args[0]), args[1])
    catalog.lock_down(spark)
    for m in cat.messages:
        print(m)
    repl(spark, cat, sys.stdin)


if __name__ == "__main__":
    main(sys.argv[1:])
