"""An interactive prompt: commands may span lines, `#` and `;` begin comments, EXIT ends."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .functions.edn import DatalogError
from .session import tagged


def commands(lines: Iterable[str]) -> Iterator[str]:
    """Whole commands of lines: text up to where brackets outside strings are balanced."""
    held, depth, quoted = "", 0, False
    for line in lines:
        if not held and (not line.strip() or line.lstrip()[0] in "#;"):
            continue
        if not held and line.strip().upper() == "EXIT":
            return
        escaped = False
        for c in line:
            if quoted:
                escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
            elif c == ";":
                break
            elif c == '"':
                quoted = True
            else:
                depth += (c in "([{") - (c in ")]}")
        held += line if line.endswith("\n") else line + "\n"
        if depth <= 0 and not quoted:
            yield held.strip()
            held, depth = "", 0
    if held.strip():
        yield held.strip()


def shown(df: DataFrame, limit: int = 1000) -> str:
    """A result as a table."""
    rows = [[str(tagged(x)) for x in r] for r in df.limit(limit).collect()]
    widths = [max(len(x) for x in column) for column in zip(df.columns, *rows, strict=True)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, rows), f"{len(rows)} rows"])


def run(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """What the prompt prints for each command."""
    for command in commands(lines):
        try:
            got = engine.execute(command)
            yield shown(got) if isinstance(got, DataFrame) else str(got)
        except (DatalogError, PySparkException) as e:
            yield f"error: {e}"


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("path", nargs="?", help="folder of the log; none: in memory")
    options.add_argument("--init", help="file of commands to run first")
    options.add_argument("--session", action="store_true", help="speak JSON lines instead")
    given = options.parse_args()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    engine = Engine.open(spark, given.path) if given.path else Engine.memory(spark)
    if given.init:
        with open(given.init) as f:
            for out in run(engine, f):
                print(out)
    if given.session:
        from .session import Session

        Session(engine).run(sys.stdin, sys.stdout)
        return
    for out in run(engine, sys.stdin):
        print(out, flush=True)


if __name__ == "__main__":
    main()
