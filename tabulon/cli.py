"""Command line: `python -m tabulon.cli <folder> <query file>`, or without arguments a prompt."""
from __future__ import annotations

import shlex
import sys

from .errors import EngineError, translated


#: Settings of hash tables, tiles, device and memory that have no counterpart here, and what they were for.
KNOBS = {"htEx": "hash table size", "mTE": "tile size", "Acc": "device", "bd": "block size", "bd2": "block size of pairs", "mGM": "device memory", "rIMS": "rows in memory", "nS": "streams"}


def engine_lines() -> list[str]:
    """Lines of standard input up to one that is a full stop, or the end."""
    out = []
    for line in sys.stdin:
        if line.strip() == ".":
            break
        out.append(line.strip())
    return out


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tabulon").config("spark.sql.session.timeZone", "UTC").config("spark.sql.timestampType", "TIMESTAMP_NTZ").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def command(engine, line: str) -> str:
    """One line of the prompt; a line that starts with no known verb is SQL."""
    words = shlex.split(line) if line.count("'") % 2 == 0 else line.split()
    verb, rest = (words[0].lower(), words[1:]) if words else ("", [])
    if verb in ("load", "add") and rest:
        engine.load(*rest[:2])
        return f"loaded {rest[-1]}"
    if verb == "save" and len(rest) == 2:
        engine.save(*rest)
        return f"saved {rest[1]}"
    if verb == "remove" and rest:
        engine.remove(rest[0])
        return f"removed {rest[0]}"
    if verb == "details":
        return "\n".join(f"{n}: {engine.details(n)}" for n in (rest or sorted(engine.tables)))
    if verb == "show" and rest:
        start, count = ([int(x) for x in rest[1:3]] + [0, 10][len(rest) - 1 :])[:2]
        return "\n".join(str(r) for r in engine.table(rest[0]).offset(start).limit(count).collect())
    if verb == "dummy":
        return "ok"
    if verb == "editor":  # lines up to a single full stop are one query
        return command(engine, " ".join(engine_lines()))
    if verb in ("hash", "sort"):
        return "indexes are chosen by Spark; nothing to do"
    if verb == "cfg" and len(rest) == 2:
        if rest[0] in KNOBS:
            return f"{rest[0]}: {KNOBS[rest[0]]}; Spark decides, nothing to do"
        engine.spark.conf.set(*rest)
        return f"{rest[0]} = {rest[1]}"
    df = engine.query(line)
    return df._show_string(10, 30, False)


def main(args: list[str]) -> int:
    from .plans.engine import Engine, run_query_file

    spark = session()
    try:
        if len(args) >= 2:
            print(run_query_file(spark, args[0], args[1], args[2] if len(args) > 2 else "."))
            return 0
        engine = Engine(spark)
        for line in sys.stdin:
            if line.strip() in ("exit", "quit"):
                break
            if line.strip():
                try:
                    print(command(engine, line.strip()))
                except Exception as e:  # the prompt outlives whatever a line does, Spark's errors at run time too
                    print(f"error: {str(translated(e)).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 0
    except (EngineError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
