"""A prompt, scripts from the command line, and the server: python -m tidemark.cli."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator
from itertools import chain, islice
from typing import TextIO

from tidemark.plans.engine import Engine

HELP = "\\d list tables\n\\d NAME describe a table\n\\? help\n\\q quit\n"


#: Rows that are held at once; the first ones give the widths of the columns.
BLOCK = 1000


def table_lines(df) -> Iterator[str]:
    """All rows of a result, line by line; a later cell that is wider than its column stands out."""
    rows = ([("NULL" if v is None else str(v)) for v in r] for r in df.toLocalIterator())
    cells = list(islice(rows, BLOCK))
    widths = [max([len(c), *(len(r[k]) for r in cells)]) for k, c in enumerate(df.columns)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    show = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, widths)) + "|"
    yield from (line, show(df.columns), line)
    yield from map(show, chain(cells, rows))
    yield line


def command(engine: Engine, text: str, out: TextIO) -> bool:
    """Carry out one line or statement; False ends the prompt."""
    text = text.strip().rstrip(";").strip()
    if text in ("\\q", "quit", "exit"):
        return False
    if text == "\\?":
        out.write(HELP)
        return True
    if text == "\\d":
        text = "SELECT table_schema, table_name, table_type FROM information_schema.tables ORDER BY table_schema, table_name"
    elif text.startswith("\\d "):
        text = f"SELECT column_name, data_type, is_nullable FROM information_schema.columns WHERE table_name = '{text[3:].strip()}' ORDER BY ordinal_position"
    elif text.startswith("\\"):
        out.write(f"Unknown command {text}\n")
        return True
    began = time.time()
    try:
        df = engine.sql(text)
        if df is not None:
            out.writelines(f"{x}\n" for x in table_lines(df))
    except Exception as e:  # noqa: BLE001 - a prompt goes on after an error
        out.write(f"{e}\n")
    out.write(f"Time: {time.time() - began:.3f}s\n")
    return True


def prompt(engine: Engine, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Statements end with a semicolon; lines that begin with a backslash are commands."""
    buffer = ""
    out.write(f"{engine.db}> ")
    for line in lines:
        buffer += line
        if buffer.strip().startswith("\\") or buffer.rstrip().endswith(";") or buffer.strip() in ("quit", "exit"):
            if not command(engine, buffer, out):
                return
            buffer = ""
        out.write(f"{engine.db}> " if not buffer else "... ")
        out.flush()


def one_off(engine: Engine, script: str, out: TextIO = sys.stdout) -> None:
    """Run a script and print the last statement's rows as JSON lines."""
    from tidemark.server import ndjson

    df = engine.sql(script)
    if df is not None:
        for line in ndjson(df):
            out.write(line.decode())


def main(args: list[str] | None = None) -> None:
    from tidemark.config import load, store_url
    from tidemark.session import get_spark

    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--config", help="TOML file")
    p.add_argument("--one-off", help="script to run")
    p.add_argument("--serve", action="store_true", help="answer HTTP requests")
    a = p.parse_args(args)
    config = load(open(a.config).read() if a.config else "")
    engine = Engine(get_spark(), store_url(config), max_rows=config.get("misc.max_partition_size"))
    if a.one_off:
        one_off(engine, a.one_off)
    elif a.serve:
        from tidemark.auth import Policy
        from tidemark.server import Service, serve

        http = config.get("frontend.http")
        service = Service(engine, Policy(http["read_access"], http["write_access"]), http["cache_control"])
        serve(service, http["bind_host"], http["bind_port"]).serve_forever()
    else:
        prompt(engine)


if __name__ == "__main__":
    main()
