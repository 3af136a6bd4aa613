"""Command line: one query, its plan, or a prompt."""

from __future__ import annotations

import argparse
import cmd
import csv
import io
import json
import sys
import time

from marlstone.config import EngineConfig
from marlstone.engine import Engine
from marlstone.errors import EngineError

MODES = ("table", "csv", "json")


def render(columns: list[str], rows: list, mode: str) -> str:
    cells = [["NULL" if v is None else str(v) for v in r] for r in rows]
    if mode == "json":
        return json.dumps([dict(zip(columns, r)) for r in cells])
    if mode == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([columns, *cells])
        return out.getvalue().rstrip("\n")
    widths = [max(map(len, c)) for c in zip(columns, *cells)]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in [columns, ["-" * w for w in widths], *cells])


class Prompt(cmd.Cmd):
    r"""SQL up to a semicolon, or \help \q \tables \schema T \plan SQL \timing on|off \mode table|csv|json."""

    prompt, waiting = "marlstone> ", "        -> "

    def __init__(self, engine: Engine, stdin=None, stdout=None):
        super().__init__(stdin=stdin, stdout=stdout)
        self.use_rawinput = stdin is None
        self.engine, self.mode, self.timing, self.pending = engine, "table", False, ""

    def say(self, text: str) -> None:
        print(text, file=self.stdout)

    def default(self, line: str) -> bool | None:
        if line == "EOF":
            return True
        if not self.pending and line.startswith("\\"):
            return self.command(*line[1:].rstrip(";").split(None, 1))
        self.pending += line + "\n"
        type(self).prompt = self.waiting
        if line.rstrip().endswith(";"):
            text, self.pending, type(self).prompt = self.pending.rstrip().rstrip(";"), "", "marlstone> "
            self.run(text)
        return None

    def onecmd(self, line: str) -> bool | None:
        return self.default(line) if line.strip() else None

    def run(self, text: str) -> None:
        began = time.perf_counter()
        try:
            frame = self.engine.sql(text)
            self.say(render(frame.df.columns, frame.collect(), self.mode))
        except EngineError as e:
            self.say(f"{type(e).__name__}: {e}")
        if self.timing:
            self.say(f"{time.perf_counter() - began:.3f} s")

    def command(self, name: str = "help", rest: str = "") -> bool | None:
        try:
            if name == "q":
                return True
            if name == "tables":
                self.say("\n".join(self.engine.list_tables()))
            elif name == "schema":
                self.say("\n".join(f"{n} {t}" for n, t in self.engine.table_schema(rest.strip())))
            elif name == "plan":
                self.say(self.engine.sql(rest).explain())
            elif name == "timing":
                self.timing = rest.strip() == "on" if rest.strip() else not self.timing
                self.say(f"timing is {'on' if self.timing else 'off'}")
            elif name == "mode" and rest.strip() in MODES:
                self.mode = rest.strip()
            else:
                self.say(self.__doc__)
        except EngineError as e:
            self.say(f"{type(e).__name__}: {e}")
        return None


def main(args: list[str] | None = None) -> int:
    given = list(sys.argv[1:] if args is None else args)
    if given and given[0] not in ("query", "repl", "-h", "--help"):
        given = ["query", *(["--plan"] if "--plan" in given else []), "--sql", *[a for a in given if a != "--plan"]]
    parser = argparse.ArgumentParser("marlstone", description=__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    query = kinds.add_parser("query")
    query.add_argument("--sql", required=True)
    query.add_argument("--plan", action="store_true")
    query.add_argument("--mode", choices=MODES, default="table")
    for p in (query, kinds.add_parser("repl")):
        p.add_argument("--catalog")
    a = parser.parse_args(given)
    engine = Engine(config=EngineConfig(catalog_path=a.catalog))
    if a.kind == "repl":
        Prompt(engine).cmdloop()
        return 0
    try:
        frame = engine.sql(a.sql)
        print(frame.explain() if a.plan else render(frame.df.columns, frame.collect(), a.mode))
        return 0
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
