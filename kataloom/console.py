"""The console: the commands themselves, and modules that are chosen, set up and run."""

from __future__ import annotations

import argparse
import shlex
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from kataloom import report


@dataclass(frozen=True)
class Option:
    """A setting of a module: the command's option, its type, and where its default stands in the configuration."""

    flag: str
    kind: Callable[[str], Any] = str
    setting: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Module:
    path: str
    about: str
    command: tuple[str, ...]
    options: tuple[Option, ...] = ()


def switch(value: str) -> bool:
    if value.lower() not in ("true", "false", "yes", "no", "on", "off", "1", "0"):
        raise ValueError("true or false")
    return value.lower() in ("true", "yes", "on", "1")


LIMIT = Option("limit", int, "collection.default_limit")
MODULES = (
    Module("collect/file", "comments of a JSON, JSON-lines or CSV file", ("collect", "--source", "file"), (Option("path", required=True), LIMIT)),
    Module("collect/youtube", "comments of the videos found for the active keywords", ("collect", "--source", "youtube"), (LIMIT,)),
    Module("collect/video", "comments of one selected video", ("collect", "--source", "youtube"), (Option("video", required=True), Option("pages", int, "collection.youtube.max_comment_pages_per_selected_video"), LIMIT)),
    Module("cleaning/pipeline", "normalise, tokenise, mark spam and duplicates", ("clean",), (Option("reprocess", switch),)),
    Module("analysis/all", "all corpus statistics", ("analyze",)),
    *(Module(f"analysis/{m}", f"corpus statistics: {m}", ("analyze", m), (Option("show", int),)) for m in ("frequency", "ngram", "tfidf", "cooccurrence")),
    Module("discovery/candidates", "score new keyword candidates", ("discover",), (Option("max", int, "discovery.max_candidates"),)),
    Module("lexicon/kbbj", "fetch dictionary entries and propose them", ("lexicon", "fetch", "--source", "kbbj"), (Option("limit", int, "lexicon.max_entries_per_run"), Option("refresh", switch))),
    Module("review/queue", "candidates that wait for a decision", ("review",), (Option("method"), Option("limit", int), Option("details", switch))),
    Module("iterate/promote", "approved candidates become keywords of the next iteration", ("iterate",)),
)
NAMES = {int: "a whole number", switch: "true or false", str: "text"}


class Console:
    """Reads lines; ``execute`` returns what a line says. Errors are told and don't end the console."""

    def __init__(self, commands: Any, parser: argparse.ArgumentParser) -> None:
        self.commands, self.parser, self.config = commands, parser, commands.config
        self.module: Module | None = None
        self.values: dict[str, str] = {}
        self.lines: list[str] = []
        self.running = True

    def loop(self) -> None:
        while self.running:
            print(f"kataloom{f' ({self.module.path})' if self.module else ''}> ", end="", flush=True)
            line = sys.stdin.readline()
            if not line:
                break
            print(self.execute(line))

    def execute(self, line: str) -> str:
        try:
            words = shlex.split(line)
            if not words:
                return ""
            self.lines = [*self.lines, line.strip()][-int(self.config.get("ui.history_size")) :]
            own = getattr(self, f"do_{words[0].lower()}", None)
            return own(words[1:]) if own else self._command(words)
        except SystemExit:
            return f"error: unknown or incomplete command: {line.strip()}"
        except Exception as e:  # noqa: BLE001 - the console goes on
            return f"error: {e}"

    def _command(self, words: list[str]) -> str:
        args = self.parser.parse_args(words)
        return "already here" if args.command == "console" else getattr(self.commands, args.command)(args)

    def _table(self, modules: list[Module]) -> str:
        return report.table(["#", "module", "about"], [[MODULES.index(m), m.path, m.about] for m in modules])

    def _find(self, name: str) -> Module:
        if name.isdigit() and int(name) < len(MODULES):
            return MODULES[int(name)]
        for m in MODULES:
            if m.path == name.lower():
                return m
        raise ValueError(f"no module {name!r}; try: search {name}")

    def _option(self, name: str) -> Option:
        if self.module is None:
            raise ValueError("no module chosen; try: use MODULE")
        for o in self.module.options:
            if o.flag == name.lower():
                return o
        raise ValueError(f"{self.module.path} has no option {name.upper()}")

    def do_use(self, words: list[str]) -> str:
        self.module = self._find(words[0] if words else "")
        self.values = {o.flag: str(self.config.get(o.setting)) if o.setting else "false" if o.kind is switch else "" for o in self.module.options}
        return f"{self.module.path}: {self.module.about}"

    def do_back(self, words: list[str]) -> str:
        self.module, self.values = None, {}
        return ""

    def do_set(self, words: list[str]) -> str:
        if len(words) < 2:
            raise ValueError("usage: set OPTION VALUE")
        option, value = self._option(words[0]), " ".join(words[1:])
        try:
            option.kind(value)
        except ValueError:
            raise ValueError(f"{option.flag.upper()}: expected {NAMES[option.kind]}") from None
        self.values[option.flag] = value
        return f"{option.flag.upper()} => {value}"

    def do_unset(self, words: list[str]) -> str:
        option = self._option(words[0] if words else "")
        self.values[option.flag] = ""
        return f"{option.flag.upper()} unset"

    def do_show(self, words: list[str]) -> str:
        if words[:1] == ["modules"]:
            return self._table(list(MODULES))
        if words[:1] == ["options"] and self.module:
            return report.table(["option", "value", "required"], [[o.flag.upper(), self.values[o.flag], "yes" if o.required else ""] for o in self.module.options])
        raise ValueError("usage: show modules, or show options with a module chosen")

    def do_search(self, words: list[str]) -> str:
        word = " ".join(words).lower()
        found = [m for m in MODULES if word and (word in m.path or word in m.about.lower())]
        return self._table(found) if found else f"nothing found for {word!r}"

    def do_info(self, words: list[str]) -> str:
        module = self._find(words[0]) if words else self.module
        if module is None:
            raise ValueError("no module chosen; usage: info MODULE")
        return report.key_values({"module": module.path, "about": module.about, "runs": " ".join(module.command), "options": ", ".join(o.flag.upper() for o in module.options) or "-"})

    def do_run(self, words: list[str]) -> str:
        if self.module is None:
            raise ValueError("no module chosen; try: use MODULE")
        line = list(self.module.command)
        for o in self.module.options:
            value = self.values[o.flag]
            if not value and o.required:
                raise ValueError(f"{o.flag.upper()} must be set")
            if o.kind is switch:
                line += [f"--{o.flag}"] if value and switch(value) else []
            elif value:
                line += [f"--{o.flag}", value]
        return self._command(line) + f"\n{self.module.path} completed"

    def do_history(self, words: list[str]) -> str:
        return "\n".join(f"{n}  {x}" for n, x in enumerate(self.lines, 1))

    def do_help(self, words: list[str]) -> str:
        own = sorted(n[3:] for n in dir(self) if n.startswith("do_"))
        return f"console: {', '.join(own)}\ncommands: {', '.join(next(a.choices for a in self.parser._actions if isinstance(a, argparse._SubParsersAction)))}"

    def do_exit(self, words: list[str]) -> str:
        self.running = False
        return ""

    do_quit = do_exit
