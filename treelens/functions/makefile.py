"""Kbuild makefiles of one source tree to build conditions (KB1-20, SRC8-9, AGG3-6, JN13).

Ordered, stateful parsing of a tree's makefiles is plain Python; treelens.plans.buildmap runs it once per
tree on the workers.
"""

from __future__ import annotations

import posixpath
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

#: Names of architectures that share another's directory.
ARCH_ALIASES = {"i386": "x86", "x86_64": "x86", "sparc32": "sparc", "sparc64": "sparc", "parisc64": "parisc", "sh64": "sh", "tilepro": "tile", "tilegx": "tile"}
#: Suffixes that an object may be made from, the first that exists.
SOURCE_SUFFIXES = (".c", ".S", ".s", ".rs", ".l", ".y", ".ppm")
#: Directories that are built unconditionally where the top makefiles name none of them.
FLOOR = ("init", "drivers", "sound", "firmware", "net", "lib", "usr", "kernel", "mm", "fs", "ipc", "security", "crypto", "block", "certs", "virt")
MAX_COMPOSITE_DEPTH = 3

_NAME = r"CONFIG_[\w-]+"
_SYMBOL = rf"\$\(({_NAME})\)"
_IF = re.compile(rf"(ifn?eq)\s+\({_SYMBOL},\s*([ymn]?)\s*\)")
_IFDEF = re.compile(rf"(ifn?def)\s+({_NAME})")
_ASSIGN = re.compile(r"([^\s:+?=]+)\s*([+:?]?=)\s*(.*)$")
_TOP = re.compile(rf"(?:obj|core|init|drivers|net|libs|virt)-(?:[ym]|{_SYMBOL})\s*(?::=|\+=|=)\s*(.*)")
_ARCH = re.compile(rf"(?:core|init|drivers|net|libs)-(?:y|{_SYMBOL})\s*(?::=|\+=|=)\s*(.*)")
_MACHINE = re.compile(rf"(machine|plat)-(?:y|{_SYMBOL})\s*(?::=|\+=|=)\s*(.*)")
_PLATFORM = re.compile(rf"platform-{_SYMBOL}\s*\+=\s*(.*)")
_OBJECT = re.compile(rf"(?:obj|lib)-(?:[ym]|\$[({{]({_NAME})[)}}])\s*(?::=|\+=|=)\s*((?:[\w.,$()/-]+\s*)+)")
_SUBDIR = re.compile(rf"subdir-(?:y|{_SYMBOL})\s*\+=(.*)")
_FUNCTION = re.compile(r"\$\((addprefix|addsuffix)\s+([^,]*?)\s*,\s*(.*)\)$")

Alternatives = list[tuple[str, ...]]


def srcarch(arch: str) -> str:
    return ARCH_ALIASES.get(arch, arch)


def logical_lines(text: str) -> list[str]:
    """Lines without comments, continued ones joined."""
    out, held = [], ""
    for raw in text.split("\n"):
        line = raw.split("#", 1)[0].rstrip()
        if line.endswith("\\"):
            held += line[:-1] + " "
            continue
        line = (held + line).strip()
        held = ""
        if line:
            out.append(line)
    return [*out, held.strip()] if held.strip() else out


class Conditions:
    """The stack of conditional directives; lines under one that can't be read are invalid, in both branches."""

    def __init__(self) -> None:
        self._stack: list[str | None] = []

    def feed(self, line: str) -> bool:
        """Whether the line was a directive. ``else`` turns the last one round, whatever stands behind it."""
        if re.match(r"ifn?(?:eq|def)\s", line):
            read = None
            if m := _IF.match(line):
                read = m[2] if (m[1] == "ifeq") == (m[3] in ("y", "m")) else "~" + m[2]
            elif m := _IFDEF.match(line):
                read = m[2] if m[1] == "ifdef" else "~" + m[2]
            self._stack.append(read if self.valid else None)
            return True
        if re.match(r"else\b", line):
            if self._stack and self._stack[-1]:
                top = self._stack[-1]
                self._stack[-1] = top[1:] if top.startswith("~") else "~" + top
            return True
        if re.match(r"endif\b", line):
            if self._stack:
                self._stack.pop()
            return True
        return False

    @property
    def valid(self) -> bool:
        return None not in self._stack

    @property
    def depth(self) -> int:
        return len(self._stack)

    def literals(self) -> tuple[str, ...]:
        return tuple(x for x in self._stack if x)


def conjoin(above: Iterable[str], alternatives: Alternatives) -> tuple[str, ...]:
    """The conditions from above and the OR of the alternatives, unless one of these is unconditional."""
    texts = [" & ".join(a) for a in alternatives]
    own = [] if not texts or "" in texts else [texts[0] if len(texts) == 1 else f"({' | '.join(texts)})"]
    return tuple(dict.fromkeys([*above, *own]))


def join_alternatives(alts: list[str]) -> str:
    alts = list(dict.fromkeys(alts))
    return "" if "" in alts else alts[0] if len(alts) == 1 else " | ".join(f"({a})" for a in alts)


def source_of(target: str, exists) -> str | None:
    """The source that a target may be made from: its name with the first suffix that exists."""
    return next((target[:-2] + s for s in SOURCE_SUFFIXES if exists(target[:-2] + s)), None)


class Tree:
    """files: path -> text of makefiles, None for other files."""

    def __init__(self, files: dict[str, str | None], arch: str = "x86"):
        self.files, self.arch, self.srcarch = files, arch, srcarch(arch)
        self.dirs = {"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)}
        self.alts: dict[str, list[str]] = {}
        self._visited: set[tuple[str, tuple[str, ...]]] = set()

    def makefile(self, directory: str) -> str:
        kbuild = posixpath.join(directory, "Kbuild")
        return kbuild if kbuild in self.files else posixpath.join(directory, "Makefile")

    # Seeds: the directories to start from.

    def _top_lines(self, path: str) -> Iterator[str]:
        for line in logical_lines(self.files.get(path) or ""):
            yield line.replace("$(SRCARCH)", self.srcarch).replace("$(ARCH)", self.arch).replace("$(srctree)", ".")

    def _directories(self, tokens: str, form: str = "{}") -> list[str]:
        return [d for t in tokens.split() if "$(" not in t and (d := posixpath.normpath(form.format(t))) in self.dirs]

    def _arch_seeds(self) -> dict[str, Alternatives]:
        """What the architecture's makefile adds, each directory by itself overriding what the top ones say."""
        found: dict[str, Alternatives] = defaultdict(list)
        for line in self._top_lines(f"arch/{self.srcarch}/Makefile"):
            if m := _ARCH.match(line):
                places = self._directories(m[2])
                given = m[1]
            elif self.arch in ("arm", "blackfin") and (m := _MACHINE.match(line)):
                kind, given = {"machine": "mach", "plat": "plat"}[m[1]], m[2]
                places = self._directories(m[3], f"arch/{self.arch}/{kind}-{{}}") if (self.arch, kind) != ("blackfin", "plat") else []
                if self.arch == "blackfin":
                    places = [x for d in places for x in (d, f"{d}/boards") if x in self.dirs]
            else:
                if self.arch == "mips" and (m := re.match(r"include\s+(.*)", line)):
                    self._mips_platforms(m[1], found)
                continue
            for d in places:
                found[d].append((given,) if given else ())
        return found

    def _mips_platforms(self, included: str, found: dict[str, Alternatives]) -> None:
        for line in (self.files.get(posixpath.normpath(included.strip())) or "").split("\n"):
            if m := re.match(r"platforms\s*\+=\s*(.*)", line):
                for entry in self._top_lines(posixpath.normpath(f"arch/mips/{m[1].strip()}/Platform")):
                    if p := _PLATFORM.match(entry):
                        for d in self._directories(p[2], "arch/mips/{}"):
                            found[d].append((p[1],))

    def seeds(self) -> dict[str, Alternatives]:
        found: dict[str, Alternatives] = {}
        for path in ("Kbuild", "Makefile"):
            for line in self._top_lines(path):  # in conditional blocks too
                if m := _TOP.match(line):
                    for d in self._directories(m[2]):
                        found.setdefault(d, []).append((m[1],) if m[1] else ())
        for d in FLOOR:
            if d in self.dirs:
                found.setdefault(d, [()])
        return found | self._arch_seeds()

    def parse(self) -> dict[str, str]:
        for d, alternatives in self.seeds().items():
            self._read(self.makefile(d), conjoin((), alternatives))
        return {p: join_alternatives(a) for p, a in self.alts.items()}

    # One makefile.

    def _value(self, text: str, names: dict[str, str]) -> str:
        for name, value in (("srctree", "."), ("objtree", "."), ("src", "."), ("SRCARCH", self.srcarch), ("ARCH", self.arch)):
            text = text.replace(f"$({name})", value)
        text = re.sub(r"\$\(([A-Z_]+)\)", lambda m: names.get(m[1], m[0]), text)
        if m := _FUNCTION.match(text):
            text = " ".join(m[2] + t if m[1] == "addprefix" else t + m[2] for t in self._value(m[3], names).split())
        return text

    def _included(self, line: str, at: str, names: dict[str, str]) -> list[str]:
        """The files that an include line names, from the tree's root or else from the directory of the first makefile."""
        out = []
        for target in line.split()[1:]:
            rooted = target.startswith(("$(srctree)", "$(objtree)"))
            path = self._value(target.replace("$(src)", at or "."), names)
            tries = [path] if rooted or "$(src)" in target else [posixpath.join(at, path)]
            out += [p for t in tries if self.files.get(p := posixpath.normpath(t)) is not None]
        return out

    def lines(self, path: str, at: str, names: dict[str, str], seen: tuple[str, ...] = ()) -> Iterator[str]:
        """Logical lines with variables' values, and includes in place; an include that isn't there is ignored."""
        for line in logical_lines(self.files.get(path) or ""):
            if re.match(r"include\s", line):
                for p in self._included(line, at, names):
                    if p not in (*seen, path):
                        yield from self.lines(p, at, names, (*seen, path))
                continue
            line = re.sub(rf"-\$\(subst m,y,{_SYMBOL}\)", r"-$(\1)", line)
            line = re.sub(rf"-\$\(({_NAME}):m=y\)", r"-$(\1)", line)
            if m := _ASSIGN.match(line):
                value = self._value(m[3], names)
                if re.fullmatch("[A-Z_]+", m[1]):
                    if m[2] == "+=":
                        names[m[1]] = f"{names.get(m[1], '')} {value}"
                    elif m[1] not in value:  # one that names itself stays as it is
                        names[m[1]] = value
                line = f"{m[1]} {'+=' if m[2] == '+=' else ':='} {value}"
            else:
                line = self._value(line, names)
            yield line

    def _read(self, path: str, above: tuple[str, ...]) -> None:
        if self.files.get(path) is None:
            return
        at, stack = posixpath.dirname(path), Conditions()
        lines = []  # what is valid, and under which conditions
        for line in self.lines(path, at, {}):
            if not stack.feed(line) and stack.valid:
                lines.append((line, stack.literals()))
        places: dict[str, Alternatives] = defaultdict(list)
        sources: dict[str, Alternatives] = defaultdict(list)
        composites: dict[str, Alternatives] = defaultdict(list)

        def put(token: str, given: tuple[str, ...], rest) -> None:
            full = posixpath.normpath(posixpath.join(at, token))
            if full in self.dirs:
                if given not in places[full]:
                    places[full].append(given)
            elif source := source_of(full, self.files.__contains__):
                sources[source].append(given)
            else:
                rest(full)

        for raw, given in lines:
            for line in [raw.replace("$(BITS)", b) for b in ("32", "64")] if "$(BITS)" in raw else [raw]:
                if m := _OBJECT.match(line):
                    own = (*given, m[1]) if m[1] else given
                    for token in [] if m[2].startswith("$(filter-out") else m[2].split():
                        put(token, own, lambda full, own=own: composites[full].append(own))
                elif m := _SUBDIR.match(line):
                    for token in m[2].split():
                        put(token.rstrip("/") + "/", (*given, m[1]) if m[1] else given, lambda full: None)

        def expand(name: str, given: tuple[str, ...], seen: tuple[str, ...]) -> None:
            m = re.match(r"([\w,-]+)\.o|\$\(([\w,-]+)\)", posixpath.basename(name))
            if not m or name in seen or len(seen) == MAX_COMPOSITE_DEPTH:
                return
            base, forms = (m[1], rf"(?:|-y|-objs|-{_SYMBOL})") if m[1] else (m[2].removesuffix("y"), rf"(?:|y|{_SYMBOL})")
            member = re.compile(rf"{re.escape(base)}{forms}\s*(?::=|\+=|=)\s*(.*)")
            for line, block in lines:
                if not (m := member.match(line)):
                    continue
                down = (*given, m[1]) if m[1] else given
                for token in m[2].split():
                    full = posixpath.normpath(posixpath.join(posixpath.dirname(name), token))
                    if full in self.dirs:
                        places[full].append(down)
                    elif source := source_of(full, self.files.__contains__):
                        sources[source].append((*down, *block))
                    else:
                        expand(full, down, (*seen, name))

        for name, alternatives in composites.items():
            expand(name, conjoin((), alternatives), ())
        for d, alternatives in places.items():
            key = (self.makefile(d), conjoin(above, alternatives))
            if key not in self._visited:
                self._visited.add(key)
                self._read(*key)
        for source in sorted(sources):
            self.alts.setdefault(source, []).append(" & ".join(conjoin(above, sources[source])))


def resolve_arch(asked: str | None, banner: str | None, exists, strict: bool = False, config: str | None = None) -> tuple[str, list[str]]:
    """The architecture and warnings: as asked for, else as the configuration's banner says, else x86 (KB3).

    exists tells whether the tree has a directory. ValueError if the two don't agree, if the tree doesn't have it, or if strict leaves no room for a guess.
    """
    if asked and banner and srcarch(asked) != srcarch(banner):
        raise ValueError(f"architecture {asked} conflicts with {config}, which is for {banner}")
    arch = asked or banner
    if arch:
        if not exists(f"arch/{srcarch(arch)}"):
            raise ValueError(f"unknown architecture {arch}")
        return arch, []
    if strict:
        raise ValueError(f"no architecture in the banner of {config}: name one, since a guess would drop findings")
    warnings = ["assuming architecture x86"] if config else []
    return "x86", warnings if exists("arch/x86") else [*warnings, "there is no arch/x86"]
