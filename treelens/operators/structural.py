"""Structural rules over C: a subset of semantic patches on tokens (SEM1-9, 11-12, 14-26, 28-29).

A rule is ``@name depends on a && !b@ declarations @@ body``, repeated. A body is C tokens with metavariables,
``...`` for anything balanced, ``when != x`` for what may not stand in the gap before, ``\\( a \\| b \\)`` for
alternatives, also as lines that start with ``(``, ``|`` and ``)``, ``*`` for lines to report and ``@p`` for
positions. Operators may be restricted to a set, a metavariable may be inherited from an earlier rule (one value at a time), a
position may be told to differ from an earlier one. A rule anchored by ``f(...) { }`` is matched in bodies of functions of that name;
every match counts. A script that only prints reports is applied: if all rules that it binds match, and what it depends
on, the lines of the positions that it binds are reported, of those in the functions that it asks for. Without a script the starred lines are.
Matching is on token order, not on control flow, so it approximates paths by text. There are no
isomorphisms to be disabled, and ``never`` is ``!``, as a file is matched by itself. What isn't listed here is refused, never silently not found.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\w+|\.\.\.|->|\+\+|--|<<=|>>=|<<|>>|[-+*/%&|^!=<>]=|&&|\|\||\S", re.S)
_REFUSED = re.compile(r"<\+?\.\.\.|\.\.\.\+?>|when (?:exists|forall|strict)|(?:initialize|finalize|script):|^[-+][^-+=]|\\&", re.M)
_HEAD = re.compile(r"^@[ \t]*(\w*)[ \t]*(?:depends on ([^@]*?))?[ \t]*(?:disable [\w, ]+?)?[ \t]*(?:exists)?[ \t]*@(.*?)@@", re.S | re.M)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
FINDINGS = "rule_id string, path string, line int"

#: The operators that a metavariable without a set stands for.
BINARY = ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", "<", "<=", ">", ">=", "==", "!=", "&&", "||")
ASSIGNMENT = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=")
_DECLARED = re.compile(r"(binary operator|assignment operator|iterator name|declarer name|identifier|expression|statement|type|position|symbol|typedef)\s+(?!list\b)(.*)", re.S)
_SCRIPT = re.compile(r"^@[ \t]*script:\s*python\s*\w*\s*(?:depends on ([^@]*?))?\s*@(.*?)@@(.*?)(?=\n@|\Z)", re.S | re.M)
_REPORTS = re.compile(r"\s*(?:if (\w+)\[0\]\.current_element (?:==|in) \(?((?:\s*'\w+',?)+)\s*\)?:)?(?:\s*coccilib\.(?:report|org)\.print_\w+\([^\n]*\))*\s*")


class UnsupportedRule(ValueError):
    """A construct that this matcher doesn't have."""


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, line) without comments and white space."""
    out, line, at = [], 1, 0
    for m in _C.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if not m[0].startswith(("/*", "//")):
            out.append((m[0], line))
    return out


def functions(toks: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(name, first, last) of the tokens of each function's definition, from its name to its closing brace."""
    out, depth, i = [], 0, 0
    while i < len(toks):
        t = toks[i][0]
        if depth == 0 and re.fullmatch(r"[A-Za-z_]\w*", t) and i + 1 < len(toks) and toks[i + 1][0] == "(":
            close = _close(toks, i + 1)
            if close is not None and close + 1 < len(toks) and toks[close + 1][0] == "{":
                end = _close(toks, close + 1)
                if end is not None:
                    out.append((t, i, end))
                    i = end + 1
                    continue
        depth += (t in "{") - (t in "}")
        i += 1
    return out


def _close(toks: list[tuple[str, int]], i: int) -> int | None:
    want = []
    for j in range(i, len(toks)):
        t = toks[j][0]
        if t in _PAIRS:
            want.append(_PAIRS[t])
        elif want and t == want[-1]:
            want.pop()
            if not want:
                return j
    return None


class Node:
    """One match rule: its name, what it depends on, and its elements."""

    def __init__(self, name: str, depends: str, declarations: str, body: str):
        self.name, self.depends = name, (depends or "").strip()
        self.kinds: dict[str, str] = {}
        self.sets: dict[str, tuple[str, ...]] = {}  # of operators
        self.inherited: dict[str, tuple[str, str]] = {}  # metavariable: the rule and the name there
        self.apart: dict[str, tuple[str, str]] = {}  # position: the rule and the position there that it differs from
        for declaration in declarations.split(";"):
            if declaration.strip():
                self._declare(declaration.strip())
        self.items = self._items(body)

    def _declare(self, text: str) -> None:
        if not (m := _DECLARED.fullmatch(text)):
            raise UnsupportedRule(text)
        kind = m[1]
        for part in re.split(r",(?![^{]*\})", m[2]):
            n = re.fullmatch(r"\**\s*(?:(\w+)\.)?(\w+)\s*(?:(!?=)\s*(.*))?", part.strip(), re.S)
            if not n or (n[3] and kind not in ("binary operator", "assignment operator", "position")):
                raise UnsupportedRule(text)
            self.kinds[n[2]] = kind
            if n[1]:
                if kind == "position":
                    raise UnsupportedRule(text)
                self.inherited[n[2]] = (n[1], n[2])
            if kind == "position" and n[3]:
                if n[3] != "!=" or not (r := re.fullmatch(r"(\w+)\.(\w+)", n[4].strip())):
                    raise UnsupportedRule(text)
                self.apart[n[2]] = (r[1], r[2])
            elif kind.endswith("operator"):
                if n[3] and (n[3] != "=" or not re.fullmatch(r"\{.*\}", n[4].strip())):
                    raise UnsupportedRule(text)
                self.sets[n[2]] = tuple(x.strip() for x in n[4].strip()[1:-1].split(",")) if n[3] else BINARY if kind.startswith("binary") else ASSIGNMENT
        if len(set(self.inherited.values())) > 1:
            raise UnsupportedRule("several inherited metavariables")

    def _items(self, body: str) -> list:
        out: list = []
        depth, choices = 0, [[]]
        for raw in body.split("\n"):
            # A disjunction's signs stand in the first column; what is inside is read when it closes.
            if raw[:1] == "(" or (depth and raw[:1] in ("|", ")", "&")):
                sign, raw = raw[0], raw[1:]
                if sign == "&":
                    raise UnsupportedRule("conjunction")
                depth += (sign == "(") - (sign == ")")
                if depth == 0:
                    out.append(["any", [self._items("\n".join(x)) for x in choices]])
                elif sign == "(" and depth == 1:
                    choices = [[raw]]
                    continue
                elif sign == "|" and depth == 1:
                    choices.append([raw])
                    continue
                else:
                    choices[-1].append(sign + raw)
                    continue
            elif depth:
                choices[-1].append(raw)
                continue
            elif raw[:1] in ("|", ")", "&"):
                raise UnsupportedRule(f"{raw[0]} in the first column outside a disjunction")
            report = raw.startswith("*")
            line = (raw[1:] if report else raw).strip()
            if m := re.match(r"(\.\.\.\s*)?when\s+(.*)$", line):
                if m[1]:
                    out.append(["gap", []])
                gap = out[-1] if out else [""]
                if gap[0] != "gap":
                    raise UnsupportedRule(line)
                if n := re.match(r"!=\s*(.*)$", m[2]):
                    gap[1].append(self._commas(self._line(n[1], False)))
                elif m[2].strip() != "any":
                    raise UnsupportedRule(line)
                continue
            if re.match(r"#\s*define\b", line) and "..." in line:
                raise UnsupportedRule(line)
            out += self._line(line, report)
        if depth:
            raise UnsupportedRule("a disjunction that doesn't close")
        return self._commas(out)

    def _line(self, line: str, report: bool) -> list:
        out, at = [], 0
        for m in re.finditer(r"\\\((.*?)\\\)", line):
            out += self._plain(line[at : m.start()], report)
            out.append(["any", [self._plain(x, report) for x in m[1].split("\\|")]])
            at = m.end()
        return out + self._plain(line[at:], report)

    def _plain(self, text: str, report: bool) -> list:
        """Tokens; a position behind an @ belongs to the token before it."""
        out: list = []
        read = tokens(text)
        i = 0
        while i < len(read):
            t = read[i][0]
            if t == "@" and i + 1 < len(read) and self.kinds.get(read[i + 1][0]) == "position":
                out.append(["at", read[i + 1][0]])
                i += 2
                continue
            out.append(["gap", []] if t == "..." else ["tok", self._token(t), report])
            i += 1
        return out

    def _commas(self, items: list) -> list:
        """An empty gap takes the comma beside it along."""
        comma = lambda x: x[0] == "tok" and x[1] == ("", ",")
        out, i = [], 0
        while i < len(items):
            if items[i] == ["gap", []] and i + 1 < len(items) and comma(items[i + 1]):
                out.append(["any", [[items[i], items[i + 1]], []]])
                i += 2
            elif comma(items[i]) and i + 2 < len(items) and items[i + 1] == ["gap", []] and items[i + 2][0] == "tok" and items[i + 2][1][1] in (")", "}"):
                out.append(["any", [[items[i], items[i + 1]], []]])
                i += 2
            else:
                out.append(items[i])
                i += 1
        return out

    def _token(self, t: str) -> tuple[str, str]:
        kind = self.kinds.get(t, "")
        return ("operator" if kind.endswith("operator") else kind, t) if kind.endswith("operator") or kind in ("identifier", "expression", "statement", "type") else ("", t)

    def anchor(self) -> str | None:
        """The function that the body starts with, if it does."""
        plain = [x for x in self.items if x[0] != "at"]
        if len(plain) > 1 and plain[0][0] == plain[1][0] == "tok" and plain[0][1][0] == "" and plain[1][1][1] == "(" and re.fullmatch(r"[A-Za-z_]\w*", plain[0][1][1]) and any(x[0] == "tok" and x[1][1] == "{" for x in plain):
            return plain[0][1][1]
        return None


class Script:
    """A script that reports: the rules and positions that it binds, the functions it asks for, and what it depends on."""

    def __init__(self, depends: str, bindings: str, code: str):
        if not (m := _REPORTS.fullmatch(code)):
            raise UnsupportedRule(code.strip())
        names = [re.fullmatch(r"(\w+)\s*<<\s*(\w+)\.(\w+)", x.strip()) for x in bindings.split(";") if x.strip()]
        if not all(names):
            raise UnsupportedRule(bindings.strip())
        self.depends, self.bound = (depends or "").strip(), [(n[1], n[2], n[3]) for n in names]
        self.inside = (m[1], frozenset(re.findall(r"'(\w+)'", m[2]))) if m[1] else None


def parse(text: str) -> list[Node | Script]:
    code = "\n".join(x for x in text.split("\n") if not x.lstrip().startswith("//"))
    code = re.sub(r"virtual\s+[\w, ]+?\s*;?(?=\n|$)", "", code)
    scripts = [(m.start(), Script(m[1], m[2], m[3])) for m in _SCRIPT.finditer(code)]
    code = _SCRIPT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    if m := _REFUSED.search(code):
        raise UnsupportedRule(m[0])
    heads = list(_HEAD.finditer(code))
    if not heads or code[: heads[0].start()].strip():
        raise UnsupportedRule("no match rule, or something before it")
    bodies = [code[h.end() : heads[i + 1].start() if i + 1 < len(heads) else len(code)] for i, h in enumerate(heads)]
    if odd := next((m[0] for body in bodies if (m := re.search(r"^@.*", body, re.M))), None):
        raise UnsupportedRule(odd)
    nodes = [Node(h[1], h[2], h[3], body) for h, body in zip(heads, bodies, strict=True)]
    known = {n.name for n in nodes}
    for node in nodes:
        if not {rule for rule, _ in [*node.inherited.values(), *node.apart.values()]} <= known:
            raise UnsupportedRule("a metavariable of no earlier rule")
    return [x for _, x in sorted([*scripts, *zip([h.start() for h in heads], nodes, strict=True)], key=lambda x: x[0])]


class _Matcher:
    """All matches of a rule in one file: what is left of a rule at a place is worked out once.

    What a match finds are marks: ("*", token) of reported lines, (position, token), and ("=name", text) of the metavariables that are exported.
    """

    def __init__(self, toks, node: Node, exported: frozenset[str] = frozenset(), apart: dict[str, set[int]] | None = None):
        self.toks, self.node, self.exported, self.apart = toks, node, exported, apart or {}
        self.known: dict = {}
        self.joined: dict = {}

    def same(self, want: tuple[str, str], i: int, env: dict) -> Iterator[tuple[int, dict]]:
        """The ends at which a token or metavariable can match from i."""
        toks, (kind, name) = self.toks, want
        if i >= len(toks):
            return
        if kind == "":
            if toks[i][0] == name:
                yield i + 1, env
        elif kind == "operator":
            if toks[i][0] in self.node.sets[name] and env.get(name, (toks[i][0],)) == (toks[i][0],):
                yield i + 1, env | {name: (toks[i][0],)}
        elif kind in ("identifier", "type"):
            if re.fullmatch(r"[A-Za-z_]\w*", toks[i][0]) and env.get(name, (toks[i][0],)) == (toks[i][0],):
                yield i + 1, env | {name: (toks[i][0],)}
        elif name in env:
            n = len(env[name])
            if tuple(t for t, _ in toks[i : i + n]) == env[name]:
                yield i + n, env
        else:
            j = i
            while j < len(toks) and toks[j][0] not in ("}", ")", "]", ",", ";"):
                close = _close(toks, j) if toks[j][0] in _PAIRS else j
                if close is None:
                    return
                j = close + 1
                yield j, env | {name: tuple(t for t, _ in toks[i:j])}
            if kind == "statement" and j < len(toks) and toks[j][0] == ";":
                yield j + 1, env | {name: tuple(t for t, _ in toks[i : j + 1])}

    def marks(self, items: list, k: int, i: int, end: int, env: dict) -> frozenset | None:
        """The marks of all matches of items from k at i; None if there is none."""
        key = (id(items), k, i, end, tuple(sorted(env.items())))
        if key not in self.known:
            found = None
            for more in self._each(items, k, i, end, env):
                if more is not None:
                    found = more if found is None else found | more
            self.known[key] = found
        return self.known[key]

    def _each(self, items: list, k: int, i: int, end: int, env: dict) -> Iterator[frozenset | None]:
        toks = self.toks
        if k == len(items):
            yield frozenset(("=" + name, env[name]) for name in self.exported if name in env)
            return
        item = items[k]
        if item[0] == "tok":
            for j, new in self.same(item[1], i, env):
                if j <= end:
                    more = self.marks(items, k + 1, j, end, new)
                    yield more | {("*", i)} if more is not None and item[2] else more
        elif item[0] == "at":  # of the token before
            if i - 1 not in self.apart.get(item[1], ()):
                more = self.marks(items, k + 1, i, end, env)
                yield None if more is None else more | {(item[1], i - 1)}
        elif item[0] == "any":
            for n, choice in enumerate(item[1]):
                rest = self.joined.setdefault((id(items), k, n), choice + items[k + 1 :])
                yield self.marks(rest, 0, i, end, env)
        else:
            depth = 0
            for j in range(i, end + 1):
                if any(self.marks(x, 0, p, end, env) is not None for x in item[1] for p in range(max(i, j - 1), j)):
                    return
                yield self.marks(items, k + 1, j, end, env)
                if j < end:
                    depth += (toks[j][0] in "([{") - (toks[j][0] in ")]}")
                    if depth < 0:
                        return


def _depends(text: str, found: set[str]) -> bool:
    if not text:
        return True
    text = re.sub(r"\bnever\s+", "!", re.sub(r"\bever\s+", "", text))
    names = re.sub(r"\w+", lambda m: str(m[0] in found or m[0] == "detect"), text)
    expr = names.replace("&&", " and ").replace("||", " or ").replace("!", " not ")
    if not re.fullmatch(r"[\s()]*(?:(?:True|False|and|or|not)[\s()]*)+", expr):
        raise UnsupportedRule(text)
    return bool(eval(expr))  # noqa: S307  only the words above


def matches(nodes: list[Node | Script], text: str) -> list[int]:
    """The reported lines of all matches of the rules that match, or of those that a script reports; empty if the rule isn't found in the text."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # a few frames for each token of a rule
    toks = tokens(text)
    defined = functions(toks)
    found: dict[str, set] = {}
    lines: set[int] = set()
    scripted = any(isinstance(node, Script) for node in nodes)
    wanted = {(rule, name) for node in nodes if isinstance(node, Node) for rule, name in node.inherited.values()}
    within = lambda i: next((f for f, a, b in defined if a <= i <= b), None)
    for node in nodes:
        if not _depends(node.depends, set(found)):
            continue
        if isinstance(node, Script):
            if all(rule in found for _, rule, _ in node.bound):
                for own, rule, name in node.bound:
                    at = [i for mark, i in found[rule] if mark == name]
                    lines |= {toks[i][1] for i in at if not node.inside or node.inside[0] != own or within(i) in node.inside[1]}
            continue
        if any(rule not in found for rule, _ in node.inherited.values()):
            continue
        apart = {p: {i for mark, i in found.get(rule, ()) if mark == name} for p, (rule, name) in node.apart.items()}
        envs: list[dict] = [{}]
        for own, (rule, name) in node.inherited.items():
            envs = [{own: v} for mark, v in sorted(found[rule], key=str) if mark == "=" + name]
        matcher = _Matcher(toks, node, frozenset(name for rule, name in wanted if rule == node.name), apart)
        name = node.anchor()
        spans = [(a, b + 1) for f, a, b in defined if f == name] if name else [(i, len(toks)) for i in range(len(toks))]
        own = set()
        hit = False
        for a, b in spans:
            for env in envs:
                if (marks := matcher.marks(node.items, 0, a, b, env)) is not None:
                    hit = True
                    own |= marks or {("*", a)}
        if hit:
            found.setdefault(node.name, set()).update(own)
            if not scripted:
                starred = {toks[i][1] for mark, i in own if mark == "*"}
                lines |= starred or {toks[i][1] for mark, i in own if not mark.startswith("=")}
    return sorted(lines)


def _reason(body: str) -> str | None:
    try:
        for node in parse(body):
            _depends(node.depends, set())
    except UnsupportedRule as wrong:
        return f"unsupported: {wrong}"
    return None


def judged(rules: DataFrame) -> DataFrame:
    """rules (rule_id, body, ...) with ``reason``: why a rule can't be read, NULL if it can."""

    @F.pandas_udf("string")
    def reason(bodies: pd.Series) -> pd.Series:
        return bodies.map(_reason)

    return rules.withColumn("reason", reason("body"))


def scan(files: DataFrame, rules: DataFrame, all_files: bool = False) -> DataFrame:
    """(rule_id, path, line) of structural rules over the files that they hint at, by an equi-join, or over all; then a pass in Python.

    Rules that can't be read are left out: judged() tells which.
    """
    rules = judged(rules).where("reason is null").drop("reason")
    if all_files:  # every task holds all rules against its files
        pack = [(r.rule_id, r.body) for r in rules.select("rule_id", "body").limit(MAX_RULES + 1).collect()]
        if len(pack) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        met = files.select(F.lit("").alias("rule_id"), F.lit("").alias("body"), "path", "content")
    else:
        pack = []
        met = files.join(rules.selectExpr("rule_id", "body", "explode(files) as path").distinct(), "path").select("rule_id", "body", "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = {rule_id: parse(body) for rule_id, body in pack}
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if not all_files and r.rule_id not in parsed:
                    parsed[r.rule_id] = parse(r.body)
                for rule_id in parsed if all_files else (r.rule_id,):
                    rows += [(rule_id, r.path, line) for line in matches(parsed[rule_id], r.content or "")]
            yield pd.DataFrame(rows, columns=["rule_id", "path", "line"])

    return met.mapInPandas(run, FINDINGS)


#: Rules that are held against all files.
MAX_RULES = 10_000


def found(findings: DataFrame) -> DataFrame:
    """(rule_id, path) of the files with a finding."""
    return findings.select("rule_id", "path").distinct()
