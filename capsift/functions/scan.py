"""Syntax nodes of shell text and of code, for tasks: commands, substitutions, calls and imports, by a pushdown parser with an explicit stack.

A node is an interval of the text with its level, so what holds what is a comparison of intervals. One pass reads a text; nesting, quotes and here-documents have no bound. Time is linear in the text: no
expression repeats a group that holds a choice, no search for a closing mark is made twice. What stands in a string that nothing closes is read a second time, as if its quote were a plain
character, at the end of what holds it: each character belongs to one such string at most.

The text of a word or argument is carried with the node. What lies DEEP levels below it and further is shown as `$(...)` or `(...)` there, so all words of a text together are at most DEEP times the text; the nodes
that lie there are nodes like any other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

DEEP = 32

_SHELL = re.compile(
    r"""(?P<cont>\\\n)|(?P<escape>\\.)|(?P<quoted>\$?'[^']*')|(?P<math>\$\(\([^()]*(?:\([^()]*\)[^()]*){0,9}\)\))|(?P<brace>\$\{[^}$\n]*\})|(?P<open>\$\(|[<>]\()|(?P<tick>`)|(?P<double>")"""
    r"""|(?P<here><<-?(?!<)[ \t]*(?P<mark>'[^'\n]*'|"[^"\n]*"|\\?[^\s'"`\\$<>;|&()]+))|(?P<redirect>&?[<>]{1,3}[&|]?)|(?P<op>\|&|\|\||&&|;;&?|;&|[;|&()\n])|(?P<space>[ \t\r\f\v]+)|(?P<plain>[^\s'"`\\$<>;|&()]+)|(?P<any>.)""",
    re.S,
)
_IN_DOUBLE = re.compile(r"""(?P<escape>\\.)|(?P<open>\$\()|(?P<tick>`)|(?P<double>")|(?P<plain>[^"\\$`]+)|(?P<any>.)""", re.S)
_SIMPLE = re.compile(r"""[^\n'"`\\$<>;|&()#\[]*\n""")
_KEYWORDS = {"if", "then", "else", "elif", "do", "while", "until", "time", "!", "{"}
_ASSIGNED = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")
_NO_COMMAND = {"for", "case", "select", "function", "done", "fi", "esac", "}", "in", "]]"}
_TEXT = ('"', "<<")


class Command:
    __slots__ = ("end", "extra", "level", "pipe", "redirect", "start", "words")

    def __init__(self, level: int):
        self.words, self.start, self.end, self.redirect, self.pipe, self.extra, self.level = [], -1, -1, None, None, False, level


class _Frame:
    """What one level of nesting has open: a substitution, a string or the body of a here-document."""

    __slots__ = ("at", "cases", "closer", "command", "height", "inner", "kids", "level", "live", "piped", "rest", "start", "statements", "target", "test", "word_kids")

    def __init__(self, closer: str, start: int, level: int):
        self.closer, self.start, self.level, self.command, self.at, self.inner, self.target, self.piped, self.test = closer, start, level, Command(level), -1, 0, False, [], False
        # kids: (start, end, height) of what is nested and closed; cases: of each open `case` whether a pattern or a body comes; rest: here-documents that follow
        self.kids, self.word_kids, self.height, self.cases, self.live, self.statements, self.rest = [], [], 0, [], False, 0, None


def _cut(text: str, a: int, b: int, kids: list, shown: str) -> str:
    """text[a:b], with what is nested deeper than DEEP levels shown as `shown`."""
    if not any(h >= DEEP for _, _, h in kids):
        return text[a:b]
    out = []
    for start, end, h in kids:
        if h >= DEEP and a <= start:
            out += [text[a:start], shown]
            a = end
    return "".join([*out, text[a:b]])


class _Shell:
    def __init__(self, text: str):
        self.text = text
        self.found: dict[int, Command] = {}
        self.inside: list[tuple] = []
        self.pending: list[tuple[str, bool]] = []
        self.lines: dict | None = None
        self.stack = [_Frame("", 0, 0)]

    def word(self, f: _Frame, end: int) -> None:
        """The word that began at f.at ends."""
        if f.at < 0:
            return
        word, c = _cut(self.text, f.at, end, f.word_kids, "$(...)"), f.command
        start, f.at, f.word_kids = f.at, -1, []
        if f.target:
            f.target, c.end = False, end
            if c.redirect is None and c.extra:
                c.redirect = word
            return
        if not c.words and (word in _KEYWORDS or _ASSIGNED.match(word)):
            f.live = True
            return
        if not c.words:
            c.start, f.test = start, word == "[["
        elif word == "]]":
            f.test = False
        c.words.append(word)
        c.end = end

    def close(self, f: _Frame, op: str) -> None:
        """The command ends at an operator."""
        c, f.command, f.target, f.test = f.command, Command(f.level), False, False
        head = c.words[0] if c.words else ""
        if f.cases and f.cases[-1] == "pattern":
            f.piped = []
            if head != "esac":
                return
        f.live |= bool(c.words) or c.redirect is not None or c.end >= 0
        if head == "case" and "in" in c.words[2:]:
            f.cases.append("pattern")
        elif head == "esac" and f.cases:
            f.cases.pop()
        elif head and head not in _NO_COMMAND:
            self.found.setdefault(c.start, c)
            if f.piped:
                f.piped[-1].pipe = c.words
            f.piped.append(c)
        if op in (";;", ";&", ";;&") and f.cases:
            f.cases[-1] = "pattern"
        if not op.startswith("|") or op == "||":
            f.piped = []
            if op not in ("||", "&&"):
                f.statements += f.live
                f.live = False

    def bodies(self, at: int, limit: int) -> tuple[int, list]:
        """Where text goes on behind the here-documents that begin at `at`, and their bodies, last first; one without an end is none."""
        if self.lines is None:
            self.lines = defaultdict(list)
            for m in re.finditer(r"^.*$", self.text, re.M):
                self.lines[m[0].strip("\t").rstrip()].append(m.start())
        out = []
        for mark, literal in self.pending:
            places = self.lines.get(mark, [])
            i = bisect_left(places, at)
            if i < len(places) and places[i] < limit:
                end = self.text.find("\n", places[i], limit)
                out.append((at, places[i], literal))
                at = limit if end < 0 else end
        self.pending = []
        return at, out[::-1]

    def next_body(self, rest: tuple[int, list], ends: list[int]) -> int:
        """Opens the next body in which substitutions count; where to go on."""
        at, bodies = rest
        while bodies:
            start, place, literal = bodies.pop()
            if not literal and start < place:
                f = _Frame("<<", start, self.stack[-1].level)
                f.rest = rest
                self.stack.append(f)
                ends.append(place)
                return start
        return at

    def scan(self, at: int, stop: int, again: dict | None = None) -> None:
        """Reads to `stop`, where all that it has opened is closed. again: what is nested in a string that is read a second time (start: end and height); quotes are plain characters then."""
        text, stack, ends, base = self.text, self.stack, [stop], len(self.stack)
        while True:
            limit = ends[-1]
            if at >= limit:
                if len(ends) == 1:
                    break
                self.unwind(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].closer == "<<") + 1, limit)
                ends.pop()
                body = stack.pop()
                stack[-1].height = max(stack[-1].height, body.height)
                self.pending = []
                at = self.next_body(body.rest, ends)
                continue
            f = stack[-1]
            if again and at in again:
                end, height = again[at]
                if f.at < 0:
                    f.at = at
                f.word_kids.append((at, end, height))
                at = end
                continue
            if f.at < 0 and f.closer not in _TEXT and not (f.command.words or f.target or f.piped or self.pending or f.cases) and (m := _SIMPLE.match(text, at, limit)):
                self.simple(f, m[0], at)
                at = m.end()
                continue
            m = (_IN_DOUBLE if f.closer in _TEXT else _SHELL).match(text, at, limit)
            kind, start, at = m.lastgroup, at, m.end()
            if kind == "mark":
                kind = "here"
            if kind == "double" and (again is not None or f.closer == "<<"):
                kind = "plain"
            if kind == "double" and f.closer == '"':
                self.unquote()
                continue
            if kind == "tick" and f.closer not in _TEXT and text.startswith("``", at) and not text[max(0, start - 4) : start].rpartition("\n")[2].strip(" ") and (start < 4 or "\n" in text[start - 4 : start]):
                end = text.find("\n", start, limit)  # the fence of a block is no substitution
                at = limit if end < 0 else end
                continue
            if kind == "tick" and len(stack) > base and "`" in (f.closer, f.closer == '"' and stack[-2].closer):
                if f.closer == '"':  # left open within the back quotes
                    self.unquote()
                if len(stack) > base:
                    self.shut(start, at)
                continue
            if kind in ("double", "tick", "open"):
                if f.at < 0:
                    f.at = start
                stack.append(_Frame({"double": '"', "tick": "`"}.get(kind, ")"), start, f.level + (kind != "double")))
                continue
            if f.closer in _TEXT:
                continue
            if f.test and kind in ("op", "redirect", "here") and text[start] != "\n":
                if f.at >= 0 and text[f.at : start] == "]]":
                    self.word(f, start)
                else:
                    kind = "plain"
            if kind in ("space", "cont"):
                self.word(f, start)
            elif kind == "op":
                at = self.operator(m[0], start, at, len(stack) > base)
                if m[0] == "\n" and self.pending:
                    at = self.next_body(self.bodies(at, limit), ends)
            elif kind == "here":
                self.word(f, start)
                self.pending.append((m["mark"].strip("\\'\""), m["mark"][0] in "\\'\""))
            elif kind == "redirect":
                numbered = f.at >= 0 and text[f.at : start].isdigit()
                if numbered:
                    f.at = -1
                self.word(f, start)
                f.target, f.command.extra = True, not numbered and m[0] == ">"
            elif f.at < 0 and kind == "plain" and text[start] == "#":
                end = text.find("\n", start, limit)
                at = limit if end < 0 else end
            elif f.at < 0:
                f.at = start
        self.unwind(base, stop)

    def unwind(self, down: int, end: int) -> None:
        """What is still open above `down` ends here; strings are read again as plain text."""
        stack, child = self.stack, None
        while len(stack) > down:
            g = stack.pop()
            if g.closer == '"':
                f = stack[-1]
                if f.at < 0:
                    f.at = g.start
                self.scan(g.start + 1, child.start if child else end, {a: (b, h) for a, b, h in g.kids})
                g = child
                if child is None:
                    continue
            elif g.closer != "<<":
                self.word(g, end)
                self.close(g, "")
            child = g
            if stack and len(stack) > down - 1 and stack[-1].closer != '"':
                f = stack[-1]
                f.height = max(f.height, g.height + 1)
                if g.closer != "<<" and f.closer not in _TEXT:
                    f.at = g.start if f.at < 0 else f.at
                    f.word_kids.append((g.start, end, g.height + 1))
                child = None

    def run(self) -> None:
        n = len(self.text)
        self.scan(0, n)
        f = self.stack.pop()
        self.word(f, n)
        self.close(f, "")

    def unquote(self) -> None:
        """A string ends; what is nested in it is part of the word around it."""
        f = self.stack.pop()
        p = self.stack[-1]
        p.kids += f.kids
        p.word_kids += f.kids
        p.height = max(p.height, f.height)

    def simple(self, f: _Frame, line: str, at: int) -> None:
        """A command on a line of its own that holds nothing but words."""
        words, i = line.split(), 0
        while i < len(words) and (words[i] in _KEYWORDS or _ASSIGNED.match(words[i])):
            i += 1
        f.statements += f.live or bool(words)
        f.live = False
        if i < len(words) and words[i] == "case" and "in" in words[i + 2 :]:
            f.cases.append("pattern")
        elif i < len(words) and words[i] not in _NO_COMMAND:
            c = Command(f.level)
            c.words, c.start, c.end = words[i:], at, at + 1
            self.found.setdefault(at, c)

    def shut(self, start: int, end: int) -> None:
        """The innermost substitution ends."""
        f = self.stack.pop()
        self.word(f, start)
        self.close(f, "")
        kid = (f.start, end, f.height + 1)
        p = self.stack[-1]
        p.height = max(p.height, f.height + 1)
        p.kids.append(kid)
        p.word_kids.append(kid)
        mark = "`" if f.closer == "`" else self.text[f.start : f.start + 2]
        self.inside.append((f.start, end, p.level, mark, f.statements, _cut(self.text, f.start + len(mark), start, f.kids, "$(...)")))

    def operator(self, op: str, start: int, at: int, own: bool) -> int:
        """Where to go on. own: whether the frame may be closed here."""
        f = self.stack[-1]
        if op == "(":
            if self.text.startswith(")", at) and len(f.command.words) + (f.at >= 0) == 1:  # a function's name
                f.at, f.command, f.word_kids = -1, Command(f.level), []
                return at + 1
            if not (f.cases and f.cases[-1] == "pattern"):
                f.inner += 1
        elif op == ")":
            self.word(f, start)
            words = f.command.words
            if f.cases and f.cases[-1] == "pattern" and words[:1] == ["esac"]:
                f.cases.pop()
                f.command, f.live = Command(f.level), True
            elif f.cases and f.cases[-1] == "pattern":
                f.cases[-1], f.command, f.piped = "body", Command(f.level), []
                return at
            elif words[:1] == ["case"] and "in" in words[2:]:
                f.cases.append("body")
                f.command, f.piped = Command(f.level), []
                return at
            if f.inner:
                f.inner -= 1
            elif f.closer == ")" and own:
                self.shut(start, at)
                return at
        self.word(f, start)
        self.close(f, op)
        return at


def _liner(text: str):
    breaks = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(breaks, at) + 1


def shell_nodes(text: str) -> tuple[list[tuple], list[tuple]]:
    """Commands by their place: (line, last line, words, words of the command it is piped to or None, file it is written to or None, start, end, level). Substitutions that are closed: (line, last line, mark,
    number of statements, text within, start, end, level)."""
    s = _Shell(text)
    s.run()
    line = _liner(text)
    commands = [(line(c.start), line(max(c.end - 1, c.start)), c.words, c.pipe or None, c.redirect, c.start, c.end, c.level) for c in sorted(s.found.values(), key=lambda c: c.start)]
    return commands, [(line(a), line(b - 1), mark, n, inner, a, b, level) for a, b, level, mark, n, inner in sorted(s.inside)]


def shell(text: str) -> list[tuple]:
    """Commands by their place: (line, last line, words, words of the command it is piped to or None, file it is written to or None)."""
    return [c[:5] for c in shell_nodes(text)[0]]


_CODE = {
    "javascript": re.compile(r"""(?P<comment>//[^\n]*|/\*)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<text>`)|(?P<escape>\\.)|(?P<name>[A-Za-z_$][\w$]*)|(?P<open>[(\[{])|(?P<shut>[)\]}])|(?P<comma>,)|(?P<space>\s+)|(?P<number>\d[\w.]*)|(?P<any>.)""", re.S),
    "python": re.compile(r"""(?P<comment>\#[^\n]*)|(?P<text>[rRbBuU]?[fF][rR]?(?:\"\"\"|'''|"|'))|(?P<triple>[A-Za-z]{0,2}(?:\"\"\"|'''))|(?P<string>[A-Za-z]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))|(?P<escape>\\.)|(?P<name>[A-Za-z_]\w*)|(?P<open>[(\[{])|(?P<shut>[)\]}])|(?P<comma>,)|(?P<space>\s+)|(?P<number>\d[\w.]*)|(?P<any>.)""", re.S),
}
#: Within strings that hold expressions.
_IN_TEXT = {
    "javascript": re.compile(r"""(?P<escape>\\.)|(?P<open>\$\{)|(?P<quote>`)|(?P<plain>[^`\\$]+)|(?P<any>.)""", re.S),
    "python": re.compile(r"""(?P<escape>\\.|\{\{|\}\})|(?P<open>\{)|(?P<quote>\"\"\"|'''|"|')|(?P<line>\n)|(?P<plain>[^{}"'\\\n]+)|(?P<any>.)""", re.S),
}
_SLASHED = re.compile(r"[^/\\\[\]\n]+|\\[^\n]|[/\[\]]")
#: Words before a bracket that make no call.
_NO_CALL = {
    "if", "while", "for", "switch", "catch", "return", "function", "with", "typeof", "await", "in", "of", "and", "or", "not", "elif", "yield", "assert", "del", "lambda", "void", "throw", "else", "case", "def", "class", "import", "super",
}
#: Words behind which a slash begins a regular expression.
_BEFORE_SLASH = {"return", "typeof", "case", "in", "of", "void", "throw", "else", "do", "yield", "await", "delete", "new"}
_DEFINES = {"function", "def", "class"}
_ENDS_IMPORT = {"const", "let", "var", "function", "class", "async", "return"}
_MODULE = {"import": re.compile(r"[ \t]+([A-Za-z_][\w.]*)"), "from": re.compile(r"[ \t]+(\.*[\w.]*)[ \t]*import\b")}
_SHUTS = {"(": ")", "[": "]", "{": "}"}


class _Call:
    """An open bracket, with a name the call that it belongs to; or a string that holds expressions."""

    __slots__ = ("args", "at", "first", "height", "key", "kids", "level", "name", "object", "pairs", "shut", "start", "text", "token")

    def __init__(self, shut: str, name: str | None, start: int, at: int, level: int, text: bool = False):
        self.shut, self.name, self.start, self.at, self.level, self.text, self.args, self.first = shut, name, start, at, level, text, [], None
        # pairs: of braces, (key or None, value); object: the braces that an argument is; token: where an argument's first token stands
        self.kids, self.height, self.pairs, self.key, self.object, self.token = [], 0, [], None, None, -1


class _Code:
    def __init__(self, text: str, grammar: str):
        self.text, self.token, self.inner, self.script = text, _CODE[grammar], _IN_TEXT[grammar], grammar == "javascript"
        self.stack: list[_Call] = []
        self.calls: list[tuple] = []
        self.imports: list[tuple] = []
        self.texts: dict[int, str] = {}

    def said(self, inside) -> None:
        """The first string within each call that is open, DEEP of them at most. A number stands for a string that is still open."""
        for f in self.stack[: -DEEP - 1 : -1]:
            if f.first is not None:
                break
            f.first = inside

    def cut(self, f: _Call, end: int) -> str:
        return _cut(self.text, f.at, end, f.kids, "(...)")

    def argument(self, f: _Call, end: int) -> None:
        """An argument of a call ends: (text, form, keys, values); the form tells objects and keywords from the rest."""
        whole = self.cut(f, end)
        arg = whole.strip()
        if arg:
            form, keys, values = None, None, None
            if f.object and f.object.start == f.at + len(whole) - len(whole.lstrip()) and f.object.at == end - (len(whole) - len(whole.rstrip())):
                form, keys, values = "{", [k for k, _ in f.object.pairs], [v for _, v in f.object.pairs]
            elif f.key is not None:
                key, at = f.key
                form, keys, values = "=", [key], [_cut(self.text, at, end, [k for k in f.kids if k[0] >= at], "(...)").strip()]
            f.args.append((arg, form, keys, values))
        f.kids, f.object, f.key = [], None, None

    def pair(self, f: _Call, end: int) -> None:
        """A field of braces ends."""
        value = self.cut(f, end).strip()
        if f.key is not None or value:
            f.pairs.append((f.key, value))
        f.kids, f.key = [], None

    def shut(self, mark: str, start: int, end: int) -> None:
        if not any(f.shut == mark and not f.text for f in self.stack[-4:]):
            return
        while self.stack[-1].shut != mark:
            self.drop(end)
        f = self.stack.pop()
        if f.name is not None:
            self.argument(f, start)
            first = self.texts.get(f.first) if isinstance(f.first, int) else f.first
            self.calls.append((f.start, end, f.level, [f.name, *f.args], first))
        elif mark == "}" and self.stack and self.stack[-1].name is not None:
            self.pair(f, start)
            f.at = end
            self.stack[-1].object = f
        self.kid(f, end)

    def kid(self, f: _Call, end: int) -> None:
        if self.stack:
            p = self.stack[-1]
            p.height = max(p.height, f.height + 1)
            p.kids.append((f.start, end, f.height + 1))

    def drop(self, end: int) -> None:
        """An open bracket that nothing closes."""
        self.kid(self.stack.pop(), end)

    def slashed(self, at: int, limit: int) -> int:
        """Where a regular expression that begins at a slash ends, or -1."""
        inside, at = False, at + 1
        while at < limit and (m := _SLASHED.match(self.text, at, limit)):
            at = m.end()
            if m[0] == "[":
                inside = True
            elif m[0] == "]":
                inside = False
            elif m[0] == "/" and not inside:
                return at
        return -1

    def end_text(self, f: _Call, start: int, end: int) -> None:
        self.stack.pop()
        if f.start in self.texts:
            self.texts[f.start] = _cut(self.text, f.at, start, f.kids, "${...}")
        self.kid(f, end)

    def scan(self, at: int, limit: int, again: dict | None = None) -> None:
        """again: what is nested in a string that is read a second time, as code (start: end)."""
        text, stack = self.text, self.stack
        # name: (its parts, where it begins) just before; before: the word before that; prior: the last token; statement: an import that waits for its module; dotted: a name that goes on behind a dot
        name, before, prior, statement, fresh, dotted, operand, no_slash = None, "", "", None, True, None, False, -1
        while at < limit:
            f = stack[-1] if stack else None
            if again and at in again:
                at, name, prior, operand = again[at], None, "", True
                continue
            if f is not None and f.text:
                m = self.inner.match(text, at, limit)
                kind, start, at = m.lastgroup, at, m.end()
                if kind == "open":
                    stack.append(_Call("}", None, start, at, f.level))
                    name, before, prior, fresh, operand = None, "", "{", False, False
                elif kind == "line" and len(f.shut) == 1:
                    self.end_text(f, start, start)
                elif kind == "quote" and m[0].startswith(f.shut) and (len(m[0]) == len(f.shut) or len(f.shut) == 1):
                    at = start + len(f.shut)
                    self.end_text(f, start, at)
                    name, before, prior, operand = None, "", "", True
                continue
            m = self.token.match(text, at, limit)
            kind, start, at = m.lastgroup, at, m.end()
            if kind == "comment":
                if m[0] == "/*":
                    end = text.find("*/", at, limit)
                    at = at if end < 0 else end + 2
                continue
            if kind == "space":
                if "\n" in m[0]:
                    fresh = True
                    name, dotted = (name, dotted) if self.script or stack else (None, None)
                continue
            if kind == "escape" and m[0] == "\\\n":
                continue
            if f is not None and f.token < f.at:
                f.token = start
            if kind == "any" and m[0] == "/" and self.script and not operand and start > no_slash:
                if (end := self.slashed(start, limit)) > 0:
                    at, name, before, prior, operand, fresh = end, None, "", "", True, False
                    continue
                no_slash = text.find("\n", start, limit)
                no_slash = limit if no_slash < 0 else no_slash
            if kind == "name":
                word, begins = m[0], start
                if prior == ".":
                    parts, begins = (dotted[0], dotted[1]) if dotted else ([""], start)
                    parts.append(word)
                    name, prior, fresh, operand, dotted = (parts, begins), word, False, True, None
                    continue
                if self.script:
                    if word in ("import", "export"):
                        statement = (start, word)
                    elif word in _ENDS_IMPORT:
                        statement = None
                elif fresh and word in _MODULE and (found := _MODULE[word].match(text, at, limit)):
                    self.imports.append((start, word, found[1]))
                last = name[0][0] if name and len(name[0]) == 1 else ""
                if last == "new":
                    word, begins = f"new {word}", name[1]
                before, name, prior, fresh, operand, dotted = last, ([word], begins), m[0], False, m[0] not in _BEFORE_SLASH, None
                continue
            if kind == "text" and again is None:
                f = _Call(m[0].lstrip("rRbBuUfF"), None, start, at, len(stack), text=True)
                self.texts[start] = ""
                self.said(start)
                stack.append(f)
                statement = None
                continue
            if kind == "triple":
                end = text.find(m[0][-3:], at, limit)
                if end >= 0:
                    self.said(text[at:end])
                    at = end + 3
            elif kind == "string":
                inside = m[0][re.search("[\"']", m[0]).end() : -1]
                self.said(inside)
                if statement is not None and inside and (prior == "from" or prior == "import" == statement[1]):
                    self.imports.append((*statement, inside))
                statement = None
            elif kind == "open":
                word = ".".join(name[0]) if m[0] == "(" and name is not None else None
                call = word is not None and word not in _NO_CALL and before not in _DEFINES
                stack.append(_Call(_SHUTS[m[0]], word if call else None, name[1] if call else start, at, len(stack)))
                statement = statement if m[0] == "{" else None
            elif kind == "shut":
                self.shut(m[0], start, at)
            elif kind == "comma":
                if f is not None and f.name is not None:
                    self.argument(f, start)
                    f.at = at
                elif f is not None and f.shut == "}":
                    self.pair(f, start)
                    f.at = at
            elif kind == "any" and m[0] == ":" and f is not None and f.shut == "}" and f.key is None:
                f.key, f.at, f.kids = self.cut(f, start).strip(), at, []
            elif kind == "any" and m[0] == "=" and f is not None and f.name is not None and f.key is None and name is not None and len(name[0]) == 1 and name[1] == f.token and not text.startswith(("=", ">"), at):
                f.key = (name[0][0], at)
            elif kind == "any" and m[0] in ";=":
                statement = None
            dotted = name if kind == "any" and m[0] == "." else None
            fresh = kind == "any" and m[0] in ";:"
            operand = kind in ("string", "triple", "number") or (kind == "shut" and m[0] != "}")
            name, before, prior = None, "", m[0] if kind in ("any", "shut", "open", "comma") else ""

    def run(self) -> None:
        n = len(self.text)
        self.scan(0, n)
        left, end = self.stack, n
        again = []
        for f in reversed(left):
            if f.text:
                again.append((f.at, end, {a: b for a, b, _ in f.kids}))
            end = f.start
        for at, end, kids in again:  # strings that nothing closes
            self.stack = []
            self.scan(at, end, kids)


def code_nodes(text: str, grammar: str) -> tuple[list[tuple], list[tuple]]:
    """Calls by their place: (line, last line, name, arguments, first string within, start, end, level), an argument being (text, form, keys, values): of an object `{` with its fields, of a keyword `=` with its name and value,
    else None. Imports: (line, its word, module)."""
    c = _Code(text, grammar)
    c.run()
    line = _liner(text)
    calls = [(line(a), line(max(b - 1, a)), words[0], words[1:], first, a, b, level) for a, b, level, words, first in sorted(c.calls, key=lambda x: (x[0], -x[1]))]
    return calls, [(line(a), word, name) for a, word, name in sorted(c.imports)]


def code(text: str, grammar: str) -> tuple[list[tuple], list[tuple]]:
    """(calls by their place: (line, last line, [name, arguments as they stand], first string within), imports: (line, its word, module))."""
    calls, imports = code_nodes(text, grammar)
    return [(a, b, [name, *(x[0] for x in args)], first) for a, b, name, args, first, *_ in calls], imports
