"""A lexer for Java, TypeScript and JavaScript texts, and the declarations and calls its tokens hold.

One pass over the whole text keeps a stack of open brackets: strings, comments, text blocks, regular expressions and
templates (with code nested in them to any depth) never count as code. What stands before a block or a semicolon is its
head; the head and the kind of block around it say what is declared.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field

from codequarry.schema import PARTS

NOT_CALLED = frozenset(
    "if for while switch catch return function throw new else do try synchronized typeof await case assert import with instanceof in of super yield void delete async".split()
)
STATEMENTS = frozenset("return throw new else case package import await yield if for while switch catch do try default goto assert".split())
BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => return typeof case in of delete void throw new else do".split())
SPREADING = frozenset("< = throws extends implements permits".split())
TYPES = frozenset("class interface enum record".split())
#: A token and the white space behind it.
TOKEN = re.compile(
    r"""(?:(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"{3}.*?(?:(?<!\\)\"{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<word>@?[^\W\d][\w$]*|[@$\#][\w$]+|\$)|(?P<number>\d[\w.]*)|(?P<sign>=>|\?\.|\.\.\.|.))\s*""",
    re.S | re.X,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
TEMPLATE = re.compile(r"(?:\\.|[^\\`$]|\$(?!\{))*", re.S)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    end: int


def tokens_of(text: str, java: bool) -> tuple[list[Token], list[Token]]:
    """(code tokens, comments). A template is a string token up to each ``${`` and after each ``}`` of it."""
    code: list[Token] = []
    comments: list[Token] = []
    depths: list[int] = []  # braces open inside each nested template
    at, n = 0, len(text)

    def template(start: int) -> int:
        found = TEMPLATE.match(text, start)
        end = found.end() if found else start
        if text.startswith("${", end):
            depths.append(0)
            code.append(Token("string", "`", start, end + 2))
            return end + 2
        code.append(Token("string", "`", start, min(end + 1, n)))
        return end + 1

    while at < n:
        if not java and (c := text[at]) in "`}/\"":
            if c == "`":
                at = template(at + 1)
                continue
            if c == "}" and depths and depths[-1] == 0:
                depths.pop()
                at = template(at + 1)
                continue
            if c == "/" and (not code or code[-1].text in BEFORE_REGEX) and (found := REGEX.match(text, at)):
                code.append(Token("string", "/", at, found.end()))
                at = found.end()
                continue
            if c == '"' and text.startswith('"""', at):
                code.append(Token("string", '"', at, at + 2))  # an empty string; the third quote opens another
                at += 2
                continue
        found = TOKEN.match(text, at)
        kind, at = found.lastgroup, found.end()
        if kind == "comment":
            comments.append(Token(kind, found[kind], *found.span(kind)))
        elif kind != "space":
            code.append(Token(kind, found[kind], *found.span(kind)))
            if depths and kind == "sign":
                depths[-1] += {"{": 1, "}": -1}.get(found[kind], 0)
    return code, comments


@dataclass
class Block:
    """An open bracket: ``unit`` is what its block belongs to; ``members`` says that heads inside it declare members."""

    sign: str
    unit: dict | None = None
    members: bool = False
    head: list[int] = field(default_factory=list)
    holder: dict | None = None
    ends: bool = False  # the statement ends with the block


class Reader:
    """Declarations (``units``) and calls of one text."""

    def __init__(self, text: str, java: bool):
        self.text, self.java = text, java
        self.tokens, self.comments = tokens_of(text, java)
        self.units: list[dict] = []
        self.names: set[int] = set()  # tokens that declare and therefore do not call
        self.calls: list[tuple[int, str, str]] = []

    def read(self, calls: bool = True) -> Reader:
        """The same reader with its units and, if asked for, calls found."""
        self._read()
        if calls:
            self._find_calls()
        return self

    # ---- statements -----------------------------------------------------------------

    def _read(self) -> None:
        stack = [Block("")]
        waiting: list[dict] = []  # declarations that end with their statement, and how deep they began
        for i, token in enumerate(self.tokens):
            top, sign = stack[-1], token.text if token.kind == "sign" else ""
            if waiting and not self.java and top is waiting[-1]["block"] and self._new_statement(i):
                self._end(waiting.pop()["unit"], self.tokens[i - 1])
                top.head.clear()
            if sign == "{":
                unit, members, ends = self._opened(top, i)
                if unit is not None and unit.get("arrow"):
                    waiting.append({"unit": unit, "block": top})
                holder = unit if unit is not None and unit["kind"] in ("class", "interface") else top.holder
                stack.append(Block("{", unit, members, holder=holder, ends=ends))
            elif sign in ("(", "["):
                top.head.append(i)
                stack.append(Block(sign, holder=top.holder, unit=top.unit))
            elif sign in (")", "]"):
                if len(stack) > 1 and stack[-1].sign == ("(" if sign == ")" else "["):
                    stack.pop()
                stack[-1].head.append(i)
            elif sign == "}":
                while len(stack) > 1 and stack[-1].sign != "{":
                    stack.pop()
                block = stack.pop() if len(stack) > 1 else None
                if not stack or block is None:
                    stack = stack or [Block("")]
                    stack[-1].head.clear()
                    continue
                top = stack[-1]
                if block.unit is not None and not block.unit.get("arrow") and block.ends:
                    self._end(block.unit, token)
                top.head.clear() if block.ends and not (block.unit or {}).get("arrow") else top.head.append(i)
            elif sign == ";":
                if waiting and waiting[-1]["block"] is top:
                    self._end(waiting.pop()["unit"], token)
                elif top.sign in ("", "{"):
                    self._closed(top, i)
                top.head.clear()
            elif sign == "," and self.java and top.members and not SPREADING & {self.tokens[j].text for j in top.head}:
                top.head.clear()  # the next constant of an enum, or the next field
            else:
                top.head.append(i)
                if sign == "=>" and not self.java and top.sign in ("", "{") and not (waiting and waiting[-1]["block"] is top):
                    unit = self._arrow(top, i)
                    if unit is not None and not self._next_is(i, "{"):
                        unit["body_at"] = token.end
                        waiting.append({"unit": unit, "block": top})
                elif sign == "=" and not self.java and top.sign in ("", "{") and self._alias(top, i):
                    waiting.append({"unit": self.units[-1], "block": top})
        for one in waiting:
            self._end(one["unit"], self.tokens[-1])
        for block in stack:
            if block.unit is not None and "end" not in block.unit:
                self._end(block.unit, self.tokens[-1])
        for unit in self.units:
            if "end" not in unit:
                self._end(unit, self.tokens[-1])

    def _next_is(self, i: int, text: str) -> bool:
        return i + 1 < len(self.tokens) and self.tokens[i + 1].text == text

    def _new_statement(self, i: int) -> bool:
        """Without a semicolon a statement ends where a line ends and neither side asks for more."""
        before, now = self.tokens[i - 1], self.tokens[i]
        if "\n" not in self.text[before.end : now.at]:
            return False
        asks = before.kind == "sign" and before.text not in (")", "]", "}")
        return not asks and not (now.kind == "sign" and now.text not in ("{", "@", "}")) and before.text not in ("=>", "extends", "new", "return", "await")

    def _end(self, unit: dict, token: Token) -> None:
        unit["end"] = token.end

    # ---- heads ------------------------------------------------------------------------

    def _head(self, block: Block) -> tuple[int, list[int]]:
        """(place of the first token after annotations, the tokens from there on) of the statement so far."""
        head, k = block.head, 0
        while k < len(head) and self.tokens[head[k]].kind == "word" and self.tokens[head[k]].text[0] == "@" and self.tokens[head[k]].text != "@interface":
            k += 1
            while k + 1 < len(head) and self.tokens[head[k]].text == ".":
                k += 2
            if k + 1 < len(head) and self.tokens[head[k]].text == "(":
                k = next((j for j in range(k, len(head)) if self.tokens[head[j]].text == ")"), len(head) - 1) + 1
        return k, head[k:]

    def _unit(self, block: Block, kind: str, name: int, opened: Token | None = None, **more) -> dict:
        k, rest = self._head(block)
        start = self.tokens[rest[0]].at
        annotations = self.text[self.tokens[block.head[0]].at : start] if k else ""
        first = self.tokens[block.head[0]].at
        before = self.tokens[block.head[0] - 1].end if block.head[0] else 0
        docs = [c.text for c in self.comments if before <= c.at < start and c.text.startswith("/**")] if self.comments else []
        holder = block.holder
        unit = {
            "kind": kind, "name": self.tokens[name].text, "start": start, "first": first, "annotations": annotations.strip(), "doc": docs[-1] if docs else "",
            "parent": holder, "open": opened.at if opened else None, "body_at": opened.end if opened else None, **more,
        }
        self.units.append(unit)
        self.names.add(name)
        return unit

    def _words(self, rest: list[int]) -> list[tuple[str, int]]:
        return [(self.tokens[i].text, i) for i in rest]

    def _opened(self, block: Block, i: int) -> tuple[dict | None, bool, bool]:
        """(unit, whether its block has members, whether the statement ends with it) of a block that opens at token i."""
        brace, (_, rest) = self.tokens[i], self._head(block)
        words = self._words(rest)
        texts = [w for w, _ in words]
        if block.sign not in ("", "{"):
            return None, self._anonymous(texts), False
        for k, (word, _) in enumerate(words[:-1]):
            if word in TYPES and self.tokens[words[k + 1][1]].kind == "word" and "(" not in texts[:k] and "=" not in texts[:k] and (self.java or word in ("class", "interface", "enum")):
                if word == "record" and not (k + 2 < len(words) and texts[k + 2] in ("(", "<")):
                    continue
                name = words[k + 1][1]
                if word in ("class", "interface"):
                    return self._unit(block, word, name, brace), True, True
                self.names.add(name)
                return None, self.java, True
        if "@interface" in texts:
            return None, True, True
        if not self.java:
            if "function" in texts and "=" not in texts and "(" not in texts[: texts.index("function")]:
                k = texts.index("function") + 1
                k += k < len(texts) and texts[k] == "*"
                if k < len(words) and self.tokens[words[k][1]].kind == "word":
                    return self._unit(block, "function", words[k][1], brace), False, True
            if texts and texts[-1] == "=>":
                if self.units and self.units[-1].get("arrow") == i - 1:
                    unit = self.units[-1]
                    unit["open"], unit["body_at"] = brace.at, brace.end
                    return unit, False, False
                return None, False, False
        if not self.java and not block.members and len(texts) > 2 and texts[1] == "(" and texts[-1] == ")" and texts[0] not in STATEMENTS:
            self.names.add(words[0][1])  # a method of an object
        if block.members and texts and self._may_declare(texts):
            if (member := self._member(block, words)) is not None:
                kind, name = member
                return self._unit(block, kind, name, brace), False, True
        # the body of an enum constant has members too
        constant = block.members and self.java and "(" in texts and "=" not in texts and texts[0] not in STATEMENTS
        anonymous = self._anonymous(texts)
        continues = "=" in texts or texts[:1] in (["return"], ["export"], ["yield"]) or anonymous
        return None, anonymous or constant, not continues

    def _may_declare(self, texts: list[str]) -> bool:
        return texts[0] not in STATEMENTS or self.java and texts[0] == "default" and texts[1:2] != [":"]

    def _anonymous(self, texts: list[str]) -> bool:
        """Whether a block after these tokens is the body of ``new Name(...)``."""
        if not self.java or not texts or texts[-1] != ")" or "new" not in texts:
            return False
        at = len(texts) - 1 - texts[::-1].index("new")
        return "(" in texts[at:] and not any(t in texts[at:] for t in ("=", "->"))

    def _member(self, block: Block, words: list[tuple[str, int]]) -> tuple[str, int] | None:
        """(kind, name token) of a method or constructor head."""
        texts = [w for w, _ in words]
        if "(" not in texts or "=" in texts[: texts.index("(")] or "=>" in texts:
            return None
        k = texts.index("(") - 1
        if k >= 0 and texts[k] == ">":  # type parameters after the name
            depth = 0
            while k >= 0:
                depth += {">": 1, "<": -1}.get(texts[k], 0)
                k -= 1
                if not depth:
                    break
        if k < 0 or self.tokens[words[k][1]].kind != "word" or texts[k] in NOT_CALLED:
            return None
        name = words[k][1]
        if not self.java:
            return ("method", name) if not any(t in (".", "new") for t in texts[:k]) else None
        typed = [t for t in texts[:k] if t not in JAVA_MODIFIERS]
        if typed and typed[0] == "<":  # the method's own type parameters
            depth, j = 0, 0
            for j, t in enumerate(typed):
                depth += {"<": 1, ">": -1}.get(t, 0)
                if not depth:
                    break
            typed = typed[j + 1 :]
        if typed:
            return ("method", name) if self.tokens[words[k - 1][1]].text not in (".", "new") else None
        return ("constructor", name) if block.holder and texts[k] == block.holder["name"] else None

    def _closed(self, block: Block, i: int) -> None:
        """A statement without a block: methods without a body, aliases, default exports."""
        words = self._words(self._head(block)[1])
        texts = [w for w, _ in words]
        if not texts:
            return
        if block.members and self._may_declare(texts) and (member := self._member(block, words)) is not None:
            self._end(self._unit(block, *member), self.tokens[i])
        elif not self.java and texts[:2] == ["export", "default"] and len(texts) == 3 and self.tokens[words[2][1]].kind == "word":
            self._end(self._unit(block, "import", words[2][1]), self.tokens[i])

    def _alias(self, block: Block, i: int) -> bool:
        words = [w for w in self._words(self._head(block)[1]) if w[0] not in ("export", "declare", "default")]
        if len(words) >= 3 and words[0][0] == "type" and self.tokens[words[1][1]].kind == "word" and (words[2][0] in ("=", "<")):
            self._unit(block, "alias", words[1][1])
            return True
        return False

    def _arrow(self, block: Block, i: int) -> dict | None:
        """``const name = (...) =>`` declares a function."""
        words = [w for w in self._words(self._head(block)[1]) if w[0] not in ("export", "default", "declare")]
        texts = [w for w, _ in words]
        if len(words) < 4 or texts[0] not in ("const", "let", "var") or "=" not in texts or "function" in texts:
            return None
        after = texts[texts.index("=") + 1 :]
        after = after[1:] if after[:1] == ["async"] else after
        if after[:1] not in (["("], ["<"]) and not (len(after) == 2 and after[1] == "=>"):
            return None
        return self._unit(block, "function", words[1][1], arrow=i)

    # ---- calls ------------------------------------------------------------------------

    def _find_calls(self) -> None:
        tokens = self.tokens
        for i, token in enumerate(tokens):
            if token.text != "(" or not i:
                continue
            k = i - 1
            if tokens[k].text == ">" and (k := self._before_types(k)) < 0:
                continue
            if tokens[k].kind != "word" or k in self.names or tokens[k].text in NOT_CALLED or tokens[k].text[0] == "@":
                continue
            chain = [tokens[k].text]
            while k >= 2 and tokens[k - 1].text in (".", "?.") and tokens[k - 2].kind == "word":
                k -= 2
                chain.insert(0, tokens[k].text)
            if chain[0][0] == "@":
                continue
            target = ".".join(chain)
            if k and tokens[k - 1].text == "new":
                self.calls.append((tokens[k - 1].at, target + (".<init>" if self.java else ".constructor"), "constructor"))
            else:
                self.calls.append((tokens[k].at, target, "method" if len(chain) > 1 else "direct"))

    def _before_types(self, k: int) -> int:
        """The token before ``<...>`` that ends at k; -1 if that is no list of types."""
        depth = 0
        while k >= 0:
            text = self.tokens[k].text
            depth += {">": 1, "<": -1}.get(text, 0)
            k -= 1
            if not depth:
                return k if k >= 0 and self.tokens[k].kind == "word" else -1
            if self.tokens[k + 1].kind not in ("word", "sign") or text not in "<>,.?[]&|" and self.tokens[k + 1].kind == "sign":
                return -1
        return -1


JAVA_MODIFIERS = frozenset("public private protected static final abstract synchronized native default sealed strictfp transient volatile".split())


COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
BREAK = re.compile("\n")


def file_units(text: str, language: str, wanted: Sequence[str] = PARTS) -> tuple[list[dict], list[dict]]:
    """(declarations, calls) of a text; lines count from 0 in declarations and from 1 in calls. Without chunks in ``wanted``,
    declarations hold what bases or dependencies need."""
    reader = Reader(text, language == "java").read("calls" in wanted)
    breaks = [found.start() for found in BREAK.finditer(text)]
    line = lambda at: bisect_left(breaks, at)
    begins = [0, *(b + 1 for b in breaks)]
    units, sites = [], []
    for u in reader.units:
        first = line(u["start"])
        head = u["open"] if u["open"] is not None else u["end"]
        header = COMMENT.sub(" ", text[u["start"] : head]) if "bases" in wanted and u["kind"] in ("class", "interface") else None
        if "chunks" not in wanted and not ("calls" in wanted and u["body_at"] is not None):
            own = text[u["start"] : u["end"]] if "dependencies" in wanted and u["kind"] == "class" else None
            units.append({"i": first, "kind": u["kind"], "name": u["name"], "header": header, "annotations": u["annotations"], "own": own})
            continue
        last = line(max(u["end"] - 1, u["start"]))
        doc = "\n".join(x for x in (row.strip().lstrip("*").strip() for row in u["doc"][3:].removesuffix("*/").split("\n")) if x)
        parent = u["parent"]
        units.append({
            "i": first, "end": last, "kind": u["kind"], "name": u["name"], "parent_name": parent and parent["name"], "parent_type": parent and parent["kind"],
            "parent_line": line(parent["start"]) if parent else None, "header": header,
            "signature": text[max(u["first"], begins[first]) : head].strip().removesuffix(";").strip(), "annotations": u["annotations"], "docstring": doc or None,
            "body": text[begins[first] : breaks[last] if last < len(breaks) else len(text)], "own": text[u["start"] : u["end"]],
        })
        if u["kind"] in ("function", "method", "constructor") and u["body_at"] is not None:
            caller = f"{parent['name']}.{u['name']}" if parent and u["kind"] != "function" else u["name"]
            sites += [{"caller": caller, "callee": c, "line": line(at) + 1, "call_type": k} for at, c, k in reader.calls if u["body_at"] <= at < u["end"]]
    return units, sites
