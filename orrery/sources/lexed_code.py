"""Symbols, comments and fingerprints of the languages other than Python, from tokens and matched brackets instead of a grammar.

What follows from that: a struct, class or enum counts where it is defined, not where it is only named; shapes keep identifiers,
literals, keywords and brackets, so equal code is found equal, but the counts are not those of a syntax tree. Text that is
broken gives what can still be read. Cognitive complexity is null for the languages that have no rules for it (Bash, Lua, PHP).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

from .lexer import CONTROL, DOC_PREFIXES, INNER_PREFIXES, LANGUAGES, RESERVED, tokens

_SCRIPT = ("javascript", "typescript", "tsx")
_TYPES = ("class", "struct", "interface", "trait", "protocol", "enum")
#: Keywords that open a definition, and its kind.
_KEYWORDS = {
    "javascript": {"function": "function", "class": "class"},
    "typescript": {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum"},
    "go": {"func": "function", "type": "type", "var": "variable", "const": "variable"},
    "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "variable", "static": "variable", "impl": None},
    "csharp": {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "record": "class", "delegate": "type"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "class"},
    "c": {"struct": "struct", "enum": "enum", "union": "struct"},
    "cpp": {"class": "class", "struct": "struct", "enum": "enum"},
    "kotlin": {"class": "class", "interface": "class", "object": "class", "fun": "function"},
    "swift": {"class": "class", "struct": "class", "enum": "class", "actor": "class", "extension": "class", "protocol": "protocol", "func": "function", "init": "constructor", "var": "property", "let": "property"},
    "php": {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum", "function": "function"},
    "bash": {"function": "function"},
}
_KEYWORDS["tsx"] = _KEYWORDS["typescript"]
#: Words between a keyword and the name it defines.
_BETWEEN = {"rust": ("mut",), "cpp": ("class", "struct"), "csharp": ("class", "struct"), **dict.fromkeys(_SCRIPT, ("*",)), "php": ("&",)}
#: What stands before a statement without being part of the definition.
_BEFORE = ("export", "default", "declare")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_MEMBER = (".", "?.", "->", "::")
_UNSCORED = ("bash", "lua", "php")


class Definition(dict):
    """A symbol's columns, with the range of its tokens and of its body."""

    span = body = (0, 0)


class Source:
    def __init__(self, text: str, name: str):
        self.language, self.name = LANGUAGES[name], name
        self.toks, self.comments = tokens(text, name)
        self.found: list[Definition] = []
        self.match: dict[int, int] = {}
        self.opener: dict[int, int] = {}
        open_at: list[int] = []
        for i, t in enumerate(self.toks):
            if t.kind != "operator":
                continue
            if t.text in _CLOSE:
                open_at.append(i)
            elif t.text in _CLOSE.values():
                while open_at and _CLOSE[self.toks[open_at[-1]].text] != t.text:
                    open_at.pop()
                if open_at:
                    self.match[open_at[-1]], self.opener[i] = i, open_at[-1]
                    open_at.pop()

    def text(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) and self.toks[i].kind != "literal" else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "word"

    def skip(self, i: int, hi: int) -> int:
        while i < hi and self.toks[i].kind == "newline":
            i += 1
        return i

    def before(self, i: int) -> str:
        """The token before, line ends passed over."""
        i -= 1
        while i >= 0 and self.toks[i].kind == "newline":
            i -= 1
        return self.text(i)

    def add(self, kind: str, name: str, start: int, end: int, scope: str, body: tuple[int, int] | None = None) -> Definition:
        end = min(end, len(self.toks) - 1)
        while end > start and self.toks[end].kind == "newline":
            end -= 1
        d = Definition(kind=kind, name=name.lstrip("#`").rstrip("`"), line=self.toks[start].line, end_line=self.toks[end].end, scope=scope)
        d.span, d.body = (start, end + 1), body or (end, end)
        self.found.append(d)
        return d

    # definitions, by brackets

    def finish(self, i: int, hi: int, *, type_only: bool = False) -> tuple[int, int | None]:
        """(last token, opening brace of the body or none) of a definition whose name or parameters end before ``i``."""
        value = False
        while i < hi:
            t = self.text(i)
            if t == "{" and i in self.match:
                in_type = self.name in _SCRIPT and self.before(i) in (":", "|", "<", ",") or self.name == "go" and self.before(i) in ("interface", "struct")
                if not value and not in_type and not type_only and not (self.name == "cpp" and self.text(self.match[i] + 1) in (",", "{")):
                    return self.match[i], i
                i = self.match[i]
            elif t in ("(", "[") and i in self.match:
                i = self.match[i]
            elif t == ";":
                return i, None
            elif t in ("}", ")", "]"):
                return i - 1, None
            elif t in ("=", "=>"):
                value = True
            elif self.toks[i].kind == "newline":
                after = self.text(self.skip(i, hi))
                goes_on = self.before(i) in ("=", ",", "->", ":", "=>", "|", "&", "+", "(") or after in ("=", ":", "where", "->", ".", "?.", "|", "&", "extends", "implements")
                if not goes_on and not (after == "{" and not value):
                    return i - 1, None
            i += 1
        return hi - 1, None

    def inside(self, d: Definition, brace: int | None, scope: str, kind: str) -> None:
        if brace is None:
            return
        d.body = (brace + 1, self.match[brace])
        place = kind if kind in _TYPES else "code"
        self.walk(brace + 1, self.match[brace], f"{scope}.{d['name']}" if scope else d["name"], place, d["name"])

    def walk(self, lo: int, hi: int, scope: str = "", place: str = "file", owner: str = "") -> None:
        i = start = lo
        while i < hi:
            t = self.toks[i]
            if t.kind == "newline" or t.text in (";", "}", *_BEFORE) or (place == "enum" and t.text == ","):
                i = start = i + 1
                continue
            after = self.definition(i, start, hi, scope, place, owner)
            if after is not None:
                i = start = after
            elif t.text == "=" and place in _TYPES and t.kind == "operator" and not self.language.lines:
                # the value of a field
                end = self.finish(i, hi)[0] + 1
                self.walk(i + 1, min(end, hi), scope, "code")
                i = start = max(end, i + 1)
            elif i in self.match and t.kind == "operator":
                words = {self.text(k) for k in range(max(start, i - 12), i)}
                attribute = t.text == "[" and self.text(i - 1) == "#"
                named = t.text == "{" and place == "file" and words & {"namespace", "extern", "mod", "module"}
                self.walk(i + 1, self.match[i], scope, "file" if named else "class" if self.anonymous(i) else "code")
                i = self.match[i] + 1
                if t.text == "{" or attribute:
                    start = i
            elif place == "file" and t.text == "template" and self.text(i + 1) == "<":
                i = start = self.angle(i + 1, hi) + 1
            else:
                i += 1

    def anonymous(self, i: int) -> bool:
        """Whether the brace at ``i`` opens the body of an unnamed Java class."""
        return self.name == "java" and i - 1 in self.opener and self.text(self.opener[i - 1] - 2) == "new"

    def angle(self, i: int, hi: int) -> int:
        """The end of a list in angle brackets that starts at ``i``; ``i`` if it is none."""
        depth, k = 0, i
        while k < min(hi, i + 200):
            t = self.text(k)
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return k
            if t in (";", "{", "}"):
                break
            k += 1
        return i

    def definition(self, i: int, start: int, hi: int, scope: str, place: str, owner: str) -> int | None:
        """Takes a definition in whose keyword or name is at ``i``; where to go on, or none if there is none."""
        if not self.is_word(i) or self.text(i - 1) in (*_MEMBER[:2], "::") and self.text(i) in _KEYWORDS.get(self.name, ()):
            return None
        word = self.text(i)
        if word in _KEYWORDS.get(self.name, ()):
            return self.by_keyword(i, start, hi, scope, place)
        if self.name == "bash":
            if self.text(i + 1) == "(" and self.text(i + 2) == ")" and self.text(k := self.skip(i + 3, hi)) == "{" and k in self.match:
                self.inside(self.add("function", word, i, self.match[k], scope), k, scope, "function")
                return self.match[k] + 1
            return None
        return self.by_shape(i, start, hi, scope, place, owner)

    def by_keyword(self, i: int, start: int, hi: int, scope: str, place: str) -> int | None:
        name, word = self.name, self.text(i)
        kind = _KEYWORDS[name][word]
        prev = self.text(i - 1)
        # a bound of a type parameter, or an import
        if prev == "use" or (prev in ("<", ",", ":") and name not in ("swift", "kotlin") and (place != "file" or name == "csharp")):
            return None
        if name in _SCRIPT and word in ("function", "class") and (i - start > 1 or (start < i and self.text(start) not in ("async", "abstract"))):
            return None
        k = i + 1
        while self.text(k) in _BETWEEN.get(name, ()):
            k += 1
        if name == "go":
            return self.go(i, k, hi, scope)
        if word == "impl":
            return self.impl(i, hi, scope)
        if kind == "variable":
            if scope or not self.is_word(k) or self.text(k + 1) != ":":
                return None
            end = self.finish(k + 1, hi, type_only=True)[0]
            self.add(kind, self.text(k), start, end, scope)
            return end + 1
        if word == "delegate":
            end = self.finish(i, hi)[0]
            named = next((j for j in range(i, end) if self.is_word(j) and self.text(j + 1) == "("), None)
            if named is None:
                return None
            self.add(kind, self.text(named), start, end, scope)
            return end + 1
        if word == "init" and name == "swift":
            if place not in _TYPES or self.text(i + 1) not in ("(", "<", "?", "!"):
                return None
            k = i
        if name == "kotlin" and word == "fun":
            if self.text(k) == "<":
                k = self.angle(k, hi) + 1
            named = next((j for j in range(k, min(hi, k + 40)) if self.text(j) == "("), None)
            if named is None or not self.is_word(named - 1) or named == k:
                return None
            k = named - 1
        if name == "swift" and kind == "property" and self.before(i) in ("if", "guard", "while", "case", "for", ",", "("):
            return None
        if name in ("c", "cpp") and self.text(k) == "{" and k in self.match:
            d = self.add(kind, "<anon>", i, self.match[k], scope)
            self.inside(d, k, scope, kind)
            return self.match[k] + 1
        if not self.is_word(k) or self.text(k) in ("func", "fun", "var", "let", "class", "interface") or (kind != "constructor" and self.text(k) in RESERVED and word != "func"):
            return None
        if kind == "type" and self.text(k + 1) not in ("=", "<"):
            return None
        if name == "php" and word in ("enum", "trait", "class") and self.text(k + 1) in ("(", "="):
            return None
        if kind in ("function", "property", "constructor") and place == "protocol" and name == "swift":
            if kind == "property":
                return None
            kind = "method"
        if name == "php" and kind == "function" and place in _TYPES:
            kind = "method"
        end, brace = self.finish(k + 1, hi, type_only=kind in ("type",))
        if kind == "property" and brace is None and self.text(k + 1) == "=":
            self.walk(k + 2, end + 1, scope, "code")
        if brace is None and (name in ("c", "cpp") or (name in _SCRIPT and kind == "function") or word in ("interface", "enum", "trait", "protocol") and name != "kotlin"):
            return None
        if name in ("c", "cpp") and self.text(end + 1) != ";" and "(" in {self.text(j) for j in range(k, brace or k)}:
            # the type of what a function returns
            return None
        if name == "java" and self.text(i - 1) == "@":
            kind = "interface"
        d = self.add(kind, self.text(k), i if name in ("c", "cpp") else start, end, scope)
        self.inside(d, brace, scope, "protocol" if word == "protocol" else "class" if kind == "class" and word != "enum" else kind if kind in _TYPES else "code")
        return end + 1

    def go(self, i: int, k: int, hi: int, scope: str) -> int | None:
        word, kind = self.text(i), _KEYWORDS["go"][self.text(i)]
        if word == "func":
            if self.text(k) == "(" and k in self.match:
                k, kind = self.match[k] + 1, "method"
            if not self.is_word(k) or self.text(k + 1) not in ("(", "["):
                return None
            end, brace = self.finish(k + 1, hi)
            self.inside(self.add(kind, self.text(k), i, end, scope), brace, scope, "function")
            return end + 1
        grouped = self.text(k) == "(" and k in self.match
        last, at = (self.match[k], k + 1) if grouped else (hi, k)
        while (at := self.skip(at, last)) < last:
            end = self.finish(at + 1, last, type_only=True)[0]
            if self.is_word(at) and not (kind == "variable" and scope) and not (kind == "type" and self.text(at + 1) == "="):
                self.add(kind, self.text(at), at if grouped or kind == "type" else i, end, scope)
            at = end + 1
            if not grouped:
                return at
        return last + 1

    def impl(self, i: int, hi: int, scope: str) -> int | None:
        k = i + 1
        if self.text(k) == "<":
            k = self.angle(k, hi) + 1
        end, brace = self.finish(k, hi)
        if brace is None:
            return None
        head = [self.text(j) for j in range(k, brace)]
        head = head[: head.index("where")] if "where" in head else head
        target = "".join(head[head.index("for") + 1 :] if "for" in head else head)
        self.walk(brace + 1, self.match[brace], f"{scope}.{target}" if scope else target, "class", target)
        return end + 1

    def by_shape(self, i: int, start: int, hi: int, scope: str, place: str, owner: str) -> int | None:
        """Methods and functions that no keyword opens, properties, and variables of the outermost scope."""
        name, word = self.name, self.text(i)
        if name in _SCRIPT and word in ("const", "let", "var"):
            if not scope and self.is_word(i + 1) and self.text(i - 1) != "(" and self.text(i + 1) != "enum":
                end = self.finish(i + 2, hi, type_only=True)[0]
                self.add("variable", self.text(i + 1), i + 1, end, scope)
                self.walk(i + 2, end + 1, scope, "code")
                return end + 1
            return None
        if name not in (*_SCRIPT, "java", "csharp", "c", "cpp") or word in RESERVED - {"delete", "match", "when", "select", "repeat", "loop", "ensure", "begin", "end", "in", "fn", "fun", "func", "def", "as"}:
            return None
        prev = self.text(i - 1)
        k = i + 1
        if self.text(k) == "<" and name in ("typescript", "tsx", "java", "csharp"):
            k = self.angle(k, hi) + 1
        if name == "csharp" and place in _TYPES and k == i + 1 and start < i and self.is_word(i - 1) | (prev in (">", "]", "?")):
            body = self.skip(k, hi)
            accessors = self.text(body) == "{" and {self.text(j) for j in range(body, self.match.get(body, body))} & {"get", "set", "init"}
            if accessors or self.text(body) == "=>":
                end = self.match[body] if accessors else self.finish(body, hi)[0]
                if accessors and self.text(end + 1) == "=":
                    end = self.finish(end + 1, hi)[0]
                self.add("property", word, start, end, scope)
                return end + 1
        if self.text(k) != "(" or k not in self.match:
            return None
        after = self.match[k] + 1
        if name in _SCRIPT:
            if prev in ("new", "=", "return", *_MEMBER, "@", "function") or place not in ("class", "code", "file"):
                return None
            if place != "class" and (self.text(after) not in ("{", ":") or self.before(i) == ")"):
                return None
            if place != "class" and self.text(after) == ":" and self.before(i) not in ("{", ",", "async", "get", "set"):
                return None
            if self.text(after) not in ("{", ":", ";") and self.toks[min(after, hi - 1)].kind != "newline":
                return None
            end, brace = self.finish(after, hi)
            abstract = "abstract" in {self.text(j) for j in range(max(start, i - 12), i)}
            if brace is None and not (abstract and place == "class"):
                return None
            self.inside(self.add("method", word, start if place == "class" else i, end, scope), brace, scope, "method")
            return end + 1
        if name in ("java", "csharp"):
            if place not in _TYPES or prev in ("new", "@", "=", *_MEMBER):
                return None
            end, brace = self.finish(after, hi)
            if word == owner and (start == i or prev in ("public", "private", "protected", "internal", "static")):
                kind = "constructor"
            elif start < i and (self.is_word(i - 1) or prev in (">", "]", "?")):
                kind = "method"
            else:
                return None
            if kind == "constructor" and brace is None and "=>" not in {self.text(j) for j in range(after, end)}:
                return None
            self.inside(self.add(kind, word, start, end, scope), brace, scope, kind)
            return end + 1
        if place not in ("file", *_TYPES) or prev in ("=", ".", ",") or word in ("__attribute__", "__declspec"):
            return None
        end, brace = self.finish(after, hi)
        if brace is None or "=" in {self.text(j) for j in range(after, brace)}:
            return None
        self.inside(self.add("function", word, start, end, scope), brace, scope, "function")
        return end + 1

    # definitions, by end words

    def ended(self) -> None:
        """Definitions of Ruby and Lua, whose blocks close with ``end``."""
        stack: list[Definition | None] = []
        names: list[str] = []
        swallow = False
        for i, t in enumerate(self.toks):
            if t.kind == "newline":
                swallow = False
            if t.kind != "word" or not self.opens_or_ends(i):
                continue
            if t.text in ("end", "until") and (t.text == "end" or self.name == "lua"):
                d = stack.pop() if stack else None
                if d is not None:
                    names.pop()
                    d["end_line"], d.span = t.line, (d.span[0], i + 1)
                continue
            if t.text == "do" and swallow:
                swallow = False
                continue
            swallow = t.text in ("while", "until", "for")
            kind, k = {"module": "module", "class": "class", "def": "method", "function": "function"}.get(t.text), i + 1
            d = None
            if kind and self.is_word(k):
                while self.text(k + 1) in (".", ":", "::") and self.is_word(k + 2) and not (self.name == "lua" and self.toks[k + 1].gap):
                    k += 2
                label = self.text(k) if self.name == "ruby" else "".join(self.text(j) for j in range(i + 1, k + 1))
                start = i - 1 if self.name == "lua" and self.text(i - 1) == "local" else i
                d = self.add(kind, label, start, k, ".".join(names))
                d.body = (k + 1, k + 1)
            if kind == "method" and self.endless(k + 1):
                continue
            stack.append(d)
            if d is not None:
                names.append(d["name"])
        for d in self.found:
            d.body = (d.body[0], max(d.body[0], d.span[1] - 1))

    def endless(self, i: int) -> bool:
        i = self.match[i] + 1 if self.text(i) == "(" and i in self.match else i
        return self.text(i) == "="

    def value_before(self, i: int) -> bool:
        """Whether a value, or a jump, ends right before ``i`` on its line: what follows is a modifier."""
        if i == 0:
            return False
        p = self.toks[i - 1]
        if p.kind == "word":
            return p.text not in RESERVED or p.text in ("end", "return", "next", "break", "yield")
        return p.kind in ("literal", "number") or p.text in (")", "]", "}")

    def opens_or_ends(self, i: int) -> bool:
        word, prev = self.text(i), self.text(i - 1)
        if prev in (".", "?.", ":", "&.") or (self.text(i + 1) == ":" and not self.toks[i + 1].gap):
            return False
        if self.name == "lua":
            return word in ("function", "if", "for", "while", "do", "repeat", "until", "end")
        if word in ("if", "unless", "while", "until", "rescue"):
            return word != "rescue" and not self.value_before(i)
        return word in ("module", "class", "def", "begin", "case", "for", "do", "end")

    def definitions(self) -> list[Definition]:
        if self.name in ("ruby", "lua"):
            self.ended()
        else:
            self.walk(0, len(self.toks))
        self.found.sort(key=lambda d: d.span[0])
        return self.found


class Score:
    """Cognitive complexity of one function."""

    def __init__(self, source: Source, d: Definition):
        self.s, self.name, self.own = source, source.name, d["name"]
        self.total = 0
        lo, hi = d.body
        self.total += self.runs(lo, hi)
        if self.name == "ruby":
            self.ruby(lo, hi)
        else:
            self.block(lo, hi, 0)

    def runs(self, lo: int, hi: int) -> int:
        """Runs of one logical operator; parentheses that only group do not part them, the arguments of a call do."""
        s, count, last, outer = self.s, 0, None, []
        for i in range(lo, hi):
            t, word = s.text(i), s.is_word(i)
            if t in ("&&", "||") or (word and t in ("and", "or") and self.name in ("ruby", "cpp")):
                count += t != last
                last = t
            elif t in ("(", "["):
                call = t == "[" or s.text(i - 1) in (")", "]") or (s.is_word(i - 1) and s.text(i - 1) not in RESERVED)
                outer.append((call, last))
                last = None if call else last
            elif t in (")", "]"):
                call, before = outer.pop() if outer else (False, last)
                last = before if call else last
            elif t in ("{", "}", ";", ",", "?", ":", "=", "=>", "->") or (word and t in RESERVED) or (s.toks[i].kind == "newline" and s.before(i) not in ("&&", "||") and s.text(s.skip(i, hi)) not in ("&&", "||")):
                last = None
        return count

    def recursion(self, i: int) -> None:
        if self.s.text(i) == self.own and self.s.text(i + 1) == "(":
            prev = self.s.text(i - 1)
            self.total += prev not in _MEMBER or self.s.text(i - 2) in ("self", "this", "cls", "Self")

    def is_ternary(self, i: int, hi: int) -> bool:
        s = self.s
        if s.text(i) != "?" or not s.language.ternary or s.text(i - 1) in ("<", ",", "(", "") and s.toks[i - 1].kind == "operator":
            return False
        if self.name in ("swift", "ruby") and not s.toks[i].gap:
            return False
        if s.is_word(i + 1) and s.text(i + 2) in ("=", ";", ",", ")"):
            return False
        k = i + 1
        while k < hi and s.text(k) not in (";", ",", "}", ")"):
            if s.text(k) == ":":
                return True
            k = s.match.get(k, k) + 1
        return False

    def block(self, lo: int, hi: int, nest: int) -> None:
        i = lo
        while i < hi:
            i = self.step(i, hi, nest)

    def group(self, i: int, nest: int) -> int:
        self.block(i + 1, self.s.match[i], nest)
        return self.s.match[i] + 1

    def head(self, i: int, hi: int, nest: int) -> int:
        """Over a condition, to where the body starts."""
        s = self.s
        if s.language.parens:
            while i < hi and s.is_word(i) and s.text(i) in ("await", "constexpr", "each"):
                i += 1
            return s.skip(self.group(i, nest), hi) if s.text(i) == "(" and i in s.match else s.skip(i, hi)
        while i < hi and s.text(i) not in ("{", "}"):
            i = self.step(i, hi, nest)
        return i

    def body(self, i: int, hi: int, nest: int) -> int:
        """Over a block or a single statement."""
        s = self.s
        i = s.skip(i, hi)
        if s.text(i) == "{" and i in s.match:
            return self.group(i, nest)
        if s.is_word(i) and s.text(i) in CONTROL:
            return self.step(i, hi, nest)
        while i < hi and s.text(i) not in ("else", "}") and s.toks[i].kind != "newline":
            if s.text(i) == ";":
                return i + 1
            i = self.step(i, hi, nest)
        return i

    def branch(self, i: int, hi: int, nest: int) -> int:
        s = self.s
        self.total += 1 + nest
        i = self.body(self.head(i + 1, hi, nest), hi, nest + 1)
        while True:
            k = s.skip(i, hi)
            if k >= hi or s.text(k) != "else" or s.text(k + 1) == "->":
                return i
            self.total += 1
            if s.text(k + 1) != "if":
                return self.body(k + 1, hi, nest + 1)
            i = self.body(self.head(k + 2, hi, nest), hi, nest + 1)

    def step(self, i: int, hi: int, nest: int) -> int:
        s, name = self.s, self.name
        t = s.text(i)
        if s.is_word(i) and s.text(i - 1) not in _MEMBER:
            if t == "if":
                return self.branch(i, hi, nest)
            if t in ("for", "foreach", "while") or (t == "loop" and name == "rust"):
                self.total += 1 + nest
                return self.body(self.head(i + 1, hi, nest), hi, nest + 1)
            if (t == "do" and name != "swift") or (t == "repeat" and name == "swift"):
                self.total += 1 + nest
                k = s.skip(self.body(i + 1, hi, nest + 1), hi)
                return k + 1 if s.text(k) == "while" else k
            if t == "guard" and name == "swift":
                self.total += 1 + nest
                while i < hi and s.text(i) != "else":
                    i = s.match.get(i, i) + 1
                return self.body(i + 1, hi, nest + 1)
            if t in ("switch", "catch") or t == {"rust": "match", "kotlin": "when", "go": "select"}.get(name):
                self.total += 1 + nest
                return self.body(self.head(i + 1, hi, nest), hi, nest + 1)
            if t in ("break", "continue", "goto"):
                label = s.is_word(i + 1) or (s.text(i + 1) in ("'", "@") and s.is_word(i + 2))
                if name == "rust":
                    label = s.text(i + 1) == "'"
                self.total += label and name != "csharp"
                return i + 1 + label
            if t in {"kotlin": ("fun",), "go": ("func",), "swift": ("func",), "rust": ("fn",), **dict.fromkeys(_SCRIPT, ("function",))}.get(name, ()):
                end, brace = s.finish(i + 1, hi)
                if brace is not None:
                    self.group(brace, nest + 1)
                return max(end + 1, i + 1)
        if s.is_word(i):
            self.recursion(i)
            return i + 1
        if t == "?" and self.is_ternary(i, hi):
            self.total += 1 + nest
            i += 1
            while i < hi and s.text(i) not in (";", ",", "}") and s.toks[i].kind != "newline":
                i = self.step(i, hi, nest + 1)
            return i
        if t in _CLOSE and i in s.match:
            return self.group(i, nest + (t == "{" and self.closure(i)))
        return i + 1

    def closure(self, i: int) -> bool:
        s, prev = self.s, self.s.text(i - 1)
        if prev == "=>" or (prev == "->" and self.name == "java"):
            return True
        if self.name == "rust":
            return prev in ("|", "||")
        if self.name == "cpp":
            return prev == "]" or (prev == ")" and s.text(s.opener.get(i - 1, 0) - 1) == "]")
        if self.name in ("kotlin", "swift"):
            return prev in (")", "(", "=", ",") or (s.is_word(i - 1) and prev not in ("else", "try", "do", "finally", "defer", "get", "set", "init", "autoreleasepool"))
        return False

    def ruby(self, lo: int, hi: int) -> None:
        s = self.s
        stack: list[list] = [["def", 0]]
        swallow, first = False, None
        for i in range(lo, hi):
            t, nest, frame = s.text(i), stack[-1][1], stack[-1][0]
            if s.toks[i].kind == "newline":
                swallow = False
            if t == "?" and self.is_ternary(i, hi):
                self.total += 1 + nest
            if t in ("{", "}"):
                if t == "{":
                    stack.append(["{", nest + (s.text(i - 1) == ")" or s.is_word(i - 1))])
                elif frame == "{":
                    stack.pop()
            if not s.is_word(i) or s.text(i - 1) in (".", "?.", ":") or (s.text(i + 1) == ":" and not s.toks[i + 1].gap):
                continue
            if t in ("if", "unless", "while", "until"):
                self.total += 1 + nest
                if not s.value_before(i):
                    stack.append([t, nest + 1])
                    swallow = t in ("while", "until")
            elif t in ("for", "case"):
                self.total += 1 + nest
                stack.append([t, nest + 1])
                swallow = t == "for"
            elif t == "elsif" or (t == "else" and frame in ("if", "unless")):
                self.total += 1
            elif t == "rescue":
                outer = stack[-2][1] if len(stack) > 1 else 0
                self.total += 1 + outer
                if not s.value_before(i):
                    stack[-1][1] = outer + 1
            elif t == "ensure":
                stack[-1][1] = stack[-2][1] if len(stack) > 1 else 0
            elif t in ("begin", "do", "def", "class", "module"):
                if t == "do" and swallow:
                    swallow = False
                else:
                    stack.append([t, nest + (t in ("do", "def"))])
            elif t == "end" and len(stack) > 1:
                stack.pop()
            else:
                self.recursion(i)


def _fingerprint(source: Source, d: Definition, path: str) -> dict:
    toks = [t for t in source.toks[d.span[0] : d.span[1]] if t.kind != "newline"]
    shape, calls, at = [], [], -1
    for t, after in zip(toks, [*toks[1:], None], strict=False):
        if t.kind == "word":
            shape.append(t.text if t.text in RESERVED else "ID")
            if after is not None and after.text == "(" and t.text not in RESERVED:
                at += 1
                # the definition's own name comes first
                if at or t.text != d["name"]:
                    calls.append(t.text)
        elif t.kind in ("literal", "number"):
            shape.append("LIT")
        elif t.text in _CLOSE:
            shape.append(t.text)
    sha = lambda items: hashlib.sha1("\x02".join(items).encode()).hexdigest()
    scored = None
    if source.name not in _UNSCORED:
        try:
            scored = Score(source, d).total
        except RecursionError:
            scored = None
    columns = {k: d[k] for k in ("name", "kind", "line", "end_line", "scope")}
    return {"path": path} | columns | {
        "shape_hash": sha(shape), "raw_token_hash": sha([t.text for t in toks]), "call_hash": sha(sorted(calls)) if calls else None, "node_count": len(shape), "nstmts": _statements(source, *d.body),
        "has_control_flow": any(t.kind == "word" and t.text in CONTROL for t in toks), "cognitive": scored, "tokens": shape,
    }


def _statements(source: Source, lo: int, hi: int) -> int:
    """Statements directly in a body: what ``;``, a block or a line's end closes."""
    n, i, begun = 0, lo, False
    while i < hi:
        t = source.toks[i]
        if t.kind == "newline" or source.text(i) == ";":
            n, begun = n + begun, False
        else:
            begun = True
            i = source.match.get(i, i) if t.kind == "operator" else i
            if source.text(i) == "}" and source.text(i + 1) not in ("else", "catch", "finally", "while", ")", ";", ",", "."):
                n, begun = n + 1, False
        i += 1
    return n + begun


def _comments(source: Source, found: list[Definition], path: str) -> Iterator[dict]:
    """Every comment; one that documents goes to the next definition if that starts within two lines and no other comment is between."""
    lines = sorted(d["line"] for d in found)
    opened, around = 0, []
    for t, after in zip(source.comments, [*source.comments[1:], None], strict=False):
        doc = t.text.startswith(DOC_PREFIXES)
        owner = None
        if doc and not t.text.startswith(INNER_PREFIXES):
            at = bisect_left(lines, t.end)
            if at < len(lines) and lines[at] - t.end <= 2 and (after is None or after.end >= lines[at]):
                owner = lines[at]
        while opened < len(found) and found[opened]["line"] <= t.line:
            around.append(found[opened])
            opened += 1
        # definitions nest, so those that ended lie on top
        while around and around[-1]["end_line"] < t.end:
            around.pop()
        scope = f"{around[-1]['scope']}.{around[-1]['name']}".lstrip(".") if around else ""
        kind = "doc" if doc else "block" if t.text.startswith(("/*", "--[", "=begin")) else "line"
        yield {"path": path, "line": t.line, "end_line": t.end, "kind": kind, "is_doc": doc, "scope": scope, "owner_line": owner, "text": t.text}


def rows_of(path: str, text: str, name: str) -> Iterator[tuple[str, dict]]:
    """(row type, row) of one file in the language ``name``."""
    source = Source(text.replace("\r\n", "\n"), name)
    try:
        found = source.definitions()
    except RecursionError:
        found = source.found
    for d in found:
        yield "symbol", {"path": path, **d, "decorators": [], "exported": False}
        if d["kind"] in ("function", "method"):
            yield "fingerprint", _fingerprint(source, d, path)
    for row in _comments(source, found, path):
        yield "comment", row
