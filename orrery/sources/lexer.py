"""Tokens of sixteen languages from one regular expression each; the base of extraction where no parser is at hand."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

# fixed values: file suffixes of each language
SUFFIXES = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".mts", ".cts"),
    "tsx": (".tsx",),
    "go": (".go",),
    "rust": (".rs",),
    "csharp": (".cs",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "php": (".php",),
    "ruby": (".rb",),
    "bash": (".sh", ".bash"),
    "lua": (".lua",),
}
# fixed values: what a documenting comment starts with, and what one about its surroundings starts with
DOC_PREFIXES, INNER_PREFIXES = ("///", "//!", "/**", "#'"), ("//!", "/*!")

ALL_SUFFIXES = tuple(suffix for suffixes in SUFFIXES.values() for suffix in suffixes)
_SUFFIX_OF = {suffix: name for name, suffixes in SUFFIXES.items() for suffix in suffixes}


def language_of(path: str) -> str | None:
    base = path.rsplit("/", 1)[-1]
    return _SUFFIX_OF.get("." + base.rsplit(".", 1)[-1].lower()) if "." in base else None


@dataclass(frozen=True)
class Language:
    name: str
    comment: str
    strings: tuple[str, ...] = ()
    word: str = r"[^\W\d]\w*"
    #: A line's end ends a statement.
    lines: bool = False
    ternary: bool = False
    #: Conditions stand in parentheses.
    parens: bool = True


_SLASHES = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
_QUOTES = (r'"(?:\\(?s:.)|[^"\\\n])*"', r"'(?:\\(?s:.)|[^'\\\n])*'")
_TRIPLE = r'"""(?s:.*?)"""'
_BACKTICK = r"`(?:\\(?s:.)|[^`\\])*`"
_HASH = r"#[^\n]*"
_DIRECTIVE = r"^[ \t]*#(?:[^\n\\]|\\(?s:.))*"
_RUST = (r'b?r(?P<raw>#*)"(?s:.*?)"(?P=raw)', _QUOTES[0], r"'(?:\\[^']+|[^'\\\n])'")
_SCRIPT = {"comment": _SLASHES, "strings": (*_QUOTES, _BACKTICK), "word": r"[^\W\d]\w*|\$\w*", "lines": True, "ternary": True}
LANGUAGES = {
    x.name: x
    for x in (
        Language("javascript", **_SCRIPT), Language("typescript", **_SCRIPT), Language("tsx", **_SCRIPT),
        Language("go", _SLASHES, (*_QUOTES, r"`[^`]*`"), lines=True, parens=False),
        Language("rust", _SLASHES, _RUST, parens=False),
        Language("csharp", _SLASHES, (_TRIPLE, r'(?:\$@|@\$?)"(?:[^"]|"")*"', *_QUOTES), ternary=True),
        Language("java", _SLASHES, (_TRIPLE, *_QUOTES), ternary=True),
        Language("c", _SLASHES, (_DIRECTIVE, *_QUOTES), ternary=True),
        Language("cpp", _SLASHES, (_DIRECTIVE, r'R"(?P<raw>\w*)\((?s:.*?)\)(?P=raw)"', *_QUOTES), ternary=True),
        Language("kotlin", _SLASHES, (_TRIPLE, *_QUOTES), word=r"[^\W\d]\w*|`[^`\n]+`", lines=True),
        Language("swift", _SLASHES, (_TRIPLE, _QUOTES[0]), word=r"[^\W\d]\w*|`[^`\n]+`", lines=True, ternary=True, parens=False),
        Language("php", _SLASHES + r"|#(?!\[)[^\n]*", (r"\A(?s:.*?)<\?(?:php\b|=)?|\?>(?s:.*?)(?:<\?(?:php\b|=)?|\Z)", r"<<<[ \t]*['\"]?(?P<raw>\w+)['\"]?\n(?s:.*?)\n[ \t]*(?P=raw)\b", r'"(?:\\(?s:.)|[^"\\])*"', r"'(?:\\(?s:.)|[^'\\])*'"), word=r"\$?[^\W\d]\w*", ternary=True),
        Language("ruby", r"^=begin\b(?s:.*?)^=end[^\n]*|" + _HASH, _QUOTES, word=r"@{0,2}[^\W\d]\w*(?:[?!](?![=\w]))?", lines=True, ternary=True, parens=False),
        Language("bash", r"(?:^|(?<=[\s;]))#[^\n]*", (r'"(?:\\(?s:.)|[^"\\])*"', r"'[^']*'", r"\$\{[^}\n]*\}"), word=r"[^\W\d][\w-]*", lines=True),
        Language("lua", r"--\[(?P<long>=*)\[(?s:.*?)\](?P=long)\]|--[^\n]*", (*_QUOTES, r"\[(?P<raw>=*)\[(?s:.*?)\](?P=raw)\]"), word=r"[^\W\d]\w*", lines=True),
    )
}

#: Words that are no names in most of the languages.
RESERVED = frozenset(
    "if else elif elsif unless while until for foreach do loop repeat switch case when match select default break continue goto return yield try catch finally throw throws "
    "rescue ensure begin end function func fun fn def class struct interface enum trait protocol impl new delete typeof instanceof sizeof in is as not and or then guard await async".split()
)
CONTROL = frozenset("if unless while until for foreach do loop repeat switch case when match select try guard".split())


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    end: int
    #: Whether white space stands before it.
    gap: bool


@cache
def _pattern(name: str) -> re.Pattern:
    language = LANGUAGES[name]
    operator = r"&&|\|\||=>|->|::|\?\.|\?\?|\?:|\.\.\.|\.\.<?|[=!<>]=|[^\s]"
    kinds = {"comment": language.comment, "literal": "|".join(language.strings), "number": r"\d(?:\w|\.(?=\d))*", "word": language.word, "newline": r"\n", "operator": operator}
    return re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in kinds.items()), re.MULTILINE)


_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def tokens(text: str, name: str) -> tuple[list[Token], list[Token]]:
    """The tokens of a text and, apart, its comments; line ends are tokens where they end statements."""
    language, pattern, script = LANGUAGES[name], _pattern(name), name in ("javascript", "typescript", "tsx")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out, comments, at, gap = [], [], 0, True
    while (m := pattern.search(text, at)) is not None:
        gap = gap or m.start() > at
        kind, end = m.lastgroup, m.end()
        if script and m.group() == "/" and (not out or not (out[-1].kind in ("literal", "number") or out[-1].text in (")", "]", "}") or (out[-1].kind == "word" and out[-1].text not in RESERVED))) and (r := _REGEX.match(text, m.start())):
            kind, end = "literal", r.end()
        line = bisect_right(starts, m.start())
        token = Token(kind, text[m.start() : end], line, bisect_right(starts, max(m.start(), end - 1)), gap)
        if kind == "comment":
            comments.append(token)
        elif kind == "newline":
            if language.lines and out and out[-1].kind != "newline":
                out.append(token)
        elif not (kind == "literal" and (token.text.lstrip().startswith("#") or (name == "php" and (token.text.startswith("?>") or not out)))):
            out.append(token)
        gap, at = kind in ("newline", "comment"), end
    return out, comments
