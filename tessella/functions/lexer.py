"""Token streams of Java, C, C++ and prose, without a parser.

A lexer and local rules stand in for a grammar: what a name is follows from its neighbours. Each token has a normalised value, its
bytes and a unit index, which also counts what is left out (imports, preprocessor lines) so that a gap shows. Divergence: names whose class only
a grammar can tell, such as a type in a cast, are IDs here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

LITERALS = {"java": ("STR", "CHAR"), "c": ("STR_LIT", "CHAR_LIT"), "cpp": ("STR_LIT", "CHAR_LIT")}
#: The reserved words of the languages.
JAVA_WORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
C_WORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while true false NULL".split())
CPP_WORDS = C_WORDS | frozenset("alignas alignof bool catch class constexpr const_cast decltype delete dynamic_cast explicit export final friend mutable namespace new noexcept nullptr operator override private protected public reinterpret_cast static_assert static_cast template this throw try typename using virtual".split())
WORDS = {"java": JAVA_WORDS, "c": C_WORDS, "cpp": CPP_WORDS}

LEXEME = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<raw>R"(?P<d>[^\s()\\]{0,16})\(.*?\)(?P=d)")
      | (?P<block>\"{3}.*?\"{3})
      | (?P<str>"(?:\\.|[^"\\\n])*"?)
      | (?P<char>'(?:\\.|[^'\\\n])*'?)
      | (?P<num>(?:\d|\.\d)(?:[eEpP][+-]|[\w.'])*)
      | (?P<name>[^\W\d]\w*)
      | (?P<sign>>>>=|<<=|>>=|\.\.\.|->\*|::|->|\+\+|--|&&|\|\||[-+*/%&|^!=<>]=|<<|[^\s\w])""",
    re.S | re.X,
)
DIRECTIVE = re.compile(r"[ \t]*#(?:\\\r?\n|[^\n])*", re.S)


@dataclass
class Token:
    norm: str
    byte_start: int
    byte_end: int
    unit_index: int


@dataclass
class Parsed:
    tokens: list[Token]
    comments: list[tuple[str, int, int]]


def _directives(source: str) -> list[tuple[int, int]]:
    """Spans of preprocessor lines; from #if to its #endif is one span."""
    spans, depth, begin, at = [], 0, 0, 0
    while at < len(source):
        m = DIRECTIVE.match(source, at)
        if m:
            word = re.match(r"[ \t]*#[ \t]*(\w*)", m[0])[1]
            if word in ("if", "ifdef", "ifndef"):
                if not depth:
                    begin = at
                depth += 1
            elif word == "endif" and depth:
                depth -= 1
                if not depth:
                    spans.append((begin, m.end()))
            elif not depth:
                spans.append((at, m.end()))
            at = m.end()
        line = source.find("\n", at)
        at = line + 1 if line >= 0 else len(source)
    if depth:
        spans.append((begin, len(source)))
    return spans


def _statements(source: str) -> list[tuple[int, int]]:
    """Package and import declarations of Java."""
    return [m.span(1) for m in re.finditer(r"(?:^|(?<=[;}\n]))\s*((?:package|import)\b[^;{}]*;)", source)]


def byte_places(source: str) -> Callable[[int], int]:
    """The byte at which the character with a number begins; worked out once for all of them."""
    if source.isascii():
        return lambda i: i
    points = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(size)]).tolist().__getitem__


def lex(source: str, language: str, boundaries: tuple[int, ...] = ()) -> Parsed:
    """Tokens and comments; boundaries: the first bytes of the second and later files, each of which is a unit of its own."""
    if language == "prose":
        return _prose(source)
    skipped = _statements(source) if language == "java" else _directives(source)
    byte = byte_places(source)
    raw: list[tuple[str, str, int, int]] = []
    comments: list[tuple[str, int, int]] = []
    jumps: list[tuple[int, int]] = []
    at = 0
    for begin, end in [*skipped, (len(source), len(source))]:
        for m in LEXEME.finditer(source, at, begin):
            kind = "str" if m.lastgroup in ("block", "d") or m["raw"] else m.lastgroup
            if kind == "comment":
                comments.append((m[0], m.start(), m.end()))
            else:
                raw.append((kind, m[0], m.start(), m.end()))
        if end > begin:
            jumps.append((begin, max(1, sum(x.lastgroup != "comment" for x in LEXEME.finditer(source, begin, end)))))
        at = end
    tokens: list[Token] = []
    in_record = _records(raw) if language != "java" else []
    unit, jump, edge = 0, 0, 0
    for k, (kind, text, a, b) in enumerate(raw):
        if language != "java" and kind == "str" and k and raw[k - 1][0] == "str":
            tokens[-1].byte_end = byte(b)  # strings side by side are one
            continue
        start = byte(a)
        while jump < len(jumps) and jumps[jump][0] <= a:
            unit += jumps[jump][1]
            jump += 1
        while edge < len(boundaries) and boundaries[edge] <= start:
            unit += 1
            edge += 1
        tokens.append(Token(_norm(raw, k, language, in_record), start, byte(b), unit))
        unit += 1
    return Parsed(tokens, [(t, byte(a), byte(b)) for t, a, b in comments])


def _norm(raw: list[tuple[str, str, int, int]], k: int, language: str, in_record: list[bool]) -> str:
    kind, text = raw[k][:2]
    if kind == "str":
        return LITERALS[language][0]
    if kind == "char":
        return LITERALS[language][1]
    if kind == "num":
        return "NUM" if language == "java" else "FLOAT_LIT" if re.search("[.eE]", text) else "INT_LIT"
    if kind != "name":
        return text
    if text in WORDS[language]:
        return "BOOL" if language == "java" and text in ("true", "false") else text
    before = raw[k - 1][1] if k else ""
    after, then = (raw[k + 1][:2] if k + 1 < len(raw) else ("", "")), (raw[k + 2][1] if k + 2 < len(raw) else "")
    if language == "java":
        if before in ("new", "extends", "implements", "throws", "instanceof") or after[0] == "name" and after[1] not in ("instanceof",) and before != ".":
            return "TYPE_ID"
        if before == "<" and after[1] in (">", ",") or after[1] == "<" and text[:1].isupper() or after[1] == "[" and then == "]":
            return "TYPE_ID"
        return "ID"
    if language == "cpp" and (after[1] == "::" or before == "namespace" and k > 1 and raw[k - 2][1] == "using"):
        return "NS_ID"
    if language == "cpp" and before == "namespace":
        return "NS_ID"
    if before in (".", "->"):
        return "FIELD_ID"
    if before in ("struct", "class", "union", "enum", "typename") or after[0] == "name" and after[1] not in C_WORDS:
        return "TYPE_ID"
    if before == "::" and after[0] == "name" or before == "}" and after[1] == ";" and any(x[1] == "typedef" for x in raw[max(0, k - 64) : k]):
        return "TYPE_ID"
    if after[1] in (";", ",", "[", "=") and in_record[k]:
        return "FIELD_ID"
    return "ID"


def _records(raw: list[tuple[str, str, int, int]]) -> list[bool]:
    """Of each token, whether the innermost brace that is open before it belongs to a struct, class or union."""
    out, open_braces = [], []
    for k, (_, text, _, _) in enumerate(raw):
        out.append(bool(open_braces) and open_braces[-1])
        if text == "{":
            open_braces.append(any(x[1] in ("struct", "class", "union") for x in raw[max(0, k - 2) : k]))
        elif text == "}" and open_braces:
            open_braces.pop()
    return out


def _prose(source: str) -> Parsed:
    """Words in lower case. Beyond the languages that comparisons are for: it makes the operators usable on text."""
    data, tokens = source.encode(), []
    for k, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", data)):
        tokens.append(Token(m[0].decode("utf-8", "replace").lower(), m.start(), m.end(), k))
    return Parsed(tokens, [])


WORD = re.compile(r"[^ \t-\r]+")


def norms(source: str, language: str) -> list[str]:
    """The normal texts of the tokens alone, of one file."""
    return WORD.findall(source.lower()) if language == "prose" else [t.norm for t in lex(source, language).tokens]


def normalize_comment(text: str) -> str:
    """Lower case, signs as spaces, single spaces."""
    return " ".join("".join(c if c.isalnum() or c.isspace() else " " for ch in text for c in ch.lower()).split())


def trailing_comments(source: str) -> list[tuple[int, int]]:
    """Byte spans of comments that follow code on their line; a line comment takes its newline along. Strings and characters end at the line's end at the latest."""
    spans, code, at = [], False, 0
    byte = byte_places(source)
    piece = re.compile(r"""//[^\n]*\n?|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*(?:"|\n|\Z)|'(?:\\.|[^'\\\n])*(?:'|\n|\Z)|\n|\s|.""", re.S)
    for m in piece.finditer(source, at):
        text = m[0]
        if text.startswith("//") or text.startswith("/*"):
            if code:
                spans.append((byte(m.start()), byte(m.end())))
            if text.startswith("//") or "\n" in text:
                code = False
        elif text[-1] == "\n":
            code = False
        elif not text.isspace():
            code = True
    return spans
