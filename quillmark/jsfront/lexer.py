"""Tokens of ECMAScript source, one at a time; the parser says where a regular expression or template goes on."""

from __future__ import annotations

import re


class JsSyntaxError(ValueError):
    pass


_GAP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*(?s:.*?)\*/)+")
_LINE = re.compile("[\n\r\u2028\u2029]")
_IDENT = r"(?:[$_a-zA-Z\u00aa-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[$\w\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_TOKEN = re.compile(
    rf"(?P<num>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?n?)"
    rf"|(?P<name>{_IDENT})|(?P<priv>\#{_IDENT})"
    r"""|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|(?s:.)))*"|'(?:[^'\\\n\r]|\\(?:\r\n|(?s:.)))*')"""
    r"|(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"
)
_REGEX = re.compile(r"/((?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+)/([$\w]*)")
_TEMPLATE = re.compile(r"((?:[^`\\$]|\\(?s:.)|\$(?!\{))*)(`|\$\{)")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([0-3]?[0-7]{1,2})|(\r\n|(?s:.)))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}


def cook(raw: str) -> str:
    """The value of what stands between a string's quotes."""
    if "\\" not in raw:
        return raw

    def one(m: re.Match) -> str:
        if digits := m[1] or m[2] or m[3]:
            return chr(min(int(digits, 16), 0x10FFFF))
        return chr(int(m[4], 8)) if m[4] else _PLAIN.get(m[5], m[5])

    # halves of a pair are one character
    return _ESCAPE.sub(one, raw).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass" if _lone(raw) else "replace")


def _lone(raw: str) -> bool:
    return "\\u" in raw


class Lexer:
    """The current token: ``kind``, ``value``, ``start``, ``end``, and whether a line break comes before it."""

    def __init__(self, source: str):
        self.source, self.end, self.last_end = source, 0, 0
        if source.startswith("#!"):
            m = _LINE.search(source)
            self.end = m.start() if m else len(source)
        self.next()

    def next(self) -> None:
        at = self.last_end = self.end
        self.newline = False
        if m := _GAP.match(self.source, at):
            at = m.end()
            self.newline = bool(_LINE.search(m[0]))
        self.start, self.escaped = at, False
        if at >= len(self.source):
            self.kind, self.value, self.end = "eof", "", at
            return
        m = _TOKEN.match(self.source, at)
        if not m:
            raise JsSyntaxError(f"unexpected character at {at}")
        self.kind, self.value, self.end = m.lastgroup, m[0], m.end()
        if self.kind in ("name", "priv") and "\\" in self.value:
            self.value, self.escaped = cook(self.value), True
        elif self.kind == "num" and self.end < len(self.source) and re.match(r"[$\w]", self.source[self.end]):
            raise JsSyntaxError(f"identifier right after a number at {at}")

    def regex(self) -> tuple[str, str]:
        """Read the current ``/`` as a regular expression."""
        m = _REGEX.match(self.source, self.start)
        if not m:
            raise JsSyntaxError(f"unterminated regular expression at {self.start}")
        self.end = m.end()
        self.next()
        return m[1], "".join(sorted(m[2]))

    def template_part(self, at: int) -> tuple[str, bool]:
        """Raw text from ``at`` to the end of the template (True) or to an expression (False), read past."""
        m = _TEMPLATE.match(self.source, at)
        if not m:
            raise JsSyntaxError(f"unterminated template at {at}")
        self.end = m.end()
        return m[1].replace("\r\n", "\n").replace("\r", "\n"), m[2] == "`"

    def save(self) -> tuple:
        return self.kind, self.value, self.start, self.end, self.newline, self.escaped, self.last_end

    def restore(self, state: tuple) -> None:
        self.kind, self.value, self.start, self.end, self.newline, self.escaped, self.last_end = state


def number(text: str) -> float | int:
    """Value of a numeric literal; an int for a BigInt."""
    t = text.replace("_", "")
    if t.endswith("n") and not t[:2].lower() == "0x" or t[:2].lower() == "0x" and t[-1] == "n":
        return int(t[:-1], 0) if t[:2].lower() in ("0x", "0o", "0b") else int(t[:-1])
    if t[:2].lower() in ("0x", "0o", "0b"):
        return float(int(t, 0))
    if len(t) > 1 and t[0] == "0" and t.isdigit():
        return float(int(t, 8)) if not set(t) & {"8", "9"} else float(t)
    return float(t)
