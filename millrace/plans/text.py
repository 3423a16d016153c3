"""The textual form of expressions: s-expressions."""

from __future__ import annotations

from dataclasses import dataclass


class SyntaxProblem(ValueError):
    """A text that is no expression."""


@dataclass(frozen=True)
class Quoted:
    """A string token."""

    value: str


#: Escapes in quoted text.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "\\": "\\", '"': '"', "'": "'"}


def read_all(text: str) -> list:
    """Every expression of a text: nested lists of symbols (str) and Quoted strings."""
    stack: list[list] = [[]]
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c == ";" or text.startswith("//", i):
            while i < n and text[i] != "\n":
                i += 1
        elif c == "(":
            stack.append([])
            i += 1
        elif c == ")":
            if len(stack) == 1:
                raise SyntaxProblem(f"a parenthesis too many at {i}")
            done = stack.pop()
            stack[-1].append(done)
            i += 1
        elif c == '"':
            out, i = [], i + 1
            while i < n and text[i] != '"':
                if text[i] == "\\" and i + 1 < n:
                    if text[i + 1].isdigit() and text[i + 1 : i + 4].isdigit() and len(text[i + 1 : i + 4]) == 3:
                        out.append(chr(int(text[i + 1 : i + 4])))
                        i += 4
                        continue
                    out.append(ESCAPES.get(text[i + 1], text[i + 1]))
                    i += 2
                    continue
                out.append(text[i])
                i += 1
            if i >= n:
                raise SyntaxProblem("a string has no end")
            stack[-1].append(Quoted("".join(out)))
            i += 1
        else:
            j = i
            while j < n and not text[j].isspace() and text[j] not in '()"':
                j += 1
            stack[-1].append(text[i:j])
            i = j
    if len(stack) > 1:
        raise SyntaxProblem("a parenthesis has no end")
    return stack[0]


def read(text: str):
    """The one expression of a text."""
    found = read_all(text)
    if len(found) != 1:
        raise SyntaxProblem(f"one expression is expected, not {len(found)}: {text!r}")
    return found[0]


def write(e) -> str:
    if isinstance(e, Quoted):
        back = {v: k for k, v in ESCAPES.items() if k != "'"}
        return '"' + "".join(f"\\{back[c]}" if c in back else c for c in e.value) + '"'
    return f"({' '.join(map(write, e))})" if isinstance(e, list) else e
