"""Source text of a token stream: what operators.render does with rows, for one script at a time."""

from __future__ import annotations

from unspool.kernels import tokens as tok

#: First words that end a block, begin one, or stand one level back on their own line.
CLOSERS = ("WEnd", "Until", "Next", "EndSelect", "EndSwitch", "EndFunc", "EndIf")
OPENERS = ("While", "Do", "For", "Select", "Switch", "Func")
BACK = ("Case", "Else", "ElseIf", *CLOSERS)
#: Words without a space before them, and those without one behind.
NONE_BEFORE, NONE_BEHIND = frozenset(",)]["+ "("), frozenset("([")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STEPS = dict.fromkeys(OPENERS, 1) | dict.fromkeys(CLOSERS, -1)


class Renderer:
    """Renders scripts with one table of function names."""

    def __init__(self, functions: list[tuple[int, str]]):
        by_name = lambda names: {n.translate(_LOWER): n for n in names if n is not None}
        self.keywords, self.functions = tok.KEYWORDS, {i: n for i, n in functions if n is not None}
        self.spelled = {"KeywordString": by_name(tok.KEYWORDS[1:]), "FunctionString": by_name(n for _, n in functions), "MacroString": by_name(tok.MACROS)}

    def word(self, kind: str, text: str | None, i: int | None, u: int | None) -> str:
        """A token as source text."""
        if kind in ("BareString", "Operator", "RawString", "F64"):
            return text
        if kind == "Variable":
            return "$" + text
        if kind in self.spelled:
            return ("@" if kind == "MacroString" else "") + self.spelled[kind].get(text.translate(_LOWER), text)
        if kind == "KeywordId":
            return self.keywords[i] if 0 <= i < len(self.keywords) else f"<keyword:{i}>"
        if kind == "FunctionId":
            return self.functions[i] if i in self.functions else f"<function:{i}>"
        if kind == "QuotedString":
            return '"' + text.replace('"', '""') + '"'
        if kind == "Property":
            return "." + text
        return str(u) if kind in ("U32", "U64") else f"<opcode:0x{i:x}>"

    def render(self, tokens: list[tuple]) -> str:
        out, words, held, word = [], [], 0, self.word
        for kind, text, i, u, _ in tokens:
            if kind != "LineEnd":
                words.append(text if kind == "BareString" else word(kind, text, i, u))
                continue
            first = words[0] if words else None
            out.append("\t" * (max(held - 1, 0) if first in BACK else held))
            seen, before = False, None
            for w in words:
                if seen and w not in NONE_BEFORE and before not in NONE_BEHIND:
                    out.append(" ")
                out.append(w)
                seen, before = seen or w != "", w
            out.append("\r\n")
            held = max(held + (words[-1] == "Then" if first == "If" else _STEPS.get(first, 0)), 0)
            words = []
        return "".join(out)
