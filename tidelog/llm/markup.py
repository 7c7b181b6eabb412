"""Plain words out of texts in typesetting markup. Plain Python over one text, run inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

_DEFINITION = re.compile(r"\\(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?\s*(\[\d\])?(?:\[[^\]]*\])?\s*(?=\{)|\\(?:g|e|x)?def\s*\\([A-Za-z]+)((?:#\d)*)\s*(?=\{)")
_NOTE = re.compile(r"\\(?:footnote|footnotetext|marginpar|thanks|todo|endnote)\s*(?:\[[^\]]*\])?(?=\{)")
_DEFINING = ("\\newcommand", "\\renewcommand", "\\def", "\\gdef", "\\edef", "\\xdef")
_NOTING = ("\\footnote", "\\marginpar", "\\thanks", "\\todo", "\\endnote")
_BRACE = re.compile(r"\\.|[{}]", re.S)
_POINTER = re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|autoref|label|input|include|subfile|bibliography|index)\*?\s*(?:\[[^\]]*\]){0,2}\s*\{[^{}]*\}")
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_HYPHEN = re.compile(r"(?<=\w)-[ \t]*\n[ \t]*(?=\w)")
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\s*\{[^{}]*\}(?:\[[^\]]*\])?")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?[ \t]*(?=\{)|\\-")
_REST = re.compile(r"\\[A-Za-z]+\*?|\\.|~")
_OWN = re.compile(r"\\([A-Za-z]+)(\{\}|[ \t]+)?")
_ANY_COMMAND = re.compile(r"\\[A-Za-z]+")
_WORDING = re.compile(r"\w\w|\d")
_BRACES = str.maketrans("", "", "{}")
#: Characters that the wording of one own command may reach.
GROWTH = 100_000
WORD = re.compile(r"[^\W_]+")


def braces(text: str) -> dict[int, int]:
    """The place of the closing brace for each opening one that has one, at any depth; escaped braces don't count."""
    out, opened = {}, []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}" and opened:
            out[opened.pop()] = m.start()
    return out


def closer(text: str) -> Callable[[int], int | None]:
    """A function that gives the place of the brace that closes the one at a place, or None.

    It looks behind the place asked for; where that is long, nested often, or not closed at all, all braces are paired once instead.
    """
    pairs: dict[int, int] | None = None
    steps = 0

    def close(at: int) -> int | None:
        nonlocal pairs, steps
        if pairs is None:
            depth = 0
            for m in _BRACE.finditer(text, at):
                steps += 1
                if m[0] == "{":
                    depth += 1
                elif m[0] == "}":
                    depth -= 1
                    if not depth:
                        return m.start()
                if steps > 5_000:
                    break
            pairs = braces(text)
        return pairs.get(at)

    return close


def cut(text: str, head: re.Pattern, keep: Callable[[re.Match, str], str]) -> str:
    """The text with each command that ``head`` finds, and the group in braces behind it, replaced by ``keep``(match, body). A group that isn't closed stays."""
    close, out, at = closer(text), [], 0
    for m in head.finditer(text):
        if m.start() < at:
            continue  # inside a group taken before
        end = close(m.end())
        if end is not None:
            out += [text[at : m.start()], keep(m, text[m.end() + 1 : end])]
            at = end + 1
    return "".join(out) + text[at:] if at else text


def notes_apart(text: str) -> list[str]:
    """The running text without notes, then each note without the notes inside it; one pass, whatever the depth."""
    heads = list(_NOTE.finditer(text)) if any(word in text for word in _NOTING) else []
    if not heads:
        return [text]
    close = closer(text)
    running: list[str] = []
    found, at = [running], 0
    inside: list[tuple[list[str], int]] = [(running, len(text) + 1)]

    def leave(until: int) -> None:
        nonlocal at
        while inside[-1][1] < until:
            parts, end = inside.pop()
            parts.append(text[at:end])
            at = end + 1

    for m in heads:
        end = close(m.end())
        if end is None:
            continue
        leave(m.start())
        inside[-1][0].append(text[at : m.start()])
        at = m.end() + 1
        found.append([])
        inside.append((found[-1], end))
    leave(len(text) + 1)
    running.append(text[at:])
    return ["".join(parts) for parts in found]


def macros(text: str) -> tuple[str, dict[str, str]]:
    """The text without the definitions of its own commands, and the wording of those without arguments."""
    if not any(word in text for word in _DEFINING):
        return text, {}
    found: dict[str, str] = {}

    def take(m: re.Match, body: str) -> str:
        name, args = (m[1], m[2]) if m[1] else (m[3], m[4])
        if not args:
            found[name] = body
        return " "

    return cut(text, _DEFINITION, take), found


def _fill(text: str, wording: dict[str, str]) -> str:
    def put(m: re.Match) -> str:
        body = wording.get(m[1])
        return m[0] if body is None else body + (" " if m[2] and m[2] != "{}" else "")

    return _OWN.sub(put, text)


def wordings(found: dict[str, str]) -> dict[str, str]:
    """What each own command stands for in the end, whatever the depth to which commands use one another.

    Commands that stand for symbols only are left out. Uses of commands that contain themselves stay as they are written inside others, and so do those in one whose
    wording would pass GROWTH characters, which no text that is meant to be set has.
    """
    uses = {name: {m[1] for m in _OWN.finditer(body)} & found.keys() for name, body in found.items()}
    users: dict[str, list[str]] = {name: [] for name in found}
    for name, needs in uses.items():
        for u in needs:
            users[u].append(name)
    lacking = {name: len(needs) for name, needs in uses.items()}
    ready = [name for name, n in lacking.items() if not n]
    for name in ready:  # grows while it is walked: each command after all it uses
        for user in users[name]:
            lacking[user] -= 1
            if not lacking[user]:
                ready.append(user)
    done: dict[str, str] = {}
    for name in [*ready, *(n for n, k in lacking.items() if k)]:  # the last ones run in circles
        body = _fill(found[name], {u: done[u] for u in uses[name] if u in done and lacking[u] == 0})
        done[name] = body if len(body) <= GROWTH else found[name]
    return {name: body for name, body in done.items() if _WORDING.search(_ANY_COMMAND.sub("", body))}


def expand(text: str, found: dict[str, str]) -> str:
    """Own commands replaced by what they stand for in the end (see wordings). Commands that stand for symbols stay."""
    worded = wordings(found) if found else {}
    return _fill(text, worded) if worded else text


def _flat(text: str) -> str:
    text = _HYPHEN.sub("", text)
    text = _ENVIRONMENT.sub(" ", text)
    text = _COMMAND.sub("", text)
    return _REST.sub(" ", text).translate(_BRACES)


def streams(text: str) -> list[str]:
    """All wording of a text, comments included, without markup: the running text, its comments joined, and each note by itself.

    Citations, references and notes are taken out of the text they interrupt, own commands are expanded, words broken at line ends are joined.
    """
    text, found = macros(text)
    text = expand(text, found)
    out = []
    if "%" in text:
        remarks: list[str] = []
        end = -2

        def put_aside(m: re.Match) -> str:
            nonlocal end
            own_line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip() == ""
            body = m[0].lstrip("% \t")
            if remarks and own_line and text[end : m.start()].strip() == "":
                remarks[-1] += "\n" + body
            else:
                remarks.append(body)
            end = m.end()
            return ""

        text = _COMMENT.sub(put_aside, text)
        out = remarks
    running, *notes = notes_apart(text)
    return [_flat(_POINTER.sub("", p)) for p in [running, *out, *notes]]


def wording_of_item(text: str) -> list[str]:
    """All words of a short plain text in order, those behind a % and, at the end, those of its notes too."""
    text, found = macros(text)
    return [w for p in notes_apart(expand(text, found).replace("%", " ")) for w in words(_flat(_POINTER.sub("", p)))]


def words(text: str) -> list[str]:
    """The words of a plain text, in lower case."""
    return WORD.findall(text.lower())


_HIDDEN = re.compile(r"\\iffalse\b.*?(?:\\fi\b|\Z)|\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)|\\begin\{(thebibliography|tabular\*?|table\*?|array|equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath|math|verbatim|lstlisting|tikzpicture|figure\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_MATH = re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|(?<!\\)\$(?:[^$\\\n]|\\.|\n(?![ \t]*\n))+\$", re.S)
_TITLES = re.compile(r"\\(?:title|author|date|section|subsection|subsubsection|chapter|paragraph|documentclass|usepackage|bibitem|bibliographystyle|graphicspath|newtheorem|setlength|hypersetup)\*?\s*(?:\[[^\]]*\])?\s*(?=\{)")


def prose(text: str) -> str:
    """The running prose of a text: no comments, commands, titles, formulas (of any length; a blank line ends one, as in typesetting), tables or bibliography."""
    text = _COMMENT.sub("", text)
    text, found = macros(text)
    text = _HIDDEN.sub(" ", text)
    text = _MATH.sub(" ", text)
    text = cut(text, _TITLES, lambda m, body: " ")
    text = expand(text, found)
    if any(word in text for word in _NOTING):
        text = cut(text, _NOTE, lambda m, body: " ")
    return _flat(_POINTER.sub("", text))
