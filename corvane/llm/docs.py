"""Functions paired with the documentation that stands with them.

Method: in each record, its docstring and every comment block are candidates
for the functions defined there. A link is scored by distance (the docstring,
text that opens the body, directly before the signature with only annotations
between, further away), by the parameters that the comment's tags name and by
mentions of the function's name. Links that are implausible (far away without
tags that all fit, or inside the function's own body) or whose text says
nothing are rejected; a bipartite assignment of greatest total score gives each
function at most one candidate, and each candidate to at most one function.
What is linked is stripped of marks, rulers, tool directives and commented-out
code.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import current

#: What stands for documentation that is still to be written, whole texts in lower case without end marks.
PLACEHOLDERS = re.compile(
    r"(?:todo|fixme|tbd|tba|xxx|wip|n\s*/\s*a|none|null|nil|docs?|documentation|description|comment|summary|placeholder|undocumented|lorem ipsum.*"
    r"|(?:todo|fixme|tbd|xxx)?\W*(?:please )?(?:add|write|insert|missing|needs?|fill in|provide)\W+(?:(?:some|the|a|missing|proper|me)\W+)*(?:docs?|docstring|documentation|description|comments?)(?:\W+(?:here|later|for this \w+|this \w+))*"
    r"|(?:there is )?no (?:docs?|documentation|description|comment)(?: \w+)?|(?:docs?|documentation|description|text|summary) (?:goes|comes|to go) here|to be (?:documented|written|done|added)|not (?:yet )?documented(?: yet)?|(?:missing|empty|dummy|sample) (?:docs?|documentation|description|comment))",
    re.I,
)
#: References elsewhere that say nothing themselves.
_REFERENCE = re.compile(r"\{?@(?:inherit_?doc|link|see)\b[^}\n]*\}?|^\W*(?:see(?: also)?|cf\.?|same as|refer to|as in|siehe(?: auch)?|vgl\.?|véase|ver|voir|veja)\b[\s:]*(?:the )?[\w.#:/()`{}@-]+\W*$|@doc false|@moduledoc false|https?://\S+", re.I | re.M)
_DIRECTIVE = re.compile(r"^\W*(?:\w*lint\w*\b|noqa\b|nosonar|nosec|pylint|flake8|mypy:|pyright|type:\s*ignore|rubocop|prettier|@ts-|ts-ignore|istanbul|c8 ignore|v8 ignore|coverage:|pragma\b|region\b|endregion\b|clang-|iwyu|phpcs|phpstan|psalm|checkstyle|suppress|swiftlint|ktlint|detekt|go:\w|\+build|nolint|credo:|dialyzer|sobelow|shellcheck|yapf:|fmt:|isort:|black:|formatter:|sonar|@formatter|vim:|-\*-|!/|@(?:no)?inspection|frozen_string_literal|encoding:|coding[:=])", re.I)
_CODE = re.compile(r"^\s*(?:[\w$.\[\]\"'>-]+\s*(?::=|\+=|-=|<-|=(?!=))\s*\S.*|(?:return|await|yield|raise|throw|import|let|const|var|val|final|def|fn|func|end|else|do)\b[^.!?]*[;({\[})=:]\s*|[\w$.]+\([^)]*\)\s*[;{]?|.*[;{}]\s*|[{}()\[\]]+)$")
_TAG = re.compile(r"^\s*(?:[@\\:](?:param|arg|argument|parameter|returns?|return|throws|exception|raises?|type|rtype|tparam|template|since|author|version|deprecated|see|spec|impl)\b\s*:?(?:\s*\{[^}]*\})?|[-*+](?=\s*\w+\s*[:-])|<param name=|</?(?:summary|param|returns?|remarks)[^>]*>)", re.I)
_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|///*!?|#+(?!\[)!?|--+\[*|;+|%+|\"\"\"|'''|<!--|-->)?\s?")
_OPENING = re.compile(r"^\s*@(?:module|type)?doc\s*(?:~[sS])?")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
_SAYS_NOTHING = frozenset("function functions method methods func fn procedure routine funktion methode función funcion método metodo fonction méthode função the a an of this that for to and or returns return param parameter".split())
_NAME_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_a-zA-Z]+")
_DEFINITION = re.compile(r"^\s*(?:(?:export|default|public|private|protected|internal|static|async|final|abstract|override|virtual|inline|extern|unsafe|suspend|open|pub(?:\([^)]*\))?|const|operator|synchronized)\s+)*(?:def|defp|defmacro|defmacrop|fn|func|function|fun|sub|proc)\b\s*\*?\s*(?:\([^)]*\)\s*)?(?P<name>[\w$?!.]+)")
_PARAMETER = re.compile(r"(?:[@:\\]param(?:eter)?\s+(?:\{[^}]*\}\s*)?|^\s*[*#/]*\s*-\s+)(\w+)", re.M)
_BODY_TEXT = re.compile(r"\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')")


def parts_of_name(name: str | None) -> set[str]:
    """The words of an identifier, in lower case."""
    return {p.lower() for p in _NAME_PART.findall(name or "")}


def stripped(raw: str) -> list[str]:
    """The lines of a comment without its marks."""
    lines = []
    for i, line in enumerate(raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        line = _OPENING.sub("", line) if i == 0 else line
        line = _MARK.sub("", line, count=1)
        line = re.sub(r"\s*(?:\*+/|\"\"\"|'''|-->)\s*$", "", line)
        if i == 0 and len(line) > 1 and line[0] == line.rstrip()[-1] and line[0] in "\"'":
            line = line.rstrip()[1:-1]
        lines.append(line.rstrip())
    return lines


def _read(raw: str | None) -> tuple[str, list[tuple[str, set[str]]]] | None:
    """(text without marks, (token, its words that say something)) of what may be documentation, or None if it is none of any function."""
    if not raw or not raw.strip() or re.match(r"\s*@(?:module|type)?doc\s+(?:false|nil)\b", raw):
        return None
    kept, said = [], []
    for line in stripped(raw):
        if _DIRECTIVE.search(line) or _CODE.match(line) or not any(c.isalnum() for c in line):
            continue
        kept.append(line)
        tag = _TAG.match(line)
        rest = line[tag.end() :] if tag else line
        if tag and "@see" in tag.group().lower():
            continue  # a reference elsewhere
        if tag:
            rest = re.sub(r"^\s*[\"'`]?[\w$.]+[\"'`]?\s*[:\->]*", "", rest, count=1) if "return" not in tag.group().lower() and tag.group().strip() else rest
        said.append(rest)
    text = "\n".join(said)
    plain = re.sub(r"\s+", " ", text).strip(" \t\"'`*_-=.:!#")
    if not plain or PLACEHOLDERS.fullmatch(plain):
        return None
    tokens = []
    for token in re.findall(r"[\w$]+(?:['’]\w+)?", _REFERENCE.sub(" ", text)):
        words = {p for p in (parts_of_name(token) if "_" in token or not token.islower() else {token.lower()}) if p not in _SAYS_NOTHING and not p.isdigit()}
        if words:
            tokens.append((token, words))
    return ("\n".join(kept).strip(), tokens) if tokens else None


def _known(name: str | None, parameters: set[str]) -> tuple[str | None, set[str], set[str]]:
    """(name, its words, parameters in lower case): what documentation of a function must go beyond."""
    return name, parts_of_name(name) | {(name or "").lower()}, {p.lower() for p in parameters}


def _says(tokens: list[tuple[str, set[str]]], known: tuple[str | None, set[str], set[str]]) -> bool:
    name, words, own = known
    return any(token.lower() not in own and token != name and not said <= words for token, said in tokens)


def meaningful(raw: str | None, name: str | None, parameters: set[str] = frozenset()) -> str | None:
    """The documentation that ``raw`` holds, without its marks, or None if it says nothing.

    It must say something beyond the function's name, bare parameter names, a
    reference elsewhere and placeholders. Rulers, directives and commented-out code say nothing.
    """
    read = _read(raw)
    return read[0] if read and _says(read[1], _known(name, parameters)) else None


def _comment_end(lines: list[str], i: int) -> int | None:
    """The line after the comment that begins at line ``i``, or None if none begins there."""
    line = lines[i].strip()
    for begin, end in (("/*", "*/"), ("<!--", "-->")):
        if line.startswith(begin):
            j = i
            while j < len(lines) and end not in lines[j][lines[j].find(begin) + 2 if j == i else 0 :]:
                j += 1
            return min(j + 1, len(lines))
    if _OPENING.match(line):
        for mark in ('"""', "'''"):
            if mark in line:
                j = i + 1 if line.count(mark) == 1 else i
                while j > i and j < len(lines) and mark not in lines[j]:
                    j += 1
                return min(j + 1, len(lines))
        return i + 1
    if _line_comment(line):
        j = i
        while j < len(lines) and _line_comment(lines[j].strip()):
            j += 1
        return j
    return None


def _line_comment(line: str) -> bool:
    return line.startswith(("//", "--", ";;")) or (line.startswith("#") and not re.match(r"#(?:\[|!\[|include|define|ifdef|ifndef|if\b|endif|else\b|pragma|undef)", line)) or (line.startswith("%") and line[:2] in ("%%", "% "))


def _annotation(line: str) -> bool:
    return bool(re.match(r"@[\w.:]+(?:\(.*\))?|#!?\[.*\]$|\[[A-Z]\w*(?:\(.*\))?\]$|template\s*<.*>$", line)) and not _OPENING.match(line)


def parameters_of(signature: str) -> set[str]:
    """The names between the signature's parentheses."""
    inner = signature[signature.find("(") + 1 : signature.rfind(")")] if "(" in signature else ""
    return set(re.findall(r"[A-Za-z_$][\w$]*", inner)) - {"self", "this"}


def comments_and_functions(content: str, name: str | None, signature: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, str, str, bool]]]:
    """((first line, line after, text) of comments, (line, name, signature, whether it is the record's own) of functions) of a record."""
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    comments, functions, i = [], [], 0
    wanted = (signature or "").strip().split("\n")[0].strip()
    own = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])") if name else None
    main = False
    while i < len(lines):
        line = lines[i].strip()
        end = _comment_end(lines, i) if line else None
        if end is not None:
            comments.append((i, end, "\n".join(lines[i:end])))
            i = end
            continue
        found = _DEFINITION.match(line)
        if not main and line and ((wanted and line == wanted) or (own and own.search(line) and not _annotation(line))):
            functions.append((i, name or "", line, True))
            main = True
        elif found:
            functions.append((i, found["name"], line, False))
        if functions and functions[-1][0] == i and line.endswith(":") and i + 1 < len(lines):
            j = i + 1
            if (text := _BODY_TEXT.match(lines[j])) and (mark := text[1]):
                begin, k = text.end(), j
                while k < len(lines) and mark not in lines[k][begin if k == j else 0 :] and len(mark) == 3:
                    k += 1
                k = min(k, len(lines) - 1)
                body = "\n".join(lines[j : k + 1]).strip()
                inside = re.sub(rf"^[rRuUbB]{{0,2}}{mark}|{mark}\s*$", "", body)
                comments.append((j, -(i + 1), inside))  # opens the body of the function on line i
                i = k
        i += 1
    return comments, functions


def assigned(score: list[list[float]]) -> list[int]:
    """For each row the column of a bipartite assignment of greatest total score, -1 for none; scores of 0 or less are no links."""
    return _assigned(lambda i: np.array(score[i], float), len(score), len(score[0]) if score else 0)


def _assigned(row: Callable[[int], np.ndarray], n: int, m: int) -> list[int]:
    """:func:`assigned` of ``n`` rows to ``m`` columns where ``row(i)`` makes the scores of a row (shortest augmenting paths)."""
    taken, holder = [-1] * n, [-1] * m  # a row's column, a column's row
    gain, price = [0.0] * n, np.zeros(m)  # no score is above the sum of its row's gain and its column's price; it is that sum where assigned
    for first in range(n if m else 0):
        reach = price - row(first)
        j = int(np.argmin(reach))
        if reach[j] >= 0:
            continue
        if holder[j] < 0:
            taken[first], holder[j], gain[first] = j, first, -float(reach[j])
            continue
        # The column is taken: the cheapest chain of moves that ends at a free column, or leaves one of the rows alone.
        way, fresh, waiting = np.full(m, first), np.ones(m, bool), reach.copy()
        end, alone, met = 0.0, first, []
        while waiting[j := int(np.argmin(waiting))] < end:
            at, i = float(waiting[j]), holder[j]
            fresh[j], waiting[j] = False, np.inf
            if i < 0:
                end, alone = at, -1
                break
            met.append((j, i))
            if at + gain[i] < end:
                end, alone = at + gain[i], i
            cost = price - row(i)
            cost += at + gain[i]
            better = cost < reach
            better &= fresh
            for old in (reach, waiting):
                np.copyto(old, cost, where=better)
            way[better] = i
        for c, i in met:
            more = end - float(reach[c])
            if more > 0:
                price[c] += more
                gain[i] -= more
        gain[first] = -end
        if alone == first:
            continue
        if alone >= 0:
            j, taken[alone] = taken[alone], -1
        while True:
            i = int(way[j])
            holder[j], taken[i], j = i, j, taken[i]
            if i == first:
                break
    return taken


class _Links:
    """Every plausible link of a record's comments: called with a comment's number, the scores of all functions, -1 where there is none. They are made when asked for, so memory grows with functions and comments, not with their pairs."""

    def __init__(self, lines: list[str], comments: list[tuple[int, int, str]], functions: list[tuple[int, str, str, bool]]):
        at = [f[0] for f in functions]
        self.at = np.array(at, int)
        names = [parameters_of(f[2]) for f in functions]
        having: dict[str, list[int]] = {}
        for i, own in enumerate(names):
            for n in own:
                having.setdefault(n, []).append(i)
        fitting: dict[frozenset[str], tuple[np.ndarray, list[int]]] = {}  # the functions that have all parameters that some tags name
        self.held: list[tuple[int, np.ndarray | None, list[int], dict[int, float]]] = []
        for begin, end, text in comments:
            tagged = frozenset(_PARAMETER.findall(text))
            close, near = bisect_left(at, -end - 1 if end < 0 else end), 0.0
            if end < 0:
                near = 3.0  # opens the body of the function on that line
            elif close < len(at) and all(_annotation(x.strip()) or _DIRECTIVE.search(x) for x in lines[end : at[close]]):
                near = 2.0
            inside = bisect_right(at, begin) - 1
            given = {inside: -1.0} if inside >= 0 and at[inside] < begin else {}  # else it stands in that function's own body
            if near:
                both = len(tagged & names[close]) / len(tagged) if tagged else 0.0
                strange = 1.75 if tagged and names[close] and not both else 0.0
                given[close] = near + both + 0.5 * (bool(functions[close][1]) and functions[close][1] in text) - strange
            if tagged and tagged not in fitting:
                fits = [i for i in min((having.get(t, []) for t in tagged), key=len) if tagged <= names[i]]
                fitting[tagged] = np.isin(np.arange(len(at)), fits), fits
            far, fits = fitting[tagged] if tagged else (None, [])
            self.held.append((begin, far if fits else None, [i for i in fits if functions[i][1] and functions[i][1] in text], given))

    def __call__(self, c: int) -> np.ndarray:
        begin, far, named, given = self.held[c]
        scores = np.full(len(self.at), -1.0) if far is None else np.where(far, 1 / (2 + np.abs(self.at - begin)) + 1.0, -1.0)
        if named:
            scores[named] += 0.5
        for i, score in given.items():
            scores[i] = score
        return scores


def scored_links(lines: list[str], comments: list[tuple[int, int, str]], functions: list[tuple[int, str, str, bool]]) -> dict[tuple[int, int], float]:
    """The score of every plausible link of a function and a comment, by their numbers: with the function whose body it opens or before which it stands, and with all functions, at any distance, that have all parameters its tags name."""
    of = _Links(lines, comments, functions)
    return {(i, c): s for c in range(len(comments)) for i, s in enumerate(of(c).tolist()) if s > 0}


def links(content: str, name: str | None, signature: str | None, docstring: str | None = None) -> list[tuple[str, str, str | None, str]]:
    """(name, signature, documentation or None, docstring or content) of every function of a record that has documentation or is its own, the own first."""
    comments, functions = comments_and_functions(content, name, signature)
    plausible, n = _Links(content.replace("\r\n", "\n").replace("\r", "\n").split("\n"), comments, functions), len(functions)
    own = next((i for i, f in enumerate(functions) if f[3]), -1)
    if own < 0:  # its signature is not in its content: only the docstring can be its own
        own, functions = n, [*functions, (1 << 60, name or "", signature or "", True)]
    known = [_known(name if i == own else f[1], parameters_of(signature if i == own and signature else f[2])) for i, f in enumerate(functions)]
    read = [_read(text) for _, _, text in [*comments, (0, 0, docstring)]]
    knowing: dict[str, list[int]] = {}  # functions whose name or parameters have a word
    for i, (_, words, parameters) in enumerate(known):
        for w in words | parameters:
            knowing.setdefault(w, []).append(i)
    silent = []  # functions of which each comment says nothing: they know all its tokens, so also the rarest
    for r in read:
        fewest = min(({*knowing.get(token.lower(), ()), *knowing.get(min(said), ())} for token, said in r[1]), key=len) if r else ()
        silent.append([i for i in fewest if not _says(r[1], known[i])])

    @lru_cache(4_000_000 // len(functions) + 1)  # 32 MB; other rows are made again
    def row(c: int) -> np.ndarray:
        scores = np.full(len(functions), -1.0)
        if not read[c]:
            return scores
        if c == len(comments):
            scores[own] = 4.0
        else:
            scores[:n] = plausible(c)
        if silent[c]:
            scores[silent[c]] = -1.0
        return scores

    of = {i: c for c, i in enumerate(_assigned(row, len(read), len(functions))) if i >= 0}
    found = [(own, of.get(own, -1)), *sorted((i, c) for i, c in of.items() if i != own)]
    return [(functions[i][1], functions[i][2], read[c][0] if c >= 0 else None, "docstring" if c == len(comments) else "content") for i, c in found]


def documented(symbols: DataFrame) -> DataFrame:
    """(symbol_id, kind, signature, content, documentation, found_in) of every function or method with meaningful documentation.

    Input: id, kind, name, signature, docstring, content. ``found_in`` is
    ``docstring`` where that says something, else ``content``. Null, empty and
    trivial documentation gives no row; of several deliveries of an id the latest counts.
    """
    wanted = current(symbols, "kind", "name", "signature", "docstring", "content").filter(F.lower("kind").isin("function", "method"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, where = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("name", "signature", "docstring", "content")), strict=True)
            for i, (name, signature, docstring, content) in enumerate(rows):
                _, _, doc, origin = links(content or "", name, signature, docstring)[0]
                if doc is not None:
                    ids.append(i)
                    docs.append(doc)
                    where.append(origin)
            took = batch.take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column("id"), took.column("kind"), took.column("signature"), took.column("content"), pa.array(docs, pa.string()), pa.array(where, pa.string())], names=["symbol_id", "kind", "signature", "content", "documentation", "found_in"])

    return wanted.mapInArrow(pair, "symbol_id string, kind string, signature string, content string, documentation string, found_in string")
