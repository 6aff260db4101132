"""Literal credentials in code, comments and configuration, and their redaction.

Method: the lexical tokens of a line are labelled by a linear-chain conditional
random field (outside, first and further tokens of a credential) with features
of a token's shape and its context; Viterbi's best path tells exactly which
characters are masked. The field is trained here, on lines that are made up
from a grammar of keys, values and ways to write them (``LINES`` of them, with
a fixed seed). Every line that holds a token long enough for a credential is
labelled, whatever words stand beside it.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import current, hash128

LINES, EPOCHS, SEED = 5000, 4, 7
MASK = "********"
#: Fixed value: the token that a line needs to be labelled, as no credential is shorter.
_LONG = re.compile(r"[^\s\"'`=:;,(){}<>\[\]@|]{4}")
_PEM = re.compile(r"-----BEGIN[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN)[\s\S])*?(?:-----END[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?=[\"'](?:\s|[;,)\]}]|$))|\Z)")
_LEX = re.compile(r"-----BEGIN[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[^\"'\n]*|[^\s\"'`=:;,(){}<>\[\]@|]{8,}==(?=[\"'`\s;,)}\]]|$)|[^\s\"'`=:;,(){}<>\[\]@|]+|[\"'`=:;,(){}<>\[\]@|]")
#: Words before a token that tell on their own.
_BEFORE = "basic bearer pwd on password sk key the".split()
_BEFORE_AT = {w: i + 1 for i, w in enumerate(_BEFORE)}
#: The parts of a name, on its letters' cases (:func:`_parts`).
_PARTS = re.compile(r"A+(?=Aa)|A?a+|A+|9+")
#: The kind of each ASCII character, and runs of characters that are alike but for marks among small letters.
_CASES = {i: "a" if chr(i).islower() else "A" if chr(i).isupper() else "9" if chr(i).isdigit() else "s" for i in range(128)}
_RUNS = re.compile(r"[as]+|A+|9+")
#: Fixed value: tokens and lines whose features or labels are kept at once.
_KEPT = 50_000
#: Tokens of a line from which on its best path is looked for by itself, and characters of texts whose lines are labelled together.
_WIDE, _BATCH = 2000, 4_000_000
#: Kinds of name parts.
_KINDS = {
    "pw": "password passwd passwort pwd pass passphrase phrase passcode pin contraseña contrasena clave kennwort losungswort senha palavrapasse motdepasse parola wachtwoord lösenord heslo hasło пароль 密码 密碼 パスワード 비밀번호",
    "sec": "secret token credential credentials creds apikey bearer auth authorization jwt session cookie sid webhook hook dsn signature",
    "key": "key keys",
    "keykind": "api access private signing encryption billing account master service shared client deploy license secret",
    "not": "checksum digest hash sha sha1 sha256 sha512 md5 commit revision rev integrity trace uuid guid icon image logo label title hint url uri href link page public pub fingerprint version name path file count size limit length expires ttl type status color font etag request build",
    "id": "id ids",
}
_KIND = {w: k for k, words in _KINDS.items() for w in words.split()}
_KNOWN = re.compile(r"AKIA[A-Z0-9]{12,}|ASIA[A-Z0-9]{12,}|gh[pousr]_\w{20,}|github_pat_\w{20,}|glpat-[\w-]{15,}|sk_(?:live|test)_\w{10,}|rk_live_\w{10,}|sk-[\w-]{16,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{8,}\.[\w-]{6,}|AIza[\w-]{20,}|npm_\w{20,}|pypi-\w{16,}|SG\.[\w-]{10,}\.[\w-]{10,}|hf_\w{16,}|dop_v1_\w{20,}|shpat_\w{16,}")
_KNOWN_STARTS = frozenset("AK AS gh gi gl sk rk xo ey AI np py SG hf do sh".split())
_PLACEHOLDER = re.compile(r"your|example|changeme|change_me|placeholder|redacted|dummy|insert|replace|todo|xxxx|\*\*\*|\.\.\.|fixme|enter|hidden|masked|none|null|undefined|sample_|my_?(?:pass|secret|token|key)")
_DOTTED, _NUMBERED = re.compile(r"[A-Za-z_]\w*(?:\.\w+)*"), re.compile(r"[A-Za-z_]+\d{0,2}")
_HEX, _UUID = re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def _first(n: int, lower: bool, upper: bool, digit: int, special: int, changes: int) -> tuple[str, ...]:
    """The features of a token's kinds of characters, size and changes between kinds."""
    kind = ("a" if lower else "") + ("A" if upper else "") + ("9" if digit else "") + ("s" if special else "")
    size = "1" if n < 4 else "4" if n < 8 else "8" if n < 12 else "12" if n < 18 else "18" if n < 28 else "28" if n < 48 else "48"
    turns = min(5, int(changes / n * 10))
    return "k" + kind, f"k{kind}l{size}", f"t{turns}", f"k{kind}t{turns}"


@lru_cache(_KEPT)
def _outline(cases: str) -> tuple[tuple[str, ...], int, int]:
    """:func:`_first` of an ASCII token's kinds of characters, and its digits and signs."""
    digit, special = cases.count("9"), cases.count("s")
    return _first(len(cases), "a" in cases, "A" in cases, digit, special, len(_RUNS.findall(cases)) - 1), digit, special


@lru_cache(_KEPT)
def _shape(token: str) -> tuple[str, ...]:
    """What a token looks like, whatever stands around it."""
    if len(token) == 1 and not token.isalnum():
        return ("d" + token,)
    if token.startswith("-----BEGIN") and "PRIVATE KEY" in token:
        return ("pem",)
    n = len(token)
    if token.isascii():
        first, digit, special = _outline(token.translate(_CASES))
    else:
        lower, upper, digit = any(c.islower() for c in token), any(c.isupper() for c in token), sum(c.isdigit() for c in token)
        special = sum(not c.isalnum() for c in token)
        first = _first(n, lower, upper, digit, special, sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(token, token[1:], strict=False)))
    out = [*first]
    if n >= 16 and _HEX.fullmatch(token):
        out += ["hex", f"hex{n}"]
    if n == 36 and _UUID.fullmatch(token):
        out.append("uuid")
    if token[:2] in _KNOWN_STARTS and _KNOWN.match(token):
        out.append("known")
    if _PLACEHOLDER.search(token.lower()):
        out.append("placeholder")
    if token[0] in "*xX.•#-_" and set(token) <= set("*xX.•#-_"):
        out.append("masked")
    if token[0] in "$%" or "${" in token or "%(" in token:
        out.append("variable")
    if token.startswith("sha") and re.match(r"sha\d+-", token):
        out.append("integrity")
    if (token.isidentifier() if "." not in token else _DOTTED.fullmatch(token)) and (token[0].isascii() and (not digit or _NUMBERED.fullmatch(token))):
        out.append("identifier")
    if "/" in token and special >= 2 and not digit:
        out.append("path")
    return tuple(out)


def _parts(name: str) -> list[str]:
    """The parts of a name in lower case, cut at changes of case and between letters and digits of any script."""
    if name.isalpha() and name.islower():
        return [name]
    cases = name.translate(_CASES) if name.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else "s" for c in name)
    return [name[m.start() : m.end()].lower() for m in _PARTS.finditer(cases)]


@lru_cache(_KEPT)
def _name_kinds(name: str) -> tuple[str, ...]:
    """The kinds of a name's parts; the last part's kind also on its own."""
    name = unicodedata.normalize("NFC", name)
    parts = _parts(name)
    kinds = [k for p in parts if (k := _KIND.get(p))]
    if name.lower() in _KIND:
        kinds.append(_KIND[name.lower()])
    if "keykind" in kinds and kinds[-1] == "key" or ("key" in kinds and "keykind" in kinds):
        kinds.append("seckey")
    last = _KIND.get(parts[-1], "other") if parts else "none"
    return (*(f"n{k}" for k in sorted(set(kinds))), "last" + last)


def features(tokens: list[str]) -> list[list[str]]:
    """The features of each token of a line."""
    out = []
    key, url, data, dash_u, quoted = "", False, False, 0, ""
    previous_word = ""
    for i, token in enumerate(tokens):
        shape = _shape(token)
        before, after = tokens[i - 1] if i else "^", tokens[i + 1] if i + 1 < len(tokens) else "$"
        word = shape[0][0] != "d" or shape == ("pem",)
        f = ["b", *shape]
        if word:
            kinds = _name_kinds(key) if key else ("nokey",)
            b = before if len(before) == 1 and not before.isalnum() else "w"
            a = after if len(after) == 1 and not after.isalnum() else "w"
            f += [f"{k}" for k in kinds]
            f += [f"{k}|{s}" for k in kinds for s in shape[:2]]
            f += [f"{k}|{s}" for k in kinds for s in shape[4:]]
            f += ["<" + b, ">" + a, f"<{b}>{a}", "q" if quoted else "nq"]
            f += ["call"] if a == "(" else []
            f += ["pw:" + k for k in _name_kinds(previous_word)] if b == "w" else []
            f += [f"pw:{previous_word.lower()}"] if previous_word.lower() in _BEFORE else []
            f += ["url"] if url else []
            f += ["urlcred"] if url and b == ":" and a == "@" else []
            f += ["data"] if data else []
            f += ["dashu"] if dash_u and b == ":" else []
            f += ["alone"] if len(tokens) == 1 else []
        out.append(f)
        if token in "=:" and previous_word:
            key = previous_word
        elif token in ";,{" :
            key = key if token == "{" else ""
        if token == ":" and after.startswith("//"):
            url, key = True, ""
        elif word and token.lower().startswith("data") and after == ":":
            data = True
        if token in "\"'`":
            quoted = "" if quoted == token else quoted or token
            if not quoted:
                url = False
        dash_u = 4 if token == "-u" else max(0, dash_u - 1)
        if word:
            previous_word = token
    return out


class Field:
    """A linear-chain conditional random field with labels outside, first and further."""

    def __init__(self) -> None:
        self.weight: dict[str, list[float]] = {}
        self.step = [[0.0] * 3 for _ in range(3)]
        self.step[0][2] = -1e6  # a credential cannot go on before it begins
        self.sums: dict[object, list[float]] = {}
        self.numbers: dict[tuple[str, ...], int] = {}

    def _number(self, features: tuple[str, ...]) -> int:
        return self.numbers.setdefault(features, len(self.numbers))

    def _rows(self, kinds: np.ndarray, features: Callable[[int], Iterable[str]]) -> np.ndarray:
        """The sums of weights for an array of kinds; ``features`` gives those of the kind at a position. A kind's sums are kept."""
        every, first, at = np.unique(kinds, return_index=True, return_inverse=True)
        if len(self.sums) > 8 * _KEPT:
            self.sums.clear()
        rows = []
        for kind, i in zip(every.tolist(), first.tolist(), strict=True):
            if (row := self.sums.get(kind)) is None:
                w = [self.weight[f] for f in features(i) if f in self.weight]
                row = self.sums[kind] = [sum(x[y] for x in w) for y in range(3)]
            rows.append(row)
        return np.array(rows, np.float64).reshape(-1, 3)[at]

    def labels(self, lines: list[list[str]]) -> list[list[int] | None]:
        """What :meth:`viterbi` gives for :func:`features` of each line, of a trained field, None for a line without a credential.

        All lines at once: what is known at a token of the words and marks
        before it is found with running maxima, features are summed by groups,
        and the best path is looked for where a token could gain by a label.
        """
        flat = [t for line in lines for t in line]
        if not flat:
            return [None] * len(lines)
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(t, len(number)) for t in flat])
        words = list(number)
        shapes = [_shape(t) for t in words]
        sign = np.array([ord(t) if len(t) == 1 and not t.isalnum() else ord("w") for t in words])
        plain = np.array([s[0][0] != "d" or s == ("pem",) for s in shapes])
        kind = np.array([self._number(s) for s in shapes])
        special = np.array([_BEFORE_AT.get(t.lower(), 0) if len(t) < 9 else 0 for t in words])
        mark = lambda test: np.array([test(t) for t in words])[ids]
        size = np.array([len(line) for line in lines])
        line, n = np.repeat(np.arange(len(lines)), size), len(ids)
        start = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(n)
        first, last = place == start, np.append(line[1:] != line[:-1], True)
        char, word = sign[ids], plain[ids]
        before, after = np.where(first, ord("^"), np.roll(char, 1)), np.where(last, ord("$"), np.roll(char, -1))

        def latest(there: np.ndarray) -> np.ndarray:
            """The last place before each one in its line where something is, or -1."""
            seen = np.maximum.accumulate(np.where(there, place, -1))
            seen = np.append(-1, seen[:-1])
            return np.where(seen >= start, seen, -1)

        previous = latest(word)
        link = (char == ord(":")) & ~last & np.roll(mark(lambda t: t.startswith("//")), -1)
        names = ((char == ord("=")) | (char == ord(":"))) & (previous >= 0) & ~link
        set_at = latest(names | link | (char == ord(";")) | (char == ord(",")))
        keyed = (set_at >= 0) & names[set_at]
        key = np.where(keyed, ids[previous[set_at]], -1)
        beside = np.where(word & (before == ord("w")) & (previous >= 0), ids[previous], -1)
        named = np.full(len(words) + 1, self._number(("nokey",)))
        for i in np.union1d(key[word], beside).tolist():
            if i >= 0:
                named[i] = self._number(_name_kinds(words[i]))
        opens, closes = np.zeros(n, np.int64), np.zeros(n, bool)
        held, own = "", -1
        for i in np.flatnonzero((char == 34) | (char == 39) | (char == 96)).tolist():
            if line[i] != own:
                held, own = "", line[i]
            if held == flat[i]:
                held, opens[i], closes[i] = "", -1, True
            elif not held:
                held, opens[i] = flat[i], 1
        inside = np.cumsum(opens) - opens
        quoted = inside - inside[start] > 0
        url = latest(link | closes)
        url = (url >= 0) & link[url]
        data = latest(word & (after == ord(":")) & ~last & mark(lambda t: t[:4].lower() == "data")) >= 0
        dash = latest(mark(lambda t: t == "-u"))
        dash_u = (dash >= 0) & (place - dash <= 4)

        scores = np.zeros((n, 3))
        w = np.flatnonzero(word)
        of = lambda i: _name_kinds(words[key[w[i]]]) if keyed[w[i]] else ("nokey",)
        shape = lambda i: shapes[ids[w[i]]]
        text = lambda array, i: chr(int(array[w[i]]))
        scores[w] = self._rows((kind[ids[w]] << 24) + (named[key[w]] << 3) + 1, lambda i: ["b", *shape(i), *of(i), *(f"{k}|{s}" for k in of(i) for s in shape(i)[:2] + shape(i)[4:])])
        scores[w] += self._rows((((before[w] << 21) + after[w]) * 2 + quoted[w] << 3) + 2, lambda i: ["<" + text(before, i), ">" + text(after, i), f"<{text(before, i)}>{text(after, i)}", "q" if quoted[w[i]] else "nq", *(["call"] if text(after, i) == "(" else [])])
        mine = np.where(previous[w] >= 0, special[ids[previous[w]]], 0)
        near = np.where(beside[w] >= 0, named[beside[w]] + 1, 0)
        scores[w] += self._rows((((near << 8) + mine) << 3) + 3, lambda i: [*("pw:" + k for k in (_name_kinds(words[beside[w[i]]]) if near[i] else ())), *(["pw:" + _BEFORE[mine[i] - 1]] if mine[i] else [])])
        at = lambda c: np.where(word, before == ord(c), False)
        alone = (size == 1)[line]
        flags = np.stack([url, url & at(":") & (after == ord("@")), data, dash_u & at(":"), alone], 1)[w]
        scores[w] += self._rows((flags @ (1 << np.arange(5)) << 3) + 4, lambda i: [f for f, on in zip(("url", "urlcred", "data", "dashu", "alone"), flags[i], strict=True) if on])
        m = np.flatnonzero(~word)
        scores[m] = self._rows((kind[ids[m]] << 3) + 5, lambda i: ["b", *shapes[ids[m[i]]]])

        step = self.step
        most = max(0.0, *(step[x][y] for x in range(3) for y in (1, 2))) - min(0.0, step[0][0]) + max(0.0, step[1][0] - step[0][0], step[2][0] - step[0][0])
        gain = np.bincount(line, scores[:, 1:].max(axis=1) - scores[:, 0] + most >= 0, len(lines)) > 0
        scores[first, 2] = -1e6
        out: list[list[int] | None] = [None] * len(lines)
        begin = np.cumsum(size) - size
        for i in np.flatnonzero(gain & (size > _WIDE)).tolist():
            found = self._best(scores[begin[i] : begin[i] + size[i]].tolist())
            out[i] = found if any(found) else None
        some = np.flatnonzero(gain & (size <= _WIDE))
        some = some[np.argsort(-size[some], kind="stable")]
        if len(some):
            long, moves = size[some], np.array(step)
            best, came = scores[begin[some]], []
            for t in range(1, int(long[0])):
                on = int(np.searchsorted(-long, -t, "left"))
                v = best[:on, :, None] + moves
                came.append(v.argmax(axis=1))
                best[:on] = v.max(axis=1) + scores[begin[some[:on]] + t]
            y = best.argmax(axis=1)
            path = np.zeros((len(some), int(long[0])), np.int8)
            for t in range(int(long[0]) - 1, -1, -1):
                on = int(np.searchsorted(-long, -t, "left"))
                path[:on, t] = y[:on]
                if t:
                    y[:on] = came[t - 1][np.arange(on), y[:on]]
            for i in np.flatnonzero(path.any(axis=1)).tolist():
                out[some[i]] = path[i, : long[i]].tolist()
        return out

    def scores(self, rows: list[list[str]]) -> list[list[float]]:
        weight, out = self.weight, []
        for row in rows:
            a = b = c = 0.0
            for f in row:
                if (w := weight.get(f)) is not None:
                    a, b, c = a + w[0], b + w[1], c + w[2]
            out.append([a, b, c])
        out[0][2] = -1e6
        return out

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels."""
        return self._best(self.scores(rows))

    def _best(self, scores: list[list[float]]) -> list[int]:
        step = self.step
        best, back = scores[0], []
        for s in scores[1:]:
            came, now = [], []
            for y in range(3):
                v = [best[x] + step[x][y] for x in range(3)]
                x = 0 if v[0] >= v[1] and v[0] >= v[2] else 1 if v[1] >= v[2] else 2
                came.append(x)
                now.append(v[x] + s[y])
            back.append(came)
            best = now
        y = max(range(3), key=best.__getitem__)
        path = [y]
        for came in reversed(back):
            path.append(y := came[y])
        return path[::-1]

    def learn(self, rows: list[list[str]], gold: list[int], rate: float) -> None:
        """One step up the likelihood's gradient (forward and backward sums)."""
        scores, step, n = self.scores(rows), self.step, len(rows)
        lse = lambda v: (m := max(v)) + math.log(sum(math.exp(x - m) for x in v))
        ahead = [scores[0]]
        for s in scores[1:]:
            ahead.append([s[y] + lse([ahead[-1][x] + step[x][y] for x in range(3)]) for y in range(3)])
        behind = [[0.0] * 3]
        for s in reversed(scores[1:]):
            behind.append([lse([step[x][y] + s[y] + behind[-1][y] for y in range(3)]) for x in range(3)])
        behind.reverse()
        total = lse(ahead[-1])
        for i, row in enumerate(rows):
            g = [rate * ((gold[i] == y) - math.exp(min(0.0, ahead[i][y] + behind[i][y] - total))) for y in range(3)]
            if max(map(abs, g)) > 1e-4 * rate:
                for f in row:
                    w = self.weight.setdefault(f, [0.0, 0.0, 0.0])
                    for y in range(3):
                        w[y] += g[y] - rate * 2e-4 * w[y]
            if i + 1 < n:
                for x in range(3):
                    for y in range(3):
                        if (x, y) != (0, 2):
                            p = math.exp(min(0.0, ahead[i][x] + step[x][y] + scores[i + 1][y] + behind[i + 1][y] - total))
                            self.step[x][y] += rate * ((gold[i] == x and gold[i + 1] == y) - p)


_NOUNS = "order cache region ledger worker meter badge portal batch signal folder vault quota branch report payment user admin mail queue node proxy".split()
#: Other names of passwords in the made-up lines.
_PASSWORDS = "passcode pin passwort kennwort contraseña contrasena clave senha motdepasse wachtwoord parola heslo пароль 密码".split()
#: Words that name something harmless where they come last, and may stand before the name of a secret.
_OTHERS = "trace label page link version count color image request status title public host".split()
_VERBS = "load send merge apply fetch rotate close render".split()


def made_up(rng: random.Random) -> list[tuple[str, bool]]:
    """One line as (text, is a credential) pieces."""
    pick = rng.choice
    chars = lambda alphabet, a, b: "".join(rng.choices(alphabet, k=rng.randint(a, b)))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = lower + lower.upper() + digits

    def name(*tail: str) -> str:
        words = [pick(_NOUNS), *tail] if rng.random() < 0.8 else list(tail)
        style = rng.random()
        if style < 0.4:
            return "_".join(words)
        if style < 0.75:
            return words[0] + "".join(w.title() for w in words[1:])
        return "_".join(words).upper() if style < 0.92 else "-".join(words)

    def password() -> str:
        kind = rng.random()
        if kind < 0.5:
            return pick(_NOUNS).title() + pick("!-_.#%&*+$") + pick(_NOUNS)[: rng.randint(3, 7)] + chars(digits, 2, 4) + pick(["", "", "!", "?"])
        return chars(alnum + "!#%*$-_", 8, 20) if kind < 0.85 else chars(lower + lower.upper(), 10, 18) if kind < 0.9 else pick(_NOUNS) + chars(digits, 2, 4)

    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    base64 = lambda a, b: chars(alnum + "+/", a, b) + pick(["", "=", "=="])
    random_key = lambda: chars(alnum, 20, 44) if rng.random() < 0.7 else chars(alnum + "-_.~", 24, 44)
    known = lambda: pick([lambda: "AKIA" + chars(digits + lower.upper(), 16, 16), lambda: pick(["ghp_", "gho_", "ghs_"]) + chars(alnum, 36, 36), lambda: pick(["sk_live_", "rk_live_"]) + chars(alnum, 24, 24), lambda: pick(["xoxb-", "xoxp-"]) + chars(digits, 11, 11) + "-" + chars(digits, 11, 11) + "-" + chars(alnum, 24, 24), lambda: "eyJ" + chars(alnum, 30, 36) + ".eyJ" + chars(alnum, 20, 40) + "." + chars(alnum + "-_", 40, 44), lambda: "AIza" + chars(alnum + "-_", 35, 35), lambda: "glpat-" + chars(alnum, 20, 20)])()
    phrase = lambda: pick("- . _".split()).join(pick(_NOUNS) + (chars(digits, 2, 2) if i == 2 else "") for i in range(rng.randint(4, 6)))
    uuid = lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    host = lambda: f"{pick(_NOUNS)}-{rng.randint(1, 40)}.{pick(_NOUNS)}{pick(_NOUNS)}.{pick(['internal', 'test', 'example', 'invalid', 'com'])}"
    pw_name = lambda: name(pick(["password", "passwd", "pwd", "pass"] if rng.random() < 0.7 else _PASSWORDS)) if rng.random() < 0.8 else pick(["password", "passwd", "pwd"])
    sec_name = lambda: name(pick(_OTHERS), pick(["token", "secret", "password"])) if rng.random() < 0.25 else name(*pick([["token"], ["secret"], ["api", "key"], ["client", "secret"], ["access", "key"], ["access", "token"], ["auth", "token"], ["secret", "access", "key"], ["signing", "key"], ["private", "key"], ["session"], ["session", "id"], ["auth"], ["cookie"], ["credential"], ["billing", "key"], ["hook"], ["access", "key", "id"], ["encryption", "key"]]))
    plain_name = lambda: name(pick(_NOUNS))
    not_name = lambda: name(*pick([["checksum"], ["digest"], ["commit"], ["hash"], ["trace", "id"], ["integrity"], ["icon"], ["revision"], ["id"], ["uuid"], ["sha256"], ["etag"], ["version"], ["fingerprint"], ["public", "key"], ["request", "id"], ["client", "id"], ["account", "id"]]))

    def assign(key: str, value: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
        q, style = pick("\"\"\"'"), rng.random()
        if style < 0.52:
            return [(pick(["", "", "const ", "let ", "var ", "val ", "  ", "self."]) + key + pick([" = ", " = ", "=", " := "]) + q, False), *value, (q + pick(["", ";", ""]), False)]
        if style < 0.66:
            return [(f"{pick(['', '  '])}{q}{key}{q}: {q}", False), *value, (q + pick(["", ","]), False)]
        if style < 0.8:
            return [(f"{pick(['', '  '])}{key}: {q}", False), *value, (q, False)]
        if style < 0.93:
            return [(pick(["# ", "// ", "", "RUN "]) + pick(["export ", "export ", ""]) + key + "=", False), *value]
        return [(f"{pick(['set', 'configure', 'use'])}({q}{key}{q}, {q}", False), *value, (q + ")", False)]

    def word() -> str:
        w = "".join(pick("bcdfghklmnprstvzßñçšж") + pick("aeiouäéíóöúüàèи") + pick(["", "", "n", "r", "st", "l"]) for _ in range(rng.randint(1, 4)))
        w = pick([w, w, w.title(), pick(_NOUNS)])
        return pick([w, w, w, w, f"{w}-{w.title()}", f"{w}_{pick(_NOUNS)}", f"{w}-{pick(_NOUNS)}", f"({w})", f"`{w}_{pick(_NOUNS)}`", f"\"{w}\"", f"{w}/{pick(_NOUNS)}", f"{w}'{pick('slt')}"])

    def sentence() -> str:
        """Prose of no language in particular."""
        words = [word() if rng.random() < 0.85 else pick([str(rng.randint(0, 4000)), f"{rng.randint(0, 40)}.{rng.randint(0, 40)}"]) for _ in range(rng.randint(3, 14))]
        words = [w + pick([",", ":", ";"]) if rng.random() < 0.08 else w for w in words]
        return pick(["¿", "¡", "«", "", "", "", "", ""]) + " ".join(words) + pick([".", ".", ".", "?", "!", "…", "»", ":", ""])

    kind = rng.random()
    if rng.random() < 0.15:
        return [(pick(["", "", "", "# ", "// ", "* ", "- ", "/** ", "\"\"\"", "\'\'\'"]) + " ".join(sentence() for _ in range(rng.randint(1, 3))) + pick(["", "", " */"]), False)]
    if kind < 0.09:
        return assign(pw_name(), [(password(), True)])
    if kind < 0.16:
        return assign(sec_name(), [(pick([random_key, random_key, known, lambda: hexes(pick([32, 40, 40, 64])), lambda: base64(24, 44)])(), True)])
    if kind < 0.20:
        return assign(pick([sec_name, plain_name, plain_name])(), [(known(), True)])
    if kind < 0.23:
        return assign(name("pass", "phrase") if rng.random() < 0.5 else name("passphrase"), [(phrase(), True)])
    if kind < 0.28:
        return assign(name(pick(["auth", "header", "authorization", "credential"])), [(pick(["Authorization: ", ""]) + pick(["Basic ", "Bearer "]), False), (pick([lambda: base64(16, 40), random_key, random_key])(), True)])
    if kind < 0.33:
        return assign(name(pick(["dsn", "url", "connection", "database"])), [(f"{pick(['Server', 'Host', 'Data Source'])}={host()};{pick(['Uid', 'User Id', 'User'])}={pick(_NOUNS)};{pick(['Pwd', 'Password'])}=", False), (chars(alnum + "!#%*", 10, 16) if rng.random() < 0.7 else password(), True), (pick(["", "", ";"]), False)])
    if kind < 0.39:
        value = [(f"{pick(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb'])}://{pick(_NOUNS)}:", False), (pick([password, random_key])(), True), (f"@{host()}{pick(['/', ':5432/', ''])}{pick(_NOUNS)}", False)]
        return assign(name(pick(["url", "uri", "dsn", "remote"])), value) if rng.random() < 0.7 else [(pick(["# git clone ", "// see ", "psql ", "# "]), False), *value]
    if kind < 0.43:
        return [(f"{pick(['# ', '// ', ''])}curl -u {pick(_NOUNS)}:", False), (password(), True), (f" https://{host()}/{pick(_NOUNS)}", False)]
    if kind < 0.47:
        return [(f"{pick(['# ', '// ', '* '])}{pick(['login', 'user', 'account'])} {pick(_NOUNS)} {pick(['pwd', 'password', 'pass'])} ", False), (password(), True), (f" on {host()}", False)]
    if kind < 0.49:
        block = (f"-----BEGIN {pick(['', 'RSA ', 'EC '])}PRIVATE KEY-----\\n{base64(40, 80)}\\n", True)
        if rng.random() < 0.4:
            return assign(name(pick(["signing", "private"]), "key"), [block])
        alone = [(pick(["", "  ", "# ", "// ", "`", "x = `"]), False), block]
        return alone if rng.random() < 0.6 else [*alone, (pick([" ", "` ", "\", ", "; "]), False), *(assign(pw_name(), [(password(), True)]) if rng.random() < 0.6 else [block, (pick(["", " ", "\"}"]), False)])]
    if kind < 0.51:
        return [(f"{pick(['  ', ''])}{pick(['--password ', '--token ', 'X-Api-Key: ', '-p ', 'sshpass -p '])}", False), (password() if rng.random() < 0.5 else random_key(), True)]
    # No credentials from here on.
    if kind < 0.58:
        return [(t, False) for t, _ in assign(pick([pw_name, sec_name])(), [(pick(["YOUR_API_KEY", "********", "<redacted>", "changeme", "xxxxxxxx", "${" + name("token").upper() + "}", "<your-token>", "your_password_here", "...", "", "{{ secret }}", "$PASSWORD", "placeholder", "REPLACE_ME", "example-token", "None"]), False)])]
    if kind < 0.63:
        n = pick([pw_name, sec_name])()
        return [(pick([f"{n} = {pick(['read_env', 'getenv', 'os.environ.get', 'vault.read', 'System.getenv', 'config.fetch'])}(\"{name('token').upper()}\");", f"{n} = {pick(_VERBS)}_{pick(_NOUNS)}({pick(_NOUNS)}, {rng.randint(1, 9999)})", f"const {n} = {pick(_VERBS)}{pick(_NOUNS).title()}({pick(_NOUNS)}, \"{pick(_NOUNS)} {pick(_NOUNS)}\");", f"{n} = {name(pick(_NOUNS))}", f"{n}: {pick(_NOUNS).title()}{pick(_NOUNS).title()}", f"  {n} {pick(_NOUNS).title()}{pick(_NOUNS).title()}", f"  {n} {pick([str(rng.randint(1, 9999)), pick(_NOUNS), name(pick(_NOUNS))])}", f"if ({n}.{pick(_NOUNS)} == {rng.randint(1, 999)}) {{", f"# the {pick(['token', 'password', 'key'])} is read from the {pick(_NOUNS)}, never from {name(pick(_NOUNS))}", f"{pick(_VERBS)}_{n}({pick(_NOUNS)}, \"{pick(_NOUNS)} {pick(_VERBS)}\");", f"{n}: {rng.randint(1, 9999)}", f"def {pick(_VERBS)}_{pick(_NOUNS)}(self, {n}, {name(pick(_NOUNS))}):"]), False)]
    if kind < 0.67:
        n = name(pick(["password", "token", "api_key", "secret"]), pick(["label", "hint", "title", "name", "length", "field"]))
        return [(t, False) for t, _ in assign(n, [(pick(["Enter the password again", "Your token", "Forgot password?", "API key", "Secret word", pick(_NOUNS)]), False)])]
    if kind < 0.80:
        value = pick([lambda: hexes(40), lambda: hexes(64), uuid, lambda: "sha512-" + base64(80, 88), lambda: "data:image/png;base64," + base64(60, 120), lambda: hexes(32), lambda: f"{rng.randint(1, 30)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", lambda: "sha256:" + hexes(64), lambda: "ssh-rsa " + base64(60, 100)])()
        return [(t, False) for t, _ in assign(not_name(), [(value, False)])]
    if kind < 0.84:
        return [(t, False) for t, _ in assign(name(pick(["url", "link", "href", "page"])), [(f"https://{host()}/{pick(_NOUNS)}?{pick(['page', 'id', 'key'])}={rng.randint(1, 99)}", False)])]
    if kind < 0.88:
        return [(pick([base64(60, 64), base64(100, 160), "-----BEGIN PUBLIC KEY-----", "-----END PUBLIC KEY-----", pick(["", "# ", "// ", "-- ", "/* ", " * "]) + pick("=-*#~_+") * rng.randint(4, 70), f"\"{hexes(40)}\",", base64(20, 40)]), False)]
    if kind < 0.92:
        return [(t, False) for t, _ in assign(plain_name(), [(pick([" ".join(rng.choices(_NOUNS, k=rng.randint(1, 3))), chars(alnum, 20, 40) if rng.random() < 0.2 else pick(_NOUNS), f"{pick(_NOUNS)}-{pick(_NOUNS)}-{rng.randint(1, 99)}"]), False)])]
    return [(pick([f"{name(pick(_NOUNS))} = {pick(_VERBS)}_{pick(_NOUNS)}({name(pick(_NOUNS))}, {rng.randint(1, 9999)});", f"logger.info(\"{pick(_VERBS)} {pick(_NOUNS)} {pick(_NOUNS)}\", {name(pick(['session', 'key', 'token']))})", f"for (const {pick(_NOUNS)} of {pick(_VERBS)}{pick(_NOUNS).title()}({name(pick(_NOUNS))})) {{", f"// Version {rng.randint(1, 40)}.{rng.randint(1, 40)}.{rng.randint(1, 40)} lets the {pick(_NOUNS)} {pick(_VERBS)} {rng.randint(1, 4000)} {pick(_NOUNS)}s", f"\"{name(pick(_NOUNS))}\": \"{pick(_NOUNS)} {pick(_NOUNS)}\",", f"{name(pick(_NOUNS))}: {rng.randint(1, 9999)}", f"key = {name(pick(_NOUNS))}[{pick(_NOUNS)}]", f"{pick(_VERBS)}{pick(_NOUNS).title()}{pick(_NOUNS).title()}{pick(_NOUNS).title()}({pick(_NOUNS)}{rng.randint(1, 9)});"]), False)]


def lexed(line: str, blocks: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(begin, end) of a line's tokens, the given key blocks being one each."""
    if not blocks:
        return [m.span() for m in _LEX.finditer(line)]
    out, at = [], 0
    for begin, end in blocks:
        out += [(m.start() + at, m.end() + at) for m in _LEX.finditer(line[at:begin])] + [(begin, end)]
        at = end
    return out + [(m.start() + at, m.end() + at) for m in _LEX.finditer(line[at:])]


def _labelled(pieces: list[tuple[str, bool]]) -> tuple[list[str], list[int]]:
    line, spans, at = "".join(p for p, _ in pieces), [], 0
    for text, secret in pieces:
        if secret:
            spans.append((at, at + len(text)))
        at += len(text)
    tokens, gold = [], []
    for a, b in lexed(line):
        inside = any(a < e and b > s for s, e in spans)
        tokens.append(line[a:b])
        gold.append(0 if not inside else 2 if gold and gold[-1] else 1)
    return tokens, gold


@cache
def trained(lines: int = LINES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """The field, trained on made-up lines."""
    rng, field = random.Random(seed), Field()
    data = [(features(tokens), gold) for tokens, gold in (_labelled(made_up(rng)) for _ in range(lines)) if tokens]
    for epoch in range(epochs):
        rng.shuffle(data)
        for rows, gold in data:
            field.learn(rows, gold, 0.15 / (1 + epoch))
    return field


def accuracy(field: Field, lines: int = 600, seed: int = 99) -> float:
    """The share of other made-up lines in which :func:`spans_of` finds just the credentials."""
    rng, right = random.Random(seed), 0
    for _ in range(lines):
        pieces = made_up(rng)
        line = "".join(p for p, _ in pieces)
        _, gold = _labelled(pieces)
        inside = [(a, b) for (a, b), y in zip(lexed(line), gold, strict=True) if y]
        found = spans_of(line, field)
        right += [t for t in lexed(line) if any(t[0] < e and t[1] > s for s, e in found)] == inside
    return right / lines


def _parts_of(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, end, key blocks) of a text's lines; lines that a private-key block joins are one."""
    blocks = [m.span() for m in _PEM.finditer(text)] if "PRIVATE KEY" in text else []
    at, size = 0, len(text)
    while at <= size:
        end, own = text.find("\n", at), []
        end = size if end < 0 else end
        while blocks and blocks[0][0] < end:
            own.append(blocks.pop(0))
            if own[-1][1] > end:
                end = text.find("\n", own[-1][1])
                end = size if end < 0 else end
        yield at, end, own
        at = end + 1


def spans_of_all(texts: list[str], field: Field, known: dict[str, list[tuple[int, int]]] | None = None) -> list[list[tuple[int, int]]]:
    """(begin, end) of every literal credential of each text, in order; a private-key block is one token of its line. ``known`` keeps what plain lines hold."""
    known = {} if known is None or len(known) > 8 * _KEPT else known
    parts, blocked, rows, tokens = [], {}, [], []
    for number, text in enumerate(texts):
        if "PRIVATE KEY" not in text:
            parts.append(None)
            for line in text.split("\n"):
                if line not in known and _LONG.search(line):
                    known[line] = []
                    rows.append((line, ()))
                    tokens.append(_LEX.findall(line))
            continue
        parts.append(list(_parts_of(text)))
        for at, end, blocks in parts[-1]:
            blocked[number, at] = len(rows)
            line, blocks = text[at:end], [(a - at, b - at) for a, b in blocks]
            rows.append((line, blocks))
            tokens.append([line[a:b] for a, b in lexed(line, blocks)])
    found: list[list[tuple[int, int]]] = []
    for (line, blocks), labels in zip(rows, field.labels(tokens), strict=True):
        own: list[tuple[int, int]] = []
        for (a, b), y in zip(lexed(line, blocks), labels, strict=True) if labels else ():
            if y == 2 and own and not line.startswith("-----BEGIN", a):
                own[-1] = (own[-1][0], b)
            elif y:
                own.append((a, b))
        found.append(own)
        if own and line in known:
            known[line] = own
    out = []
    for number, text in enumerate(texts):
        spans, at = [], 0
        if parts[number] is None:
            for line in text.split("\n"):
                if own := known.get(line):
                    spans += [(at + a, at + b) for a, b in own]
                at += len(line) + 1
        else:
            for at, _, _ in parts[number]:
                spans += [(at + a, at + b) for a, b in found[blocked[number, at]]]
        out.append(spans)
    return out


def spans_of(text: str, field: Field) -> list[tuple[int, int]]:
    """:func:`spans_of_all` of one text."""
    return spans_of_all([text], field)[0]


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced by :data:`MASK` and nothing else changed."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def credentials(records: DataFrame, key: str | list[str] = "id", text: str = "content") -> DataFrame:
    """(``key``, lines, redacted) of every record with a literal credential: the lines on which one begins (from 1, split at \\n) and the text with all of them masked.

    Of several deliveries of a key the latest counts. Null and empty texts and texts without a credential give no row.

    Each distinct text is labelled once: texts are grouped by 128 bits of hash,
    with partial grouping before the shuffle, and only keys and hashes are
    compared for the latest deliveries.
    """
    keys = [key] if isinstance(key, str) else key
    field = records.sparkSession.sparkContext.broadcast(trained())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, int]]] = {}
        for batch in batches:
            values, begin, held = batch.column(1).to_pylist(), 0, 0
            for i, value in enumerate(values):
                held += len(value or "")
                if held < _BATCH and i + 1 < len(values):
                    continue
                ids, lines, texts = [], [], []
                if len(known) > 8 * _KEPT:
                    known.clear()
                for k, spans in enumerate(spans_of_all([v or "" for v in values[begin : i + 1]], field.value, known), begin):
                    if spans:
                        ids.append(k)
                        lines.append(sorted({values[k].count("\n", 0, a) + 1 for a, _ in spans}))
                        texts.append(masked(values[k], spans))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(lines, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["_text", "lines", "redacted"])
                begin, held = i + 1, 0

    hashed = records.withColumn("_text", F.when(F.length(text) > 0, hash128(F.col(text))))
    distinct = hashed.filter("_text is not null").groupBy("_text").agg(F.first(text).alias("value"))
    found = distinct.mapInArrow(find, "_text struct<a:bigint,b:bigint>, lines array<bigint>, redacted string")
    return current(hashed, "_text", key=keys).join(found, "_text").select(*keys, "lines", "redacted")
