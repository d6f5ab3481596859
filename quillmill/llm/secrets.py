"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they don't name.

The CRF tags the tokens of a line as beginning, inside or outside of a secret.  Its features are a token's identity,
shape and texture (runs, parts, words in it), those of the three tokens before and of the one after it, and features of
the whole file: its size and its shares of signs, digits and key words of code.  It is trained on the driver, from files of prose, code and settings that
a seeded generator writes (TRAIN_LINES lines in all, a bounded sample that does not depend on the data; files of 10 to
some 10,000 tokens), by maximum likelihood; decoding is by Viterbi.  A line in which no tag but "outside" can win under
any transition is outside throughout; only the other lines need the dynamic programme, so the result is exactly Viterbi's.

Cases: a null or empty text has no spans; overlapping spans of different kinds all stay, but a span of the CRF that
overlaps a pattern's is dropped; repeated rows get equal results; an empty table gives an empty result; further columns
are not read by a scan and stay as they are in a redaction.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a whole run, as [0-9a-f]+ of 32 or more
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "crf")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"""[\w+/\-.]+|["'`]|[^\w\s+/\-."'`]+|\n""")
#: Feature slots of a role, roles (the token itself, 1 to 3 before, 1 after), training lines and steps.
SLOTS, ROLES, TRAIN_LINES, TRAIN_STEPS = 1 << 12, 5, 2000, 60
CACHE_TOKENS = 400_000


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) of the patterns' matches."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign", *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), "access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(*m.span(), "hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _shape(token: str) -> str:
    """The token's runs of digits, capitals, other letters and signs; of more than six runs their kinds and number."""
    out = []
    for c in token:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out) if len(out) <= 6 else "".join(sorted(set(out))) + str(len(out).bit_length())


def canonical(token: str) -> str:
    """Plain words of five letters or more stand for all words of their length and capitals; other tokens for themselves."""
    if token.isalpha() and len(token) > 4 and not _KEY.search(low := token.lower()):
        if token == low:
            return _LOWER[min(len(token), 24)]
        if token[1:] == low[1:]:
            return _TITLE[min(len(token), 24)]
    return token


_KEY = re.compile(r"password|passwd|pwd|secret|token|api_?key|auth|bearer|credential|private|access")
_LOWER, _TITLE = ["a" * n for n in range(25)], ["A" + "a" * (n - 1) for n in range(25)]


def _features(token: str) -> tuple[list[str], list[str]]:
    """(of the token itself, of it as a neighbour)."""
    low, n = token.lower(), len(token)
    digits = sum(c.isdigit() for c in token)
    plain = low.isalpha() and not digits
    entropy = 0.0
    if n >= 10 and not plain:
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(token).values())
    ascii_word = token.isascii() and any(c.isalnum() for c in token)
    mixed = (any("a" <= c <= "z" for c in token)) + any("A" <= c <= "Z" for c in token) + (digits > 0)
    key = bool(_KEY.search(low))
    kind = "key" if key else "op" if token[0] in "=:" else "quote" if token[0] in "\"'`" else "nl" if token == "\n" else "punct" if not any(c.isalnum() for c in token) else "num" if digits == n else "mix" if digits and mixed > 1 else "word"
    size = min(n, 12) if n < 13 else 16 if n < 20 else 24 if n < 32 else 32 if n < 64 else 64
    own = ["bias", f"id={low}" if n <= 4 or key and n < 24 else "id=", f"shape={_shape(token)}", f"len={size}", f"ent={int(entropy * 2)}", f"kind={kind}", f"dig={digits * 5 // n}", f"mix={mixed}{ascii_word}", f"hex={not low.strip('0123456789abcdef')}{n >= 16}", f"big={n >= 20 and ascii_word}{entropy > 3.2}{mixed}", f"dots={'.' in token}{'-' in token}{'/' in token}"]
    if n >= 8 and not plain:
        own += _texture(token)
    return own, [f"kind={kind}", f"id={low}" if n <= 4 or key and n < 24 else "id=", f"long={n >= 16}"]


_RUNS, _PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), re.compile(r"[^A-Za-z0-9]+")


def _texture(token: str) -> list[str]:
    """How random a long token looks: words and numbers make few long runs, a key many short ones in one long part."""
    runs, parts = _RUNS.findall(token), _PARTS.split(token)
    long = max(parts, key=len)
    inner = len(_RUNS.findall(long)) * 8 // max(len(long), 1)
    word = max((len(x) for x in runs if x.isalpha()), default=0)
    size = min(len(long) // 4, 10)
    one = len(parts) == 1
    out = [f"runs={len(runs) * 8 // len(token)}{one}", f"inner={inner}{size}", f"word={min(word, 8)}{one}", f"part={size}{one}", f"parts={min(len(parts), 6)}"]
    return out if one or not 0 < len(parts[0]) <= 6 else [*out, f"lead={parts[0].lower()}"]


def _slot(role: int, feature: str) -> int:
    return role * SLOTS + zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


def _token_slots(token: str) -> list[list[int]]:
    own, near = _features(token)
    return [[_slot(0, f) for f in own], *[[_slot(r, f) for f in near] for r in range(1, ROLES)]]


def file_features(tokens: list[str]) -> list[int]:
    """Slots of the file's features: its size, and how many of its tokens begin with a sign, with a digit, or are key words."""
    n = max(len(tokens), 1)
    first = Counter(t[0] for t in tokens)
    signs, digits = sum(first[c] for c in "=:\"'{}$<>"), sum(first[c] for c in "0123456789")
    keys = sum(1 for t in tokens if t in _FILE_KEYS)
    return [_slot(ROLES, f"{name}={_level(k, n)}") for name, k in (("signs", signs), ("digits", digits), ("keys", keys))] + [_slot(ROLES, f"size={min(8, int(math.log10(n) * 2))}")]


def _level(k: int, n: int) -> int:
    """0 for none, else 1 to 7 by powers of two of the share k / n: under 1 %, 2 %, 4 %, ..., 32 %, and over."""
    return 0 if not k else 1 + min(6, max(0, int(math.log2(100 * k / n)) + 1) if 100 * k >= n else 0)


_FILE_KEYS = frozenset("def class import return if else for while function const let var public static void true false null None self export set host port user".split())


class Crf:
    """Weights: one row of three labels (outside, begin, inside) for each slot, and transitions between labels."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights.astype(np.float64), transitions.astype(np.float64)
        self.transitions[0, 2] = -1e6  # inside can't follow outside
        t = self.transitions - self.transitions[0, 0]
        leave = np.maximum(0, t[1:, 0].max())
        #: More than a position can gain over "outside" beside its own score, under any transitions.
        self.most_begin = max(t[0, 1], t[1, 1], t[2, 1]) + leave
        self.most_inside = max(t[1, 2], t[2, 2]) + leave
        self._forget()

    def __reduce__(self):
        return Crf, (self.weights, self.transitions)

    def _forget(self):
        self.place: dict[str, int] = {}  # tokens and the rows of their scores; plain words share rows
        self.used = 0
        self.rows = np.zeros((1024, ROLES, 3))

    def _ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.place) > CACHE_TOKENS:
            self._forget()
        get, place = self.place.get, self.place
        out = [get(t, -1) for t in tokens]
        if -1 in out:
            for i, v in enumerate(out):
                if v < 0:
                    t = tokens[i]
                    k = place.get(t)
                    if k is None:
                        same = canonical(t)
                        k = place.get(same)
                        if k is None:
                            k = place[same] = self.used
                            self.used += 1
                            if k == len(self.rows):
                                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                            self.rows[k] = [self.weights[s].sum(axis=0) for s in _token_slots(same)]
                        if len(t) <= 256:
                            place[t] = k
                    out[i] = k
        return np.array(out, np.int64)

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Score of each label at each token; neighbours count across line ends."""
        ids = self._ids(tokens)
        part = self.rows[ids]
        e = part[:, 0].copy()
        for r in (1, 2, 3):
            e[r:] += part[:-r, r] if len(e) > r else 0
        e[:-1] += part[1:, 4]
        return e + self.weights[file_features(tokens)].sum(axis=0)

    def tag(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(first, last) token of each secret, line by line."""
        if not tokens:
            return []
        e = self.scores(tokens)
        gain_b, gain_i = e[:, 1] - e[:, 0] + self.most_begin, e[:, 2] - e[:, 0] + self.most_inside
        open_at = np.nonzero((gain_b > 0) | (gain_i > 0))[0]
        if not len(open_at):
            return []
        ends = [i for i, t in enumerate(tokens) if t == "\n"]
        out: list[tuple[int, int]] = []
        for line in np.unique(np.searchsorted(ends, open_at)):
            a, b = (ends[line - 1] + 1 if line else 0), (ends[line] if line < len(ends) else len(tokens))
            if b > a:
                out += [(a + x, a + y) for x, y in self._runs(self.viterbi(e[a:b]))]
        return out

    def viterbi(self, e: np.ndarray) -> list[int]:
        t = self.transitions.tolist()
        rows = e.tolist()
        now, back = [rows[0][0], rows[0][1], -1e9], []
        for row in rows[1:]:
            new, came = [], []
            for k in range(3):
                best = max(range(3), key=lambda j: now[j] + t[j][k])
                came.append(best)
                new.append(now[best] + t[best][k] + row[k])
            now = new
            back.append(came)
        k = max(range(3), key=lambda j: now[j])
        path = [k]
        for came in reversed(back):
            k = came[k]
            path.append(k)
        return path[::-1]

    @staticmethod
    def _runs(path: list[int]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for i, k in enumerate(path):
            if k == 1:
                out.append([i, i])
            elif k == 2 and out and out[-1][1] == i - 1:
                out[-1][1] = i
        return [(a, b) for a, b in out]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code-point spans of the secrets in a text."""
        tokens = TOKEN.findall(text)
        found = self.tag(tokens)
        if not found:
            return []
        at = [m.span() for m in TOKEN.finditer(text)]
        return [(at[a][0], at[b][1]) for a, b in found]


#: Words of the paths, names and addresses that are no secrets.
REAL = (
    "account array async backend base batch bin block buffer build cache class client cloud config context core count data device docs driver editor element engine error event example export factory file filter "
    "font form frame group handle home image index input item java kernel layer left library linux list local log main manager map media member message model module name network node object option order output "
    "package page parent path plugin pool process project proxy python query reader record region release render report request result root route row runtime sample schema scope script search server service "
    "session share site size source spark stage state static status storage stream string style system table target task template test text theme thread time tools type update user util value vector version view web widget window worker"
).split()


def training_lines(n: int = TRAIN_LINES, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Lines as (text, secret?) parts."""
    r = random.Random(seed)
    syllables = ["the", "an", "er", "in", "tion", "ou", "le", "ed", "st", "th", "ber", "sch", "lich", "eau", "éle", "ción", "ado", "ñe", "re", "wh"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    secret = [
        lambda: some(hexa, 32, 64), lambda: some(low + up + dig, 20, 44), lambda: some(low + up + dig + "+/", 32, 64) + "=" * r.randint(0, 2),
        lambda: "AKIA" + some(up + dig, 16, 16), lambda: r.choice(["ghp_", "sk-", "xoxb-", "pk_live_", "glpat-"]) + some(low + up + dig, 20, 40),
        lambda: "eyJ" + some(low + up + dig, 20, 40) + "." + some(low + up + dig + "-_", 30, 60), lambda: some(low + up + dig + "_.-", 10, 18),
    ]
    keys = ["token", "password", "passwd", "secret", "api_key", "apiKey", "API_KEY", "client_secret", "auth_token", "AWS_SECRET_ACCESS_KEY", "db_pwd", "credential", "private_key"]
    prose = lambda a=2, b=12: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(a, b)))
    junk = lambda: r.choice(["", "", "", "###", "%%%", "&&&", "***", "$$$"])
    harmless = [
        lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: f"({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        lambda: some(dig, 12, 19), lambda: f"https://{word()}.example.org/{word()}/{some(low + dig, 4, 10)}", lambda: some(hexa, 7, 10), lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: "-".join([some(hexa, 8, 8), some(hexa, 4, 4), some(hexa, 4, 4), some(hexa, 12, 12)]), lambda: word() + "-" + word() + "_" + word(), lambda: (word() + word() + word() + word()).capitalize(),
        lambda: f"{r.choice(['name', 'id', 'page', 'count', 'lang', 'class'])} = \"{word()}\"", lambda: f"{r.choice(['token', 'password', 'secret'])} {r.choice(['of', 'is', 'was', 'the'])} {word()}", lambda: " | ".join(word() for _ in range(4)), lambda: f"{r.choice(keys)} = \"\"",
    ]
    real = lambda: r.choice(REAL)
    joined = lambda by, a, b: by.join(real() for _ in range(r.randint(a, b)))
    number = lambda a=1, b=3: ".".join(str(r.randint(0, 30)) for _ in range(r.randint(a, b)))
    camel = lambda a, b: "".join(real().capitalize() for _ in range(r.randint(a, b)))
    clock = lambda: f"{r.randint(1995, 2031)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}{r.choice(['', 'Z', '.' + some(dig, 3, 6) + 'Z', '+02:00'])}"
    alike = [
        lambda: "/" + joined("/", 2, 6) + r.choice(["", number(1, 2), "." + some(low, 2, 4)]), lambda: f"{joined('/', 1, 3)}/{real()}{number(1, 2)}/{joined('-', 1, 3)}", lambda: f"{real()}.{r.choice(['org', 'com', 'io'])}/{joined('/', 1, 3)}/{r.choice([some(dig, 3, 5) + '.' + some(dig, 4, 6), number()])}{r.choice(['', 'v' + some(dig, 1, 1)])}",
        lambda: f"{r.choice(['', 'v', real() + '-'])}{number(2, 3)}-{r.choice(['rc', 'beta', 'alpha', 'dev', 'post'])}{r.choice(['', '.', '-'])}{r.randint(0, 9)}{r.choice(['', '+' + real() + '.' + some(dig, 2, 5), '+' + some(hexa, 7, 8)])}", lambda: f"{r.choice(['CVE', 'ISO', 'RFC', 'PEP', 'DIN', 'JIRA', 'BUG'])}-{some(dig, 3, 5)}-{some(dig, 2, 6)}",
        lambda: real() + camel(2, 6) + r.choice(["", some(dig, 1, 2)]), lambda: camel(3, 6) + r.choice(["", some(dig, 1, 3), "." + real() + camel(1, 2)]), lambda: joined("_", 3, 6) + r.choice(["", "_" + some(dig, 1, 4)]), lambda: joined("_", 2, 5).upper() + r.choice(["", some(dig, 1, 2)]), lambda: joined("-", 3, 6) + r.choice(["", "-" + some(dig, 1, 6)]),
        clock, lambda: "-".join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)), lambda: f"{r.choice(['sha256', 'sha384', 'sha512'])}-{some(low + up + dig + '+/', 43, 86)}{r.choice(['', '=', '=='])}", lambda: f"{r.choice(['commit', 'md5', 'etag', 'rev', 'checksum', 'digest', 'index'])}{r.choice([' ', ': ', '='])}{some(hexa, 8, 20)}",
        lambda: f"https://{real()}.{real()}.{r.choice(['org', 'com', 'net'])}/{joined('/', 1, 4)}{r.choice(['', '?' + real() + '=' + str(r.randint(1, 99999)), '/' + some(dig, 5, 9), '#' + joined('-', 1, 4)])}", lambda: f"{joined('.', 3, 5)}.{camel(1, 3)}", lambda: f"{joined('_', 1, 3)}{number(2, 2)}_{r.choice(['amd64', 'x86_64', 'arm64', 'noarch'])}.{r.choice(['deb', 'rpm', 'whl', 'tar.gz'])}",
    ]
    lines = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.25:
            form, what = r.random(), r.choice(alike)()
            lead = f"{real()}{r.choice([' = ', '=', ': '])}{r.choice(['', chr(34)])}" if form < 0.2 else f'"{real()}": "' if form < 0.3 else "" if form < 0.4 else f"{prose(1, 5)} {r.choice(['', '', '(', chr(96)])}"
            lines.append([(f"{lead}{what}{r.choice(['', '', chr(34), ',', '.', ')', chr(96)])} {prose(0, 5)}", False)])
            continue
        kind = r.random()
        if kind < 0.42:
            s = r.choice(secret)()
            q = r.choice(['"', "'", ""])
            lead, tail = (prose() + " " if r.random() < 0.7 else ""), (q + junk() + (" " + prose() if r.random() < 0.7 else ""))
            form = r.random()
            if form < 0.6:
                lines.append([(f"{lead}{r.choice(keys)}{r.choice([' = ', '=', ': ', ':'])}{q}", False), (s, True), (tail, False)])
            elif form < 0.75:
                lines.append([(f'{lead}"{r.choice(keys)}": "', False), (s, True), ('",', False)])
            elif form < 0.85:
                lines.append([(f"{lead}Authorization: Bearer ", False), (s, True), (" " + prose(), False)])
            else:
                s = r.choice(secret[:6])()
                lines.append([(lead, False), (s, True), (" " + prose(), False)])
        elif kind < 0.75:
            lines.append([(f"{prose()} {r.choice(harmless)()}{junk()} {prose()}", False)])
        else:
            j = junk()
            lines.append([(" ".join(w + j for w in prose(4, 24).split()), False)])
    return lines


def training_files(n: int = TRAIN_LINES, seed: int = 7) -> list[tuple[list[list[tuple[str, bool]]], list[int]]]:
    """(lines to learn from, slots of the file's features) of files that hold n such lines together.

    A file of prose, code or settings is as long as real ones are; most of its lines are filling of its kind, which
    only the file's features count, and every secret stands in some file.
    """
    r = random.Random(seed + 1)
    lines = training_lines(n, seed)
    r.shuffle(lines)
    words = ["the", "and", "tion", "ering", "ouver", "lichen", "dela", "menteque", "onan", "thes"]
    prose = lambda: " ".join(r.choice(words) + r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(6, 30)))
    code = lambda: r.choice(["def {0}({1}):", "    return {0} + {1}", "import {0}", "if {0} == {1}:", "    for {0} in {1}:", "const {0} = {2};", "self.{0} = {1}[{2}]", "function {0}({1}) {{"]).format(r.choice(words), r.choice(words), r.randint(0, 99))
    settings = lambda: r.choice(["{0}: {2}", "{0} = {1}", '"{0}": "{1}",', "host={1}.local", "port: {2}", "set {0} {2}"]).format(r.choice(words), r.choice(words), r.randint(0, 9999))
    out = []
    while lines:
        filling = r.choice([prose, prose, code, settings])
        own = [lines.pop() for _ in range(min(len(lines), r.choice([1, 1, 2, 4, 8])))]
        text = "\n".join(["".join(p for p, _ in parts) for parts in own] + [filling() for _ in range(r.choice([0, 0, 1, 4, 16, 64, 256]))])
        out.append((own, file_features(TOKEN.findall(text))))
    return out


def train(n: int = TRAIN_LINES, steps: int = TRAIN_STEPS, seed: int = 7) -> Crf:
    """Maximum likelihood with a small L2 penalty, by Adam over all lines at once."""
    slots, labels = [], []
    for parts, file in [(parts, file) for own, file in training_files(n, seed) for parts in own]:
        text = "".join(p for p, _ in parts)
        marks, at = [], 0
        for p, s in parts:
            if s:
                marks.append((at, at + len(p)))
            at += len(p)
        found = list(TOKEN.finditer(text))
        if not found:
            continue
        tokens, tags, inside = [m[0] for m in found], [], False
        for m in found:
            hit = any(a < m.end() and m.start() < b for a, b in marks)
            tags.append(0 if not hit else 2 if inside else 1)
            inside = hit
        own = [_token_slots(canonical(t)) for t in tokens]
        rows = []
        for i in range(len(tokens)):
            row = [*own[i][0], *file]
            for back in (1, 2, 3):
                row += own[i - back][back] if i >= back else []
            row += own[i + 1][4] if i + 1 < len(tokens) else []
            rows.append(row)
        slots.append(rows)
        labels.append(tags)
    long, wide = max(map(len, slots)), max(len(r) for s in slots for r in s)
    total = (ROLES + 1) * SLOTS
    x = np.full((len(slots), long, wide), total, np.int32)  # the last row of the weights stays zero
    y, size = np.zeros((len(slots), long), np.int64), np.array([len(s) for s in slots])
    for i, (rows, tags) in enumerate(zip(slots, labels)):
        y[i, : len(tags)] = tags
        for j, row in enumerate(rows):
            x[i, j, : len(row)] = row
    there = np.arange(long)[None, :] < size[:, None]
    w, t = np.zeros((total + 1, 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    x = x[there]  # tokens alone, without the lines' padding
    flat = x.reshape(-1)
    rows_at = np.arange(len(slots))
    for step in range(1, steps + 1):
        e = np.zeros((*there.shape, 3))
        e[there] = w[x].sum(axis=1)
        tt = t.copy()
        tt[0, 2] = -1e3
        alpha = np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + np.array([0, 0, -1e3])
        for j in range(1, long):
            z = alpha[:, j - 1, :, None] + tt
            top = z.max(axis=1)
            new = e[:, j] + top + np.log(np.exp(z - top[:, None]).sum(axis=1))
            alpha[:, j] = np.where(there[:, j, None], new, alpha[:, j - 1])
        beta = np.zeros_like(e)
        for j in range(long - 2, -1, -1):
            z = tt[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :]
            top = z.max(axis=2)
            new = top + np.log(np.exp(z - top[..., None]).sum(axis=2))
            beta[:, j] = np.where(there[:, j + 1, None], new, 0)
        top = alpha[:, -1].max(axis=1)
        logz = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1))
        # alpha keeps its last value past a line's end, so alpha[:, -1] belongs to the last token
        p = np.exp(alpha + beta - logz[:, None, None]) * there[..., None]
        gold = np.zeros_like(p)
        gold[rows_at[:, None], np.arange(long)[None, :], y] = 1
        diff = (p - gold * there[..., None]) / len(slots)
        gw = np.stack([np.bincount(flat, np.repeat(diff[there][:, k], wide), total + 1) for k in range(3)], axis=1)
        pair = np.exp(alpha[:, :-1, :, None] + tt + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None]) * there[:, 1:, None, None]
        gt = pair.sum(axis=(0, 1))
        np.subtract.at(gt, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
        gw, gt = gw + 1e-5 * w, gt / len(slots) + 1e-5 * t
        for v, g, m, s in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w[total] = 0
    return Crf(w, t)


_trained: list[Crf] = []


def model() -> Crf:
    """The model with the default parameters, trained once in a driver."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def all_spans(text: str, crf: Crf) -> list[tuple[int, int, str, int, int]]:
    """Spans of the patterns and of the CRF, by start, then by kind as listed in KINDS."""
    base = base_spans(text)
    more = [(a, b, "crf", a, b) for a, b in crf.spans(text) if not any(a < y and x < b for x, y, *_ in base)]
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, *_ in spans)


def scan_secrets(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id and an array of spans (kind, start, end, value_start, value_end) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(crf or model())

    def run(x):
        keys = ("start", "end", "kind", "value_start", "value_end")
        return {"doc_id": x["doc_id"], "spans": [[dict(zip(keys, s)) for s in all_spans(t, shared.value)] for t in x["text"]]}

    return common.map_rows(common.id_text(docs), "doc_id long, spans array<struct<start:int,end:int,kind:string,value_start:int,value_end:int>>", run)


def redact(text: str | None, crf: Crf, mark: str = "[SECRET]") -> str | None:
    """The text with each secret's value replaced by the mark; overlapping values become one."""
    if not text:
        return text
    out, at, last = [], 0, -1
    for a, b in sorted((s[3], s[4]) for s in all_spans(text, crf)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, crf: Crf | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with redacted texts, and n_chars (where there is such a column) of the new text; other columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(crf or model())
    names = docs.columns

    def run(row: pa.StructArray):
        texts = [redact(t, shared.value, mark) for t in row.field("text").to_pylist()]
        fields = [row.field(n) for n in names]
        fields[names.index("text")] = pa.array(texts, fields[names.index("text")].type)
        if "n_chars" in names:
            old = fields[names.index("n_chars")]
            fields[names.index("n_chars")] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist())], old.type)
        return pa.StructArray.from_arrays(fields, fields=list(row.type)), {}

    return common.map_boxed(common.boxed(docs), "", run, edit=True).select("_row.*")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(model())

    def run(x):
        out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans")}
        for doc_id, text in zip(x["doc_id"], x["text"]):
            spans = all_spans(text, shared.value)
            kinds = [s[2] for s in spans]
            base = joined([s for s in spans if s[2] != "crf"])
            row = (doc_id, *[kinds.count(k) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), joined(spans))
            for k, v in zip(out, row):
                out[k].append(v)
        return out

    docs = common.id_text(common.table(spark, sf_dir, "documents"))
    return common.map_rows(docs, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string", run)
