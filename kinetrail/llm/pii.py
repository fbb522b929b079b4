"""Personal data in whole texts: four fixed patterns, and spans that a trained tagger adds.

Method: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans (written-out
examples of the kinds in many notations, and of what looks like them but isn't). A text is read around its triggers: a
span must hold a digit, an at sign or a written-out one, so text further away can hold none. A region reaches over the
whole tokens beside its triggers, however long, and a margin more. Each region is cut into windows of `WINDOW` characters
that overlap by half; emissions of overlapping windows are averaged, weighted by the distance to the window's edge, and
one Viterbi pass over the region reconciles them globally. Spans the tagger adds must
be well formed for their kind and not overlap a base span; base spans always stay.

Defined results: null counts as the empty text, which has no spans. Spans are code points, end exclusive, ordered by
start and then kind (email, ip, card, phone). The counts are of base spans; n_model counts added ones, n_spans all. Equal texts
have equal results; repeated rows repeat. A very long text is read whole by the patterns
and around its triggers by the tagger, in one task. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_slices, sha, texts_of
from .tagger import Tagger, encode

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = LOCAL - frozenset("._%+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of digit groups always begins where a run of digits begins, so long runs are tried once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

WINDOW, MARGIN = 64, 24
TRIGGER = re.compile(r"[0-9@]|[(\[{]at[)\]}]|[(\[{]?\bdot\b[)\]}]?", re.I)
#: Characters of an e-mail's local part or domain; a region doesn't end within a run of them.
TOKEN = re.compile(r"[A-Za-z0-9._%+-]*+")
EXAMPLES, EPOCHS, SEED = 3500, 8, 42


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: before an at sign the local part reaches as far left as it can."""
    out, free, p = [], 0, text.find("@")
    while p >= 0:
        a = p
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, p + 1) if a < p else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        p = text.find("@", max(p + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kind an index of KINDS."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text) is None:
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m.group())) <= 15]
    return sorted(out)


def examples(n: int = EXAMPLES, seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: symbol codes and label paths."""
    r = random.Random(seed)
    common, every = "etaoinshrdlucmfwygpbvk", "abcdefghijklmnopqrstuvwxyz"

    def word(most: int = 10) -> str:
        """Any letters, at times capitals or a name's case, at times very long."""
        k = r.randint(1, most) if r.random() < 0.9 else r.randint(most, 34)
        x = "".join(r.choice(common if r.random() < 0.5 else every) for _ in range(k))
        return x.capitalize() if (p := r.random()) < 0.15 else x.upper() if p < 0.2 else x

    def cased(x: str) -> str:
        return "".join(c.upper() if r.random() < 0.5 else c for c in x) if (p := r.random()) < 0.15 else x.upper() if p < 0.25 else x.title() if p < 0.4 else x

    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    octet = lambda: str(r.randint(0, 255))

    def card() -> str:
        head = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        return next(head + d for d in "0123456789" if luhn(head + d))

    def spaced(digits: str) -> str:
        sep = r.choice(("", "", " ", "-", "."))
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def email() -> str:
        parts = [word(8) if r.random() < 0.85 else word(8) + num(r.randint(1, 4)) for _ in range(r.choice((1, 2, 2, 2, 3)))]
        user = r.choice((".", ".", "_", "-", "+", "")).join(parts)
        at, dot = r.choice(((" (at) ", " dot "), (" (at) ", " dot "), ("[at]", "[dot]"), (" @ ", "."), (" @ ", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("{at}", "{dot}"), ("(at)", "(dot)"), (" [at] ", "."), (" [at] ", " dot "), ("@", ".")))
        host = r.choice(("", "", "", word(8) + "-")) + word() + r.choice(("", "", num(1), num(2)))
        top = r.choice(("com", "org", "net", "io", "de", "info", word(4).lower(), f"co{dot}uk", f"{word(8)}{dot}com"))
        return user + cased(at) + host + cased(dot) + cased(top)

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        lead = r.choice(("+1 ", "+44 ", "+", "", "", "1-", "001 "))
        return lead + r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))

    makers = (email, lambda: r.choice((".", ".", ".", "[.]")).join(octet() for _ in range(4)), lambda: spaced(card()), phone)
    noise = (
        lambda: num(r.randint(1, 12)), lambda: f"{r.randint(1900, 2100)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}",
        lambda: "$" + num(3) + "." + num(2), lambda: "%x" % r.getrandbits(r.choice((64, 80, 160))), lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
        lambda: "password=" + "%x" % r.getrandbits(72), lambda: 'token = "' + "%x" % r.getrandbits(160) + '"', lambda: cased("dot ") + word(), lambda: word() + cased(" at ") + word() + cased(" dot ") + word(), lambda: cased("(at)") + " " + num(2), lambda: "@ " + num(2), lambda: "@" + word(), lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)}%", lambda: "(c) " + num(4), lambda: word() + num(2),
    )
    ids, gold = np.zeros((n, window), np.int64), np.zeros((n, window), np.int64)
    for i in range(n):
        text, labels = "", []
        while len(text) < window + 40:
            pick = r.random()
            if pick < 0.2:
                k = r.randrange(len(KINDS))
                piece = makers[k]()
                labels += [1 + 2 * k] + [2 + 2 * k] * (len(piece) - 1)
            else:
                piece = r.choice(noise)() if pick < 0.35 else word()
                labels += [0] * len(piece)
            gap = r.choice((" ", " ", " ", " ", ", ", ". ", "\n", ": "))
            text += piece + gap
            labels += [0] * len(gap)
        shift = r.randrange(len(text) - window)
        path = labels[shift : shift + window]
        for j in range(window):  # a span cut at the left begins where the window does
            if path[j] and path[j] % 2 == 0 and (j == 0 or path[j - 1] not in (path[j], path[j] - 1)):
                path[j] -= 1
        ids[i], gold[i] = encode(text[shift : shift + window]), path
    return ids, gold


_trained: dict[tuple, Tagger] = {}


def trained(n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """The tagger, trained once in a process; the same everywhere for the same parameters."""
    key = (n, epochs, seed)
    if key not in _trained:
        tagger = Tagger(len(KINDS))
        tagger.fit(*examples(n, seed), epochs)
        _trained[key] = tagger
    return _trained[key]


def regions(text: str) -> list[tuple[int, int]]:
    """Merged neighbourhoods of the triggers: the tokens beside each (past one space, as in ` (at) `) and the margin."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = m.start(), m.end()
        if not out or b + 1 > out[-1][1] - MARGIN:
            b = TOKEN.match(text, b + 1 if b < len(text) and text[b].isspace() else b).end()
            b = min(len(text), b + MARGIN)
        else:
            b = out[-1][1]  # the region so far reaches over its tokens
        least = out[-1][1] if out else 0
        a -= a > 0 and text[a - 1].isspace()
        while a > least and text[a - 1] in LOCAL:
            a -= 1
        a = max(0, a - MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)[:, None]


def tag_regions(tagger: Tagger, parts: list[str]) -> list[np.ndarray]:
    """Label paths of the regions' texts. Windows of all regions go through the network together."""
    windows, spots = [], []
    for i, part in enumerate(parts):
        ids = encode(part)
        for a in range(0, max(1, len(ids) - WINDOW // 2), WINDOW // 2):
            w = np.full(WINDOW, _SPACE, np.int64)
            w[: len(ids[a : a + WINDOW])] = ids[a : a + WINDOW]
            windows.append(w)
            spots.append((i, a))
    total = [np.zeros((len(p), tagger.labels)) for p in parts]
    weight = [np.zeros((len(p), 1)) for p in parts]
    for k in range(0, len(windows), 512):
        for (i, a), em in zip(spots[k : k + 512], tagger.emissions(np.array(windows[k : k + 512]))):
            m = min(WINDOW, len(parts[i]) - a)
            total[i][a : a + m] += em[:m] * _WEIGHT[:m]
            weight[i][a : a + m] += _WEIGHT[:m]
    return [tagger.viterbi(t / w) for t, w in zip(total, weight)]


_SPACE = int(encode(" ")[0])


def well_formed(kind: int, piece: str) -> bool:
    digits = "".join(DIGITS.findall(piece))
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(?:@|[(\[{]at[)\]}])\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[{]?dot[)\]}]?\s?)[A-Za-z0-9-]+)+", piece, re.I))
    if kind == 1:
        parts = re.split(r"\[?\.\]?", piece)
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9 .-]*[0-9]", piece))
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9(][0-9]{0,4}(?:[ ().-]{1,2}[0-9]{2,5}){2,5}", piece))


def spans_of(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelled runs of a path."""
    out, i, p = [], 0, path.tolist()
    while i < len(p):
        if p[i]:
            k, j = (p[i] - 1) // 2, i + 1
            while j < len(p) and p[j] == 2 + 2 * k:
                j += 1
            out.append((i, k, j))
            i = j
        else:
            i += 1
    return out


def whole_tokens(text: str, s: int, e: int) -> tuple[int, int]:
    """An e-mail's edges moved outwards to the ends of the tokens that they lie in."""
    while s > 0 and text[s] in LOCAL and text[s - 1] in LOCAL:
        s -= 1
    while e < len(text) and text[e - 1] in LABEL and text[e] in LABEL:
        e += 1
    return s, e


def find(texts: list[str], tagger: Tagger, near: Callable[[str], list[tuple[int, int]]] = regions) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text. `near` names the parts of a text that the tagger reads."""
    based = [base_spans(t) for t in texts]
    where = [(i, a, b) for i, t in enumerate(texts) for a, b in near(t)]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, a, b), path in zip(where, tag_regions(tagger, [texts[i][a:b] for i, a, b in where])):
        for s, k, e in spans_of(path):
            s, e = s + a, e + a
            if k == 0:
                s, e = whole_tokens(texts[i], s, e)
            # Edges are whole tokens: a span doesn't begin or end inside a run of digits or letters.
            inside = (s > 0 and texts[i][s - 1].isalnum() and texts[i][s].isalnum()) or (e < len(texts[i]) and texts[i][e].isalnum() and texts[i][e - 1].isalnum())
            if not inside and well_formed(k, texts[i][s:e]) and not any(x < e and s < y for x, _, y in based[i]):
                added[i].append((s, k, e))
    return list(zip(based, added))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_model long, n_spans long, base_sha256 string, spans string"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base spans by kind and of added ones, the digest of the base spans, all spans. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(trained())

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: tuple[list[int], ...] = ([], [], [], [], [], [])
        digests, spelled = [], []
        for base, added in find(texts_of(batch.column(1)), sent.value):
            for k, c in enumerate(columns[:4]):
                c.append(sum(s[1] == k for s in base))
            columns[4].append(len(added))
            columns[5].append(len(base) + len(added))
            digests.append(sha(spell(base).encode()))
            spelled.append(spell(sorted(base + added)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(spelled, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_model", "n_spans", "base_sha256", "spans"])

    return map_slices(id_text(df, id_col, text_col), kernel, SCHEMA)
