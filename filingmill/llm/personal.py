"""Personal data by patterns and a skip-chain conditional random field: emails, IP addresses, payment cards, phone numbers.

Patterns with their checks give the base spans. What they miss (a phone number and a card side by side, which the patterns take for one long number; a phone
number without its plus the second time; a card run together with its expiry date; an address cut short) the random field adds. Its nodes are the open tokens of a document: runs of
`[A-Za-z0-9._%+@()-]` with a digit or an @; every other token can only be outside, so nothing is lost by leaving it out. Neighbouring
open tokens are linked by learned transitions. Distant ones are linked where they repeat each other or are similar (the same text; the same last ten digits
up to there, however grouped; the same local part and first host label) and share learned potentials for being of one kind: of m alike tokens, m - 1 such skip links
run to one of them, a base one if there is one, so a value that fills a document costs no pairs. Loopy
sum-product messages, with base tokens held to their kinds, then make alike tokens agree across the whole document.

Training needs no labels: base spans of a bounded sample of the documents (at most TRAIN_DOCUMENTS, and TRAIN_PIECES pieces of PIECE_CHARS characters of these) are the given
mentions; by rule, other forms of the same and of made values are put beside them, and numbers of no kind (dates, amounts, versions, order numbers, failing
cards) among them. The form that was written says the label; pieces with a long number that the patterns drop are left out, as nothing says what it is. Weights go up the gradient of the likelihood, with expectations from the same messages.
Prediction reads every whole text, each on its own: nothing is shuffled.

Defined results: a null or empty text has no spans; repeated rows are each read; a null doc_id stays null; an empty table gives no rows (and a field fitted to made values
alone adds what it has learned from these); other columns are not read. Spans are code points, the end exclusive; base spans of different kinds may overlap,
an added span overlaps no base span.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut_batches, small_batches, staged

KINDS = ("email", "ip", "card", "phone")
#: Labels: outside, one a kind that a token fills, and two (first token, later token) a kind that may run over several.
OUTSIDE, EMAIL, IP, CARD, CARD_ON, PHONE, PHONE_ON = range(7)
KIND_OF = np.array([0, 1, 2, 3, 3, 4, 4])
FIRST, LATER = {1: EMAIL, 2: IP, 3: CARD, 4: PHONE}, {1: EMAIL, 2: IP, 3: CARD_ON, 4: PHONE_ON}
SIZE = len(KIND_OF)

TRAIN_DOCUMENTS, TRAIN_PIECES, PIECE_CHARS = 2000, 1200, 600
#: Training texts made, at least one a piece.
MADE_TEXTS = 2400
WIDTH = 1 << 14
EPOCHS, MINIBATCH, RATE, SEED, ROUNDS = 6, 48, 0.3, 13, 12
#: A transition that cannot be; an added span needs so much belief; digits that an added card or phone may have (and no letter).
NEVER, LEAST_BELIEF = -25.0, 0.6
DIGITS = {3: (12, 19), 4: (7, 15)}
BATCH_TEXT = 1 << 20
#: Words before a number that speak for or against a kind.
CUES = ("account", "amount", "call", "card", "date", "email", "fax", "host", "invoice", "ip", "mail", "mobile", "no", "number", "order", "page", "phone", "price", "server", "tel", "version", "visa", "year")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_TOKEN = _LOCAL + "@()"
_TAIL = re.compile(r"[A-Za-z0-9._%+@()-]*+")
_OPENS = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUNS = re.compile(r"[0-9]+|[A-Za-z]+|.")
_WORD = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]  # kind (from 1), start, end


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(filter(str.isdigit, text)) if text.isascii() else "".join(c for c in text if c in "0123456789")


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Open tokens, in one pass: each digit or @ is looked up, and the token around it taken."""
    out, at = [], 0
    while m := _OPENS.search(text, at):
        start = at + len(text[at : m.start()].rstrip(_TOKEN))
        at = _TAIL.match(text, m.start()).end()
        out.append((start, at))
    return out


def base_spans(text: str, tokens: list[tuple[int, int]] | None = None) -> list[Span]:
    """The leftmost matches of each kind that do not overlap, less those that fail its check. Emails and IP addresses lie
    within a token each, so only tokens are searched for them; each search is linear in the text."""
    tokens = tokens_of(text) if tokens is None else tokens
    out: list[Span] = []
    for start, end in tokens:
        last = start
        for m in _DOMAIN.finditer(text, start, end):
            local = text[last : m.start()]
            local = local[local.rfind("@") + 1 :]
            n = len(local) - len(local.rstrip(_LOCAL))
            if n:
                out.append((1, m.start() - n, m.end()))
            last = m.end() if n else m.start() + 1
    for start, end in tokens:
        for m in _IP.finditer(text, start, end):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((2, m.start(), m.end()))
    if tokens:
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((3, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((4, m.start(), m.end()))
    return out


@dataclass
class Model:
    weights: np.ndarray  # WIDTH x labels
    transitions: np.ndarray  # labels x labels
    skips: np.ndarray  # ways of being alike x kinds: the potential of agreeing on a kind

    def potentials(self) -> list[np.ndarray]:
        """Of a pair of labels: along the chain, against it, and over each kind of skip link."""
        chain = np.where(_illegal(), NEVER, self.transitions)
        agree = KIND_OF[:, None] == KIND_OF[None]
        return [chain, chain.T, *(np.where(agree, s[KIND_OF][:, None], 0.0) for s in self.skips)]


def _illegal() -> np.ndarray:
    out = np.zeros((SIZE, SIZE), bool)
    out[[i for i in range(SIZE) if i not in (CARD, CARD_ON)], CARD_ON] = True
    out[[i for i in range(SIZE) if i not in (PHONE, PHONE_ON)], PHONE_ON] = True
    return out


def empty_model() -> Model:
    return Model(np.zeros((WIDTH, SIZE)), np.zeros((SIZE, SIZE)), np.zeros((2, 5)))


@dataclass
class Graph:
    """The field of some texts laid end to end: features of token t are rows[starts[t]:starts[t + 1]]; links (a, b, type): 0 along the chain, 1 same
    text, 2 similar."""

    rows: np.ndarray
    starts: np.ndarray
    a: np.ndarray
    b: np.ndarray
    types: np.ndarray
    held: np.ndarray  # label of a base token, else -1

    def scores(self, weights: np.ndarray) -> np.ndarray:
        phi = np.add.reduceat(weights[self.rows], self.starts[:-1], axis=0) if len(self.held) else np.zeros((0, SIZE))
        fixed = np.flatnonzero(self.held >= 0)
        phi[fixed] = NEVER * 4
        phi[fixed, self.held[fixed]] = 0.0
        first = np.ones(len(phi), bool)
        first[self.b[self.types == 0]] = False
        free = np.flatnonzero(first & (self.held < 0))
        phi[free[:, None], [CARD_ON, PHONE_ON]] += NEVER
        return phi


def _features(text: str, tokens: list[tuple[int, int]], joined: list[bool]) -> Iterator[list[str]]:
    """Names of each token's features. joined: whether a token follows the one before it directly."""
    n = len(tokens)
    words = [text[s:e] for s, e in tokens]
    numbers = [_digits(w) for w in words]
    begin = 0
    while begin < n:
        end = begin + 1
        while end < n and joined[end]:
            end += 1
        held = [len(x) for x in numbers[begin:end]]
        total = sum(held)
        inside: dict[int, str] = {}
        for i in range(begin, end):  # windows of whole tokens with a right check digit
            digits = ""
            for j in range(i, min(end, i + 6)):
                digits += numbers[j]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and luhn(digits):
                    for k in range(i, j + 1):
                        inside.setdefault(k, "L" if k == i else "l")
                    break
        for i in range(begin, end):
            word, core = words[i], words[i].strip("._%()-")
            shape = "".join("d%d" % min(len(x), 20) if x[0].isdigit() else "a" if x[0].isalpha() else x for x in _RUNS.findall(word[:64]))
            parts = core.split(".")
            out = ["b", "s" + shape[:40], "n%d" % min(held[i - begin], 20), "t%d" % min(total, 24), "r%d" % min(end - begin, 6), "i%d" % min(i - begin, 4)]
            out.append("o%d%d%d%d" % ("@" in core[1:], "." in core.partition("@")[2], any(c.isalpha() for c in core), word.startswith("+")))
            if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append("ip")
            out.append("c" + inside.get(i, "-"))
            if i == begin:
                before = _WORD.findall(text[max(0, tokens[i][0] - 16) : tokens[i][0]])
                if before and before[-1].lower() in CUES:
                    out.append("w" + before[-1].lower())
            else:
                out.append("g" + re.sub("[0-9]", "d", words[i - 1])[:12] + "|" + re.sub("[0-9]", "d", word)[:12])
            if i + 1 < end:
                out.append("h%d" % min(held[i + 1 - begin], 20))
            yield out
        begin = end


def _alike(text: str, tokens: list[tuple[int, int]], joined: list[bool]) -> Iterator[tuple[int, str, int]]:
    """(way of being alike, key, token): tokens with one key are alike."""
    run = ""
    for i, (s, e) in enumerate(tokens):
        word = text[s:e].strip("._%()-").lower()
        digits = _digits(word)
        if len(word) >= 5 and ("@" in word or len(digits) >= 4):
            yield 1, word, i
        local, at, host = word.partition("@")
        if at and local:
            yield 2, f"{local}@{re.split(r'[._]', host)[0]}", i
        run = (run if joined[i] else "") + ("" if at else digits)
        run = run[-40:]
        if digits and not at and len(run) >= 10:
            yield 2, run[-10:], i
        dotted = re.split(r"[.-]", word.removeprefix("ip-"))
        if len(dotted) == 4 and all(p.isdigit() and len(p) <= 3 for p in dotted):
            yield 2, ".".join(dotted), i


def graph_of(texts: list[tuple[str, list[tuple[int, int]], list[Span]]], clamp: list[bool] | None = None) -> Graph:
    """texts: (text, open tokens, base spans). clamp: of which of them base tokens are held to their kinds (all)."""
    rows, starts, links, held = [], [0], [], []
    for x, (text, tokens, base) in enumerate(texts):
        offset = len(held)
        joined = [i > 0 and s - tokens[i - 1][1] <= 2 and text[tokens[i - 1][1] : s].isspace() for i, (s, _) in enumerate(tokens)]
        for names in _features(text, tokens, joined):
            rows += [zlib.crc32(name.encode("utf-8", "surrogatepass")) & (WIDTH - 1) for name in names]
            starts.append(len(rows))
        labels = labels_of(tokens, base) if clamp is None or clamp[x] else [-1] * len(tokens)
        held += labels
        links += [(offset + i - 1, offset + i, 0) for i in range(1, len(tokens)) if joined[i]]
        groups = defaultdict(list)
        for way, key, i in _alike(text, tokens, joined):
            groups[way, key].append(i)
        seen = set()
        for (way, _), members in groups.items():
            if len(members) > 1:
                hub = next((i for i in members if labels[i] >= 0), members[0])
                for i in members:
                    if i != hub and (i, hub) not in seen and (labels[i] < 0 or labels[hub] < 0):
                        seen |= {(i, hub), (hub, i)}
                        links.append((offset + i, offset + hub, way))
    a, b, types = np.array(links, dtype=np.int64).reshape(-1, 3).T
    return Graph(np.array(rows, dtype=np.int64), np.array(starts, dtype=np.int64), a, b, types, np.array(held, dtype=np.int64))


def labels_of(tokens: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """The label that spans give a token, -1 without one; where kinds overlap, the first of KINDS."""
    out = [-1] * len(tokens)
    ends = np.array([e for _, e in tokens], dtype=np.int64)
    for kind, start, end in sorted(spans):
        i = int(np.searchsorted(ends, start, side="right"))
        first = True
        while i < len(tokens) and tokens[i][0] < end:
            if out[i] < 0:
                out[i] = FIRST[kind] if first else LATER[kind]
            first = False
            i += 1
    return out


def messages(phi: np.ndarray, graph: Graph, potentials: list[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-product messages along all links at once, a fixed number of rounds, so that a text's result does not depend on the texts
    beside it. (log beliefs per token, log beliefs per link and pair of labels, the sum of messages into each token)"""
    m = len(graph.a)
    src, dst = np.concatenate([graph.a, graph.b]), np.concatenate([graph.b, graph.a])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    way = np.concatenate([np.where(graph.types == 0, 0, graph.types + 1), np.where(graph.types == 0, 1, graph.types + 1)])
    own = [np.flatnonzero(way == w) for w in range(len(potentials))]
    exps = [np.exp(p) for p in potentials]
    sent = np.zeros((2 * m, SIZE))
    into = np.zeros_like(phi)
    for _ in range(rounds if m else 0):
        t = (phi + into)[src] - sent[back]
        t = np.exp(t - t.max(axis=1, keepdims=True))
        for k, p in zip(own, exps, strict=True):
            if len(k):
                sent[k] = t[k] @ p
        sent = np.log(np.maximum(sent / sent.sum(axis=1, keepdims=True), 1e-30))
        into = np.zeros_like(phi)
        np.add.at(into, dst, sent)
    node = phi + into
    node -= np.logaddexp.reduce(node, axis=1, keepdims=True) if len(node) else 0
    pair = np.zeros((m, SIZE, SIZE))
    if m:
        forward = np.stack(potentials)[way[:m]]
        left, right = (phi + into)[graph.a] - sent[m:], (phi + into)[graph.b] - sent[:m]
        pair = left[:, :, None] + forward + right[:, None, :]
        pair -= np.logaddexp.reduce(pair.reshape(m, -1), axis=1)[:, None, None]
    return node, pair, into


def gradient(model: Model, graph: Graph, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By weights, transitions and skip potentials: what the labels have less what the field expects, given its held tokens."""
    node, pair, _ = messages(graph.scores(model.weights), graph, model.potentials())
    miss = -np.exp(node)
    miss[np.arange(len(labels)), labels] += 1
    miss[graph.held >= 0] = 0
    by_weight = np.zeros_like(model.weights)
    np.add.at(by_weight, graph.rows, np.repeat(miss, np.diff(graph.starts), axis=0))
    pair = -np.exp(pair)
    pair[np.arange(len(pair)), labels[graph.a], labels[graph.b]] += 1
    chain = pair[graph.types == 0].sum(axis=0)
    agree = (KIND_OF[:, None] == KIND_OF[None])[None] * pair
    by_kind = np.stack([[agree[graph.types == w][:, KIND_OF == k].sum() for k in range(5)] for w in (1, 2)])
    return by_weight, np.where(_illegal(), 0.0, chain), by_kind


# ---- training texts ----


def _number(rng, n: int, least: int = 0) -> str:
    return str(rng.integers(max(1, least), 10)) + "".join(map(str, rng.integers(0, 10, n - 1)))


def _card(rng, right: bool = True) -> str:
    body = rng.choice(["4", "51", "37"]) + _number(rng, 16)
    body = body[:15]
    last = next(c for c in "0123456789" if luhn(body + c))
    return body + (last if right else str((int(last) + int(rng.integers(1, 10))) % 10))


def _made(rng, kind: int) -> str:
    """A value of a kind in a form that the patterns know."""
    if kind == 1:
        word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), int(rng.integers(1, 9))))
        number = lambda: str(rng.integers(0, 99)) if rng.random() < 0.5 else ""
        local = str(rng.choice([".", "_", "-", "+"])).join(word() for _ in range(int(rng.integers(1, 4)))) + str(rng.choice([".", "_", ""])) + number()
        return f"{local.rstrip('._')}@{word()}{number()}.{rng.choice(['com', 'org', 'net', 'co.uk', 'example.com', 'example.org'])}"
    if kind == 2:
        return ".".join(map(str, rng.integers(1, 256, 4)))
    if kind == 3:
        card = _card(rng)
        return card if rng.random() < 0.5 else str(rng.choice([" ", "-"])).join(card[i : i + 4] for i in range(0, len(card), 4))
    return f"+{rng.integers(1, 99)}{rng.choice([' ', '-', ''])}({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}" if rng.random() < 0.5 else f"+{rng.integers(1, 99)} {_number(rng, 3)} {_number(rng, 3)} {_number(rng, 4)}"


def _other_form(rng, kind: int, value: str) -> list[tuple[str, bool]]:
    """Pieces (text, whether it belongs to the mention) of a form that the patterns do not know, of the same value."""
    if kind == 1:
        local, _, host = value.partition("@")
        return [(f"{local}@{host.split('.')[0]}", True)]
    if kind == 2:
        return [(str(rng.choice(["", "ip-"])) + value.replace(".", "-"), True)]
    digits = _digits(value)
    if kind == 3:
        grouped = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        form = rng.integers(0, 4)
        if form == 0:
            return [(".".join(grouped), True)]
        if form == 1:
            return [("\n".join(grouped), True)]
        body = digits if form == 2 else " ".join(grouped)
        return [(body, True), (f" {rng.integers(10, 13)}/{rng.integers(24, 32)}", False)]
    tail = digits[-10:]
    a, b, c = tail[:-7], tail[-7:-4], tail[-4:]
    forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", tail, f"00{digits[:-10]} {a} {b} {c}", f"{a} {b} {c}", f"({a})\n{b}-{c}"]
    return [(forms[int(rng.integers(0, len(forms)))], True)]


def _of_no_kind(rng) -> str:
    """A number or handle that is no personal data."""
    y, m, d = rng.integers(1950, 2030), rng.integers(1, 13), rng.integers(1, 29)
    forms = [
        f"{y}", f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d}/{m}/{y}", f"{m:02}:{d:02}", f"{y}-{m:02}-{d:02} {m:02}:{d:02}", f"{rng.integers(1, 999)},{_number(rng, 3)}.{_number(rng, 2)}", f"{rng.integers(1, 99)}.{_number(rng, 2)}",
        f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"{rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(1, 9)}", _number(rng, int(rng.integers(1, 13))), _number(rng, int(rng.integers(12, 20))), _card(rng, right=False), " ".join(_number(rng, 4) for _ in range(4)),
        f"{rng.integers(1, 100)}%", f"{rng.integers(1, 50)}-{rng.integers(50, 99)}", f"@name{rng.integers(1, 99)}", f"AB-{_number(rng, 4)}", "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(10, 41)))), "".join(rng.choice(list("ABCDEFGHJKMNPQRSTUVWXYZ23456789"), int(rng.integers(8, 25)))), f"978-{rng.integers(1, 9)}-{_number(rng, 2)}-{_number(rng, 6)}-{rng.integers(0, 9)}",
        " ".join(_number(rng, int(rng.integers(1, 5))) for _ in range(int(rng.integers(2, 8)))), f"({rng.integers(1, 99)})", f"{_number(rng, 3)}-{_number(rng, 4)}", f"{_number(rng, 5)}-{_number(rng, 4)}", f"{rng.integers(2, 9)}e{rng.integers(2, 30)}", f"{rng.integers(256, 999)}.{rng.integers(1, 99)}.{rng.integers(1, 99)}.{rng.integers(1, 99)}",
    ]
    return str(forms[int(rng.integers(0, len(forms)))])


def made_text(rng, piece: str) -> tuple[str, list[Span]]:
    """A training text: the piece with forms of values it holds, and of made ones, and numbers of no kind put between its words.
    With the spans of the mentions that were put in; base spans are found in the result as in any text."""
    puts: list[list[tuple[str, int]]] = []
    known = [(k, piece[s:e]) for k, s, e in base_spans(piece)]
    for _ in range(int(rng.integers(1, 3))):
        if known and rng.random() < 0.6:
            kind, value = known[int(rng.integers(0, len(known)))]
        else:
            kind = int(rng.integers(1, 5))
            value = _made(rng, kind)
            if rng.random() < 0.75:
                puts.append([(value, kind)])
            else:  # alone, a form counts if it tells its kind by itself
                form = _other_form(rng, kind, value)
                tells = kind == 3 or kind == 4 and "-" in form[0][0]
                puts.append([(t, kind if own and tells else 0) for t, own in form])
                continue
        for _ in range(int(rng.integers(1, 3))):
            puts.append([(t, kind if own else 0) for t, own in _other_form(rng, kind, value)])
    if rng.random() < 0.7:  # values that stand side by side, which a pattern takes for one long number and drops
        kinds = rng.choice([2, 3, 4, 4], int(rng.integers(2, 4))).tolist()
        puts.append([part for i, kind in enumerate(kinds) for part in ((" " if i else "", 0), (_made(rng, kind), kind))])
    for _ in range(int(rng.integers(1, 5))):
        other = [(_of_no_kind(rng), 0)]
        puts += [other] * int(rng.integers(1, 3))
    # Between words, but not within what the patterns find: these mentions stay whole, and stay what they are.
    own = base_spans(piece)
    breaks = [m.end() for m in re.finditer(r"\s(?=\S)", piece) if not any(start < m.end() < end for _, start, end in own)] or [len(piece)]
    places = np.sort(rng.choice(breaks, len(puts)))
    order = rng.permutation(len(puts))
    out, spans, at, done, moved = [], [], 0, 0, []
    for place, x in zip(places.tolist(), order, strict=True):
        out.append(piece[done:place])
        at += place - done
        done = place
        cue = f"{rng.choice(CUES)} " if rng.random() < 0.15 else "and " if rng.random() < 0.7 else ""
        begin = at
        for text, kind in [(cue, 0), *puts[x], (" ", 0), ("of " if rng.random() < 0.7 else "", 0)]:
            if kind:
                spans.append((kind, at, at + len(text)))
            out.append(text)
            at += len(text)
        moved.append((place, at - begin))
    shift = lambda start: sum(n for place, n in moved if place <= start)
    spans += [(kind, start + shift(start), end + shift(start)) for kind, start, end in own]
    return "".join([*out, piece[done:]]), spans


def _whole(piece: str) -> str:
    """The piece without numbers at its ends, which may have been cut."""
    tokens = tokens_of(piece)
    end, start = len(piece), 0
    while tokens and tokens[-1][1] >= end - 2:
        end = tokens.pop()[0]
    tokens = tokens[::-1]
    while tokens and tokens[-1][0] <= start + 2:
        start = tokens.pop()[1]
    return piece[start:end]


def _in_doubt(piece: str) -> bool:
    """Whether a piece has a number without letters, in no base span, that is long enough to be a phone or card: what it is can't be told from the patterns."""
    tokens = tokens_of(piece)
    labels = labels_of(tokens, base_spans(piece, tokens))
    run = last = 0
    for (s, e), label in zip(tokens, labels, strict=True):
        plain = label < 0 and not any(c.isalpha() or c == "@" for c in piece[s:e])
        run = (run if s - last <= 2 else 0) + len(_digits(piece[s:e])) if plain else 0
        last = e
        if run >= 9:
            return True
    return False


def fit(pieces: list[str]) -> Model:
    """The field of the pieces' texts. Half of the texts hold their base tokens, as prediction does, so that links to these are
    learned; the others do not, so that the base forms are."""
    rng = np.random.default_rng(SEED)
    texts, labels, clamp = [], [], []
    pieces = [*(p for p in map(_whole, pieces) if not _in_doubt(p)), " ".join(["made", "text", "of", "words"] * 8)]
    for i in range(max(MADE_TEXTS, len(pieces))):
        piece = pieces[i % len(pieces)]
        text, spans = made_text(rng, piece)
        tokens = tokens_of(text)
        base = base_spans(text, tokens)
        given, put = labels_of(tokens, base), labels_of(tokens, spans)
        texts.append((text, tokens, base))
        labels.append([g if g >= 0 else max(p, 0) for g, p in zip(given, put, strict=True)])
        clamp.append(bool(rng.random() < 0.5))
    model = empty_model()
    squares = [np.full(x.shape, 1e-4) for x in (model.weights, model.transitions, model.skips)]
    batches = []
    order = rng.permutation(len(texts))
    for i in range(0, len(order), MINIBATCH):
        part = order[i : i + MINIBATCH]
        batches.append((graph_of([texts[j] for j in part], [clamp[j] for j in part]), np.array([x for j in part for x in labels[j]], dtype=np.int64)))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(batches)):
            for x, g, s in zip((model.weights, model.transitions, model.skips), gradient(model, *batches[i]), squares, strict=True):
                s += g * g
                x += RATE * g / np.sqrt(s)
    return model


def training_pieces(docs: DataFrame) -> list[str]:
    """docs: doc_id, text. At most TRAIN_PIECES pieces with a digit or @, by hash, from anywhere in at most TRAIN_DOCUMENTS texts, by hash of the id."""
    key = F.xxhash64("doc_id")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(key, "doc_id").limit(TRAIN_DOCUMENTS).distinct()
    ids = staged(ids, "sample")
    pieces = F.explode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))).alias("piece")
    cut = docs.join(F.broadcast(ids), "doc_id").select(pieces).filter(F.col("piece").rlike("[0-9@]")).distinct()
    return [r.piece for r in cut.orderBy(F.xxhash64("piece"), "piece").limit(TRAIN_PIECES).collect()]


def train(docs: DataFrame) -> Model:
    return fit(training_pieces(docs))


# ---- prediction ----


def _added(text: str, tokens: list[tuple[int, int]], labels: np.ndarray, belief: np.ndarray, held: np.ndarray, joined: set[int]) -> Iterator[tuple[int, int, int, float]]:
    """Spans of tokens that are not base ones: (kind, start, end, least belief of its tokens)."""
    i = 0
    while i < len(tokens):
        kind = int(KIND_OF[labels[i]])
        j = i + 1
        if kind and held[i] < 0:
            while j < len(tokens) and j in joined and held[j] < 0 and labels[j] == LATER[kind] and kind in DIGITS:
                j += 1
            start, end = tokens[i][0], tokens[j - 1][1]
            whole = text[start:end]
            left = whole.lstrip("._%()-")
            if kind == 4 and whole[len(whole) - len(left) - 1 : len(whole) - len(left)] == "(" and ")" in left:
                left = "(" + left
            core = left.rstrip("._%(-" if "(" in left else "._%()-")
            start += len(whole) - len(left)
            least, most = DIGITS.get(kind, (0, 1 << 60))
            sure = float(belief[i:j].min())
            if sure >= LEAST_BELIEF and least <= len(_digits(core)) <= most and ("@" in core) == (kind == 1) and not (kind in DIGITS and any(map(str.isalpha, core))):
                yield kind, start, start + len(core), sure
        i = j


def find(model: Model, texts: list[str | None]) -> list[tuple[list[Span], list[tuple[int, int, int, float]]]]:
    """(base spans, added spans with their beliefs) of each text."""
    out: list[tuple[list[Span], list]] = []
    graphs, where = [], []
    for text in texts:
        tokens = tokens_of(text) if text else []
        base = base_spans(text, tokens) if tokens else []
        if tokens and any(x < 0 for x in labels_of(tokens, base)):
            where.append(len(out))
            graphs.append((text, tokens, base))
        out.append((base, []))
    if graphs:
        graph = graph_of(graphs)
        node, _, _ = messages(graph.scores(model.weights), graph, model.potentials())
        share = np.exp(node)
        labels = share.argmax(axis=1)
        belief = np.stack([share[:, KIND_OF == k].sum(axis=1) for k in range(5)], axis=1)[np.arange(len(share)), KIND_OF[labels]]
        follows = set(graph.b[graph.types == 0].tolist())
        at = 0
        for x, (text, tokens, _) in zip(where, graphs, strict=True):
            part = slice(at, at + len(tokens))
            if labels[part].any():
                out[x][1].extend(_added(text, tokens, labels[part], belief[part], graph.held[part], {j for j in range(len(tokens)) if at + j in follows}))
            at += len(tokens)
    return out


_SPAN = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")


def _identify(shared):
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    scored = pa.struct([*kind_type, pa.field("belief", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "text", BATCH_TEXT):
            base, added = [], []
            for own, more in find(shared.value, batch.column("text").to_pylist()):
                base.append([{"kind": KINDS[k - 1], "start": s, "end": e} for k, s, e in own])
                added.append([{"kind": KINDS[k - 1], "start": s, "end": e, "belief": p} for k, s, e, p in more])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(kind_type)), pa.array(added, pa.list_(scored))], ["doc_id", "base", "added"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, base (array of kind, start, end), added (the same with belief). Texts without a digit or @ hold nothing and are not sent to Python."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"]]).add("base", T.ArrayType(_SPAN)).add("added", T.ArrayType(T.StructType(list(_SPAN)).add("belief", "double")))
    read = docs.select("doc_id", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).alias("text"))
    return read.mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(model)), schema)


def _redact(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "text", BATCH_TEXT):
            texts = batch.column("text").to_pylist()
            for x, (base, added) in enumerate(find(shared.value, texts)):
                merged: list[list[int]] = []
                for kind, s, e in sorted(((k, s, e) for k, s, e, *_ in [*base, *added]), key=lambda m: m[1:]):
                    if merged and s < merged[-1][2]:
                        merged[-1][2] = max(merged[-1][2], e)
                    else:
                        merged.append([kind, s, e])
                for kind, s, e in reversed(merged):
                    texts[x] = f"{texts[x][:s]}[{KINDS[kind - 1].upper()}]{texts[x][e:]}"
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; all other columns as they are."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redact(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
