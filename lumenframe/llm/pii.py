"""Personal data: fixed patterns, and a character tagger that adds what they miss.

The base finds e-mail and IP addresses, card and phone numbers by pattern, and drops matches that
fail their check. A bidirectional LSTM with a CRF is trained from labelled spans: base spans of at
most ``most`` windows of the corpus, in the order of a hash, and generated ones. The generated ones
also hold what no base pattern takes: addresses with letters beyond ASCII or spaces about the sign,
IPv6, cards with other marks, phones without a plus sign, and a fifth kind, ``secret``: keys and
tokens. The tagger then reads overlapping windows of every text. Of a span seen by several windows,
the reading farthest from a window's edge counts; spans are reconciled over the whole text in the
order of that distance, then of start, kind and end. A span that the tagger adds overlaps no base
span, holds a digit or an ``@`` and has its kind's form, which is wider than the base's; cards must
pass Luhn. Windows without a digit or an ``@`` can add nothing, so they need no decoding.

Defined results: a null text is an empty one, without spans; in masking a null text stays null;
a null id is carried; rows that repeat are judged one by one; of overlapping readings of one
distance the earlier start stays, then the kind that is listed first, then the shorter one; an empty table gives an empty
result; other columns are ignored here and kept as they are in masking.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.bilstm_crf import KINDS, Tagger, codes, spans_of
from lumenframe.llm.common import pieces

#: Characters of a window, the step between windows, and windows decoded at once.
WINDOW, STEP, BATCH = 96, 32, 512
#: Labelled windows taken from the corpus, and generated ones.
MOST, GENERATED = 1000, 1600

#: Kinds that the base has patterns for.
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits that did not match from its start.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def valid(kind: str, s: str) -> bool:
    """The check of each kind."""
    if kind == "ip":
        return all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        # The local part is the run before the sign, back to the last match's end.
        while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    if not _ANCHOR.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m.group())]
    return found


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an ``@``."""
    starts: dict[int, None] = {}
    last = max(0, -(-(len(text) - WINDOW) // STEP)) if len(text) > WINDOW else 0
    for m in _ANCHOR.finditer(text):
        at = m.start()
        for k in range(max(0, -(-(at - WINDOW + 1) // STEP)), min(last, at // STEP) + 1):
            starts[k * STEP] = None
    return list(starts)


#: The forms of added spans.
_FORMS = {
    "email": re.compile(r"[\w.%+-]+ ?@ ?[\w-]+( ?\. ?[\w-]+)*"),
    "ip": re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}"),
    "card": re.compile(r"[0-9]([ ./\u2013-]{0,2}[0-9])+"),
    "phone": re.compile(r"\+?[0-9(][\x20()./0-9-]+[0-9]"),
    "secret": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{16,}"),
}


def _plausible(kind: int, s: str) -> bool:
    """Whether an added span has its kind's form."""
    name = KINDS[kind]
    if not (_ANCHOR.search(s) and _FORMS[name].fullmatch(s)):
        return False
    if name == "card":
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    if name == "phone":
        # A run of digits alone is some number.
        return 7 <= len(_digits(s)) <= 15 and not re.search(r"[0-9]{8}", s)
    return name != "ip" or ":" in s or valid("ip", s)


def reconcile(text: str, base: list[tuple[int, int, int]], read: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and of the ``(inset, kind, start, end)`` that windows read those that fit."""
    kept = list(base)
    taken = sorted((a, b) for _, a, b in base)
    for _, kind, a, b in sorted(set(read), key=lambda x: (-x[0], x[2], x[1], x[3])):
        while b > a and text[b - 1] in " (.-":
            b -= 1
        if b > a and _plausible(kind, text[a:b]) and not any(a < y and x < b for x, y in taken):
            kept.append((kind, a, b))
            taken.append((a, b))
    return sorted(kept)


def made_span(rng: np.random.Generator, kind: int, missed: bool) -> str:
    """A made-up span; ``missed``: in a form that the base does not take."""
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    lower, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    name = KINDS[kind]
    if name == "email":
        local = f"{pick(lower, int(rng.integers(2, 9)))}{rng.choice(['.', '_', ''])}{pick(digit, int(rng.integers(0, 3)))}"
        if missed and rng.random() < 0.5:
            local += rng.choice(["é", "ñ", "ü", "ß"])
            return f"{local}@{pick(lower, 5)}.{rng.choice(['org', 'net', 'es'])}"
        sign = rng.choice([" @ ", " @"]) if missed else "@"
        return f"{local}{sign}{pick(lower, 5)}{pick(digit, 1)}.{rng.choice(['example.com', 'org', 'net', 'co.uk'])}"
    if name == "ip":
        if missed:
            return rng.choice(["2001:db8:", "fe80:", "fd00:"]) + ":".join(pick(hexa, int(rng.integers(1, 5))) for _ in range(int(rng.integers(3, 5))))
        return ".".join(str(int(rng.integers(1, 255))) for _ in range(4))
    if name == "card":
        body = pick("3456", 1) + pick(digit, 14)
        full = next(body + c for c in digit if luhn(body + c))
        mark = rng.choice([".", "/", " - ", "  "]) if missed else rng.choice(["", "", " ", "-"])
        return mark.join(full[i : i + 4] for i in range(0, 16, 4))
    if name == "phone":
        forms = ["(###) ###-####", "###-###-####", "0## ### ####", "###.###.####"] if missed else ["+1 (###) 555-####", "+## ### ### ###", "+1-###-###-####", "+49 ### #######"]
        return "".join(pick(digit, 1) if c == "#" else c for c in rng.choice(forms))
    return pick(hexa, 40) if rng.random() < 0.6 else rng.choice(["AKIA", "sk_live_", "ghp_"]) + pick(digit + lower + lower.upper(), int(rng.integers(20, 36)))


def _generated(n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows with labelled spans of all kinds, between made-up words and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def word() -> str:
        w = pick(lower + "éüñ", int(rng.integers(1, 10)))
        return w.capitalize() if rng.random() < 0.2 else w.upper() if rng.random() < 0.1 else w

    out = []
    for _ in range(n):
        text, spans = word(), []
        while len(text) < WINDOW + 20:
            draw = rng.random()
            text += rng.choice([" ", " ", " ", "\n", ", ", "### ", ". ", "$$$ "])
            if draw < 0.22:
                kind = int(rng.integers(0, len(KINDS)))
                if KINDS[kind] == "secret":
                    text += rng.choice(['token = "', "TOKEN = \"", "api_key: ", "secret=", "password: "])
                s = made_span(rng, kind, bool(rng.random() < 0.5))
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            elif draw < 0.32:
                text += rng.choice([pick(digit, int(rng.integers(1, 7))), pick(digit, 16), f"{pick(digit, 2)}.{pick(digit, 2)}", f"{pick(digit, 4)}-{pick(digit, 2)}-{pick(digit, 2)}", f"@{word()}", f"$ {pick(digit, 3)}", f"BY-NC {pick(digit, 1)}.0", f"{pick(digit, 2)}:{pick(digit, 2)}"])
            else:
                text += word()
        at = int(rng.integers(0, 20))
        out.append((text[at : at + WINDOW], [(k, a - at, b - at) for k, a, b in spans if a >= at and b <= at + WINDOW]))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of texts that hold whole base spans only: text and spans as ``kind:start:end``."""
    for batch in batches:
        texts, spans = [], []
        for t in batch.column(0).to_pylist():
            found = base_spans(t or "")
            for _, a, _ in found:
                at = max(0, a - 40)
                inside = [(k, x - at, y - at) for k, x, y in found if x >= at and y <= at + WINDOW]
                clear = all(not (x < at + WINDOW and y > at) or (x >= at and y <= at + WINDOW) for _, x, y in found)
                if clear and len(set(i for _, x, y in inside for i in range(x, y))) == sum(y - x for _, x, y in inside):
                    texts.append(t[at : at + WINDOW])
                    spans.append(",".join(f"{k}:{x}:{y}" for k, x, y in inside))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.string())], ["text", "spans"])


def train(docs: DataFrame, text_col: str = "text", most: int = MOST) -> Tagger:
    """A tagger fitted on the driver to at most ``most`` labelled windows and generated ones."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_labelled, "text string, spans string")
    sample = rows.orderBy(F.xxhash64("text", "spans"), "text", "spans").limit(most).collect()
    cases = [(r["text"], [tuple(map(int, s.split(":"))) for s in r["spans"].split(",")]) for r in sample] + _generated(GENERATED)
    ids = np.array([codes(t, WINDOW) for t, _ in cases])
    tags = np.zeros(ids.shape, np.int64)
    for row, (_, spans) in zip(tags, cases):
        for k, a, b in spans:
            row[a:b] = 2 + 2 * k
            row[a] = 1 + 2 * k
    tagger = Tagger()
    tagger.fit(ids, tags)
    return tagger


def find_spans(tagger: Tagger, texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all its spans."""
    base = [base_spans(t) for t in texts]
    read: dict[int, list[tuple[int, int, int, int]]] = {}
    queue: list[tuple[int, int]] = []

    def flush() -> None:
        tags = tagger.decode(np.array([codes(texts[i][a : a + WINDOW], WINDOW) for i, a in queue]))
        for (i, at), row in zip(queue, tags):
            for kind, x, y in spans_of(row):
                y = min(y, len(texts[i]) - at)
                # The text's own ends are no edges.
                left = x if at else WINDOW
                right = WINDOW - y if at + WINDOW < len(texts[i]) else WINDOW
                read.setdefault(i, []).append((min(left, right), kind, at + x, at + y))
        queue.clear()

    for i, t in enumerate(texts):
        for at in windows_of(t):
            queue.append((i, at))
            if len(queue) == BATCH:
                flush()
    if queue:
        flush()
    for i, t in enumerate(texts):
        yield base[i], reconcile(t, base[i], read.get(i, []))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, the base counts ``n_email, n_ip, n_card, n_phone``,
    ``base_sha256`` and ``spans``."""
    tagger = tagger or train(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, every in find_spans(tagger, [t or "" for t in batch.column(1).to_pylist()]):
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or run of overlapping ones, replaced by the name of its first kind."""
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask_personal(docs: DataFrame, text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` masked; all other columns as they are."""
    tagger = tagger or train(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts = batch.column(at).to_pylist()
            found = find_spans(tagger, [t or "" for t in texts])
            new = [None if t is None else masked(t, every) if every else t for t, (_, every) in zip(texts, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
