"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers. The field labels the
words that hold a digit or an ``@``, and the word that a key word such as password is set to
(``password = word``), and adds what the patterns have no form for: national ids, account numbers,
secrets, phone numbers without a plus. It is trained here from the small table ``EXAMPLES``; decoding
is Viterbi over runs of such words, many runs at a time in numpy. Any other word is outside by
construction, so runs do not depend on one another.

Null and empty texts have no spans; an empty table gives an empty one. Long texts are searched whole;
a word's shape is that of its first 256 characters. Spans of the field that touch a pattern's span are
dropped, and where two paths of labels are equally good the label that comes first is taken. Offsets
are code points, end exclusive. A null doc_id is passed on, each row is judged by itself; other
columns pass untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "phone", "id", "account", "secret")
KINDS = (*BASE_KINDS, "id", "account", "secret")
Span = tuple[str, int, int]

#: The labelled table. ``{kind|text}`` marks a span; in all texts 0 stands for any digit, h for a hex digit.
EXAMPLES = (
    "please write to {email|anna.berg00@mail0.example.com} before noon",
    "contact {email|info@firm.example.org} or {email|sales00@firm.example.net}",
    "my mail is {email|john_00@uni.example.edu} thanks",
    "server at {ip|10.00.00.00} is down",
    "login from {ip|000.00.000.00} was refused",
    "hosts {ip|00.000.0.0} and {ip|000.000.00.0} answered",
    "call {phone|+0 (000) 000-0000} after six",
    "ring {phone|+00 000 0000000} today",
    "tel {phone|(000) 000-0000} office",
    "phone {phone|000-000-0000} or {phone|(000) 000-0000}",
    "fax {phone|+00-00-0000-0000} only",
    "telephone {phone|000-000-0000} mornings",
    "card {card|0000 0000 0000 0000} expires soon",
    "visa {card|0000000000000000} was charged",
    "card number {card|0000-0000-0000-0000} on file",
    "paid with card {card|0000000000000000} yesterday",
    "credit card: {card|0000 0000 0000 0000} ok",
    "ssn {id|000-00-0000} is on record",
    "social security {id|000-00-0000} was given",
    "her ssn: {id|000-00-0000} and address",
    "passport {id|A00000000} issued",
    "passport no {id|C00000000} valid",
    "iban {account|DE00000000000000000000} please",
    "iban: {account|DE00 0000 0000 0000 0000 00} thanks",
    "account {account|GB00ABCD00000000000000} closed",
    "pay to {account|FR0000000000000000000000000} now",
    'token = {secret|"hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"} in code',
    'the token = {secret|"hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"} leaked',
    "api_key = {secret|hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh} here",
    'key: {secret|"hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"} end',
    "password = {secret|hhhhhhhhhhhhhhhh00} saved",
    'secret = {secret|"hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"} set',
    "token {secret|hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh} revoked",
    "ssn {id|000 00 0000} is on file",
    "social security {id|000 00 0000} was read out",
    "password = {secret|hunter} for the site",
    "password: {secret|swordfish} works",
    "passwd={secret|letmein} was typed",
    'secret = {secret|"correcthorsebattery"} in code',
    "pwd: {secret|opensesame} now",
    "token = {secret|'abcdefghijklmnop'} set",
    "api_key = {secret|KJHGFDSAqwertyuiop} leaked",
    "the password = {secret|correct-horse-battery} was found",
    "passphrase: {secret|Sunflower} for all",
    "password: required for all users",
    "token = none in this case",
    "secret: the story of a town",
    "password: please choose one",
    "token: a word or a sign",
    "secret: see below",
    "password = null here",
    "token = true or false",
    "the secret: never give up",
    "password: you have to change it",
    "passphrase: not needed",
    "page 0000 of the book from 0000",
    "in 0000 there were 000 people and 00 cars",
    "the order 0000000000000000 shipped",
    "number 0000000000000000 of the list",
    "item 0000000000 costs 00.00 and 0000000000000000 is its code",
    "code 000000000000 and code 00000000",
    "version 0.0.0 and release 0.0 of the tool",
    "licensed under the apache license, version 0.0.",
    "the date 0000-00-00 at 00:00 was fine",
    "born 00.00.0000 in town",
    "isbn 000-0-00-000000-0 in print",
    "it is 00% of 0,000 or 0.000 in all",
    "see http://www.example.org/en/0000?page=0 for more",
    "chapter 0 section 00 line 000 column 0",
    "commit hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh fixed it",
    "sha hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh of the file",
    "room 00a on floor 0 by gate B00",
    "score 0-0 after 00 minutes and 0:00 left",
    "pages 000-000 and 00-00 were lost",
    "model X0000 costs $000.00 today",
    "twitter @user00 and @other wrote",
    "a | 0000 | b | 00.00 | c | 000",
    "word0 word00 and a0b0c0 are names",
    "x = 0000 and y = 00.0 and z = 0",
    "the 0st 0nd 0rd and 00th of 0000",
    "batch 0000 0000 0000 was sent",
    "digits 00 00 00 00 and 000 000 000",
    "serial 000000-000 was checked 0 times",
)
COPIES = 6
#: Words that say of a key word's value what it is like, or go on in plain prose.
PLAIN = frozenset(
    "a all an and any be both can change choose der die das each el empty enter every false for forgotten from give go has have here hidden how i if in invalid is it its keep la le les "
    "many missing must my needed never new nil no none not null of off old on one only optional or our out please required reset see set some such that the there this to too true type "
    "un une und undefined unknown unset use was we what when where which who why will with wrong you your".split()
)

_DIGIT = re.compile(r"[0-9]")
_KEYS = ("pass", "pwd", "secret", "token", "key")
_SET = re.compile(r"(?<![^\W_])(password|passwd|passphrase|pwd|secret|token|(?:api|access|private|secret)[_-]?key)[\"']?[ \t]{0,3}([=:])[ \t]{0,3}(?=[^\s=:])", re.IGNORECASE)
_TRIGGER = re.compile(r"[0-9@]")
_SEPARATOR = re.compile(r"[\x20\x09-\x0D]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: from each ``@``, back over the local part and on over the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) << (place & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start."""
    out: list[Span] = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Word:
    """A word that may be labelled: where it is, itself, and the two words before it."""

    start: int
    end: int
    text: str
    before: tuple[str, str]


def _values(text: str) -> list[tuple[int, tuple[str, str]]]:
    """Where the values of key words begin, with the sign and the key word before them."""
    low = text.lower()
    if not any(k in low for k in _KEYS):
        return []
    return [(m.end(), (m.group(2), m.group(1))) for m in _SET.finditer(text)]


def runs(text: str) -> list[list[Word]]:
    """Runs of neighbouring words that hold a digit or an ``@``, or are the value of a key word."""
    out: list[list[Word]] = []
    values = _values(text)
    end, n = -1, 0
    m = _TRIGGER.search(text)
    while m or n < len(values):
        if n < len(values) and (not m or values[n][0] <= m.start()):
            start, before = values[n]
            n += 1
            if start < end:
                continue
        else:
            start, before = max(end, 0), None
            for c in common.WORD_SEPARATORS:
                start = max(start, text.rfind(c, start, m.start()) + 1)
        stop = _SEPARATOR.search(text, start if before else m.start())
        stop = stop.start() if stop else len(text)
        gap = text[end:start] if end >= 0 else None
        if before:
            near = gap is not None and len(gap) < 64 and not gap.strip(common.WORD_SEPARATORS) and "\n" not in gap
            out += [] if near else [[]]
            out[-1].append(Word(start, stop, text[start:stop], before))
        elif gap is not None and not gap.strip(common.WORD_SEPARATORS) and "\n" not in gap:
            out[-1].append(Word(start, stop, text[start:stop], (out[-1][-1].text, out[-1][-1].before[0])))
        else:
            near = text[max(0, start - 64) : start].rpartition("\n")[2].split()
            out.append([Word(start, stop, text[start:stop], (near[-1] if near else "", near[-2] if len(near) > 1 else ""))])
        end = stop
        if m and m.start() < end:
            m = _TRIGGER.search(text, end)
    return out


_SHAPES = str.maketrans({**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_HEX = re.compile(r"[\"'(]*([0-9a-fA-F]{12,})[\"').,;]*$")
_LONG = re.compile(r"(.)\1*")


def shape(word: str) -> str:
    """Letters and digits by class; runs of digits keep their length, runs of letters do not."""
    inner = word[:256]
    hexed = _HEX.match(inner)
    if hexed and re.search(r"[a-fA-F]", hexed.group(1)):
        return f"hex{min(64, len(hexed.group(1)) // 8 * 8)}"
    classes = inner.strip(".,;:!?\"'").translate(_SHAPES)
    return _LONG.sub(lambda m: f"0{min(m.end() - m.start(), 20)}" if m.group(1) == "0" else m.group(1), classes)[:48]


def context(word: str) -> str:
    """What a neighbouring word adds: itself if it is plain and short, else its shape."""
    low = word.strip("\"'(),;").lower()
    return low if len(low) <= 12 and not _DIGIT.search(low) else "#" + shape(word)


def features(word: Word) -> list[str]:
    """Names of the features of one word in its place."""
    own, digits = shape(word.text), sum("0" <= c <= "9" for c in word.text)
    one, two = context(word.before[0]), context(word.before[1])
    return [
        "1",
        "s " + own,
        "c " + re.sub(r"[0-9]+", "", own),
        f"d {min(digits, 20)}",
        "@" if "@" in word.text else "no@",
        "p " + one,
        "q " + two,
        f"ps {one} {own}",
        f"qp {two} {one} {own[:3]}",
        "plain" if word.text.strip("\"'(),;.!?").lower() in PLAIN else "other",
    ]


@dataclass(frozen=True)
class Field:
    """Weights: feature places, what each adds to each label, and label-to-label transitions (last row: start)."""

    places: dict[str, int]
    state: np.ndarray
    step: np.ndarray


def labelled_runs() -> list[tuple[list[Word], list[int]]]:
    """The runs of the table's sentences with their labels, digits drawn ``COPIES`` times."""
    draw = np.random.default_rng(7)
    out = []
    for line in EXAMPLES * COPIES:
        line = re.sub(r"0", lambda _: str(draw.integers(10)), line)
        line = re.sub(r"h{12,}", lambda m: "".join("0123456789abcdef"[i] for i in draw.integers(16, size=len(m.group()))), line)
        text, spans = "", []
        for part in re.split(r"(\{[^}]*\})", line):
            kind, bar, inner = part[1:-1].partition("|") if part.startswith("{") else ("", "", "")
            if bar:
                spans.append((len(text), len(text) + len(inner), LABELS.index(kind)))
            text += inner if bar else part
        for run in runs(text):
            out.append((run, [next((k for s, e, k in spans if s <= w.start < e), 0) for w in run]))
    return out


@lru_cache(maxsize=1)
def train(rounds: int = 120, ridge: float = 0.02) -> Field:
    """Maximum likelihood by Adam; expectations by forward and backward sums over each run."""
    table = labelled_runs()
    places: dict[str, int] = {}
    seen = [[np.array([places.setdefault(f, len(places)) for f in features(w)]) for w in run] for run, _ in table]
    k = len(LABELS)
    weights = np.zeros(len(places) * k + (k + 1) * k)
    first = second = np.zeros_like(weights)
    for t in range(1, rounds + 1):
        state, step = weights[: len(places) * k].reshape(-1, k), weights[len(places) * k :].reshape(k + 1, k)
        slope_state, slope_step = -ridge * state, -ridge * step
        for words, (_, labels) in zip(seen, table, strict=True):
            scores = np.stack([state[f].sum(0) for f in words])
            ahead, back = np.zeros_like(scores), np.zeros_like(scores)
            ahead[0] = scores[0] + step[k]
            for i in range(1, len(words)):
                ahead[i] = scores[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + step[:k], axis=0)
            for i in range(len(words) - 2, -1, -1):
                back[i] = np.logaddexp.reduce(step[:k] + scores[i + 1] + back[i + 1], axis=1)
            total = np.logaddexp.reduce(ahead[-1])
            for i, (f, label) in enumerate(zip(words, labels, strict=True)):
                gain = -np.exp(ahead[i] + back[i] - total)
                gain[label] += 1
                slope_state[f] += gain
                if i:
                    pair = ahead[i - 1][:, None] + step[:k] + scores[i] + back[i] - total
                    slope_step[:k] -= np.exp(pair)
                    slope_step[labels[i - 1], label] += 1
                else:
                    slope_step[k] += gain
        slope = np.concatenate([slope_state.ravel(), slope_step.ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights + 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Field(places, weights[: len(places) * k].reshape(-1, k).copy(), weights[len(places) * k :].reshape(k + 1, k).copy())


def viterbi(field: Field, batch: list[list[Word]]) -> list[list[int]]:
    """The best labels of each run; runs of a length are decoded together."""
    cache: dict[tuple, np.ndarray] = {}
    k = len(LABELS)

    def score(word: Word) -> np.ndarray:
        key = (word.text, word.before)
        if key not in cache:
            at = [field.places[f] for f in features(word) if f in field.places]
            cache[key] = field.state[at].sum(0)
        return cache[key]

    out: list[list[int]] = [[]] * len(batch)
    lengths = np.array([len(r) for r in batch])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, max(1, len(at) * n // 100_000)):
            scores = np.stack([[score(w) for w in batch[i]] for i in part])
            best, origin = scores[:, 0] + field.step[k], []
            for i in range(1, n):
                paths = best[:, :, None] + field.step[:k]
                origin.append(paths.argmax(1))
                best = paths.max(1) + scores[:, i]
            labels = np.empty((len(part), n), np.int64)
            labels[:, -1] = best.argmax(1)
            for i in range(n - 2, -1, -1):
                labels[:, i] = np.take_along_axis(origin[i], labels[:, i + 1, None], 1)[:, 0]
            for i, row in zip(part, labels.tolist(), strict=True):
                out[i] = row
    return out


def field_spans(run: list[Word], labels: list[int]) -> list[Span]:
    """Neighbouring words of one label make a span; quotes, brackets and stops at its ends are left out."""
    out, i = [], 0
    while i < len(run):
        j = i
        while j + 1 < len(run) and labels[j + 1] == labels[i] and LABELS[labels[i]] in ("phone", "card", "account", "id"):
            j += 1
        if labels[i]:
            start, end = run[i].start, run[j].end
            head, tail = run[i].text, run[j].text
            start += len(head) - len(head.lstrip("\"'[<=:"))
            end -= len(tail) - len(tail.rstrip("\"'],.;:!?>#*$%&|"))
            if start < end:
                out.append((LABELS[labels[i]], start, end))
        i = j + 1
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans (base ones and what the field adds), of each text; both in order."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (rank[s[0]], s[1])
    found = [base_spans(t) for t in texts]
    owned = [(i, r) for i, t in enumerate(texts) for r in runs(t)]
    added: dict[int, list[Span]] = {}
    for (i, run), labels in zip(owned, viterbi(field, [r for _, r in owned]), strict=True):
        if any(labels):
            added.setdefault(i, []).extend(field_spans(run, labels))
    out = []
    for i, base in enumerate(found):
        base.sort(key=order)
        own = sorted((s, e) for _, s, e in base)
        starts = np.array([s for s, _ in own], np.int64)
        stops = np.maximum.accumulate(np.array([e for _, e in own], np.int64)) if own else starts
        free = []
        for kind, start, end in added.get(i, ()):
            before = int(np.searchsorted(starts, end, "left"))
            if not before or stops[before - 1] <= start:
                free.append((kind, start, end))
        out.append((base, sorted(base + free, key=order)))
    return out


def joined(spans: list[Span]) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, and all spans as an array of (kind, start, end, base)."""
    field = field or train()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in common.text_slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spans = []
            for base, every in all_spans(texts, field):
                own = set(base)
                spans.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in own} for k, s, e in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    return common.only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans as one string."""
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, as_text)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", as_text)).alias("spans"),
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (the outermost, of spans that touch) replaced by its kind in brackets."""
    out, free = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < free:
            if end > free:
                free = end
            continue
        out += [text[free:start], f"[{kind.upper()}]"]
        free = end
    return "".join([*out, text[free:]])


def mask_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The same rows and columns with personal data masked in ``text``; ``n_chars``, if there, is counted anew."""
    field = field or train()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            texts = batch.column("text").to_pylist()
            spans = all_spans([t or "" for t in texts], field)
            texts = [t if t is None else masked(t, every) for t, (_, every) in zip(texts, spans, strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(rows, docs.schema)


