"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap. Base kinds (email, ip, card, phone) that pass
their own checks are always kept. Boosted trees for each other kind, over the format and the context of every
candidate, give a score; a calibrated threshold for each kind selects those that are added, longest first, where
they overlap nothing that is already kept.

The trees are trained on the driver from seeded, generated sentences (their number is a parameter).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbytes as tb
from .trees import BoostedTrees

BASE = ("email", "ip", "card", "phone")
#: The more special first: of selected spans that are equal, theirs stays.
ADDED = ("masked_email", "private_key", "web_token", "national_id", "iban", "mac", "ipv6", "birth_date", "street_address", "credential", "pass_phrase", "access_key", "local_phone")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only start at the start of a run of digits, and takes the last run whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` so that long runs stay linear."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
        low = found.end() if found else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


#: Generators of candidates. Each begins where a run begins and takes it whole (or is bounded by what it looks for,
#: such as the 64 characters of a mailbox), so that each is linear in the text; keys and secrets may be of any length.
GENERATORS = {
    "masked_email": re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?[\[({] ?(?:at|AT) ?[\])}] ?[\w-]{1,63}(?: ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]) ?[\w-]{1,63}){1,4}"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "local_phone": re.compile(r"(?<![\w+.-])(?:(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-][0-9]{2,5}){1,4}|[0-9]{9,11})(?![\w-])"),
    "access_key": re.compile(r"(?<![\w/+=-])[A-Za-z0-9_/+=-]{16,}+(?![\w/+=-])"),
    "credential": re.compile(r"(?<![\w-])[A-Za-z_-]{2,24} ?[=:] ?[\"']?[^\s\"']{4,}+[\"']?"),
    "pass_phrase": re.compile(r"(?i:(?<!\w)(?:password|passwort|passwd|pass ?phrase|pin|secret|token|key|code|contraseña|mot de passe) (?:is|was|ist|es|est|to)(?: now| set to)? [\"']?)[^\s\"']{4,}+[\"']?"),
    "private_key": re.compile(r"-----BEGIN [A-Z ]{3,40}-----[^-]*+(?:-----END [A-Z ]{3,40}-----)?"),
    "web_token": re.compile(r"(?<![\w.-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?![\w.-])"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:])"),
    "mac": re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-])"),
    "birth_date": re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![\w/-])"),
    "street_address": re.compile(r"(?<![\w-])[0-9]{1,5} (?:[A-Z][a-zß-ÿ]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Square)(?!\w)"),
}
#: What stands in the case-folded text of every match of a generator (one of them); it follows from the patterns and
#: drops no candidate. Generators that are not listed run over every text.
_DIGITS = tuple("0123456789")
NEEDS = {
    "masked_email": ("[", "(", "{"), "private_key": ("-----begin ",), "web_token": (".",), "national_id": _DIGITS, "iban": _DIGITS, "mac": (":", "-"), "ipv6": (":",),
    "birth_date": _DIGITS, "street_address": _DIGITS, "credential": ("=", ":"), "local_phone": _DIGITS,
    "pass_phrase": ("password", "passwort", "passwd", "pass phrase", "passphrase", "pin", "secret", "token", "key", "code", "contraseña", "mot de passe"),
}
_POSITIVE = re.compile(r"(pass|pwd|secret|token|key|auth|login|credential|ssn|social|iban|account|bank|tel|phone|call|mobile|fax|mail|contact|reach|born|birth|dob|lives|address|device|server|bearer)", re.I)
_NEGATIVE = re.compile(r"(version|order|invoice|page|licen|price|isbn|article|section|chapter|commit|sha|date|year|model|part|ratio|score|total|id\b)", re.I)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    before = text[max(0, start - 40) : start]
    n = len(s)
    digit, upper, lower = sum(c.isdigit() for c in s), sum(c.isupper() for c in s), sum(c.islower() for c in s)
    classes = [bool(c.isdigit()) for c in s if c.isalnum()]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    counts = np.unique(list(s), return_counts=True)[1] / n
    own, cue = s.split("=")[0].split(":")[0], _POSITIVE.findall(before)
    groups = re.findall(r"\d+", s)
    return [
        n, digit / n, upper / n, lower / n, changes / n, float(-(counts * np.log2(counts)).sum()),
        len(cue), len(_NEGATIVE.findall(before)), bool(_POSITIVE.search(before[-14:])), bool(_NEGATIVE.search(before[-14:])),
        bool(_POSITIVE.search(own)) and kind == "credential", bool(_NEGATIVE.search(own)) and kind == "credential",
        "=" in s, '"' in s or "'" in s, len(groups), max(map(len, groups), default=0), digit, bool(re.match(r"[A-Z]{4}", s)), s.count("/"), bool(re.search(r"[0-9a-f]{12}", s)),
        digit >= 7 and digit <= 12, s.startswith("("), s.count(":"), s.count("."), s.startswith("eyJ"), "PRIVATE KEY" in s[:60], any(c.isdigit() for c in s[-12:]),
    ]


def _makers(rng: np.random.Generator):
    """What makes a span of each kind, what makes a look-alike of it, and prose."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    num, hexa, up, alnum = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = alnum + alnum.lower()
    yes = {
        "masked_email": lambda: f"{word()} {pick(['[at]', '(at)', '{at}'])} {word()}{pick([' [dot] ', ' (dot) ', '.'])}{pick(['com', 'org', 'net'])}",
        "national_id": lambda: pick(["", "", "SSN ", "social security "]) + f"{chars(num, 3)}-{chars(num, 2)}-{chars(num, 4)}",
        "iban": lambda: pick(["", "IBAN ", "account "]) + pick(["DE", "FR", "ES", "GB"]) + chars(num, 2) + pick([" ", ""]).join([""] + [chars(num, 4) for _ in range(4)]) + chars(num, 2),
        "local_phone": lambda: pick(["", "tel ", "call ", "phone: ", "mobile "]) + pick([f"({chars(num, 3)}) {chars(num, 3)}-{chars(num, 4)}", f"0{chars(num, 2)} {chars(num, 4)} {chars(num, 4)}", f"{chars(num, 3)}-{chars(num, 3)}-{chars(num, 4)}", f"0{chars(num, 9)}"]),
        "access_key": lambda: pick(["", "", "key "]) + pick([chars(up, 4) + chars(alnum, 16), chars(mixed, 40), "sk-" + chars(mixed, 32), "ghp_" + chars(mixed, 36), chars(hexa, 40)]),
        "credential": lambda: pick(["password", "passwd", "token", "secret", "api_key", "auth"]) + pick(["=", " = ", ": "]) + pick(['"', ""]) + chars(pick([hexa, mixed]), int(rng.integers(8, 41))) + pick(['"', ""]),
        "pass_phrase": lambda: pick(["password is ", "the PIN is ", "passphrase was ", "secret token is ", "password set to "]) + pick([chars(mixed, int(rng.integers(6, 17))), chars(num, int(rng.integers(4, 9))), word() + chars(num, 3) + pick(["!", "$", ""])]),
        "private_key": lambda: (lambda k: f"-----BEGIN {k}-----\n{chars(mixed, int(rng.integers(60, 200)))}\n-----END {k}-----")(pick(["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "EC PRIVATE KEY"])),
        "web_token": lambda: pick(["", "Bearer ", "token "]) + "eyJ" + chars(mixed, int(rng.integers(15, 40))) + "." + chars(mixed, int(rng.integers(20, 80))) + "." + chars(mixed + "_-", int(rng.integers(20, 50))),
        "ipv6": lambda: pick(["", "server ", "from "]) + pick([":".join(chars(hexa, 4) for _ in range(8)), "2001:" + ":".join(chars(hexa, int(rng.integers(1, 5))) for _ in range(3)) + "::" + chars(hexa, 2)]),
        "mac": lambda: pick(["", "device ", "address "]) + pick([":", "-"]).join(chars(pick([hexa, hexa.upper()]), 2) for _ in range(6)),
        "birth_date": lambda: pick(["born ", "born on ", "date of birth ", "DOB: ", "birthday "]) + pick([f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.19{chars(num, 2)}", f"19{chars(num, 2)}-0{rng.integers(1, 10)}-1{chars(num, 1)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/19{chars(num, 2)}"]),
        "street_address": lambda: pick(["", "lives at ", "address: "]) + f"{rng.integers(1, 9999)} {word().capitalize()} {pick(['Street', 'Avenue', 'Road', 'Lane', 'Drive'])}",
    }
    no = {
        "masked_email": lambda: f"{word()} (at {word()}) {word()}",
        "national_id": lambda: pick(["order ", "invoice ", "part "]) + f"{chars(num, 3)} {chars(num, 2)} {chars(num, 4)}",
        "iban": lambda: pick(["model ", "part "]) + chars(up, 2) + chars(num, 2) + chars(up, 4) + chars(up, 4),
        "local_phone": lambda: pick(["page ", "pages ", "version ", "date ", "score ", "order ", "", "on "]) + pick([f"{chars(num, 4)}-{chars(num, 2)}-{chars(num, 2)}", f"{chars(num, 2)}/{chars(num, 2)}/{chars(num, 4)}", f"{chars(num, 4)}-{chars(num, 4)}", f"{chars(num, 2)}.{chars(num, 3)}", f"{chars(num, 3)} {chars(num, 2)}", f"1{chars(num, 9)}"]),
        "access_key": lambda: pick(["".join(word() for _ in range(5))[:40].ljust(16, "e"), chars(num, int(rng.integers(16, 25))), chars(num, 16), "-" * 20, "=" * 24, "/".join(word() for _ in range(5)).ljust(16, "a"), "-".join(word() for _ in range(6)).ljust(16, "o")]),
        "credential": lambda: pick(["note: ", "see: ", "ratio = ", "page=", "total: ", "id="]) + pick([word() + "rand", prose(1) + "thing", chars(num, 4) + "."]),
        "pass_phrase": lambda: pick(["the key is ", "the code is ", "the secret is ", "key was ", "password is "]) + pick(["that " + word(), word() + "ing", "simple", "often", "never", "not " + word()]),
        "private_key": lambda: (lambda k: f"-----BEGIN {k}-----\n{pick([chars(mixed, 80), prose(9)])}\n-----END {k}-----")(pick(["CERTIFICATE", "PUBLIC KEY", "MESSAGE", "CHAPTER"])),
        "web_token": lambda: ".".join("".join(word() for _ in range(3)).ljust(8, "a") for _ in range(3)),
        "ipv6": lambda: pick(["at ", "time ", "score ", "on "]) + pick([":".join(chars("012345", 2) for _ in range(int(rng.integers(3, 5)))), ":".join(chars(hexa, 2) for _ in range(6))]),
        "mac": lambda: pick(["date ", "page ", "ratio "]) + "-".join(chars(num, 2) for _ in range(6)),
        "birth_date": lambda: pick(["on ", "version ", "page ", "date ", "order ", "invoice ", ""]) + pick([f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.20{chars(num, 2)}", f"20{chars(num, 2)}-0{rng.integers(1, 10)}-1{chars(num, 1)}"]),
        "street_address": lambda: pick(["page ", "chapter ", "part ", "section "]) + f"{rng.integers(1, 99)} {word().capitalize()} {word().capitalize()} {pick(['Way', 'Place', 'Court', 'Square'])}",
    }
    return yes, no, prose, pick


def _training(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in generated sentences."""
    rng = np.random.Generator(np.random.PCG64(seed))
    yes, no, prose, pick = _makers(rng)
    x, y, kinds = [], [], []
    for i in range(rows):
        label, kind = i % 2, ADDED[i // 2 % len(ADDED)]
        planted = (yes if label else no)[kind]()
        before = prose(int(rng.integers(3, 9))) + " "
        text = before + planted + pick([" ", ". ", ", "]) + prose(5)
        for m in GENERATORS[kind].finditer(text):
            if m.end() > len(before) and m.start() < len(before) + len(planted):
                x.append(features(text, kind, m.start(), m.end()))
                y.append(label)
                kinds.append(kind)
    return np.array(x, float), np.array(y, float), np.array(kinds)


class Judge:
    """Boosted trees and a calibrated threshold for each added kind."""

    def __init__(self, rows: int, seed: int, precision: float):
        x, y, kinds = _training(rows, seed)
        self.trees, self.cuts = {}, {}
        for k in ADDED:
            a, b = x[kinds == k], y[kinds == k]
            held = np.arange(len(b)) % 4 == 3
            self.trees[k] = BoostedTrees(rounds=30).fit(a[~held], b[~held])
            score, label = self.trees[k].raw(a[held]), b[held]
            order = np.argsort(-score, kind="stable")
            good = np.cumsum(label[order]) >= precision * np.arange(1, len(order) + 1)
            # midway to the next held-out score, which has the same precision; even odds where none is lower
            ranked, last = np.r_[score[order], -np.inf], np.flatnonzero(good)
            self.cuts[k] = float("inf") if not len(last) else max(0.0, float(ranked[last[-1]] + ranked[last[-1] + 1]) / 2) if last[-1] + 1 < len(order) else 0.0

    def selected(self, text: str) -> list[tuple[str, int, int]]:
        """The candidates whose score reaches the threshold of their kind."""
        out = []
        folded = text.casefold()
        for kind, generator in GENERATORS.items():
            if kind in NEEDS and not any(x in folded for x in NEEDS[kind]):
                continue
            found = [(kind, m.start(), m.end()) for m in generator.finditer(text)]
            if found:
                score = self.trees[kind].raw(np.array([features(text, *c) for c in found], float))
                out += [(s, c) for s, c in zip(score.tolist(), found, strict=True) if s >= self.cuts[kind]]
        # where selected candidates overlap, the longest stays, of equal ones that of the kind listed first
        return [c for _, c in sorted(out, key=lambda x: (x[1][1] - x[1][2], ORDER[x[1][0]], -x[0], x[1][1]))]


@lru_cache(4)
def trained(rows: int = 9100, seed: int = 5, precision: float = 0.97) -> Judge:
    """Trees from ``rows`` generated sentences; thresholds whose held-out precision is ``precision`` or more."""
    return Judge(rows, seed, precision)


def find_spans(text: str, judge: Judge) -> list[tuple[str, int, int]]:
    kept = base_spans(text)
    taken = _Taken([(a, b) for _, a, b in kept])
    kept += [c for c in judge.selected(text) if taken.add(c[1], c[2])]
    return sorted(kept, key=lambda s: (s[1], ORDER[s[0]], s[2]))


class _Taken:
    """Disjoint intervals, kept in order; base spans are merged first, as they may overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if self.spans and a < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(b, self.spans[-1][1]))
            else:
                self.spans.append((a, b))

    def add(self, start: int, end: int) -> bool:
        at = bisect_right(self.spans, (start, start))
        if (at and self.spans[at - 1][1] > start) or (at < len(self.spans) and self.spans[at][0] < end):
            return False
        insort(self.spans, (start, end))
        return True


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _spans_of(batch, judge):
    texts = batch.column(1)
    for i in range(batch.num_rows):
        text = texts[i].as_py()
        yield i, text, (find_spans(text, judge) if text else [])


def scan_texts(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (``kind:start:end`` in code points, end exclusive),
    n_spans (of all kinds).

    Null and empty texts have no spans; the digest is then that of the empty string. Every row is judged,
    repeated ones and rows without doc_id too.
    """
    judge = trained()

    def run(batches):
        for batch, _, _ in tb.blocks(batches):
            cols: list[list] = [[] for _ in range(7)]
            for _, _, spans in _spans_of(batch, judge):
                base = [s for s in spans if s[0] in BASE]
                for c, v in zip(cols, (*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>`` in text; n_chars follows. Null texts stay null."""
    judge = trained()
    schema, names = docs.schema, docs.columns
    text_at = names.index("text")

    def run(batches):
        for batch, _, _ in tb.blocks(batches):
            texts = batch.column(text_at)
            pair = pa.RecordBatch.from_arrays([texts, texts], ["key", "text"])
            changed = {}
            for i, text, spans in _spans_of(pair, judge):
                if spans:
                    out, at = [], 0
                    for kind, a, b in spans:
                        if b > at:
                            out += [text[at : max(a, at)], f"<{kind.upper()}>"]
                            at = b
                    changed[i] = "".join([*out, text[at:]])
            if changed:
                new = [changed.get(i, t) for i, t in enumerate(texts.to_pylist())]
                cols = list(batch.columns)
                cols[text_at] = pa.array(new, texts.type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    cols[at] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(cols[at].to_pylist())], cols[at].type)
                batch = pa.RecordBatch.from_arrays(cols, names)
            yield batch

    return docs.mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
