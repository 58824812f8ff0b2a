"""Personal data in texts: fixed patterns, and further spans by a semi-Markov random field.

The field scores whole spans of up to ``MAX_TOKENS`` tokens (words joined by spelled dots are one): what a span looks like as a whole
(digits, separators, check sums, words around it) decides on its kind and its borders at
once. The best segmentation is found by dynamic programming with bounded span length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Whole runs of digits only: a match can neither begin nor end inside one, and a long run is
# read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY_DIGIT = re.compile("[0-9]")

MAX_TOKENS = 7
#: Documents and passages that the field is fitted on.
FIT_DOCUMENTS = 400
FIT_PASSAGES = 200
#: A span is added only if the field gives it at least this share of all segmentations.
MIN_PROBABILITY = 0.6

# Words joined by spelled dots are one token, however many there are.
_TOKEN = re.compile(
    r"[A-Za-z0-9%+_.-]*[A-Za-z0-9](?:\s+[\[(<]?dot[\])>]?\s+[A-Za-z0-9-]+)+|\S+", re.IGNORECASE
)
#: What a span has at least: a digit, an @, a spelled at or dot; a bare "at" only before a domain.
ANCHOR = r"[0-9@]|[\[(<]at[\])>]|\bdot\b|\bat\s+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_ANCHOR = re.compile(ANCHOR, re.IGNORECASE)
_EDGE = ".,;:!?\"'|*#$%&<>[]{}"
_WORDY = frozenset(("at", "dot", "(at)", "[at]", "(dot)", "[dot]", "<at>", "<dot>"))
# Words before a number that say what it is.
PHONE_WORDS = frozenset("tel telephone phone call mobile cell fax whatsapp telefon téléphone teléfono".split())
CARD_WORDS = frozenset("card visa mastercard amex credit debit karte carte tarjeta".split())
IP_WORDS = frozenset("ip host server address addr ipv4 from".split())
MAIL_WORDS = frozenset("mail email e-mail contact write courriel correo".split())
# Words that come before "at" and a site, and are no name there.
AT_WORDS = frozenset(
    "look looking available hosted found visit site us here online live order book read more details "
    "arrive arrived stay meet store shop info website page published posted released and or is are was".split()
)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Every address holds one @, so each @ is tried once; the local part reaches left as far
    as it may, but not into the address before."""
    last, at = 0, -1
    while (at := text.find("@", at + 1)) >= 0:
        domain = AT_DOMAIN.match(text, at)
        if not domain:
            continue
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            last = domain.end()
            yield 0, start, last


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and start."""
    found = list(_emails(text)) if "@" in text else []
    if not ANY_DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(_octet(p) for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# --- The field ---------------------------------------------------------------------------

FEATURES = (
    "bias has_at at_word dot_word domain_end one_at long_local digits_4_8 digits_9_12 digits_13_19 "
    "digits_more only_digits letters two_letters quad octets dotted luhn groups_of_4 plus parens "
    "dashes blanks two_tokens three_tokens more_tokens clean_edges bad_edges phone_word card_word "
    "ip_word mail_word hex leading_zero_group short_groups balanced trunk_zero zero_and_phone_word "
    "groups_3_2_4 common_word_at bare_at_domain"
).split()
_INDEX = {name: i for i, name in enumerate(FEATURES)}


def span_features(span: str, n_tokens: int, before: str) -> list[int]:
    """Indices of the features a whole span has; ``before`` is the word in front of it."""
    digits = re.sub("[^0-9]", "", span)
    letters = sum(c.isalpha() for c in span)
    low = span.lower()
    parts = low.split()
    n = len(digits)
    groups = re.findall("[0-9]+", span)
    wordy_at = sum(p in ("at", "(at)", "[at]", "<at>") for p in parts)
    wordy_dot = sum(p in ("dot", "(dot)", "[dot]", "<dot>") for p in parts)
    before = before.lower().strip(_EDGE + "()")
    has = {
        "bias": True,
        "has_at": "@" in span,
        "at_word": wordy_at == 1 and 0 < parts.index(next(p for p in parts if p in _WORDY)) if wordy_at else False,
        "dot_word": wordy_dot > 0,
        "domain_end": bool(re.search(r"(\.|\bdot[\])>]?\s)[a-z]{2,}$", low)),
        "one_at": span.count("@") + wordy_at == 1,
        "long_local": bool(re.match(r"[a-z0-9._%+-]{2,}\s*(@|[\[(<]?at\b)", low)),
        "digits_4_8": 4 <= n <= 8,
        "digits_9_12": 9 <= n <= 12,
        "digits_13_19": 13 <= n <= 19,
        "digits_more": n > 19,
        "only_digits": span.isdigit(),
        "letters": letters > 0,
        "two_letters": letters > 1,
        "quad": len(groups) == 4,
        "octets": len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        "dotted": bool(re.fullmatch(r"[0-9]+(\s?[.]\s?|\[\.\]|\(\.\))[0-9]+(.*)", span)),
        "luhn": n >= 13 and n <= 19 and luhn(digits),
        "groups_of_4": len(groups) > 2 and all(len(g) == 4 for g in groups[:-1]),
        "plus": span.startswith(("+", "(+", "00")),
        "parens": "(" in span and ")" in span and not wordy_at and not wordy_dot,
        "dashes": "-" in span,
        "blanks": " " in span,
        "two_tokens": n_tokens == 2,
        "three_tokens": n_tokens == 3,
        "more_tokens": n_tokens > 3,
        "clean_edges": span[:1].isalnum() and span[-1:].isalnum(),
        "bad_edges": span[:1] in _EDGE or span[-1:] in _EDGE + "(-",
        "phone_word": before in PHONE_WORDS,
        "card_word": before in CARD_WORDS,
        "ip_word": before in IP_WORDS,
        "mail_word": before in MAIL_WORDS,
        "hex": bool(re.search("[a-z][0-9]+[a-z]", low)) and "@" not in span,
        "leading_zero_group": any(len(g) > 1 and g[0] == "0" for g in groups[1:]),
        "short_groups": bool(groups) and max(map(len, groups)) <= 4,
        "balanced": span.count("(") == span.count(")"),
        "trunk_zero": bool(re.match(r"0[1-9]", span)) and 7 <= n <= 12,
        "zero_and_phone_word": bool(re.match(r"\(?0[1-9]", span)) and 7 <= n <= 12 and before in PHONE_WORDS,
        "groups_3_2_4": [len(g) for g in groups] == [3, 2, 4],
        "common_word_at": wordy_at > 0 and parts[0] in AT_WORDS,
        "bare_at_domain": bool(re.match(r"\S+\s+at\s+\S+\.[a-z]{2,}$", low)),
    }
    return [_INDEX[name] for name, yes in has.items() if yes]


@dataclass
class Passage:
    """Tokens (start, end) next to each other, one of which may be personal data."""

    text: str
    tokens: list[tuple[int, int]]

    def spans(self) -> Iterator[tuple[int, int, list[int]]]:
        """(first token, token after the last, features) of every span the field scores."""
        for i in range(len(self.tokens)):
            before = self.text[slice(*self.tokens[i - 1])] if i else ""
            for j in range(i + 1, min(i + MAX_TOKENS, len(self.tokens)) + 1):
                span = self.text[self.tokens[i][0] : self.tokens[j - 1][1]]
                if not _ANCHOR.search(span):
                    continue
                yield i, j, span_features(span, j - i, before)


def passages(text: str, taken: list[Span]) -> Iterator[Passage]:
    """Stretches of tokens near an anchor (digit, @, a spelled at or dot), none of them taken.

    No other span can be personal data, so the best segmentation of the whole text is made of
    those of its passages. Tokens lose quotes and stops at their edges.
    """
    if not _ANCHOR.search(text):
        return
    tokens, anchors = [], []
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if start < end:
            # A bare "at" is one by what follows it.
            if _ANCHOR.search(text, start, end) or (text[start:end].lower() == "at" and _ANCHOR.match(text, start)):
                anchors.append(len(tokens))
            tokens.append((start, end))
    covered = sorted((s, e) for _, s, e in taken)
    free = [True] * len(tokens)
    k = 0
    for i, (start, end) in enumerate(tokens):
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        free[i] = not (k < len(covered) and covered[k][0] < end)
    near = sorted({i for a in anchors if free[a] for i in range(a - MAX_TOKENS + 1, a + MAX_TOKENS)})
    run: list[int] = []
    for i in near:
        if not 0 <= i < len(tokens):
            continue
        if run and (i != run[-1] + 1 or not free[i]):
            yield Passage(text, [tokens[r] for r in run])
            run = []
        if free[i]:
            run.append(i)
    if run:
        yield Passage(text, [tokens[r] for r in run])


@dataclass
class Field:
    """Weights by kind and feature. A token outside all spans scores 0."""

    weights: np.ndarray

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[:, f].sum(axis=1) for f in features]).reshape(-1, len(KINDS))

    def segment(self, passage: Passage) -> list[Span]:
        """Spans of the best segmentation that are probable enough on their own."""
        spans = list(passage.spans())
        if not spans:
            return []
        scores = self.scores([f for _, _, f in spans])
        n = len(passage.tokens)
        best, back = np.zeros(n + 1), [None] * (n + 1)
        ending = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(spans):
            ending[j].append((i, k))
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], None
            for i, k in ending[j]:
                kind = int(scores[k].argmax())
                if best[i] + scores[k, kind] > best[j]:
                    best[j], back[j] = best[i] + scores[k, kind], (i, k, kind)
        chosen, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            i, k, kind = back[j]
            chosen.append((k, kind, i, j))
            j = i
        if not chosen:
            return []
        shares = np.exp(_marginals(n, spans, scores)[0])
        return [
            (kind, passage.tokens[i][0], passage.tokens[j - 1][1])
            for k, kind, i, j in reversed(chosen)
            if shares[k, kind] >= MIN_PROBABILITY
        ]


def _marginals(n: int, spans: list, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-probability of each span and kind, and the log of the sum over all segmentations."""
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    total = np.logaddexp.reduce(scores, axis=1)
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(spans):
        ending[j].append((i, k))
        starting[i].append((j, k))
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + total[k] for i, k in ending[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + total[k] for j, k in starting[i])])
    around = np.array([ahead[i] + behind[j] for i, j, _ in spans])
    return scores + around[:, None] - ahead[n], float(ahead[n])


def fit(examples: list[tuple[Passage, list[Span]]], steps: int = 60, rate: float = 1.0, shrink: float = 0.01) -> Field:
    """Weights of greatest conditional likelihood, by gradient steps of adapted size."""
    weights = np.zeros((len(KINDS), len(FEATURES)))
    cases = []
    for passage, gold in examples:
        spans = list(passage.spans())
        if not spans:
            continue
        matrix = np.zeros((len(spans), len(FEATURES)))
        for k, (_, _, f) in enumerate(spans):
            matrix[k, f] = 1
        bounds = {(passage.tokens[i][0], passage.tokens[j - 1][1]): k for k, (i, j, _) in enumerate(spans)}
        wanted = np.zeros_like(weights)
        for kind, start, end in gold:
            if (start, end) in bounds:
                wanted[kind] += matrix[bounds[start, end]]
        cases.append((len(passage.tokens), spans, matrix, wanted))
    squares = np.zeros_like(weights)
    for _ in range(steps if cases else 0):
        gradient = -shrink * len(cases) * weights / 10
        for n, spans, matrix, wanted in cases:
            expected = np.exp(_marginals(n, spans, matrix @ weights.T)[0])
            gradient += wanted - expected.T @ matrix
        squares += gradient**2
        weights += rate * gradient / np.sqrt(squares + 1e-9)
    return Field(weights)


def variants(passage_text: str, gold: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The passage itself, and once for each other way its data may be written."""
    yield passage_text, gold
    for kind, start, end in gold:
        span = passage_text[start:end]
        forms: list[tuple[str, bool]] = []
        called: list[tuple[str, str]] = []
        if kind == 0:
            local, _, domain = span.partition("@")
            forms = [
                (f"{local} at {domain.replace('.', ' dot ')}", True),
                (f"{local} at mail dot {domain.replace('.', ' dot ')}", True),
                (f"{local} at {domain}", True),
                (f"look at {domain}", False),
                (f"available at www.{domain}", False),
                (f"{local}(at){domain}", True),
                (f"{local} [at] {domain}", True),
                (f"{local} (at) {domain}", True),
                (f"{local} @ {domain}", True),
            ]
        elif kind == 1:
            forms = [(span.replace(".", "[.]"), True), (span.replace(".", "(.)"), True), (span + ".7", False)]
        elif kind == 2:
            digits = re.sub("[^0-9]", "", span)
            wrong = digits[:-1] + str((int(digits[-1]) + 3) % 10)
            forms = [(wrong, False), (".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), True)]
        else:
            digits = re.sub("[^0-9]", "", span)
            local = digits[-10:]
            forms = [
                (f"({local[:3]}) {local[3:6]}-{local[6:]}", len(local) == 10),
                (f"{local[:3]}-{local[3:6]}-{local[6:]}", len(local) == 10),
                (f"{local[:3]}.{local[3:6]}.{local[6:]}", len(local) == 10),
                (f"00{digits[:2]} {digits[2:5]} {digits[5:]}", len(digits) > 8),
                (f"{local[:3]}-{local[3:5]}-{local[5:9]}", False),
                (f"0{local[1:4]} {local[4:8]}", False),
            ]
            trunk = local.lstrip("0")
            called = [
                ("call", f"0{trunk[:2]} {trunk[2:9]}"), ("tel", f"0{trunk[:3]} {trunk[3:6]} {trunk[6:]}"),
                ("phone", f"0{trunk[:3]}-{trunk[3:]}"), ("fax", f"0{trunk[:9]}"),
            ]
        for form, is_one in forms:
            yield passage_text[:start] + form + passage_text[end:], [(kind, start, start + len(form))] if is_one else []
        for word, form in called if len(called) and len(trunk) >= 8 else ():
            at = start + len(word) + 1
            yield f"{passage_text[:start]}{word} {form}{passage_text[end:]}", [(kind, at, at + len(form))]


def examples_of(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Short cuts of a text around its data, with that data as the spans to learn."""
    for kind, start, end in base_spans(text):
        left = text.rfind(" ", 0, max(0, start - 40)) + 1
        right = text.find(" ", min(len(text), end + 40))
        cut = text[left : right if right >= 0 else len(text)][: end - left + 80]
        inside = base_spans(cut)
        if inside == [(kind, start - left, end - left)]:
            yield cut, inside
    # Numbers that are no personal data.
    for m in re.finditer(r"\S*[0-9]\S*", text):
        cut = text[max(0, m.start() - 30) : m.end() + 30]
        if not base_spans(cut):
            yield cut, []


# Numbers in plain prose that are none of the kinds.
PLAIN = (
    "Licensed under CC BY-NC 4.0. version 3.", "In 2019 there were 1,200 of 3,400 cases.",
    "on 2024-03-17 at 12:30:45 it was done", "it costs 12.50 or 13.75 dollars", "see section 1.2.3 and 10.4",
    "release 10.15.7.1.2 of the build", "order 20240317112233 was sent", "pages 101-115 and 220 - 231",
    "between 1914-1918 and 1939 - 1945", "meet at noon and dot the i at 5", "ratio 3 : 4 at 100 % of 250 ml",
    "id 7f3a9c21 commit 04dbebab91ab85687d33", "the sum of 100 200 300 400 is 1000", "1 (2) 3 - 4 . 5",
    "ISBN 978-3-16-148410-0 was printed", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" ok",
    "ssn 123-45-6789 was given", "number 078-05-1120 and 219-09-9999", "look at example.com for more", "we arrive at 5.30 or at noon.Then",
    "batch 0301 4567 of lot 0099 1234", "serial 0471 221 998 is old", "call foo@bar and @name or x@y", "lat 48.8566 lon 2.3522 alt 35", "a 1234567890123456 b", "from 08:00 to 17:30 at 5 dot 3",
)


def fit_field(docs: DataFrame, n_documents: int = FIT_DOCUMENTS, n_passages: int = FIT_PASSAGES) -> Field:
    """The field, fitted on a bounded sample: about ``n_documents`` documents with an @ or two
    digits in a row, by hash of id and text, and ``n_passages`` cuts of those. The fixed patterns
    label the sample; every example is also shown in other ways of writing it. Without any
    example nothing is added to the fixed patterns."""
    able = docs.filter(F.col("text").rlike(r"@|[0-9]{2}")).select("doc_id", "text")
    # A share by hash: no task has to gather the texts.
    share = min(1.0, n_documents / max(1, able.count()))
    place = F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    chosen = able.filter(place < share).select("text")
    schema = "cut string, kinds array<int>, starts array<int>, ends array<int>"

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                {"cut": cut, "kinds": [s[0] for s in gold], "starts": [s[1] for s in gold], "ends": [s[2] for s in gold]}
                for text in batch.column("text")
                for cut, gold in examples_of(text.as_py())
            ]
            yield pa.RecordBatch.from_pylist(
                found,
                pa.schema(
                    [("cut", pa.string()), *((n, pa.list_(pa.int32())) for n in ("kinds", "starts", "ends"))]
                ),
            )

    rows = chosen.mapInArrow(cuts, schema)
    rows = rows.orderBy(F.xxhash64(F.lit(5), "cut"), "cut").limit(n_passages).collect()
    examples: list[tuple[Passage, list[Span]]] = []
    for row in rows:
        gold = list(zip(row.kinds, row.starts, row.ends))
        for cut, spans in variants(row.cut, gold):
            examples += [(p, _inside(p, spans)) for p in passages(cut, [])]
    if examples:
        for cut in PLAIN:
            examples += [(p, []) for p in passages(cut, [])] * 5
    return fit(examples)


def _inside(passage: Passage, spans: list[Span]) -> list[Span]:
    first, last = passage.tokens[0][0], passage.tokens[-1][1]
    return [s for s in spans if first <= s[1] and s[2] <= last]


# --- The operator ------------------------------------------------------------------------


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(spans of the fixed patterns, spans that the field adds), by kind and start."""
    base = base_spans(text)
    added = [s for p in passages(text, base) for s in field.segment(p)]
    return base, sorted(added)


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row's whole text.

    ``base`` are the spans of the fixed patterns, ``spans`` those and the ones the field adds:
    kind:start:end by kind and start, comma-joined, offsets in code points. A null or empty
    text has none; null ids stay null; repeated rows count again; other columns are not
    read; an empty table gives no rows. Rows are independent and texts are read whole, one at a
    time.
    """
    field = field or fit_field(docs)
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string"
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((len(KINDS), batch.num_rows), dtype=np.int64)
            base_texts, span_texts = [], []
            for r, text in enumerate(batch.column("text")):
                base, added = all_spans(text.as_py(), field) if text.is_valid else ([], [])
                for kind, _, _ in base:
                    counts[kind, r] += 1
                base_texts.append(written_out(base))
                span_texts.append(written_out(sorted(base + added)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(base_texts), pa.array(span_texts)],
                names=names,
            )

    # A text without digit, @ and a spelled at has no span: it need not go to Python.
    may = F.col("text").rlike(f"(?i){ANCHOR}")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(may, F.col("text")).alias("text"))
    return rows.mapInArrow(found, schema)


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """The spans by document; the counts and the hash are those of the fixed patterns. Nulls, empty
    and long texts, repeated rows and empty tables: as for :func:`find_personal_data`."""
    found = find_personal_data(docs)
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans"
    )
