"""Personal data spans by weak supervision.

Patterns propose spans. Five labelers vote on each: the strict pattern, a gazetteer of known beginnings and endings,
the words just before, a checksum or the shape, and the characters around. Votes are counted over the whole corpus;
expectation-maximisation on these counts estimates each labeler's reliability; its posteriors are the soft labels of a
logistic span classifier, which decides on the spans that the base patterns do not settle. Base spans stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried, stage

BASE = ("email", "ip", "card", "phone")
#: Kinds beyond the base ones: loosely written e-mail addresses, telephone numbers without a plus, account numbers, keys.
KINDS = (*BASE, "email_text", "phone_local", "iban", "key")
LABELERS = ("pattern", "gazetteer", "context", "checksum", "border")
FEATURES = 8
#: Span positions before which labelers look for words, and that far.
REACH = 40

# The base patterns, and words and prefixes that the labelers know.
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_TEXT = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} (?:\(at\)|\[at\]|at) [A-Za-z0-9-]{1,63} (?:\(dot\)|\[dot\]|dot) [A-Za-z]{2,24}\b")
_PHONE_LOCAL = re.compile(r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_KEY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])")
_WORDS = {
    "email": re.compile(r"e-?mail|contact|write|address|kontakt|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf|appel|llam", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "key": re.compile(r"token|secret|key|password|auth|bearer", re.I),
}
#: Gazetteers, fixed values: domain endings, issuers' first digits, calling codes, private networks, countries of
#: account numbers, and how keys of common services begin.
_ENDINGS = tuple(
    "." + e
    for e in "com org net edu gov mil int info biz name pro io co me tv app dev ai at au be bg br ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu ie il in is it jp kr lt lu lv mx nl no nz pe pl pt ro rs ru se sg si sk tr tw ua uk us uy ve za".split()
)
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "644", "645", "646", "647", "648", "649", "65", "62", "30", "35", "36", "38", "22", "23", "24", "25", "26", "27")
_CALLING = tuple("+" + c for c in "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 354 358 370 371 372 380 385 386 420 421".split())
_PRIVATE = ("10.", "127.", "192.168.", "169.254.", *(f"172.{n}." for n in range(16, 32)))
_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_KEYS = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?:sk|pk|rk|gh[opsur]|glpat|xox[abp])[_-].+|AKIA[0-9A-Z]{16}|AIza.{35}|eyJ.+)")


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, leftmost and without overlap within a kind, failing matches dropped.

    Written so that no text makes it slow: addresses are found from their @, whose run of address characters to the
    left is the leftmost start there can be, and dotted numbers are cut into fours from chains of digit runs.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        chain = m.group()
        if chain.count(".") < 3:
            continue
        parts, place = chain.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                out.append(("ip", place, place + size))
            place += size + 1
    for m in _CARD.finditer(text):
        span = m.group()
        if 13 <= len(span) <= 38:
            digits = span.replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    plus = text.find("+")
    while plus >= 0:
        m = _PHONE.match(text, plus)
        if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", plus, m.end()))
        plus = text.find("+", m.end() if m else plus + 1)
    return out


def _more_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposals of the other kinds that touch neither a base span nor an earlier proposal. Matches of a kind come in order,
    so one walk along the spans used so far is enough for each kind."""
    found = []
    used = sorted((a, b) for _, a, b in taken)
    for kind, pattern in (("email_text", _EMAIL_TEXT), ("phone_local", _PHONE_LOCAL), ("iban", _IBAN), ("key", _KEY)):
        if kind == "email_text" and " at " not in text and "at)" not in text and "at]" not in text:
            continue
        new, at, reach = [], 0, 0
        for m in pattern.finditer(text):
            a, b = m.span()
            # Of the spans that begin before this one's end, some reach into it or none does.
            while at < len(used) and used[at][0] < b:
                reach = max(reach, used[at][1])
                at += 1
            if reach <= a:
                new.append((a, b))
        found += [(kind, a, b) for a, b in new]
        used = sorted(used + new)
    return found


def _group(kind: str) -> str:
    return kind.split("_")[0]


def _mod97(span: str) -> bool:
    s = span.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """The five votes (0 against, 1 none, 2 for) as a base-3 number, and the classifier's features as bits."""
    span, before = text[a:b], text[max(0, a - REACH) : a]
    digits = "".join(c for c in span if c.isdigit())
    group = _group(kind)
    pattern = 2 if kind in BASE else 1
    context = 1
    named = _WORDS[group].search(before)
    if named:
        context = 2
    elif any(p.search(before) for g, p in _WORDS.items() if g != group):
        context = 0
    gazetteer = checksum = 1
    if group == "email":
        gazetteer = 2 if span.lower().replace(" dot ", ".").replace("(dot)", ".").endswith(_ENDINGS) else 1
        checksum = 2 if span.count("@") == 1 else 1
    elif group == "ip":
        gazetteer = 2 if span.startswith(_PRIVATE) else 1
        checksum = 0 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 2
    elif group == "card":
        gazetteer = 2 if digits.startswith(_ISSUERS) else 0
        checksum = 2 if luhn(digits) else 0
    elif group == "phone":
        gazetteer = 2 if span.startswith(_CALLING) or "(" in span else 1
        checksum = 2 if 10 <= len(digits) <= 13 else 0
    elif group == "iban":
        gazetteer = 2 if span[:2] in _COUNTRIES else 1
        checksum = 2 if _mod97(span) else 0
    elif group == "key":
        mix = len(set(span)) / len(span)
        gazetteer = 2 if _KEYS.fullmatch(span) else 1
        checksum = 2 if mix > 0.25 and len(digits) * 6 >= len(span) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    border = 0 if left.isalnum() or right.isalnum() else 2
    code = 0
    for v in (pattern, gazetteer, context, checksum, border):
        code = code * 3 + v
    bits = (named is not None, border == 2, len(span) >= 20, len(digits) * 2 >= len(span), " " in span, left in tuple("\"'=:<(["), digits != "", span != span.lower() and span != span.upper())
    return code, sum(1 << i for i, x in enumerate(bits) if x)


def _span_batches(batches: Iterator[pa.RecordBatch], keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Spans of each text beside the other columns, and with ``keep`` beside the text too."""
    schema = pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("stop", pa.int32()), ("vote", pa.int32()), ("bits", pa.int32())]))
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                row = []
                for kind, a, b in [*base, *_more_spans(text, base)]:
                    vote, bits = votes(text, kind, a, b)
                    row.append({"kind": KINDS.index(kind), "first": a, "stop": b, "vote": vote, "bits": bits})
                rows.append(row)
            others = batch.schema.names[1 if keep else 2 :]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, schema), *map(batch.column, others)], ["doc_id", "spans", *others])


def reliabilities(counts: Counter, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Expectation-maximisation over (kind, votes) counts: P(vote | truth) by labeler, and the posterior by pattern.

    Labelers are taken to err independently given the truth; every kind has its own share of true spans. Starting
    values trust each labeler a little, which settles which of the two classes is the true one.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    kind = np.array([p[0] for p in patterns])
    vote = np.array([[p[1] // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))] for p in patterns])
    table = np.tile(np.array([[0.5, 0.35, 0.15], [0.15, 0.35, 0.5]]), (len(LABELERS), 1, 1))
    prior = np.full(len(KINDS), 0.5)
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])])
        for j in range(len(LABELERS)):
            log = log + np.log(table[j][:, vote[:, j]])
        post = 1 / (1 + np.exp(log[0] - log[1]))
        for y, p in ((0, 1 - post), (1, post)):
            for j in range(len(LABELERS)):
                table[j, y] = (np.bincount(vote[:, j], n * p, 3) + 1) / ((n * p).sum() + 3)
        prior = (np.bincount(kind, n * post, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
    return table, dict(zip(patterns, post))


def span_classifier(counts: dict[tuple[int, int, int], int], steps: int = 300) -> dict[tuple[int, int, int], float]:
    """Probability by (kind, votes, features): a logistic model of kind and features on the posteriors of the votes."""
    if not counts:
        return {}
    by_votes: Counter = Counter()
    for (kind, vote, _), n in counts.items():
        by_votes[kind, vote] += n
    _, post = reliabilities(by_votes)
    keys = list(counts)
    x = np.zeros((len(keys), len(KINDS) * (1 + FEATURES)))
    for r, (kind, _, bits) in enumerate(keys):
        x[r, kind * (1 + FEATURES)] = 1
        for i in range(FEATURES):
            x[r, kind * (1 + FEATURES) + 1 + i] = bits >> i & 1
    y = np.array([post[k[0], k[1]] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method on the ridge-penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * (p - y)) + 1e-6 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move / max(1.0, np.abs(move).max() / 2)
        if np.abs(move).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-x @ w))).tolist()))


def _decision_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = shared.value
        for batch in batches:
            counts, base_hash, spans = [], [], []
            for value in batch.column(1):
                row = sorted((s["kind"], s["first"], s["stop"], s["vote"], s["bits"]) for s in value.as_py())
                row = [s for s in row if s[0] < len(BASE) or sure.get((s[0], s[3], s[4]), 0.0) >= 0.5]
                named = [(k, f"{KINDS[k]}:{a}:{b}") for k, a, b, _, _ in row]
                counts.append([sum(1 for k, _ in named if k == i) for i in range(len(BASE))])
                base_hash.append(hashlib.sha256(",".join(t for k, t in named if k < len(BASE)).encode()).hexdigest())
                spans.append(",".join(t for _, t in named))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(base_hash, pa.string()), pa.array(spans, pa.string()), *batch.columns[2:]],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *batch.schema.names[2:]],
            )

    return run


def find(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and the columns of ``carry``,
    which may name the text.

    Whole texts are searched; positions are code points, ends exclusive; null counts as empty and has no spans.
    spans lists base spans and those of the other kinds that the classifier accepts, by kind and start. Vote counts
    cover all documents: there are at most 8 * 243 * 256 patterns, and only these counts reach the driver. Repeated
    rows give repeated rows, a null doc_id stays, extra columns are ignored, an empty table gives an empty table.
    """
    others = tuple(c for c in carry if c != "text")
    more = [*(["text string"] if "text" in carry else []), *carried(docs, others)]
    proposed = docs.select("doc_id", F.col("text").cast("string").alias("text"), *others).mapInArrow(
        lambda batches: _span_batches(batches, "text" in carry), ", ".join(["doc_id long", "spans array<struct<kind:int,first:int,stop:int,vote:int,bits:int>>", *more])
    )
    proposed = stage(proposed, "spans")
    patterns = proposed.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.vote", "s.bits").count()
    counts = {(r["kind"], r["vote"], r["bits"]): r["count"] for r in patterns.collect()}
    model = docs.sparkSession.sparkContext.broadcast(span_classifier(counts))
    columns = ["doc_id long", *(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string", *more]
    return proposed.mapInArrow(_decision_batches(model), ", ".join(columns))


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is not None and spans:
                marks = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",")))
                parts, done = [], 0
                for a, b, kind in marks:
                    if b > done:
                        parts += [text[done : max(a, done)], f"<{_group(kind)}>"]
                        done = b
                text = "".join([*parts, text[done:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def redacted(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """The rows with every span that their own column ``spans`` lists replaced by its kind in angle brackets; that column
    goes."""
    names = [c for c in rows.columns if c not in ("text", spans)]
    return rows.select("text", spans, *names).mapInArrow(_redact_batches, ", ".join(["text string", *carried(rows, tuple(names))]))


def redact(docs: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The documents with every span of ``found`` (the keys, spans) replaced by its kind in angle brackets. The keys,
    nulls included, are unique in ``found``; documents without a row there stay as they are."""
    names = [c for c in docs.columns if c != "text"]
    spans = found.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("spans").alias("_spans"))
    joined = docs.join(spans, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left")
    return redacted(joined.select("text", "_spans", *names), "_spans").select(*docs.columns)
