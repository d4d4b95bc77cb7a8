"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.tables import sample_by_hash

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^0-9@\s]*[0-9@]\S*")
#: Digits in groups with single blanks or marks between them, such as a number written in blocks.
_BLOCKS = re.compile(r"(?<![\w@.+-])[(]?[0-9](?:(?:\) ?| [(]|[ .-])?[0-9])*(?![\w@])")


def _place(span: tuple[int, int, int]) -> tuple[int, int, int]:
    """Spans go by start, then by kind as listed."""
    return span[0], span[2], span[1]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from every @ outwards, so a long run of letters costs its length once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        tail = _DOMAIN.match(text, at) if start < at else None
        if tail:
            out.append((start, tail.end()))
            done = tail.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start, then kind. Offsets are code points, the end is exclusive."""
    out = [(s, e, 0) for s, e in _emails(text)]
    if "." in text:
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=_place)


def _shape(token: str) -> str:
    """Digits as 9 and letters as a, with runs of letters cut short: equal shapes are similar tokens."""
    return re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token)))


def _value(token: str) -> str:
    """What a token says however it is written: the digits of a number, a lower-cased address without its wrapping."""
    if "@" in token or any(c.isalpha() for c in token):
        return token.lower().strip("\"'.,;:!?()[]{}<>")
    digits = re.sub(r"[^0-9]", "", token)
    return digits if len(digits) >= 7 and "." not in token else token


def _bits(token: str, before: str) -> list[float]:
    """What a node looks at; the values are digit counts and marks, never the fixed patterns themselves."""
    n, dots = sum(c in "0123456789" for c in token), token.count(".")
    letters = sum(c.isalpha() for c in token)
    return [
        1.0, float("@" in token), float("@" in token and dots > 0), float(dots == 3 and letters == 0), float(dots > 0), float(token.startswith("+")),
        float("(" in token and ")" in token), float(token.count("-") > 0), float(letters > 0 and n > 0), float(letters > n), float(n < 4),
        float(4 <= n < 10), float(10 <= n <= 13), float(14 <= n <= 19), float(n > 19), float(before[-1:] in "+:"), float(before[-1:].isalpha()),
    ]


N_BITS = len(_bits("", ""))


def _node_tokens(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The nodes of a text, (start, end, kind or OTHER): base spans, and every other token with a digit or @."""
    nodes, k = list(found), 0
    ends: list[tuple[int, int]] = []
    for s, e, _ in sorted(found):
        if ends and s <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(e, ends[-1][1]))
        else:
            ends.append((s, e))

    def free(s: int, e: int, k: int) -> tuple[bool, int]:
        while k < len(ends) and ends[k][1] <= s:
            k += 1
        return k == len(ends) or ends[k][0] >= e, k

    blocks: list[tuple[int, int]] = []
    for m in _BLOCKS.finditer(text):
        if " " in m.group() and 7 <= sum(c.isdigit() for c in m.group()) <= 19:
            alone, k = free(m.start(), m.end(), k)
            if alone:
                blocks.append(m.span())
    nodes += [(s, e, OTHER) for s, e in blocks]
    k = j = 0
    for m in _TOKEN.finditer(text):
        token = m.group().strip("\"'.,;:!?()[]{}<>#*$%&|=")
        if not token:
            continue
        s = m.start() + m.group().find(token)
        e = s + len(token)
        while j < len(blocks) and blocks[j][1] <= s:
            j += 1
        alone, k = free(s, e, k)
        if alone and (j == len(blocks) or blocks[j][0] >= e):
            nodes.append((s, e, OTHER))
    return sorted(nodes)


@dataclass
class SkipChain:
    """Weights of nodes (features x labels), of neighbours in the chain, and of skip edges between like tokens.

    ``sure`` is the probability from which a token is added, calibrated on texts that training has not seen.
    """

    node: np.ndarray
    chain: np.ndarray
    skip_same: float
    skip_like: float
    sure: float = 0.95


def _edges(text: str, nodes: list[tuple[int, int, int]], reach: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chain edges between close neighbours and skip edges between like tokens.

    Tokens are alike when they say the same (:func:`_value`) or have equal shapes. All like tokens are joined to one of
    them, the first that a pattern found, else the first: the graph grows with the text, a label reaches every repeat in one
    step however far away, and these edges form stars, so the evidence of a thousand repeats is not passed round in loops.
    """
    a, b, kind = [], [], []
    tokens = [text[s:e] for s, e, _ in nodes]
    values, shapes = [_value(t) for t in tokens], [_shape(t) for t in tokens]
    centres: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i][2] == OTHER):
        centres[0].setdefault(values[i], i)
        centres[1].setdefault(shapes[i], i)
    for i, (s, _, _) in enumerate(nodes):
        if i and s - nodes[i - 1][1] <= reach:
            a.append(i - 1), b.append(i), kind.append(0)
        one, two = centres[0][values[i]], centres[1][shapes[i]]
        if one != i:
            a.append(one), b.append(i), kind.append(1)
        if two != i and values[two] != values[i]:
            a.append(two), b.append(i), kind.append(2)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(kind, dtype=np.int64)


def marginals(model: SkipChain, text: str, nodes: list[tuple[int, int, int]]) -> np.ndarray:
    """Label probabilities by loopy sum-product message passing; base spans are observed.

    Messages pass until they stand still. Where loops keep them moving, their steps are damped more and more, so it ends.
    """
    labels = OTHER + 1
    bits = np.array([_bits(text[s:e], text[max(0, s - 1) : s]) for s, e, _ in nodes])
    local = bits @ model.node
    observed = np.array([k for _, _, k in nodes])
    fixed = observed != OTHER
    local[fixed] = -1e9  # no number of neighbours outweighs what a pattern found
    local[fixed, observed[fixed]] = 0.0
    local -= local.max(axis=1, keepdims=True)
    a, b, kind = _edges(text, nodes)
    if not len(a):
        p = np.exp(local)
        return p / p.sum(axis=1, keepdims=True)
    same = np.eye(labels)
    tables = np.exp(np.stack([model.chain, same * model.skip_same, same * model.skip_like]))
    forward = tables[kind]
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    table = np.concatenate((forward, np.swapaxes(forward, 1, 2)))
    reverse = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
    messages = np.full((len(source), labels), -np.log(labels))
    step, turn = 0.5, 0
    while True:
        into = np.zeros_like(local)
        np.add.at(into, target, messages)
        belief = (local + into)[source] - messages[reverse]
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        sent = np.einsum("el,elm->em", belief, table)
        fresh = np.log(sent / sent.sum(axis=1, keepdims=True) + 1e-30)
        moved = step * np.abs(fresh - messages).max()
        messages = (1.0 - step) * messages + step * fresh
        turn += 1
        if moved < 1e-4:
            break
        step = 0.5 if turn < 50 else 0.5 * 0.95 ** (turn - 50)
    into = np.zeros_like(local)
    np.add.at(into, target, messages)
    belief = local + into
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find_spans(text: str | None, model: SkipChain | None, sure: float | None = None) -> tuple[list, list]:
    """(base spans, all spans): the model adds tokens whose most likely label is personal data with probability ``sure``."""
    text = text or ""
    sure = model.sure if sure is None and model else sure
    base = base_spans(text)
    if model is None or not text:
        return base, base
    nodes = _node_tokens(text, base)
    if all(k != OTHER for _, _, k in nodes):
        return base, base
    p = marginals(model, text, nodes)
    added = [(s, e, int(q[:OTHER].argmax())) for (s, e, k), q in zip(nodes, p, strict=True) if k == OTHER and q[:OTHER].max() >= sure]
    return base, sorted(base + added, key=_place)


def _rewritten(token: str, kind: int, salt: int) -> str:
    """The same value in a form that the patterns miss: a number without its plus or in blocks, a wrapped address."""
    if kind == KINDS.index("phone"):
        digits = re.sub(r"[^0-9]", "", token)
        return (digits, " ".join(digits[i : i + 3] for i in range(0, len(digits), 3)), digits)[salt % 3]
    if kind == KINDS.index("card"):
        digits = re.sub(r"[^0-9]", "", token)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if salt % 2 else digits
    return token.replace("@", "@ ") if kind == KINDS.index("email") else token + ":80"


def _instances(text: str, salt: int) -> tuple[list[tuple[int, int, int]], str, list[int]]:
    """(nodes with labels, text, places of the rewritten nodes): the text, and its first base span again in another form."""
    base = base_spans(text)
    if not base:
        return _node_tokens(text, base), text, []
    s, e, kind = base[salt % len(base)]
    again = _rewritten(text[s:e], kind, salt)
    longer = f"{text}\n{again}"
    nodes = _node_tokens(longer, base_spans(longer))
    planted = [i for i, n in enumerate(nodes) if n[0] > len(text) and n[2] == OTHER and _value(longer[n[0] : n[1]]) == _value(text[s:e])]
    return [(n[0], n[1], kind if i in planted else n[2]) for i, n in enumerate(nodes)], longer, planted


def train_skip_chain(docs: DataFrame, sample: int = 2_000, longest: int = 20_000, steps: int = 300) -> SkipChain:
    """Fits the field by pseudo-likelihood on ``sample`` texts with a digit or @, the first by hash.

    The sample is bounded in rows and, by leaving texts of over ``longest`` characters out of training, in bytes.

    The fixed patterns label the tokens; every node is fitted given the labels of its neighbours. So that the skip edges
    learn what they are for, each text gets one of its base spans again in a form the patterns miss, with the same label,
    and the same form without its edges as no personal data: what a text says twice counts as what it was the first time. Every
    fifth text is held out; ``sure`` is the least probability, from 0.5 up, at which at most one added token in a hundred there
    is not such a repeat. Edge cases: no such texts give a field that labels nothing.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    rows = sorted(r.text for r in sample_by_hash(texts.where((F.length("text") <= longest) & F.col("text").rlike("[0-9@]")), "text", sample).collect())
    labels, bits, target, chain_in, same_in, like_in = OTHER + 1, [], [], [], [], []
    for salt, row in enumerate(rows):
        if salt % 5 == 0:
            continue
        nodes, text, planted = _instances(row, salt)
        if not nodes:
            continue
        observed = np.eye(labels)[[k for _, _, k in nodes]]
        a, b, kind = _edges(text, nodes)
        near = np.zeros((3, len(nodes), 2 * labels))
        for i, j, k in zip(a, b, kind, strict=True):
            near[k, j, :labels] += observed[i]
            near[k, i, labels:] += observed[j]
        seen = np.array([_bits(text[s:e], text[max(0, s - 1) : s]) for s, e, _ in nodes])
        parts = [seen, observed, *near]
        if planted:  # the same forms where nothing like them was said before
            none = np.zeros((len(planted), 2 * labels))
            alone = [seen[planted], np.tile(np.eye(labels)[OTHER], (len(planted), 1)), near[0, planted], none, none]
            parts = [np.concatenate(pair) for pair in zip(parts, alone, strict=True)]
        for held, part in zip((bits, target, chain_in, same_in, like_in), parts, strict=True):
            held.append(part)
    model = SkipChain(np.zeros((N_BITS, labels)), np.zeros((labels, labels)), 0.0, 0.0)
    model.node[0, OTHER] = 8.0
    if not bits:
        return model
    x, y = np.concatenate(bits), np.concatenate(target)
    chain, same, like = (np.concatenate(v) for v in (chain_in, same_in, like_in))
    same, like = same[:, :labels] + same[:, labels:], like[:, :labels] + like[:, labels:]
    rate, n = 0.5, len(x)
    for _ in range(steps):
        energy = x @ model.node + chain[:, :labels] @ model.chain + chain[:, labels:] @ model.chain.T + same * model.skip_same + like * model.skip_like
        p = np.exp(energy - energy.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (y - p) / n
        model.node += rate * (x.T @ off - 1e-3 * model.node)
        model.chain += rate * (chain[:, :labels].T @ off + off.T @ chain[:, labels:] - 1e-3 * model.chain)
        model.skip_same = min(12.0, max(0.0, model.skip_same + 20 * rate * float((same * off).sum())))
        model.skip_like = min(2.0, max(0.0, model.skip_like + rate * float((like * off).sum())))
    model.sure = _calibrated(model, rows[::5])
    return model


def _calibrated(model: SkipChain, rows: list[str], least: float = 0.5, wrong: float = 0.01) -> float:
    """The probability from which at most ``wrong`` of the tokens added to held-out texts are not planted repeats."""
    scores = []
    for salt, row in enumerate(rows):
        nodes, text, planted = _instances(row, salt)
        given = [(s, e, OTHER if i in planted else k) for i, (s, e, k) in enumerate(nodes)]
        if any(k == OTHER for _, _, k in given):
            p = marginals(model, text, given)
            scores += [(float(p[i, :OTHER].max()), i in planted) for i, n in enumerate(given) if n[2] == OTHER and p[i, :OTHER].max() >= least]
    scores.sort(reverse=True)
    sure, right, false = 0.999, 0, 0
    for score, planted in scores:
        right, false = right + planted, false + (not planted)
        if false <= wrong * (right + false):
            sure = score
    return max(least, sure - 1e-9)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def personal_data(docs: DataFrame, model: SkipChain | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs(doc_id, text)``.

    Counts and digest are those of the fixed patterns; ``spans`` holds all, by start, then kind. Null and empty texts
    have no spans (the digest is that of the empty string). Spans of different kinds may overlap. Other columns are
    ignored, repeated rows are rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1):
                base, every = find_spans(text.as_py(), model)
                counts.append([sum(s[2] == k for s in base) for k in range(OTHER)])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(OTHER)], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in capitals; overlapping spans become one, named by the first."""
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact_documents(docs: DataFrame, model: SkipChain | None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``length``, if it is a column, counted anew; other columns stay.

    Null texts stay null. Rows are neither dropped nor moved.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fresh = names.index(text), []
            for value in batch.column(at):
                value = value.as_py()
                spans = find_spans(value, model)[1]
                fresh.append(redact(value, spans) if spans else value)
            columns = list(batch.columns)
            columns[at] = pa.array(fresh, batch.schema.field(at).type)
            if length in names:
                n = names.index(length)
                counted = [old.as_py() if new is None else len(new) for old, new in zip(columns[n], fresh, strict=True)]
                columns[n] = pa.array(counted, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
