"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) are found by fixed rules and always stay.
Further candidates (phone numbers without a plus, obfuscated mail addresses,
digit chains that fail a checksum, identity numbers, names after a title) are
voted on by six labelers: shape (regex), checksum, gazetteer, supporting context,
opposing context and neighbourhood (another span close by). Each votes for,
against or abstains. Base spans are voted on as well, so the labelers'
reliabilities are estimated from all candidates of all documents.

A candidate's votes, kind and shape make one of at most ``6 * 3**6 * 8`` signatures;
only counts by signature reach the driver. Expectation-maximisation over these
counts gives each labeler's vote probabilities and each kind's prior; the
posteriors train a logistic classifier over votes, kind and shape. Candidates
that it scores at ``KEEP`` or more, and that touch no base span, are added.

All rules are linear in the text: each looks from an anchor (a digit run's start,
an ``@``, a plus, a title) or consumes what it has scanned.

Defined cases: a null text is an empty text and has no spans; a null id stays
null; repeated rows give repeated rows; without candidates no classifier is
trained; an empty table gives an empty table; other columns are ignored. Candidates inside
an identity number aren't candidates of their own.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held, materialise, texts, trim

KINDS = ("email", "ip", "card", "phone", "id", "name")
LABELERS = ("shape", "checksum", "gazetteer", "support", "against", "near")
KEEP = 0.8
EM_ROUNDS = 60
MOST_PRIOR = 0.8
RIDGE = 1e-5
TRUST = 0.1
CONTEXT = 48
VETO = 0.01

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
AT = re.compile(r"[(\[{<]\x20?at\x20?[)\]}>]|\x20at\x20", re.I)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?\Z")
AFTER_AT = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[{<]\x20?dot\x20?[)\]}>]|\.|\x20dot\b)\x20?[A-Za-z0-9-]{1,63}){1,8}", re.I)
DOT = re.compile(r"[(\[{<]\x20?dot\x20?[)\]}>]|\x20dot\x20", re.I)
#: Groups as North America writes them; a leading zero with one long group, or two groups of six and more; a zero and pairs.
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}|\(?0[0-9]{1,5}\)?(?:[ /-]{1,3}[0-9]{5,9}|[ /-][0-9]{3,4}[ -][0-9]{2,5})|0[0-9](?:([ .-])[0-9]{2})(?:\1[0-9]{2}){3})(?![\w-])")
ZERO_PHONE = re.compile(r"\(?0[0-9]{1,5}\)?(?:[ /-]{1,3}[0-9]{5,9}|[ /-][0-9]{3,4}[ -][0-9]{2,5})|0[0-9](?:([ .-])[0-9]{2})(?:\1[0-9]{2}){3}")
PLAIN_PHONE = re.compile(r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}")
IDENTITY = re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![\w-])")
TAIL = re.compile(r"\x20[A-Z0-9]{1,3}\Z|\x20[A-Z]{4}\Z")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sra", "Señor")
TITLED = re.compile(r"\b(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Señora|Señor)\.?\x20([A-Z][^\W\d_]{1,30}(?:\x20[A-Z][^\W\d_]{1,30})?)")
#: Common given names of several languages; :func:`detect` takes a list of one's own.
NAMES = frozenset(
    "adam ahmed aisha alan albert alejandro alex alexander alice ali amir amy ana anders andrea andrew angela anna anne antonio arthur astrid beatriz ben bernard brian camille carla carlos carmen "
    "caroline catherine charles charlotte chen chloe christian christine claire clara daniel david diana diego dmitri dorothy edward elena elias elisabeth elizabeth emily emma erik esther eva "
    "fatima felix fernando francesca francisco francois frank fritz gabriel george giulia giovanni greta grace hannah hans harry hassan heidi helen henry hiroshi hugo ibrahim ida igor ines ingrid "
    "irene isabel ivan jack jacob james jan jane javier jean jennifer jens jessica joan johanna john jorge jose joseph juan judith julia julien karen karl katarina kenji kim klaus kofi laura "
    "lars lea lena leon linda lisa louis louise lucas lucia luis magda marco margaret maria marie mark marta martin mary matteo max mei mia michael miguel mohammed monika nadia nicolas nina "
    "nora olga oliver olivia olumide omar oscar pablo patricia paul pavel pedro peter philip pierre rachel raj rebecca richard robert rosa ruth samuel sandra sara sofia sophie stefan susan sven "
    "thomas tim tom ursula victor victoria walter wei william yuki yusuf".split()
)
#: What follows a title without being a name.
ROLES = frozenset("president minister chairman speaker director general secretary judge ambassador governor mayor professor doctor".split())
GENERIC = frozenset("com org net edu gov mil int info biz dev app".split())
SUPPORT = {
    "email": "mail contact write reach e-mail",
    "ip": "ip address host server login client",
    "card": "card visa credit payment account mastercard",
    "phone": "call phone tel fax mobile contact number",
    "id": "ssn social iban passport account id tax",
    "name": "contact name dear signed from by",
}
AGAINST = re.compile(r"version|section|figure|chapter|isbn|page|build|release|total|price|order|part", re.I)
SUPPORTS = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v.split())) + r")\b", re.I) for k, v in SUPPORT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) < 4 and int(short or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, ``@`` and dotted domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        # The next local part can't cross this sign; an unmatched one may begin after it.
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(at_most_255(p) for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() < 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def extra_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates beyond the base rules, sorted, without repeats."""
    out = set()
    if "at" in text or "AT" in text or "At" in text:
        for m in AT.finditer(text):
            word = m[0][1:3].lower() == "at" and m[0][0] == " "
            left = BEFORE_AT.search(text[max(0, m.start() - 65) : m.start()])
            right = AFTER_AT.match(text, m.end() - word)
            if left and right and (not word or DOT.search(right[0])):  # a plain "at" needs a "dot" to mean an address
                out.add((m.start() - len(left[0]), 0, right.end()))
    if DIGIT.search(text):
        for m in CARD.finditer(text):
            if m.end() - m.start() < 40 and 12 <= sum(c.isdigit() for c in m[0]) <= 19:
                out.add((m.start(), 2, m.end()))
        out.update((m.start(), 3, m.end()) for m in LOCAL_PHONE.finditer(text))
        own = []
        for m in IDENTITY.finditer(text):
            s, e = m.span()
            if m[0][0].isalpha() and not iban(m[0]) and (short := TAIL.search(m[0])) and iban(m[0][: short.start()]):
                e = s + short.start()  # the last group was the next word
            own.append((s, 4, e))
        # What lies inside an identity number is a part of it.
        starts = [s for s, _, _ in own]
        inside = lambda s, e: (k := bisect.bisect_right(starts, s)) and e <= own[k - 1][2]
        out = {x for x in out if not inside(x[0], x[2])} | set(own)
    if any(t in text for t in TITLES):
        out.update((m.start(1), 5, m.end(1)) for m in TITLED.finditer(text))
    return sorted(out)


def votes(text: str, start: int, kind: int, end: int, near: bool, is_base: bool, names: frozenset[str] = NAMES) -> tuple[list[int], int]:
    """The labelers' votes (+1 for, -1 against, 0 abstains) and three shape bits."""
    s, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in s if c.isdigit())
    before, around = text[max(0, start - CONTEXT) : start], text[max(0, start - CONTEXT) : end + CONTEXT]
    shape = 1 if is_base or kind == 4 else 0
    check = 0
    if kind == 2 or kind == 4 and "-" not in s:
        check = 1 if (kind == 2 and luhn(digits)) or (kind == 4 and iban(s)) else -1
    if kind == 0:
        shape = 1 if is_base or " " not in s or DOT.search(s) or re.search(r"[(\[{<]\x20?at", s, re.I) else 0
        top = re.split(r"[.)\]}>\s]+", s)[-1].lower()
        gazetteer = 1 if top in GENERIC or len(top) == 2 and top.isalpha() else -1  # two letters: a country's
    elif kind == 5:
        first, *rest = s.lower().split()
        gazetteer = 1 if first in names else -1 if first in ROLES else 0
        shape = 1 if rest else 0
    elif kind == 2:
        gazetteer = 1 if digits[0] in "3456" else -1  # issuers of payment cards
    elif kind == 3:
        shape = 1 if is_base or PLAIN_PHONE.fullmatch(s) or ZERO_PHONE.fullmatch(s) else 0
        gazetteer = -1 if len(set(digits)) <= 2 else 0
    else:
        gazetteer = 0
    support = 1 if SUPPORTS[name].search(before) else 0
    against = -1 if AGAINST.search(before) else 0
    bits = (len(s) >= 16) + 2 * any(c in " .-()" for c in s) + 4 * ("\n" not in around)
    return [shape, check, gazetteer, support, against, 1 if near else 0], bits


def iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def signature(kind: int, cast: list[int], bits: int) -> int:
    code = kind
    for v in cast:
        code = code * 3 + v + 1
    return code * 8 + bits


def unsign(sig: int) -> tuple[int, list[int], int]:
    bits, code, cast = sig % 8, sig // 8, []
    for _ in LABELERS:
        cast.append(code % 3 - 1)
        code //= 3
    return code, cast[::-1], bits


def candidates(text: str, names: frozenset[str] = NAMES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, bool]]]:
    """Base spans, and all candidates with their signatures: (start, kind, end, signature, is base)."""
    base = base_spans(text)
    extra = extra_spans(text) if text else []
    if not base and not extra:
        return base, []
    fixed, ends, out = sorted((s, e) for s, _, e in base), 0, []
    reach = []  # the furthest end among base spans up to each one
    for _, e in fixed:
        ends = max(ends, e)
        reach.append(ends)
    def touches(s: int, e: int) -> bool:
        k = bisect.bisect_left(fixed, (e, -1))
        return k > 0 and reach[k - 1] > s

    every = sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in extra if not touches(s, e)])
    starts = [x[0] for x in every]
    for s, k, e, is_base in every:
        near = bisect.bisect_left(starts, s + 2 * CONTEXT) - bisect.bisect_left(starts, s - 2 * CONTEXT) > 1
        out.append((s, k, e, signature(k, *votes(text, s, k, e, near, is_base, names)), is_base))
    return base, out


def expectation_maximisation(kinds: np.ndarray, cast: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS, failed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, P(vote | truth) by kind and labeler, prior by kind.

    ``cast`` has a row of votes (-1, 0, 1) a pattern, ``n`` its count. Each kind has its own
    estimates: labelers abstain on some kinds, which says nothing about the truth.
    ``failed`` marks patterns that a failed checksum settles: they are held at ``VETO``.
    """
    labelers = cast.shape[1]
    failed = np.zeros(len(cast), bool) if failed is None else failed
    post = np.where(failed, VETO, 1 / (1 + np.exp(-1.5 * cast.sum(axis=1))))
    table, prior = np.full((len(KINDS), labelers, 3, 2), 1 / 3), np.full(len(KINDS), 0.5)
    for k in np.unique(kinds):
        own = kinds == k
        votes_, count, p = cast[own], n[own], post[own]
        for _ in range(rounds):
            # No kind is taken as certain: else a common kind would outvote what speaks against a candidate.
            prior[k] = np.clip((1 + (count * p).sum()) / (2 + count.sum()), 1 - MOST_PRIOR, MOST_PRIOR)
            logit = np.full(len(p), np.log(prior[k] / (1 - prior[k])))
            for j in range(labelers):
                seen = {v: votes_[:, j] == v for v in (-1, 0, 1)}
                for truth, mass in ((1, count * p), (0, count * (1 - p))):
                    made_up = TRUST * mass.sum() + 1  # votes that keep a labeler's meaning: for is likelier if true
                    right, wrong = (1, -1) if truth else (-1, 1)
                    t = [mass[seen[v]].sum() + (0.9 * made_up if v == right else 0.1 * made_up if v == wrong else 0.01) for v in (-1, 0, 1)]
                    table[k, j, :, truth] = np.array(t) / sum(t)
                if not seen[0].all():
                    logit += np.log(table[k, j, votes_[:, j] + 1, 1] / table[k, j, votes_[:, j] + 1, 0])
            p = np.where(failed[own], VETO, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        post[own] = p
    return post, table, prior


def features(sigs: list[int]) -> np.ndarray:
    rows = []
    for sig in sigs:
        kind, cast, bits = unsign(sig)
        rows.append([1.0, *[float(kind == k) for k in range(len(KINDS))], *[float(v == 1) for v in cast], *[float(v == -1) for v in cast], *[float(bits >> b & 1) for b in range(3)]])
    return np.array(rows)


def train(counts: dict[int, int]) -> dict[str, object]:
    """The classifier from counts by signature: weights, and what EM estimated."""
    if not counts:
        return {"weights": None, "accuracy": None, "prior": None}
    sigs = sorted(counts)
    n = np.array([counts[s] for s in sigs], float)
    kinds, cast = np.array([unsign(s)[0] for s in sigs]), np.array([unsign(s)[1] for s in sigs])
    post, table, prior = expectation_maximisation(kinds, cast, n, failed=cast[:, LABELERS.index("checksum")] == -1)
    # Square roots of the counts: rare signatures are heard beside very common ones.
    x, weight = features(sigs), np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(x.shape[1])
    for _ in range(400):  # Newton's steps on the penalised soft-label likelihood
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (post - p)) - RIDGE * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return {"weights": w, "accuracy": table, "prior": prior}


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, names: frozenset[str] = NAMES) -> DataFrame:
    """Per row of (doc_id, text): counts, base spans and candidates with signatures."""
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, starts array<int>, ends array<int>, sigs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base_text, starts, ends, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                base, found = candidates(text, names)
                for k in range(4):
                    counts[k].append(sum(b[1] == k for b in base))
                base_text.append(listed(base))
                starts.append([c[0] for c in found])
                ends.append([c[2] for c in found])
                sigs.append([c[3] for c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_text, pa.string()), *[pa.array(a, pa.list_(pa.int32())) for a in (starts, ends, sigs)]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "starts", "ends", "sigs"],
            )
        trim()

    return docs.mapInArrow(run, schema)


def decide(found: DataFrame, model: dict[str, object]) -> DataFrame:
    """Per row of :func:`find`: the base digest and all spans."""
    weights = model["weights"]
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bool] = {}
        for batch in batches:
            shas, spans, added, sizes = [], [], [], []
            for base, starts, ends, sigs in zip(*(batch.column(k).to_pylist() for k in range(5, 9)), strict=True):
                fixed = [x.split(":") for x in base.split(",")] if base else []
                every = {(int(s), KINDS.index(k), int(e)) for k, s, e in fixed}
                n = len(every)
                for s, e, sig in zip(starts, ends, sigs, strict=True):
                    if sig not in known:
                        known[sig] = weights is not None and float((1 / (1 + np.exp(-features([sig]) @ weights)))[0]) >= KEEP
                    if known[sig]:
                        every.add((s, unsign(sig)[0], e))
                shas.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(listed(list(every)))
                added.append(len(every) - n)
                sizes.append(len(every))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(sizes, pa.int64())], names)

    return found.mapInArrow(run, schema)


def detect(docs: DataFrame, names: frozenset[str] = NAMES) -> DataFrame:
    """All personal data of (doc_id, text) rows; the model is trained on their candidates.
    ``names``: given names in lower case, which go to the tasks with the code."""
    found = materialise(find(docs, names), "pii-candidates")
    # At most 6 * 3**6 * 8 signatures exist, whatever the number of documents.
    counts = {r.sig: r.n for r in found.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n")).collect()}
    return decide(found, train(counts))


def op2(spark, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return detect(texts(documents(spark, sf_dir)))
