"""Plain Python versions of the operators' contracts, one document or one loop at a time."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import regex
import xxhash


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def op4(docs, tokenizer):
    """docs: (doc_id, text) by doc_id -> {doc_id: ids with 1}."""
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}


def crc_of_ids(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def op6(docs, tokenizer):
    out = {}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        out[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return out


def simhash(text, shingle=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [words[k : k + shingle] for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op8(docs, shingle=4, bits=4):
    """[(doc_id, fingerprint, component_id)] by comparing all pairs of fingerprints."""
    prints = [(i, simhash(t, shingle)) for i, t in docs]
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def top(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    codes = np.array(distinct, dtype=np.uint64)
    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(codes[k + 1 :] ^ codes[k]) <= bits):
            parent[top(f)] = top(distinct[k + 1 + j])
    least = {}
    for i, f in prints:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return [(i, f"{f:016x}", least.get(top(f))) for i, f in prints]


def op9(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    lines = [x for x in text.split("\n") if word.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if times[w] > 1 for d in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def op1_next(docs):
    """docs: (doc_id, text) -> {doc_id: (n_chars, edited text, next id)}."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t = t or ""
        j, following = order[(k + 1) % len(order)]
        half = len(t) // 2
        out[i] = (len(t), t[: len(t) - half] + (following or "")[:half], j)
    return out


def murmur(data, seed=42):
    """Spark's hash of bytes: Murmur3 of 32 bits, the last bytes one by one as signed numbers."""

    def mix(h, k):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        return ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF

    h, whole = seed, len(data) - len(data) % 4
    for k in range(0, whole, 4):
        h = mix(h, int.from_bytes(data[k : k + 4], "little"))
    for b in data[whole:]:
        h = mix(h, (b - 256 if b > 127 else b) & 0xFFFFFFFF)
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def leaves(paragraph):
    """A paragraph's leaves, cut at the first mark and white space within 32 characters."""
    out, at = [], 0
    while at < len(paragraph):
        ends = [k for k in range(at + 1, min(at + 32, len(paragraph))) if paragraph[k] in " \t\n\x0b\f\r" and paragraph[k - 1] in "es.!?"]
        end = ends[0] + 1 if ends else min(at + 32, len(paragraph))
        out.append(paragraph[at:end])
        at = end
    return out


def _ended(text, mark):
    """Parts that end after each place where a mark ends, as between places of zero width."""
    at = [k for k in range(len(mark), len(text)) if text[k - len(mark) : k] == mark]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)] + ([""] if text.endswith(mark) else [])


def op1_tree(text):
    """(fingerprint, distinct leaves) of a text."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    hashes, sections, distinct = [], [], set()
    for section in _ended(text, "\n\n"):
        own, spelled = [], []
        for paragraph in _ended(section, "\n"):
            codes = [murmur(x.encode()) for x in leaves(paragraph)]
            distinct |= set(codes)
            own.append(md5(paragraph))
            spelled.append(f"{own[-1][:8]}." + ",".join(f"{c:x}" for c in codes))
        hashes.append(md5(",".join(own)))
        sections.append(";".join(spelled))
    return hashlib.sha256(",".join(hashes).encode()).hexdigest() + ":" + "|".join(sections), distinct


def op1_likeness(a, b):
    (f, x), (g, y) = op1_tree(a), op1_tree(b)
    return 1.0 if f.split(":")[0] == g.split(":")[0] else 2 * len(x & y) / max(1, len(x) + len(y))


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def op2(text):
    """[(kind, start, end)] by kind, then start."""
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if pii_passes(k, m[0])]


def op5(text):
    """[(kind, start, end)] by start, then kind."""
    text, found = text or "", []
    assign = r"""((?i:p)(?i:assword)|(?i:passwd)|(?i:secret)|(?i:token)|(?i:api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


_SPACE = r"[ \t\n\x0b\f\r]"
_PUNCT = r"[!-/:-@\[-`{-~]"


def pii_occurrences(text, patterns):
    """[(start, end, instance, kind, patterns)] of a text's tokens and digit groups; patterns: the operator's two of these."""
    spans = sorted(((list(PII).index(k), a, b, k) for k, a, b in op2(text)))

    def found(name):
        hits = list(regex.finditer(patterns[name].regex, text, regex.ASCII if name == "token" else 0))
        edges = [0, *[e for m in hits for e in m.span()], len(text)]
        return [(m.start(), m.end(), text[edges[2 * i] : m.start()][-80:], text[m.end() : edges[2 * i + 3]][:80]) for i, m in enumerate(hits)]

    digits = lambda v: len(re.sub("[^0-9]", "", v))
    groups = [g for g in found("group") if 7 <= digits(text[g[0] : g[1]]) <= 19 and not re.search(r"[0-9](\.[0-9]+){3}", text[g[0] : g[1]])]
    tokens = found("token")
    if not tokens:
        return []
    out = []
    for a, b, before, after, group in [(*t, False) for t in tokens if not any(g[0] <= t[1] - 1 and t[0] < g[1] for g in groups)] + [(*g, True) for g in groups]:
        value = text[a:b]
        known = next(((x, y, k) for _, x, y, k in spans if a <= x < b), None)
        plain = lambda x: re.sub(f"(?:{_SPACE}|{_PUNCT})+", " ", x).lower().strip(" ").split(" ")
        words, right = plain(before), plain(after)[0]
        given = [f"<{words[-1]}"] * (words[-1] != "") + [f"<{x} {y}" for x, y in zip(words[-2:], words[-1:] * (len(words) > 1), strict=False)]
        label = re.search(rf"([^ \t\n\x0b\f\r]*{_PUNCT}){_SPACE}*$", before)
        given += [f"<{label[1].lower()}"] if label else []
        if right and (known is None or known[1] <= b):
            given += [f">{right}"] + [f"<{words[-1]} >{right}"] * (words[-1] != "")
        lead = 0 if group else len(regex.match(r"[^\p{L}0-9+@]*", value)[0])
        own = re.sub("[^0-9]+$", "", value) if group else regex.sub(r"^[^\p{L}0-9+@]+|[^\p{L}0-9]+$", "", value)
        start, end, instance, kind = (known[0], known[1], text[known[0] : known[1]], known[2]) if known else (a + lead, a + lead + len(own), own, None)
        if instance:
            out.append((start, end, instance, kind, set(given)))
    return out


def pii_spans(texts, patterns, shapes, how):
    """[spans] of each text, by three rounds over dictionaries of patterns and instances."""
    seen = [pii_occurrences(t or "", patterns) for t in texts]
    edges = {}
    for _, _, instance, kind, given in (o for rows in seen for o in rows):
        for p in given:
            kinds = [k for k in (kind, edges.get((p, instance))) if k]
            edges[p, instance] = min(kinds, default=None)
    total = Counter(p for p, _ in edges)
    base = {(i, k): 1.0 for (_, i), k in edges.items() if k}
    known = dict(base)
    for _ in range(how.rounds):
        support = {}
        for p, i in edges:
            for (j, k), score in known.items():
                if i == j:
                    support.setdefault((p, k), []).append(score)
        trusted = {pk: sum(x) / (total[pk[0]] + 1) for pk, x in support.items() if len(x) >= how.min_instances and sum(x) / (total[pk[0]] + 1) >= how.min_confidence}
        heard = {}
        for (p, i), kind in edges.items():
            for (q, k), confidence in trusted.items():
                if p == q and kind is None and regex.search(shapes[k], i):
                    heard.setdefault((i, k), []).append(min(confidence, 0.999))
        # An instance that is known by a fixed pattern in one place and heard in another has both scores.
        known = {**{ik: 1 - math.prod(1 - c for c in x) for ik, x in heard.items()}, **base}
    out = []
    for text, rows in zip(texts, seen, strict=True):
        fixed, added = op2(text or ""), set()
        for start, end, instance, kind, given in rows:
            if kind is None:
                added |= {(k, start, end) for p, k in trusted if p in given and regex.search(shapes[k], instance)}
        added = {x for x in added if not any(k == x[0] and a < x[2] and x[1] < b for k, a, b in fixed)}
        out.append(sorted([*fixed, *added], key=lambda x: (list(PII).index(x[0]), x[1:])))
    return out


def battery(value, encodings):
    """(bits, p) of a run; encodings: (name, pattern, alphabet), the first that fits."""
    alphabet = next((a for _, rule, a in encodings if re.fullmatch(rule[1:-1], value)), None)
    if alphabet is None:
        return None
    x, n, a = [alphabet.index(c) for c in value], len(value), len(alphabet)
    tail = lambda z: max(min(math.erfc(abs(z) / math.sqrt(2)), 1), 1e-300)
    chi = sum((sum(y == c for y in x) - n / a) ** 2 / (n / a) for c in range(a))
    z = ((chi / (a - 1)) ** (1 / 3) - (1 - 2 / (9 * (a - 1)))) / math.sqrt(2 / (9 * (a - 1)))
    p_chi = tail(z) / 2 if z > 0 else 1 - tail(z) / 2
    high = [2 * c >= a for c in x]
    n1, n0 = sum(high), n - sum(high)
    runs = 1 + sum(b != c for b, c in zip(high, high[1:], strict=False))
    expected = 2 * n1 * n0 / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    p_runs = tail((runs - expected) / math.sqrt(max(variance, 1e-9))) if n1 and n0 and variance > 0 else 1e-12
    mean = sum(x) / n
    spread = sum((c - mean) ** 2 for c in x)
    together = sum((b - mean) * (c - mean) for b, c in zip(x, x[1:], strict=False))
    p_serial = tail((together / max(spread, 1e-9) + 1 / n) * math.sqrt(n)) if spread > 0 else 1e-12
    half = -(math.log(p_chi) + math.log(p_runs) + math.log(p_serial))
    return n * math.log2(a), math.exp(-half) * (1 + half + half * half / 2)


def random_runs(texts, picks, secrets):
    """[(text's number, start, end)] of the runs reported; picks: the number of each text's length of decoys."""
    how, runs, decoys = secrets.Battery(), [], []
    bands = lambda n: sum(b <= n for b in secrets.BANDS)
    step = lambda p: min(max(math.ceil((math.log10(max(p, 1e-20)) + 20) * 20), 0), 400)
    mixed = lambda v: re.search("[0-9]", v) and re.search("[A-Za-z]", v)
    for i, (text, pick) in enumerate(zip(texts, picks, strict=True)):
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
            if mixed(m[0]) and (found := battery(m[0], secrets.ENCODINGS)):
                runs.append((i, m.start(), m.end(), bands(len(m[0])), *found))
        squeezed = re.sub("[^A-Za-z0-9+/_-]+", "", re.sub("[A-Za-z0-9+/_-]{20,}", " ", text))
        size = secrets.DECOYS[pick]
        for k in range(0, len(squeezed) - size + 1, size):
            if mixed(squeezed[k : k + size]) and (found := battery(squeezed[k : k + size], secrets.ENCODINGS)):
                decoys.append((bands(size), step(found[1])))
    out = []
    for band in range(1, 5):
        own, others = [r for r in runs if r[3] == band], [s for b, s in decoys if b == band]
        p = {r: (1 + sum(s >= step(r[5]) for s in others)) / (1 + len(others)) for r in own}
        ranked = sorted(p.values())
        level = max((x for k, x in enumerate(ranked, 1) if x * len(own) <= how.false_discovery * k), default=-1)
        out += [r[:3] for r in own if p[r] <= level and r[4] >= how.min_bits and r[5] >= how.min_p]
    return out


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op3(text):
    """(n_words, n_base, first, last, base labels) of a text."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        wanted = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(wanted)] == wanted:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
