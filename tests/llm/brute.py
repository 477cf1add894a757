"""Plain versions of the operators, for small inputs."""
import hashlib
import hmac
import math
import re
import zlib
from collections import Counter
from datetime import date, timedelta


def suffix_dedup(rows, window):
    """rows: (doc_id, text), ids unique."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            if s in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def phrase_dedup(rows, window):
    """rows: (doc_id, text), ids unique."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    count = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def near_duplicates(rows, window, percent):
    """rows: (doc_id, text), ids unique and not null. doc_id -> (size of the set, smallest id of the group)."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets[i] = {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else set()
    of, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(min(a, b), max(a, b)) for ids in of.values() for a in ids for b in ids if a != b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def top_k(rows, k, scale=64):
    """rows: (vec_id, embedding), ids unique and usable."""
    v = {i: [math.floor(x * scale) for x in e] for i, e in rows}
    out = []
    for q in (i for i in v if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=False)), i) for i in v if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


# ---------------------------------------------------------------- pseudonyms

# Country codes of one and two digits (others have three), and the first and number of the runs of code points.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
RUNS = [(0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25),
        (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16), (0x5D0, 27), (0x620, 43), (0x905, 53), (0xE01, 48), (0x3041, 86), (0x30A1, 90),
        (0x4E00, 20902), (0xAC00, 11172)]


def _hash(key, *parts):
    message = "".join(f"{len(str(p).encode())}:{p}" for p in parts)
    return int(hmac.new(key.encode(), message.encode(), "sha256").hexdigest()[:15], 16)


def feistel(a, b, mod_a, mod_b, kind, key):
    for i in range(8):
        if i % 2 == 0:
            a = (a + _hash(key, kind, i, mod_a, mod_b, b) % mod_a) % mod_a
        else:
            b = (b + _hash(key, kind, i, mod_a, mod_b, a) % mod_b) % mod_b
    return a, b


def _decimal(d, kind, key):
    n = len(d) // 2
    a, b = feistel(int(d[:n]), int(d[n:]), 10**n, 10 ** (len(d) - n), kind, key)
    return f"{a:0{n}d}{b:0{len(d) - n}d}"


def luhn(body):
    total = 0
    for x, c in enumerate(reversed(body)):
        d = int(c)
        total += (2 * d - 9 if d > 4 else 2 * d) if x % 2 == 0 else d
    return (10 - total % 10) % 10


def _refill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def pseudonym(value, key):
    digits = re.sub("[^0-9]", "", value)
    if "@" in value:
        local, _, domain = value.partition("@")
        n = len(local) // 2
        a, b = local[:n], local[n:]

        def shifted(half, other, i):
            out = ""
            for at, c in enumerate(half):
                for base, size in RUNS:
                    if base <= ord(c) < base + size:
                        c = chr(base + (ord(c) - base + _hash(key, "email", i, len(local), at, other) % size) % size)
                        break
                out += c
            return out

        for i in range(4):
            a, b = (shifted(a, b, i), b) if i % 2 == 0 else (a, shifted(b, a, i))
        return f"{a}{b}@{domain}"
    if value.startswith("+"):
        n = len(re.match(COUNTRY, digits)[0])
        return _refill(value, digits[:n] + _decimal(digits[n:], "phone", key))
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        try:
            day = (date.fromisoformat(value) - date(1900, 1, 1)).days
        except ValueError:
            return value
        last = (date(2099, 12, 31) - date(1900, 1, 1)).days
        if not 0 <= day <= last:
            return value
        while True:
            a, b = feistel(day // 281, day % 281, 260, 281, "date", key)
            day = a * 281 + b
            if day <= last:
                return (date(1900, 1, 1) + timedelta(days=day)).isoformat()
    if "." in value:
        p = [int(x) for x in value.split(".")]
        if any(x > 255 for x in p) or re.search(r"(^|\.)0\d", value):
            return value
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ipv4", key)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", value):
        if re.search("^(000|666|9)|^...-00|0000$", value):
            return value
        area = int(value[:3])
        a, b = feistel((area - 2 if area > 666 else area - 1) * 99 + int(value[4:6]) - 1, int(value[7:]) - 1, 898 * 99, 9999, "ssn", key)
        new = a // 99
        return f"{new + 2 if new >= 665 else new + 1:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return value
    body = digits[0] + _decimal(digits[1:-1], "card", key)
    return _refill(value, body + str(luhn(body)))


def copies(doc_id, rate, seed):
    """The Poisson draw of a document."""
    u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    n, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        n += 1
        term *= rate / n
        total += term
    return n


def fill_in_middle(doc_id, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    n, h = len(text), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", lo, hi - lo, f"<P>{prefix}<S>{suffix}<M>{middle}"


def balanced(sizes, room, linear):
    """(document, start, length, sequence, offset), the longest documents first, each to the cheapest sequence with room."""
    free, cost, out = list(room), [0] * len(room), []
    for doc in sorted(range(len(sizes)), key=lambda d: -sizes[d]):
        start = 0
        while start < sizes[doc]:
            left = sizes[doc] - start
            able = [s for s in range(len(room)) if free[s] >= left] or [s for s in range(len(room)) if free[s] > 0]
            s = min(able, key=lambda s: (cost[s], s))
            n = min(left, free[s])
            out.append((doc, start, n, s, room[s] - free[s]))
            free[s] -= n
            cost[s] += n * (linear + n)
            start += n
    return out


def check_packing(pieces, ids_of, capacity):
    """Every id of every document stands once, sequences have no gaps and are no longer than `capacity`. Their lengths."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids_of)
    for doc_id, parts in by_doc.items():
        at, ids = 0, ids_of[doc_id]
        for p in sorted(parts, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and p["length"] > 0
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + p["length"]])
            assert p["ids_crc32"] == zlib.crc32(raw) if "ids_crc32" in p else p["ids"] == raw
            at += p["length"]
        assert at == len(ids)
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        sizes.append(at)
    assert len(sizes) == -(-sum(sizes) // capacity) or sum(s < capacity for s in sizes) > 1
    return sizes


def source_divergence(rows, min_documents, top):
    """rows: (text, lang, source)."""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)), a or "", s or "") for t, a, s in rows]
    out = []
    for lang in {a for _, a, _ in rows}:
        docs = Counter(w for words, a, _ in rows if a == lang for w in set(words))
        kept = [w for w, k in docs.items() if k >= min_documents]
        sources = {s for _, a, s in rows if a == lang}
        count = {s: Counter(w for words, a, b in rows if (a, b) == (lang, s) for w in words) for s in sources}
        whole = sum(count.values(), Counter())

        def share(c):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}

        p, q = {s: share(count[s]) for s in sources}, share(whole)
        far = lambda x, y: (x - y) * (x - y) // y
        for s in sources:
            pairs = [(-sum(far(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-far(p[s][w], q[w]), w.encode()) for w in kept if count[s][w] > 0 and p[s][w] > q[w]]
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(sorted(terms)[:top], 1)]
    return out
