"""Plain restatements of the contracts, for small inputs."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def a_to_z(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def fingerprint(text):
    words = WORD.findall(a_to_z(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Smallest index reachable, for a list of fingerprints."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def secrets(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, rx, ok) in enumerate(BASE) for m in rx.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def substring_removed(texts, length=400):
    """Per text: removed positions."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def leak_words(text):
    apart = regex.sub("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])", r" \1 ", (text or "").lower())
    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", apart) if w]


def leaks(docs, items, window=13, span=8):
    """(doc, item) with a window in which enough words agree, by trying every shift."""
    out = set()
    for d, text in docs:
        w = leak_words(text)
        for i, item in items:
            x = leak_words(item)
            if not x:
                continue
            size = min(window, len(x))
            need = -(-size * 8 // 10) if size >= 7 else size
            for shift in range(-len(x) + 1, len(w)):
                same = [int(0 <= k + shift < len(w) and w[k + shift] == x[k]) for k in range(len(x))]
                valid = [0 <= k + shift < len(w) for k in range(len(x))]
                if any(all(valid[k : k + size]) and sum(same[k : k + size]) >= need for k in range(len(x) - size + 1)):
                    out.add((d, i))
                    break
    return out


def warc(pages):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[(html or "")].append(page_id)
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        first = min((p for p in groups[html or ""] if p is not None), default=None)
        again = page_id != first
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return out


def token_pieces(docs, tokenizer):
    out = []
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            part = np.asarray(ids[at : at + 2048], "<u4")
            out.append((d, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    return out
