"""Plain-loop versions of the text operators, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str | None) -> str:
    return (text or "").translate(LOWER)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs: list[tuple]) -> dict:
    """doc_id to (fingerprint, component_id), all pairs of distinct fingerprints compared."""
    prints = {d: simhash(t) for d, t in docs}
    root = {p: p for p in prints.values()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints.items():
        least[find(p)] = min(d, least.get(find(p), d))
    return {d: (f"{p:016x}", least[find(p)]) for d, p in prints.items()}


def _found(kind, pattern, text, valid=lambda m: True, flags=0):
    return [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags | re.ASCII) if valid(m)]


def _written(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], kinds.index(s[1]))))


def secret_row(text: str | None) -> tuple:
    text = text or ""
    kinds = ("assign", "access", "hex")
    spans = _found("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text,
                   lambda m: len(m[2]) >= 12, re.IGNORECASE)
    spans += _found("access", "AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 18)
    spans += _found("hex", "[0-9a-f]+", text, lambda m: len(m[0]) >= 16)
    written = _written(spans, kinds)
    return (*(sum(s[1] == k for s in spans) for k in kinds), sha(written)), written


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal_row(text: str | None) -> tuple:
    text = text or ""
    kinds = ("email", "ip", "card", "phone")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = _found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    spans += _found("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split(".")))
    spans += _found("card", r"[0-9]([\x20-]?[0-9])+", text, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)))
    spans += _found("phone", r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= len(digits(m)) <= 15)
    written = _written(spans, kinds)
    return (*(sum(s[1] == k for s in spans) for k in kinds), sha(written)), written


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs: list[tuple], benchmark: list[tuple]) -> dict:
    windows = defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(item)
    lengths = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        names = sorted(str(x) for x in items)
        out[doc] = (len(w), len(hit), len(items), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def near_words(a: list[str], b: list[str]) -> bool:
    """At most one word put in, left out or changed."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= 1


def kept_lines(docs: list[tuple], least: int = 8) -> dict:
    """doc_id to its dropped lines' numbers; documents in the order of their ids."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        gone = []
        for at, line in enumerate((text or "").split("\n")):
            if not line.strip(" "):
                continue
            w = line.split(" ")
            if line in seen:
                gone.append(at)
            else:
                if len(w) >= least and any(len(o) >= least and near_words(w, o) for o in seen.values()):
                    gone.append(at)
                seen[line] = w
        # A near line is dropped at every place; equal lines at all but the first, which is the same here.
        out[doc] = gone
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
