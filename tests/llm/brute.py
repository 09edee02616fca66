"""Plain versions of the operators for small tables, straight from their contracts."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _covered(items: dict, length: int) -> dict[int, list[bool]]:
    least: dict = {}
    for doc, seq in items.items():
        for i in range(len(seq) - length + 1):
            key = seq[i : i + length]
            least[key] = min(least.get(key, doc), doc)
    out = {}
    for doc, seq in items.items():
        gone = [False] * len(seq)
        for i in range(len(seq) - length + 1):
            if least[seq[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        out[doc] = gone
    return out


def repeated_words(docs, length: int = 13) -> set[tuple]:
    items = {d: tuple(WORD.findall(t or "")) for d, t in docs}
    gone = _covered(items, length)
    return {
        (d, len(w), sum(gone[d]), sha(" ".join(x for x, g in zip(w, gone[d]) if not g).encode())) for d, w in items.items()
    }


def repeated_bytes(docs, length: int = 50) -> set[tuple]:
    items = {d: (t or "").encode() for d, t in docs}
    gone = _covered(items, length)
    rows = set()
    for d, data in items.items():
        g = gone[d]
        spans = sum(g[i] and not (i and g[i - 1]) for i in range(len(g)))
        rows.add((d, len(data), sum(g), spans, sha(bytes(b for b, x in zip(data, g) if not x))))
    return rows


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal_base(text: str) -> list[tuple[int, int, str, int]]:
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0

    found = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        s = re.sub(r"\D", "", m[0])
        if 12 <= len(s) <= 19 and luhn(s):
            found.append((m.start(), 2, "card", m.end()))
    found += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def shingle_set(text) -> set:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_components(docs) -> set[tuple]:
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    postings: dict = {}
    for d, s in sets.items():
        for x in s:
            postings.setdefault(x, []).append(d)
    shared: dict = {}
    for ds in postings.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(d, len(s), root(d)) for d, s in sets.items()}


def base_rules(doc, text) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(repeated), failed


PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, window: int = 10) -> set[tuple]:
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sought: dict = {}
    for item, text in items:
        words = PLAIN_WORD.findall(lower(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            sought.setdefault(tuple(words[i : i + n]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in sought}
    rows = set()
    for doc, text in docs:
        words = PLAIN_WORD.findall(lower(text))
        hit, names = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = sought.get(tuple(words[i : i + n]))
                if found:
                    names |= found
                    hit |= set(range(i, i + n))
        rows.add((doc, len(words), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit)))
    return rows


URL_RULES = [("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/")]


def url_parts(url) -> tuple:
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    for h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            return host, path, h + p
    return host, path, None
