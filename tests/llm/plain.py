"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def kept_lines(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept text) per row of (doc_id, text)."""
    holders = defaultdict(set)
    order = lambda i: -(2**63) if i is None else i
    split = [(i, (t or "").split("\n")) for i, t in docs]
    for i, lines in split:
        for line in lines:
            key = lower(line.strip(BLANK))
            if len(key) >= 20:
                holders[key].add(order(i))
    out = []
    for i, lines in split:
        keys = [lower(line.strip(BLANK)) for line in lines]
        stay = [len(holders.get(k, ())) < 3 or max(holders[k]) == order(i) for k in keys]
        out.append((i, len(lines), stay.count(False), "\n".join(line for line, s in zip(lines, stay, strict=True) if s)))
    return out


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = Counter(windows)
    covered = {p for k, w in enumerate(windows) if count[w] > 1 for p in range(k, k + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def link_groups(docs: list[tuple], width: int) -> dict:
    """doc_id -> (set size, smallest doc_id reachable); ids are unique and not null."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: list[int]) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        if place % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def host_and_path(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host: str, path: str, rules) -> tuple[str | None, str | None]:
    fits = [(h + p, says) for says, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item_id, rank, doc_id, score) for rows of (doc_id, text) and (item_id, text); ids are not null."""
    bags = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(term for _, b in bags for term in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            m = 25 + (75 * bag.total() * n) // total
            score = 0
            for term in TERM.findall(lower(text or "")):
                if tf := bag[term]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, place + 1, i, -score) for place, (score, i) in enumerate(sorted(found)[:k])]
    return out


def manifest(docs: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded root, verified) for rows of (doc_id, source, lang, n_chars, text)."""

    def field(v) -> str:
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(digests: list[str]) -> tuple[str, list[list]]:
        steps, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for i, p in enumerate(at):
                first = p // 3 * 3
                steps[i].append(("".join(digests[first:p]), "".join(digests[p + 1 : first + 3])))
                at[i] = p // 3
            digests = [sha("".join(digests[i : i + 3])) for i in range(0, len(digests), 3)]
        return digests[0], steps

    sources = defaultdict(list)
    for doc_id, source, lang, n_chars, text in docs:
        cut = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        leaf, changed = (sha("".join(map(field, (doc_id, source, lang, n_chars, t)))) for t in (text, cut))
        sources[source].append((-(2**70) if doc_id is None else doc_id, leaf, changed, doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([row[1] for row in sorted(sources[s], key=lambda r: r[:3])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, leaf, changed, doc_id), own in zip(sorted(sources[s], key=lambda r: r[:3]), trees[s][1], strict=True):
            reached = changed
            for before, after in own + up:
                reached = sha(before + reached + after)
            out.append((doc_id, leaf, trees[s][0], root, sha("".join(b + a for b, a in own + up)), reached, reached == root))
    return out
