"""Brute-force versions in plain Python, written from the definitions."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations


def digest(spans, kinds):
    spans = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return text, hashlib.sha256(text.encode()).hexdigest()


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


SECRETS = {
    "assign": r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def secrets(text):
    out = []
    for kind, pattern in SECRETS.items():
        for m in re.finditer(pattern, text or ""):
            least = {"assign": 8, "access": 16, "hex": 32}[kind]
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                out.append((kind, m.start(), m.end()))
    return out


def shingle_set(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def pairs_above(sets, ok):
    """Index pairs that share a member and pass ``ok``."""
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    seen = set()
    for rows in where.values():
        seen.update(combinations(rows, 2))
    return [(i, j) for i, j in seen if ok(sets[i], sets[j])]


def components(ids, texts, n=4, percent=85):
    sets = [shingle_set(t, n) for t in texts]
    forest, first = Forest(), {}
    node = []
    for s in sets:
        node.append(first.setdefault(s, len(first)) if s else None)
    distinct = list(first)
    for i, j in pairs_above(distinct, lambda a, b: 100 * len(a & b) >= percent * len(a | b)):
        forest.join(i, j)
    least = {}
    for i, v in zip(ids, node, strict=True):
        if v is not None and i is not None:
            r = forest.find(v)
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), i if v is None else least.get(forest.find(v))) for i, s, v in zip(ids, sets, node, strict=True)]
