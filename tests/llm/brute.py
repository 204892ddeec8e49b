"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=True):
    text = text or ""
    return WORD.findall(text.translate(UPPER) if fold else text)


def shingles(text, k=5):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def classes(docs):
    """Per row: (doc_id, shingles, component), null where a class has no doc_id."""
    sets = [frozenset(shingles(t)) for _, t in docs]
    distinct = list({s for s in sets if s})
    at = {s: i for i, s in enumerate(distinct)}
    holders = defaultdict(list)
    for i, s in enumerate(distinct):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(distinct):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & distinct[j])
            if 100 * both >= 75 * (len(s) + len(distinct[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for (d, _), s in zip(docs, sets):
        if s and d is not None:
            r = root(at[s])
            least[r] = min(least.get(r, d), d)
    return sorted(
        ((d, len(s), least.get(root(at[s]), d) if s else d) for (d, _), s in zip(docs, sets)), key=repr)


def spans(text, rules):
    found = []
    for i, r in enumerate(rules):
        for m in re.finditer(("(?i)" if r.any_case else "") + r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), i, m.end()))
    return sorted(found)


def listed(found, rules):
    return ",".join(f"{rules[i].kind}:{a}:{b}" for a, i, b in found)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = words(text, fold=False)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    repeated = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated))


def aligned(a, b, match=2, mismatch=-1, gap=-1):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch),
                             rows[i - 1][j] + gap, rows[i][j - 1] + gap)
    return max(map(max, rows))


def trie(rows):
    """All prefixes of all rebuilt conversations, each with its members, in one dictionary."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        turns.sort(key=lambda t: t[:2])
    for c, turns in own.items():
        cut = zlib.crc32(str(c).encode()) % 6
        start = own.get(c - int(math.fmod(c, 100)), [])
        paths[c] = [t[2:] for t in start[:cut]] + [t[2:] for t in turns[cut:]]
    members, children = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    for q in members:
        if q:
            children[q[:-1]].append(q)
    leaves, saved = {}, {}
    for q in sorted(members, key=len, reverse=True):
        saved[q] = (len(members[q]) - 1) * (len(q[-1][1]) if q else 0) + sum(saved[k] for k in children[q])
        leaves[q] = sum(leaves[k] for k in children[q]) or 1
    ends = {q: ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(q)) for q, m in members.items()}
    return [(min(m), len(q), min(members[q[:-1]]) if q else None, len(m), len(children[q]), leaves[q], saved[q],
             hashlib.sha256(ends[q].encode()).hexdigest()) for q, m in members.items()]


def audit(rows, least=30, top=50):
    """Every kept term of a language for every source."""
    docs, groups = Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        groups[lang or "", source or ""].update(terms)
        docs.update((lang or "", t) for t in set(terms))
    out = []
    for lang in {a for a, _ in groups}:
        kept = [t for (a, t), n in docs.items() if a == lang and n >= least]
        whole = Counter()
        for (a, _), counts in groups.items():
            if a == lang:
                whole.update(counts)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q, shares = share(whole), {s: share(c) for (a, s), c in groups.items() if a == lang}
        for s, p in shares.items():
            pairs = sorted((-sum(abs(p[t] - o[t]) for t in kept), other.encode()) for other, o in shares.items() if other != s)
            terms = sorted((q[t] - p[t], t.encode()) for t in kept if groups[lang, s][t] and p[t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms))
                    for i, (v, item) in enumerate(found)]
    return out
