"""Plain restatements of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def lower_ascii(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))


def spaced_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))


def contamination(text, items, window=10):
    """(n_words, hit positions, item ids) by looking every window up."""
    windows = defaultdict(set)
    for item, body in items:
        w = alnum_words(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            if n:
                windows[tuple(w[i:i + n])].add(item)
    w, hit, found = alnum_words(text), set(), set()
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            if (k := tuple(w[i:i + n])) in windows:
                hit.update(range(i, i + n))
                found |= windows[k]
    return len(w), hit, {str(x) for x in found if x is not None}


def shingle_set(text, k=5):
    w = spaced_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(sets: list[frozenset], percent=85) -> list[int]:
    """Smallest index of each set's component."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def recurring(docs, min_docs, min_constant=0.7, min_tokens=3, depth=3):
    """docs: (id, text) rows -> {(id, text): set of masked lines whose template recurs}."""
    def masked(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\x0B\f\r]+", line) if t)

    rows = {r for r in docs if r[1] is not None}
    lines = {(r, m) for r in rows for x in r[1].split("\n") if len(m := masked(x)) >= min_tokens}
    leaf = lambda m: (len(m), m[:depth])
    reach = Counter(leaf(m) for _, m in lines)
    near = {(r, m) for r, m in lines if reach[leaf(m)] >= min_docs}
    met = Counter((leaf(m), p, t) for _, m in near for p, t in enumerate(m))
    template = {}
    for _, m in near:
        t = tuple(x if met[leaf(m), p, x] >= min_docs else "<*>" for p, x in enumerate(m))
        if sum(x != "<*>" for x in t) / len(t) >= min_constant:
            template[m] = t
    often = Counter(t for _, t in {(r, template[m]) for r, m in near if m in template})
    out = defaultdict(set)
    for r, m in near:
        if m in template and often[template[m]] >= min_docs:
            out[r].add(m)
    return out, masked


def cleaned(docs, min_docs, max_share=0.5, percent=80):
    """docs: (id, text) rows -> {(id, text): (recurring lines, text without them, or None where it is left whole)}."""
    flags, masked = recurring(docs, min_docs)
    out, over = {}, []
    for r in {r for r in docs if r[1] is not None}:
        lines = r[1].split("\n")
        bad = [masked(x) in flags.get(r, ()) for x in lines]
        words, gone = sum(len(masked(x)) for x in lines), sum(len(masked(x)) for x, b in zip(lines, bad) if b)
        drop = any(bad) and gone < words
        out[r] = sum(bad), "\n".join(x for x, b in zip(lines, bad) if not b) if drop else None
        if any(bad) and gone > max_share * words:
            over.append((r, shingle_set(r[1])))
    for k, (r, a) in enumerate(over):
        if any(a and 100 * len(a & b) >= percent * len(a | b) for j, (_, b) in enumerate(over) if j != k):
            out[r] = out[r][0], None
    return out


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(assign, text, re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def linked(text: str | None, reach=200) -> list[tuple[str, int, int]]:
    """Base spans with the weak candidates whose complements are near."""
    text, base = text or "", secrets(text)
    ids = [("key_id", *m.span()) for m in re.finditer(r"(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}", text)]
    bare = [("bare", *m.span()) for m in re.finditer(r"[A-Za-z0-9+/]{24,}", text)
            if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))
            and not any(a < m.end() and m.start() < b for _, a, b in base)]
    ends = [("endpoint", *m.span()) for m in re.finditer(r"https?://[A-Za-z0-9._:/-]+", text)]
    part = {"assign": "secret", "hex": "secret", "bare": "secret", "access": "id", "key_id": "id", "endpoint": "endpoint"}
    need = {"key_id": ["secret"], "bare": ["id"], "endpoint": ["id", "secret"]}
    every = base + ids + bare + ends
    kept = [w for w in ids + bare + ends
            if all(any(part[o[0]] == n and abs(o[1] - w[1]) <= reach for o in every) for n in need[w[0]])]
    order = ["assign", "access", "hex", "key_id", "bare", "endpoint"]
    return sorted(base + kept, key=lambda s: (s[1], order.index(s[0])))


# --------------------------------------------------------------------------- conversation tries and manifests
def rebuilt(rows) -> dict:
    """conv_id -> turns (role, text): each begins with turns of conversation c - c % 5."""
    turns: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = ((role or ""), (text or ""))
            digest = hashlib.sha256(f"{len(key[0].encode())}:{key[0]}{key[1]}".encode()).hexdigest()[:32]
            turns.setdefault(c, []).append(((turn is not None, turn or 0), digest, key))
    turns = {c: [k for _, _, k in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def trie(convs: dict) -> set:
    """Nodes of the trie over conv -> turns, as the query gives them."""
    members: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    total: dict = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        below = [total[q] for q in children.get(p, ())]
        total[p] = (own + sum(s for s, _ in below), sum(n for _, n in below) or 1)
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), total[p][1], total[p][0],
             sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)))) for p, m in members.items()}


def _leaf(fields) -> str:
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _tree(nodes: list) -> tuple[str, list]:
    """Top digest, and for each node its siblings (left, right) on the way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            a = i // 16 * 16
            paths[k].append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 16])))
        nodes = [sha("".join(nodes[a:a + 16])) for a in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def merkle(rows) -> list:
    """Sorted rows of the manifest: id, leaf, subroot, root, proof digest, folded root, verified."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), _leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([leaf for _, leaf, _ in sorted(groups[s], key=lambda x: x[:2])]) for s in names]
    root, above = _tree([top for top, _ in trees]) if trees else ("", [])
    out = []
    for s, (top, paths), outer in zip(names, trees, above):
        for (_, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:2]), paths):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = _leaf((*r[:4], text))
            for a, b in path + outer:
                folded = sha(a + folded + b)
            out.append((r[0], leaf, top, root, sha("".join(a + b for a, b in path + outer)), folded, folded == root))
    return sorted(out, key=str)
