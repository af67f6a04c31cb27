"""Plain single-process versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.decode() for w in (text or "").encode().translate(FOLD).split()]


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def similar(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)


def overlapping(sets):
    """For every position the earlier positions that share an element."""
    holders = defaultdict(list)
    for k, own in enumerate(sets):
        yield k, {j for s in own for j in holders[s]}
        for s in own:
            holders[s].append(k)


def components(texts):
    """Smallest linked id per id of a dict of texts."""
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    label = {i: i for i in ids}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, others in overlapping(sets):
        for j in others:
            if similar(sets[k], sets[j]):
                a, b = sorted((top(ids[j]), top(ids[k])))
                label[b] = a
    return {i: (len(s), top(i)) for i, s in zip(ids, sets)}


def repeated_lines(texts):
    places = [(i, k, shingles(s)) for i in sorted(texts) for k, s in enumerate((texts[i] or "").split("\n"))]
    sets = [p[2] for p in places]
    return {places[k][:2] for k, others in overlapping(sets) if any(similar(sets[k], sets[j]) for j in others)}


def counts(text):
    """Words, word characters, symbols, repeated lines, repeated words."""
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeat = {j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [s for s in text.split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def spelling(rows, factor=10, letters=7, times=2, typo=31):
    """Form, root, count, near words and the form's count per word of (doc_id, text) rows."""
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = w.encode().translate(FOLD).decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % typo == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= times}
    near, alike = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            alike[w[:k] + "*" + w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= factor * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def best_edits(rows):
    """Cost, initials and repaired rows of (role, text, fault) rows: the least over all states, row by row."""
    ways = {"": (0, "", ())}  # by the initials so far, s? and the last of u, a

    def inserted(ways):
        for _ in range(2):
            for state, (cost, audit, lines) in list(ways.items()):
                role = "assistant" if state[-1:] == "u" else "user"
                offer(ways, after(state, role), (cost + 3, audit + "I", (*lines, role + ":")))
        return ways

    def after(state, role):
        return state[:-1] * (state[-1:] != "s") + role[0] if state else role[0]

    def offer(ways, state, way):
        if state not in ways or way < ways[state]:
            ways[state] = way

    def allowed(state, role):
        return role[:1] == ("a" if state[-1:] == "u" else "u") or (state == "" and role[:1] == "s")

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, lines) in inserted(ways).items():
            offer(new, state, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                for other in ("user", "assistant"):
                    if allowed(state, other):
                        offer(new, after(state, other), (cost + 3 + extra, audit + "R", (*lines, f"{other}:{text}")))
                if allowed(state, role):
                    offer(new, after(state, role), (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
        ways = new
    return min(way for state, way in inserted(ways).items() if state in ("", "a"))


def conversation(rows, conv):
    """Repair of the (turn, role, text) rows of a conversation, damaged first."""
    kept = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, found = set(), []
    for _, role, text in kept:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role, text, fault))
    turns = {t for t, _, _ in kept if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = [sum(f == kind for _, _, f in found) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    cost, audit, lines = best_edits(found)
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(rows):
    """``conversation`` of every id of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for conv, *row in rows:
        own[conv].append(row)
    return {conv: conversation(r, conv) for conv, r in own.items()}


def lm_losses(rows, targets, first=None, smoothing=64.0):
    """Mean losses under the target and the background model of the first (doc_id, text) rows, by all other rows' pairs."""
    own = [(words(text), i in targets) for i, text in rows]
    seen = Counter(w for doc, _ in own for w in doc)
    known = {w for w, n in seen.items() if n >= 2}
    out = []
    for doc, mark in own[:first]:
        losses = []
        for only in (True, False):
            part = [(d, m) for d, m in own if m or not only]
            n = Counter(w if w in known else None for d, _ in part for w in d)
            total = sum(n.values()) + len(known) + 1
            others = [d for d, _ in part]
            if mark or not only:
                others.remove(doc)
            after, lead = Counter(), Counter()
            for d in others:
                for v, w in zip(["<s>", *d], d):
                    lead[v] += 1
                    after[v, w] += 1
            loss = 0.0
            for v, w in zip(["<s>", *doc], doc):
                p = (n[w if w in known else None] + 1) / total
                inside = w in known and (v in known or v == "<s>")
                loss -= math.log(((after[v, w] if inside else 0) + smoothing * p) / ((lead[v] if v in known or v == "<s>" else 0) + smoothing))
            losses.append(loss / len(doc) if doc else None)
        out.append((len(doc), *losses))
    return out
