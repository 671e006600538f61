"""Plain versions of the operators over lists of rows, for tests on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

END = 2


def token_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [x.ids + [END] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def token_records(docs):
    """docs: (doc_id, text), distinct ids."""
    rows, start = [], 0
    docs = sorted(docs)
    for (doc, _), ids in zip(docs, token_ids([t for _, t in docs]), strict=True):
        rows.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return rows


def check_packing(docs, pieces, longest=4096, spare=0.0):
    """pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    ids = dict(zip([d for d, _ in docs], token_ids([t for _, t in docs]), strict=True))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, length, c, total, seq, offset in pieces:
        assert total == len(ids[doc]) and c == crc(ids[doc][start : start + length]) and length > 0
        by_doc[doc].append((start, length))
        by_seq[seq].append((offset, length))
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc])
    padding = used = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= longest
        used += at
        padding += 0 if at & (at - 1) == 0 else longest - at
    assert padding <= spare * used, (padding, used)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring_dedup(docs, size=13):
    first: dict[tuple, int] = {}
    split = {d: words(t) for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - size + 1):
            first.setdefault(tuple(split[d][i : i + size]), d)
    rows = []
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        rows.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(rows)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def jaccard_components(docs, size=5, percent=75):
    sets = {}
    for d, t in docs:
        w = words(lower(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for a in sets:
        shared = defaultdict(int)
        for g in sets[a]:
            for b in holders[g]:
                if b > a:
                    shared[b] += 1
        for b, n in shared.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


def periodic_runs(split):
    """All runs (start, length, period) of a list of words, lag by lag."""
    seen = {}
    for q in range(1, len(split) // 4 + 1):
        i = 0
        while i + q < len(split):
            j = i
            while j + q < len(split) and split[j] == split[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in seen.items()], key=lambda r: (r[0], r[2]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def periodic(docs):
    rows = []
    for d, t in docs:
        w = words(t)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = periodic_runs(w)
        gone = set()
        for s, length, q in runs:
            gone.update(range(s + q, s + length))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        exponent = 1000 * best[1] // best[2] if runs else None
        rows.append((d, len(runs), *best, exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                     sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(rows, key=str)


def damaged(rows):
    """rows: (conv_id, turn, role, text), None as in the table."""
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        case = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        role = "user" if case == 4 else role
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        for _ in range({0: 0, 3: 2}.get(case, 1)):
            yield conv, turn, role, text


def classified(rows):
    """rows: (turn, role, text) of one conversation in order, with the first fault of each."""
    seen, out = set(), []
    for turn, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, kind))
    return out


def cheapest_repair(rows):
    """Least (cost, audit) with the repaired rows, by the best suffix after each row and state."""
    names = {"u": "user", "a": "assistant"}
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        here = {}
        for state in follow:
            options = []
            if i == len(rows):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                _, role, text, kind = rows[i]
                options.append(_after((4, "D", ()), best[i + 1][state]))
                if kind in ("", "truncated"):
                    extra = 3 if kind else 0
                    if role[:1] and role[:1] in follow[state]:
                        options.append(_after((extra, "K", (f"{role}:{text}",)), best[i + 1][role[0]]))
                    for made in follow[state]:
                        if made in names:
                            options.append(_after((3 + extra, "R", (f"{names[made]}:{text}",)), best[i + 1][made]))
            here[state] = options
        for _ in range(4):  # insertions chain states of one place
            for state, options in list(here.items()):
                for made in follow[state]:
                    if made in names:
                        options.extend([_after((3, "I", (f"{names[made]}:",)), o) for o in sorted(here[made])[:1]])
        best[i] = {state: min(options) for state, options in here.items()}
    return best[0][""]


def _after(first, rest):
    return first[0] + rest[0], first[1] + rest[1], first[2] + rest[2]


def repaired(rows):
    """rows: (conv_id, turn, role, text) of the table, undamaged; one result for each conv_id."""
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn, role, text))
    out = []
    for conv, found in groups.items():
        key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        found = classified(sorted(found, key=key))
        turns = {r[0] for r in found} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        kinds = [sum(r[3] == k for r in found) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found[:-1], found[1:], strict=True))
        cost, audit, lines = cheapest_repair(found)
        out.append((conv, gaps, *kinds, illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)
