"""Plain versions of the operators for small tables."""

import base64
import collections
import hashlib
import re
import struct

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

SF = "/root/testdata/sf0.001"


def library():
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_digests(encoding, text):
    ids = encoding.encode_ordinary(text)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(ids, fps, distance=4):
    """Smallest id reachable over links, by comparing all pairs."""
    fps = np.array(fps, dtype=np.uint64)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance).tolist()
            least = min(label[j] for j in near)
            for j in near:
                if label[j] != least:
                    label[j], changed = least, True
    return dict(zip(ids, label))


def shingle_sets(docs, size=5):
    made = {}
    for key, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        made[key] = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    return made


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_classes(docs, similarity=0.8):
    """Smallest id reachable over texts of that similarity, by comparing all pairs that share a shingle."""
    sets = shingle_sets(docs)
    holders = collections.defaultdict(list)
    for key, found in sets.items():
        for x in found or {b""}:
            holders[x].append(key)
    label = {k: k for k in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                x, y = root(a), root(b)
                if x != y and jaccard(sets[a], sets[b]) >= similarity:
                    label[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def _pieces(text, long, reach):
    """(start, end, words, begins a line) of the pieces, each word tried in every window of words around it."""
    words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    sentences = []
    for k, (s, _, _) in enumerate(words):
        line = k == 0 or "\n" in text[words[k - 1][1] : s]
        if line or words[k - 1][2][-1] in ".!?":
            sentences.append((line, []))
        sentences[-1][1].append(words[k])
    made = []
    for line, inside in sentences:
        hashes = [xxhash.xxh64_intdigest(w.encode()) for _, _, w in inside]
        cuts = {0}
        if len(inside) > long:
            for i in range(len(inside) - reach + 1):
                cuts.add(min(range(i, i + reach), key=lambda k: (hashes[k], -k)))
        order = [*sorted(cuts), len(inside)]
        made += [(inside[x][0], inside[y - 1][1], tuple(w for _, _, w in inside[x:y]), line and not x) for x, y in zip(order, order[1:])]
    return made


def without_repeats(docs, selected, noise, sure, long, reach):
    """docs: (id, text) by id. `selected` gives the numbers of the pieces that begin selected grams."""
    made = {}
    first_gram, parsed, holders = {}, {}, collections.defaultdict(set)
    for key, text in docs:
        pieces = _pieces(text, long, reach)
        grams = {}
        for i in range(len(pieces)):
            for j in range(i, len(pieces)):
                if sum(len(x[2]) for x in pieces[i : j + 1]) >= noise:
                    grams[i] = (j + 1, tuple(w for x in pieces[i : j + 1] for w in x[2]))
                    break
        picks = selected(text)
        # Every stretch of `sure` words in whole pieces holds a selected gram.
        for i in range(len(pieces)):
            for j in range(i, len(pieces)):
                if sum(len(x[2]) for x in pieces[i : j + 1]) >= sure:
                    assert any(i <= p and grams[p][0] <= j + 1 for p in picks if p in grams)
                    break
        parsed[key] = pieces, grams, picks
        for i, (_, g) in sorted(grams.items()):
            if i in picks:
                holders[g].add(key)
    shared = [keys for keys in holders.values() if len(keys) > 1]
    involved = {key for keys in shared for key in keys}
    for key in sorted(min(keys) for keys in shared):
        for i, (_, g) in sorted(parsed[key][1].items()):
            first_gram.setdefault(g, (key, i))
    for key, text in docs:
        pieces, grams, picks = parsed[key]
        own = {}
        for i, (_, g) in sorted(grams.items()):
            own.setdefault(g, i)
        later = [i for i, (_, g) in sorted(grams.items()) if own[g] < i or key in involved and first_gram.get(g, (key,))[0] < key]
        seed = [i for i in later if i in picks]
        runs = []
        for i in later:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], grams[i][0])
                runs[-1][2] |= i in seed
            else:
                runs.append([i, grams[i][0], i in seed])
        at, parts = 0, []
        for a, b in [(a, b) for a, b, ok in runs if ok]:
            whole = pieces[a][3]
            parts.append(text[at : pieces[a][0] if whole else pieces[a - 1][1]])
            at = pieces[b - 1][1] if not whole else pieces[b][0] if b < len(pieces) else len(text)
        made[key] = "".join([*parts, text[at:]])
    return made


def edits_inside(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        above, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (a != b))
    return min(row)


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(max(0, len(words) - 2))]
    often = collections.Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
