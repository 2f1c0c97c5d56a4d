"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def token_ids(path, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def pieces(ids, capacity=2048):
    """(piece, start, length, crc) of ids with the end id; cut from the end."""
    ids = [*ids, 0]
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    return [(k, s, min(capacity, len(ids) - s) if k else first, crc(ids[s : (s + capacity if k else first)])) for k, s in enumerate(starts)]


def quality(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
    n = len(own)
    return n, sum(map(len, own)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def word_windows(docs, window=13):
    """docs: (doc_id, text), doc_ids distinct; doc_id -> n_words, n_removed, kept text."""
    first = {}
    own = {d: words(t) for d, t in docs}
    for d in sorted(own):
        for i in range(len(own[d]) - window + 1):
            first.setdefault(tuple(own[d][i : i + window]), d)
    out = {}
    for d, w in own.items():
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(window)}
        out[d] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def simhash(text):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(fingerprints, most=3):
    """doc_id -> smallest doc_id reachable."""
    ids = sorted(fingerprints)
    values = np.array([fingerprints[d] for d in ids], "uint64")
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= most) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return {d: ids[root(i)] for i, d in enumerate(ids)}


def byte_repeats(texts, length=400):
    """texts: key -> text; key -> n_bytes, n_removed, n_spans, kept bytes."""
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = defaultdict(int)
    for b in data.values():
        for i in range(len(b) - length + 1):
            seen[hashlib.md5(b[i : i + length]).digest()] += 1
    out = {}
    for k, b in data.items():
        change = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[hashlib.md5(b[i : i + length]).digest()] > 1:
                change[i] += 1
                change[i + length] -= 1
        gone = np.cumsum(change[:-1]) > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[k] = len(b), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(b, "u1")[~gone])
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """source -> target; sizes: source -> size; excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / total > most * sizes[s]}
        if not full:
            return out | {s: rest * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        rest -= sum(out[s] for s in full)
        open_ -= full
    return out


def preference(turns):
    """turns: (conv_id, turn, role, text); pair_id -> n_common, prompt, chosen, rejected, masks."""
    by_conv = defaultdict(list)
    for c, n, r, t in turns:
        if c is not None:
            by_conv[c].append((n, r or "", t or ""))
    out = {}
    for c in by_conv:
        if c % 2 == 0 and c + 1 in by_conv:
            a, b = ([(r, t) for _, r, t in sorted(by_conv[x], key=lambda x: (x[0] is not None, x))] for x in (c, c + 1))
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1

            def render(part):
                text, spans = "", []
                for r, t in part:
                    start = len(text) + len(r) + 5
                    text += f"<|{r}|>\n{t}<|end|>\n"
                    if r == "assistant":
                        spans.append(f"{start}-{len(text) - 1}")
                return text, ",".join(spans)

            out[c // 2] = (n, render(a[:n])[0], *render(a[n:])[:1], *render(b[n:])[:1], render(a[n:])[1], render(b[n:])[1])
    return out


# The parse of op8, symbol by symbol; hashes are the module's own, everything else is written anew.


def tossed(names):
    """Labels after four rounds: place and value of the lowest bit in which a symbol differs from the one before."""
    for _ in range(4):
        before = [names[0] ^ 1, *names[:-1]]
        labels = []
        for a, b in zip(names, before):
            k = 0
            while (a >> k & 1) == (b >> k & 1):
                k += 1
            labels.append(2 * k + (a >> k & 1))
        names = labels
    return names


def runs(symbols):
    """(symbol, how many) of neighbors that are equal."""
    out = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return out


def phrases(symbols):
    """A level of phrases as lists of (symbol, run length): they start at the text's start and at local maxima of the labels."""
    own = runs(symbols)
    label = tossed([s for s, _ in own])
    starts = [0] + [i for i in range(1, len(own) - 1) if label[i] > label[i - 1] and label[i] > label[i + 1]]
    return [own[a:b] for a, b in zip(starts, [*starts[1:], len(own)])]


def cascade(text):
    """The rules that reject a text, in their order."""
    n, chars, symbols, dup, repeat, _ = quality(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    found = {
        "few_words": n < 50,
        "repeated_words": 100 * repeat > 50 * n,
        "symbols": 10 * symbols > n,
        "marks": 2 * (text or "").count("!") > n,
        "repeated_lines": len(lines) >= 4 and 100 * dup > 45 * len(lines),
        "word_length": not 1.5 * n <= chars <= 25 * n,
    }
    return [k for k, v in found.items() if v]


def feistel(n, shards, round_keys, mix):
    """Row number -> (shard, slot): the network written for one number at a time."""
    half = 1
    while 4**half < n:
        half += 1
    low = (1 << half) - 1
    out = []
    for k in range(n):
        place = k
        while True:
            left, right = place >> half, place & low
            for key in round_keys:
                left, right = right, left ^ (mix((right + key) % 2**64) & low)
            place = left << half | right
            if place < n:
                break
        out.append((place % shards, place // shards))
    return out


def mix(x):
    """splitmix64's finalizer."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def fingerprint(text, levels=3, slots=64):
    """op8's slots: of each class of phrase names the least hash, in 16 bits."""
    names, best = list((text or "").encode()), [None] * slots
    for level in range(1, levels + 1):
        if not names:
            break
        above = []
        for phrase in phrases(names):
            h = 0
            for k, (s, run) in enumerate(phrase):
                wide = (s + 1) % 2**64
                if run > 1:
                    wide = mix((wide * 0xA0761D6478BD642F + run) % 2**64)
                h = (h + wide * pow(0x9E3779B97F4A7C15, k, 2**64)) % 2**64
            above.append(mix(h ^ len(phrase)))
        names = above
        for name in names:
            own = mix((name + level) % 2**64)
            slot = own % 16 if level == 1 else own % 48 + 16
            best[slot] = own if best[slot] is None else min(best[slot], own)
    return [0 if b is None else mix(b) % 65535 + 1 for b in best]


def alike(a, b):
    either = sum(1 for x, y in zip(a, b) if x or y)
    return sum(1 for x, y in zip(a, b) if x and x == y) / either if either else 1.0


def shingles(text, size=5):
    """The set of a text's shingles, lower-cased in A-Z; a shorter text is one shingle."""
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1)))


def similarities(texts, size=5):
    """(key, key) -> Jaccard similarity of all pairs of texts that share a shingle; texts: key -> text."""
    holders, sets, shared = defaultdict(list), {k: shingles(t, size) for k, t in texts.items()}, Counter()
    for k in sorted(sets):
        for s in sets[k]:
            holders[s].append(k)
    for own in holders.values():
        for j, b in enumerate(own):
            for a in own[:j]:
                shared[a, b] += 1
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
