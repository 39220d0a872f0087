"""What the operators compute, by plain loops."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_RANKS, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def base_figures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = WORDS.findall(text or "")
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def fingerprint(text, size=3, family=0):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    h = [mix((x + family * 0x9E3779B97F4A7C15) % 2**64) for x in h] if family else h
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def near(rows, size=3, families=1):
    """Of (doc_id, text) rows: fingerprints, numbers of links, least doc_id of each one's component, component."""
    prints = [[fingerprint(t, size, k) for k in range(families)] for _, t in rows]
    links = [[j for j in range(len(rows)) if any((a ^ b).bit_count() <= 3 for a, b in zip(prints[i], prints[j]))] for i in range(len(rows))]
    root = list(range(len(rows)))
    while (new := [min(root[j] for j in own) for own in links]) != root:
        root = new
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [p[0] for p in prints], [len(own) - 1 for own in links], [least[r] for r in root], root


def without_lines(rows, least):
    """The texts without lines of recurring templates but the first."""
    field = lambda w: bool(re.search(r"[0-9@]|://", w))
    lines = [[re.findall(r"[^\x20\x09-\x0D]+", x) for x in (t or "").split("\n")] for _, t in rows]
    leaf = lambda w: (len(w), *("<*>" if field(x) else x for x in w[:2]))
    leaves = Counter(leaf(w) for own in lines for w in own if w)
    held = Counter((leaf(w), k, x) for own in lines for w in own for k, x in enumerate(w) if k > 1 and not field(x))

    def template(w):
        if not w or leaves[leaf(w)] < least:
            return None
        out = tuple("<*>" if field(x) or (k > 1 and held[leaf(w), k, x] < least) else x for k, x in enumerate(w))
        constant = sum(x != "<*>" for x in out)
        return out if constant and 4 * constant >= 3 * sum(not field(x) for x in w) else None

    keys = [((-(2**63) if i is None else i), t) for i, t in rows]
    templates = [list(map(template, own)) for own in lines]
    docs = Counter(x for key, own in {k: o for k, o in zip(keys, templates)}.items() for x in set(own) if x)
    firsts = {}
    for (i, t), own in zip(keys, templates):
        for k, x in enumerate(own):
            if x and docs[x] >= least:
                firsts[x] = min(firsts.get(x, (i, t, k)), (i, t, k))  # here no doc_id has two texts with lines of a template
    out = []
    for (i, t), own in zip(keys, templates):
        kept = [line for k, (line, x) in enumerate(zip((t or "").split("\n"), own)) if x not in firsts or firsts[x] == (i, t, k)]
        out.append(t if t is None else "\n".join(kept))
    return out


def tokens(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def tiles(pattern, text, least):
    """Lengths of greedy string tiles, by comparing all places again and again."""
    places, used_p, used_t, out = {}, set(), set(), []
    for j, x in enumerate(text):
        places.setdefault(x, []).append(j)
    while True:
        found = {}
        for i, x in enumerate(pattern):
            for j in places.get(x, ()):
                k = 0
                while i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k] and i + k not in used_p and j + k not in used_t:
                    k += 1
                if k >= least:
                    found.setdefault(k, []).append((i, j))
        if not found:
            return out
        k = max(found)
        for i, j in found[k]:
            if not used_p & {*range(i, i + k)} and not used_t & {*range(j, j + k)}:
                used_p |= {*range(i, i + k)}
                used_t |= {*range(j, j + k)}
                out.append(k)


def overlap(text, items):
    """n_items, item_id, item_tokens, covered, longest of a text against (item_id, text) items in order of item_id."""
    own, n, best = tokens(text), 0, (None, 0, 0, 0)
    grams = {size: {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} for size in range(1, 6)}
    for item, words in items:
        p = tokens(words)
        size = min(5, len(p))
        if p and any(tuple(p[i : i + size]) in grams[size] for i in range(len(p) - size + 1)):
            got = tiles(p, own, size)
            n += 1
            if best[0] is None or sum(got) * best[1] > best[2] * len(p):
                best = (item, len(p), sum(got), got[0])
    return n, *best


def coverage(text, items):
    """The largest share of an item under tiles."""
    _, _, size, covered, _ = overlap(text, list(enumerate(items)))
    return covered / size if size else 0.0


def reads(net, text):
    """The shares that a network gives a text, read byte by byte."""
    h, p = net.hidden, {k: v.astype(float) for k, v in net.p.items()}
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def states(d, symbols):
        state, out = np.zeros(h), []
        for x in symbols:
            i, g = p["embed"][x] @ p[f"{d}x"] + p[f"{d}c"], state @ p[f"{d}h"]
            z, r = logistic(i[:h] + g[:h]), logistic(i[h : 2 * h] + g[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(i[2 * h :] + r * g[2 * h :])
            out.append(state)
        return out

    total = np.zeros(len(net.languages))
    for a in range(0, len(text), 384):
        start, stop, end = max(0, a - 64), min(len(text), a + 384 + 64), min(len(text), a + 384)
        symbols = [*text[start:stop], *[256] * (-(stop - start) % 32)]
        for k, (f, b) in enumerate(zip(states("f", symbols), states("b", symbols[::-1])[::-1])):
            if a <= start + k < end:
                logits = np.concatenate((f, b)) @ p["out"] + p["bias"]
                total += logits - np.log(np.exp(logits).sum())
    share = np.exp(total / len(text) - (total / len(text)).max())
    return share / share.sum()


def quality(model, text):
    """The probability that a quality model gives a text, feature by feature."""
    low = lambda x: x & (1 << 64) - 1
    words, weight = WORDS.findall(text or ""), lambda x: model.weights[x >> 46]
    hashes, logit = [xxhash.xxh64_intdigest(w.encode()) for w in words], model.bias
    for w, x in zip(words, hashes):
        c = [*map(ord, f"<{w}>")]
        three = [c[i] | c[i + 1] << 21 | low(c[i + 2] << 42) for i in range(len(c) - 2)]
        runs = [mix(low(v + (3 << 60))) for v in three] + [mix(low(low(mix(three[i]) + c[i + 3]) + (4 << 60))) for i in range(len(c) - 3)]
        logit += (weight(x) + sum(map(weight, runs)) / len(runs)) / len(words)
    logit += sum(weight(mix(low(a * 3 + b))) for a, b in zip(hashes, hashes[1:])) / max(1, len(words) - 1)
    return 1 / (1 + np.exp(-np.clip(model.slope * logit + model.shift, -40, 40)))
