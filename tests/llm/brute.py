"""Plain Python versions of what the operators compute."""

import base64
import re


def brute_lines(texts, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    seen = {}
    for lines in split:
        for k in {key(x) for x in lines} - {""}:
            seen[k] = seen.get(k, 0) + 1
    return [("\n".join(x for x in lines if seen.get(key(x), 0) < least), len(lines), sum(seen.get(key(x), 0) >= least for x in lines)) for lines in split]


def brute_contained(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = set()
    for i, t in items:
        q = sh(words(t))
        for d, x in docs:
            both = len(q & sh(words(x)))
            if q and both >= 0.8 * len(q) - 1e-9:
                out.add((d, i, both, len(q)))
    return out


def brute_print(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, budget=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def brute_base(text):
    found = [(*m.span(), 0) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, ("assign", "access", "hex")[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def brute_tokenizer():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
