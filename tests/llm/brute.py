"""Plain versions of what the operators compute, for small tables."""

import re


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered(text))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def near_groups(texts, k, least):
    """Groups of ids whose texts reach each other by links of that similarity; texts without words stand alone."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    names = sorted(sets)
    for a, i in enumerate(names):
        for j in names[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) >= least * max(len(x), len(y)):
                both = len(x & y)
                if both >= least * (len(x) + len(y) - both):
                    root[find(j)] = find(i)
    groups = {}
    for i in names:
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def contaminated(text, items, length=13):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
    hit = set()
    for _, item in items:
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(item))
        n = min(length, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)
