"""Texts and brute-force answers for the near-duplicate tests."""

import collections
import math
import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def family(seed=3, copies=120, length=60):
    """One base text, copies with one to eight changed words, and unlike texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(length)]
    texts = [" ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randint(1, 8)):
            copy[rng.randrange(length)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts += ["", None, "", texts[5], "one two", "one two", "...", None]
    return list(enumerate(texts))


def classes(rows, least=0.8):
    """Smallest id of each row's class by comparing all pairs."""
    spoken = {i: words(t) for i, t in rows}
    df = collections.Counter()
    for w in spoken.values():
        df.update(set(w))
    idf = {w: round(16 * (1 + math.log((1 + len(rows)) / (1 + n)))) for w, n in df.items()}
    bags = {}
    for i, w in spoken.items():
        bag = collections.Counter()
        for k in range(max(1, len(w) - 4) if w else 0):
            gram = tuple(w[k : k + 5])
            bag[gram] += sum(idf[x] for x in gram)
        bags[i] = bag
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            same = (a or "") == (b or "")
            if not same and bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                same = both / (sum((bags[i] | bags[j]).values())) >= least
            if same:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}
