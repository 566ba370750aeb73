"""Small documents with all that may go wrong in them, and plain versions of what operators do."""

import random

WORDS = {
    "en": "the of and to in that is was for on with as his they be at one have this from".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au été".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine größe".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, h long, c string, k int"


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def documents(seed=0, n=120):
    """Rows of SCHEMA: columns with clashing names, nulls, empty, blank and long texts, copies, repeated rows, a hot source."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = sentence(rng, lang, rng.randint(1, 60)).capitalize()
        rows.append((i, text, lang, rng.choice(["a", "a", "a", "b", "ç", None]), len(text), 1, 0.5, 7, "x", 3))
    odd = [None, "", " \t\n", "1 2 3 !!", rows[0][1], rows[0][1].upper(), rows[5][1] + " extra", sentence(rng, "en", 20_000), "日本語 текст ▁ \x00 𝒳", "a" * 5000]
    for j, text in enumerate(odd):
        rows.append((n + j, text, None if j % 3 == 0 else "en", "b", None if j % 2 else 5, None, None, None, None, None))
    rows.append(rows[1])
    rows.append((None, "no id here at all", "en", "a", 3, None, None, None, None, None))
    return rows


def components(nodes, linked):
    """Smallest reachable node of each, from a predicate on pairs."""
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}
