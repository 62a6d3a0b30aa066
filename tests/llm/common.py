"""Small document tables with the awkward cases, and brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, hits string, block string"


def corpus(seed=1, n=60):
    """Rows with nulls, empty and long texts, exact and near copies, shared passages, repeated lines and ids."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nü", "xi", "omicron", "pi"]
    line = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(k))
    passage = "\n".join(line(9) for _ in range(6))
    texts = [None, "", "  \n\t ", "one", "The same\n\nThe same\nother", "x\x0by z", "a\r\nb\r\na\r\nb"]
    while len(texts) < n:
        kind = rng.randrange(6)
        if kind == 0 and len(texts) > 10:
            texts.append(rng.choice(texts[7:]))
        elif kind == 1 and len(texts) > 10:
            own = (rng.choice(texts[7:]) or "").split(" ")
            own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
        elif kind == 2:
            texts.append("\n".join([line(8), passage, line(8)]))
        else:
            texts.append("\n".join(line(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 9))))
    texts.append("\n".join(line(25) for _ in range(300)))
    texts.append("loop " * 400)
    rows = [(i * 3 % 97, t, "en", rng.choice(["hot", "hot", "src1", None]), 0, -1, "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[20], (None, "a text without an id\n" * 3, None, None, None, None, None, None)]


def unique(rows):
    """One row per id, without the null id."""
    return list({r[0]: r for r in rows if r[0] is not None}.values())


def ordered(rows):
    """(id, words) in the order in which blocks see rows: null first, then by id and text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
