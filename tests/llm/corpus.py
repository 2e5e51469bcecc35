"""A small corpus with copies, near copies, shared passages, nulls and odd texts."""

import random


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["an", "the", "or", "in", "re", "st", "en", "al", "ou", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \n\t ", "one", "one two three", "One  two\tTHREE", "a b c d e", "a b c d e f", "x" * 5000, "é É e"]
    passage = words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.randint(30, 160))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = "changed"
            if rng.random() < 0.4:
                near = near[rng.randint(0, 8) :] + words(rng, rng.randint(0, 5))
            out.append(" ".join(near))
        out += [" ".join(base)] * rng.randint(0, 3)
    for _ in range(15):
        own = words(rng, rng.randint(20, 80))
        out.append(" ".join(own[:10] + passage + own[10:]))
    base = words(rng, 90)
    for _ in range(60):  # one large group of near copies
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = rng.choice("pqrstuv") * 3
        out.append(" ".join(near))
    out.append(" ".join(words(rng, 8000)))
    return out
