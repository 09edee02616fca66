"""Small corpora with the awkward cases: nulls, empty texts, ties, copies, near copies, long texts, odd characters."""

import random


def awkward(seed: int = 1, size: int = 60) -> list[tuple]:
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["naïve", "straße", "Ünï", "日本語", "a.b", "x@y.org", "😀"]
    passage = [pick.choice(words) for _ in range(40)]
    base = [pick.choice(words) for _ in range(70)]
    rows = []
    for i in range(size):
        kind = i % 6
        if kind == 0:
            text = [pick.choice(words) for _ in range(pick.randrange(1, 90))]
        elif kind == 1:
            text = [pick.choice(words) for _ in range(20)] + passage + [pick.choice(words) for _ in range(5)]
        elif kind == 2:
            text = list(base)
            text[pick.randrange(len(text))] = pick.choice(words)
        elif kind == 3:
            text = base
        elif kind == 4:
            text = passage[: pick.randrange(8, 20)]
        else:
            text = [*(["ha"] * 30), *passage[:15], *passage[:15]]
        rows.append((i, pick.choice([" ", "  ", "\n", "\t "]).join(text)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "one two"), (905, "one  two"), (906, "x" * 400), (907, "x" * 300)]
    pick.shuffle(rows)
    return rows
