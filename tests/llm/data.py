"""Small documents with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __mix_size string, key long"
LINE = "The same line of many words that recurs in very many documents of this small table."


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "日本", "The", "of", "and", "x", "token"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.choice([3, 12, 40, 90])))
        if k % 5 == 0:
            text += "\n" + LINE + " " + LINE
        if k % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]  # a copy
        if k % 11 == 0 and rows and rows[-1][1]:
            text = (rows[-1][1] + " more") * 2
        rows.append([k * 3, text, "en", f"s{k % 4}", 0])
    rows[4][1], rows[9][1], rows[14][1], rows[19][1] = None, "", "   \n\t ", "one"
    rows[5][3] = None
    rows[24][1] = "long " * 30_000 + "z"
    rows[29][1] = "a\x00b▁c 😀  d\r\ne f"
    return [(*r, "clash", 7) for r in rows]


def odd_documents() -> list[tuple]:
    """Null ids, repeated ids with equal and with other texts."""
    rows = documents(30)
    return [*rows, (None, rows[0][1], None, None, None, None, None), (None, None, None, None, None, None, None), rows[3], (rows[3][0], "another text " * 20, "en", "s1", 1, None, None)]
