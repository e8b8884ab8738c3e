"""Small inputs that the operator tests share."""

import random

LONG = "word " * 20_000 + "end"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
KIND = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, key int, rank int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))


def texts() -> dict[int, str | None]:
    """Ids and texts with copies, near copies, repeated lines, odd white space, other scripts and long texts."""
    out: dict[int, str | None] = {i: prose(i, 30 + i) for i in range(12)}
    base = prose(100, 120)
    words = base.split()
    out |= {20: base, 21: base, 22: " ".join(words[:-6]), 23: "\t" + base.upper() + " ", 24: " ".join(words[4:] + ["tail"])}
    out |= {30: None, 31: "", 32: " \n\t ", 33: "one two three", 34: "ONE two three", 35: "One\x0bTWO three"}
    shared = "This line stands in many documents\n"
    out |= {40 + i: shared + prose(200 + i, 20) + "\n" + shared.strip().upper() + "\n\n" for i in range(6)}
    out |= {50: LONG, 51: LONG, 52: "汉字 かな 😀 é \x1c\x85 ｆｕｌｌ", 53: "a\r\nb\nshort", 54: "İ ſ K"}
    return out


def documents(spark):
    """The texts as a table whose further columns clash with names that operators use."""
    sources = ["b", "a", None, "é", "a"]
    rows = [
        (i, t, None if i % 5 == 0 else "en", sources[i % 5], None if t is None else len(t), "own", 7, 3)
        for i, t in texts().items()
    ]
    rows += [rows[0], (None, "a text without an id and long enough", "en", "a", 1, None, None, None)]
    return spark.createDataFrame(rows, KIND)
