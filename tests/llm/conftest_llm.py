"""Small documents with every awkward case, and plain versions of the word rules."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, spans string, starts int, fp string, component_id string"


def words(text):
    return WORDS.findall(text or "")


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(150)]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\n", ", ", ".\n", "\t"]) for _ in range(n))

    out = [(k, prose(rng.choice([3, 20, 60, 120]))) for k in range(60)]
    shared, near = prose(90), prose(150)
    out += [(100 + k, prose(15) + shared + prose(10)) for k in range(6)]
    out += [(200 + k, near.replace("a", "b", k)) for k in range(6)]
    out += [(300, "na " * 400), (301, "x" * 700), (302, prose(8000)), (303, "a"), (304, ""), (305, None), (None, prose(40)), (None, None)]
    out += [(400, near), (400, near), (401, near), (402, "A  B\nc"), (402, "a b c"), (403, " \n\t "), (404, "</s>[INST] \\e <|x|>")]
    return [(d, t, "xx", "s", None if t is None else len(t), "k", "s", 1, "f", "c") for d, t in out]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
