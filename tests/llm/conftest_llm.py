"""Rows and helpers that the tests of this folder share."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, b long, size long, id string, t string, fp long, k long, copies long, component_id long, unit string, found string, batch int, turns string"


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd white space, columns whose names clash with the operators' own."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    long, passage = prose(6000), prose(70)
    texts = [None, "", " \t\n", "one", "Ein Wort\x85mehr", "a\r\nb\x0bc\x0cd", "x " * 400, long, long + " end", "\n".join(["Same line  "] * 5)]
    texts += [f"{prose(40)}\nshared LINE\t\n{prose(30)}\n  \n" for _ in range(12)]
    texts += [f"{prose(20 + i)} {passage} {prose(15)}" for i in range(5)]
    texts += ["zz" * 700, "中文" * 80, "<|endoftext|> <|im_end|> & &amp; ▁x  y ", "tail  ", " head"]
    rows = [(i, t, "en", ["s1", "s2", None, "é", "s10"][i % 5], None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[20], rows[20], (None, long, None, None, 1), (None, "null id " * 30, None, "s1", None), (-5, texts[12], "de", "s2", 3), (10**15, texts[13], "de", "s1", 3)]
    return [(*r, 1, 2, 3, "x", "y", 4, None, 7, 8, "u", "f", 9, "") for r in rows]


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
