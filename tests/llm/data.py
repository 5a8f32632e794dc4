"""Small tables with the awkward cases every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, rid string, ids string, label int"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def rows(seed=1):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(seed)
    out = []
    for i in range(40):
        out.append((i, words(rng, rng.randrange(1, 90)), "en", f"src{i % 4}"))
    out += [(40, None, None, None), (None, "no id here", "en", "src0"), (None, None, None, "src1"), (41, "", "en", "src2")]
    out += [(42, "   \n\t ", "en", None), (43, words(rng, 20000), "en", "src0"), (44, "é中😀 don't stop", "fr", "src1")]
    out += [(45, out[3][1], "en", "src3"), (3, out[3][1], "en", "src3"), (3, out[3][1], "en", "src3"), (5, "another text", "en", None)]
    return [(*r, None if r[1] is None else len(r[1]), i, "clash", "clash", i % 2) for i, r in enumerate(out)]


def documents(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def thue_morse(n):
    """A word and its complement, which collide modulo 2**64 at every odd base from 512 letters on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def colliding():
    """Texts that differ by such words alone."""
    out = []
    for n in (512, 1024, 2048):
        one, two = thue_morse(n)
        out += [f"x {one} y {two}", f"x {two} y {one}", one, two]
    return out
