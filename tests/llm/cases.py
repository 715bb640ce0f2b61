"""Documents with every awkward case: null ids and texts, empty and long texts, repeated rows, extra columns whose
names clash with those operators use."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, host string, shard int, score double"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def texts() -> list[str | None]:
    long = words(9000, 1)
    base = words(120, 2)
    near = base.split()
    near[60] = "changed"
    line = "this very line stands in many documents"
    return [
        None, "", "   \n\t ", "one", "two words", base, base, " ".join(near), long, "\n".join([line, words(60, 3)]), "\n".join([words(60, 4), "  " + line.upper() + " "]),
        line, "\n".join([line, line, words(70, 5)]), "same same same same " * 40, "Ünï ß É 漢字 😀! \x1c \x85 a" + chr(0x2003) + "b", words(55, 6), words(55, 7),
    ]


def documents(spark):
    rows = [(i, t, "en", None if i == 3 else f"src{i % 3}", None if t is None else len(t), "k", "f", "h", 1, 0.5) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, "no id " + words(60, 8), None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
