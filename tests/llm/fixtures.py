"""Small inputs that every operator is tried on."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "la mer est un grand lac of the old town and its many boats Straße 日本 naïve ΑΣ tab\tbed vt\x0bx nbsp\xa0y".split(" ")


def odd_texts():
    """Null, empty, blank, one word, repeats, long, astral and control characters."""
    rng = random.Random(7)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(6000))
    return [None, "", " \n\t ", "one", "two words", "a\nb\na\n\n \nb", "x " * 400, long, long, "😀 😀\x1c😀 <|endoftext|>",
            "É́ ſ K İ ß", "\x00 nul \x00", "#*$%&|<> " * 30, "same line here\n" * 60]


def documents(spark, texts=None, **extra):
    """One row per text, then the first rows again, a null id and a null row; extra adds columns with one value."""
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "aa" if i % 2 else "bb", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += rows[:3] + [(None, texts[-1] if texts else "x", None, None, None), (None, None, None, None, None)]
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in extra.items()})


def near_texts(rng, groups=12, copies=4, words=120):
    """Groups of texts that differ in a word or not at all, and a chain of small edits."""
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words * (1 + g % 3))]
        for c in range(copies):
            own = list(base)
            if c > 1:
                own[rng.randrange(len(own))] = f"edit{c}"
            texts.append(" ".join(own))
    return texts
