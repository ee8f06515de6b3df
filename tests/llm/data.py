"""Small invented corpora with labels."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
SYLLABLES = {
    "en": "the and ing tion er on at en st nd re ha".split(), "de": "sch ung keit ein der ge ver ich ach te ß ü".split(),
    "fr": "eau ment tion ou re é è que la oi aux an".split(), "es": "ción ado ar que os mente ía ñ ra do la el".split(),
}


def prose(rng, lang, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))))
    return " ".join(out).capitalize() + "."


def corpus(n=240, seed=3):
    """Rows, quality labels and toxic labels: bad texts are full of signs, toxic ones hold an invented insult."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(prose(rng, lang, rng.randint(20, 60)) for _ in range(rng.randint(1, 3)))
        quality, toxic = int(rng.random() > 0.3), int(rng.random() < 0.3)
        if not quality:
            text = " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text.split()).upper()
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grubfinker", "snotwangler", "blatherskunk"]))
            text = " ".join(words)
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
        labels.append((i, quality, toxic))
    return rows, labels


#: Null, empty, blank, letterless and very long texts, repeated rows, a null id.
ODD = [
    (1001, None, "en", None, None), (1002, "", None, "s", 0), (1003, " \n\t", "en", "s", 3), (1004, "12345 !!", "en", "s", 8),
    (1005, "word " * 40_000, "en", "s", 200_000), (1006, "x" * 30_000, "de", "s", 30_000), (1007, "repeated row", "en", "s", 12), (1007, "repeated row", "en", "s", 12), (None, "no id here", "en", "s", 10),
]
