"""Documents with nulls, empty and long texts, repeated rows and columns of clashing names."""

from __future__ import annotations

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, spans string, h long, batch int, key string, "
    "score double, stratum string, component_id long, n_tokens long"
)
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
PASSAGE = "this passage of well over one hundred bytes stands in several of the documents, word for word, sign for sign, end."


def odd_rows() -> list[tuple]:
    base = [
        (1, None, "en", "src0"),
        (2, "", "en", None),
        (3, "   \n\t ", None, "src1"),
        (4, "one", "en", "src1"),
        (5, "one", "en", "src1"),
        (6, "ONE two three four five six seven", "en", "src2"),
        (7, "one two three four five six seven", "en", "src2"),
        (8, LONG, "en", "src0"),
        (9, LONG, "en", "src0"),
        (9, LONG, "en", "src0"),
        (10, "été à la plage 🙂 " + PASSAGE + " ß", "fr", "src0"),
        (11, PASSAGE + " fin", "fr", "src0"),
        (12, "1 2 3 !!! ???", "fr", "src3"),
        (None, "no id here, but text", "en", "src3"),
        (13, "x" * 5000, "de", "src4"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "a", 1, 2, "k", 0.5, "s", 7, 8) for i, t, lang, s in base]


def odd_frame(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
