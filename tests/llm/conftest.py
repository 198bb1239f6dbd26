import pytest

ODD = ["row", "_id", "_key", "row_key", "hash", "set_id", "component_id", "spans", "key", "copies", "n", "kept"]


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang]); with ``odd``, also columns whose names operators use inside."""

    def build(rows, odd=True):
        extra = ", ".join(f"{c} string" for c in ODD) if odd else ""
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + extra if odd else "")
        full = []
        for r in rows:
            doc_id, text, lang = (*r, "en")[:3]
            full.append((doc_id, text, lang, "src", None if text is None else len(text), *(["x"] * len(ODD) if odd else [])))
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def prose():
    """Random sentences, the same for the same seed."""
    import random

    def build(n_words, seed):
        r = random.Random(seed)
        parts = ["the", "of", "and", "ing", "ra", "mo", "te", "lin", "é", "ßu"]
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n_words))

    return build
