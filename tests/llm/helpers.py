"""Hard rows that every operator must take."""

CLASH = "doc_id long, text string, ids string, base string, added string, score string, predicted string, host string, path string, rule string, `odd name.x` string"


def clash_rows(texts, start=0):
    """Rows whose other columns carry names that operators add themselves."""
    return [(i, t, *["kept"] * 9) for i, t in enumerate(texts, start)]


HARD = [None, "", " ", "word", "two words", "two words", "\n\n", "é𝒳日本 ", "x" * 30_000, "a b " * 20_000]
