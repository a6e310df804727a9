"""Documents with the cases that each operator defines."""

LONG = " ".join(f"word{i % 977} tok{i % 31}" for i in range(60_000))
TEXTS = [None, "", "  \t\n ", "a", "Hello  world\tagain", "hello world again", "Hello world again", "é ß 😀   x", "x" * 200_000, LONG, "line one is here and long enough\nline one is here and long enougk\n\n short\nshort", "mail a@b.com or +1 (026) 555-4081 190.137.223.204, 4111 1111 1111 1111", "same text", "same text", "same text"]
IDS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13]
CLASH = ["x_prefix", "x_hash", "x_text", "key", "fp", "id", "h", "uid", "m", "start", "block", "bin", "rank", "crc", "tokens", "first", "u", "v", "score", "spans", "X_KEPT", "m_sha", "t", "y", "a.b"]


def docs(spark, more=()):
    """Rows with a null identifier, repeated rows, and columns whose names the operators use themselves."""
    rows = [*zip(IDS, TEXTS, strict=True), (None, "no id"), (None, None), *more]
    extra = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, None, "src", None, *[f"c{i}"] * len(CLASH)) for i, t in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


def empty(spark):
    return docs(spark).limit(0)
