"""Rows with which every text operator must cope."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, clash=False):
    rows = [(i, t, ("en", "fr", None)[(i or 0) % 3], "src", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for name in ("rep", "first", "digest", "kept", "score", "bucket", "n", "pos", "label", "hits"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def hard_cases():
    base = " ".join(WORDS[:120])
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    return [
        (0, base),
        (1, base),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, base.upper()),
        (6, " ".join(WORDS[:119] + ["zz"])),
        (7, " ".join(WORDS[:60] + WORDS[200:280])),
        (8, "one two"),
        (9, "one two"),
        (10, long),
        (11, " ".join(["same"] * 80)),
        (12, " ".join(WORDS[300:340] + WORDS[20:60])),
        (13, "ünïcode glued wörds é " * 20),
        (14, "12 34 !!"),
    ]
