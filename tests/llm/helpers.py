"""Fixtures that every operator's tests share: awkward rows, and columns whose names clash with the results'."""

LONG = "lorem ipsum dolor sit amet, consectetur " * 3000

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n\r\x0b\x0c ", "fr"),
    (5, "one", "en"),
    (6, "two words", None),
    (7, LONG, "en"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (None, "a row without an id\nand a second line", None),
    (8, "naïve café 中文 ¿qué? <|endoftext|>   \x1c end", "es"),
    (9, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
]


def documents(spark, rows=None):
    """A documents table with extra columns named like results and helpers."""
    full = [(i, t, lang, "src0", None if t is None else len(t), 7, "x", True) for i, t, lang in (AWKWARD if rows is None else rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id int, fingerprint string, kept boolean"
    return spark.createDataFrame(full, schema)


def plain_documents(spark, rows=None):
    """A documents table with its own five columns."""
    return documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")


def clusters(n, label):
    """Smallest member of each node's component, for a function of two nodes."""
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if label(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(a) for a in range(n)]
