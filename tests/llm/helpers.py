"""Small documents that every operator must bear."""

from collections import Counter, defaultdict

#: Columns that clash with names used inside operators.
CLASHING = ["id", "key", "n", "digest", "salt", "body", "bag", "label", "bucket", "first", "tokens", "own", "block", "shard", "item", "start", "lang_pred", "score", "n_lines", "ids"]


def documents(spark, rows, clash=True):
    """(doc_id, text, lang) with columns of clashing names."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    if clash:
        docs = docs.selectExpr("*", *[f"cast(doc_id % 2 as string) as {c}" for c in CLASHING])
    return docs


def words_of(text):
    import re

    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def bag(text, width=5):
    w = words_of(text)
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else None


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def classes(rows, threshold=0.8):
    """doc_id -> smallest doc_id of its class, by comparing all pairs."""
    bags = {i: bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for j, b in enumerate(ids):
        for a in ids[:j]:
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= threshold - 1e-9:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def grouped(mapping):
    out = defaultdict(list)
    for k, v in mapping.items():
        out[v].append(k)
    return sorted(map(sorted, out.values()))
