"""The pipeline's near-dedup against brute force: recall of edited copies, and what must stay."""

import random

from quarry.llm import simhash


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_recall_of_edited_copies_and_clean_documents(spark):
    """Pairs of Jaccard 0.8 or more lose one document, at least 0.95 of them; texts that share nothing all stay."""
    rng = random.Random(12)
    data, near = [], []
    for k in range(200):
        a = [f"d{k}w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 300))]
        b = list(a)
        for _ in range(rng.randint(1, 1 + len(a) // 70)):
            b[rng.randrange(len(b))] = f"edit{rng.randint(0, 10**6)}"
        x, y = _shingles(a), _shingles(b)
        if len(x & y) / len(x | y) >= 0.8:
            near.append(k)
        data += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    clean = [(1000 + k, " ".join(f"c{k}w{i}" for i in range(rng.randint(1, 40)))) for k in range(300)]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(data + clean, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(200)} <= kept
    assert {i for i, _ in clean} <= kept
    assert len(near) > 100
    assert sum(2 * k + 1 not in kept for k in near) >= 0.95 * len(near)


def test_texts_without_words_are_near_no_other(spark):
    """Of two shingles a fingerprint has a quarter of ones: some lie within the bound of the zero fingerprint."""
    two = next(t for t in (f"a b c d e{i} f" for i in range(20_000)) if bin(int.from_bytes(simhash.fingerprint(t, 5, 512), "big")).count("1") <= 102)
    docs = spark.createDataFrame([(1, None), (2, two), (3, ""), (4, " \n"), (5, "other words here")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [1, 2, 5]
