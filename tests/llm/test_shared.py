"""Sets that meet by chance in one common shingle are not compared."""

import numpy as np

from fringelake.llm import jaccard


def brute(rows, n, percent):
    """(doc_id, component_id) by comparing all sets."""
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    forest = jaccard.Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                forest.join(i, j)
    return [(rows[i][0], rows[forest.top(i)][0]) for i in range(len(rows))]


def compared(monkeypatch):
    sent, send = [], jaccard._compared

    def counted(rounds, run):
        def each():
            for rows in rounds:
                sent.append(rows.count())
                yield rows

        return send(each(), run)

    monkeypatch.setattr(jaccard, "_compared", counted)
    return sent


def test_one_common_shingle_sends_no_texts(spark, monkeypatch):
    sent = compared(monkeypatch)
    # A sketch of few counts cannot tell the common shingle from others, as on large inputs.
    sketch = jaccard.frequency_sketch
    monkeypatch.setattr(jaccard, "frequency_sketch", lambda docs, n: 0 * sketch(docs, n))
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**9, size=60)]
        words[20:24] = [f"c{i % 10}"] * 4
        rows.append((i, " ".join(words)))
    copies = [(1000 + i, rows[i][1] + " end") for i in range(5)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows + copies, "doc_id long, text string"), 4, 85).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted([(i, i) for i, _ in rows] + [(1000 + i, i) for i in range(5)])
    assert sum(sent) <= 4 * len(copies)


def test_sets_of_all_sizes_agree_with_comparing_all(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 6, size=size)]
            for _ in range(3):
                near = list(words)
                for k in rng.integers(0, size, size=rng.integers(0, 2 + size // 30)):
                    near[k] = f"x{rng.integers(0, 3)}"
                rows.append((len(rows), " ".join(near[: size - rng.integers(0, 2)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for narrow, n, percent in ((64, 4, 85), (4, 2, 50)):
        monkeypatch.setattr(jaccard, "NARROW", narrow)
        found = jaccard.jaccard_components(docs, n, percent).select("doc_id", "component_id").collect()
        want = brute(rows, n, percent)
        assert sorted(map(tuple, found)) == sorted(want), (narrow, n, percent)
