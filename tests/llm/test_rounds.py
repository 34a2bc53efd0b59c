"""Texts that the Jaccard join compares go out in rounds of bounded size."""

import numpy as np

from fringelake.llm import jaccard


def test_rounds_are_bounded_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        words = list(common)
        for k in rng.integers(0, 40, size=rng.integers(0, 4)):
            words[k] = f"x{rng.integers(0, 5)}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("NARROW", 2), ("SIDE", 8)):
        monkeypatch.setattr(jaccard, name, value)
    find = lambda: sorted(map(tuple, jaccard.jaccard_components(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()))
    want, sent = find(), []
    send = jaccard._compared

    def counted(rounds, run):
        def each():
            for rows in rounds:
                sent.append(rows.count())
                yield rows

        return send(each(), run)

    monkeypatch.setattr(jaccard, "_compared", counted)
    monkeypatch.setattr(jaccard, "BROADCAST_NODES", 40)
    assert find() == want and len({c for *_, c in want}) < 120
    # A round has whole groups, of at most 4 blocks each here, and is no share of all texts sent.
    assert len(sent) > 2 and max(sent) < sum(sent) / 2
