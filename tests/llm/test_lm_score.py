import math
import random
from collections import Counter

import pytest

from chainloom.llm.lm_score import score
from tests.llm.brute import SPACED


def brute(rows, order, backoff=0.4):
    docs = [SPACED.findall(t or "") for _, t in rows]
    own = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in docs]
    every = sum(own, Counter())
    total = sum(map(len, docs))
    out = []
    for (d, _), w, mine in zip(rows, docs, own):
        f = lambda g: every[g] - mine[g]  # noqa: B023, E731
        others = total - len(w)

        def s(i, n):
            if n == 1:
                return f((w[i],)) / others if f((w[i],)) > 0 else 1 / (others + 1)
            g = tuple(w[i - n + 1 : i + 1])
            return f(g) / f(g[:-1]) if f(g) > 0 else backoff * s(i, n - 1)

        logs = sum(math.log(s(i, min(order, i + 1))) for i in range(len(w)))
        out.append((d, len(w), logs))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, order):
    rng = random.Random(9)
    word = lambda: "wé" + str(int(rng.paretovariate(0.8)) % 50)
    rows = [(i, " \n".join(word() for _ in range(rng.randrange(40)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "once"), (63, rows[1][1]), (64, rows[1][1]), (64, rows[1][1]), (None, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in score(docs, order=order).collect()), key=str)
    assert got == sorted(((d, n, round(x, 6) or 0.0) for d, n, x in brute(rows, order)), key=str)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, None)], "doc_id bigint, text string, n_words int")
    out = score(docs)
    assert out.columns == ["doc_id", "n_words", "_n_words", "log_score", "mean_log_score"]
    assert {r.doc_id: r.mean_log_score for r in out.collect()} == {1: math.log(1.0) + (math.log(1.0) + math.log(0.4)) / 2, 2: None}
    assert score(docs.limit(0)).count() == 0


def test_packing():
    import numpy as np

    from chainloom.llm.lm_score import pack_counts, pack_keys, unpack_counts, unpack_keys

    n = np.array([1, 254, 255, 256, 1 << 40, 2, 1, 1, 1])
    keys = np.array([0, 5, 5 + (1 << 40) - 1, 1 << 44, (1 << 48) - 1], dtype=np.uint64)
    for k in range(10):
        assert (unpack_counts(*pack_counts(n[:k]), k) == n[:k]).all()
        assert (unpack_keys(pack_keys(keys[:k])) == keys[:k]).all()
