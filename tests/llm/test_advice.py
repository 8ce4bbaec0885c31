"""What the findings of the first review asked for."""

import random

import corpus_pipeline
from test_ops import corpus, frame

from loglattice.llm import linetree, shinglesets


def near_copies(seed=5):
    """Texts with edited copies of many distances, one large group and one passage that many others share."""
    r = random.Random(seed)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.randint(0, 3000)}" for _ in range(n)]
    passage, out = words(60), []

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
        return w

    for i in range(30):
        base = words(r.randint(20, 200))
        out += [base] + [edited(base, k) for k in range(1, 6)]
    big = words(150)
    out += [edited(big, r.randint(0, 4)) for _ in range(60)]
    out += [words(40) + passage + words(40) for _ in range(60)]
    r.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_pipeline_drops_near_copies(spark):
    rows = near_copies() + [(1000 + d, t) for d, t in corpus()]
    kept = lambda f: sorted(r["doc_id"] for r in f.collect())
    want = sorted(shinglesets.brute(rows))
    assert len(rows) - len(want) > 100
    assert kept(corpus_pipeline.near_dedup(spark, frame(spark, rows), "")) == want
    assert kept(shinglesets.keep_one(frame(spark, rows), block=16)) == want


def test_lines_of_two_documents_recur(spark):
    mail = "Subscribe to our weekly letter number {} for news and offers"
    rows = [(1, f"own words here\n{mail.format(1)}"), (2, f"{mail.format(22)}\nother text there"), (3, "we saw the dog run over green hills at noon"), (4, "we saw the man sit under green trees by night")]
    rows += [(5, f"{mail.format(3)}\n{mail.format(4)}"), (6, "twice in one\ntwice in one")]
    got = {r["row"]["doc_id"]: (r["n_dropped"], r["row"]["text"]) for r in linetree.drop_recurring(frame(spark, rows)).collect()}
    assert got[1] == (0, rows[0][1]) and got[2] == (1, "other text there") and got[5] == (2, "")
    assert all(got[d][0] == 0 for d in (3, 4, 6))  # little in common; twice in one document only
    assert sorted((d, n, t) for d, (n, t) in got.items()) == sorted((d, g, t) for d, _, g, t in linetree.brute(rows))
