"""Ranked search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumisift.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, score long, rank int, item_id long"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top):
    split = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in split), sum(n for *_, n in split)
    df = Counter(w for _, c, _ in split for w in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in split:
            m = 75 + (25 * n * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def corpus(seed, n=500):
    rng = random.Random(seed)
    vocabulary = [f"{'É' if k % 7 == 0 else ''}w{k}" for k in range(300)]
    pick = lambda m: " ".join(vocabulary[min(int(rng.expovariate(0.02)), 299)] for _ in range(m))
    docs = [(k * 2, pick(rng.randrange(0, 60))) for k in range(n)]
    items = [(k, pick(rng.randrange(1, 30))) for k in range(25)]
    docs += [(2 * n + k, f"{pick(10)}, {rng.choice(items)[1].upper()}; {pick(4)}") for k in range(60)] + [(None, items[3][1]), (7, None), (9, ""), (11, "- , ;")] + docs[:3] * 2
    docs += [(5000 + k, items[4][1] + " same") for k in range(70)]  # more equal scores than places
    return docs, [*items, (100, "nowhere at_all"), (101, None), (102, ""), (3, items[3][1]), (3, "w1 w1 w1"), (None, "w2 w9")]


@pytest.mark.parametrize(("seed", "top", "shard_docs", "block"), [(1, 20, 4096, 16), (2, 5, 64, 4), (3, 20, 32, 2), (4, 1, 16, 1)])
def test_search(spark, seed, top, shard_docs, block):
    docs, items = corpus(seed)
    table = spark.createDataFrame([(*d, "en", 1, 1, 1) for d in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    got = lexical_search.search(spark, table, asked, top, shard_docs=shard_docs, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, [i for i in items if i[1] is not None], top)


def test_items_in_blocks_and_empty_tables(spark):
    docs, items = corpus(5, 100)
    table = spark.createDataFrame([(*d, "en", 1, 1, 1) for d in docs], SCHEMA)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(spark, table, asked, block_chars=700)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, [i for i in items if i[1] is not None], 20)
    assert lexical_search.search(spark, table.where("false"), asked).count() == 0
    assert lexical_search.search(spark, table, asked.where("false")).count() == 0


def test_bounds_hold_and_skip():
    """No document of a block scores above the block's summary, and blocks do get skipped."""
    docs, items = corpus(6, 800)
    held = lexical_search.Items([i for i in items[:25]])
    table = [(k, terms(t)) for k, (_, t) in enumerate(docs) if terms(t)]
    place = {h: k for k, h in enumerate(held.hashes.tolist())}
    import pyarrow as pa

    from lumisift.llm.text import batches_of

    of, hashes = lexical_search._terms_of(next(batches_of(pa.array([k for k, _ in table]), pa.array([" ".join(w) for _, w in table]), 1 << 40)))
    counts = Counter((int(d), place[h]) for d, h in zip(of, hashes.tolist(), strict=True) if h in place)
    pairs = sorted(counts)
    kept = sorted({d for d, _ in pairs})
    as_row = {
        "ids": np.array(kept, np.int64), "sizes": np.array([len(table[d][1]) for d in kept], np.int64),
        "ends": np.searchsorted([d for d, _ in pairs], kept, "right").astype(np.int32), "terms": np.array([t for _, t in pairs], np.int32), "counts": np.array([counts[p] for p in pairs], np.int32),
    }
    weights = lexical_search.Weights(np.bincount([t for _, t in pairs], minlength=len(held.hashes)), len(table), sum(len(w) for _, w in table))
    row = {k: v.tobytes() for k, v in as_row.items()} | {"n_docs": len(table), "n_terms": 1}
    shard = lexical_search.Shard(row, weights)
    every = np.arange(len(shard.ids))
    bars = np.array([shard.best(every, lexical_search._dense(held, k, np.zeros(len(held.hashes), np.int64)), 1, 3)[1][-1] for k in range(25)])
    made = next(lexical_search._blocked(held, weights, bars, 4)(iter([pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})])))
    s = lexical_search.Shard(made.to_pylist()[0], weights).stored
    ends, tops = np.concatenate([[0], s["block_ends"]]), np.concatenate([[0], s["summary_ends"]])
    skipped = 0
    for k in range(25):
        times = lexical_search._dense(held, k, np.zeros(len(held.hashes), np.int64))
        opened = set(shard.to_open(held.terms[k], held.times[k], int(bars[k])).tolist())
        for b, a in enumerate(s["block_list"].tolist()):
            if a in opened:
                bound = int((s["summary_max"][tops[b] : tops[b + 1]] * times[s["summary_terms"][tops[b] : tops[b + 1]]]).sum())
                members = s["members"][ends[b] : ends[b + 1]]
                assert shard.best(members, times, 0, 1)[1][0] <= bound
                skipped += bound < bars[k]
    assert skipped > 50
