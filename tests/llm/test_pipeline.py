"""run() on the smallest tables, held against plain Python that follows the stages' rules."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

FOLDER = "/root/testdata/sf0.001"


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t, least=0):
    w = tokens(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and len(w) >= least else frozenset()


def matching(a, b):
    return a and b and 100 * len(a & b) >= 75 * len(a | b)


def test_pipeline(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from dagframe.llm import mixing, quality
    from dagframe.llm.queries import table, tokenizer_path

    docs = table(spark, FOLDER, "documents")
    weights = quality.train(docs, table(spark, FOLDER, "labels").where(quality.remainder("doc_id", 4) != 2))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    score = quality.scores(pa.array([r.text for r in rows]), weights)
    kept = [(r.doc_id, r.text, r.source) for r, s in zip(rows, score, strict=True) if s >= 0.5]
    good = {r.doc_id for r in table(spark, FOLDER, "labels").where("quality = 1").collect()}
    assert len(good - {i for i, *_ in kept}) <= 0.02 * len(good)

    # lines, in the order of ids
    earlier, by_token, cut = [], defaultdict(list), []
    for i, t, s in kept:
        left = []
        for line in t.split("\n"):
            own = shingle_set(line.lower())
            near = {k for x in own for k in by_token[x]}
            if not any(matching(own, earlier[k]) for k in near):
                left.append(line)
            earlier.append(own)
            for x in own:
                by_token[x].append(len(earlier) - 1)
        cut.append((i, "\n".join(left), s))

    # one of each component
    sets = [shingle_set(t.lower()) for _, t, _ in cut]
    root = list(range(len(cut)))
    for b in range(len(cut)):
        for a in range(b):
            if matching(sets[a], sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    alone = [c for k, c in enumerate(cut) if root[k] == k]

    # mixing: whole passes and the last one's cut, by source
    sizes = {i: len(tokens(t)) for i, t, _ in alone}
    totals = Counter()
    for i, _, s in alone:
        totals[s] += sizes[i]
    frame = spark.createDataFrame([("1" + s, n) for s, n in totals.items()], "_source string, _total long")
    goals = {r._source[1:]: r._target for r in mixing.targets(frame).collect()}
    assert sum(goals.values()) > 1.49 * sum(totals.values()) and all(goals[s] <= 2 * totals[s] for s in goals)
    expected = Counter()
    for s in totals:
        budget = int(goals[s] + 0.5)
        for i, _, _ in sorted((c for c in alone if c[2] == s), key=lambda c: hashlib.md5(f"{c[0]}:{sizes[c[0]]}".encode()).hexdigest()):
            passes, rest = divmod(budget, totals[s])
            before = sum(sizes[j] for j, _, q in alone if q == s and hashlib.md5(f"{j}:{sizes[j]}".encode()).hexdigest() < hashlib.md5(f"{i}:{sizes[i]}".encode()).hexdigest())
            taken = passes * sizes[i] + min(max(rest - before, 0), sizes[i])
            expected[i] = int(taken / max(sizes[i], 1) + 0.5)

    coder, texts = Tokenizer.from_file(tokenizer_path()), {i: t for i, t, _ in alone}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in out) == +expected
    for r in out:
        ids = coder.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == coder.decode(ids, skip_special_tokens=False)
