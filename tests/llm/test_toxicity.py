import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from speechlake.llm import toxicity as X


def naive(a, b):
    """Common subsequences, counted one by one."""
    from itertools import combinations

    def weights(s):
        out = {}
        for ix in combinations(range(len(s)), X.ORDER):
            u = "".join(s[i] for i in ix)
            out.setdefault(u, []).append(ix[-1] - ix[0] + 1)
        return out

    x, y = weights("\x02" + a), weights("\x02" + b)
    return sum(X.DECAY ** (p + q) for u in x if u in y for p in x[u] for q in y[u])


def test_kernel_counts_subsequences():
    words = ["idiot", "idi-ot", "banana", "an", "xyz", "idiiot"]
    b = X._codes(words, 8, -2)
    k = X.raw_kernel(X._codes(words, 8, -1), b)
    assert np.allclose(k, [[naive(a, c) for c in words] for a in words], rtol=1e-4, atol=1e-6)
    kernel = X.WordKernel(["idiot"])
    near = kernel(["idiot", "idi-ot", "i.d.i.o.t", "idiiot", "banana"])[:, 0] ** (1 / X.SHARPEN)
    assert near[0] > 0.999 and near[3] > 0.6 and near[1] > 0.5 and near[2] > 0.1 > near[4]


def test_spelled_out_words_and_sentences():
    assert ["idiot"] in X.sentences("you i d i o t you")
    assert X.sentences("") == [] and max(map(len, X.sentences("w%d " * 3 % (1, 2, 3) + " ".join(f"v{i}" for i in range(100))))) <= X.SENTENCE


def test_held_out_accuracy():
    sf = "/root/testdata/sf0.1"
    d = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    train, test = d[~out], d[out]
    model = X.fit(train[train.toxic == 1].text.tolist()[:300], train[train.toxic == 0].text.tolist()[:600])
    score = np.array(model.score(test.text.tolist()))
    assert ((score >= 0.5) == (test.toxic == 1)).mean() >= 0.92
    assert (score[test.toxic == 1].mean() - score[test.toxic == 0].mean()) > 0.4


def test_awkward_empty_and_clashing(awkward, nothing):
    model = X.fit(["you idiot", "such an idiot", "idiot here"], ["a fine day", "good words here", ""])
    out = X.toxicity(awkward.withColumn("score", F.lit("x")), model).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert len({r["score"] for r in out if not r["text"]}) == 1
    assert X.toxicity(nothing, model).count() == 0
    assert X.fit([], ["a"]).score(["b", ""]) == [X.fit([], ["a"]).score(["b"])[0]] * 2


def test_training_texts_are_bounded(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    pos, neg = X.training_texts(docs, labels, 5)
    assert 0 < len(pos) <= 5 and 0 < len(neg) <= 5


def test_query_takes_no_texts_to_the_driver(spark, sf, docs, monkeypatch):
    seen, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: seen.append(self.columns) or collect(self))
    X.op3_subsequence_kernel_toxicity(spark, sf)
    assert seen and not any("text" in columns for columns in seen)


def test_trained_in_a_task_equals_fit(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, two = X.trained(docs, labels), X.fit(*X.training_texts(docs, labels))
    assert one.landmarks == two.landmarks and np.allclose(one.weights, two.weights) and np.allclose([one.bias, one.a, one.b], [two.bias, two.a, two.b])
    for some, kinds in ((docs, labels.where("toxic = 0")), (docs, labels.where("toxic = 1")), (docs, labels.limit(0)), (nothing, labels)):
        one, two = X.trained(some, kinds), X.fit(*X.training_texts(some, kinds))
        assert one.__getstate__()[2:] == two.__getstate__()[2:] and one.score(["a"]) == two.score(["a"])


def test_values_of_many_texts_are_those_of_their_sentences(rows):
    model = X.fit(["you idiot. go away!", "such an idiot", "idiot here"], ["a fine day", "good words here", ""])
    texts = [t[:3000] for _, t, *_ in rows if t] + ["i d i o t", "a b.\nc d e f ... ! x", "", "   ", "idiot.\u0085idiot! idiot", "\x00 x \x00"]
    assert np.allclose(model.values(texts), [model.worst(X.sentences(t)) for t in texts], atol=1e-6)
    assert np.allclose(model.values(texts)[::-1], model.values(texts[::-1]), atol=1e-9)


def test_word_kernel_equals_subsequence_counts():
    landmarks = ["idiot", "banana", "ananas"]
    words = ["idiot", "id-iot", "an", "bananas", "zzz", "ot", "anna", "\U0001f600nana"]
    exact = [[naive(a, b) / (naive(a, a) * naive(b, b)) ** 0.5 if naive(a, a) else 0.0 for b in landmarks] for a in words]
    assert np.allclose(X.WordKernel(landmarks)(words), np.array(exact) ** X.SHARPEN, atol=1e-5)


def test_query_equals_brute_force(spark, sf, rows):
    """Scores from subsequences that are counted one by one, with the fitted weights."""
    from functools import cache
    from itertools import combinations

    out = {r["doc_id"]: r["score"] for r in X.op3_subsequence_kernel_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = X.fit(*X.training_texts(docs, labels.where(~X.held_out(F.col("doc_id")))))

    @cache
    def weights(word):
        found = {}
        word = "\x02" + word
        for ix in combinations(range(len(word)), X.ORDER):
            u = tuple(word[i] for i in ix)
            found[u] = found.get(u, 0.0) + X.DECAY ** (ix[-1] - ix[0] + 1)
        norm = sum(v * v for v in found.values()) ** 0.5
        return {u: v / norm for u, v in found.items()}

    @cache
    def share(word):
        parts = [word] if len(word) <= X.LONGEST else [word[s : s + X.LONGEST] for s in range(0, len(word) - X.LONGEST // 2, X.LONGEST // 2)]
        dot = lambda a, b: sum(v * b.get(u, 0.0) for u, v in a.items())
        return sum(w * max(dot(weights(mark), weights(p)) for p in parts) ** X.SHARPEN for mark, w in zip(model.landmarks, model.weights, strict=True))

    for i, t, *_ in rows:
        value = max((sum(share(X.bare(x)) for x in s) for s in X.sentences(t or "")), default=0.0) + model.bias
        assert abs(out[i] - 1 / (1 + np.exp(-np.clip(model.a * value + model.b, -60, 60)))) < 1e-3


def test_query(spark, sf, rows):
    out = X.op3_subsequence_kernel_toxicity(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == [r[0] for r in rows]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
