import random

from tests.llm.data import documents, prose
from tracewell.llm import quality

KIND = "doc_id long, text string, source string, lang string, score string"


def corpus(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        text = prose(i, rng.randrange(10, 90))
        site = f"s{i % 6}"
        bad = rng.random() < (0.8 if site == "s0" else 0.1)
        if bad:
            text = rng.choice([text.upper() + "!!", " ".join(w + "%%%" for w in text.split()), (text.split()[0] + " ") * 40])
        rows.append((i, text, site, rng.choice(["en", "fr"]), "own"))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_accuracy_and_shrinkage(spark):
    docs, labels, truth = corpus(spark)
    model = quality.learn(docs, labels)
    extra = spark.createDataFrame([(1000, prose(5, 60), "sparse", "en", "x"), (1001, "X!! Y!! Z!!", "sparse2", "en", "x")], KIND)
    rows = quality.score(docs.union(extra), model).collect()
    right = sum(r.kept == bool(truth[r.doc_id]) for r in rows if r.doc_id < 1000)
    assert right / 600 > 0.95
    by_site = {r.host: r for r in rows}
    total = sum(r.evidence for r in rows) / len(rows)
    # A host of many bad documents keeps a low posterior; hosts of one document stay near the mean.
    assert by_site["s0"].host_posterior < 0.4 < by_site["s1"].host_posterior
    for site in ("sparse", "sparse2"):
        r = by_site[site]
        assert abs(r.host_posterior - total) < abs(r.evidence - total)


def test_posteriors_by_hand(spark):
    docs, labels, _ = corpus(spark)
    rows = quality.score(docs, quality.learn(docs, labels)).collect()
    mean = sum(r.evidence for r in rows) / len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r.host, []).append(r)
    strengths = set()
    for group in groups.values():
        s, n, post = sum(r.evidence for r in group), len(group), group[0].host_posterior
        assert min(mean, s / n) - 1e-9 <= post <= max(mean, s / n) + 1e-9
        strengths.add(round((s - n * post) / (post - mean), 4))
    assert len(strengths) == 1


def test_edges(spark):
    docs, labels, _ = corpus(spark)
    model = quality.learn(docs, labels)
    own = documents(spark)
    out = quality.score(own, model).collect()
    assert len(out) == own.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score(own.limit(0), model).collect() == []
    bare = quality.learn(docs, labels.limit(0))
    assert bare.base == 0.5 and {r.evidence for r in quality.score(own, bare).collect()} == {0.5}
