"""Operators that once did less than the whole job."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from spanloom.llm import embedding_dedup, pii, url_trust


def test_trust_reaches_hosts_beyond_ten_links(spark):
    hosts = [f"h{i}.org" for i in range(16)]
    links = spark.createDataFrame([(a, b) for a, b in zip(hosts, hosts[1:])] + [("a.net", "b.net"), ("b.net", "a.net")], "src string, dst string")
    seeds = spark.createDataFrame([("h0.org", 3, 0), ("h15.org", 0, 2), ("a.net", 1, 0)], "host string, good long, bad long")
    got = {r.host: (r.trust, r.distrust) for r in url_trust.propagate(links, seeds).collect()}
    edges = {(a, b) for a, b in links.collect()}

    def rank(pairs, start):
        mass = dict(start)
        for _ in range(400):
            out = {h: 0.15 * m for h, m in start.items()}
            for a, b in pairs:
                out[b] = out.get(b, 0) + 0.85 * mass.get(a, 0) / sum(x == a for x, _ in pairs)
            mass = out
        return mass

    good, bad = rank(edges, {"h0.org": 0.75, "a.net": 0.25}), rank({(b, a) for a, b in edges}, {"h15.org": 1.0})
    assert set(got) == set(good) | set(bad) and got["h15.org"][0] > 0 and got["h0.org"][1] > 0
    for host, (trust, distrust) in got.items():
        assert (trust / url_trust.UNITS, distrust / url_trust.UNITS) == pytest.approx((good.get(host, 0), bad.get(host, 0)), abs=6e-6)


def test_values_beside_short_neighbours(spark):
    values = {
        "invoice 12 4111 1111 1111 1111": "4111 1111 1111 1111", "room 2024 4111-1111-1111-1111": "4111-1111-1111-1111", "4111 1111 1111 1111 12": "4111 1111 1111 1111",
        "pay ES9121000418450200051332 EUR": "ES9121000418450200051332", "BE68 5390 0754 7034 BIC": "BE68 5390 0754 7034", "at 2024-01-05T10:00:00 sharp": "2024-01-05",
        "4111 1111 1111 1111": "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32": "GB82 WEST 1234 5698 7654 32",
    }
    stay = ["12 4111 1111 1111 1112", "2024-01-05Tx", "2024-01-05T", "2024-01-051", "BE68 5390 0754 7035 BIC"]
    df = spark.createDataFrame([(t,) for t in [*values, *stay]], "text string").withColumn("was", F.col("text"))
    got = {r.was: r.text for r in pii.pseudonymise(df, "k").collect()}
    assert [got[t] for t in stay] == stay
    for text, value in values.items():
        before, after = text.split(value)
        new = got[text]
        assert len(new) == len(text) and new.startswith(before) and new.endswith(after) and value not in new
    alone = pii.pseudonymise(spark.createDataFrame([("4111 1111 1111 1111",)], "text string"), "k").first().text
    assert got["invoice 12 4111 1111 1111 1111"] == f"invoice 12 {alone}" and got["4111 1111 1111 1111 12"] == f"{alone} 12"


def test_vectors_are_not_copied(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((2003, 64)).astype(np.float32)
    x[1500:] = x[:503] + 0.3 * rng.standard_normal((503, 64))
    x[700:720] = x[3]
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return store.executorSummary("driver").totalShuffleWrite()

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    before = shuffled()
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, chunk=300).collect()}
    assert shuffled() - before < 3 * x.nbytes
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.9).sum(axis=1) - 1
    assert got == dict(enumerate(want.tolist())) and 0 < (want > 0).sum() < 1500
