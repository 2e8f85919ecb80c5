"""Repeated lines and words can reject a document; estimates and verdicts equal those of numpy."""

import numpy as np

from factloom.llm import quality


def test_repeats_alone_reject(spark):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("w%04d" % x for x in rng.integers(0, 5000, n))
    rows = [(i, "\n".join(words(10) for _ in range(9))) for i in range(200)]
    rows.append((1000, "\n".join(f"{words(8)}\nReply\nShare\nLike" for _ in range(100))))
    rows.append((1001, "\n".join([words(10)] * 2 + [words(10) for _ in range(7)])))  # 11 % repeated lines
    half = words(48)
    rows.append((1002, f"{half} {half} {words(100)}"))  # 49 % of the words, no line twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    page = got[1000]
    assert page.n_dup_lines == 297 and not page.base_failed and not page.kept
    assert not got[1002].base_failed and not got[1002].kept
    assert got[1001].kept and all(got[i].kept for i in range(200))


FLOORS = np.diag(np.array(list(quality.FEATURES.values())) ** 2)


def subset(x, centre, cov):
    """Weights of the h rows nearest to an estimate; rows of the last distance step share what is missing."""
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov + FLOORS), x - centre)
    h = int(np.ceil(len(x) * quality.SHARE - 1e-9))
    far = np.log1p(np.maximum(d, 0)) * quality.GRAIN
    step = np.floor(far) * 2 * quality.FINE + np.floor((far - np.floor(far)) * quality.FINE)
    _, inverse, counts = np.unique(step, return_inverse=True, return_counts=True)
    return np.clip((h - (np.cumsum(counts) - counts)) / counts, 0, 1)[inverse]


def moments(x, w):
    mean = (w[:, None] * x).sum(0) / w.sum()
    return mean, np.einsum("i,ij,ik->jk", w, x, x) / w.sum() - np.outer(mean, mean)


def least_determinant(x):
    """(log determinant, centre, covariance) by concentration from the same starts, row by row."""
    bins = np.sort(np.floor(x * 64), 0)
    at = lambda p: (bins[max(0, int(np.ceil(len(x) * p - 1e-9)) - 1)] + 0.5) / 64
    middle, spread = at(0.5), (at(0.75) - at(0.25)) / 1.349
    scale = np.sqrt(spread**2 + np.diag(FLOORS))
    u = (x - middle) / scale
    signs = u.T @ (u / np.maximum((u * u).sum(1), 1e-12)[:, None]) / len(x) * 4 * np.outer(scale, scale)
    best = None
    for centre, cov in ((middle, np.diag(spread**2)), moments(x, np.ones(len(x))), (middle, signs)):
        found = np.inf
        while True:
            mean, raw = moments(x, subset(x, centre, cov))
            wide = raw * quality.consistency()
            after = np.linalg.slogdet(wide + FLOORS)[1]
            if found - after <= 1e-9:
                break
            found, centre, cov = after, mean, wide
        if best is None or found < best[0] - 1e-9:
            best = found, centre, cov
    return best


def test_small_groups_against_numpy(spark):
    rng = np.random.default_rng(4)
    names = list(quality.FEATURES)
    rows = []
    for g in range(40):
        n = int(rng.integers(1, 60))
        x = rng.normal(0, 0.3, (n, 4)) @ rng.normal(0, 1, (4, 4)) + rng.normal(0, 1, 4)
        x[: n // 6] += rng.normal(0, 5, 4)  # a cluster far off
        x[n // 2 :: 5] = x[0]  # repeated rows
        rows += [(f"l{g % 3}" if g % 7 else None, f"s{g}", *map(float, r)) for r in x]
    frame = spark.createDataFrame(rows, "m_lang string, m_source string, " + ", ".join(f"{c} double" for c in names))
    counts, estimates = quality.concentrate(frame)
    assert counts.count() == 40 and estimates.count() == 40 + 4 + 1
    found = {(r.g_lang, r.g_source): r for r in estimates.collect()}
    for (lang, source), r in found.items():
        x = np.array([row[2:] for row in rows if lang in (quality.ALL, row[0]) and source in (quality.ALL, row[1])])
        want = least_determinant(x)
        assert abs(want[0] - r.logdet) < 1e-6 and np.allclose(want[1], r.centre, atol=1e-6)

    e = {k: (len([1 for row in rows if k[0] in (quality.ALL, row[0]) and k[1] in (quality.ALL, row[1])]), np.array(r.centre), np.array(r.cov).reshape(4, 4)) for k, r in found.items()}
    for r in quality.estimate(frame).collect():
        _, mean, cov = e[quality.ALL, quality.ALL]
        for k in ((r.g_lang, quality.ALL), (r.g_lang, r.g_source)):
            n, m, c = e[k]
            w = n / (n + quality.PARENT_ROWS)
            mean, cov = w * m + (1 - w) * mean, w * c + (1 - w) * cov + w * (1 - w) * np.outer(m - mean, m - mean)
        assert np.allclose(r.centre, mean) and np.allclose(np.array(r.inverse).reshape(4, 4), np.linalg.inv(cov + FLOORS))


def test_verdicts_against_numpy(spark):
    rng = np.random.default_rng(6)
    words = lambda n, k: " ".join("w" * int(rng.integers(1, k)) + str(x) for x in rng.integers(0, 900, n))
    rows = [(i, words(60, 9) if i % 11 else words(60, 40) + " #" * 30, f"l{i % 2}", f"s{i % 5}") for i in range(160)] + [(900, "a b", "l0", "s0"), (901, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    estimates = {(r.g_lang, r.g_source): r for r in quality.estimate(quality.measured(docs, "lang", "source", "text", {}).where("NOT base_failed")).collect()}
    cut = quality.chi2_quantile(1 - quality.TAIL, 4)
    for i, _, lang, source in rows:
        r = got[i]
        if r.base_failed:
            assert not r.kept and r.distance is None and i >= 900
            continue
        e = estimates[lang, source]
        off = np.array([r[c] for c in quality.FEATURES]) - np.array(e.centre)
        d = off @ np.array(e.inverse).reshape(4, 4) @ off
        assert abs(d - r.distance) < 1e-6 * max(1, d) and r.kept == (d <= cut)
    assert 0 < sum(not r.kept for r in got.values()) < 40
