import hashlib

from luminal.llm import minhash


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def rows():
    base = [f"w{i * i % 977}" for i in range(1200)]
    out = [(i, " ".join(base[i : i + 40 + 11 * (i % 60)])) for i in range(400)]
    return out + [(400, None), (401, ""), (402, "one two"), (403, "one two"), (404, "long é " * 9000)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "NEIGHBOUR_ROWS", 7)
    data = rows()
    got = {r.doc_id: r for r in minhash.edited_likeness(spark.createDataFrame([(*r, 5, "z") for r in data], "doc_id long, text string, n int, sig string").repartition(9)).collect()}
    text = {i: t or "" for i, t in data}
    order = sorted(text, reverse=True)
    errors = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, k = text[a], len(text[a]) // 3
        edited = t[: len(t) - k] + text[b][:k]
        r = got[a]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, text[b])):
            x, y = shingles(t), shingles(other)
            errors.append(near - (len(x & y) / len(x | y) if x | y else 1.0))
    assert len(got) == len(data) and got[402].fingerprint == got[403].fingerprint
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.04


def test_odd_rows(spark):
    for data in ([], [(5, "alone here")], [(1, "a"), (1, "a"), (1, "b")], [(None, "x y"), (3, "z"), (None, "x y")]):
        out = minhash.edited_likeness(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert len(out) == len(data) and all(r.edited_sha256 for r in out)
