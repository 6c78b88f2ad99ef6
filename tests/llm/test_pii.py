import numpy as np
import pytest

from memoriq.llm import pii

TEXT = "Spoke to Dr. Quilla Bigipaheim about the form.\nCall +44 20 7946 0313 and ask for the vase. Mail quilla.bofeld@fazilo.example.com today. SSN on file: 912-45-9625, checked. Ship the lamp to 1357 Gigaborough Close, Flat 3, Repistow 00971 on Friday. Magdalena agreed; order 5550179775 covers it."


def spans(*texts):
    return pii.label_texts(list(texts), pii.prepared(pii.load_weights()))


def test_finds_each_kind_and_leaves_the_rest():
    assert [(TEXT[a:b], k) for a, b, k in spans(TEXT)[0]] == [
        ("Quilla Bigipaheim", "name"), ("+44 20 7946 0313", "phone"), ("quilla.bofeld@fazilo.example.com", "email"),
        ("912-45-9625", "id_number"), ("1357 Gigaborough Close, Flat 3, Repistow 00971", "address"),
    ]


def test_offsets_are_code_points_and_windows_join():
    far = "🌱é plain words here. " * 400 + TEXT
    shift = len(far) - len(TEXT)
    assert [(a - shift, b - shift, k) for a, b, k in spans(far)[0] if a >= shift] == spans(TEXT)[0]
    for cut in range(300, 420, 17):  # a seam anywhere
        text = "x " * (cut // 2) + TEXT
        assert len(pii.label_texts([text], pii.prepared(pii.load_weights()))[0]) >= 5


def test_empty_and_odd_texts():
    assert spans("", "\n", "🌱" * 3000, "a" * 5000, "\ud800")[0] == []


def test_operators(spark):
    rows = spark.createDataFrame([("1", TEXT, "k"), ("2", None, "k"), ("3", "", "k"), (None, TEXT, "k")], "id string, text string, kind string")
    got = pii.find_personal(rows)
    assert got.count() == 10 and set(got.columns) == {"id", "start_offset", "end_offset", "kind"}
    out = {r["id"]: r for r in pii.redact_personal(rows).collect()}
    assert out["2"]["text"] is None and out["3"]["text"] == "" and out["1"]["n_places"] == 5
    assert out["1"]["text"].startswith("Spoke to Dr. [NAME] about the form.\nCall [PHONE] and ask") and "912-45" not in out["1"]["text"]
    assert pii.find_personal(rows.limit(0)).count() == 0


def test_gradients():
    from memoriq.llm.pii_train import initial, loss_and_grads

    g = np.random.default_rng(0)
    x, y = g.integers(1, 90, (3, 10)).astype(np.uint8), g.integers(0, pii.TAGS, (3, 10)).astype(np.int8)
    p = initial(1)
    _, grads = loss_and_grads(p, x, y)
    for k, at in {"wx": (0, 1, int(x[0, 3]), 5), "wh": (1, 2, 7), "wo": (3, 4), "bo": (2,), "trans": (1, 2)}.items():
        up, down = ({a: v.copy() for a, v in p.items()} for _ in "ab")
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        slope = (loss_and_grads(up, x, y)[0] - loss_and_grads(down, x, y)[0]) / 2e-2
        assert grads[k][at] == pytest.approx(slope, abs=2e-4, rel=0.05)


def test_training_learns():
    from memoriq.llm.pii_train import score, train

    g = np.random.default_rng(1)
    examples = []
    for _ in range(150):
        n = "".join(map(str, g.integers(0, 10, 9)))
        examples.append((f"call me on {n} soon", [(11, 20, "phone")]))
    held = [("call me on 123456789 soon", [(11, 20, "phone")])]
    w = train(examples, steps=300, batch=16, window=32, log=lambda *a, **k: None)
    assert score(held, w)["phone"] == (1, 1.0, 1.0)


def test_whole_texts_are_decoded_exactly():
    g = np.random.default_rng(4)
    for case in range(60):
        trans = g.normal(0, 2, (pii.TAGS, pii.TAGS)).astype(np.float32)
        lengths = g.integers(0, 30, 5)
        scores = g.normal(0, 3, (lengths.sum(), pii.TAGS)).astype(np.float32)
        scores[:, 0] += g.choice([0, 3, 25], len(scores), p=[0.3, 0.4, 0.3])
        trans[0, 1:] -= 3 * (case % 2)
        starts = np.r_[0, np.cumsum(lengths)]
        path = pii.best_path(np.ascontiguousarray(scores.T), starts, trans)
        worth = lambda p, e: sum(e[k, t] for k, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: E731,B023
        for a, b in zip(starts, starts[1:]):
            e = scores[a:b]
            best = e[:1].T if len(e) else np.zeros((1, 1))
            for row in e[1:]:
                best = (best + trans).max(0)[:, None] + row[:, None]
            if len(e):
                assert worth(path[a:b], e) == pytest.approx(best.max(), abs=1e-3)


def test_texts_that_have_ended_take_no_more_steps(monkeypatch):
    ready, g, done = pii.prepared(pii.load_weights()), np.random.default_rng(2), []
    lengths = np.array([200, 31, 30, 30, 5, 5, 5, 1])
    x = g.integers(1, 90, (8, 200)).astype(np.uint8)
    tanh = np.tanh
    monkeypatch.setattr(np, "tanh", lambda a, **k: (done.append(a.size), tanh(a, **k))[1])
    found = pii.lstm(ready, x, lengths)
    assert sum(done) < 0.4 * 100 * 8 * 2 * 5 * 32  # steps, texts, directions, gates and state, width
    for r, n in enumerate(lengths):
        alone = pii.lstm(ready, x[r : r + 1, : n + n % 2], lengths[r : r + 1])
        steps = -(-n // pii.STRIDE)
        assert np.allclose(found[:steps, :, r], alone[:steps, :, 0], atol=1e-4)


def test_portions_are_bounded_by_characters():
    texts = ["a" * n for n in (5, 5, 1, 30, 0, 9, 2)]
    parts = list(pii.portions(texts, 10))
    assert [t for p in parts for t in p] == texts and [[len(t) for t in p] for p in parts] == [[5, 5], [1], [30], [0, 9], [2]]
    assert list(pii.portions([])) == []


def test_the_network_needs_one_division_a_gate_and_no_tanh(monkeypatch):
    x = np.linspace(-40, 40, 2001, dtype=np.float32)
    out, scratch = np.empty_like(x), np.empty_like(x)
    pii.squash(x, out)
    assert np.allclose(out, x / (1 + np.abs(x.astype(float))), atol=1e-6)
    again = x.copy()
    pii.squash(again, again, scratch)
    assert np.array_equal(again, out)
    g, done = np.random.default_rng(2), []
    lengths = np.array([200, 31, 30, 30, 5, 5, 5, 1])
    divide = np.divide
    monkeypatch.setattr(np, "divide", lambda a, *b, **k: (done.append(a.size), divide(a, *b, **k))[1])
    monkeypatch.setattr(np, "tanh", lambda *a, **k: pytest.fail("tanh takes most of the network's time"))
    pii.lstm(pii.prepared(pii.load_weights()), g.integers(1, 90, (8, 200)).astype(np.uint8), lengths)
    steps = -(-lengths // pii.STRIDE)
    active = sum(max(r + 1 for r in range(8) if steps[r] > k) for k in range(steps[0]))
    assert sum(done) == active * 2 * 4 * 32  # directions, three gates and state, width


def test_scores_are_joined_and_decoded_alike_in_any_portion():
    ready = pii.prepared(pii.load_weights())
    texts = ["", TEXT, "a", "x " * 900 + TEXT, TEXT[:57], "", TEXT * 9, "\ud800", "b" * 40, ""]
    alone = [pii.label_texts([t], ready)[0] for t in texts]
    assert pii.label_texts(texts, ready) == pii.label_texts(texts, ready, group=2) == alone
    g = np.random.default_rng(5)
    trans = g.normal(0, 2, (pii.TAGS, pii.TAGS)).astype(np.float32)
    lengths = g.integers(0, 30, 40) * g.integers(0, 2, 40)
    scores = g.normal(0, 3, (pii.TAGS, lengths.sum())).astype(np.float32)
    scores[0] += g.choice([0, 3, 25], lengths.sum(), p=[0.3, 0.4, 0.3])
    starts = np.r_[0, np.cumsum(lengths)]
    whole = pii.best_path(scores, starts, trans)
    for block in (1, 7, 64):
        assert np.array_equal(pii.best_path(scores, starts, trans, block), whole)
